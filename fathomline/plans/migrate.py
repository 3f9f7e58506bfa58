"""Moving an entry's vectors into another space while it is in use: convert or embed again in watermark order, then swap."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import templates
from fathomline.operators import changes as C
from fathomline.operators.lineage import cut
from fathomline.plans.catalog import Catalog, Entry
from fathomline.sources.embedders import Converter, Embedder, converted, embedded

MOST_BACKOFF = 300
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


class MigrationError(ValueError):
    """The step is refused."""


@dataclass(frozen=True)
class Migration:
    """State: running -> awaiting_finalize -> done; or aborted, or failed (final)."""

    id: int
    registry_id: int
    old_model: str
    new_model: str
    old_dim: int
    new_dim: int
    strategy: str
    column: str
    state: str = "running"
    rows_total: int = 0
    rows_done: int = 0
    rows_skipped: int = 0
    failures: int = 0
    last_pk: str | None = None
    error: str | None = None


@dataclass
class Migrator:
    """Steps of migrations. A batch is (new column is null) rows after the watermark; a vector that is there is newer."""

    catalog: Catalog
    embedders: dict[str, Embedder]
    converters: dict[tuple[str, str], Converter]
    batch_rows: int = BATCH_ROWS
    batch_bytes: int = BATCH_BYTES
    document_bytes: int = C.Limits().document_bytes
    most_failures: int = 5

    def all(self) -> list[Migration]:
        v = self.catalog.store.version("migrations")
        return [] if v is None else [Migration(**m) for m in v["migrations"]]

    def _save(self, m: Migration) -> Migration:
        rest = [x for x in self.all() if x.id != m.id]
        rows = [(x.id, x.registry_id, x.state, x.rows_total, x.rows_done, x.rows_skipped) for x in [*rest, m]]
        df = self.catalog.store.spark.createDataFrame(rows, "id bigint, registry_id bigint, state string, rows_total bigint, rows_done bigint, rows_skipped bigint")
        self.catalog.store.write("migrations", df, migrations=[asdict(x) for x in sorted([*rest, m], key=lambda x: x.id)])
        return m

    def _entry(self, m: Migration) -> Entry:
        return next(e for e in self.catalog.entries() if e.id == m.registry_id)

    def start(self, table: str, source: str, new_model: str, strategy: str = "auto") -> Migration:
        """Check, choose the way (auto: a converter if there is one, else embedding again), add the new null column."""
        e = self.catalog.find(table, source)
        if any(m.registry_id == e.id and m.state in ("running", "awaiting_finalize") for m in self.all()):
            raise MigrationError("a migration is under way")
        if e.chunking != "none":
            raise MigrationError("chunked entries are split and embedded anew instead")
        if new_model == e.model:
            raise MigrationError("that is the model in use")
        converter = self.converters.get((e.model, new_model))
        if strategy == "auto":
            strategy = "convert" if converter else "reembed"
        if strategy == "convert" and converter is None:
            raise MigrationError(f"no converter from {e.model} to {new_model}")
        if strategy == "reembed" and new_model not in self.embedders:
            raise MigrationError(f"no route to {new_model}")
        if strategy not in ("convert", "reembed"):
            raise MigrationError("strategy must be auto, convert or reembed")
        dim = converter.target_dim if strategy == "convert" else self.embedders[new_model].dim
        df, column = self.catalog.store.read(table), f"{e.vector}_new"
        if column in df.columns:
            raise MigrationError(f"column {column!r} exists")
        what = e.vector if strategy == "convert" else e.source
        total = df.where(F.col(what).isNotNull()).count()
        self.catalog.store.write(table, df.withColumn(column, F.lit(None).cast("array<float>")))
        self.catalog._save([replace(x, state="migrating") if x.id == e.id else x for x in self.catalog.entries()])
        return self._save(Migration(max([m.id for m in self.all()], default=0) + 1, e.id, e.model, new_model, e.dim, dim, strategy, column, rows_total=total))

    def _batch(self, m: Migration, e: Entry) -> DataFrame:
        df = self.catalog.store.read(e.table)
        what = F.col(e.vector) if m.strategy == "convert" else templates.rendered(e.format, e.source)
        rows = df.where(F.col(m.column).isNull()).select(*e.key, what.alias("what")).where("what is not null")
        page = cut(C.keyset_page(rows, e.key, C.after_watermark(df, e.key, m.last_pk), self.batch_rows))
        size = F.size("what") * 4 if m.strategy == "convert" else F.octet_length("what")
        first = page.orderBy(*e.key).limit(1)
        return C.budget_prefix(page, [F.col(k) for k in e.key], size, self.batch_bytes).unionByName(first).dropDuplicates(list(e.key))

    def step(self, m: Migration) -> Migration:
        """One batch: convert or embed, put in where the new column is still null, move the watermark."""
        if m.state != "running":
            return m
        e = self._entry(m)
        batch = cut(self._batch(m, e))
        last = C.watermark_of(batch, e.key)
        if last is None:
            return self._save(replace(m, state="awaiting_finalize"))
        skipped = batch.limit(0)
        if m.strategy == "reembed":  # as in the queue, a text over the document bound is never sent
            skipped, batch = (batch.where(F.octet_length("what") > self.document_bytes), batch.where(F.octet_length("what") <= self.document_bytes))
        made = cut(converted(batch, "what", self.converters[e.model, m.new_model]) if m.strategy == "convert" else embedded(batch, "what", self.embedders[m.new_model]))
        counts = {r.status: r["count"] for r in made.groupBy("status").count().collect()}
        if counts.get("retry"):
            error = made.where("status = 'retry'").first().error
            failed = m.failures + 1
            return self._save(replace(m, failures=failed, error=error, state="failed" if failed > self.most_failures else "running"))
        there = self.catalog.store.read(e.table).where(F.col(m.column).isNotNull()).select(*e.key)
        fresh = made.where("status = 'ok'").join(there, list(e.key), "left_anti")
        self.catalog.store.patch(e.table, e.key, m.column, fresh.select(*e.key, F.col("vector").alias("value")))
        ok = counts.get("ok", 0)
        return self._save(replace(m, rows_done=m.rows_done + ok, rows_skipped=m.rows_skipped + sum(counts.values()) - ok + skipped.count(), last_pk=last, failures=0, error=None))

    def run(self, m: Migration, wait: Callable[[float], None] = time.sleep, most_steps: int | None = None) -> Migration:
        """Steps until the migration is no longer running, with a growing pause after failures; or as many as asked for."""
        steps = 0
        while m.state == "running" and (most_steps is None or steps < most_steps):
            m, steps = self.step(m), steps + 1
            if m.failures and m.state == "running":
                wait(self.backoff(m))
        return m

    def backoff(self, m: Migration, base_seconds: float = 5.0) -> float:
        return min(MOST_BACKOFF, base_seconds * 2 ** min(m.failures, 10))

    def finalize(self, m: Migration) -> Migration:
        """The new column takes the old one's name in one snapshot; the entry has the new model."""
        if m.state != "awaiting_finalize":
            raise MigrationError(f"the migration is {m.state}")
        e = self._entry(m)
        df = self.catalog.store.read(e.table)
        columns = [c for c in df.columns if c not in (e.vector, m.column)]
        at = df.columns.index(e.vector)
        self.catalog.store.write(e.table, df.select(*columns[:at], F.col(m.column).alias(e.vector), *columns[at:]))
        self.catalog._save([replace(x, model=m.new_model, space=m.new_model, dim=m.new_dim, state="active") if x.id == e.id else x for x in self.catalog.entries()])
        return self._save(replace(m, state="done"))

    def abort(self, m: Migration) -> tuple[Migration, DataFrame]:
        """Drop the new column; returns the keys whose vector only it held, to be queued again."""
        if m.state not in ("running", "awaiting_finalize", "failed"):
            raise MigrationError(f"the migration is {m.state}")
        e = self._entry(m)
        df = self.catalog.store.read(e.table)
        lost = df.where(F.col(e.vector).isNull() & F.col(m.column).isNotNull()).select(*e.key)
        self.catalog.store.write(e.table, df.drop(m.column))
        self.catalog._save([replace(x, state="active") if x.id == e.id else x for x in self.catalog.entries()])
        return self._save(replace(m, state="aborted")), lost
