"""Registry of maintained columns, and the versioned snapshots that hold tables and control state."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.functions import chunking, templates
from fathomline.operators.search import HybridIndex

#: Types whose values have a plain text.
TEXT_LIKE = (T.StringType, T.VarcharType, T.CharType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)
MOST_NAME = 59
#: Tables of control state besides the registry.
CONTROL = ("jobs", "jobs_dead", "models", "migrations")
#: Versions of a table that stay for its readers, and patches beyond which they are merged whatever their size.
KEPT, MOST_PATCHES = 8, 256


class CatalogError(ValueError):
    """The verb is refused; nothing has changed."""


@dataclass(frozen=True)
class Entry:
    """One maintained (table, source column)."""

    id: int
    table: str
    source: str
    vector: str
    key: tuple[str, ...]
    model: str
    space: str
    dim: int
    distance: str = "cosine"
    config: str = "simple"
    format: str | None = None
    chunking: str = "none"
    chunk_size: int | None = None
    chunk_overlap: int | None = None
    destination: str | None = None
    token: str | None = None
    backfill: str = "queue"
    watermark: str | None = None
    owns_vector: bool = True
    state: str = "active"
    shape: str | None = None


class Store:
    """Tables as immutable Parquet versions and patches under one root; a pointer file, replaced by rename, names the current
    ones.

    All file access is by the cluster's file system, so the root can be anywhere Spark reads. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current.json"

    def version(self, name: str) -> dict | None:
        p = self._path(self._pointer(name))
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame | None:
        """The current version with its patches merged in."""
        v = self.version(name)
        if v is None:
            return None
        df = self.spark.read.schema(T.StructType.fromJson(v["schema"])).parquet(f"{self.root}/{name}/v={v['n']}")
        for column in dict.fromkeys(p["column"] for p in v.get("patches", [])):
            own = [p for p in v["patches"] if p["column"] == column]
            keys = own[0]["keys"]
            fresh = self.spark.read.parquet(*[self._patch(name, v["n"], p["i"]) for p in own])
            last = fresh.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct("value"), "__i").alias("__last"))
            on = F.lit(True)
            for k in keys:
                on = on & (F.col(k) == F.col(f"__{k}"))
            new = F.when(F.col("__last").isNotNull(), F.col("__last.value")).otherwise(F.col(column))
            df = df.join(last, on, "left").withColumn(column, new).select(*df.columns)
        return df

    def _patch(self, name: str, n: int, i: int) -> str:
        return f"{self.root}/{name}/p={n}.{i}"

    def patch(self, name: str, keys: list[str] | tuple[str, ...], column: str, fresh: DataFrame) -> int:
        """Put values (the key's columns and `value`; null clears) into one column: only they are written, and merged when
        read. Once patches hold a quarter as many rows as the table, they are merged into a new version, so that what is
        written grows with the rows that change. Returns how many there were."""
        v = self.version(name)
        i = v.get("last_patch", 0) + 1
        path = self._patch(name, v["n"], i)
        fresh.select(*keys, "value", F.lit(i).alias("__i")).write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).count()
        patches = [*v.get("patches", []), {"i": i, "column": column, "keys": list(keys), "rows": rows}]
        self._point(name, {**v, "patches": patches, "last_patch": i})
        base = self.spark.read.parquet(f"{self.root}/{name}/v={v['n']}").count()  # from the files' footers
        if 4 * sum(p["rows"] for p in patches) >= base or len(patches) >= MOST_PATCHES:
            self._write(name, self.read(name), v["n"], {k: x for k, x in v.items() if k not in ("n", "schema", "patches", "last_patch")})
        return rows

    def write(self, name: str, df: DataFrame, **facts: object) -> int:
        """A new version; readers of the old one keep it, until `KEPT` more have come."""
        return self._write(name, df, (self.version(name) or {"n": 0})["n"], facts)

    def _write(self, name: str, df: DataFrame, last: int, facts: dict) -> int:
        n = last + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        self._point(name, {"n": n, "schema": json.loads(df.schema.json()), **facts})
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            kind, _, number = PurePosixPath(status.getPath().toString()).name.partition("=")
            if kind in ("v", "p") and int(number.partition(".")[0]) <= n - KEPT:
                self._fs.delete(status.getPath(), True)
        return n

    def _point(self, name: str, facts: dict) -> None:
        part = self._path(f"{self.root}/{name}/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(part, self._path(self._pointer(name)), how)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self) -> list[str]:
        p = self._path(self.root)
        return sorted(PurePosixPath(s.getPath().toString()).name for s in self._fs.listStatus(p)) if self._fs.exists(p) else []


class Catalog:
    """Lifecycle verbs over a store: enable, adopt, set_format, disable, uninstall, drift."""

    def __init__(self, store: Store):
        self.store = store

    def entries(self) -> list[Entry]:
        v = self.store.version("registry")
        return [] if v is None else [Entry(**{**e, "key": tuple(e["key"])}) for e in v["entries"]]

    def _save(self, entries: list[Entry]) -> None:
        rows = [(e.id, e.table, e.source, e.vector, e.model, e.space, e.dim, e.distance, e.state, e.chunking) for e in entries]
        df = self.store.spark.createDataFrame(rows, "id bigint, table string, source string, vector string, model string, space string, dim int, distance string, state string, chunking string")
        last = max([e.id for e in entries] + [(self.store.version("registry") or {}).get("last", 0)])
        self.store.write("registry", df, entries=[asdict(e) for e in entries], last=last)

    def find(self, table: str, source: str) -> Entry:
        for e in self.entries():
            if (e.table, e.source) == (table, source):
                return e
        raise CatalogError(f"{table}.{source} is not maintained")

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise CatalogError(f"no table {name}")
        return df

    def plan(self, table: str, source: str, model: str, dim: int, key: list[str], **options: object) -> Entry:
        """Everything enable checks, without effect."""
        df = self._table(table)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if not key or any(k not in kinds for k in key):
            raise CatalogError(f"{table} needs a primary key of its own columns")
        if source not in kinds or not isinstance(kinds[source], TEXT_LIKE):
            raise CatalogError(f"column {source!r} is missing or has no plain text")
        if not 1 <= dim <= 16_000:
            raise CatalogError("dim must be in 1..16000")
        entries = self.entries()
        last = (self.store.version("registry") or {}).get("last", 0)
        e = Entry(id=last + 1, table=table, source=source, vector=str(options.pop("vector", f"{source}_semantic")), key=tuple(key), model=model, space=str(options.pop("space", model)), dim=dim, **options)  # type: ignore[arg-type]
        if len(e.vector.encode()) > MOST_NAME:
            raise CatalogError(f"vector column name is over {MOST_NAME} bytes")
        if e.distance not in ("cosine", "l2", "ip"):
            raise CatalogError("distance must be cosine, l2 or ip")
        if any((x.table, x.vector) == (table, e.vector) and x.destination == e.destination for x in entries):
            raise CatalogError(f"{table}.{e.vector} has a writer already")
        if e.chunking not in ("none", "recursive"):
            raise CatalogError("chunking must be none or recursive")
        if e.chunking == "recursive":
            e = replace(e, chunk_size=e.chunk_size or chunking.DEFAULT_SIZE, chunk_overlap=chunking.DEFAULT_OVERLAP if e.chunk_overlap is None else e.chunk_overlap)
            chunking.check_geometry(e.chunk_size, e.chunk_overlap)
            e = replace(e, destination=e.destination or f"{table}_{source}_chunks", token=uuid.uuid4().hex)
        if e.format is not None:
            templates.validate(e.format, source, df.columns, e.vector, e.chunking == "recursive")
        return e

    def enable(self, table: str, source: str, model: str, dim: int, key: list[str], if_not_exists: bool = False, **options: object) -> Entry:
        """Register, add the null vector column (or an empty chunk table)."""
        for e in self.entries():
            if (e.table, e.source) == (table, source):
                if not if_not_exists:
                    raise CatalogError(f"{table}.{source} is maintained already")
                want = {"model": model, "dim": dim, "key": tuple(key), **options}
                different = sorted(k for k, v in want.items() if getattr(e, k) != v)
                if different:
                    raise CatalogError(f"{table}.{source} is maintained with other options: {', '.join(different)}")
                return e
        e = self.plan(table, source, model, dim, key, **options)
        df = self._table(table)
        if e.chunking == "none":
            if e.vector in df.columns:
                raise CatalogError(f"column {e.vector!r} exists; adopt it")
            self.store.write(table, df.withColumn(e.vector, F.lit(None).cast("array<float>")))
        else:
            kind = df.schema[key[0]].dataType.simpleString() if len(key) == 1 else "string"  # several columns: the key's text
            empty = self.store.spark.createDataFrame([], f"chunk_id bigint, source_pk {kind}, chunk_seq int, char_start bigint, char_end bigint, chunk_text string, {e.vector} array<float>")
            self.store.write(e.destination, empty, token=e.token, high_water=0)
        self._save([*self.entries(), e])
        return e

    def adopt(self, table: str, source: str, model: str, dim: int, key: list[str], vector: str, backfill: str = "missing", observed: bool = False, **options: object) -> Entry:
        """Take over a vector column that is there; its non-null vectors must have the dimension. backfill: missing, all or
        none. An adopted column is never dropped. An observed one is only searched: others write it, until `promote`."""
        df = self._table(table)
        if vector not in df.columns or not isinstance(df.schema[vector].dataType, T.ArrayType):
            raise CatalogError(f"no vector column {vector!r}")
        if backfill not in ("missing", "all", "none"):
            raise CatalogError("backfill must be missing, all or none")
        if df.where(F.col(vector).isNotNull() & (F.size(vector) != dim)).limit(1).count():
            raise CatalogError(f"{vector!r} holds vectors of another dimension")
        e = replace(self.plan(table, source, model, dim, key, vector=vector, **options), owns_vector=False, backfill=backfill, state="observed" if observed else "active")
        e = replace(e, shape=fingerprint(df.select(*e.key, e.source, e.vector)))
        self._save([*self.entries(), e])
        return e

    def promote(self, table: str, source: str) -> Entry:
        """Maintain an observed entry from now on; what it was adopted with must still hold."""
        e = self.find(table, source)
        if e.state != "observed":
            raise CatalogError(f"{table}.{source} is {e.state}, not observed")
        df = self._as_adopted(e)
        if df.where(F.col(e.vector).isNotNull() & (F.size(e.vector) != e.dim)).limit(1).count():
            raise CatalogError(f"{e.vector!r} holds vectors of another dimension")
        new = replace(e, state="active")
        self._save([new if x.id == e.id else x for x in self.entries()])
        return new

    def _as_adopted(self, e: Entry) -> DataFrame:
        df = self._table(e.table)
        missing = {*e.key, e.source, e.vector} - set(df.columns)
        if missing or e.shape is not None and fingerprint(df.select(*e.key, e.source, e.vector)) != e.shape:
            raise CatalogError(f"{e.table} has changed since {e.vector!r} was taken over")
        return df

    def index(self, table: str, source: str, **more: object) -> HybridIndex:
        """The search index of an entry, over its table as it is now; refused if an adopted table has changed its shape."""
        e = self.find(table, source)
        if e.state == "quarantined":
            raise CatalogError(f"{table}.{source} is quarantined")
        df = self._as_adopted(e) if e.chunking == "none" else self._table(table)
        key = e.key[0] if len(e.key) == 1 else list(e.key)
        return HybridIndex(df, key, e.source, e.vector, e.dim, e.distance, e.config, chunks=self.store.read(e.destination) if e.destination else None, **more)

    def set_format(self, table: str, source: str, template: str | None) -> tuple[Entry, bool]:
        """The entry and whether all rows must be embedded again (the template differs in any byte)."""
        e = self.find(table, source)
        if template is not None:
            templates.validate(template, source, self._table(table).columns, e.vector, e.chunking == "recursive")
        if template == e.format:
            return e, False
        new = replace(e, format=template)
        self._save([new if x.id == e.id else x for x in self.entries()])
        return new, True

    def disable(self, table: str, source: str, drop: bool = False) -> None:
        """Stop maintaining; with `drop` the vector column goes if it was made here, the chunk table if its token matches."""
        e = self.find(table, source)
        if drop and e.chunking == "none" and e.owns_vector:
            self.store.write(table, self._table(table).drop(e.vector))
        if drop and e.destination and (self.store.version(e.destination) or {}).get("token") == e.token:
            self.store.drop(e.destination)
        self._save([x for x in self.entries() if x.id != e.id])

    def uninstall(self) -> None:
        for e in self.entries():
            self.disable(e.table, e.source, drop=True)

    def check_drift(self) -> list[int]:
        """Entries whose table, columns or key are gone go to quarantine; their ids."""
        out, entries = [], self.entries()
        for i, e in enumerate(entries):
            df = self.store.read(e.table)
            needed = {e.source, *e.key, *([e.vector] if e.chunking == "none" else [])} | ({r for r in templates.references(templates.parse(e.format)) if r != "chunk"} if e.format else set())
            if df is None or not needed <= set(df.columns):
                entries[i] = replace(e, state="quarantined")
                out.append(e.id)
        if out:
            self._save(entries)
        return out

    def dump(self, path: str) -> None:
        """Control state below `path`: the registry as JSON lines, the other control tables with their counters."""
        facts = {}
        for name in CONTROL:
            if v := self.store.version(name):
                self.store.read(name).write.mode("overwrite").parquet(f"{path}/{name}")
                facts[name] = {k: x for k, x in v.items() if k not in ("n", "schema", "patches", "last_patch")}
        lines = [json.dumps(asdict(e)) for e in self.entries()] + [json.dumps({"tables": facts})]
        self.store.spark.createDataFrame([(x,) for x in lines], "value string").write.mode("overwrite").text(f"{path}/registry")

    def restore(self, path: str) -> None:
        rows = [json.loads(r.value) for r in self.store.spark.read.text(f"{path}/registry").collect()]
        self._save([Entry(**{**e, "key": tuple(e["key"])}) for e in sorted((r for r in rows if "id" in r), key=lambda e: e["id"])])
        for name, facts in next(r["tables"] for r in rows if "tables" in r).items():
            self.store.write(name, self.store.spark.read.parquet(f"{path}/{name}"), **facts)


def fingerprint(df: DataFrame) -> str:
    """Identity of a table's shape, to be compared before a read."""
    return re.sub(r"\s", "", df.schema.json())
