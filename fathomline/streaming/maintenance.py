"""Keeps vectors in step with their tables.

`Worker.refresh` is one round for one entry: capture what changed since the table's last seen version, queue it, claim a
batch, read it within the byte budgets, embed, write back, settle. `follow` drives rounds from a change stream with
`foreachBatch`; with `Trigger.AvailableNow` the same is a backfill. There is one writer. A round writes vectors, dead letters
and the queue in this order; one that is lost in between is done again, with the same vectors and no letter twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.functions import chunking, templates
from fathomline.operators import changes as C
from fathomline.operators.lexical import Keeper
from fathomline.operators.lineage import cut
from fathomline.operators.search import key_text
from fathomline.plans.catalog import Catalog, Entry
from fathomline.plans.migrate import Migration, Migrator
from fathomline.sources.embedders import Embedder, embedded

#: Rows beyond which a one-shot backfill is refused.
MOST_QUEUED = 1_000_000
DEAD = C.JOBS + ", failed_at timestamp, dead_id bigint"


@dataclass
class Worker:
    """The single writer of a catalog's tables."""

    catalog: Catalog
    embedders: dict[str, Embedder]
    limits: C.Limits = field(default_factory=C.Limits)
    keeper: Keeper = field(default_factory=Keeper)
    counters: dict[str, int] = field(default_factory=lambda: {"rounds": 0, "embedded": 0, "dead": 0, "retried": 0, "left": 0})

    @property
    def spark(self):
        return self.catalog.store.spark

    def table_of(self, name: str, schema: str) -> DataFrame:
        df = self.catalog.store.read(name)
        return self.spark.createDataFrame([], schema) if df is None else df

    def jobs(self) -> DataFrame:
        return self.table_of("jobs", C.JOBS)

    def dead(self) -> DataFrame:
        return self.table_of("jobs_dead", DEAD)

    def _next(self, name: str) -> int:
        return int((self.catalog.store.version(name) or {}).get("high_water", 0))

    def enqueue(self, entry: Entry, keys: DataFrame, op: str = "embed") -> int:
        """Queue keys (pk_value, chunk_id) of an entry, unless pending; returns how many."""
        now = F.current_timestamp()
        jobs = self.jobs()
        fresh = keys.select(F.lit(entry.id).cast("bigint").alias("registry_id"), "pk_value", F.lit(op).alias("op"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.lit(0).alias("attempts"), now.alias("not_before"), F.lit(None).cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("last_error"), now.alias("created_at"))
        top = self._next("jobs")
        new = C.with_ids(C.coalesced(jobs.where("claimed_at is null"), fresh), "id", top, ["pk_value", "chunk_id"])
        kept = cut(jobs.unionByName(new.select(*jobs.columns)))
        n = kept.where(F.col("id") > top).count()
        self.catalog.store.write("jobs", kept, high_water=top + n)
        return n

    def backfill(self, entry: Entry) -> int:
        """Queue every row whose source is there and whose vector isn't (for `all`, every row)."""
        df = self.catalog.store.read(entry.table)
        rows = df.where(F.col(entry.source).isNotNull())
        if entry.chunking == "none" and entry.backfill != "all":
            rows = rows.where(F.col(entry.vector).isNull())
        if rows.limit(MOST_QUEUED + 1).count() > MOST_QUEUED:
            raise ValueError(f"over {MOST_QUEUED} rows: use the cursor backfill")
        return self.enqueue(entry, rows.select(key_text(*entry.key).alias("pk_value"), F.lit(None).alias("chunk_id")), "embed" if entry.chunking == "none" else "refresh")

    def set_format(self, table: str, source: str, template: str | None) -> int:
        """Change an entry's template and queue all its rows if that changes what is embedded; returns how many."""
        e, changed = self.catalog.set_format(table, source, template)
        if not changed or e.state != "active":
            return 0
        rows = self.catalog.store.read(e.table).where(F.col(e.source).isNotNull())
        return self.enqueue(e, rows.select(key_text(*e.key).alias("pk_value"), F.lit(None).alias("chunk_id")), "embed" if e.chunking == "none" else "refresh")

    def abort(self, migrator: Migrator, m: Migration) -> Migration:
        """Abort a migration and queue the rows whose only vector went with it."""
        e = self.catalog.entries()
        m, lost = migrator.abort(m)
        entry = next(x for x in e if x.id == m.registry_id)
        self.enqueue(entry, lost.select(key_text(*entry.key).alias("pk_value"), F.lit(None).alias("chunk_id")))
        return m

    def backfill_page(self, entry: Entry, page: int) -> tuple[Entry, int]:
        """The cursor backfill: the next rows by key while the queue is less than a page deep; done when there are none."""
        if self.jobs().where(F.col("registry_id") == entry.id).limit(page).count() >= page:
            return entry, 0
        df = self.catalog.store.read(entry.table)
        rows = cut(C.keyset_page(df, entry.key, C.after_watermark(df, entry.key, entry.watermark), page).select(*entry.key, entry.source, *([entry.vector] if entry.chunking == "none" else [])))
        last = C.watermark_of(rows, entry.key)
        if last is None:
            new = replace(entry, backfill="done")
        else:
            new = replace(entry, watermark=last)
            due = rows.where(F.col(entry.source).isNotNull())
            due = due.where(F.col(entry.vector).isNull()) if entry.chunking == "none" else due
            n = self.enqueue(entry, due.select(key_text(*entry.key).alias("pk_value"), F.lit(None).alias("chunk_id")), "embed" if entry.chunking == "none" else "refresh")
        self.catalog._save([new if e.id == entry.id else e for e in self.catalog.entries()])
        return new, 0 if last is None else n

    def apply(self, table: str, new: DataFrame) -> int:
        """Replace a table's rows as one change: capture by diff, drop stale chunks with it, queue what must be embedded.
        Vectors of rows that stay are kept."""
        old = self.catalog.store.read(table)
        entries = [e for e in self.catalog.entries() if e.table == table and e.state == "active"]
        queued = 0
        key = list(entries[0].key) if entries else [new.columns[0]]
        vectors = [e.vector for e in entries if e.chunking == "none"]
        for v in vectors:
            if v not in new.columns:
                new = new.join(old.select(*key, v), key, "left")
        captured = []
        for e in entries:
            watched = [c for c in dict.fromkeys([e.source, *(templates.references(templates.parse(e.format)) if e.format else [])]) if c != "chunk"]
            captured.append((e, cut(C.changed_rows(old, new, key, watched, e.source))))
        self.catalog.store.write(table, new.select(*[c for c in old.columns if c in new.columns], *[c for c in new.columns if c not in old.columns]))
        for e, diff in captured:
            if e.chunking != "none":
                chunks = self.catalog.store.read(e.destination)
                gone = diff.where("change != 'insert'").select(source_pk(e).alias("source_pk"))
                v = self.catalog.store.version(e.destination)
                self.catalog.store.write(e.destination, C.rechunked(chunks, gone, chunks.limit(0)), token=v.get("token"), high_water=v.get("high_water", 0))
            queued += self.enqueue(e, diff.where("change != 'delete'").select(key_text(*e.key).alias("pk_value"), F.lit(None).alias("chunk_id")), "embed" if e.chunking == "none" else "refresh")
        return queued

    def truncate(self, table: str) -> None:
        """Empty a table with its jobs, chunks and statistics."""
        self.catalog.store.write(table, self.catalog.store.read(table).limit(0))
        for e in [e for e in self.catalog.entries() if e.table == table]:
            self.catalog.store.write("jobs", self.jobs().where(F.col("registry_id") != e.id), high_water=self._next("jobs"))
            if e.destination:
                v = self.catalog.store.version(e.destination)
                self.catalog.store.write(e.destination, self.catalog.store.read(e.destination).limit(0), token=v.get("token"), high_water=v.get("high_water", 0))
            self.keeper.truncated(f"{e.table}.{e.source}")

    def refresh(self, entry: Entry) -> int:
        """One round for an entry; returns the number of jobs that are not merely put off."""
        now, store = F.current_timestamp(), self.catalog.store
        queue, expired = C.released(self.jobs(), now, self.limits)
        mine = cut(C.claim(queue.where(F.col("registry_id") == entry.id), now, self.limits.batch_rows))
        handled = mine.count()
        if not handled:
            return 0
        source = store.read(entry.table)
        bad = C.uncastable(mine, source.schema[entry.key[0]].dataType.simpleString()) if len(entry.key) == 1 else mine.limit(0)
        outcomes = bad.select("id", F.lit("dead").alias("status"), F.lit("key is not valid for the table").alias("error"))
        good = mine.join(bad.select("id"), "id", "left_anti")
        refresh, embed = good.where("op = 'refresh'"), good.where("op = 'embed'")
        done = [outcomes]
        if entry.chunking != "none":
            done.append(self._split(entry, source, refresh))
            done.append(self._embed_chunks(entry, source, embed))
        else:
            done.append(self._embed_rows(entry, source, embed))
        result = done[0]
        for d in done[1:]:
            result = result.unionByName(d)
        result = cut(result)
        now_jobs = self.jobs()  # splitting has queued children meanwhile
        rest = now_jobs.join(mine.select("id"), "id", "left_anti").join(expired.select("id"), "id", "left_anti")
        back, dead = C.settled(mine, result, now, self.limits)
        all_dead = dead.unionByName(expired).withColumn("dead_id", F.lit(0).cast("bigint"))
        top = self._next("jobs_dead")
        # A round that was lost after this write is done again: its dead letters, known by their job, are not added twice.
        new_dead = all_dead.drop("dead_id").join(self.dead().select("id"), "id", "left_anti")
        kept_dead = cut(self.dead().unionByName(C.with_ids(new_dead, "dead_id", top, ["id"]).select(*self.dead().columns)))
        n_dead = kept_dead.where(F.col("dead_id") > top).count()
        store.write("jobs_dead", kept_dead, high_water=top + n_dead)
        store.write("jobs", rest.unionByName(back.select(*rest.columns)), high_water=self._next("jobs"))
        counts = {r.status: r["count"] for r in result.groupBy("status").count().collect()}
        for name, value in (("rounds", 1), ("embedded", counts.get("ok", 0)), ("dead", n_dead), ("retried", counts.get("retry", 0))):
            self.counters[name] += value
        return handled - counts.get("deferred", 0)

    def _embed_rows(self, e: Entry, source: DataFrame, jobs: DataFrame) -> DataFrame:
        store = self.catalog.store
        keyed = source.withColumn("__k", key_text(*e.key))
        sized = jobs.select(F.col("id").alias("__job"), "pk_value", F.col("created_at").alias("__at")).join(keyed.withColumn("__size", templates.rendered_bytes(e.format, e.source)), F.col("pk_value") == F.col("__k"), "left")
        judged = C.admitted(sized, ["__at", "__job"], "__size", self.limits)
        texts = judged.where("verdict = 'admitted'").select("__job", *e.key, templates.rendered(e.format, e.source).alias("__text"))
        made = cut(embedded(texts, "__text", self.embedders[e.model]))
        empty = judged.where("verdict = 'null'").select("__job", *e.key)
        cleared = empty.where(F.col(e.key[0]).isNotNull()).select(*e.key, F.lit(None).cast("array<float>").alias("value"))  # else the row is gone
        store.patch(e.table, e.key, e.vector, made.where("status = 'ok'").select(*e.key, F.col("vector").alias("value")).unionByName(cleared))
        none = F.lit(None).cast("string")
        parts = [
            made.select("__job", "status", "error"),
            empty.select("__job", F.lit("empty"), none),
            judged.where("verdict = 'too_large'").select("__job", F.lit("dead"), F.concat(F.lit("text is "), F.col("__size"), F.lit(f" bytes, over {self.limits.document_bytes}"))),
            judged.where("verdict = 'deferred'").select("__job", F.lit("deferred"), none),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.toDF("id", "status", "error")

    def _split(self, e: Entry, source: DataFrame, jobs: DataFrame) -> DataFrame:
        """Replace the chunks of changed documents and queue the new ones, in one snapshot of the chunk table."""
        if not jobs.limit(1).count():
            return jobs.select("id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")).limit(0)
        store = self.catalog.store
        docs = jobs.select("pk_value").join(source.withColumns({"__k": key_text(*e.key), "__pk": source_pk(e)}), F.col("pk_value") == F.col("__k"))
        chunks, refused = chunking.chunked(docs, "__pk", e.source, e.chunk_size, e.chunk_overlap)
        v = store.version(e.destination)
        top = int(v.get("high_water", 0))
        fresh = cut(C.with_ids(chunks, "chunk_id", top, ["source_pk", "chunk_seq"]))
        touched = jobs.select((F.col("pk_value").try_cast(source.schema[e.key[0]].dataType) if len(e.key) == 1 else F.col("pk_value")).alias("source_pk"))
        store.write(e.destination, C.rechunked(store.read(e.destination), touched, fresh), token=v.get("token"), high_water=top + fresh.count())
        self.enqueue(e, fresh.select(F.col("source_pk").cast("string").alias("pk_value"), "chunk_id"))
        errors = refused.select(F.col("source_pk").cast("string").alias("pk_value"), F.col("error").alias("__e"))
        return jobs.join(errors, "pk_value", "left").select("id", F.when(F.col("__e").isNull(), "ok").otherwise("dead").alias("status"), F.col("__e").alias("error"))

    def _embed_chunks(self, e: Entry, source: DataFrame, jobs: DataFrame) -> DataFrame:
        store = self.catalog.store
        judged = C.child_verdicts(jobs, store.read(e.destination))
        live = judged.where("verdict = 'live'").select(F.col("id").alias("__job"), "chunk_id", "pk_value", "chunk_text")
        joined = live.join(source.withColumn("__k", key_text(*e.key)), F.col("pk_value") == F.col("__k"))
        made = cut(embedded(joined.select("__job", "chunk_id", templates.rendered(e.format, e.source, chunk="chunk_text").alias("text")), "text", self.embedders[e.model]))
        store.patch(e.destination, ["chunk_id"], e.vector, made.where("status = 'ok'").select("chunk_id", F.col("vector").alias("value")))
        return made.select(F.col("__job").alias("id"), "status", "error").unionByName(judged.where("verdict != 'live'").select("id", F.col("verdict").alias("status"), F.when(F.col("verdict") == "dead", "chunk is missing or of another key").alias("error")))

    def drain(self, most_rounds: int | None = None) -> int:
        """Rounds over all entries in turn until nothing is due, or as many as asked for (`counters["left"]` says how many
        due jobs that leaves); then at most one refresh of statistics."""
        total = rounds = 0
        while most_rounds is None or rounds < most_rounds:
            n = sum(self.refresh(e) for e in self.catalog.entries() if e.state == "active")
            total, rounds = total + n, rounds + 1
            if not n:
                break
        self.counters["left"] = C.due(self.jobs(), F.current_timestamp()).count()
        changes = {f"{e.table}.{e.source}": (self.catalog.store.version(e.table) or {}).get("n", 0) for e in self.catalog.entries()}
        for e in self.catalog.entries():
            df, text = (self.catalog.store.read(e.destination), "chunk_text") if e.destination else (self.catalog.store.read(e.table), e.source)
            self.keeper.entries[f"{e.table}.{e.source}"] = (df, text, e.config)
        if name := self.keeper.stale(changes):
            self.keeper.refresh(name, changes.get(name))
        return total

    def retry_dead(self, entry: Entry, ids: list[int] | None = None) -> int:
        mine, others = self.dead().where(F.col("registry_id") == entry.id), self.dead().where(F.col("registry_id") != entry.id)
        live = self.catalog.store.read(entry.destination) if entry.destination else None
        jobs, rest = C.retried(mine, self.jobs(), ids, F.current_timestamp(), live, C.MOST_RETRIED)
        n = self.enqueue(entry, cut(jobs.select("pk_value", "chunk_id")), "embed" if entry.chunking == "none" else "refresh")
        self.catalog.store.write("jobs_dead", cut(others.unionByName(rest.select(*others.columns))), high_water=self._next("jobs_dead"))
        return n


def source_pk(e: Entry) -> Column:
    """How chunks name their document: by its key, or by the text of a key of several columns."""
    return F.col(e.key[0]) if len(e.key) == 1 else key_text(*e.key)


def follow(worker: Worker, stream: DataFrame, table: str, key: str | list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of changes (the table's columns and `__op`: upsert or delete, `__seq`: order) in micro-batches: the
    last change of each key counts; each batch is applied, then the queue is drained."""

    def batch(df: DataFrame, _: int) -> None:
        from pyspark.sql import Window

        keys = C.key_list(key)
        last = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__seq").desc()))).where("__n = 1")
        old = worker.catalog.store.read(table)
        kept = old.join(last.select(*keys), keys, "left_anti")
        fresh = last.where("__op != 'delete'").select(*[c for c in old.columns if c in df.columns])
        vectors = [c for c in old.columns if c not in df.columns]
        fresh = fresh.join(old.select(*keys, *vectors), keys, "left") if vectors else fresh
        worker.apply(table, cut(kept.unionByName(fresh.select(*old.columns))))
        worker.drain()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
