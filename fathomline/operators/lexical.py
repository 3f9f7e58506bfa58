"""BM25 over analysed text with corpus statistics that are computed once and kept."""

from __future__ import annotations

import operator
import time
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as X

K1, B = 1.2, 0.75
#: The least time between refreshes, in seconds; more after a long one; and the wait after an error.
THROTTLE, THROTTLE_FACTOR, AFTER_ERROR = 30.0, 10.0, 600.0


def idf(df: Column | float, n: Column | float) -> Column:
    df = F.least(F.lit(df) if not isinstance(df, Column) else df, F.lit(n) if not isinstance(n, Column) else n)
    return F.log(F.lit(1.0) + (F.lit(n) - df + 0.5) / (df + 0.5))


def bm25(tok: Column, terms: list[str], dfs: list[int], n: int, avgdl: float) -> Column:
    """Sum over the query terms present; the length of a document is all its positions. 0 if none is; null for null."""
    length = F.size(F.filter(tok, lambda t: t.isNotNull())).cast("double")
    out = F.lit(0.0)
    for t, df in zip(terms, dfs, strict=True):
        tf = X.occurrences(tok, t).cast("double")
        out = out + idf(float(df), float(n)) * tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B * length / F.lit(float(avgdl)))
    return F.when(tok.isNotNull(), out)


def corpus_tokens(df: DataFrame, key: str, text: str, config: str = "simple") -> DataFrame:
    """One row per document and lexeme: key, term, tf."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(X.tokens(text, config)).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"))


def postings(df: DataFrame, key: str, text: str, config: str = "simple") -> DataFrame:
    """An inverted index to be kept: term, key, tf, positions (from 1)."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(X.tokens(text, config)).alias("p", "term")).where("term is not null")
    return rows.groupBy("term", "key").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions"))


@dataclass
class Statistics:
    """n documents with text, their mean length, and in how many each term is, kept only where that is over one.

    frequencies is a DataFrame (term, df). whole is False for a reader of a part of the corpus, who gets no statistics."""

    n: int
    avgdl: float
    frequencies: DataFrame
    whole: bool = True

    def of(self, terms: list[str]) -> list[int]:
        """Document frequencies of a query's terms, 1 where unknown."""
        known = {r.term: r.df for r in self.frequencies.where(F.col("term").isin(terms)).collect()} if terms else {}
        return [int(known.get(t, 1)) for t in terms]


def statistics(df: DataFrame, text: str, config: str = "simple") -> Statistics:
    """One pass for counts and lengths, one aggregation for the terms. Empty texts count, null ones don't."""
    rows = df.where(F.col(text).isNotNull()).select(X.tokens(text, config).alias("t"))
    lengths = F.size(F.filter("t", lambda t: t.isNotNull()))
    n, total = rows.agg(F.count("*"), F.sum(lengths)).first()
    frequencies = rows.select(F.explode(F.array_distinct("t")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    return Statistics(n, total / n if n and total else 1.0, frequencies)


def scored(df: DataFrame, text: str, query: str, stats: Statistics | None, config: str = "simple") -> DataFrame:
    """Rows of `df` that match the query, with `score`: BM25 under statistics, else cover density."""
    node = X.parse_query(query, config)
    terms = X.positive_terms(node)
    rows = df.where(F.col(text).isNotNull()).withColumn("__t", X.tokens(text, config)).where(X.matches(F.col("__t"), node))
    if stats is not None and stats.whole and stats.n > 0:
        return rows.withColumn("score", bm25(F.col("__t"), terms, stats.of(terms), stats.n, stats.avgdl)).drop("__t")
    return rows.withColumn("score", X.cover_density(F.col("__t"), terms)).drop("__t")


def _terms(node: X.Node | None) -> list[str]:
    """All lexemes of a query, excluded ones too."""
    if node is None:
        return []
    if isinstance(node, X.Phrase):
        return sorted({w for w, _ in node.words})
    return _terms(node.of) if isinstance(node, X.Not) else sorted({t for p in node.parts for t in _terms(p)})


def _holds(places: Column, node: X.Node) -> Column:
    """Whether places, an array of (term, positions), satisfy the query."""
    at = lambda w: F.flatten(F.transform(F.filter(places, lambda x: x["term"] == w), lambda x: x["positions"]))
    if isinstance(node, X.Not):
        return ~_holds(places, node.of)
    if isinstance(node, X.Phrase):
        moved = [F.transform(at(w), partial(_less, d)) for w, d in node.words]
        return F.size(reduce(F.array_intersect, moved)) > 0
    return reduce(operator.and_ if isinstance(node, X.Both) else operator.or_, [_holds(places, p) for p in node.parts])


def _less(d: int, p: Column) -> Column:
    return p - d


def _tf(places: Column, term: str) -> Column:
    return F.aggregate(F.filter(places, lambda x: x["term"] == term), F.lit(0), lambda a, x: a + F.size(x["positions"])).cast("double")


#: Folders that an index's terms are dealt to, so that a query lists and reads few of them.
BUCKETS = 64


@dataclass
class Index:
    """Postings with lengths and the corpus's statistics, written once; a query reads its terms' postings only."""

    rows: DataFrame
    n: int
    avgdl: float
    config: str

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str, config: str = "simple") -> Index:
        """Write (bucket, term, key, n, positions) below `path`, sorted by term and key: a frequent term is split over
        files, and files and row groups of other terms are skipped by their bounds."""
        spark = df.sparkSession
        docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), X.tokens(text, config).alias("t"))
        docs = docs.withColumn("n", F.size(F.filter("t", lambda t: t.isNotNull())))
        placed = docs.select("key", "n", F.posexplode("t").alias("p", "term")).where("term is not null")
        posts = placed.groupBy("key", "n", "term").agg(F.array_sort(F.collect_list(F.col("p") + 1)).alias("positions")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        order = ["bucket", "term", "key"]
        posts.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)
        n, total = docs.agg(F.count("*"), F.sum("n")).first()
        return cls(spark.read.parquet(path), n, total / n if n and total else 1.0, config)

    def scored(self, query: str) -> DataFrame | None:
        """key and score (BM25) of the matching documents, as `scored` has them; none for a query that only excludes."""
        node = X.parse_query(query, self.config)
        terms, wanted = _terms(node), X.positive_terms(node)
        if node is not None and not wanted:
            return None
        spark = self.rows.sparkSession
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).collect()] if terms else []
        posts = self.rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        dfs = {r.term: r["count"] for r in posts.groupBy("term").count().collect()} if terms else {}
        docs = posts.groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("term", "positions")).alias("places"))
        score = F.lit(0.0)
        for t in wanted:
            tf = _tf(F.col("places"), t)
            score = score + idf(float(max(1, dfs.get(t, 1))), float(self.n)) * tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B * F.col("n").cast("double") / F.lit(float(self.avgdl)))
        holds = F.lit(False) if node is None else _holds(F.col("places"), node)
        return docs.where(holds).select("key", score.alias("score"))


@dataclass
class Keeper:
    """Keeps statistics of several corpora fresh: which is stale, and refreshing it without ever losing the old ones."""

    entries: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)
    kept: dict[str, Statistics] = field(default_factory=dict)
    seen: dict[str, tuple[int | None, float, float, str | None]] = field(default_factory=dict)  # changes, when, how long, error

    def stale(self, changes: dict[str, int], now: float | None = None) -> str | None:
        """The entry to refresh: never refreshed, or changed and past its throttle; the one longest ago first."""
        now = time.time() if now is None else now
        due = []
        for name in self.entries:
            if name not in self.seen:
                due.append((0.0, name))
                continue
            had, when, took, error = self.seen[name]
            wait = AFTER_ERROR if error else max(THROTTLE, THROTTLE_FACTOR * took)
            if (error or had != changes.get(name)) and now - when >= wait:
                due.append((when, name))
        return min(due)[1] if due else None

    def refresh(self, name: str, changes: int | None = None) -> str | None:
        """Recompute one entry's statistics; an error is returned and recorded, and the old ones stay."""
        began = time.time()
        try:
            df, text, config = self.entries[name]
            self.kept[name] = statistics(df, text, config)
            error = None
        except Exception as e:  # noqa: BLE001 whatever the source throws is the entry's error
            error = f"{type(e).__name__}: {e}"[:1024]
        self.seen[name] = (changes, time.time(), time.time() - began, error)
        return error

    def truncated(self, name: str) -> None:
        self.kept.pop(name, None)
        self.seen.pop(name, None)
