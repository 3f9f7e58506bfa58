"""URL filters as a sort-merge range join on reversed-host keys.

A host's labels are reversed and each is closed by a dot (`www.example.org` -> `org.example.www.`), so that a host and all
its subdomains are the keys with one prefix, an interval. URLs are range-partitioned and sorted by (key, path, id); one
sweep over a partition keeps a stack of the host rules whose intervals hold the current key, nested ones on top. On each
level paths are looked up longest first; the first fit from the top of the stack is the longest rule.

Sorting by (key, path, id) lets a single hot host be split over partitions. Rules travel with the tasks when there are at
most `MOST_RULES`; beyond that each URL is joined with its own ancestors' rules by equality (`expanded`), with the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number go to every task (about 10 MB at 100 bytes a rule).
MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


class Sweep:
    """The stack of active rules over ascending keys. rules: (key prefix, path prefix, verdict, name)."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        by: dict[str, dict[str, tuple[str, str]]] = {}
        for key, path, verdict, name in sorted(rules):  # of equal rules the last, block, holds
            by.setdefault(key, {})[path] = (name, verdict)
        self.levels = [(k, by[k], sorted({len(p) for p in by[k]}, reverse=True)) for k in sorted(by)]
        self.next = 0
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.next < len(self.levels) and self.levels[self.next][0] <= key:
            if key.startswith(self.levels[self.next][0]):
                self.stack.append(self.levels[self.next])
            self.next += 1
        for _, paths, lengths in reversed(self.stack):
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])):
                    return hit
        return None, None


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """key, host, path, rule and verdict of each URL. rules: host, path, verdict ('allow' or 'block').

    The longest rule wins: the longest host that is the URL's or a parent of it, then the longest path prefix; of equal
    rules block wins. Without a fitting rule, `rule` is null and the verdict is `default`. A null URL or one without `://`
    has an empty host and path, which no rule fits. Null rules are left out."""
    host, path = host_and_path(F.col(url))
    keyed = urls.select(F.col(key).alias("__id"), host.alias("__host"), path.alias("__path")).withColumn("__key", host_key(F.col("__host")))
    clean = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict")
    near = clean.limit(most_rules + 1).collect()
    done = expanded(keyed, clean) if len(near) > most_rules else swept(keyed, [(r.host, r.path, r.verdict) for r in near])
    return done.select(F.col("__id").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def swept(keyed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    stacked = [(".".join(reversed(h.split("."))) + ".", p, v, h + p) for h, p, v in rules]
    spread = keyed.repartitionByRange("__key", "__path", "__id").sortWithinPartitions("__key", "__path", "__id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(stacked)
        for b in batches:
            hits = [sweep.find(k, p) for k, p in zip(b.column("__key").to_pylist(), b.column("__path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__host"), b.column("__path"), pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string())], names=["__id", "__host", "__path", "rule", "verdict"])

    kind = keyed.schema["__id"].dataType.simpleString()
    return spread.mapInArrow(each, f"__id {kind}, __host string, __path string, rule string, verdict string")


def expanded(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by equality: each distinct (key, path) against the rules of every ancestor of its host."""
    pairs = keyed.select("__key", "__path").distinct()
    labels = F.split(F.expr("substring(__key, 1, length(__key) - 1)"), r"\.", -1)
    ancestors = pairs.withColumn("__n", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("__of", F.concat(F.concat_ws(".", F.slice(labels, 1, F.col("__n"))), F.lit(".")))
    named = rules.select(host_key(F.col("host")).alias("__of"), F.col("path").alias("__prefix"), "verdict", F.concat("host", "path").alias("rule"))
    hits = ancestors.join(named, "__of").where(F.col("__path").startswith(F.col("__prefix")))
    best = hits.groupBy("__key", "__path").agg(F.max(F.struct(F.col("__n"), F.length("__prefix"), F.col("verdict"), F.col("rule"))).alias("__best"))
    return keyed.join(best, ["__key", "__path"], "left").select("__id", "__host", "__path", F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict"))
