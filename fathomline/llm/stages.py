"""The corpus pipeline's stages. Each takes (spark, docs, sf_dir); all but the last return the columns of `docs`.

Columns beyond those of `documents` are carried along whatever their names; null ids and texts are rows like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import difference_cover, near_copies, packing, queries, rule_ensemble, spaced_seeds
from fathomline.llm.common import LAST_ID, Renamed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a quality score of at least 0.5."""
    own = Renamed(docs)
    model = queries.quality_model(docs, table(spark, sf_dir, "labels"))
    return own.back(rule_ensemble.accepted(own.df, model, own["doc_id"], own["text"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by near copies (five-word shingles, similarity 0.8 or more): that of the smallest id (null last), and of rows that share
    it the one of least text hash."""
    own = Renamed(docs)
    key = F.struct(F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(own["text"]).alias("raw"))
    named = own.df.withColumn("__k", key)
    first = near_copies.near_copies(named, "__k", own["text"]).select("component.id", "component.raw").distinct()
    keyed = named.select(*own.df.columns, "__k.id", "__k.raw")
    return own.back(keyed.join(first, ["id", "raw"], "left_semi").dropDuplicates(["id", "raw"]).select(*own.df.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words of 50-word windows that an earlier document has. A document of which nothing is left stays, empty."""
    own = Renamed(docs)
    text, size = own["text"], own["n_chars"]
    return own.back(difference_cover.without_repeats(own.df, own["doc_id"], text).withColumn(size, F.coalesce(F.length(text).cast("long"), size)))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    own = Renamed(docs)
    found = spaced_seeds.contamination(own.df, table(spark, sf_dir, "benchmark"), own["doc_id"], own["text"], carry=tuple(own.df.columns))
    return own.back(found.where("not contaminated").select(*own.df.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs, "doc_id", "text", queries.TOKENIZER)
