"""From raw documents to packed training sequences: five stages, each one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import stages
from fathomline.llm.common import cut, table

STAGES = [
    ("quality_classifier", stages.quality),
    ("simhash_near_dedup", stages.near_duplicates),
    ("substring_dedup", stages.repeated_passages),
    ("benchmark_decontamination", stages.decontaminated),
    ("best_fit_packing", stages.packed),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each leaves is written to the shared checkpoint folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
