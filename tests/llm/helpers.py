"""Small document frames that hold the awkward cases: nulls, empty and long texts, repeated rows, clashing names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, start int, c string"


def documents(spark: SparkSession, texts: list, ids: list | None = None, langs: list | None = None) -> DataFrame:
    """Columns of `documents` and some more, whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", "src0", len(t) if t is not None else None, 7, 7, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
