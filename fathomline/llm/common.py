"""What the corpus operators share: reading tables, cutting lineage, walking Arrow batches in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import lineage

#: Text bytes that one vectorised pass works on; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Stands for a null document id where documents are put in order: after every other.
LAST_ID = (1 << 63) - 1


#: Rows of an Arrow batch: what a Python worker and its JVM side hold at a time.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session has its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there."""
    bounded_batches(df.sparkSession)
    return lineage.cut(df)


forget = lineage.forget


class Renamed:
    """A frame whose columns are numbered, so that no operator's own names can clash with them; back() restores them."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"__c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"__c{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        return df.toDF(*self.names)


def crc32_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def text_block(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and len+1 offsets into them; nulls are empty."""
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        width = np.int32
    else:
        values, width = values.cast(pa.large_binary()), np.int64
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) else b"")
    _, at, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with at most `most` text bytes each, or one row."""
    if not batch.num_rows:
        return
    _, at = text_block(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def arrow_struct(df_schema: str) -> pa.Schema:
    """The Arrow schema of a short `name type, ...` list (long, int, double, float, string, binary, boolean, array<...>)."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in df_schema.split(", ")])
