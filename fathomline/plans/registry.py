"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.plans import queries_tables, queries_text, queries_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_vectors.QUERIES, **queries_text.QUERIES, **queries_tables.QUERIES}
SQL: dict[str, str] = {**queries_vectors.SQL, **queries_text.SQL, **queries_tables.SQL}
