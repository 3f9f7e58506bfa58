"""Status and metrics over the control tables, each one plan of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "0.1"


def backlog(jobs: DataFrame, dead: DataFrame, now: Column) -> DataFrame:
    """Per entry: pending, of them refresh and embed, age of the oldest in seconds, the latest error, and dead letters."""
    counts = jobs.groupBy("registry_id").agg(F.count("*").alias("pending"), F.count_if(F.col("op") == "refresh").alias("pending_refresh"), F.count_if(F.col("op") == "embed").alias("pending_embed"), F.min("created_at").alias("oldest"))
    errors = jobs.where("last_error is not null").groupBy("registry_id").agg(F.max_by("last_error", F.struct("not_before", "id")).alias("last_error"))
    lost = dead.groupBy("registry_id").agg(F.count("*").alias("dead"))
    rows = counts.join(errors, "registry_id", "left").join(lost, "registry_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("registry_id", zero("pending"), zero("pending_refresh"), zero("pending_embed"), zero("dead"), (F.unix_seconds(now) - F.unix_seconds("oldest")).cast("double").alias("oldest_seconds"), "last_error")


def status(registry: DataFrame, jobs: DataFrame, dead: DataFrame, routes: DataFrame, models: DataFrame, now: Column) -> DataFrame:
    """One row per entry with its backlog and the route that serves it: its model's, its space's, or a converter into it."""
    served = registry.select("id", "model", "space").join(routes.select(F.col("space").alias("r_space"), "route", "execution", "priority"), (F.col("route") == F.col("model")) | F.col("r_space").isin(F.col("model"), F.col("space")))
    served = served.select("id", F.lit(0).alias("tier"), (F.col("route") != F.col("model")).alias("other"), (F.col("r_space") != F.col("model")).alias("apart"), "priority", "route", "execution")
    bridges = registry.select("id", "model", "space").join(models.where("model_type = 'convert'").select(F.col("name").alias("route"), F.col("target_model").alias("t")), F.col("t").isin(F.col("model"), F.col("space")))
    bridges = bridges.select("id", F.lit(1).alias("tier"), F.lit(False).alias("other"), F.lit(False).alias("apart"), F.lit(0).alias("priority"), "route", F.lit("bridge").alias("execution"))
    first = Window.partitionBy("id").orderBy("tier", "other", "apart", "priority", "route")
    best = served.unionByName(bridges).withColumn("__n", F.row_number().over(first)).where("__n = 1").select("id", "route", "execution")
    back = backlog(jobs, dead, now).withColumnRenamed("registry_id", "__r")
    out = registry.join(back, F.col("id") == F.col("__r"), "left").drop("__r").join(best, "id", "left")
    return out.fillna(0, ["pending", "pending_refresh", "pending_embed", "dead"]).orderBy("id")


def progress(migrations: DataFrame) -> DataFrame:
    """Percent done of each migration, skipped rows included, to one place, never over 100."""
    part = F.round(F.lit(100.0) * (F.col("rows_done") + F.col("rows_skipped")) / F.col("rows_total"), 1)
    return migrations.withColumn("percent", F.when(F.col("rows_total") > 0, F.least(F.lit(100.0), part)).otherwise(F.lit(100.0)))


def stats(counters: dict[str, int], spark) -> DataFrame:
    """A worker's counters as rows."""
    return spark.createDataFrame(sorted(counters.items()), "counter string, value bigint")
