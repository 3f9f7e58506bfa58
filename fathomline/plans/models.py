"""Routing: which model serves a vector space, and by which way a text or a vector gets into it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODELS = "name string, model_type string, source_model string, target_model string, source_dim int, target_dim int, sequence_len int, raw string, last_seen timestamp"
LOCAL, PROVIDER = 100, 200


def routes(models: DataFrame) -> DataFrame:
    """One row per embedding model: space, route, provider, execution, dim, priority, explicit, preferred, last_seen. The
    priority is a JSON number of 1..65535 or else 100 for local and 200 for provider models; the preferred route of a space
    has the least, of equals the first name."""
    raw = F.col("raw")
    provider = F.get_json_object(raw, "$.extra.provider")
    given = F.get_json_object(raw, "$.extra.priority")
    is_number = F.from_json(raw, "extra struct<priority:string>")["extra"]["priority"].rlike("^[0-9]{1,5}$") & ~raw.rlike(r'"priority"\s*:\s*"')
    number = F.when(is_number, given.try_cast("int"))
    rows = models.where("model_type = 'embed'").select(
        F.coalesce("target_model", "name").alias("space"), F.col("name").alias("route"), provider.alias("provider"),
        F.when(provider.isNull(), "local").otherwise(F.concat(F.lit("provider "), provider)).alias("execution"), F.col("target_dim").alias("dim"),
        F.when(number.between(1, 65535), number).when(provider.isNull(), LOCAL).otherwise(PROVIDER).alias("priority"),
        F.coalesce(F.get_json_object(raw, "$.extra.priority_explicit") == "true", F.lit(False)).alias("explicit"), "last_seen",
    )
    first = F.row_number().over(Window.partitionBy("space").orderBy("priority", "route")) == 1
    return rows.withColumn("preferred", first)


def resolve_route(routes_: DataFrame, model: str, space: str | None = None) -> DataFrame:
    """The exact route, else the model's own space by priority, else the remembered space; ties by name."""
    named = F.col("route") == model
    return routes_.where(named | F.col("space").isin([x for x in (model, space) if x is not None])).orderBy(named.desc(), (F.col("space") == model).desc(), "priority", "route").limit(1)


def effective_priorities(models: DataFrame) -> DataFrame:
    """name and priority: local 100, an explicit number, else 200 + rank by when it was added, its file and its name.
    models: name, provider, explicit_priority, added, file."""
    late = F.when(F.col("provider").isNotNull() & F.col("explicit_priority").isNull(), F.lit(1)).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(late).orderBy(F.col("added").asc_nulls_last(), F.col("file").asc_nulls_last(), "name"))
    return models.select("name", F.when(F.col("explicit_priority").isNotNull(), F.col("explicit_priority")).when(F.col("provider").isNull(), LOCAL).otherwise(PROVIDER + rank).cast("int").alias("priority"))


@dataclass(frozen=True)
class Way:
    """How to get into a space: directly by a route, or by embedding with `via` and converting with `route`."""

    kind: str
    route: str
    space: str
    via: str | None = None


def resolve_embedding(models: DataFrame, model: str, space: str | None = None) -> Way | None:
    """A serving route, else the first local converter into the space whose source can be embedded."""
    served = routes(models)
    if r := resolve_route(served, model, space).first():
        return Way("direct", r.route, r.space)
    targets = [x for x in (model, space) if x is not None]
    sources = served.select(F.col("space").alias("source_model")).union(served.select("route")).distinct()
    local = F.get_json_object("raw", "$.extra.provider").isNull()
    c = models.where("model_type = 'convert'").where(local & F.col("target_model").isin(targets)).join(sources, "source_model", "left_semi").orderBy("name").first()
    if c is None:
        return None
    via = resolve_route(served, c.source_model).first()
    return Way("bridge", c.name, c.target_model, via.route)


def resolve_conversion(models: DataFrame, source: str, target: str) -> str | None:
    """A direct converter only; local before provider, then by name."""
    provider = F.get_json_object("raw", "$.extra.provider")
    r = models.where("model_type = 'convert'").where((F.col("source_model") == source) & (F.col("target_model") == target)).orderBy(provider.isNotNull(), "name").first()
    return r.name if r else None


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Models from JSON lines as nodes serve them: name, kind, source, target, dims, declared and tokenizer lengths. The
    type follows from what a model says of itself; the served length is the lesser of the two."""
    raw = spark.read.schema("name string, model_type string, source_model string, target_model string, source_dim int, target_dim int, sequence_len int, tokenizer_max_length int, extra string, node int").json(path)
    kind = F.coalesce("model_type", F.when(F.col("source_model").isNotNull() & F.col("target_model").isNotNull(), "convert").when(F.col("target_dim").isNotNull(), "embed").otherwise("legacy"))
    last = Window.partitionBy("name").orderBy(F.col("node").desc_nulls_last())
    rows = raw.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    return rows.select("name", kind.alias("model_type"), "source_model", "target_model", "source_dim", "target_dim", F.least("sequence_len", "tokenizer_max_length").alias("sequence_len"), F.concat(F.lit('{"extra":'), F.coalesce("extra", F.lit("{}")), F.lit("}")).alias("raw"), F.current_timestamp().alias("last_seen"))


def one_width(models: DataFrame) -> DataFrame:
    """Without routes that contradict their space's dimension, which is that of its first route by name."""
    space = F.coalesce("target_model", "name")
    width = F.first("target_dim", ignorenulls=True).over(Window.partitionBy("model_type", space).orderBy("name"))
    return models.withColumn("__w", width).where("model_type != 'embed' or target_dim is null or target_dim <=> __w").drop("__w")


def upserted(models: DataFrame, fresh: DataFrame, complete: bool) -> DataFrame:
    """The model table after discovery, with `changed`: rows whose facts differ are replaced, others only seen again; what a
    complete discovery didn't bring is gone."""
    facts = ["model_type", "source_model", "target_model", "source_dim", "target_dim", "sequence_len", "raw"]
    old, new = models.select("name", F.struct(*facts).alias("o"), F.col("last_seen").alias("os")), fresh.select("name", F.struct(*facts).alias("n"), F.col("last_seen").alias("ns"))
    both = old.join(new, "name", "full_outer")
    kept = both if not complete else both.where("n is not null")
    return kept.select("name", F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.col("o")).alias("f"), F.coalesce("ns", "os").alias("last_seen"), (F.col("n").isNotNull() & ~F.col("o").eqNullSafe(F.col("n"))).alias("changed")).select("name", "f.*", "last_seen", "changed")
