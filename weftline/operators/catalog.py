"""Relational look-ups around the pipeline: users, templates, providers, presentations and their tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.inputs import kept


def latest_per(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row of each key, the least tie-breaker of equals."""
    w = Window.partitionBy(key).orderBy(F.desc(time), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def presentation_list(presentations: DataFrame, users: DataFrame, tasks: DataFrame) -> DataFrame:
    """Presentations with their user's name (guest<id> without one), the latest status and the title of the JSON configuration."""
    last = latest_per(tasks, "presentation_id", "created_at", "id").select("presentation_id", "status")
    named = presentations.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    named = named.join(last, named["id"] == last["presentation_id"], "left")
    title = F.coalesce(F.get_json_object("configuration_json", "$.title"), F.lit("Untitled"))
    return named.select("id", "user_id", F.coalesce("username", F.concat(F.lit("guest"), F.col("user_id").cast("string"))).alias("username"), title.alias("title"), "status")


def clashes(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """Rows whose key another id has too: one aggregate over digests of the keys, however long these are, and no self-join. Null keys clash with none."""
    dealt = rows.where(F.col(key).isNotNull()).withColumn("_digest", F.sha2(F.col(key).cast("string").cast("binary"), 256))
    ids = dealt.groupBy("_digest").agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi")).where("_lo <> _hi")
    return dealt.join(ids.select("_digest"), "_digest", "left_semi").drop("_digest")


def provider_chain(providers: DataFrame, task: str, builtin: DataFrame) -> DataFrame:
    """Enabled providers that serve the task: others by (priority, name) before the default ones, and the built-in last if no provider has its type.

    providers: name, provider_type, model, enabled, priority, is_default, tasks (array, empty for all), overrides (map).
    """
    serves = (F.coalesce(F.size("tasks"), F.lit(0)) <= 0) | F.array_contains("tasks", task)
    model = F.coalesce(F.nullif(F.element_at("overrides", F.lit(task)), F.lit("")), F.col("model"))
    p = providers.where(F.col("enabled") & serves).select("name", "provider_type", model.alias("model"), F.coalesce("priority", F.lit(100)).alias("priority"), F.coalesce("is_default", F.lit(False)).alias("is_default"), F.lit(0).alias("last"))
    own = builtin.join(p, "provider_type", "left_anti").select("name", "provider_type", "model", F.lit(100).alias("priority"), F.lit(True).alias("is_default"), F.lit(1).alias("last"))
    keys = ["last", "is_default", F.when(~F.col("is_default"), F.col("priority")), F.when(~F.col("is_default"), F.col("name"))]
    return numbered(p.unionByName(own), keys, "position").drop("last")


def numbered(rows: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """Rows with their number from 1 in the order of keys: ranges of keys are numbered apart, and each starts after the sizes of those before it, a row a range."""
    dealt = kept(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.withColumn("_own", inside).join(starts, "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("int")).drop("_range", "_own", "_start")


def redacted(providers: DataFrame, secret: str = "api_key") -> DataFrame:
    """The listing by (priority, id) that tells whether there is a key, never which."""
    return providers.withColumn("has_api_key", F.coalesce(F.col(secret), F.lit("")) != "").drop(secret).orderBy("priority", "id")


def without(rows: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Cascade: rows whose key is not among the deleted ones."""
    return rows.join(gone.select(F.col(other or key).alias(key)).distinct(), key, "left_anti")


def seeded(rows: DataFrame, default: DataFrame) -> DataFrame:
    """The table, or the default rows where it is empty."""
    return rows.unionByName(default.join(rows.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti"))


def is_admin(role: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(role.isin("admin", "admin1"), F.lit(False))


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): 5 to 50 slides, percentages of 0 to 100, a title, 50 characters of text or 20 of a brief."""
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    reason = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title").when(~F.col("slide_count").between(5, 50), "slide_count").when(~F.col("theory_percent").between(0, 100), "theory_percent")
        .when(~F.col("image_percent").between(0, 100), "image_percent").when((F.col("content_type") == "prompt") & (n < 20), "content").when((F.col("content_type") == "text") & (n < 50), "content")
    )
    told = requests.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")
