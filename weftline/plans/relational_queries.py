"""Queries over the relational tables: look-ups, latest rows, clashes, chains, geometry and windows of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import duration_seconds
from weftline.operators import catalog, figures, geometry, model_output
from weftline.plans.inputs import scratch, table
from weftline.streaming import stream


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return catalog.latest_per(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def customer_orders_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    both = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return both.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("guest"), F.col("o_custkey").cast("string"))).alias("name"), "n_name")


def presentations_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, orders as presentations with a JSON configuration, lines as tasks."""
    o, c, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    config = F.when(F.col("o_orderkey") % 3 == 0, "{}").otherwise(F.concat(F.lit('{"title": "Deck '), F.col("o_orderkey").cast("string"), F.lit('"}')))
    p = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), config.alias("configuration_json"))
    u = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    task = li.select(F.col("l_orderkey").alias("presentation_id"), F.col("l_shipdate").alias("created_at"), F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.col("l_returnflag"), F.col("l_linestatus")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("status"))
    return catalog.presentation_list(p, u, task)


def clash_excluding_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clashes(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


def ordered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers."""
    s = table(spark, sf_dir, "supplier")
    p = s.select(
        F.col("s_name").alias("name"), F.concat(F.lit("type"), (F.col("s_nationkey") % 5).cast("string")).alias("provider_type"), F.lit("m").alias("model"), (F.col("s_acctbal") > 0).alias("enabled"), F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 7).cast("int")).alias("priority"),
        (F.col("s_suppkey") % 10 == 0).alias("is_default"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("outline"))).otherwise(F.array().cast("array<string>")).alias("tasks"),
        F.when(F.col("s_suppkey") % 5 == 0, F.create_map(F.lit("outline"), F.lit("small"))).otherwise(F.create_map().cast("map<string,string>")).alias("overrides"),
    )
    own = spark.createDataFrame([("built-in", "type9", "m")], "name string, provider_type string, model string")
    return catalog.provider_chain(p, "outline", own)


def props_json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.title"), F.lit("Untitled")).alias("title"))


def orders_without_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade by anti-join: orders none of whose lines was returned."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return catalog.without(table(spark, sf_dir, "orders"), gone, "o_orderkey", "l_orderkey").select("o_orderkey")


def enclosing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks on pages: each purchase under the last other event above it, as-of by user and time."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("y"))
    figures = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page"), F.col("event_id").alias("figure_no"), F.col("y").alias("y0"))
    heads = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page"), F.col("y").alias("y0"), F.col("event_id").cast("string").alias("text"))
    return geometry.enclosing_headings(figures, heads)


def rect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes on its page."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 600, F.col("l_suppkey") % 800
    boxes = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity")).cast("double").alias("x1"), (y + F.col("l_quantity")).cast("double").alias("y1"), F.lit(1).cast("long").alias("items"))
    return figures.rect_clusters(boxes).drop("first")


def spaced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return model_output.spaced(calls).select("id", F.round(F.col("start") - F.col("at"), 3).alias("waited"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat((F.col("user_id") % 60).cast("string"), F.lit("m"), (F.col("event_id") % 60).cast("string"), F.lit("s")).alias("told"))
    return e.select("event_id", F.round(duration_seconds(F.col("told")), 3).alias("seconds"))


def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ordinal: events of a user before each of them, and their running value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.row_number().over(w) - 1).cast("long").alias("before"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


def streamed_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the events, taken once: each batch adds the windows it changed, and the last state of a window counts.

    The watermark lets the stream forget windows that are over.
    """
    e = stream.document_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    counted = stream.events_per_window(e.withColumn("ts", F.col("ts").cast("timestamp")))
    out = f"{scratch(spark)}/weftline-stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


QUERIES = [
    latest_event_per_user, customer_orders_lookup, presentations_of_customers, clash_excluding_self, ordered_chain, props_json_default, orders_without_returns, enclosing_headings, rect_clusters, spaced_calls, durations,
    running_share, streamed_event_windows,
]

SQL = {
    "latest_event_per_user": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    "customer_orders_lookup": "SELECT o_orderkey, coalesce(c_name, 'guest' || o_custkey) AS name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "presentations_of_customers": """WITH t AS (SELECT l_orderkey, l_returnflag || l_linestatus AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) = 1)
    SELECT o_orderkey AS id, o_custkey AS user_id, coalesce(c_name, 'guest' || o_custkey) AS username, CASE WHEN o_orderkey % 3 = 0 THEN 'Untitled' ELSE 'Deck ' || o_orderkey END AS title, status
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON l_orderkey = o_orderkey""",
    "clash_excluding_self": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id <> d.doc_id)",
    "ordered_chain": """WITH p AS (SELECT s_name AS name, 'type' || s_nationkey % 5 AS provider_type, CASE WHEN s_suppkey % 5 = 0 THEN 'small' ELSE 'm' END AS model, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 7 AS INTEGER) ELSE 100 END AS priority,
    s_suppkey % 10 = 0 AS is_default, 0 AS last FROM supplier WHERE s_acctbal > 0), u AS (SELECT * FROM p UNION ALL SELECT 'built-in', 'type9', 'm', 100, true, 1)
    SELECT name, provider_type, model, priority, is_default, CAST(row_number() OVER (ORDER BY last, is_default, CASE WHEN NOT is_default THEN priority END NULLS FIRST, CASE WHEN NOT is_default THEN name END NULLS FIRST, name) AS INTEGER) AS position FROM u""",
    "props_json_default": "SELECT event_id, coalesce(CAST(props::JSON ->> '$.k' AS BIGINT), -1) AS k, coalesce(props::JSON ->> '$.title', 'Untitled') AS title FROM events",
    "orders_without_returns": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "enclosing_headings": """SELECT user_id AS doc_id, event_id AS figure_no, coalesce(section, '') AS section FROM (SELECT user_id, event_id, event_type,
    last_value(CASE WHEN event_type <> 'purchase' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) + CASE WHEN event_type = 'purchase' THEN 6 ELSE 0 END, event_type = 'purchase' ROWS UNBOUNDED PRECEDING) AS section FROM events) WHERE event_type = 'purchase'""",
    "durations": "SELECT event_id, round(CAST((user_id % 60) * 60 + event_id % 60 AS DOUBLE), 3) AS seconds FROM events",
    "spaced_calls": """WITH c AS (SELECT event_type, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS sec, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS n FROM events)
    SELECT event_id AS id, round(max(sec - n * 3.5::DOUBLE) OVER (PARTITION BY event_type ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 3.5::DOUBLE - sec, 3) AS waited FROM c""",
    "running_share": "SELECT event_id, row_number() OVER w - 1 AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "streamed_event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
