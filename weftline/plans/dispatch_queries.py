"""Queries of prompts: templates filled from rows, providers in waves, answers from memory, wrapped text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dispatch
from weftline.plans.inputs import scratch, table
from weftline.sources import sinks
from weftline.streaming import stream

#: Widths of some characters, in tenths of a point at ten points; all others are as wide as OTHER.
WIDTHS = {"i": 22.0, "j": 22.0, "l": 22.0, ".": 28.0, ",": 28.0, "f": 28.0, "t": 28.0, "r": 33.0, "m": 83.0, "w": 72.0, "M": 83.0, "W": 94.0}
SPACE, OTHER, MOST = 28.0, 56.0, 1800.0


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each type of part, one of them with a name that no part has, filled from every part of the type."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "ECONOMY", "{colour}").otherwise("{name}")
    templates = p.select("p_type").distinct().select("p_type", F.concat(F.lit("Write {size} slides on "), name, F.lit(" for {brand}, of type "), F.lower("p_type"), F.lit(". {name} costs {price}; {braces")).alias("template"))
    values = F.map_from_arrays(F.array(*map(F.lit, ("name", "brand", "size", "price"))), F.array("p_name", F.concat(F.lit("{size} "), "p_brand"), F.col("p_size").cast("string"), F.nullif(F.col("p_size") % 7, F.lit(0)).cast("string")))
    return p.join(templates, "p_type").select("p_partkey", dispatch.filled(F.col("template"), values).alias("f")).select("p_partkey", "f.text", F.array_join("f.missing", ",").alias("missing"))


CHAIN = ["quick", "steady", "built-in"]


def answers_in_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a prompt of its day: the first provider knows clicks and views and runs out of quota now and then, the second knows large values, the last all but errors."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    k = F.get_json_object("props", "$.k").cast("int")
    of = lambda name, body, quota: e.select(F.lit(name).alias("provider"), F.col("event_id").alias("prompt_id"), body.alias("body"), quota.alias("quota"))
    quick = of("quick", F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("q"), "event_type")).otherwise("  "), k == 97)
    steady = of("steady", F.when(F.col("value") > 20, F.concat(F.lit("s"), F.col("event_id").cast("string"))), k == 98)
    last = of("built-in", F.when(F.col("event_type") != "error", F.lit("stock")), F.lit(None).cast("boolean"))
    responses = quick.unionByName(steady).unionByName(last)
    out = dispatch.answered_in_waves(e.select(F.col("event_id").alias("prompt_id"), "day", F.col("event_id").alias("turn")), responses, CHAIN)
    return out.select("prompt_id", "answer", "provider", F.size("tried").alias("n_tried"))


def answers_from_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a stream: a prompt for each user and type, whose answer lives six hours."""
    calls = stream.document_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    calls = calls.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("prompt"), F.lit(5).alias("requested"), F.col("event_id").cast("string").alias("answer"))
    out = f"{scratch(spark)}/weftline-memory-{uuid.uuid4().hex}"
    told = stream.answered_from_memory(calls, 6 * 3600)
    told.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{out}/rows").select("id", "answer", "served")


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every whole text, wrapped to 180 points at ten points."""
    widths = F.create_map(*(F.lit(x) for pair in WIDTHS.items() for x in pair))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(dispatch.wrapped(F.col("line"), widths, MOST, SPACE, OTHER)).alias("row", "text"))


def upserted_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as updates of each user's status, in four batches that arrive out of order and partly twice; the table has the newest."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("batch"), F.col("event_type").alias("status"), "value")
    path = f"{scratch(spark)}/weftline-status-{uuid.uuid4().hex}"
    for part in (1, 3, 1, 0, 2, 3):
        sinks.upserted(e.where(F.pmod(F.xxhash64("batch"), F.lit(4)) == part), path, "user_id")
    return spark.read.parquet(path).select("user_id", "batch", "status", "value")


QUERIES = [upserted_status, prompt_texts, answers_in_waves, answers_from_memory, wrapped_lines]

SQL = {
    "upserted_status": "SELECT user_id, event_id AS batch, event_type AS status, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "prompt_texts": """WITH p AS (SELECT p_partkey, p_type = 'ECONOMY' AS odd, p_name, p_size, '{size} ' || p_brand AS brand, lower(p_type) AS type, coalesce(CAST(nullif(p_size % 7, 0) AS VARCHAR), '') AS price FROM part)
    SELECT p_partkey, 'Write ' || p_size || ' slides on ' || CASE WHEN odd THEN '{colour}' ELSE p_name END || ' for ' || brand || ', of type ' || type || '. ' || p_name || ' costs ' || price || '; {braces' AS text,
    CASE WHEN odd THEN 'colour' ELSE '' END AS missing FROM p""",
    "answers_in_waves": """WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    q AS (SELECT day, min(event_id) AS latch FROM e WHERE k = 97 GROUP BY day),
    w1 AS (SELECT event_id, 'q' || event_type AS answer FROM e LEFT JOIN q USING (day) WHERE event_type IN ('click', 'view') AND coalesce(k, 0) <> 97 AND (latch IS NULL OR event_id < latch)),
    r1 AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM w1)),
    s AS (SELECT day, min(event_id) AS latch FROM r1 WHERE k = 98 GROUP BY day),
    w2 AS (SELECT event_id, 's' || event_id AS answer FROM r1 LEFT JOIN s USING (day) WHERE value > 20 AND coalesce(k, 0) <> 98 AND (latch IS NULL OR event_id < latch))
    SELECT event_id AS prompt_id, coalesce(w1.answer, w2.answer, CASE WHEN event_type <> 'error' THEN 'stock' END) AS answer, CASE WHEN w1.answer IS NOT NULL THEN 'quick' WHEN w2.answer IS NOT NULL THEN 'steady' WHEN event_type <> 'error' THEN 'built-in' END AS provider,
    CAST(CASE WHEN w1.answer IS NOT NULL THEN 0 WHEN w2.answer IS NOT NULL THEN 1 WHEN event_type <> 'error' THEN 2 ELSE 3 END AS INTEGER) AS n_tried FROM e LEFT JOIN w1 USING (event_id) LEFT JOIN w2 USING (event_id)""",
    "answers_from_memory": """WITH RECURSIVE c AS (SELECT event_id, ts, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    m AS (SELECT user_id, event_type, n, ts AS since, event_id AS holder, event_id FROM c WHERE n = 1
        UNION ALL SELECT c.user_id, c.event_type, c.n, CASE WHEN c.ts <= m.since + INTERVAL 6 HOUR THEN m.since ELSE c.ts END, CASE WHEN c.ts <= m.since + INTERVAL 6 HOUR THEN m.holder ELSE c.event_id END, c.event_id
        FROM m JOIN c ON c.user_id = m.user_id AND c.event_type = m.event_type AND c.n = m.n + 1)
    SELECT event_id AS id, CAST(holder AS VARCHAR) AS answer, holder <> event_id AS served FROM m""",
}
