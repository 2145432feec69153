"""Queries of page rules, answers, requests, status logs and crops, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import maths
from weftline.operators import catalog, geometry, model_output, normalize
from weftline.plans.inputs import table
from weftline.sources import readers, sinks


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a page with a body of 20 points; every other one is bold."""
    p = table(spark, sf_dir, "part")
    header = geometry.is_page_header(F.col("p_name"), F.col("p_size"), F.col("p_partkey") % 2 == 0, F.lit(20))
    return p.select("p_partkey", header.alias("header"))


def blocks_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks of its page; the first ones span tables."""
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 800).cast("double")
    boxes = li.select("l_linenumber", "l_partkey", F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"))
    tables = boxes.where("l_linenumber = 1").withColumn("x1", F.col("x0") + 300).withColumn("y1", F.col("y0") + 400)
    out = geometry.outside_tables(boxes.where("l_linenumber > 1"), tables)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as clusters on a page of 100 by 100 points, with as many items as their quantity."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    c = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("cluster"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), q.alias("x1"), (F.col("l_partkey") % 100).cast("double").alias("y1"),
        q.cast("long").alias("items"),
    )
    return geometry.figure_like(c, 10_000.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("items").alias("items"))


def cover_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", maths.cover_crop(F.col("p_partkey") % 3000 + 1, F.col("p_size") * 20, F.lit(1.5)).alias("c")).select("p_partkey", "c.left", "c.top", "c.width", "c.height")


def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two providers that answer some customers, one of them with blanks, and one that answers all."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    first, second = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit("a"), k.cast("string"))), F.when(k % 2 == 0, F.col("c_name"))
    return c.select("c_custkey", model_output.first_answer(first, second, F.lit("built-in")).alias("answer"))


def quotas_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error bodies that name a daily quota, a quota of the minute, or nothing that is JSON."""
    body = F.when(F.col("event_id") % 3 < 2, F.concat(F.lit('{"error":{"details":[{},{"violations":[{"quotaId":"Requests'), F.when(F.col("event_id") % 3 == 0, "PerDay").otherwise("PerMinute"), F.lit('"}]}]}}'))).otherwise("busy")
    return table(spark, sf_dir, "events").select("event_id", model_output.quota_exhausted(body).alias("exhausted"))


def current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a status log and its later additions; the newest row of a user is its state."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    log = sinks.status_appended(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))
    return catalog.latest_per(log, "user_id", "ts", "event_id").select("user_id", "status")


def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as deck requests, with the reason why one is refused."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kind = F.when(k % 2 == 0, "prompt").otherwise("text")
    r = c.select(k.alias("id"), F.when(k % 11 > 0, F.col("c_name")).alias("title"), (k % 60).cast("int").alias("slide_count"), (k % 104).cast("int").alias("theory_percent"), (k % 107).cast("int").alias("image_percent"), kind.alias("content_type"), F.repeat(F.lit("x"), (k % 83).cast("int")).alias("content"))
    ok, refused = catalog.valid_requests(r)
    return ok.select("id", F.lit("accepted").alias("reason")).unionByName(refused.select("id", "reason"))


def rejoined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into lines and joined again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return normalize.normalised_text(d).select("doc_id", F.md5("text").alias("text_md5"))


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests with a text of their own, that of a file, or a prompt's answer; blank ones are refused."""
    p = table(spark, sf_dir, "pages")
    name = F.col("page_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("text", "file", "prompt", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    asked = p.select(F.col("page_id").alias("request_id"), kind.alias("content_type"), F.col("html").alias("content"), name.alias("path"), F.md5(name).alias("prompt_hash"))
    files = p.where("page_id % 3 > 0").select(name.alias("path"), F.col("url").alias("text"))
    answered = p.select(F.md5(name).alias("prompt_hash"), F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("answer "), name)).otherwise(" \n").alias("raw"))
    good, refused = readers.resolve_sources(asked, files, answered)
    return good.select("request_id", F.md5("text").alias("text_md5")).unionByName(refused.select("request_id", F.lit(None).cast("string").alias("text_md5")))


QUERIES = [page_headers, blocks_outside_tables, largest_clusters, cover_crops, first_answers, quotas_exhausted, current_status, checked_requests, rejoined_documents, request_texts]

SQL = {
    "page_headers": "SELECT p_partkey, length(p_name) <= 120 AND (p_size >= 23.6 OR (p_partkey % 2 = 0 AND p_size >= 20.4)) AS header FROM part",
    "blocks_outside_tables": """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_partkey % 600 AS x, l_suppkey % 800 AS y FROM lineitem)
    SELECT doc_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM b WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM b t WHERE t.doc_id = b.doc_id AND t.l_linenumber = 1
    AND b.x + 5 BETWEEN t.x AND t.x + 300 AND b.y + 5 BETWEEN t.y AND t.y + 400) GROUP BY doc_id""",
    "largest_clusters": """WITH c AS (SELECT *, CAST(l_quantity AS DOUBLE) * CAST(l_partkey % 100 AS DOUBLE) / 10000.0::DOUBLE AS area FROM lineitem),
    r AS (SELECT * FROM c WHERE l_quantity >= 3 AND area BETWEEN 0.012::DOUBLE AND 0.86::DOUBLE QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY area DESC, l_linenumber, l_partkey, l_quantity) <= 3)
    SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS items FROM r GROUP BY ALL""",
    "cover_crops": """WITH p AS (SELECT p_partkey, CAST(p_partkey % 3000 + 1 AS DOUBLE) AS w, CAST(p_size * 20 AS DOUBLE) AS h FROM part), c AS (SELECT *, w / h > 1.5 AS wide FROM p),
    s AS (SELECT *, CASE WHEN wide THEN round(h * 1.5) ELSE w END AS cw, CASE WHEN wide THEN h ELSE round(w / 1.5) END AS ch FROM c)
    SELECT p_partkey, CAST(trunc((w - cw) / 2) AS INTEGER) AS "left", CAST(trunc((h - ch) / 2) AS INTEGER) AS top, CAST(cw AS INTEGER) AS width, CAST(ch AS INTEGER) AS height FROM s""",
    "first_answers": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'a' || c_custkey WHEN c_custkey % 2 = 0 THEN c_name ELSE 'built-in' END AS answer FROM customer",
    "quotas_exhausted": "SELECT event_id, event_id % 3 = 0 AS exhausted FROM events",
    "current_status": "SELECT user_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
    "checked_requests": """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'title' WHEN c_custkey % 60 NOT BETWEEN 5 AND 50 THEN 'slide_count' WHEN c_custkey % 104 > 100 THEN 'theory_percent' WHEN c_custkey % 107 > 100 THEN 'image_percent'
    WHEN c_custkey % 83 < CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 50 END THEN 'content' ELSE 'accepted' END AS reason FROM customer""",
    "rejoined_documents": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "request_texts": r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN CASE WHEN page_id % 3 > 0 THEN url END WHEN 2 THEN CASE WHEN page_id % 5 > 0 THEN 'answer ' || page_id END END AS text FROM pages)
    SELECT page_id AS request_id, CASE WHEN regexp_matches(text, '[^\s\x0b\x1c-\x1f\x85\p{Z}]') THEN md5(text) END AS text_md5 FROM t""",
}
