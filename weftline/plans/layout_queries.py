"""Queries over paged layouts: figures with captions and sections, images that may be figures, clusters with their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import figures
from weftline.plans.inputs import kept, table

#: Lines of orders laid out on pages: a document for each supplier, a page for each line number, a place from the other columns.
WIDTH, HEIGHT = 600.0, 800.0


def layout(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Pages, text lines, headings, tables, images and drawings made of lineitem, every row of which is one of the last five."""
    li = table(spark, sf_dir, "lineitem")
    page = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    x0, y0 = (F.col("l_partkey") * 37 % 560).cast("double"), (F.col("l_orderkey") * 53 % 760).cast("double")
    rows = kept(li.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page"), F.row_number().over(page).alias("no"), x0.alias("x0"), y0.alias("y0"), (F.col("l_orderkey") % 20).alias("k")), "layout")
    q = F.col("l_quantity")

    def boxes(which: str, width: Column, height: Column, *more: Column) -> DataFrame:
        sides = ("x0", "y0", F.least(F.col("x0") + width, F.lit(WIDTH)).alias("x1"), F.least(F.col("y0") + height, F.lit(HEIGHT)).alias("y1"))
        return rows.where(which).select("doc_id", "page", *sides, *more)

    caption = F.concat(F.when(F.col("k") == 0, "Figure ").otherwise("see "), q.cast("int").cast("string"), F.lit(": "), "l_returnflag")
    return {
        "pages": rows.select("doc_id", "page").distinct().select("*", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), ((F.col("page") == 0) & (F.col("doc_id") % 3 == 0)).alias("preliminary")),
        "lines": rows.where("k in (0, 1, 2)").select("doc_id", "page", F.col("no").alias("line_no"), caption.alias("text"), "y0", (F.col("y0") + 10).alias("y1")),
        "headings": rows.where("k = 3").select("doc_id", "page", F.col("no").alias("heading_no"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text"), F.col("y0").alias("y")),
        "tables": boxes("k = 4", 20 + q, 10 + q, F.col("no").alias("table_no"), (F.col("l_partkey") % 4).alias("n_rows")),
        "rasters": boxes("k in (5, 6)", 3 * q, 2 * q, F.col("no").alias("raster_no"), (q * 8).cast("int").alias("width"), (q * 6).cast("int").alias("height"), F.sha1((F.col("l_partkey") % 29).cast("string")).alias("sha1")),
        "drawings": boxes("k > 6", q, F.when(F.col("l_discount") < 0.02, 0.0).otherwise(50 - q), F.col("no").alias("rect_no"), (1 + F.col("l_partkey") % 3).alias("items")),
    }


def lifted_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.lifted(**layout(spark, sf_dir))


def usable_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = layout(spark, sf_dir)
    return figures.usable_rasters(at["rasters"], at["tables"].where("n_rows >= 2"), at["pages"]).select("doc_id", "page", "raster_no", "sha1")


def grown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = layout(spark, sf_dir)
    return figures.with_labels(figures.rect_clusters(at["drawings"]), at["lines"])


QUERIES = [lifted_figures, usable_rasters, grown_clusters]

SQL = {
    "usable_rasters": """WITH l AS (SELECT *, l_suppkey AS doc_id, l_linenumber - 1 AS page, l_orderkey % 20 AS k, CAST(l_partkey * 37 % 560 AS DOUBLE) AS x0, CAST(l_orderkey * 53 % 760 AS DOUBLE) AS y0,
        row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS no FROM lineitem),
    t AS (SELECT doc_id, page, x0, y0, least(x0 + 20 + l_quantity, 600) AS x1, least(y0 + 10 + l_quantity, 800) AS y1 FROM l WHERE k = 4 AND l_partkey % 4 >= 2),
    r AS (SELECT doc_id, page, no AS raster_no, x0, y0, least(x0 + 3 * l_quantity, 600) AS x1, least(y0 + 2 * l_quantity, 800) AS y1, sha1(CAST(l_partkey % 29 AS VARCHAR)) AS sha1 FROM l WHERE k IN (5, 6) AND floor(l_quantity * 8) >= 140 AND floor(l_quantity * 6) >= 100),
    f AS (SELECT * FROM r WHERE (x1 - x0) * (y1 - y0) / 480000 BETWEEN 0.008 AND 0.86 AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = r.doc_id AND t.page = r.page AND t.x0 <= r.x1 + 4 AND r.x0 <= t.x1 + 4 AND t.y0 <= r.y1 + 4 AND r.y0 <= t.y1 + 4))
    SELECT doc_id, page, raster_no, sha1 FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, sha1 ORDER BY page, raster_no) <= 2""",
}
