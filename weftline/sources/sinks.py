"""Sinks: decks, notes, status logs and cascades."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.inputs import kept


def write_deck(deck: DataFrame, path: str, fmt: str = "parquet", again: bool = False) -> None:
    """The deck in ``buckets`` of requests; left alone where it is there, unless ``again``."""
    deck.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(64))).write.partitionBy("bucket").mode("overwrite" if again else "ignore").format(fmt).save(path)


def image_encoding(width: Column, height: Column, n_bytes: Column, alpha: Column) -> Column:
    """How an image is kept: null under 8 pixels or over 8 MB, jpeg for large opaque ones and large files, else png."""
    return (
        F.when((width < 8) | (height < 8) | (n_bytes > 8 << 20), F.lit(None)).when((width * height > 1_500_000) & ~alpha, "jpeg").when(n_bytes > 2_500_000, "jpeg").otherwise("png")
    )


def table_preview(rows: Column) -> Column:
    """At most eight rows of five cells."""
    return F.transform(F.slice(rows, 1, 8), lambda r: F.slice(r, 1, 5))


def artifacts(row: Column) -> Column:
    """The distinct files of a presentation: its own and those its configuration names."""
    paths = F.concat(F.array(row["file_path"], F.regexp_replace(row["file_path"], "\\.pptx$", ".pdf")), F.coalesce(row["assets"], F.array().cast("array<string>")))
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != "")))


def status_appended(log: DataFrame, updates: DataFrame) -> DataFrame:
    """The status log with more rows; the newest of a key is its state."""
    return log.unionByName(updates, allowMissingColumns=True)


def upserted(updates: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Bring a table of one row a key to its newest rows: key, batch (a number that grows), and any other columns.

    A key's row with the greatest batch stays, so a batch that is written again, or comes late,
    changes nothing; of rows with one key and batch, that with the greatest other columns, compared
    in their order. Only the buckets of keys that are updated are read and replaced, by an overwrite
    of their partitions; the merged rows are written apart first, so a job that fails halfway is run
    again on what it has read. The columns of the updates are those of the table; a null key is a
    key. One writer at a time.
    """
    spark, columns = updates.sparkSession, updates.columns
    new = kept(updates.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "updates")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    try:
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        both = new.unionByName(old)
    except AnalysisException:
        both = new
    rest = F.struct("batch", *(F.col(c) for c in columns if c not in (key, "batch")))
    row = F.struct(*columns)
    merged = kept(both.groupBy("bucket", key).agg(F.max_by(row, rest).alias("row")).select("row.*", "bucket"), "merged")
    merged.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)
