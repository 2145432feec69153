"""How the registered queries read their tables, and the requests that they make of documents."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import maths
from weftline.functions.text import n_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(docs: DataFrame) -> DataFrame:
    """A deck request for every document, its parameters made from the id."""
    i = F.coalesce("doc_id", F.lit(0))
    levels = F.array(F.lit("Beginner"), F.lit("Intermediate"), F.lit("Advanced"))
    r = docs.select(
        "doc_id", n_words("text").alias("words"), (5 + F.pmod(i, F.lit(46))).cast("int").alias("slide_count"), F.pmod(i * 7, F.lit(101)).cast("int").alias("theory_percent"),
        F.pmod(i * 13, F.lit(101)).cast("int").alias("image_percent"), F.get(levels, F.pmod(i, F.lit(3)).cast("int")).alias("audience_level"),
    )
    d = maths.distribution(F.col("slide_count"), F.col("theory_percent"), F.col("image_percent"), F.col("words"))
    return r.withColumn("d", d).select("doc_id", "words", "slide_count", "theory_percent", "image_percent", "audience_level", "d.*")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on one machine only (tests), one set here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder once and read back, for what a plan reads several times."""
    path = f"{scratch(df.sparkSession)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
