"""From raw documents to a mix: quality rules, near duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are written as Parquet and
read again in between. All but the last return the columns of ``documents``. Ids to keep or drop
grow with the corpus, so they are never broadcast: both filters are shuffled hash joins at any size,
with the ids, not the texts, in memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard_join, mixing, pii
from weftline.llm import quality_rules as rules
from weftline.llm.common import shared_dir, table, written

#: Near duplicates: words a shingle, and least similarity in percent.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject: null, empty and short texts among them. All columns stay; repeated rows fare alike."""
    return rules.quality_rules(docs, carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every class of near duplicates; of rows that repeat an id and text, one.

    Texts without words are classes of their own and stay. Rows with a null id stay only where their
    class has no other id; different texts that share the least id of their classes all stay.
    """
    classes = written(jaccard_join.jaccard_classes(docs, k=SHINGLE, percent=PERCENT), "classes")
    keep = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    out = docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["_id"]), "left_semi")
    unique = classes.groupBy("doc_id").count().where("count > 1").isEmpty()
    return out if unique else out.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item. Rows with a null id stay; all rows of an id that leaks go; an empty table drops none."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and the terms that reveal it, in every text.

    All rows and columns stay; a null text stays null, with a null length.
    """
    out = pii.sanitise(docs, carry=tuple(docs.columns))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document as often as it is taken, with ``copy`` from 1. A null source is one of its own; see mix_sources for ties and empty texts."""
    plan = mixing.mix_sources(docs).select("doc_id", "copies")
    return mixing.taken_rows(docs, plan)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", sanitise),
    ("mixing", mix),
]

#: Several stages cannot be expressed in SQL (see tests/llm for the brute-force versions).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/weftline-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
