"""Queries that plan and assemble decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import maths
from weftline.functions import text as t
from weftline.operators import deck, matching, model_output, normalize, planner
from weftline.operators.structure import structure
from weftline.plans.inputs import kept, requests, table
from weftline.plans.slot_queries import tokens_sql


def _structured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    heads, sections = structure(normalize.normalise(docs), kept)
    sections = kept(sections, "sections")
    asked = requests(docs).join(heads.select("doc_id", "title", "subtitle", F.col("author").alias("author_name")), "doc_id", "left")
    asked = asked.withColumn("title", F.coalesce("title", F.lit("Presentation"))).withColumn("author_email", F.lit(None).cast("string")).withColumnRenamed("doc_id", "request_id")
    return docs, sections.withColumnRenamed("doc_id", "request_id"), kept(asked, "requests")


def _content(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """Content slides without their notes, which no query here reads."""
    return kept(deck.content_slides(planner.plan(sections, asked, kept), asked).drop("notes"), "content")


def section_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs no requests, so none are made."""
    sections = structure(normalize.normalise(table(spark, sf_dir, "documents")), kept)[1].withColumnRenamed("doc_id", "request_id")
    return planner.atoms(sections).select("request_id", "atom_no", "section", "kind", F.size("points").alias("n_points"))


def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    pool = kept(planner.merged(planner.pools(planner.atoms(sections), asked)), "pool")
    return planner.allocated(pool).select("request_id", "kind", "no", "section", F.size("points").alias("n_points"), "slots")


def planned_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    return planner.plan(sections, asked, kept).withColumn("bullets", F.array_join("bullets", "\n"))


def plan_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    return planner.shortfall(planner.plan(sections, asked, kept), asked)


def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    content = _content(sections, asked)
    return deck.outline(content, asked).withColumn("bullets", F.array_join("bullets", "\n"))


def recap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    content = _content(sections, asked)
    return deck.recap(content).select("request_id", F.posexplode("bullets").alias("pos", "line"))


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections, asked = _structured(spark, sf_dir)
    content = _content(sections, asked)
    return deck.assemble(content, asked).withColumn("bullets", F.array_join("bullets", "\n"))


def rendered_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks whose slides have visuals by their number of lines: diagrams, dense figures, photos of documents and drawn infographics."""
    _, sections, asked = _structured(spark, sf_dir)
    whole = deck.assemble(_content(sections, asked), asked)
    n, none = F.size("bullets"), F.lit(None)
    image = F.struct(
        F.when(n > 1, F.concat(F.lit("https://images.invalid/"), F.col("slide_number").cast("string"))).alias("url"), F.when(n == 5, F.col("title")).otherwise(none).alias("diagram"),
        (n == 4).alias("promote"), (n == 3).alias("local"), F.col("title").alias("keyword"), F.col("title").rlike("[A-Z]").alias("generated"),
    )
    out = deck.content_ordinal(deck.promoted(whole, deck.deserves_slide(F.col("type"), image), F.when(n == 4, F.concat(F.lit("Figure: "), "title"))))
    blocks = spark.createDataFrame([(1, "cover"), (2, "outline"), (3, "theory"), (4, "practical"), (5, "theory"), (6, "end")], "block_no int, type string")
    return deck.matched_blocks(out, blocks).select("request_id", "slide_number", "type", "title", "content_index", "block_no", maths.fitted_size(F.col("bullets"), 9.0, 4.5, 20.0, 9.0).alias("font_size"))


def figure_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that is not empty is a figure of its own deck: the line is the caption, its first three words are the section."""
    docs, sections, asked = _structured(spark, sf_dir)
    content = _content(sections, asked)
    lines = docs.select(F.col("doc_id").alias("request_id"), F.posexplode(F.split("text", "\n")).alias("figure_no", "caption")).where("caption <> ''")
    figures = lines.withColumn("section", F.substring_index("caption", " ", 3))
    return matching.figure_matches(content, figures).withColumn("score", F.round("score", 9))


def redistributed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = model_output.redistributed(F.split("text", "\n"), (2 + F.pmod("doc_id", F.lit(5))).cast("int"))
    return docs.select("doc_id", F.posexplode(runs).alias("run", "points")).select("doc_id", "run", F.size("points").alias("n_points"), F.array_join("points", "\n").alias("points"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the block form made of each conversation, brought to four slides."""
    c = table(spark, sf_dir, "conversations")
    block = F.concat(F.lit("<<<START_SLIDE>>>\nTITLE: Turn "), F.col("turn").cast("string"), F.lit("\nTYPE: "), F.when(F.col("role") == "user", "practical").otherwise("theory"), F.lit("\n- "), F.regexp_replace("text", "\\s+", " "), F.lit("\n<<<END_SLIDE>>>"))
    raw = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n").alias("raw"))
    return model_output.normalised_count(model_output.parsed(raw.select(F.col("conv_id").cast("string").alias("prompt_hash"), F.lit(4).alias("requested"), "raw")))


def model_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the block form made of each conversation, parsed back and brought to the requested number."""
    s = _answers(spark, sf_dir).select("prompt_hash", F.posexplode("slides").alias("pos", "s"))
    return s.select("prompt_hash", "pos", "s.title", "s.type", F.array_join("s.bullets", "\n").alias("bullets"))


def model_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of conversations: the slides of their answers as sections, planned again, and wrapped like any other deck."""
    got = kept(_answers(spark, sf_dir).withColumn("doc_id", F.col("prompt_hash").cast("long")), "answers")
    asked = requests(got.select("doc_id", F.array_join(F.flatten(F.transform("slides", lambda s: s["bullets"])), " ").alias("text"))).withColumnRenamed("doc_id", "request_id")
    none = F.lit(None).cast("string")
    asked = kept(asked.select("*", F.concat(F.lit("Conversation "), F.col("request_id").cast("string")).alias("title"), none.alias("subtitle"), none.alias("author_name"), none.alias("author_email")), "requests")
    sections = kept(model_output.sections(got.withColumnRenamed("doc_id", "request_id")), "sections")
    return deck.assemble(_content(sections, asked), asked).withColumn("bullets", F.array_join("bullets", "\n"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(F.col("p_partkey") * 2654435, F.lit(16777216))), 6, "0"))
    p = table(spark, sf_dir, "part").select("p_partkey", hexed.alias("colour"))
    return p.select("p_partkey", "colour", F.round(maths.luminance(F.col("colour")), 6).alias("luminance"), maths.contrast(F.col("colour")).alias("contrast"), maths.tint(F.col("colour"), 0.5).alias("tint"))


def ranked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as image candidates: the best of each brand for every type, then two of them."""
    p = table(spark, sf_dir, "part")
    c = p.select(
        F.col("p_type").alias("query"), F.col("p_brand").alias("provider"), F.dense_rank().over(_order()).alias("provider_pos"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"),
        (600 + F.col("p_size") * 20).alias("width"), (300 + F.pmod("p_partkey", F.lit(700)) + F.col("p_size")).alias("height"), F.lit("image/png").alias("mime"), F.lit(1.5).alias("target_ratio"),
    )
    return matching.ranked_candidates(c).select("query", "provider", "pos", F.round("score", 9).alias("score"))


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("p_type").orderBy("p_brand")


def formatted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.formatted_runs(F.col("text"))).alias("pos", "run"))
    return docs.groupBy("doc_id", F.col("run.style").alias("style")).agg(F.count("*").alias("n"), F.sum(F.length("run.text")).alias("chars"))


QUERIES = [section_atoms, slot_allocation, planned_slides, plan_shortfall, outline_pages, recap_lines, decks, rendered_decks, figure_matches, redistributed_points, model_slides, model_decks, colours, ranked_images, formatted_runs]

SQL = {
    "redistributed_points": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p, 2 + doc_id % 5 AS k FROM documents), r AS (SELECT *, unnest(range(0, k)) AS i, len(p) AS n FROM d),
    c AS (SELECT *, i * (n // k) + least(i, n % k) AS lo, (i + 1) * (n // k) + least(i + 1, n % k) AS hi FROM r)
    SELECT doc_id, CAST(i AS INTEGER) AS run, CAST(hi - lo AS INTEGER) AS n_points, coalesce(array_to_string(p[lo + 1:hi], chr(10)), '') AS points FROM c""",
    "formatted_runs": r"""WITH r AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '(\*\*[^*]+\*\*|--[^-]+--|__[^_]+__)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')) AS p FROM documents),
    s AS (SELECT doc_id, p, CASE WHEN length(p) <= 4 THEN 'plain' WHEN starts_with(p, '**') AND ends_with(p, '**') THEN 'bold' WHEN starts_with(p, '--') AND ends_with(p, '--') THEN 'highlight' WHEN starts_with(p, '__') AND ends_with(p, '__') THEN 'italic' ELSE 'plain' END AS style FROM r)
    SELECT doc_id, style, count(*) AS n, CAST(sum(CASE WHEN style = 'plain' THEN length(p) ELSE length(p) - 4 END) AS BIGINT) AS chars FROM s GROUP BY ALL""",
    "ranked_images": rf"""WITH t AS (SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) AS provider_pos, 600 + p_size * 20 AS w, 300 + p_partkey % 700 + p_size AS h, {tokens_sql("p_name")} AS a, {tokens_sql("p_type")} AS q FROM part),
    s AS (SELECT p_type AS query, p_brand AS provider, p_partkey AS pos, provider_pos, (1 - CASE WHEN len(q) > 0 THEN len(list_intersect(a, q)) / len(q)::DOUBLE ELSE 0.0 END) + 0.35::DOUBLE * least(abs(w / h::DOUBLE - 1.5) / 1.5::DOUBLE, 2.0) AS score FROM t WHERE w >= 640 AND h >= 360),
    o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, provider ORDER BY score, pos) = 1)
    SELECT query, provider, pos, round(score, 9) AS score FROM o QUALIFY row_number() OVER (PARTITION BY query ORDER BY score, provider_pos) <= 2""",
    "colours": """WITH c AS (SELECT p_partkey, '#' || lpad(upper(to_hex((p_partkey * 2654435) % 16777216)), 6, '0') AS colour, (p_partkey * 2654435) % 16777216 AS v FROM part),
    x AS (SELECT *, v // 65536 AS r, (v // 256) % 256 AS g, v % 256 AS b FROM c)
    SELECT p_partkey, colour, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luminance, CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 140 THEN '#FFFFFF' ELSE '#000000' END AS contrast,
    '#' || lpad(upper(to_hex(CAST(floor(r + (255 - r) * 0.5) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(g + (255 - g) * 0.5) AS BIGINT))), 2, '0') || lpad(upper(to_hex(CAST(floor(b + (255 - b) * 0.5) AS BIGINT))), 2, '0') AS tint FROM x""",
}
