"""Queries over texts: counts, lines, sentences, dates, sections, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import maths
from weftline.functions import text as t
from weftline.operators import geometry, matching, normalize
from weftline.operators.structure import structure
from weftline.plans.inputs import kept, requests, table
from weftline.plans.slot_queries import keywords_sql
from weftline.sources.readers import html_text


def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.n_words("text").alias("n_words"))


def slide_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(table(spark, sf_dir, "documents")).select("doc_id", "total_slides", "content_slides", "theory_slides", "practical_slides", "image_slides", "warning")


def slot_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.explode(maths.spread(F.col("content_slides"), F.col("theory_slides"))).alias("slot"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.sentences("text")).alias("n_sentences"))


def packed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", "line_no", F.posexplode(t.pack(t.sentences("line"))).alias("pos", "point"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", normalize.line_kind(F.col("raw")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def inline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("doc_id", "line_no", t.plain("line").alias("clean"))


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalise(table(spark, sf_dir, "documents"))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(normalize.normalise(table(spark, sf_dir, "documents")), kept)[0]


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = structure(normalize.normalise(table(spark, sf_dir, "documents")), kept)[1]
    return s.select("doc_id", "section_no", "heading", "type", F.size("points").alias("n_points"), F.array_join("points", "\n").alias("points"))


def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.section_type(F.col("text")).alias("type"))


def dates_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.col("text").rlike(lex.DATE)).select("doc_id", F.regexp_extract("text", lex.DATE, 0).alias("first_date"))


def contents_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return geometry.contents_ratio(lines, "doc_id").select("doc_id", F.round("ratio", 9).alias("ratio"))


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return geometry.body_size(lines.select("doc_id", (8 + F.length("line") % 7 / 2.0).alias("size"), F.length("line").cast("long").alias("chars")))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("key")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return by.where("copies > 1")


def best_document_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_text_per_item(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def adjacent_turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return matching.adjacent_similarity(turns, "conv_id", "turn", "text").select("conv_id", "turn", F.round("similarity", 9).alias("similarity"))


def keyword_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = t.image_keywords(F.substring("text", 1, 1 << 30))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(k, " ").alias("keywords"), t.image_url(k, "https://images.invalid/?q=").alias("url"))


QUERIES = [
    doc_word_counts, slide_distribution, slot_indices, sentence_counts, packed_sentences, line_classes, inline_clean, normalised_lines, document_titles, document_sections, section_types, dates_found,
    contents_ratio, body_sizes, page_texts, duplicate_documents, best_document_per_item, adjacent_turn_similarity, keyword_hints,
]

#: Words as runs of anything but white space of any kind.
_WORDS = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0b\x1c-\x1f\x85\p{Z}]+')) AS INTEGER)"
_REQUESTS = f"""
WITH r AS (SELECT doc_id, {_WORDS} AS words, 5 + doc_id % 46 AS slide_count, (doc_id * 7) % 101 AS tp, (doc_id * 13) % 101 AS ip FROM documents),
c AS (SELECT *, greatest(slide_count - 4, 1) AS content FROM r),
d AS (SELECT *, CAST(round_even(content * (tp / 100.0::DOUBLE), 0) AS INTEGER) AS theory, CAST(round_even(content * (ip / 100.0::DOUBLE), 0) AS INTEGER) AS image FROM c)
"""
_DATE = lex.DATE.replace("'", "''")
SQL = {
    "doc_word_counts": f"SELECT doc_id, {_WORDS} AS n_words FROM documents",
    "slide_distribution": _REQUESTS
    + """SELECT doc_id, CAST(slide_count AS INTEGER) AS total_slides, CAST(content AS INTEGER) AS content_slides, theory AS theory_slides, CAST(content - theory AS INTEGER) AS practical_slides,
    CAST(least(content, image) AS INTEGER) AS image_slides,
    CASE WHEN words < content * 18 THEN 'Input may be too short (' || words || ' words) for ' || slide_count || ' slides. Slides will carry fewer lines each so nothing has to be repeated.' END AS warning FROM d""",
    "slot_indices": _REQUESTS
    + """SELECT DISTINCT doc_id, CAST(least(content - 1, round_even(i * (content / theory::DOUBLE), 0)) AS INTEGER) AS slot
    FROM (SELECT *, unnest(range(0, theory)) AS i FROM d WHERE theory > 0)""",
    "sentence_counts": r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')),
    '([.!?]) ([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), '([.!?]) ([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '')) AS INTEGER) AS n_sentences FROM documents""",
    "packed_sentences": r"""WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS line_no, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
    s AS (SELECT doc_id, line_no, list_filter(string_split(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(x, ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')),
    '([.!?]) ([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), '([.!?]) ([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: s <> '') AS p FROM l),
    j AS (SELECT doc_id, line_no, string_split(list_reduce(p, lambda a, s: CASE WHEN length(split_part(a, chr(2), -1)) + 1 + length(s) <= 220 THEN a || ' ' || s ELSE a || chr(2) || s END), chr(2)) AS q FROM s WHERE len(p) > 0)
    SELECT doc_id, line_no, CAST(unnest(range(0, len(q))) AS INTEGER) AS pos, unnest(q) AS point FROM j""",
    # DuckDB's edit distance counts bytes, so each accented letter first becomes one control character
    "adjacent_turn_similarity": """WITH m AS (SELECT string_agg(chr(i), '' ORDER BY i) AS c FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30]) AS i)),
    o AS (SELECT conv_id, turn, translate(text, 'äöüÄÖÜßéèêÉÈÊçÇíÍñÑóÓàáúô', c) AS text FROM conversations, m), t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM o)
    SELECT conv_id, turn, round(greatest(0.0, 1 - levenshtein(text, b) / greatest(length(text), length(b), 1)::DOUBLE), 9) AS similarity FROM t WHERE b IS NOT NULL""",
    "keyword_hints": f"WITH k AS (SELECT doc_id, {keywords_sql("coalesce(text, '')")} AS keywords FROM documents) SELECT doc_id, keywords, 'https://images.invalid/?q=' || replace(keywords, ' ', '+') AS url FROM k",
    "section_types": f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(?:{lex.PRACTICAL_SECTION})\\b') THEN 'practical' ELSE 'theory' END AS type FROM documents",
    "dates_found": f"SELECT doc_id, regexp_extract(text, '{_DATE}', 0) AS first_date FROM documents WHERE regexp_matches(text, '{_DATE}')",
    "contents_ratio": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
    SELECT doc_id, round(avg(CAST(regexp_matches(x, '^\s*.+?(?:\.{2,}|\s{2,}|\s·\s{2,}).*?(?:\d{1,4})\s*$') OR regexp_matches(trim(x), '(?i)^\s*[ivxlcdm]{1,7}\s*$') AS INTEGER)), 9) AS ratio FROM l GROUP BY doc_id""",
    "body_sizes": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), s AS (SELECT doc_id, round_even((8 + length(x) % 7 / 2.0::DOUBLE) * 2, 0) / 2 AS size, length(x) AS chars FROM l),
    g AS (SELECT doc_id, size, sum(chars) AS w FROM s GROUP BY ALL) SELECT doc_id, CAST(size AS DOUBLE) AS body_size FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, size) = 1""",
    "page_texts": r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|article|section)\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text FROM pages""",
    "duplicate_documents": "SELECT sha1(text) AS key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
    "best_document_per_item": """WITH a AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark), b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS shared FROM a JOIN b USING (w) GROUP BY ALL) SELECT item_id, doc_id, shared FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) = 1""",
    "line_classes": r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n|\r|\x{2028}', chr(10), 'g'), chr(10))) AS x FROM documents),
    k AS (SELECT doc_id, CASE WHEN regexp_matches(x, '^[\s\x0b\x1c-\x1f\x85\p{Z}]*$') OR regexp_matches(x, '^\s{0,3}(?:[-*_][ \t]*){3,}$') THEN 'blank' WHEN regexp_matches(x, '^\s*\|.*\|[ \t]*$') THEN 'table'
    WHEN regexp_matches(x, '^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$') THEN 'heading' WHEN regexp_matches(x, '^\s{0,3}(?:>\s?)+') THEN 'quote' WHEN regexp_matches(x, '^(\s*)(?:[-*+•▪◦‣⁃])\s+') THEN 'item'
    WHEN regexp_matches(x, '^\s*\d{1,3}[.)]\s+') THEN 'ordered' WHEN starts_with(x, '! ') THEN 'caption' WHEN starts_with(x, '## ') THEN 'marked' ELSE 'prose' END AS kind FROM l)
    SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL""",
}
