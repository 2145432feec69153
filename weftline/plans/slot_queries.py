"""Queries of image slots, templates, labels and the smaller look-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import maths
from weftline.functions import text as t
from weftline.operators import catalog, deck, matching, slots
from weftline.plans.inputs import table
from weftline.sources import sinks


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as decks: a slide for each turn, numbered from 0."""
    c = table(spark, sf_dir, "conversations")
    pos = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int")
    return c.select(F.col("conv_id").alias("request_id"), pos.alias("pos"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), F.col("role").alias("subtitle"), F.array("text").alias("bullets"))


def image_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images for each conversation; every third slide is planned, as a flow for the user's turns."""
    content = _turns(spark, sf_dir)
    planned = content.where("pos % 3 = 1").select("request_id", F.col("pos").alias("idx"), F.when(F.col("subtitle") == "user", "flow").otherwise("photo").alias("kind"), F.concat(F.lit("query "), F.col("pos").cast("string")).alias("query"), F.lit(None).cast("string").alias("caption"))
    asked = content.select("request_id", F.lit(2).alias("image_slides")).distinct()
    out = slots.image_slots(content, asked, planned)
    return out.select("request_id", "pos", F.array_join("keywords", " ").alias("keywords"), F.size("points").alias("n_points"), "promote", "caption")


def preferred_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest turns of a conversation as slides with the largest affinity."""
    rows = _turns(spark, sf_dir).select("request_id", "pos", F.length(F.col("bullets")[0]).alias("affinity"))
    return matching.top_slides(rows, 2)


def earlier_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are like an earlier one of their conversation, by a threshold that some of them pass."""
    return matching.earlier_duplicates(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 0.25)


def caption_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as the caption of a slide that holds all its lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return d.select("doc_id", F.size(slots.without_caption(F.col("lines"), F.col("lines")[0])).alias("n_left"), t.caption_key(F.col("lines")[0]).alias("key"))


def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", t.heading_key(F.concat((F.col("item_id") % 9).cast("string"), F.lit(". "), F.col("text"))).alias("key"))


def image_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    none, k = F.array().cast("array<string>"), F.col("p_partkey")
    spec = slots.image_spec(F.col("p_name"), F.array("p_type", F.concat(F.lit("**"), "p_brand"), F.lit(" ")), F.when(k % 2 == 0, F.array("p_brand", "p_type")).otherwise(none), F.when(k % 3 == 0, F.array("p_name")).otherwise(none), k % 5 != 0, k % 7 == 0)
    return p.select("p_partkey", spec.alias("s")).select("p_partkey", "s.keyword", F.array_join("s.points", ";").alias("points"))


def resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    specs = p.select(k.alias("key"), F.col("p_type").alias("keyword"), F.when(k % 4 == 0, F.concat(F.lit("steps of "), "p_name")).alias("diagram"))
    cache = p.where(k % 5 == 0).select(k.alias("key"), F.concat(F.lit("cached "), k.cast("string")).alias("image"))
    photos = p.where(k % 50 == 1).select(F.col("p_type").alias("keyword"), F.concat(F.lit("photo "), F.lpad(k.cast("string"), 9, "0")).alias("image"))
    return slots.resolved_images(specs, cache, photos).select("key", "origin", "image")


def template_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as templates: a block for each line, its type by the line's number; 'chart' is no known type."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("cover", "outline", "content", "chart", "content", "image", "end"))), F.col("l_linenumber").cast("int"))
    block = F.struct(kind.alias("type"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("title"), F.when(F.col("l_returnflag") == "R", "practical").alias("flavor"))
    by = li.where("l_linenumber <= 7").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", block.alias("b")))).alias("s"))
    json = by.select("l_orderkey", F.to_json(F.struct(F.transform("s", lambda x: x["b"]).alias("slide_order"))).alias("template_json"))
    out = json.select("l_orderkey", F.posexplode(slots.template_blocks(F.col("template_json"))).alias("pos", "b"))
    return out.select("l_orderkey", "pos", "b.type", "b.title", "b.flavour")


def served_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries of their user; views left an empty plan; served at the end of the last day for a week."""
    e = table(spark, sf_dir, "events")
    cache = e.select(F.col("user_id").alias("digest"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("plan "), F.lpad(F.col("event_id").cast("string"), 12, "0"))).alias("plan"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return slots.served_plans(cache, now, 7 * 86400).select("digest", "plan")


def figure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    section = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    record = F.to_json(F.struct(F.col("p_name").alias("caption"), F.lit("figure").alias("kind"), (F.col("p_size") % 10).cast("int").alias("page"), section.alias("section")))
    return p.select("p_partkey", slots.search_text(section, F.col("p_name")).alias("search"), record.alias("record"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as lines on the pages of its document."""
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")).when(F.col("l_partkey") % 3 == 1, F.element_at(F.array(F.lit("ii"), F.lit("XIV"), F.lit("m")), (F.col("l_suppkey") % 3 + 1).cast("int"))).otherwise("page 3")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), (700 + F.col("l_quantity") * 2).cast("double").alias("y1"), F.lit(800.0).alias("height"), text.alias("text"))
    return slots.page_labels(rows)


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs; every fourth is styled as a heading, and the second says Contents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    p = d.select("doc_id", "pos", F.when(F.col("pos") == 0, "Title").when((F.col("pos") == 1) | (F.col("pos") % 4 == 3), "Heading 1").otherwise("Normal").alias("style"), F.when(F.col("pos") == 1, "Contents").otherwise(F.col("text")).alias("text"))
    return slots.front_matter(p).groupBy("doc_id").agg(F.count_if("front").alias("n_front"))


def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x, y, q = (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 800).cast("double"), F.col("l_quantity").cast("double")
    box = maths.padded(x, y, x + q, y + q, 12.0, F.lit(612.0), F.lit(792.0))
    out = li.select("l_orderkey", box.alias("b"))
    return out.groupBy("l_orderkey").agg(F.round(F.sum(maths.rect_area(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"))), 3).alias("area"), F.round(F.max("b.x1"), 3).alias("right"))


def clean_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(t.preserve_structure(F.col("text"))).alias("kept_md5"), F.md5(t.strict_clean(F.col("text"))).alias("strict_md5"), t.clean_point(F.col("text")).alias("point"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.iso_time(F.col("ts")).alias("at"))


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    pages = F.ceil(F.size("lines") / 40)
    return d.select("doc_id", t.document_summary(pages, F.col("text"), F.col("lines")[0], F.size(F.filter("lines", lambda x: x.rlike("[0-9]")))).alias("summary"))


def image_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = sinks.image_encoding(F.col("l_partkey") % 3000, F.col("l_suppkey") % 2000 * 20, F.col("l_orderkey") * 1000 % 10_000_000, F.col("l_returnflag") == "R")
    return li.groupBy("l_returnflag", kind.alias("encoding")).agg(F.count("*").alias("n"))


def table_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the rows of a table."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").withColumn("n", first).where("n <= 8")  # what a preview can show, before anything is gathered
    cells = F.array(*(F.col("event_id").cast("string") for _ in range(7)))
    by = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", cells.alias("c")))).alias("s"))
    shown = sinks.table_preview(F.transform("s", lambda x: x["c"]))
    return by.select("user_id", F.array_join(F.transform(shown, lambda r: F.array_join(r, "|")), "\n").alias("preview"))


def provider_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", (F.col("s_suppkey") % 7).cast("int").alias("priority"), F.when(F.col("s_suppkey") % 3 > 0, F.repeat(F.lit("k"), (F.col("s_suppkey") % 3 - 1).cast("int"))).alias("api_key"))
    return catalog.redacted(s)


def admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    role = F.element_at(F.array(F.lit("admin"), F.lit("user"), F.lit("admin1"), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", catalog.is_admin(role, F.when(F.col("c_custkey") % 5 < 4, F.col("c_custkey") % 5 == 0)).alias("admin"))


def seeded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions, which stay as they are, and an empty table of them, which gets the default row."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    one = spark.createDataFrame([(99, "DEFAULT")], "r_regionkey int, r_name string").select(F.col("r_regionkey").cast(r.schema["r_regionkey"].dataType).alias("r_regionkey"), "r_name")
    return catalog.seeded(r, one).unionByName(catalog.seeded(r.where("r_name = ''"), one))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", maths.back_off(F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 90).cast("double")), (F.col("event_id") % 7).cast("double")).alias("wait"))


def notes_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", deck.notes_text(deck.speaker_notes(F.col("p_name"))).alias("notes"))


def image_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as images on the pages of their supplier's document; each content counts twice at most."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("sha1"), (F.col("l_orderkey") % 50).alias("page"), F.col("l_quantity").alias("y0"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"))
    return matching.at_most_twice(li).groupBy("doc_id").agg(F.count("*").alias("n"))


QUERIES = [
    image_slots, preferred_slides, earlier_duplicates, caption_bullets, heading_keys, image_specs, resolved_images, template_blocks, served_plans, figure_records, page_labels, front_matter, padded_boxes,
    clean_inputs, iso_times, document_summaries, image_encodings, table_previews, provider_listing, admins, seeded_regions, retry_waits, notes_texts, image_uses,
]


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: All but white space of any kind, and runs of it.
_GAP = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_STOP = _list(lex.MATCH_STOPWORDS)
_FRONT = _list(lex.FRONT_MATTER)


def _words(x: str) -> str:
    return rf"len(regexp_extract_all(coalesce({x}, ''), '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+'))"


def _subject_sql(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9\-]{{2,}}'), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w))"


def tokens_sql(x: str) -> str:
    """Distinct subject words of an SQL text."""
    return f"list_distinct({_subject_sql(x)})"


def keywords_sql(x: str) -> str:
    """The first three subject words of an SQL text, in order and once each, else 'presentation'."""
    found = _subject_sql(x)
    return rf"(SELECT CASE WHEN len(f) = 0 THEN 'presentation' ELSE array_to_string(list_filter(f, lambda w, i: list_position(f, w) = i)[1:3], ' ') END FROM (SELECT {found} AS f))"


_TURNS = "c AS (SELECT conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, 'Turn ' || turn AS title, role, text FROM conversations)"
SQL = {
    "image_slots": f"""WITH {_TURNS}, n AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM c), s AS (SELECT *, pos IN (0, least(n - 1, round_even(n / 2.0::DOUBLE, 0))) AS asked, pos % 3 = 1 AS planned FROM n)
    SELECT request_id, pos, CASE WHEN planned THEN 'query ' || pos ELSE {keywords_sql("concat_ws(' ', title, CASE WHEN trim(text) <> '' AND NOT starts_with(text, '**') THEN text ELSE '' END)")} END AS keywords,
    CAST(coalesce(trim(text) <> '' AND NOT starts_with(text, '**'), false) AS INTEGER) AS n_points, planned AND role = 'user' AS promote, CASE WHEN planned AND role = 'user' THEN role END AS caption FROM s WHERE asked OR (planned AND role = 'user')""",
    "preferred_slides": f"WITH {_TURNS} SELECT request_id, pos, CAST(length(text) AS INTEGER) AS affinity FROM c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY affinity DESC, pos) <= 2",
    # DuckDB's edit distance counts bytes, so each accented letter first becomes one control character
    "earlier_duplicates": """WITH m AS (SELECT string_agg(chr(i), '' ORDER BY i) AS k FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17, 18, 19, 20, 21, 22]) AS i)),
    c AS (SELECT conv_id, turn, translate(lower(text), 'äöüßéèêçíñóàáúôîâ', k) AS t FROM conversations, m)
    SELECT DISTINCT a.conv_id, a.turn FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE greatest(0.0, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t), 1)::DOUBLE) > 0.25""",
    "caption_bullets": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
    k AS (SELECT doc_id, list_transform(p, lambda x: array_to_string(list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda w: NOT list_contains({_list(lex.CAPTION_LABELS)}, w) AND NOT regexp_matches(w, '^[0-9]+$')), ' ')) AS k FROM l)
    SELECT doc_id, CAST(CASE WHEN k[1] <> '' AND len(list_filter(k, lambda x: x <> k[1])) > 0 THEN len(list_filter(k, lambda x: x <> k[1])) ELSE len(k) END AS INTEGER) AS n_left, k[1] AS key FROM k""",
    "heading_keys": rf"""WITH h AS (SELECT item_id, item_id % 9 || '. ' || text AS x FROM benchmark), c AS (SELECT item_id, regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:\d+(?:\.\d+)*[.)]?|[IVXLC]+[.)])\s*', ''), '\s*[:–—-]\s*.*$', '', 'g'), '\s*\([^)]*\)', '', 'g') AS x FROM h)
    SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda w: NOT list_contains({_list(lex.HEADING_NOISE)}, w)), ' ') AS key FROM c""",
    "image_specs": r"""WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ' || p_type ELSE trim(array_to_string(regexp_extract_all(p_name, '[a-zA-Z]{3,}')[1:3], ' ')) END AS k FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND k <> '' THEN k END AS keyword, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND k <> '' THEN CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END END AS points FROM p""",
    "resolved_images": """WITH f AS (SELECT p_type, min('photo ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS photo FROM part WHERE p_partkey % 50 = 1 GROUP BY ALL)
    SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'cache' WHEN p_partkey % 4 = 0 THEN 'diagram' WHEN photo IS NOT NULL THEN 'photo' ELSE 'drawn' END AS origin,
    CASE WHEN p_partkey % 5 = 0 THEN 'cached ' || p_partkey WHEN p_partkey % 4 = 0 THEN 'drawn:steps of ' || p_name WHEN photo IS NOT NULL THEN photo ELSE 'drawn:' || p_type END AS image FROM part LEFT JOIN f USING (p_type)""",
    "template_blocks": """WITH b AS (SELECT l_orderkey, l_linenumber, ['cover', 'outline', 'content', 'chart', 'content', 'image', 'end'][l_linenumber] AS type, CASE WHEN l_quantity > 25 THEN 'Part ' || l_partkey END AS title, CASE WHEN l_returnflag = 'R' THEN 'practical' END AS flavor FROM lineitem WHERE l_linenumber <= 7),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, type, title NULLS FIRST, flavor NULLS FIRST) - 1 AS INTEGER) AS pos FROM b WHERE type <> 'chart')
    SELECT l_orderkey, pos, type, coalesce(title, CASE WHEN type = 'end' THEN 'Thank You' ELSE 'New Section' END) AS title, coalesce(flavor, CASE WHEN type = 'content' THEN 'theory' END) AS flavour FROM n WHERE pos < 6""",
    "served_plans": """WITH c AS (SELECT user_id AS digest, ts, CASE WHEN event_type = 'view' THEN '' ELSE 'plan ' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS plan FROM events),
    l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY digest ORDER BY ts DESC, plan) = 1) SELECT digest, plan FROM l WHERE plan <> '' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 604800000000""",
    "figure_records": """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS section FROM part)
    SELECT p_partkey, trim(section || ' ' || p_name) AS search, '{"caption":"' || p_name || '","kind":"figure","page":' || p_size % 10 || ',"section":"' || section || '"}' AS record FROM p""",
    "page_labels": """WITH l AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS page, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) WHEN l_partkey % 3 = 1 THEN ['ii', 'XIV', 'm'][l_suppkey % 3 + 1] ELSE 'page 3' END AS label FROM lineitem)
    SELECT doc_id, page, label FROM l WHERE 700 + l_quantity * 2 > 720 AND label <> 'page 3' AND length(label) <= 8 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""",
    "front_matter": rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS pos, unnest(p) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
    s AS (SELECT doc_id, pos, CASE WHEN pos = 1 THEN 'Contents' ELSE x END AS x FROM l),
    k AS (SELECT *, rtrim(lower(trim(regexp_replace(replace(x, chr(173), ''), '{_GAP}+', ' ', 'g'))), '.:') AS low, regexp_extract(x, '^\s*(\d{{1,2}}(?:\.\d{{1,2}})*)[.)]?\s+(\S.*)$', 2) AS rest FROM s),
    e AS (SELECT doc_id, pos, (pos = 1 OR pos % 4 = 3 OR regexp_matches(x, '(?i)^\s*(?:chapter|section|part|module|unit|annex)\s+[\dIVXivx]+') OR (rest <> '' AND {_words('rest')} <= 9 AND NOT ends_with(rest, '.'))) AND pos <> 0
    AND NOT (low <> '' AND len(list_filter({_FRONT}, lambda p: low = p OR starts_with(low, p || ' ') OR ends_with(low, p))) > 0)
    AND NOT (regexp_matches(x, '^\s*.+?(?:\.{{2,}}|\s{{2,}}|\s·\s{{2,}}).*?(?:\d{{1,4}})\s*$') OR regexp_matches(trim(x), '(?i)^\s*[ivxlcdm]{{1,7}}\s*$')) AS ends FROM k)
    SELECT doc_id, CAST(coalesce(min(CASE WHEN ends THEN pos END), count(*)) AS BIGINT) AS n_front FROM e GROUP BY doc_id""",
    "padded_boxes": """WITH b AS (SELECT l_orderkey, greatest(0.0, l_partkey % 600 - 12.0::DOUBLE) AS x0, greatest(0.0, l_suppkey % 800 - 12.0::DOUBLE) AS y0, least(612.0::DOUBLE, l_partkey % 600 + l_quantity::DOUBLE + 12.0) AS x1, least(792.0::DOUBLE, l_suppkey % 800 + l_quantity::DOUBLE + 12.0) AS y1 FROM lineitem)
    SELECT l_orderkey, round(sum(greatest(0.0::DOUBLE, x1 - x0) * greatest(0.0::DOUBLE, y1 - y0)), 3) AS area, round(max(x1), 3) AS "right" FROM b GROUP BY ALL""",
    "clean_inputs": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'))) AS kept_md5,
    md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9\s@\x0b]', '', 'g'), '[\s\x0b]+', ' ', 'g'))) AS strict_md5,
    coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\*\*(.*?)\*\*', '\1', 'g'), '[_\-]{2,}', ' ', 'g')), ''), 'Key information point') AS point FROM documents""",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END AS at FROM events",
    "document_summaries": f"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
    SELECT doc_id, CAST(ceil(len(p) / 40.0) AS INTEGER) || ' pages, ' || {_words('text')} || ' words of body text, ' || {_words('p[1]')} || ' words of front matter, ' || len(list_filter(p, lambda x: regexp_matches(x, '[0-9]'))) || ' visuals' AS summary FROM d""",
    "image_encodings": """WITH i AS (SELECT l_returnflag, l_partkey % 3000 AS w, l_suppkey % 2000 * 20 AS h, l_orderkey * 1000 % 10000000 AS b FROM lineitem)
    SELECT l_returnflag, CASE WHEN w < 8 OR h < 8 OR b > 8388608 THEN NULL WHEN w * h > 1500000 AND l_returnflag <> 'R' THEN 'jpeg' WHEN b > 2500000 THEN 'jpeg' ELSE 'png' END AS encoding, count(*) AS n FROM i GROUP BY ALL""",
    "table_previews": """WITH e AS (SELECT user_id, event_id, array_to_string([event_id, event_id, event_id, event_id, event_id], '|') AS r FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8)
    SELECT user_id, string_agg(r, chr(10) ORDER BY event_id) AS preview FROM e GROUP BY user_id""",
    "provider_listing": "SELECT s_suppkey AS id, s_name, CAST(s_suppkey % 7 AS INTEGER) AS priority, s_suppkey % 3 = 2 AS has_api_key FROM supplier",
    "admins": "SELECT c_custkey, c_custkey % 5 = 0 OR c_custkey % 4 IN (0, 2) AS admin FROM customer",
    "seeded_regions": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'DEFAULT'",
    "retry_waits": "SELECT event_id, least(CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 AS DOUBLE) ELSE pow(2.0, event_id % 7) END, 30.0) AS wait FROM events",
    "notes_texts": """SELECT p_partkey, 'Our next topic is: ' || p_name || chr(10) || '- Highlight the key concepts on this slide' || chr(10) || '- Connect the ideas to a real-world example' || chr(10) || '- Invite audience input or questions' || chr(10)
    || 'Feel free to ask questions about this topic' || chr(10) || 'Remember: ' || p_name || ' is important' || chr(10) || 'Let''s continue with the next point.' AS notes FROM part""",
    "image_uses": "WITH i AS (SELECT l_suppkey AS doc_id, l_partkey % 20 AS k, count(*) AS n FROM lineitem GROUP BY ALL) SELECT doc_id, CAST(sum(least(n, 2)) AS BIGINT) AS n FROM i GROUP BY doc_id",
}
