"""Recorded model responses to slides and visual plans: JSON first, marked blocks next, then redistribution and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as t

MOST_BULLETS = 6


def blocks(raw: Column) -> Column:
    """The slide regions of a text: between markers, else from each SLIDE_NUMBER on, else from each TITLE on."""
    marked = F.regexp_extract_all(raw, F.lit("(?s)<<<START_SLIDE>>>(.*?)<<<END_SLIDE>>>"), F.lit(1))
    numbered = F.filter(F.split(raw, "(?m)(?=^\\s*SLIDE_NUMBER:)"), lambda p: p.rlike("(?m)^\\s*SLIDE_NUMBER:"))
    titled = F.filter(F.split(raw, "(?m)(?=^\\s*TITLE:)"), lambda p: p.rlike("(?m)^\\s*TITLE:"))
    return F.when(F.size(marked) > 0, marked).when(F.size(numbered) > 0, numbered).otherwise(titled)


def block_slide(block: Column) -> Column:
    """One region to a struct(title, bullets, type)."""
    field = lambda name: F.trim(F.regexp_extract(block, f"(?m)^\\s*{name}:\\s*(.*)$", 1))
    bullets = F.transform(F.regexp_extract_all(block, F.lit("(?m)^\\s*[-•*]\\s+(.+)$"), F.lit(1)), F.trim)
    kind = F.lower(field("TYPE"))
    return F.struct(field("TITLE").alias("title"), F.slice(F.filter(bullets, lambda b: b != ""), 1, MOST_BULLETS).alias("bullets"), F.when(kind.isin("theory", "practical"), kind).otherwise("theory").alias("type"))


def _said(x: Column) -> Column:
    """A VARIANT as text: strings as they are, numbers as digits, null and truth values by name, arrays and objects as JSON."""
    text = F.try_variant_get(x, "$", "string")
    return F.when(F.is_variant_null(x), "None").when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(text)).otherwise(text)


def json_slides(body: Column) -> Column:
    """The slides of a JSON list, null where the text is no list: keys may lack, and values of any kind are taken as text.

    Items that are no objects are left out, but count in the numbers of slides without a title.
    Bullets that are no list are one bullet; MOST_BULLETS of them stay; an unknown type is theory.
    """
    listed = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    get = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")

    def slide(x: Column, i: Column) -> Column:
        many = F.try_variant_get(x, "$.bullets", "array<variant>")
        bullets = F.when(get(x, "bullets").isNull(), F.array().cast("array<string>")).when(many.isNotNull(), F.transform(F.slice(many, 1, MOST_BULLETS), _said)).otherwise(F.array(_said(get(x, "bullets"))))
        kind = F.lower(_said(get(x, "type")))
        title = F.when(get(x, "title").isNull(), F.concat(F.lit("Slide "), (i + 1).cast("string"))).otherwise(_said(get(x, "title")))
        whole = F.struct(title.alias("title"), bullets.alias("bullets"), F.when(kind.isin("theory", "practical"), kind).otherwise("theory").alias("type"))
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), whole)

    return F.filter(F.transform(listed, slide), lambda s: s.isNotNull())


def parsed(responses: DataFrame) -> DataFrame:
    """(prompt_hash, requested, slides): a JSON list of slides, else the text's blocks; six bullets, unknown types as theory."""
    slides = F.coalesce(json_slides(t.strip_fences(F.col("raw"))), F.transform(blocks(F.col("raw")), block_slide))
    return responses.select("prompt_hash", "requested", slides.alias("slides"))


def sections(slides: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, section_no, heading, type, points): model slides as sections for the planner; slides without a bullet are left out.

    slides: the key, and slides as ``parsed`` and ``normalised_count`` give them. The model does not
    decide how many slides a deck has: the planner plans them again.
    """
    s = slides.select(key, F.posexplode("slides").alias("at", "s"))
    points = F.filter("s.bullets", lambda b: F.regexp_replace(b, "(?U)\\s", "") != "")
    title = F.coalesce(F.nullif("s.title", F.lit("")), F.concat(F.lit("Section "), (F.col("at") + 1).cast("string")))
    return s.withColumn("points", points).where(F.size("points") > 0).select(key, (F.col("at") + 1).alias("section_no"), t.clean_title(title).alias("heading"), F.col("s.type").alias("type"), "points")


def redistributed(points: Column, parts: Column) -> Column:
    """Points over exactly ``parts`` runs, the first ones longer by one where they do not divide."""
    n = F.size(points)
    at = lambda i: i * F.floor(n / parts) + F.least(i.cast("bigint"), n % parts)
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(points, (at(i) + 1).cast("int"), (at(i + 1) - at(i)).cast("int")))


def normalised_count(rows: DataFrame) -> DataFrame:
    """Exactly ``requested`` slides: cut, or all bullets redistributed if there are two for each, else padded with takeaways."""
    s, k = F.col("slides"), F.col("requested")
    bullets = F.flatten(F.transform(s, lambda x: x["bullets"]))
    runs = redistributed(bullets, k)
    title = lambda i: F.coalesce(F.get(s, i)["title"], F.concat(F.get(s, F.size(s) - 1)["title"], F.lit(" (part "), (i - F.size(s) + 2).cast("string"), F.lit(")")))
    spread = F.transform(runs, lambda b, i: F.struct(title(i).alias("title"), b.alias("bullets"), F.coalesce(F.get(s, i)["type"], F.get(s, F.size(s) - 1)["type"]).alias("type")))
    pad = F.transform(F.sequence(F.size(s) + 1, k), lambda i: F.struct(F.concat(F.lit("Key Takeaway "), i.cast("string")).alias("title"), F.array(F.lit("Summary point")).alias("bullets"), F.lit("theory").alias("type")))
    out = F.when(F.size(s) >= k, F.slice(s, F.lit(1), k)).when((F.size(s) > 0) & (F.size(bullets) >= 2 * k), spread).otherwise(F.concat(s, pad))
    return rows.withColumn("slides", out)


VISUALS = "array<struct<index:int,kind:string,query:string,caption:string,title:string,steps:array<string>,points:array<string>>>"


def visual_plan(responses: DataFrame) -> DataFrame:
    """(request_id, idx, kind, query, caption, flow_title, steps, points): valid entries, the last of an index.

    responses: request_id, raw, n_slides. Indices outside the deck, unknown kinds, flows of fewer
    than two steps and diagrams without points go.
    """
    body = t.strip_fences(F.col("raw"))
    rows = responses.select("request_id", "n_slides", F.posexplode(F.from_json(body, VISUALS)).alias("at", "v"))
    cut = lambda c, n, most: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.substring(t.squeeze(x), 1, n)), lambda x: x != ""), 1, most)
    rows = rows.select("request_id", "n_slides", "at", F.col("v.index").alias("idx"), F.lower("v.kind").alias("kind"), F.substring(t.squeeze("v.query"), 1, 80).alias("query"), "v.caption", F.col("v.title").alias("flow_title"), cut(F.col("v.steps"), 90, 6).alias("steps"), cut(F.col("v.points"), 90, 4).alias("points"))
    ok = (F.col("idx") >= 0) & (F.col("idx") < F.col("n_slides")) & ((F.col("kind") == "photo") & (F.col("query") != "") | (F.col("kind") == "flow") & (F.size("steps") >= 2) | (F.col("kind") == "diagram") & ((F.size("points") > 0) | (F.size("steps") >= 2)))
    last = Window.partitionBy("request_id", "idx").orderBy(F.desc("at"))
    return rows.where(ok).withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "at", "n_slides")


def quota_exhausted(body: Column) -> Column:
    """Whether an error body names a violated daily quota."""
    details = F.from_json(F.get_json_object(body, "$.error.details"), "array<struct<violations:array<struct<quotaId:string>>>>")
    return F.coalesce(F.exists(details, lambda d: F.exists(F.coalesce(d["violations"], F.array().cast("array<struct<quotaId:string>>")), lambda v: v["quotaId"].contains("PerDay"))), F.lit(False))


def first_answer(*providers: Column) -> Column:
    """Failover over precomputed provider answers: the first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(p) != "", p) for p in providers))


def spaced(calls: DataFrame, gap: float = 3.5, span: float = 3600.0) -> DataFrame:
    """Start times of calls (key, at in seconds) that keep ``gap`` seconds from the one before: max over earlier of at + gap * steps.

    A key may hold a third of all calls, so its calls are dealt by spans of ``span`` seconds: how
    many calls and what greatest lead come before a span is a running sum and maximum over one
    small row a key and span; the rest is done inside the spans. Any ``span`` gives the same times.
    Calls without a time come first and start at null; a null key is a key.
    """
    # structs of keys compare nulls as equal, so that joins and windows share one partitioning
    cell = ["_key", "_span"]
    c = calls.withColumn("_key", F.struct("key")).withColumn("_span", F.struct(F.floor(F.col("at") / span).alias("s")))
    inside = Window.partitionBy(*cell).orderBy("at", "id")
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = c.groupBy(*cell).agg(F.count("*").alias("_n"))
    counts = counts.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    c = c.join(counts, cell).withColumn("_n", F.col("_base") + F.row_number().over(inside)).withColumn("_lead", F.col("at") - F.col("_n") * gap)
    tops = c.groupBy(*cell).agg(F.max("_lead").alias("_top")).select(*cell, F.max("_top").over(before).alias("_carry"))
    held = F.greatest("_carry", F.max("_lead").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return c.join(tops, cell).withColumn("start", held + F.col("_n") * gap).select(*calls.columns, "start")


def keyed(prompts: DataFrame) -> DataFrame:
    """Prompts with their cache key; the first of equal keys stands for all."""
    key = F.sha2(F.concat_ws("\u0001", "prompt", F.col("requested").cast("string")), 256)
    return prompts.withColumn("prompt_hash", key).dropDuplicates(["prompt_hash"])


