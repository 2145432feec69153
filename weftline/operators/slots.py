"""Image slots of decks: which slides get one, from what it is resolved, and the records around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import maths
from weftline.functions import text as t

#: Block types of a template, how many it may have, and the flavour of content without one.
BLOCK_TYPES, MOST_BLOCKS, FLAVOUR = ("cover", "outline", "content", "image", "end"), 6, "theory"
TEMPLATE = "struct<slide_order:array<struct<type:string,title:string,flavor:string>>>"


def plain_points(bullets: Column) -> Column:
    """Bullets with text that are no bold lines."""
    return F.filter(bullets, lambda b: (F.trim(b) != "") & ~b.startswith("**"))


def image_slots(content: DataFrame, requests: DataFrame, visuals: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(request_id, pos, keywords, points, promote, caption): the slides that get an image.

    content: request_id, pos, title, subtitle, bullets; requests: request_id, image_slides; visuals: a
    visual plan (request_id, idx, kind, query, caption). Slots are spread over the deck, or are the
    ``preferred`` slides (request_id, pos) of decks that have some; slides planned as a flow or
    diagram get one besides and take a slide of their own. A planned query names the image, else
    the slide's words.
    """
    r = content.groupBy("request_id").agg(F.count("*").cast("int").alias("n")).join(requests.select("request_id", "image_slides"), "request_id")
    spread = r.select("request_id", F.explode(maths.spread(F.col("n"), F.col("image_slides"))).alias("pos"))
    if preferred is not None:
        spread = spread.join(preferred.select("request_id").distinct(), "request_id", "left_anti").unionByName(preferred.select("request_id", "pos"))
    plan = visuals.select("request_id", F.col("idx").alias("pos"), "kind", "query", F.col("caption").alias("told"))
    both = content.join(plan, ["request_id", "pos"], "left").join(spread.withColumn("asked", F.lit(True)), ["request_id", "pos"], "left")
    drawn = F.coalesce(F.col("kind").isin("flow", "diagram"), F.lit(False))
    points = plain_points(F.col("bullets"))
    words = F.when(F.coalesce("query", F.lit("")) != "", F.array("query")).otherwise(t.image_keywords(F.col("title"), F.array_join(points, " ")))
    out = both.where(F.coalesce("asked", F.lit(False)) | drawn)
    return out.select("request_id", "pos", words.alias("keywords"), F.slice(points, 1, 4).alias("points"), drawn.alias("promote"), F.when(drawn, F.coalesce("told", "subtitle")).alias("caption"))


def without_caption(bullets: Column, caption: Column) -> Column:
    """Bullets but those that only repeat the caption, if any others are left."""
    def of(key: Column) -> Column:
        kept = F.filter(bullets, lambda b: t.caption_key(b) != key)
        return F.when((key != "") & (F.size(kept) > 0), kept).otherwise(bullets)

    return t.let(t.caption_key(caption), of)


def image_spec(title: Column, bullets: Column, keywords: Column, points: Column, wants: Column, local: Column) -> Column:
    """struct(keyword, points) of the image that a slide has to fetch; null if it wants none, has a local one or no word to search for."""
    def of(words: Column) -> Column:
        own = F.when(F.coalesce(F.size(points), F.lit(0)) > 0, points).otherwise(plain_points(bullets))
        return F.when(wants & ~local & (words != ""), F.struct(words.alias("keyword"), own.alias("points")))

    named = F.slice(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[a-zA-Z]{3,}"), F.lit(0)), 1, 3)
    return t.let(F.trim(F.array_join(F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, keywords).otherwise(named), " ")), of)


def resolved_images(specs: DataFrame, cache: DataFrame, photos: DataFrame) -> DataFrame:
    """specs with ``image`` and ``origin``: from the cache, else drawn where a diagram is planned, else a photo, else drawn.

    specs: key, keyword, diagram (null without one); cache: key, image; photos: keyword, image. One
    lookup join for each table, and no call to any service.
    """
    hit = cache.groupBy("key").agg(F.max("image").alias("cached"))
    photo = photos.groupBy("keyword").agg(F.min("image").alias("photo"))
    both = specs.join(hit, "key", "left").join(photo, "keyword", "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("diagram").isNotNull(), "diagram").when(F.col("photo").isNotNull(), "photo").otherwise("drawn")
    drawn = F.concat(F.lit("drawn:"), F.coalesce("diagram", "keyword"))
    return both.withColumn("origin", origin).withColumn("image", F.coalesce("cached", F.when(F.col("diagram").isNull(), F.col("photo")), drawn)).drop("cached", "photo")


def template_blocks(json: Column) -> Column:
    """The blocks of a template: known types only, six at most, content with a flavour, and titles for all."""
    title = lambda b: F.coalesce(F.nullif(b["title"], F.lit("")), F.when(b["type"] == "end", "Thank You").otherwise("New Section"))
    flavour = lambda b: F.coalesce(F.nullif(b["flavor"], F.lit("")), F.when(b["type"] == "content", FLAVOUR))
    known = F.filter(F.from_json(json, TEMPLATE)["slide_order"], lambda b: F.coalesce(b["type"], F.lit("")).isin(*BLOCK_TYPES))
    return F.slice(F.transform(known, lambda b: F.struct(b["type"].alias("type"), title(b).alias("title"), flavour(b).alias("flavour"))), 1, MOST_BLOCKS)


def served_plans(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The newest plan of each digest, if it is not empty and not older than ``seconds``; an empty one hides older ones and is never served.

    cache: digest, at, plan.
    """
    w = Window.partitionBy("digest").orderBy(F.desc("at"), "plan")
    last = cache.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return last.where((F.coalesce("plan", F.lit("")) != "") & (age <= seconds * 1_000_000))


def search_text(section: Column, caption: Column) -> Column:
    """What a figure is matched by."""
    return F.trim(F.concat_ws(" ", F.nullif(section, F.lit("")), F.nullif(caption, F.lit(""))))


def page_labels(lines: DataFrame) -> DataFrame:
    """(doc_id, page, label): the first number, arabic or roman, of 8 characters at most that is printed in the lowest tenth of a page.

    lines: doc_id, page, pos, y1, height, text.
    """
    label = t.squeeze("text")
    ok = (F.length(label) <= 8) & (F.col("y1") > F.col("height") * 0.9) & (label.rlike("^[0-9]+$") | label.rlike("(?i)^[ivxlcdm]{1,7}$"))
    return lines.where(ok).groupBy("doc_id", "page").agg(F.min_by(label, "pos").alias("label"))


def front_matter(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with ``front``: true until the first heading that neither labels front matter, nor is an entry of contents, nor a title.

    paragraphs: doc_id, pos, style, text; a heading is told by its style or its number.
    """
    text = F.col("text")
    heading = F.col("style").rlike("^(?:Heading [1-9]|Title|Subtitle)$") | t.is_numbered_heading(text)
    ends = heading & ~t.touches_front_matter(text) & ~t.is_contents_line(text) & ~F.col("style").isin("Title", "Subtitle")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paragraphs.withColumn("front", ~F.coalesce(F.bool_or(ends).over(w), F.lit(False)))
