"""Planned slides to decks: content slides, outline pages, recap, cover and end, promotion and numbering."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import text as t


def _lookup(table: dict, key: Column) -> Column:
    """The entry of a fixed table, null for an unknown key."""
    one = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit("|".join(k) if isinstance(k, tuple) else k), one(v)) for k, v in table.items())).getItem(key)


def content_slides(planned: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, pos, title, subtitle, type, bullets, notes): refined slides; fillers only where no bullet is left."""
    r = planned.join(requests.select("request_id", "audience_level"), "request_id")
    # what is blank when trimmed is null when refined
    refined = F.filter(F.transform("bullets", t.refine_bullet), lambda b: b.isNotNull())
    level = F.when(F.col("audience_level").isin(*lex.COVER_LINES), F.col("audience_level")).otherwise("Intermediate")
    key = F.concat_ws("|", "type", level)
    r = r.where(F.exists("bullets", lambda b: F.trim(b) != "")).withColumn("lines", refined)
    generic = F.when(F.col("audience_level").isin(*lex.COVER_LINES), _lookup(lex.SUBTITLES, key)).when(F.col("type") == "practical", "Practical Implementation").otherwise("Key Concepts")
    r = r.withColumn("title", t.clean_title(t.clean_title(F.col("title"))))  # the cut to eight words may leave a mark at the end
    return r.select(
        "request_id", "pos", "title", F.coalesce(t.some(t.squeeze("subtitle")), generic).alias("subtitle"), "type",
        F.when(F.size("lines") > 0, F.col("lines")).otherwise(_lookup(lex.FILLERS, key)).alias("bullets"), speaker_notes(F.col("title")).alias("notes"),
    )


def speaker_notes(title: Column) -> Column:
    """The default notes of a slide."""
    points = ["Highlight the key concepts on this slide", "Connect the ideas to a real-world example", "Invite audience input or questions"]
    return F.struct(
        F.concat(F.lit("Our next topic is: "), title).alias("opening_remarks"), F.array(*map(F.lit, points)).alias("main_talking_points"), F.lit("Feel free to ask questions about this topic").alias("audience_engagement"),
        F.lit(90).alias("time_estimate"), F.concat(F.lit("Remember: "), title, F.lit(" is important")).alias("key_takeaway"), F.lit("Let's continue with the next point.").alias("transition_to_next"),
    )


def notes_text(notes: Column) -> Column:
    """Notes as one text: opening, three points at most, engagement, takeaway and transition."""
    return F.concat_ws("\n", notes["opening_remarks"], F.array_join(F.transform(F.slice(notes["main_talking_points"], 1, 3), lambda p: F.concat(F.lit("- "), p)), "\n"), notes["audience_engagement"], notes["key_takeaway"], notes["transition_to_next"])


def outline(content: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, page, pages, title, bullets): the outline in pages of OUTLINE_ROWS rows, numbered through.

    A page that would end with an act marker hands it to the next page.
    """
    rows = F.sort_array(F.collect_list(F.struct("pos", "title", "type")))
    c = content.groupBy("request_id").agg(rows.alias("s"))
    r = requests.select("request_id", "title").join(c, "request_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<pos:int,title:string,type:string>>")))
    topic = lambda x, i: F.concat((i + 2).cast("string"), F.lit(". "), x["title"], F.when(x["type"] == "theory", " (Theory)").otherwise(" (Practice)"))
    n = F.size("s")
    acts = F.concat(
        F.array(F.lit("**Opening**"), F.concat(F.lit("1. "), t.clean_title(F.col("title")))),
        F.when(n > 0, F.concat(F.array(F.lit("**Core Topics**")), F.transform("s", topic))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("**Closing**"), F.concat((n + 2).cast("string"), F.lit(". Key Takeaways & Next Steps"))),
    )
    items = r.select("request_id", F.posexplode(acts).alias("at", "item"))
    w = Window.partitionBy("request_id").orderBy("at")
    marker = F.col("item").startswith("**") & F.col("item").endswith("**")
    last = (F.col("at") % lex.OUTLINE_ROWS == lex.OUTLINE_ROWS - 1) & F.lead("at").over(w).isNotNull()
    items = items.withColumn("page", (F.floor(F.col("at") / lex.OUTLINE_ROWS) + F.when(last & marker, 1).otherwise(0)).cast("int"))
    pages = items.groupBy("request_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("bullets"))
    pages = pages.withColumn("pages", F.count("*").over(Window.partitionBy("request_id")).cast("int"))
    name = F.when(F.col("page") == 0, "Presentation Outline").otherwise(F.format_string("Presentation Outline (%d/%d)", F.col("page") + 1, "pages"))
    return pages.select("request_id", "page", "pages", name.alias("title"), "bullets")


def recap(content: DataFrame) -> DataFrame:
    """(request_id, bullets): a line for each distinct title, of its first slide, RECAP_LINES at most.

    Only the slides whose lines are shown are looked at for one; the others are counted.
    """
    points = F.reverse(F.filter("bullets", lambda b: (F.trim(b) != "") & ~b.startswith("**")))
    last, own = F.get("points", F.lit(0)), F.filter("points", lambda p: ~p.rlike(lex.GENERIC_TAKEAWAY))
    pick = F.coalesce(F.when(~last.rlike(lex.GENERIC_TAKEAWAY), last), F.get(own, F.lit(0)), last, F.lit("Key point covered in the session."))
    c = content.select("request_id", "pos", t.base_heading(F.col("title")).alias("title"), points.alias("points"))
    c = c.select("request_id", "pos", "title", pick.alias("pick")).repartition("request_id")
    by, first = Window.partitionBy("request_id"), Window.partitionBy("request_id", "title").orderBy("pos")
    c = c.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("n", F.row_number().over(by.orderBy("pos"))).withColumn("all", F.count("*").over(by))
    c = c.where((F.col("n") < lex.RECAP_LINES) | (F.col("n") == F.col("all")))
    c = c.withColumn("line", F.coalesce(t.refine_bullet(F.col("pick")), F.lit("Key information point.")))
    label = F.regexp_extract("line", "^([^:]{3,60}):\\s+", 1)
    own_label = (label != "") & (F.lower(F.trim(label)) == F.lower(F.trim("title")))
    c = c.withColumn("line", F.when(own_label, F.regexp_replace("line", "^[^:]{3,60}:\\s+", "")).otherwise(F.col("line")))
    more = F.concat(F.lit("... and "), (F.col("all") - lex.RECAP_LINES + 1).cast("string"), F.lit(" more key points"))
    entry = F.concat(F.lit("**"), "title", F.lit(":** "), t.shorten_recap(F.col("line")))
    c = c.select("request_id", "pos", F.when(F.col("n") > lex.RECAP_LINES, more).otherwise(entry).alias("entry"))
    return c.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("bullets"))


DECK = ["request_id", "title", "subtitle", "type", "bullets"]


def assemble(content: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, slide_number, title, subtitle, type, bullets): cover, outline, content, recap and end, numbered once.

    requests: request_id, title, subtitle, audience_level, author_name, author_email.
    """
    null = F.lit(None).cast("string")
    signed = F.filter(F.array(F.concat(F.lit("Prepared by "), F.col("author_name")), F.concat(F.lit("Contact: "), F.col("author_email"))), lambda x: x.isNotNull())
    level = F.when(F.col("audience_level").isin(*lex.COVER_LINES), F.col("audience_level")).otherwise("Intermediate")
    part = lambda df, p, pos, title, sub, kind, bullets: df.select("request_id", F.lit(p).alias("part"), F.col(pos).cast("int").alias("pos") if isinstance(pos, str) else F.lit(pos).alias("pos"), title.alias("title"), sub.alias("subtitle"), kind.alias("type"), bullets.alias("bullets"))
    cover = part(requests, 0, 0, t.clean_title(F.col("title")), F.col("subtitle"), F.lit("cover"), F.concat(_lookup(lex.COVER_LINES, level), signed))
    pages = part(outline(content, requests), 1, "page", F.col("title"), null, F.lit("outline"), F.col("bullets"))
    body = part(content, 2, "pos", F.col("title"), F.col("subtitle"), F.col("type"), F.col("bullets"))
    lines = requests.select("request_id").join(recap(content), "request_id", "left")
    none = F.array(F.lit("Summarize the most important ideas covered in this presentation."))
    close = part(lines, 3, 0, F.lit("Key Takeaways"), F.lit("Recap of the main ideas covered in this session"), F.lit("takeaways"), F.coalesce("bullets", none))
    end = part(requests, 4, 0, F.lit("Thank You"), null, F.lit("end"), F.concat(F.array(F.lit("Questions & discussion")), signed))
    rows = cover.unionByName(pages).unionByName(body).unionByName(close).unionByName(end)
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("part", "pos"))
    return rows.select("request_id", number.alias("slide_number"), *DECK[1:])


def deserves_slide(kind: Column, image: Column) -> Column:
    """Whether a slide's visual gets a slide of its own: a diagram, a dense figure of a document, or an infographic that is drawn for its keyword.

    image: struct(url, diagram, promote, local, keyword, generated), where ``local`` tells that the
    file of a document's figure is there and ``generated`` that the keyword's image is drawn. Photos
    and a document's other figures stay beside the text; covers, outlines, ends and images have none.
    """
    told = lambda c: F.coalesce(c, F.lit(False))
    some = told(image["url"] != "") | image["diagram"].isNotNull()
    dense = image["diagram"].isNotNull() | told(image["promote"]) | (~told(image["local"]) & told(F.trim(image["keyword"]) != "") & told(image["generated"]))
    return some & ~kind.isin("cover", "outline", "end", "image") & dense


def promoted(deck: DataFrame, dense: Column, caption: Column | None = None) -> DataFrame:
    """Slides whose ``dense`` holds become two rows: the slide, then its visual alone, under its caption if it has one; renumbered."""
    rows = deck.withColumn("role", F.explode(F.when(dense, F.array(F.lit("content"), F.lit("image"))).otherwise(F.array(F.lit("content")))))
    alone = F.col("role") == "image"
    order = Window.partitionBy("request_id").orderBy("slide_number", "role")
    under = F.coalesce(F.nullif(caption, F.lit("")), F.col("subtitle")) if caption is not None else F.col("subtitle")
    new = {"type": F.when(alone, "image").otherwise(F.col("type")), "bullets": F.when(alone, F.array().cast("array<string>")).otherwise(F.col("bullets")), "subtitle": F.when(alone, under).otherwise(F.col("subtitle"))}
    return rows.withColumns(new).withColumn("slide_number", F.row_number().over(order)).drop("role")


def content_ordinal(deck: DataFrame) -> DataFrame:
    """How many content slides stand before each slide of its deck."""
    w = Window.partitionBy("request_id").orderBy("slide_number").rowsBetween(Window.unboundedPreceding, -1)
    return deck.withColumn("content_index", F.coalesce(F.count_if(~F.col("type").isin("cover", "outline", "takeaways", "end")).over(w), F.lit(0)))


def matched_blocks(deck: DataFrame, blocks: DataFrame) -> DataFrame:
    """The n-th slide of a type takes the n-th template block of that type, over again when they run out; outlines share the first.

    blocks: block_no, type. Rows of either side meet by (type, n).
    """
    slot = Window.partitionBy("request_id", "type").orderBy("slide_number")
    n = F.when(F.col("type") == "outline", F.lit(0)).otherwise(F.row_number().over(slot) - 1)
    b = blocks.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy("block_no")) - 1).withColumn("of", F.count("*").over(Window.partitionBy("type")))
    sizes = b.select("type", "of").distinct()
    d = deck.withColumn("n", n).join(sizes, "type", "left").withColumn("nth", F.col("n") % F.col("of"))
    return d.join(b.select("type", "nth", "block_no"), ["type", "nth"], "left").drop("n", "of", "nth")
