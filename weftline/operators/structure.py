"""Marked lines to titles, metadata and typed sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import text as t

ZONE = 12


def classified(marked: DataFrame) -> DataFrame:
    """Lines with ``following`` (the next one, before any is left out), ``meta``, ``header`` and ``header_alone``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    told = marked.withColumn("following", F.lead("line").over(w)).withColumn("rules", t.header_rules(F.col("line")))
    return told.select(
        "doc_id", "line_no", "line", "following", t.is_metadata(F.col("line")).alias("meta"),
        F.coalesce("rules.told", F.col("rules.titled") & t.leads(F.col("following"))).alias("header"), F.coalesce("rules.told", F.lit(False)).alias("header_alone"),
    )


def metadata(rows: DataFrame) -> DataFrame:
    """(doc_id, author, date): the first author line's name, and the first date in another line."""
    line = t.unmarked(F.col("line"))
    named = F.trim(F.regexp_replace(F.regexp_extract(line, lex.AUTHOR, 1), "^:+|:+$", ""))
    alone = (
        (F.length(line) <= 40) & ~t.is_bullet(line) & (t.n_words(line) >= 1) & (t.n_words(line) <= 4) & line.rlike("(?i)(?:,|prof|dr|mr|mrs|ms|ph\\.?d|md)\\b")
        & line.rlike("^[A-Za-z .'\\-]+(?:,?\\s+(?:PhD|MD|Prof|Dr|MSc|MA|BA|BSc))?$") & ~(line.rlike("\\p{Lu}") & ~line.rlike("\\p{Ll}"))
    )
    author = F.when(line.rlike(lex.AUTHOR), named).when(alone, t.cut_end(line, "."))
    date = F.when(t.has_date(line), F.trim(F.regexp_extract(line, lex.DATE, 0)))
    by = rows.select("doc_id", "line_no", author.alias("author"), date.alias("date"))
    first = F.min(F.when(F.col("author").isNotNull(), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    by = by.withColumn("author_at", first)
    return by.groupBy("doc_id").agg(
        F.min_by("author", F.when(F.col("author").isNotNull(), F.col("line_no"))).alias("author"),
        F.min_by("date", F.when(F.col("date").isNotNull() & (F.coalesce("author_at", F.lit(-1)) != F.col("line_no")), F.col("line_no"))).alias("date"),
    )


def titled(rows: DataFrame) -> DataFrame:
    """(doc_id, title, title_at, subtitle, subtitle_at) from the first ZONE lines; 'Presentation' where none will do."""
    zone = rows.where(F.col("line_no") <= ZONE)
    line = F.col("line")
    long_enough = (t.n_words(line) >= 2) & (t.n_words(line) <= 16) & ~line.endswith(".")
    fit = ~F.col("meta") & ~t.is_bullet(line) & ~t.is_caption(line) & ~line.startswith(lex.HEADING_MARK) & long_enough & line.rlike("^\\p{Lu}")
    zone = zone.withColumn("title_at", F.min(F.when(fit, F.col("line_no"))).over(Window.partitionBy("doc_id")))
    after = (F.col("line_no") > F.col("title_at")) & ~F.col("meta") & ~t.is_bullet(line)
    inner = F.when(F.col("line_no") == ZONE, F.col("header_alone")).otherwise(F.col("header"))
    zone = zone.withColumn("stop_at", F.min(F.when(after & inner, F.col("line_no"))).over(Window.partitionBy("doc_id")))
    bare = t.unmarked(line)
    sub = after & ~inner & (t.n_words(bare) >= 2) & (t.n_words(bare) <= 16) & ~bare.endswith(".") & ~F.col("header_alone") & (F.col("line_no") < F.coalesce("stop_at", F.lit(1 << 30)))
    return zone.groupBy("doc_id").agg(
        F.coalesce(F.min_by("line", F.when(F.col("line_no") == F.col("title_at"), F.col("line_no"))), F.lit("Presentation")).alias("title"),
        F.min("title_at").alias("title_at"),
        F.min_by(bare, F.when(sub, F.col("line_no"))).alias("subtitle"),
        F.min(F.when(sub, F.col("line_no"))).alias("subtitle_at"),
    )


def sections(rows: DataFrame, heads: DataFrame, drop_metadata: bool = True) -> DataFrame:
    """(doc_id, section_no, heading, type, points): headings open sections (gaps and islands), captions close them.

    Lines before the first heading are 'Overview', or all there is if the document has no heading,
    with a stock line if it says nothing else. Sections without points, or headed like the title,
    are left out; numbers keep the gaps.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    told = (F.col("meta") if drop_metadata else F.lit(False)) | F.col("line_no").eqNullSafe(F.col("title_at")) | F.col("line_no").eqNullSafe(F.col("subtitle_at"))
    body = rows.join(heads.select("doc_id", "title", "title_at", "subtitle_at"), "doc_id").withColumn("told", told).withColumn("header", F.col("header") & ~F.col("told"))
    body = body.withColumn("section_no", F.sum(F.col("header").cast("int")).over(w))
    line, rest = F.col("line"), t.numbered_rest(F.col("line"))
    caption = t.squeeze(F.substring(line, len(lex.CAPTION_MARK) + 1, 1 << 30))
    points = (
        F.when(F.col("header") | F.col("told"), F.array().cast("array<string>")).when(t.is_caption(line), F.array(caption)).when(t.is_bullet(line), F.array(t.squeeze(F.regexp_replace(line, t.BULLET, ""))))
        .when(rest.isNotNull() & ~F.col("header_alone"), F.array(t.squeeze(rest))).otherwise(t.packed_line(line))
    )
    body = body.withColumn("points", F.filter(points, lambda p: p != "")).withColumn("late", t.is_caption(line).cast("int"))
    held = F.sort_array(F.collect_list(F.struct("late", "line_no", "points")))
    grouped = body.groupBy("doc_id", "section_no").agg(F.first("title").alias("title"), F.max(F.when(F.col("header"), t.heading_text(line))).alias("own"), F.flatten(F.transform(held, lambda x: x["points"])).alias("points"))
    many = F.max("section_no").over(Window.partitionBy("doc_id"))
    grouped = grouped.withColumn("many", many)
    orphan = F.when(F.col("many") > 0, "Overview").otherwise("Key Concepts & Overview")
    heading = F.when(F.col("section_no") > 0, F.col("own")).otherwise(orphan)
    kind = F.when((F.col("section_no") == 0) & (F.col("many") == 0), "theory").otherwise(t.section_type(F.concat_ws(" ", heading, F.array_join("points", " "))))
    points = F.when((F.col("many") == 0) & (F.size("points") == 0), F.array(F.lit(lex.NOTHING_SAID))).otherwise(F.col("points"))
    out = grouped.select("doc_id", "section_no", heading.alias("heading"), kind.alias("type"), points.alias("points"), "title")
    return out.where((F.size("points") > 0) & (F.col("heading") != F.col("title"))).drop("title")


def structure(marked: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> tuple[DataFrame, DataFrame]:
    """(documents, sections): title, subtitle, author and date of each document; and its sections.

    ``keep`` may write rows that are read several times and give them back.
    """
    rows = keep(classified(marked).drop("following"), "classified")
    heads = keep(titled(rows), "heads")
    docs = heads.join(metadata(rows), "doc_id").select("doc_id", "title", "subtitle", "author", "date")
    return docs, sections(rows, heads)
