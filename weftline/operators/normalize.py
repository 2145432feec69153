"""Whole texts to marked lines: headings, bullets, captions and prose, one row a line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import lexicons as lex
from weftline.functions.text import clean_inline, cut_both, cut_end, let, strip_decoration, undecorated

#: The shapes of lines, in the order in which they are tried.
FENCE = "^\\s{0,3}(?:`{3,}|~{3,})"
RULE = "^\\s{0,3}(?:[-*_][ \\t]*){3,}$"
TABLE = "^\\s*\\|.*\\|[ \\t]*$"
ATX = "^\\s{0,3}(#{1,6})\\s+(.*?)\\s*#*\\s*$"
QUOTE = "^\\s{0,3}(?:>\\s?)+"
ITEM = "^(\\s*)(?:[-*+•▪◦‣⁃])\\s+"
ORDERED = "^\\s*\\d{1,3}[.)]\\s+"
SEPARATOR_CELL = "^:?-{2,}:?$"


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def in_fence(marks: pd.Series) -> pd.Series:
    """For each line's fence character ('' for none): whether it opens, closes or lies in a fence."""

    def of(row) -> list[bool]:
        held, out = "", []
        for m in row if row is not None else []:
            out.append(bool(m or held))
            held = m if m and not held else "" if m and m == held else held
        return out

    return marks.map(of)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dealt: bool = False) -> DataFrame:
    """(doc_id, at, raw): the lines of every text outside code fences, numbered from 0.

    ``dealt`` shuffles the documents by id while they still are whole, for callers with windows by
    document: what is computed for the lines is then spread evenly, however few splits the input
    has, and those windows find the lines where they need them.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(whole.contains("\r") | whole.contains("\u2028"), F.regexp_replace(whole, "\r\n|\r|\u2028", "\n")).otherwise(whole)
    hint = whole.contains("```") | whole.contains("~~~")
    split = docs.select(F.col(id_col).alias("doc_id"), F.split(text, "\n").alias("l"), hint.alias("hint"))
    split = split.select("doc_id", "l", F.when(F.col("hint"), F.exists("l", lambda x: x.rlike(FENCE))).otherwise(False).alias("fenced"))
    marks = F.transform("l", lambda x: F.regexp_extract(x, "^\\s{0,3}(?:(`)`{2,}|(~)~{2,})", 1))
    tilde = F.transform("l", lambda x: F.regexp_extract(x, "^\\s{0,3}(?:(`)`{2,}|(~)~{2,})", 2))
    # a Python function runs for every row, so texts without a fence hand it nothing
    sent = F.when(F.col("fenced"), F.zip_with(marks, tilde, lambda a, b: F.concat(a, b)))
    inside = F.when(F.col("fenced"), in_fence(sent)).otherwise(F.array_repeat(F.lit(False), F.size("l")))
    zipped = split.select("doc_id", F.arrays_zip(F.col("l").alias("raw"), inside.alias("inside")).alias("zipped"))
    if dealt:
        zipped = zipped.repartition("doc_id")
    # a split text has one line at least; the outer form only spares a filter that would compute the array, and its Python, again
    both = zipped.select("doc_id", F.posexplode_outer("zipped").alias("at", "x"))
    return both.where(~F.col("x.inside")).select("doc_id", "at", F.col("x.raw").alias("raw"))


def line_kind(raw: Column) -> Column:
    """blank, table, heading, quote, item, ordered, caption, marked or prose; the first shape that fits. None but prose begins with a letter."""
    letter = ((raw >= "A") & (raw < "[")) | ((raw >= "a") & (raw < "{"))
    return (
        F.when(letter, "prose").when(~raw.rlike("(?U)\\S"), "blank").when(raw.rlike(RULE), "blank").when(raw.rlike(TABLE), "table").when(raw.rlike(ATX), "heading").when(raw.rlike(QUOTE), "quote")
        .when(raw.rlike(ITEM), "item").when(raw.rlike(ORDERED), "ordered").when(raw.startswith("! "), "caption").when(raw.startswith("## "), "marked").otherwise("prose")
    )


def marked_line(raw: Column, kind: Column) -> Column:
    """A line that is not of a table, marked and cleaned; empty where no word is left. Each step is computed once."""
    body = (
        F.when(kind == "heading", F.regexp_extract(raw, ATX, 2)).when(kind == "marked", F.substring(raw, 4, 1 << 30)).when(kind == "quote", F.regexp_replace(raw, QUOTE, ""))
        .when(kind == "item", F.regexp_replace(raw, ITEM, "")).when(kind == "ordered", F.regexp_replace(raw, ORDERED, "")).when(kind == "caption", F.substring(raw, 3, 1 << 30)).otherwise(raw)
    )
    mark = F.when(kind.isin("heading", "marked"), lex.HEADING_MARK).when(kind == "item", lex.BULLET_MARK).when(kind == "caption", lex.CAPTION_MARK).otherwise("")
    bare = lambda b: F.when(kind == "caption", b).otherwise(undecorated(b))
    cut = lambda b: F.when(kind.isin("heading", "marked"), cut_both(b, " .:\\-#")).otherwise(b)
    some = lambda b: F.when(F.when(kind == "caption", b != "").otherwise(b.rlike("[A-Za-z0-9]")), F.concat(mark, b)).otherwise("")
    return let(clean_inline(body), lambda b: let(bare(b), lambda c: let(cut(c), some)))


def _cells(raw: Column) -> Column:
    row = F.regexp_replace(F.regexp_replace(F.trim(raw), "^\\|", ""), "\\|$", "")
    return F.transform(F.split(row, "\\|"), clean_inline)


def _is_separator(cells: Column) -> Column:
    filled = F.filter(F.transform(cells, F.trim), lambda c: c != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike(SEPARATOR_CELL))


def column_label(cell: Column) -> Column:
    """A table heading before its colon, without brackets, four words at most."""
    head = F.regexp_replace(F.split(cut_end(cell, ":"), ":")[0], "\\s*\\([^)]*\\)\\s*", " ")
    words = F.filter(F.split(cut_both(F.trim(strip_decoration(head)), " .:\\-"), "\\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, 4), " ")


def table_bullet(header: Column, row: Column) -> Column:
    """One body row as ``label: values``, null for a row without cells."""
    cells = F.filter(row, lambda c: c != "")
    labels = F.transform(header, column_label)

    def part(value: Column, i: Column) -> Column:
        name = F.coalesce(F.get(labels, i + 1), F.lit(""))
        low, v = F.lower(F.trim(name)), cut_end(value, " .,;:")
        return (
            F.when(v == "", "").when(low.isin(lex.RATIONALE_COLUMNS), F.when(i == 0, v).otherwise(F.concat(F.lit("— "), v)))
            .when(low.isin(lex.GENERIC_COLUMNS) | (name == ""), v).otherwise(F.concat(name, F.lit(": "), v))
        )

    def of(c: Column) -> Column:
        values = F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
        wide = F.array_join(F.filter(F.transform(values, part), lambda p: p != ""), "; ")
        text = F.when(F.size(header) <= 2, F.array_join(values, "; ")).otherwise(wide)
        return F.when(F.size(c) == 0, F.lit(None)).when(_is_separator(c), F.lit(None)).when(F.size(c) == 1, c[0]).otherwise(F.trim(F.concat(cut_end(c[0], " .,;:"), F.lit(": "), text)))

    return let(cells, of)


def normalise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, kind): the marked lines of every text, none blank, numbered from 1.

    A table row that follows no other opens a run and is the header of the rows after it. Lines of
    tables and others pass the same windows, by document and place, so texts are read, cut and
    sorted once.
    """
    rows = lines(docs, id_col, text_col, dealt=True).withColumn("kind", line_kind(F.col("raw")))
    by, table = Window.partitionBy("doc_id").orderBy("at"), F.col("kind") == "table"
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cells", F.when(table, _cells(F.col("raw")))).withColumn("row_before", F.lag(F.when(table, F.col("at"))).over(by))
    rows = rows.withColumn("opens", table & ~F.col("row_before").eqNullSafe(F.col("at") - 1))
    rows = rows.withColumn("header", F.last(F.when(F.col("opens"), F.col("cells")), ignorenulls=True).over(so_far))
    bullet = F.when(~F.col("opens"), F.concat(F.lit(lex.BULLET_MARK), table_bullet(F.col("header"), F.col("cells"))))
    line = F.when(table, bullet).when(F.col("kind") != "blank", let(marked_line(F.col("raw"), F.col("kind")), lambda x: F.when(x != "", x)))
    # the window stands between the line and the filter on it, so that its expressions are not computed for both
    out = rows.select("doc_id", "at", line.alias("line"), "kind").withColumn("line_no", F.count("line").over(so_far).cast("int"))
    return out.where(F.col("line").isNotNull()).select("doc_id", "line_no", "line", "kind")


def normalised_text(marked: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of a document joined again, in order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))
