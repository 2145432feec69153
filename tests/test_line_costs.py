"""Texts are read and their lines marked once; patterns that are tried only where they can match leave what all of them in order leave."""

import random
import re

import plain
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import text as t
from weftline.operators import normalize, planner
from weftline.plans import deck_queries, text_queries
from weftline.plans.inputs import kept


def test_lines_of_tables_and_others_pass_one_plan(spark):
    """One scan, one shuffle and one sort of the texts; before, table rows and other lines each had their own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = normalize.normalise(docs)._jdf.queryExecution().executedPlan().toString()
    assert [len(re.findall(rf"\b{name}\b", plan)) for name in ("FileScan", "hashpartitioning", "Sort")] == [1, 1, 1]


def test_tables_between_other_lines(spark):
    """Runs end at blank lines, fences and other lines; a header alone says nothing."""
    text = "| a | b |\n| x | y |\n\n| c | d |\n| z | 1 |\nwords here\n| alone | header |\n```\n| in | fence |\n```\n| k | v |\n| m | n |\n|---|---|\n~~~\n| p |\n```\n| q |"
    got = [r.line for r in normalize.normalise(spark.createDataFrame([(1, text), (2, None), (3, "| h |")], "doc_id long, text string")).orderBy("doc_id", "line_no").collect()]
    assert got == plain.marked_lines(text) and len(got) == 4


def test_gated_patterns(spark):
    rng = random.Random(3)
    pieces = ["a", "B c", " ", "  ", "\t", " ", "　", ".", ",", ";:", "..", " .", ". ,", "http://x.y", "(http://z", "*", "**b**", "_i_", "`c`", "~~s~~", "<b>", "<!-- x -->", "[l](u)", "![i](u)", "🙂", "→", "™", "‍", "é", "–", "﻿", "!", "?"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(9)))) for i in range(3000)] + [(3000, None)]
    out = F.regexp_replace(F.coalesce("x", F.lit("")), "(?s)<!--.*?-->", " ")
    for pattern, to in t.INLINE:
        out = F.regexp_replace(out, pattern, to)
    spaced = lambda x: F.trim(F.regexp_replace(x, "(?U)[^\\S\\n]+", " "))
    out = F.regexp_replace(spaced(F.regexp_replace(out, "(?<![(\\w])https?://\\S+", "")), "(?U)\\s+([.,;:!?])", "$1")
    out = spaced(t.strip_decoration(F.trim(F.regexp_replace(F.regexp_replace(out, "([.,;:])\\1+", "$1"), "([.;:]),", "$1"))))
    got = spark.createDataFrame(rows, "i int, x string").select("x", t.plain("x").alias("got"), out.alias("want")).collect()
    assert [r for r in got if r.got != r.want] == [] and sum(r.got != (r.x or "") for r in got) > 1000


def test_whole_words(spark):
    """Patterns grouped by first letters tell what the plain alternatives tell."""
    words = [w for w in re.split(r"[|()?:\\*]+", lex.PRACTICAL_SECTION + "|" + lex.PRACTICAL_POINT) if w]
    rng = random.Random(5)
    rows = [("".join(rng.choice([w, w.upper(), w + "s", w[:-1], "x" + w, "-" + w, "_" + w]) + rng.choice([" ", ".", "é", ""]) for w in rng.choices(words, k=2)),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x string")
    for pattern, x, flag in ((lex.PRACTICAL_SECTION, F.lower("x"), ""), (lex.PRACTICAL_POINT, F.col("x"), "(?i)")):
        got = df.select(x.rlike(flag + t.whole_words(pattern)).alias("got"), x.rlike(rf"{flag}\b(?:{pattern})\b").alias("want")).collect()
        assert all(r.got == r.want for r in got) and 0 < sum(r.got for r in got) < len(got)


def test_what_queries_write(spark, monkeypatch):
    """Lines are written once, with what is told of them, and atoms make no requests of the documents."""
    names = []
    monkeypatch.setattr(deck_queries, "kept", lambda df, name: names.append(name) or kept(df, name))
    monkeypatch.setattr(text_queries, "kept", lambda df, name: names.append(name) or kept(df, name))
    for query in (text_queries.document_titles, text_queries.document_sections, deck_queries.section_atoms):
        names.clear()
        assert query(spark, "/root/testdata/sf0.001").columns and names == ["classified", "heads"], query


def test_themes_are_told_once(spark):
    rows = [(1, 1, "H", "theory", ["to  practice", " plain "]), (1, 2, "P", "practical", ["plain"]), (2, 1, "E", "theory", [" ", ""]), (3, 1, "T", "theory", ["do a checklist", "a lab"])]
    out = planner.atoms(spark.createDataFrame(rows, "request_id long, section_no long, heading string, type string, points array<string>"))
    assert len(re.findall("hecklist", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert [tuple(r) for r in out.orderBy("request_id", "atom_no").collect()] == [
        (1, 1, "H", "theory", ["plain"]), (1, 2, "H", "practical", ["to practice"]), (1, 3, "P", "practical", ["plain"]), (3, 1, "T", "theory", ["do a checklist", "a lab"]),
    ]
