"""Normaliser, structurer, planner and decks against the plain versions: all of two tables, and texts made of every kind of line."""

import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import text as t
from weftline.operators import deck, matching, normalize, planner
from weftline.operators.structure import structure
from weftline.plans.inputs import kept, requests

LINES = [
    "# One title", "## Two: heads #", "###### deep . - ", "#", "Plain Title Here", "plain words in a line that is not short and goes on and on", "Ends with a stop.", "SHOUTING LINE", "Overview", "Conclusion of this part.", "Note:",
    "Section 2 things", "1. First of all", "12) a much longer ordered line that has more than nine words in it", "iv. roman heading", "ii) a roman point that is far too long to be a heading of anything.", "- item **bold** text", "* star", "+ plus  item", "• dot", "o lone", "> quoted `code` line",
    ">> more", "! Figure 1: a caption", "! ", "## Marked heading:", "##  ", "| a | b |", "| --- | :--: |", "| x. | y |", "|  | only |", "| name | Reason | Value (in EUR): all | Description |", "| r | one, | two. | three; | extra |", "|---|---|---|---|", "```", "~~~", "```py", "in 2024 it rained", "By Ann Lee",
    "Author: Bob", "Dr Ann Lee", "12 March 2020", "May 5", "", "  ", "---", "* * *", "____", "[link](http://a.b/c) and ![img](x) <b>tags</b> __u__ _i_ ~~s~~", "see https://x.y/z now , please ..", "emoji 🙂 → ✓ ™ ®", "ünï Çödé Wörds Here", "Ärger und Ende", "!!!", "***", "-", "a <!-- hidden --> b", "tool exercise steps",
    "One sentence here. Another one there! A third? \"Quoted\" (bracket) " + "long words follow here. " * 12, "x" * 300, "Title with trailing comma,", "What is it?", "  nbsp line", "tab\tline\there", "Case Study",
    "## one two three four five six seven eight. nine ten", "- ßtart of a point", "## a b c d e f g h: i (2)", "- Label One: first half of it here; Label One: and " + "so many words " * 12 + ", but then more of it follows here", "Label One: text", "- " + "word, " * 40,
]


def made_up():
    rng = random.Random(11)
    docs = [(i, rng.choice(["\n", "\r\n", "\n\n", "\r"]).join(rng.choices(LINES, k=rng.randrange(1, 24)))) for i in range(400)]
    return docs + [(1000, None), (1001, ""), (1002, " \n "), (1003, "Only A Title"), (1004, "2024"), (1005, "# Head"), (1006, "Only A Title\n# Only A Title\n- x")]


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01", "made up"])
def built(request, spark):
    """(texts, requests, and the rows by document) of every step from texts to decks, each computed once."""
    if request.param == "made up":
        docs = spark.createDataFrame(made_up(), "doc_id long, text string").repartition(4)
    else:
        docs = spark.read.parquet(f"/root/testdata/{request.param}/documents.parquet")
    lines = kept(normalize.normalise(docs), "lines")
    heads, sections = structure(lines, kept)
    heads, sections = kept(heads, "heads"), kept(sections.withColumnRenamed("doc_id", "request_id"), "sections")
    asked = requests(docs).join(heads.select("doc_id", "title", "subtitle", F.col("author").alias("author_name")), "doc_id", "left").withColumnRenamed("doc_id", "request_id")
    level = F.when(F.col("request_id") % 7 == 0, "Expert").otherwise(F.col("audience_level"))
    email = F.when(F.col("request_id") % 2 == 0, F.concat(F.col("request_id").cast("string"), F.lit("@x.org")))
    asked = kept(asked.withColumn("title", F.coalesce("title", F.lit("Presentation"))).withColumn("author_email", email).withColumn("audience_level", level), "requests")
    planned = kept(planner.plan(sections, asked), "plan")
    content = kept(deck.content_slides(planned, asked), "content")

    def listed(df, key, order, *columns):
        out = {}
        for r in df.select(key, order, F.struct(*columns).alias("r")).orderBy(key, order).collect():
            out.setdefault(r[0], []).append(tuple(r.r) if len(columns) > 1 else r.r[0])
        return out

    rows = {
        "lines": listed(lines, "doc_id", "line_no", "line"), "heads": {r.doc_id: (r.title, r.subtitle, r.author, r.date) for r in heads.collect()},
        "sections": listed(sections, "request_id", "section_no", "heading", "type", "points"), "plan": listed(planned, "request_id", "pos", "title", "subtitle", "section", "type", "bullets"),
        "short": {r.request_id: r for r in planner.shortfall(planned, asked).collect()}, "decks": listed(deck.assemble(content, asked), "request_id", "slide_number", "title", "subtitle", "type", "bullets"),
    }
    words = docs.select(F.col("doc_id").alias("request_id"), F.posexplode(F.split("text", "\r\n?|\n")).alias("figure_no", "caption")).where("caption <> ''")
    figures = words.withColumn("section", F.array_join(F.slice(F.split("caption", " "), 1, 3), " "))
    rows |= {
        "content": listed(content, "request_id", "pos", "pos", "title", "bullets"), "figures": listed(figures, "request_id", "figure_no", "figure_no", "caption", "section"),
        "matches": listed(matching.figure_matches(content, figures), "request_id", "pos", "pos", "figure_no", "score"), "atoms": listed(planner.atoms(sections), "request_id", "atom_no", "section", "kind", "points"),
        "inline": listed(words.select("request_id", "figure_no", t.plain("caption").alias("clean")), "request_id", "figure_no", "clean"),
    }
    return {d.doc_id: d.text for d in docs.collect()}, asked.collect(), rows


def test_lines(built):
    texts, _, rows = built
    for i, text in texts.items():
        assert rows["lines"].get(i, []) == plain.marked_lines(text), i


def test_structure(built):
    texts, _, rows = built
    for i in texts:
        if i in rows["lines"]:
            assert (rows["heads"][i], rows["sections"].get(i, [])) == plain.structured(rows["lines"][i]), i
        else:
            assert i not in rows["heads"] and i not in rows["sections"]


def test_plan(built):
    """Planned slides and shortfall of a deck for every document, the requests made of the ids."""
    for r in built[1]:
        want, s = plain.planned(built[2]["sections"].get(r.request_id, []), r.content_slides, r.theory_slides), built[2]["short"][r.request_id]
        assert built[2]["plan"].get(r.request_id, []) == want, r.request_id
        assert (s.built, s.theory, s.missing, s.note is None) == (len(want), sum(w[3] == "theory" for w in want), r.content_slides - len(want), len(want) == r.content_slides)


def test_decks(built):
    """Cover, outline pages, content, recap and end."""
    for r in built[1]:
        assert built[2]["decks"][r.request_id] == plain.deck(built[2]["plan"].get(r.request_id, []), r.asDict()), r.request_id


def test_figures_matched_to_slides(built):
    """Each line of a document as a figure: the best of a slide, each used once."""
    for i in built[0]:
        got = {pos: (no, round(score, 9)) for pos, no, score in built[2]["matches"].get(i, [])}
        want = plain.matched(built[2]["content"].get(i, []), built[2]["figures"].get(i, []))
        assert got == {k: (no, round(score, 9)) for k, (no, score) in want.items()}, i


def test_inline_markup(built):
    for i, lines in built[2]["inline"].items():
        assert lines == [plain.spaced(plain.undecorated(plain.inline(c))) for _, c, _ in built[2]["figures"][i]], i


def test_atoms(built):
    """A section's lines by theme, in order, none lost; a section whose declared kind has no line stays whole."""
    for i, sections in built[2]["sections"].items():
        got = built[2]["atoms"].get(i, [])
        of = lambda p: "practical" if re.search(rf"(?i)\b(?:{lex.PRACTICAL_POINT})\b", p) else "theory"
        want = []
        for heading, declared, points in sections:
            points = [plain.squeezed(p) for p in points]
            kinds = {k: [p for p in points if of(p) == k] for k in ("theory", "practical")}
            kinds = kinds if kinds[declared] else {declared: points}
            want += [(plain.squeezed(heading), k, ps) for k, ps in kinds.items() if ps]
        assert got == want, i
