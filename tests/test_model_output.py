"""Model answers: lenient JSON, blocks brought to a number of slides, and whole decks, against plain versions."""

import json

import plain
from pyspark.sql import functions as F

from weftline.operators import model_output
from weftline.plans import deck_queries
from weftline.plans.inputs import requests

CASES = [
    '[{"title": "A", "bullets": ["x", 2, null, true, 2.5, {"k": 1}], "type": "Practical"}]', '[{"bullets": "alone"}, 7, {"title": null, "type": 3}, {"title": "", "bullets": [" "]}]', "[]", '[1, "two", null]',
    '```json\n[{"title": "fenced", "bullets": ["1","2","3","4","5","6","7"]}]\n```', '[{"title": 12, "bullets": false, "type": null}]', '[{"title": "cut", ', '{"title": "no list"}', "TITLE: Block\nTYPE: practical\n- one\n- two", "", "nothing at all", None,
]


def plain_json(raw):
    said = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)
    raw = (raw or "").strip().removeprefix("```json\n").removesuffix("\n```")
    try:
        listed = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(listed, list):
        return None
    out = []
    for i, s in enumerate(listed, 1):
        if isinstance(s, dict):
            bullets = s.get("bullets", [])
            kind = said(s.get("type", "theory")).lower()
            out.append((said(s.get("title", f"Slide {i}")), [said(b) for b in (bullets if isinstance(bullets, list) else [bullets])][:6], kind if kind in ("theory", "practical") else "theory"))
    return out


def test_lenient_json(spark):
    df = spark.createDataFrame([(str(i), 3, c) for i, c in enumerate(CASES)], "prompt_hash string, requested int, raw string")
    got = {int(r.prompt_hash): None if r.slides is None else [tuple(s) for s in r.slides] for r in model_output.parsed(df).collect()}
    for i, raw in enumerate(CASES):
        if plain_json(raw) is not None:
            assert got[i] == plain_json(raw), raw
    assert got[8] == [("Block", ["one", "two"], "practical")] and not got[9] and not got[10] and not got[11]
    assert all(plain_json(CASES[i]) is None for i in (6, 7, 8, 9, 10, 11))


def test_answers_of_a_whole_table(spark):
    """Each turn of a conversation is a slide with one bullet; fewer than asked are padded, more are cut."""
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((f"Turn {r.turn}", [" ".join(r.text.split())], "practical" if r.role == "user" else "theory"))
    got = {}
    for r in deck_queries.model_slides(spark, "/root/testdata/sf0.01").orderBy("prompt_hash", "pos").collect():
        got.setdefault(int(r.prompt_hash), []).append((r.title, [r.bullets], r.type))
    pad = lambda s: [*s[:4], *((f"Key Takeaway {i}", ["Summary point"], "theory") for i in range(len(s) + 1, 5))]
    assert got == {k: pad(s) for k, s in turns.items()}


def test_decks_of_a_whole_table(spark):
    answers = deck_queries._answers(spark, "/root/testdata/sf0.01").collect()
    texts = spark.createDataFrame([(int(r.prompt_hash), " ".join(b for s in r.slides for b in s.bullets)) for r in answers], "doc_id long, text string")
    asked, got = {r.doc_id: r.asDict() for r in requests(texts).collect()}, {}
    for r in deck_queries.model_decks(spark, "/root/testdata/sf0.01").orderBy("request_id", "slide_number").collect():
        got.setdefault(r.request_id, []).append((r.title, r.subtitle, r.type, r.bullets.split("\n")))
    for r in answers:
        i = int(r.prompt_hash)
        q = asked[i] | {"title": f"Conversation {i}", "subtitle": None, "author_name": None, "author_email": None}
        sections = [(plain.head_title(s.title or f"Section {n}"), s.type, [b for b in s.bullets if b.strip()]) for n, s in enumerate(r.slides, 1)]
        assert got[i] == plain.deck(plain.planned([s for s in sections if s[2]], q["content_slides"], q["theory_slides"]), q), i


def test_slides_without_bullets_are_no_sections(spark):
    df = spark.createDataFrame([(1, [("", ["x"], "theory"), ("T", [" ", ""], "theory"), ("U.", ["y", " "], "practical")])], "request_id long, slides array<struct<title:string,bullets:array<string>,type:string>>")
    assert sorted(tuple(r) for r in model_output.sections(df).collect()) == [(1, 1, "Section 1", "theory", ["x"]), (1, 3, "U", "practical", ["y"])]
    assert model_output.sections(df.where(F.lit(False))).collect() == []
