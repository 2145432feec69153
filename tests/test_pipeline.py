from pyspark.sql import functions as F

from weftline.operators import deck, model_output, normalize, planner
from weftline.operators.structure import structure

TEXT = """My Great Seminar On Things
By Jane Roe
12 March 2021
## Objectives
- First: do the **bold** thing
- Second point here
| Name | Model 1: now | Why |
|---|---|---|
| Sale | paid at once. | safe |
```
code
```
Practical Activities
Try the exercise. It works well.
! Figure 1. A caption
Conclusion
This is the end of it all.
"""
ASK = "request_id long, content_slides int, theory_slides int, audience_level string, title string, subtitle string, author_name string, author_email string"


def sections(spark, text=TEXT):
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    return structure(normalize.normalise(docs))


def test_structure(spark):
    heads, found = sections(spark)
    h = heads.collect()
    assert [(x.title, x.author, x.date) for x in h] == [("My Great Seminar On Things", "Jane Roe", "12 March 2021")]
    rows = {r.heading: r for r in found.collect()}
    assert rows["Objectives"].points == ["First: do the bold thing", "Second point here", "Sale: Model 1: paid at once; — safe"]
    assert rows["Practical Activities"].type == "practical" and rows["Practical Activities"].points[-1] == "Figure 1. A caption"
    assert "code" not in str(rows)


def test_deck_invariants(spark):
    found = sections(spark)[1].withColumnRenamed("doc_id", "request_id")
    ask = spark.createDataFrame([(1, 6, 3, "Beginner", "T", None, "Ann", None)], ASK)
    planned = planner.plan(found, ask)
    rows = deck.assemble(deck.content_slides(planned, ask), ask).orderBy("slide_number").collect()
    assert [r.slide_number for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].type == "cover" and rows[-1].type == "end" and rows[-2].type == "takeaways" and all(r.bullets for r in rows)
    assert all(len(r.bullets) <= 5 for r in planned.collect())
    s = planner.shortfall(planned, ask).first()
    assert s.built + s.missing == 6


def test_allocation_is_the_greedy_one(spark):
    points = lambda n: [f"p{i}" for i in range(n)]
    sizes, target = [9, 4, 3, 12], 9
    rows = [(1, "theory", i + 1, "s", points(n), target, min(target, max(n // 2, 1), 4)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "request_id long, kind string, no int, section string, points array<string>, target int, cap int")
    got = [r.slots for r in planner.allocated(df).orderBy("no").collect()]
    caps, want, left = [r[6] for r in rows], [1] * 4, target - 4
    while left:
        open_ = [i for i in range(4) if want[i] < caps[i]]
        i = max(open_, key=lambda i: (caps[i] - want[i], sizes[i], -i)) if open_ else max(range(4), key=lambda i: sizes[i])
        want[i] += 1
        left -= 1
    assert got == want


def test_chunks_and_titles(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e", "Figure 1. x"], 2), (["a"], 3), (["Figure 1. x"], 2)], "p array<string>, k int")
    got = [r[0] for r in df.select(planner.chunks(F.col("p"), F.col("k"))).collect()]
    assert got == [[["a", "b", "Figure 1. x"], ["c", "d", "e"]], [["a"]], [["Figure 1. x"]]]
    names = spark.createDataFrame([(["A", "B", "A", "A — Part 1", "A"],)], "t array<string>")
    assert names.select(planner.unique_titles(F.col("t"))).first()[0] == ["A", "B", "A (2)", "A — Part 1", "A (3)"]


def test_outline_moves_a_dangling_marker(spark):
    ask = spark.createDataFrame([(1, 7, 7, "Beginner", "T", None, None, None)], ASK)
    content = spark.createDataFrame([(1, i, f"S{i}", "theory") for i in range(6)], "request_id long, pos int, title string, type string")
    pages = [r.bullets for r in deck.outline(content, ask).orderBy("page").collect()]
    assert [len(p) for p in pages] == [9, 2] and pages[1][0] == "**Closing**"


def test_model_output(spark):
    raw = ["<<<START_SLIDE>>>\nTITLE: A\nTYPE: odd\n- x\n- y\n- z\n- w\n<<<END_SLIDE>>>", '[{"title":"J","bullets":["b"],"type":"practical"}]', "TITLE: only\n- one"]
    df = spark.createDataFrame([(str(i), 2, r) for i, r in enumerate(raw)], "prompt_hash string, requested int, raw string")
    got = {r.prompt_hash: r.slides for r in model_output.normalised_count(model_output.parsed(df)).collect()}
    assert [s.bullets for s in got["0"]] == [["x", "y"], ["z", "w"]] and got["0"][0].type == "theory"
    assert got["1"][0].type == "practical" and got["1"][1].title == "Key Takeaway 2" and len(got["2"]) == 2


def test_visual_plan(spark):
    raw = '[{"index":0,"kind":"flow","steps":["a","b"]},{"index":0,"kind":"flow","steps":["a"]},{"index":9,"kind":"photo","query":"q"},{"index":1,"kind":"odd"},{"index":0,"kind":"photo","query":"later"}]'
    df = spark.createDataFrame([(1, raw, 3)], "request_id long, raw string, n_slides int")
    assert [(r.idx, r.kind, r["query"]) for r in model_output.visual_plan(df).collect()] == [(0, "photo", "later")]


def test_every_line_is_a_figure(spark):
    """With one line of three taken, all numbers had the same rest."""
    from weftline.plans import registry

    got = registry.queries()["figure_matches"](spark, "/root/testdata/sf0.001")
    assert {r.rest for r in got.selectExpr("figure_no % 3 as rest").distinct().collect()} == {0, 1, 2}


def test_planning_keeps_what_is_read_twice(spark):
    """Rows that several later steps read are handed to ``keep``, each once; planned slides do not depend on it."""
    from weftline.plans.inputs import kept

    found = sections(spark)[1].withColumnRenamed("doc_id", "request_id")
    asked = spark.createDataFrame([(1, 6, 3, "Beginner", "T", None, None, None), (2, 2, 1, "Beginner", "T", None, None, None)], ASK)
    names = []
    held = planner.plan(found, asked, lambda rows, name: names.append(name) or kept(rows, name))
    assert names == ["pool", "chunks", "slides"]
    assert sorted(map(str, held.collect())) == sorted(map(str, planner.plan(found, asked).collect()))
