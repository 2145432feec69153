import random

from pyspark.sql import functions as F

from weftline.operators import catalog, deck, figures, geometry, matching


def test_chain_order_and_builtin(spark):
    p = spark.createDataFrame([("b", "x", "m", True, 2, False, [], {}), ("a", "x", "m", True, 2, False, ["t"], {"t": "n"}), ("d", "x", "m", True, 1, True, [], {}), ("off", "x", "m", False, 0, False, [], {})], "name string, provider_type string, model string, enabled boolean, priority int, is_default boolean, tasks array<string>, overrides map<string,string>")
    own = spark.createDataFrame([("z", "y", "k")], "name string, provider_type string, model string")
    assert [(r.name, r.model) for r in catalog.provider_chain(p, "t", own).orderBy("position").collect()] == [("a", "n"), ("b", "m"), ("d", "m"), ("z", "k")]


def test_requests_are_checked(spark):
    rows = [(1, "t", 10, 50, 50, "text", "x" * 60), (2, "t", 51, 50, 50, "text", "x" * 60), (3, "t", 10, 50, 50, "text", "short"), (4, None, 10, 50, 50, "text", "x" * 60)]
    ok, bad = catalog.valid_requests(spark.createDataFrame(rows, "request_id long, title string, slide_count int, theory_percent int, image_percent int, content_type string, content string"))
    assert [r.request_id for r in ok.collect()] == [1] and {r.request_id: r.reason for r in bad.collect()} == {2: "slide_count", 3: "content", 4: "title"}


def test_captions_and_headings(spark):
    f = spark.createDataFrame([(1, 0, 1, 100.0, 200.0), (1, 0, 2, 500.0, 600.0)], "doc_id long, page int, figure_no int, y0 double, y1 double")
    lines = spark.createDataFrame([(1, 0, 1, "Figure 1. Loss", 210.0, 220.0), (1, 0, 2, "Near line", 480.0, 490.0), (1, 0, 3, "far away", 300.0, 310.0)], "doc_id long, page int, line_no int, text string, y0 double, y1 double")
    assert {r.figure_no: r.caption for r in geometry.captions(f, lines).collect()} == {1: "Figure 1. Loss", 2: "Near line"}
    heads = spark.createDataFrame([(1, 0, 50.0, "One"), (1, 0, 300.0, "Two")], "doc_id long, page int, y0 double, text string")
    assert {r.figure_no: r.section for r in geometry.enclosing_headings(f, heads).collect()} == {1: "One", 2: "Two"}


def test_each_figure_once(spark):
    s = spark.createDataFrame([(1, 0, "3. Results", ["loss falls over training steps"]), (1, 1, "Results", ["other words entirely"])], "request_id long, pos int, title string, bullets array<string>")
    f = spark.createDataFrame([(1, 7, "training loss per step", "Results")], "request_id long, figure_no int, caption string, section string")
    got = matching.figure_matches(s, f).collect()
    assert [(r.pos, r.figure_no) for r in got] == [(0, 7)]


def test_boxes_merge(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 1), (1, 0, 20.0, 0.0, 30.0, 10.0, 1), (1, 0, 100.0, 0.0, 110.0, 10.0, 1)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, items long")
    assert sorted((x.x0, x.x1, x["items"]) for x in figures.rect_clusters(r).collect()) == [(0.0, 30.0, 2), (100.0, 110.0, 1)]


def test_visuals_that_get_a_slide(spark):
    """A diagram, a dense figure or a drawn infographic doubles its slide; photos and figures that are not dense stay."""
    image = "struct<url:string,diagram:string,promote:boolean,local:boolean,keyword:string,generated:boolean>"
    rows = [
        ("theory", ("u", None, True, True, "", False)), ("theory", ("u", None, False, True, "k", True)), ("practical", (None, "d", None, None, None, None)), ("theory", ("u", None, None, None, "k", True)),
        ("theory", ("u", None, None, None, " ", True)), ("theory", ("", None, True, None, "k", True)), ("cover", ("u", "d", True, None, "k", True)), ("takeaways", ("u", None, None, None, "k", None)), ("theory", None),
    ]
    df = spark.createDataFrame([(1, i, f"t{i}", "sub", k, ["b"], im) for i, (k, im) in enumerate(rows, 1)], f"request_id long, slide_number int, title string, subtitle string, type string, bullets array<string>, image {image}")
    caption = F.when(F.col("slide_number") == 1, "cap").when(F.col("slide_number") == 3, "")
    got = [(r.title, r.type, r.subtitle, len(r.bullets)) for r in deck.promoted(df, deck.deserves_slide(F.col("type"), F.col("image")), caption).orderBy("slide_number").collect()]
    alone = {"t1": "cap", "t3": "sub", "t4": "sub"}
    assert got == [x for i, (k, _) in enumerate(rows, 1) for x in [(f"t{i}", k, "sub", 1), *([(f"t{i}", "image", alone[f"t{i}"], 0)] if f"t{i}" in alone else [])]]


def test_many_figures_of_a_deck_are_not_paired_in_a_shuffle(spark):
    """Pairs of figures and slides that share a word are scored where they meet; no exchange has both their words."""
    s = spark.createDataFrame([(1, p, f"Part {p}", [f"common words of slide number{p}"]) for p in range(40)], "request_id long, pos int, title string, bullets array<string>")
    f = spark.createDataFrame([(1, i, f"common words of slide number{i % 50}", "") for i in range(200)], "request_id long, figure_no int, caption string, section string")
    found = matching.figure_matches(s, f)
    assert sorted((r.pos, r.figure_no) for r in found.collect()) == [(p, p) for p in range(40)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array_union" not in plan and "Deduplicate" not in plan and plan.count("Join") == 1


def test_edit_distance(spark):
    rng = random.Random(7)
    texts = ["", "a", "ab", "é𝄞z", "kitten", "sitting", *("".join(rng.choices("abcé ", k=rng.randrange(90))) for _ in range(40))]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d")).collect()
    assert [(r.a, r.b) for r in got if matching.edit_distance(r.a, r.b) != r.d] == []


def test_earlier_duplicates_of_a_large_group(spark):
    """A group of many blocks: places that repeat, copies, near copies, empty and null texts; compared in several tasks, a row for each answer."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(30))) for _ in range(60)]
    rows = [(1 + i % 2, rng.randrange(150), rng.choice([None, "", x := rng.choice(texts), x + "X", x[1:]])) for i in range(300)]
    found = matching.earlier_duplicates(spark.createDataFrame(rows, "g long, o int, t string"), "g", "o", "t", 0.6)
    similar = lambda a, b: max(0.0, 1 - matching.edit_distance(a.lower(), b.lower()) / max(len(a), len(b), 1)) > 0.6
    want = {(g, o) for g, o, t in rows for h, p, u in rows if g == h and p < o and None not in (t, u) and similar(t, u)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert matching.BLOCK < 150
