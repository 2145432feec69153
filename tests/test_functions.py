from pyspark.sql import functions as F

from weftline.functions import maths
from weftline.functions import text as t


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"] if names else None


def test_inline_markup_goes(spark):
    assert one(spark, t.plain("a"), a="**Sale** [here](http://x.y) `code` 🔄 done .. ok") == "Sale here code done. ok"


def test_sentences_pack_in_order(spark):
    assert one(spark, t.pack(t.sentences("a"), 20), a="One is. Two is. Three is much longer than that. Four.") == ["One is. Two is.", "Three is much longer than that.", "Four."]


def test_header_rules(spark):
    h = lambda line, following=None: one(spark, t.is_header(F.col("a"), F.col("b")), a=line, b=following)
    assert h("## Any") and h("CAPITAL LINE") and h("Results of it") and h("Section 4 b") and h("Some label:")
    assert not h("- bullet") and not h("! Figure 1. x") and not h("plain words here")
    assert h("Short title line", "this line has four words") and not h("Short title line", None)


def test_titles_and_bullets(spark):
    assert one(spark, t.clean_title(F.col("a")), a="one two three four five six seven eight nine — Part 2") == "one two three four five six seven eight — Part 2"
    assert one(spark, t.refine_bullet(F.col("a")), a="- the NASA plan. it works") == "The nasa plan. It works."
    assert one(spark, t.label_of(F.col("a")), a="Sale Creation: your staff") == "Sale Creation"
    assert one(spark, t.label_of(F.col("a")), a="Model 2: later") is None


def test_half_even_and_spread(spark):
    d = one(spark, maths.distribution(F.col("n"), F.col("p"), F.col("q"), F.col("w")), n=9, p=50, q=30, w=10)
    assert (d.content_slides, d.theory_slides, d.practical_slides, d.image_slides) == (5, 2, 3, 2) and d.warning.startswith("Input may be too short (10 words) for 9")
    assert one(spark, maths.spread(F.col("n"), F.col("k")), n=10, k=3) == [0, 3, 7]
    assert one(spark, maths.spread(F.col("n"), F.col("k")), n=10, k=0) == []


def test_colours_and_durations(spark):
    assert one(spark, maths.tint(F.col("c"), 0.5), c="#000080") == "#7F7FBF" and one(spark, maths.contrast(F.col("c")), c="#FFFF00") == "#000000"
    assert one(spark, t.duration_seconds(F.col("a")), a="1m30s") == 90 and one(spark, t.duration_seconds(F.col("a")), a="500ms") == 0.5


def test_front_matter_reads_a_line_once(spark):
    """The line is brought to its compared form once, not for each phrase."""
    plan = spark.range(1).select(t.touches_front_matter(F.concat(F.col("id").cast("string"), F.lit(" Contents:"))).alias("f"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("(?U)\\s+") == 1
    assert plan.first().f


def test_figure_score_thresholds(spark):
    s = lambda f, g: one(spark, maths.figure_score(F.col("f"), F.col("g")), f=f, g=g)
    assert s(["a", "b", "c"], ["a"]) == 0 and s(["a", "b", "c"], ["a", "b"]) > 0.9 and s(["a"], ["b"]) == 0


def test_spaced_calls_agree_with_one_pass(spark):
    """Any span gives the times of one pass over each key; nulls of key and time included."""
    from weftline.operators.model_output import spaced

    rows = [(i, ["a", "a", "b", None][i * 7 % 4], None if i % 40 == 0 else (i * 7919 % 3500) / 10 - 50) for i in range(600)]
    calls = spark.createDataFrame(rows, "id long, key string, at double")
    want = {}
    for key in ("a", "b", None):
        lead = None
        mine = sorted(((at, i) for i, k, at in rows if k == key), key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
        for n, (at, i) in enumerate(mine, 1):
            lead = lead if at is None else at - n * 3.5 if lead is None else max(lead, at - n * 3.5)
            want[i] = None if lead is None else lead + n * 3.5
    for span in (3600.0, 10.0):
        assert {r.id: r.start for r in spaced(calls, 3.5, span).collect()} == want
    assert spaced(calls.limit(0)).count() == 0
