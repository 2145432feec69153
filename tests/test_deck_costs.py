"""What decks are made of is computed once and only where it is shown; the shorter ways give what the plain ones give."""

import math
import random
import re

import plain
from pyspark.sql import functions as F

from weftline.functions import lexicons as lex
from weftline.functions import maths
from weftline.functions import text as t
from weftline.operators import deck, matching, planner


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bullets_are_brought_to_their_case_once(spark):
    """Each look at a refined bullet refined it again."""
    df = spark.createDataFrame([("a. b",), (" • *", ), (None,), ("ends here!",), ("w " * 29 + "w",), ("w, " * 31,), ("one two three four five six seven eight nine ten. " * 4,)], "x string")
    out = df.select("x", t.refine_bullet(F.col("x")).alias("r"))
    assert [r.r for r in out.collect()] == [plain.refined(r.x or "") for r in df.collect()]
    assert optimized(out).count("(?<=\\. )(?=[a-z])") == 1


def test_words_are_counted_without_an_array(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices(["a", "é𝄞", " ", "  ", "\n", "\t", "　", " ", ".", "\u0085", " "], k=rng.randrange(12))),) for _ in range(2000)] + [(None,)]
    out = spark.createDataFrame(rows, "x string").select("x", t.n_words("x").alias("n"), t.squeeze("x").alias("s"), F.trim(F.regexp_replace(F.coalesce("x", F.lit("")), "(?U)\\s+", " ")).alias("s0"), F.regexp_count(F.coalesce("x", F.lit("")), F.lit("(?U)\\S+")).alias("n0"))
    assert [r for r in out.collect() if r.n != r.n0 or r.s != r.s0] == []
    assert "regexp_extract_all" not in optimized(out.select("n")) and "regexp_count" not in optimized(out.select("n"))


def test_positions_of_both_pools(spark):
    """Each position takes the wanted pool, else what is left; no list grows with each step."""
    cases = [(i, n, k, a, b) for i, (n, k, a, b) in enumerate((n, k, a, b) for n in (1, 4, 7) for k in range(n + 1) for a in range(5) for b in range(5) if a + b)]
    slides = [(i, kind, j) for i, _, _, a, b in cases for kind, m in (("theory", a), ("practical", b)) for j in range(m)]
    asked = spark.createDataFrame([c[:3] for c in cases], "request_id int, content_slides int, theory_slides int")
    out = planner.placed(spark.createDataFrame(slides, "request_id int, kind string, i int"), asked)
    got = {}
    for r in out.orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append((r.pos, r.kind, r.i))
    for i, n, k, a, b in cases:
        wanted = {min(n - 1, round(j * (n / k))) for j in range(k)}
        left, want = {"theory": list(range(a)), "practical": list(range(b))}, []
        for pos in range(n):
            kind = "theory" if pos in wanted else "practical"
            kind = kind if left[kind] else "theory" if left["theory"] else "practical"
            if left[kind]:
                want.append((pos, kind, left[kind].pop(0)))
        assert got[i] == want, (n, k, a, b)
    assert "aggregate(" not in optimized(out)


def test_recaps_look_at_the_lines_they_show(spark):
    """Of a deck of many titles five lines are refined, the others are counted; refining came first."""
    rng, rows = random.Random(6), []
    said = ["**bold**", " ", "Repeat the steps below", "some words here. and more of them", "Topic 1: the label goes", "x" * 200, "long words, and " * 20]
    for deck_no in range(60):
        rows += [(deck_no, p, rng.choice([f"Topic {p}", "Topic 1", f"Topic {p % 4} — Part {p}"]), rng.choices(said, k=rng.randrange(4))) for p in range(rng.randrange(1, 14))]
    out = deck.recap(spark.createDataFrame(rows, "request_id long, pos int, title string, bullets array<string>"))
    got = {r.request_id: r.bullets for r in out.collect()}
    for deck_no in range(60):
        want = {}
        for _, _, title, bullets in (r for r in rows if r[0] == deck_no):
            base = re.sub(t.PART_MARK, "", title).strip()
            want.setdefault(base, f"**{base}:** {plain.recap_line(base, bullets)}")
        lines = list(want.values())
        assert got[deck_no] == (lines if len(lines) <= lex.RECAP_LINES else [*lines[: lex.RECAP_LINES - 1], f"... and {len(lines) - lex.RECAP_LINES + 1} more key points"]), deck_no
    plan = optimized(out)
    assert plan.index("•") < plan.index("Filter ((n#") and {len(b) for b in got.values()} >= {1, lex.RECAP_LINES}


def test_words_of_figures_are_told_once(spark):
    """Each pair of a figure and a slide built sets of their words."""
    rng = random.Random(9)
    words = ["loss", "train", "the", "steps", "Data", "K", "of-the", "x", "größe", "graph"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    slides = [(d, p, rng.choice(["", "3. Results (a)", line(2)]), [line(6), "**b** " + line(3)]) for d in range(12) for p in range(8)]
    figures = [(d, i, rng.choice([None, line(1), line(5)]), rng.choice([None, "", "Results", line(1)])) for d in range(1, 13) for i in range(20)]
    out = matching.figure_matches(spark.createDataFrame(slides, "request_id long, pos int, title string, bullets array<string>"), spark.createDataFrame(figures, "request_id long, figure_no int, caption string, section string"))
    assert "array_intersect" not in optimized(out) and out.schema.simpleString() == "struct<request_id:bigint,pos:int,figure_no:int,score:double>"
    got = {}
    for r in out.collect():
        got.setdefault(r.request_id, {})[r.pos] = (r.figure_no, r.score)
    for d in range(13):
        said = lambda *x: " ".join(filter(None, x))
        assert got.get(d, {}) == plain.matched([s[1:] for s in slides if s[0] == d], [(f[1], said(f[2]), said(f[3])) for f in figures if f[0] == d] if 0 < d < 12 else []), d


def plain_size(bullets, width, height, base, least):
    size = base
    while size >= least:
        room = lambda em: max(int(width * 72 / (0.55 * em)), 8)
        n = sum(max(1, math.ceil(len(b) / room(size + 3 if b.startswith("**") else size))) for b in bullets if b)
        if (n * size * 1.22 + max(3.0, size * 0.45) * max(n - 1, 0)) / 72 <= height * 0.94:
            return size
        size -= 0.5
    return least


def test_lines_are_measured_once(spark):
    """Every size measured every line three times."""
    rng = random.Random(4)
    rows = [([rng.choice(["", "**", "é"]) + "x" * rng.choice([0, 5, 80, 400, 2000]) for _ in range(rng.randrange(9))],) for _ in range(300)]
    df = spark.createDataFrame(rows, "b array<string>")
    for box in ((9.0, 4.5, 20.0, 9.0), (3.0, 1.0, 12.0, 10.0)):
        out = df.select("b", maths.fitted_size(F.col("b"), *box).alias("size"))
        assert [r.size for r in out.collect()] == [plain_size(r.b, *box) for r in out.collect()]
        assert optimized(out).count("length(") == 1
    assert len({plain_size(b, 9.0, 4.5, 20.0, 9.0) for (b,) in rows}) > 5
