"""Figures, clusters and labels of whole tables against plain versions of the rules, page by page."""

import random
import re
from collections import Counter, defaultdict

import pytest

from weftline.operators import figures, geometry
from weftline.plans import layout_queries

CAPTION = re.compile(r"^\s*(figure|fig\.?|abbildung|tabelle|table|chart|diagram|exhibit|graph|scheme|plate|image|listing|schaubild|diagrama|figura)\s*[\d]+(?:[.\-][\d]+)*\s*[.:)\-–—]?\s+", re.I)
BOX = "doc_id long, page int, rect_no int, x0 double, y0 double, x1 double, y1 double, items long"


def touch(a, b, slack):
    return a[0] <= b[2] + slack and b[0] <= a[2] + slack and a[1] <= b[3] + slack and b[1] <= a[3] + slack


def plain_clusters(boxes, gap=16.0):
    """Boxes (x0, y0, x1, y1, items, no): any two that are near become one, until none are."""
    todo, done = list(boxes), []
    while todo:
        c = todo.pop()
        near = next((o for o in todo + done if touch(c, o, gap)), None)
        if near is None:
            done.append(c)
            continue
        (todo if near in todo else done).remove(near)
        todo.append((min(c[0], near[0]), min(c[1], near[1]), max(c[2], near[2]), max(c[3], near[3]), c[4] + near[4], min(c[5], near[5])))
    return sorted(done)


def plain_growth(c, lines, band=34.0):
    x0, y0, x1, y1 = c[:4]
    for text, l0, l1 in lines:
        if l1 >= y0 - band and l0 <= y1 + band and not CAPTION.match(text) and l0 > x0 - band and l1 < x1 + band:
            x0, x1 = min(x0, l0), max(x1, l1)
    return (x0, y0, x1, y1, *c[4:])


def plain_caption(box, lines):
    best = above = None
    for text, l0, l1 in lines:
        gap = 0.0 if box[1] - 46 <= l0 and l1 <= box[3] + 46 else box[1] - l1 if l1 <= box[1] else l0 - box[3] if l0 >= box[3] else 0.0
        if gap <= 46 and CAPTION.match(text) and (best is None or gap < best[0]):
            best = gap, text
        if box[1] - 42 <= l1 <= box[1] and (above is None or box[1] - l1 < above[0]):
            above = box[1] - l1, text
    return (best or above or (0, ""))[1]


def plain_figures(at):
    """(doc, page, kind, box, caption, section) in order, of layouts as lists of rows."""
    by = {name: defaultdict(list) for name in at}
    order = {"lines": "line_no", "headings": "heading_no", "tables": "table_no", "rasters": "raster_no", "drawings": "rect_no", "pages": "page"}
    for name, rows in at.items():
        for r in sorted(rows, key=lambda r: r[order[name]]):
            by[name][r["doc_id"], r["page"]].append(r)
    box = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])
    share = lambda b, p: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) / (p["width"] * p["height"])
    out, state = [], defaultdict(lambda: {"n": 0, "running": "", "uses": Counter()})
    for (doc, page), (p,) in sorted(by["pages"].items()):
        s = state[doc]
        if s["n"] >= 60 or p["preliminary"]:
            continue
        heads = [(h["text"], h["y"]) for h in by["headings"][doc, page]]
        s["running"] = heads[0][0] if heads else s["running"]
        section = lambda top: max(([h for h in heads if h[1] <= top + 6]), key=lambda h: h[1], default=(s["running"],))[0]  # noqa: E731, B023
        lines = [(x["text"], x["y0"], x["y1"]) for x in by["lines"][doc, page]]
        tables = [box(t) for t in by["tables"][doc, page] if t["n_rows"] >= 2]
        for b in tables:
            out.append((doc, page, "table", b, plain_caption(b, lines), section(b[1])))
            s["n"] += 1
        found = []
        for r in by["rasters"][doc, page]:
            small = r["width"] and (r["width"] < 140 or r["height"] < 100)
            if small or not 0.008 <= share(box(r), p) <= 0.86 or any(touch(box(r), t, 4.0) for t in tables):
                continue
            s["uses"][r["sha1"]] += 1
            if s["uses"][r["sha1"]] <= 2:
                found.append(("photo", box(r)))
        drawn = by["drawings"][doc, page]
        rects = [(*box(d), d["items"], d["rect_no"]) for d in drawn if (d["x1"] - d["x0"]) * (d["y1"] - d["y0"]) >= 2 or max(d["x1"] - d["x0"], d["y1"] - d["y0"]) >= 8] if len(drawn) <= 4000 else []
        for c in sorted(plain_clusters(rects), key=lambda c: c[5]):
            c = plain_growth(c, lines)
            if not 0.012 <= share(c, p) <= 0.86 or any(touch(c, t, 2.0) for t in tables) or any(touch(c, b, 6.0) for _, b in found):
                continue
            if sum(r[4] for r in rects if touch(c, r, 2.0)) < 3:
                continue
            if len(found) >= 3:
                break
            found.append(("chart", (max(0.0, c[0] - 6), max(0.0, c[1] - 6), min(p["width"], c[2] + 6), min(p["height"], c[3] + 6))))
        for kind, b in sorted(found, key=lambda f: f[1][1]):
            if s["n"] < 60:
                out.append((doc, page, kind, b, plain_caption(b, lines), section(b[1])))
                s["n"] += 1
    return out


def listed(df):
    return [(r.doc_id, r.page, r.kind, (r.x0, r.y0, r.x1, r.y1), r.caption, r.section) for r in df.orderBy("doc_id", "figure_no").collect()]


def test_figures_of_whole_tables(spark):
    at = layout_queries.layout(spark, "/root/testdata/sf0.01")
    want = plain_figures({name: [r.asDict() for r in df.collect()] for name, df in at.items()})
    got = figures.lifted(**at)
    assert listed(got) == want and len({w[2] for w in want}) == 3
    assert all(r.a == r.b == r.c for r in got.groupBy("doc_id").agg({"figure_no": "max", "*": "count"}).selectExpr("`max(figure_no)` a", "`count(1)` b", "`count(1)` c").collect())


def test_clusters_of_whole_tables(spark):
    at = layout_queries.layout(spark, "/root/testdata/sf0.01")
    pages, lines = defaultdict(list), defaultdict(list)
    for r in at["drawings"].collect():
        pages[r.doc_id, r.page].append((r.x0, r.y0, r.x1, r.y1, r["items"], r.rect_no))
    for r in sorted(at["lines"].collect(), key=lambda r: r.line_no):
        lines[r.doc_id, r.page].append((r.text, r.y0, r.y1))
    got = layout_queries.grown_clusters(spark, "/root/testdata/sf0.01").collect()
    want = {(k, i): plain_growth(c, lines[k]) for k, boxes in pages.items() for i, c in enumerate(plain_clusters(boxes))}
    assert {((r.doc_id, r.page), r.cluster): (r.x0, r.y0, r.x1, r.y1, r["items"], r.first) for r in got} == want


@pytest.mark.parametrize("shape", ["chain", "copies", "nested", "random", "far"])
def test_clusters_of_shapes(spark, shape):
    rng = random.Random(2)
    boxes = {
        "chain": [(20.0 * i, 20.0 * i, 20.0 * i + 6, 20.0 * i + 6) for i in range(120)],  # each near the next alone
        "copies": [(5.0, 5.0, 9.0, 9.0)] * 500 + [(300.0, 5.0, 300.0, 400.0)] * 500,
        "nested": [(0.0, 0.0, 500.0, 1.0), (0.0, 0.0, 1.0, 500.0), (250.0, 250.0, 260.0, 260.0), (-700.0, -50.5, -690.0, -40.0)],
        "random": [(x := rng.uniform(-300, 900), y := rng.uniform(-300, 900), x + rng.uniform(0, 60), y + rng.uniform(0, 60)) for _ in range(150)],
        "far": [(0.0, 0.0, 1.0, 1.0), (17.0, 0.0, 18.0, 1.0), (34.1, 0.0, 35.0, 1.0)],
    }[shape]
    rows = [(1, 0, i, *b, 1) for i, b in enumerate(boxes)]
    df = spark.createDataFrame([*rows, (2, 0, 0, None, 1.0, 2.0, 2.0, 1), (None, 0, 0, 0.0, 0.0, 1.0, 1.0, 1)], BOX)
    got = sorted((r.x0, r.y0, r.x1, r.y1, r["items"], r.first) for r in figures.rect_clusters(df).collect() if r.doc_id == 1)
    assert got == plain_clusters([(*b, 1, i) for i, b in enumerate(boxes)])
    assert figures.rect_clusters(df.limit(0)).collect() == []


def test_pages_in_tasks_and_in_rounds(spark):
    """Pages gathered in tasks, whole or cut by a batch, and pages taken in rounds have the same clusters; the former without a job a round."""
    rng = random.Random(5)
    sizes = {1: 1, 2: 40, 3: 700, 4: 5, 5: 130, None: 3}
    rows = [(d, p, i, x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + rng.uniform(0, 30), y + rng.uniform(0, 30), rng.choice([1, 2, None])) for d, n in sizes.items() for p in (0, 1) for i in range(n)]
    df = spark.createDataFrame(rows, BOX)
    told = lambda c: sorted(((r.doc_id, *map(str, r)) for r in c.collect() if r.doc_id is not None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = told(figures.rect_clusters(df))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == told(figures.rect_clusters(df, gathered=0)) == told(figures.rect_clusters(df, gathered=100))
    assert len(got) > 100
    null = [r for r in figures.rect_clusters(df).collect() if r.doc_id is None]
    assert len(null) == sum(len(plain_clusters([(*r[3:7], 1, r[2]) for r in rows if r[0] is None and r[1] == p])) for p in (0, 1))


def test_boxes_meet_once(spark):
    rng = random.Random(4)
    a, b = ([(1, i % 2, i, x := rng.uniform(-200, 500), y := rng.uniform(0, 500), x + rng.choice([0, 3, 400]), y + rng.choice([0, 5, 300]), 1) for i in range(80)] for _ in range(2))
    for slack in (0.0, 7.0):
        got = [(r.i, r.j) for r in figures.touching(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), slack).selectExpr("a.rect_no i", "b.rect_no j").collect()]
        assert sorted(got) == sorted((x[2], y[2]) for x in a for y in b if x[1] == y[1] and touch(x[3:7], y[3:7], slack))


def test_no_figures(spark):
    at = {k: v.limit(0) for k, v in layout_queries.layout(spark, "/root/testdata/sf0.001").items()}
    assert figures.lifted(**at).collect() == []


def test_at_most_sixty_figures(spark):
    """Tables of a begun page all count; images stop at sixty; no page is begun from sixty on."""
    pages = spark.createDataFrame([(1, p, 600.0, 800.0, False) for p in range(4)], "doc_id long, page int, width double, height double, preliminary boolean")
    table = lambda p, i: (1, p, i, 0.0, 12.0 * i, 10.0, 12.0 * i + 5, 2)
    tables = spark.createDataFrame([table(0, i) for i in range(30)] + [table(1, i) for i in range(29)] + [table(2, i) for i in range(5)] + [table(3, 0)], BOX.replace("rect_no", "table_no").replace("items", "n_rows"))
    rasters = spark.createDataFrame([(1, p, 0, 300.0, 100.0, 500.0, 300.0, 500, 500, f"h{p}") for p in (1, 2)], "doc_id long, page int, raster_no int, x0 double, y0 double, x1 double, y1 double, width int, height int, sha1 string")
    at = layout_queries.layout(spark, "/root/testdata/sf0.001")
    args = dict(pages=pages, tables=tables, rasters=rasters, lines=at["lines"].limit(0), headings=at["headings"].limit(0), drawings=at["drawings"].limit(0))
    got = Counter((r.page, r.kind) for r in figures.lifted(**args).collect())
    assert got == {(0, "table"): 30, (1, "table"): 29, (1, "photo"): 1}
    more = Counter((r.page, r.kind) for r in figures.lifted(**args | {"rasters": rasters.where("page = 2")}).collect())
    assert more == {(0, "table"): 30, (1, "table"): 29, (2, "table"): 5}


def test_lines_are_joined_natively(spark):
    rows = [["a-", "b"], ["a -", "b"], ["Ends.", "lower"], ["open", "élan"], ["  x  y ", " ", None, "­"], ["! cap", "next"], ["- item", "more", "on"]]
    got = [r.j for r in spark.createDataFrame([(r,) for r in rows], "b array<string>").select(geometry.joined_lines("b").alias("j")).collect()]
    assert got == [["ab"], ["a - b"], ["Ends.", "lower"], ["open élan"], ["x y"], ["! cap", "next"], ["- item", "more on"]]
