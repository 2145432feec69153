"""Figures of paged documents: boxes joined through a grid, clusters of drawn boxes, images and tables, with captions and sections.

Boxes have x0, y0, x1, y1 in points, y downwards, and belong to a page: (doc_id, page). Boxes with a
null side are left out. Boxes meet in cells of the page; only the boxes of pages with PAGE_DRAWINGS
of them or fewer are gathered by page, to be clustered. Tables of pages grow with the input, so
joins with them are merged and never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import lexicons as lex
from weftline.operators import geometry
from weftline.plans.inputs import kept

#: Gaps and bands in points, least pixels, shares of a page's area, least items, and most figures of a page and of a document.
GAP, LABEL_BAND, PAD = 16.0, 34.0, 6.0
MIN_PIXELS, RASTER_AREA, VECTOR_AREA, MOST_AREA = (140, 100), 0.008, 0.012, 0.86
MIN_ITEMS, PAGE_FIGURES, DOC_FIGURES, PAGE_DRAWINGS = 3, 3, 60, 4000
#: Side of a cell of the grid.
CELL = 64.0

PAGE = ["doc_id", "page"]
SIDES = ("x0", "y0", "x1", "y1")


def touches(a: str, b: str, slack: float = 0.0) -> Column:
    """Whether boxes of two aliases overlap, touch or are ``slack`` points apart at most, in either direction."""
    c = lambda x, y: F.col(f"{x}.{y}")
    return (c(a, "x0") <= c(b, "x1") + slack) & (c(b, "x0") <= c(a, "x1") + slack) & (c(a, "y0") <= c(b, "y1") + slack) & (c(b, "y0") <= c(a, "y1") + slack)


def touching(a: DataFrame, b: DataFrame, slack: float = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs of boxes of one page that touch within ``slack``, each pair once: a join of aliases a and b, by cells.

    Boxes of a are grown by slack and dealt to all cells that they meet, as are those of b; a pair
    is kept in the one cell that holds the upper left corner of what both cover. A hot page is
    spread over its cells.
    """
    cut = lambda v: F.floor(v / cell)

    def dealt(df: DataFrame, name: str, grow: float) -> DataFrame:
        x, y = (F.explode(F.sequence(cut(F.col(lo) - grow), cut(F.col(hi) + grow))) for lo, hi in (("x0", "x1"), ("y0", "y1")))
        known = df.where(" and ".join(f"{s} is not null" for s in SIDES) + " and x0 <= x1 and y0 <= y1")
        return known.withColumn("_x", x).withColumn("_y", y).alias(name)

    left, right = dealt(a, "a", slack), dealt(b, "b", 0.0)
    corner = lambda s: cut(F.greatest(F.col(f"a.{s}") - slack, F.col(f"b.{s}")))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*PAGE, "_x", "_y")]
    here = (F.col("a._x") == corner("x0")) & (F.col("a._y") == corner("y0"))
    on = touches("a", "b", slack) & here
    for s in same:
        on = s & on
    return left.join(right.hint("merge"), on)


def untouched(a: DataFrame, b: DataFrame, slack: float, key: list[str]) -> DataFrame:
    """Boxes of a, known by ``key``, that no box of b on their page touches within slack."""
    hit = touching(a, b, slack).select(*(F.col(f"a.{k}") for k in key)).distinct()
    return a.join(hit.hint("merge"), key, "left_anti")


#: Boxes of a page from which on it is clustered by itself and not in pairs with others.
ALONE = 512


def merged(low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """For each box of one page, given by its lower and upper sides, the number of a box of its cluster.

    A box takes in all that its hull meets until that meets nothing; its hull then stands for them
    and may be taken in by a later one.
    """
    low, high, to = low.copy(), high.copy(), np.arange(low.shape[1])
    for i in range(len(to)):
        if to[i] != i:
            continue
        while True:
            met = ((low <= high[:, i : i + 1] + gap) & (low[:, i : i + 1] <= high + gap)).all(axis=0)
            met[i] = False
            at = np.flatnonzero(met)
            if not len(at):
                break
            to[at] = i
            low[:, i], high[:, i] = np.minimum(low[:, i], low[:, at].min(axis=1)), np.maximum(high[:, i], high[:, at].max(axis=1))
            low[:, at] = np.nan  # meets nothing more
    while (to != to[to]).any():
        to = to[to]
    return to


def merged_by_page(page: np.ndarray, low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """As ``merged`` for many pages at once, whose numbers ascend: all pairs of boxes of a page are compared, then those of their hulls."""
    low, high, to = low.copy(), high.copy(), np.arange(len(page))
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else to
    sizes = np.diff(np.r_[starts, len(page)])
    for start, n in zip(starts[sizes > ALONE], sizes[sizes > ALONE], strict=True):
        to[start : start + n] = start + merged(low[:, start : start + n], high[:, start : start + n], gap)
    live = np.flatnonzero(np.repeat(sizes <= ALONE, sizes))
    while len(live):
        _, first, n = np.unique(page[live], return_index=True, return_counts=True)
        after = np.repeat(first + n, n) - np.arange(len(live)) - 1
        a = np.repeat(np.arange(len(live)), after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        a, b = live[a], live[b]
        near = np.ones(len(a), bool)
        for lo, hi in zip(low, high, strict=True):
            near &= (lo[a] <= hi[b] + gap) & (lo[b] <= hi[a] + gap)
        a, b = a[near], b[near]
        if not len(a):
            break
        own = np.arange(len(page))
        while True:
            before = own.copy()
            np.minimum.at(own, b, own[a])
            np.minimum.at(own, a, own[b])
            own = own[own]
            if (own == before).all():
                break
        for lo, hi in zip(low, high, strict=True):
            np.minimum.at(lo, own[live], lo[live])
            np.maximum.at(hi, own[live], hi[live])
        to = own[to]
        live = live[(own[live] == live) & np.isin(page[live], page[a])]
    return to


def _numbered(keys: pa.Table) -> np.ndarray:
    """Rows numbered by their runs of equal keys, nulls being equal."""
    new = np.zeros(max(len(keys) - 1, 0), bool)
    for c in keys.columns:
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return np.r_[0, np.cumsum(new)][: len(keys)]


def rect_clusters(rects: DataFrame, gap: float = GAP, gathered: int = PAGE_DRAWINGS) -> DataFrame:
    """(doc_id, page, cluster, x0, y0, x1, y1, items, first): boxes within gap of each other become one, and what they make meets again, until nothing does.

    rects: doc_id, page, x0, y0, x1, y1, items, and rect_no if there is one: ``first`` is the least
    of a cluster, else null. Clusters are numbered from 0 by their corners.

    What comes out does not depend on the order of merging, so pages with ``gathered`` boxes at most
    are clustered in one step, many in a task; larger ones go through ``_clusters_in_rounds``.
    """
    first = F.col("rect_no").cast("long") if "rect_no" in rects.columns else F.lit(None).cast("long")
    boxes = rects.select(*PAGE, *(F.col(s).cast("double").alias(s) for s in SIDES), F.col("items").cast("long"), first.alias("first")).where("x0 <= x1 and y0 <= y1")
    large = boxes.groupBy(*PAGE).count().where(F.col("count") > gathered).select(*PAGE)
    out = T.StructType([*boxes.select(*PAGE).schema.fields, T.StructField("cluster", T.IntegerType()), *boxes.select(*SIDES, "items", "first").schema.fields])

    def hulls(rows: pa.Table, page: np.ndarray) -> pa.RecordBatch:
        low, high = (np.vstack([rows[c].to_numpy() for c in pair]) for pair in (("x0", "y0"), ("x1", "y1")))
        own, at = np.unique(merged_by_page(page, low, high, gap), return_inverse=True)
        least, most = low[:, own], high[:, own]
        for side in range(2):
            np.minimum.at(least[side], at, low[side])
            np.maximum.at(most[side], at, high[side])
        sums = rows.select(["items", "first"]).append_column("at", pa.array(at)).group_by("at", use_threads=False).aggregate([("items", "sum"), ("first", "min")]).sort_by("at")
        order = np.lexsort((most[1], most[0], least[1], least[0], page[own]))
        number = np.arange(len(own)) - np.searchsorted(page[own], page[own])
        key = [rows[c].take(pa.array(own)).combine_chunks() for c in PAGE]
        cols = [*key, pa.array(number.astype(np.int32)), *(pa.array(v[order]) for v in (least[0], least[1], most[0], most[1])), *(sums[c].take(pa.array(order)).combine_chunks() for c in ("items_sum", "first_min"))]
        return pa.RecordBatch.from_arrays(cols, names=out.names)

    def by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by page; the last page of a batch waits for the next one."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            page = _numbered(rows.select(PAGE).combine_chunks())
            done = int(np.searchsorted(page, page[-1])) if len(page) else 0
            if done:
                yield hulls(rows.slice(0, done), page[:done])
            held = rows.slice(done)
        if held is not None and len(held):
            yield hulls(held, np.zeros(len(held), np.int64))

    def in_tasks(some: DataFrame) -> DataFrame:
        return some.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(by_page, out)

    if large.isEmpty():
        return in_tasks(boxes)
    large = kept(large, "large")
    some = in_tasks(boxes.join(large.hint("merge"), PAGE, "left_anti"))
    return some.unionByName(_clusters_in_rounds(boxes.join(large.hint("merge"), PAGE, "left_semi"), gap))


def _clusters_in_rounds(boxes: DataFrame, gap: float) -> DataFrame:
    """As ``rect_clusters``, for pages too large to be gathered.

    Boxes whose corners lie in one square of side gap are within gap of each other, so those are
    merged by an aggregate, and the square names what they make. Squares that touch through the grid
    point to the neighbour with the least hash, pointers are followed once more, and boxes of one
    pointer merge, so that pieces shrink by a share each round. Where what is made reaches boxes that
    were out of reach, each such step takes a round. A round is written; it goes on with the pages
    where boxes met, and ends where none did.
    """
    hull = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("items").alias("items"), F.min("first").alias("first")]
    square = F.struct(F.floor(F.col("x0") / gap).alias("x"), F.floor(F.col("y0") / gap).alias("y"))
    done = None
    while True:
        boxes = kept(boxes.groupBy(*PAGE, square.alias("id")).agg(*hull), "boxes")
        pairs = touching(boxes, boxes.alias("other"), gap).where("a.id <> b.id")
        rank = lambda i: F.struct(F.xxhash64(i, *PAGE), i)
        near = pairs.select(*(F.col(f"a.{k}") for k in PAGE), F.col("a.id").alias("id"), F.col("b.id").alias("other"))
        to = kept(near.groupBy(*PAGE, "id").agg(F.min_by("other", rank(F.col("other"))).alias("to")), "pointers")
        settled = kept(boxes.join(to.select(*PAGE).distinct().hint("merge"), PAGE, "left_anti").drop("id"), "settled")
        done = settled if done is None else done.unionByName(settled)
        if to.isEmpty():
            break
        boxes = boxes.join(to.select(*PAGE).distinct().hint("merge"), PAGE, "left_semi")
        to = to.withColumn("to", F.when(rank(F.col("to")) < rank(F.col("id")), F.col("to")).otherwise(F.col("id")))
        jump = to.select(*PAGE, F.col("id").alias("to"), F.col("to").alias("over"))
        root = to.join(jump.hint("merge"), [*PAGE, "to"]).select(*PAGE, "id", F.col("over").alias("root"))
        boxes = boxes.join(root.hint("merge"), [*PAGE, "id"], "left").groupBy(*PAGE, F.coalesce("root", "id").alias("root")).agg(*hull)
    order = Window.partitionBy(*PAGE).orderBy(*SIDES)
    return done.select(*PAGE, (F.row_number().over(order) - 1).alias("cluster"), *SIDES, "items", "first")


def with_labels(clusters: DataFrame, lines: DataFrame, band: float = LABEL_BAND, along: tuple[str, str] = ("y0", "y1")) -> DataFrame:
    """Clusters widened by the lines near them, in order, but for captions.

    A line within ``band`` of a cluster's height whose extent ``along`` lies within ``band`` of the
    cluster's width, as it then is, widens it. The reference compares the heights of lines, all that
    it keeps of them; give ("x0", "x1") where lines have a place along the page. Only the extents of
    the lines in the band are gathered, by cluster.
    """
    lo, hi = along
    here = lines.where(~F.coalesce("text", F.lit("")).rlike(lex.CAPTION)).select(*PAGE, "line_no", F.col("y0").alias("l0"), F.col("y1").alias("l1"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"))
    size = 4 * band
    rows = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    c = clusters.select(*PAGE, "cluster", F.col("y0").alias("c0"), F.col("y1").alias("c1")).withColumn("row", rows(F.col("c0") - band, F.col("c1") + band))
    at = here.where("l0 <= l1 and lo is not null and hi is not null").withColumn("row", rows(F.col("l0"), F.col("l1")))
    # a pair in the first row of both only
    met = c.join(at.hint("merge"), [*PAGE, "row"]).where((F.col("l1") >= F.col("c0") - band) & (F.col("l0") <= F.col("c1") + band) & (F.col("row") == F.floor(F.greatest(F.col("c0") - band, F.col("l0")) / size)))
    near = met.groupBy(*PAGE, "cluster").agg(F.array_sort(F.collect_list(F.struct("line_no", "lo", "hi"))).alias("near"))

    def widened(w: Column, x: Column) -> Column:
        inside = (x["lo"] > w["x0"] - band) & (x["hi"] < w["x1"] + band)
        return F.when(inside, F.struct(F.least(w["x0"], x["lo"]).alias("x0"), F.greatest(w["x1"], x["hi"]).alias("x1"))).otherwise(w)

    wide = F.aggregate(F.coalesce("near", F.array().cast("array<struct<line_no:int,lo:double,hi:double>>")), F.struct("x0", "x1"), widened)
    out = clusters.join(near.withColumn("near", F.col("near").cast("array<struct<line_no:int,lo:double,hi:double>>")).hint("merge"), [*PAGE, "cluster"], "left").withColumn("w", wide)
    return out.select(*PAGE, "cluster", F.col("w.x0").alias("x0"), "y0", F.col("w.x1").alias("x1"), "y1", *(c for c in ("items", "first") if c in clusters.columns))


def area(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes with ``share``, their part of the page's area, and the page's width and height; pages: doc_id, page, width, height."""
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    whole = F.greatest(F.col("page_width") * F.col("page_height"), F.lit(1.0))
    return df.join(pages.select(*PAGE, F.col("width").cast("double").alias("page_width"), F.col("height").cast("double").alias("page_height")).hint("merge"), PAGE).withColumn("share", w * h / whole)


def usable_rasters(rasters: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Images that may be figures: large enough in pixels, a fitting share of the page, off every table, and the first two of a document with the same content.

    rasters: doc_id, page, raster_no (unique in a page), x0..y1, width, height (0 or null: not
    known), sha1. Uses are counted in the order of page and raster_no, of images that pass the rest.
    """
    known = F.coalesce("width", F.lit(0)) > 0
    sized = rasters.where(~known | ((F.col("width") >= MIN_PIXELS[0]) & (F.coalesce("height", F.lit(0)) >= MIN_PIXELS[1])))
    fitting = area(sized, pages).where(F.col("share").between(RASTER_AREA, MOST_AREA)).drop("share", "page_width", "page_height")
    free = untouched(fitting, tables, 4.0, [*PAGE, "raster_no"])
    use = F.row_number().over(Window.partitionBy("doc_id", "sha1").orderBy("page", "raster_no"))
    return free.withColumn("use", use).where("use <= 2").drop("use")


def vector_figures(drawings: DataFrame, lines: DataFrame, tables: DataFrame, rasters: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, first, x0, y0, x1, y1): clusters of drawn boxes that are charts, padded, PAGE_FIGURES with the page's images at most.

    drawings: doc_id, page, rect_no (unique in a page), x0..y1, items; pages with more than
    PAGE_DRAWINGS of them have none. Thin boxes count from a length of 8 points. A chart has a
    fitting share of the page, is off tables, images and the charts before it, by the order of its
    first box, and MIN_ITEMS items of the boxes that it touches. Each chart of a page is one step:
    the first of those left that touch none taken.
    """
    few = drawings.groupBy(*PAGE).count().where(F.col("count") <= PAGE_DRAWINGS).drop("count")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = drawings.join(few.hint("merge"), PAGE, "left_semi").where((w * h >= 2.0) | (F.greatest(w, h) >= 8.0))
    clusters = kept(with_labels(rect_clusters(boxes), lines), "grown")
    fitting = area(clusters, pages).where(F.col("share").between(VECTOR_AREA, MOST_AREA))
    key = [*PAGE, "cluster"]
    free = untouched(untouched(fitting, tables, 2.0, key), rasters, 6.0, key)
    items = touching(free, boxes, 2.0).groupBy(*(F.col(f"a.{k}").alias(k) for k in key)).agg(F.sum("b.items").alias("n"))
    room = rasters.groupBy(*PAGE).agg((F.lit(PAGE_FIGURES) - F.count("*")).alias("room"))
    pad = lambda side, by, bound: (F.greatest if by < 0 else F.least)(F.col(side) + by, bound)
    clip = {"x0": pad("x0", -PAD, F.lit(0.0)), "y0": pad("y0", -PAD, F.lit(0.0)), "x1": pad("x1", PAD, F.col("page_width")), "y1": pad("y1", PAD, F.col("page_height"))}
    left = free.join(items.where(F.col("n") >= MIN_ITEMS).hint("merge"), key, "left_semi").join(room.hint("merge"), PAGE, "left").withColumn("clip", F.struct(*(e.alias(s) for s, e in clip.items())))
    left = kept(left.select(*key, *SIDES, "first", "clip", F.coalesce("room", F.lit(PAGE_FIGURES)).alias("room")), "charts")
    taken = None
    for step in range(PAGE_FIGURES):
        one = kept(left.where(F.col("room") > step).groupBy(*PAGE).agg(F.min_by(F.struct("clip", "first"), F.struct("first", "cluster")).alias("one")), "taken").select(*PAGE, "one.clip.*", "one.first")
        taken = one if taken is None else taken.unionByName(one)
        left = kept(untouched(left.join(one.select(*PAGE).hint("merge"), PAGE, "left_semi"), one, 6.0, key), "charts")
    return taken


def sections(figures: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, figure_no, section): the lowest heading of the page at or above the figure's top (6 points of slack), the first of equals; else the page's first heading, else that of the last page before with one; else ''.

    figures: doc_id, figure_no, page, y0; headings: doc_id, page, heading_no, text, y.
    """
    none = lambda kind: F.lit(None).cast(kind)
    h = headings.where("text is not null and y is not null").select(*PAGE, "y", F.lit(0).alias("k"), (-F.col("heading_no")).cast("long").alias("no"), "text", none("long").alias("figure_no"))
    f = figures.select(*PAGE, (F.col("y0") + 6).alias("y"), F.lit(1).alias("k"), F.lit(0).cast("long").alias("no"), none("string").alias("text"), F.col("figure_no").cast("long").alias("figure_no"))
    above = F.last("text", ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("y", "k", "no"))
    own = h.unionByName(f).withColumn("own", above).where("k = 1").select(*PAGE, "figure_no", "own")
    opening = headings.groupBy(*PAGE).agg(F.min_by("text", "heading_no").alias("opening"))
    pages = own.select(*PAGE).distinct().join(opening.hint("merge"), PAGE, "full")
    running = pages.withColumn("running", F.last("opening", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page"))).select(*PAGE, "running")
    return own.join(running.hint("merge"), PAGE).select("doc_id", "figure_no", F.coalesce("own", "running", F.lit("")).alias("section"))


def lifted(pages: DataFrame, lines: DataFrame, headings: DataFrame, tables: DataFrame, rasters: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, figure_no, page, kind, x0, y0, x1, y1, caption, section): the figures of every document, in reading order, numbered from 1.

    pages: doc_id, page, width, height, preliminary; lines: doc_id, page, line_no, text, y0, y1;
    headings: doc_id, page, heading_no, text, y; tables: doc_id, page, table_no, x0..y1, n_rows; for
    rasters and drawings see above. Preliminary pages have no figures and lend no headings. A
    table of two rows or more is a figure; on each page tables come first, then images and charts by
    their tops. From DOC_FIGURES figures on, no page is begun and no image or chart taken.
    """
    shown = kept(pages.where(~F.coalesce("preliminary", F.lit(False))), "pages")
    on = lambda df: df.join(shown.select(*PAGE).hint("merge"), PAGE, "left_semi")
    tables = kept(on(tables.where("n_rows >= 2")), "tables")
    images = kept(usable_rasters(on(rasters), tables, shown), "images")
    charts = vector_figures(on(drawings), lines, tables, images, shown)
    number = lambda name: F.col(name).cast("long").alias("no")
    found = [tables.select(*PAGE, *SIDES, F.lit("table").alias("kind"), F.lit(0).alias("turn"), F.lit(0.0).alias("top"), number("table_no"))]
    found += [df.select(*PAGE, *SIDES, F.lit(kind).alias("kind"), F.lit(1).alias("turn"), F.col("y0").alias("top"), number(no)) for df, kind, no in ((images, "photo", "raster_no"), (charts, "chart", "first"))]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    order = ["page", "turn", "top", F.when(F.col("kind") == "photo", 0).otherwise(1), "no"]
    doc = Window.partitionBy("doc_id")
    before = F.coalesce(F.count("*").over(doc.orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(doc.orderBy(*order))
    counted = rows.withColumn("n", n).withColumn("before", before).where(F.when(F.col("turn") == 0, F.col("before") < DOC_FIGURES).otherwise(F.col("n") <= DOC_FIGURES))
    figures = kept(counted.select("doc_id", F.row_number().over(doc.orderBy("n")).alias("figure_no"), "page", "kind", *SIDES), "figures")
    named = figures.join(geometry.captions(figures, lines).hint("merge"), ["doc_id", "figure_no"], "left").join(sections(figures, on(headings)).hint("merge"), ["doc_id", "figure_no"], "left")
    return named.select("doc_id", "figure_no", "page", "kind", *SIDES, F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("section", F.lit("")).alias("section"))
