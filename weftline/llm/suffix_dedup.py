"""Exact repeated-passage removal: a sparse enhanced suffix array whose common-prefix intervals give maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import BYTE_VALUES, Rolling, discard, mix, signed, slices, text_bytes, written

#: Parameters: bytes of a repeat at least, bytes that name an anchor, different contexts that one suffix array takes.
LENGTH = 400
GRAM = 128
MOST_CONTEXTS = 256
#: Bytes of one document that are looked at together; longer documents go in pieces that overlap.
PIECE = 1 << 22

ONE = Rolling(0xD6E8FEB86659FD93, BYTE_VALUES)
TWO = Rolling(0xA0761D6478BD642F, mix(BYTE_VALUES))
PLACE = np.uint64((1 << 24) - 1)


def anchors(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor, over all windows of ``length`` bytes inside the rows.

    A window's anchor is the leftmost least-hashed GRAM-gram in it, which depends on its content
    alone: equal windows have equal anchors at equal places. Windows p1..p2 (first bytes) have the
    anchor at a; gram names the anchor; h1 and h2 hash all bytes of the run, raw[p1 : p2 + length].
    """
    n, gram = len(raw), min(GRAM, length)
    width = length - gram + 1
    names = ("row", "a", "p1", "p2", "gram", "h1", "h2")
    if n < length:
        return {k: np.zeros(0, np.int64) for k in names}
    one, two = ONE.sums(raw), TWO.sums(raw)
    at = np.arange(n - gram + 1)
    grams = ONE.ranges(one, at, at + gram)
    keys = (grams & ~PLACE) | at.astype(np.uint64)
    pad = -len(keys) % width
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    low = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:windows]
    fits = np.arange(windows) + length <= offs[row + 1]
    p = np.flatnonzero(fits)
    if not len(p):
        return {k: np.zeros(0, np.int64) for k in names}
    new = np.ones(len(p), bool)
    new[1:] = (low[p][1:] != low[p][:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    p1, p2 = p[first], p[np.append(first[1:], len(p)) - 1]
    a, row = low[p1], row[p1]
    end = p2 + length
    return {"row": row, "a": a, "p1": p1, "p2": p2, "gram": signed(grams[a]), "h1": signed(ONE.ranges(one, p1, end)), "h2": signed(TWO.ranges(two, p1, end))}


def _pieces(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(raw, offs, rows, shift) of a slice of rows; a longer document than PIECE comes in pieces of its windows."""
    raw, offs = text_bytes(part.column(2))
    if len(raw) <= PIECE:
        yield raw, offs, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
        return
    for r in range(part.num_rows):
        for lo in range(int(offs[r]), max(int(offs[r + 1]) - length + 1, int(offs[r]) + 1), PIECE):
            own = raw[lo : min(lo + PIECE + length - 1, int(offs[r + 1]))]
            yield own, np.array([0, len(own)]), np.array([r]), np.array([lo - offs[r]])


_RUN = "doc_id long, th long, p1 int, p2 int, off int, gram long, h1 long, h2 long"


def runs(docs: DataFrame, length: int, grams: DataFrame | None = None) -> DataFrame:
    """The anchors' runs of all documents, places within the document; off is the anchor's place in the run.

    With ``grams`` runs of other anchors are left out before they are shuffled, as far as a bounded
    Bloom filter tells them; the joins that follow are exact without it.
    """
    shared = None if grams is None else docs.sparkSession.sparkContext.broadcast(bloom.build(grams.select("gram")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                for raw, offs, rows, shift in _pieces(part, length):
                    f = anchors(raw, offs, length)
                    if shared is not None and len(f["gram"]):
                        hit = np.flatnonzero(bloom.holds(shared.value, f["gram"]))
                        f = {k: v[hit] for k, v in f.items()}
                    own = pa.array(rows[f["row"]])
                    base = shift[f["row"]] - offs[f["row"]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(own), part.column(1).take(own), *(pa.array((f[k] + base).astype(np.int32)) for k in ("p1", "p2")), pa.array((f["a"] - f["p1"]).astype(np.int32)), *(pa.array(f[k]) for k in ("gram", "h1", "h2"))],
                        ["doc_id", "th", "p1", "p2", "off", "gram", "h1", "h2"],
                    )

    return docs.mapInArrow(run, _RUN)


KEY = ["gram", "h1", "h2"]


def shared_contexts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(hulls, occurrences) of the anchors that stand in two runs or more.

    A hull is a run's content, (gram, h1, h2): ``dup`` tells that it occurs twice or more, ``hulls``
    how many different ones its anchor has, ``open`` how many of those occur once. Occurrences:
    the runs of the hulls that repeat, or whose anchor has others and some that occur once. All
    counts are aggregates with map-side combining, so that copies of one passage meet as counts; the
    occurrences are joined back, where Spark splits the hot keys.
    """
    grams = written(runs(docs, length).groupBy("gram").count().where("count > 1").select("gram"), "anchors")
    counted = written(runs(docs, length, grams).groupBy(*KEY).agg(F.count("*").alias("n")), "hulls")
    by = counted.groupBy("gram").agg(F.count("*").alias("hulls"), F.count_if(F.col("n") == 1).alias("open"), F.sum("n").alias("all")).where(F.col("all") > 1)
    hulls = counted.join(by, "gram").select(*KEY, (F.col("n") > 1).alias("dup"), "hulls", ((F.col("hulls") > 1) & (F.col("open") > 0)).alias("mixed"))
    hulls = written(hulls.where("dup or mixed"), "hulls")
    discard(counted)
    found = written(runs(docs, length, grams).join(hulls, KEY), "occurrences")
    discard(grams)
    return hulls, found


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcps: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of all common-prefix intervals of a suffix array, by a stack scan of its lcp table.

    lcps[i] is the common prefix of suffixes i and i + 1. Children come before their parents.
    """
    out, stack = [], []
    for i in range(len(lcps) + 1):
        depth = lcps[i] if i < len(lcps) else -1
        left = i
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            out.append((d, left, i))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def maximal_repeats(texts: list[bytes], offs: list[int], length: int) -> list[tuple[int, int, list[int]]]:
    """(left, right, members): maximal repeats of ``length`` bytes or more around an anchor that all texts hold at offs.

    The suffixes from the anchor on are sorted; the stack scan gives their intervals, in which all
    share ``right`` bytes. Inside an interval the members in the order of their reversed left
    contexts fall into runs that share ``left`` bytes to the left; a run whose left + right reaches
    the length, with members of different continuations, is a repeat: it cannot be extended to the
    right (the interval's members diverge there) nor to the left (the run's members diverge there).
    """
    right = [t[o:] for t, o in zip(texts, offs)]
    left = [t[:o][::-1] for t, o in zip(texts, offs)]
    order = sorted(range(len(texts)), key=right.__getitem__)
    lcps = [lcp(right[x], right[y]) for x, y in zip(order, order[1:])]
    out = []
    for depth, first, last in intervals(lcps):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        need = max(length - depth, 0)
        lefts = [lcp(left[x], left[y]) for x, y in zip(members, members[1:])]
        for shared, lo, hi in intervals(lefts):
            if shared >= need:
                out.append((shared, depth, members[lo : hi + 1]))
    return out


def contexts(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(gram, h1, h2, dup, hulls, doc_id, th, p1, off, text): one occurrence of every hull of a mixed anchor, with its bytes."""
    one = found.where("mixed").groupBy(*KEY, "dup", "hulls").agg(F.min(F.struct("doc_id", "th", "p1", "p2", "off")).alias("w"))
    asked = one.groupBy(F.col("w.doc_id").alias("d"), F.col("w.th").alias("t")).agg(F.collect_list(F.struct(*KEY, "dup", "hulls", "w.p1", "w.p2", "w.off")).alias("asked"))
    both = docs.join(asked, docs["doc_id"].eqNullSafe(asked["d"]) & (docs["th"] == asked["t"]))
    cut = lambda x: F.substring(F.col("text").cast("binary"), x["p1"] + 1, x["p2"] - x["p1"] + length)
    each = both.select("doc_id", "th", F.explode(F.transform("asked", lambda x: F.struct(x.alias("x"), cut(x).alias("text")))).alias("c"))
    return each.select(*(F.col(f"c.x.{k}").alias(k) for k in (*KEY, "dup", "hulls")), "doc_id", "th", "c.x.p1", "c.x.off", "c.text")


_FOUND = "doc_id long, th long, start int, stop int, grp string, size int, dup boolean"
_FOUND_PA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("grp", pa.string()), ("size", pa.int32()), ("dup", pa.bool_())])


def repeat_groups(found: DataFrame, length: int) -> DataFrame:
    """Occurrences of maximal repeats among the contexts of each anchor: (doc_id, th, start, stop, grp, size, dup).

    Memory holds the contexts of one anchor; the caller bounds their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        gram, last, rows = None, None, []

        def done() -> None:
            if len(rows) < 2:
                return
            for n, (left, right, members) in enumerate(maximal_repeats([r[7] for r in rows], [r[6] for r in rows], length)):
                name = f"{gram & 0xFFFFFFFFFFFFFFFF:016x}-{n}"
                for i in members:
                    r = rows[i]
                    at = r[5] + r[6]
                    out.append((r[3], r[4], at - left, at + right, name, len(members), r[2]))

        for batch in batches:
            for g, h1, h2, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if g != gram:
                    done()
                    gram, rows, last = g, [], None
                if last != (h1, h2):
                    last = (h1, h2)
                    rows.append((h1, h2, *r))
                if len(out) >= 4096:
                    yield _out(out)
                    out.clear()
        done()
        if out:
            yield _out(out)

    some = found.select(*KEY, "dup", "doc_id", "th", "p1", "off", "text")
    return some.repartition("gram").sortWithinPartitions(*KEY).mapInArrow(run, _FOUND)


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND_PA)], schema=_FOUND_PA)


def windows_by_halving(rows: DataFrame, length: int) -> DataFrame:
    """Exact duplicate windows among the contexts of anchors with very many: (doc_id, th, start, stop).

    Windows are told by how far they start before the anchor. A block of 512, 256, ... 1 such
    distances is, for each context, one string of bytes that all its windows make up, and one that
    all of them hold. Where that core is unique, no window repeats; where the whole string is found
    twice, all do; else the block is halved. One of each equal strings stays as a witness for the
    others. Each level is counted by aggregates with map-side combining, so that no anchor's
    contexts meet in one task, and the work is linear in the contexts.
    """
    state = rows.select("doc_id", "th", "gram", "dup", "p1", "off", "text", F.struct("h1", "h2").alias("id"), F.lit(0).alias("block"))
    state = state.withColumn("far", F.col("off")).withColumn("near", F.col("off") - (F.octet_length("text") - length))
    spans, size = None, 512
    while size:
        gram = min(GRAM, length)
        lo, hi = F.greatest("near", F.col("block") * size), F.least("far", F.col("block") * size + size - 1)
        core = F.lit(length - size + 1)
        live = state.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
        from_, to = F.col("off") - F.col("block") * size, F.greatest(core, F.lit(gram))
        live = live.withColumn("core", F.md5(F.substring("text", from_ + 1, to)) if length - size + 1 >= gram else F.lit(""))
        live = live.withColumn("hull", F.md5(F.substring("text", F.col("off") - F.col("hi") + 1, F.col("hi") - F.col("lo") + length)))
        live = written(live, "halving")
        key = ["gram", "block", "core"]
        hulls = live.groupBy(*key, "lo", "hi", "hull").agg(F.count("*").alias("n"), F.min("id").alias("witness"))
        cores = hulls.groupBy(*key).agg(F.count("*").alias("hulls"), F.sum("n").alias("all")).where(F.col("all") > 1)
        told = live.join(hulls, [*key, "lo", "hi", "hull"]).join(cores, key)
        told = written(told, "halving")
        hit = told.where("n > 1 and not dup").select("doc_id", "th", (F.col("p1") + F.col("off") - F.col("hi")).alias("start"), (F.col("p1") + F.col("off") - F.col("lo") + length).alias("stop"))
        spans = hit if spans is None else spans.unionByName(hit)
        on = told.where("hulls > 1 and (n = 1 or id = witness)")
        if size == 1 or on.isEmpty():
            return spans
        state = on.withColumn("block", F.explode(F.array(F.col("block") * 2, F.col("block") * 2 + 1))).select(state.columns)
        size //= 2
    return spans


def duplicate_spans(docs: DataFrame, length: int = LENGTH, most: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(spans, groups) for rows (doc_id, th, text): bytes in repeats, (doc_id, th, start, stop), and maximal repeat groups.

    ``groups``: (grp, size, doc_id, th, start, stop), every occurrence of every group, where an
    occurrence stands for all runs of windows equal to its own (same h1, h2 in ``runs``); anchors with
    more than ``most`` contexts have no groups, their repeats are told by windows_by_halving() alone.
    """
    _, found = shared_contexts(docs, length)
    whole = found.where("dup").select("doc_id", "th", F.col("p1").alias("start"), (F.col("p2") + length).alias("stop"))
    cut = written(contexts(docs, found, length), "contexts")
    groups = written(repeat_groups(cut.where(F.col("hulls") <= most), length), "repeats")
    spans = whole.unionByName(groups.where("not dup").select("doc_id", "th", "start", "stop"))
    over = cut.where(F.col("hulls") > most)
    if not over.isEmpty():
        spans = spans.unionByName(windows_by_halving(over.dropDuplicates(KEY), length))
    discard(cut)
    return spans, groups.drop("dup")


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = True, most: int = MOST_CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each row of docs.

    Removes every byte covered by a string of ``length`` bytes that also starts anywhere else, in
    the same document or another, judged on the input. A null text is empty; a null id stays null;
    rows that repeat an id or a whole row are documents of their own, so that each such text of
    ``length`` bytes or more is removed; other columns are ignored. ``kept`` is null unless
    keep_text. Nothing is capped: an anchor with very many contexts takes another exact way.
    """
    base = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"coalesce(cast(`{text_col}` as string), '') as text")
    base = base.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans, _ = duplicate_spans(base, length, most)
    by = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "spans")
    both = base.join(by, base["doc_id"].eqNullSafe(by["d"]) & (base["th"] == by["t"]), "left").select("doc_id", "text", "spans.start", "spans.stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw, offs = text_bytes(part.column(1))
                data, bounds, rows = raw.tobytes(), offs.tolist(), []
                for i, (lo, hi) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    doc = data[bounds[i] : bounds[i + 1]]
                    pieces, at, removed, n = [], 0, 0, 0
                    end = -1
                    for s, e in sorted(zip(lo or [], hi or [])):
                        if s > end:
                            pieces.append(doc[at:s])
                            n += 1
                        removed += max(0, e - max(s, end))
                        end = at = max(e, end)
                    kept = b"".join([*pieces, doc[at:]])
                    rows.append((len(doc), removed, n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, _KEPT)
