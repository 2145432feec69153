"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and the classes that its links make."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import LOWER_VALUES, Rolling, discard, mix, signed, slices, text_bytes, word_bounds, written
from weftline.llm.components import components

#: Counters of the frequency sketch (8 MB of classes on the driver and in a task), in parts; the lowest hashes, which alone
#: reach prefixes as a rule, are counted; shingles counted at a time; the most shared tokens that a prefix may ask for; partners
#: that a token below the sketch's noise is taken to have.
SKETCH_BITS, PART = 23, 1 << 17
COUNTED = np.uint64(int(0.4 * 2**64))
AT_ONCE = 1 << 22
MAX_MATCHES = 6
UNSEEN = 0.25
#: Members of a list that is long, hubs that a round draws for a long list, and rounds at most (they only save work later).
LONG, HUBS, ROUNDS = 16, 4, 6
#: Bits of a set's parity bitmap.
BITMAP = 512

ROLL = Rolling(0xC2B2AE3D27D4EB4F, LOWER_VALUES)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, sids): each row's distinct k-word shingles as sorted 64-bit hashes, and a hash of the set.

    Words are compared without ASCII case. A row with fewer than k words has one shingle, all its
    words; one without words has none.
    """
    starts, ends, bounds = word_bounds(raw, offs)
    rows = len(offs) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(rows, np.uint64)
    words = ROLL.ranges(ROLL.sums(raw), starts, ends)
    count = np.diff(bounds)
    row = np.repeat(np.arange(rows), np.maximum(count - k + 1, (count > 0).astype(np.int64)))
    sizes = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    first = np.arange(len(row)) - edge[row] + bounds[row]
    length = np.minimum(count, k)[row]
    h = np.zeros(len(row), np.uint64)
    for i in range(k):
        on = i < length
        at = np.minimum(first + i, len(words) - 1)
        h = np.where(on, mix(h * GOLD + words[at] + np.uint64(i + 1)), h)
    for r in np.flatnonzero(sizes > 1):
        h[edge[r] : edge[r + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    edge = np.searchsorted(row, np.arange(rows + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ GOLD), dtype=np.uint64)])
    sids = mix(sums[edge[1:]] - sums[edge[:-1]] + np.diff(edge).astype(np.uint64))
    return h, edge, sids


def bitmaps(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Each row's parity bitmap, as BITMAP / 64 longs: a bit tells whether an odd number of its shingles fall to it.

    Two sets differ in at least as many shingles as their bitmaps differ in bits.
    """
    rows = len(edge) - 1
    row = np.repeat(np.arange(rows), np.diff(edge))
    odd = np.bincount(row * BITMAP + (h & np.uint64(BITMAP - 1)).astype(np.int64), minlength=rows * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, BITMAP), axis=1).view(np.int64)


def _parts(docs: DataFrame, run: Callable, schema: str) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(part for batch in batches for part in slices(batch, 1))

    return docs.mapInArrow(mapped, schema)


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.uint8).astype(np.uint64) for x in table.column("counts").to_pylist()], axis=0, dtype=np.uint64)
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary()), "total": pa.array([int(total.sum())])})


def members_and_levels(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sid, bits) of every row, and the classes of a sketch: how many shingles below COUNTED fall to each of 2**SKETCH_BITS counters.

    A task's counters stop at 255 each; the classes only order tokens, and any order is exact.
    """

    names = ["doc_id", "n", "sid", "bits", "part", "counts"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n_held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for part in parts:
            h, edge, sids = shingle_sets(*text_bytes(part.column(1)), k)
            held.append(_counter(h[h < COUNTED]))
            n_held += len(held[-1])
            if n_held > AT_ONCE:
                counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
                held, n_held = [], 0
            none = pa.nulls(part.num_rows, pa.int32())
            own = bitmaps(h, edge)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edge)), pa.array(signed(sids)), bits, none, pa.nulls(part.num_rows, pa.binary())], names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.uint32)
        small = np.minimum(counts, 255).astype(np.uint8)
        some = [i for i in range(len(small) // PART) if small[i * PART : (i + 1) * PART].any()]
        m = len(some)
        data = pa.array([small[i * PART : (i + 1) * PART].tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.list_(pa.int64())), pa.array(some, pa.int32()), data], names)

    both = written(_parts(docs, run, "doc_id long, n long, sid long, bits array<long>, part int, counts binary"), "members")
    sums = written(both.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_added, "part int, counts binary, total long"), "sketch")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [levels(np.frombuffer(c, np.uint64), mean).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["part", "classes"])

    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sums.select("part", "counts").mapInArrow(classed, "part int, classes binary").toLocalIterator():
        level[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["classes"], np.uint8)
    return both.where("part is null").select("doc_id", "n", "sid", "bits"), level


def _counter(h: np.ndarray) -> np.ndarray:
    return ((h * GOLD) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)


def levels(counts: np.ndarray, mean: float) -> np.ndarray:
    """Frequency class of each counter: 0 for what chance explains, then one more for each doubling above it."""
    above = np.maximum(counts - mean - 5 * np.sqrt(mean + 1), 0)
    return np.ceil(np.log2(above + 1)).astype(np.uint8)


def prefix(h: np.ndarray, level: np.ndarray, a: int, b: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in the common order (class, then hash), and the matches that it asks for.

    A prefix of n - ceil(J n) + l tokens shares l tokens with that of any partner. l is the one with
    the least estimated cost: entries read (the classes' frequencies) plus candidates, taken to
    fall four times with each further match, times what verifying one costs.
    """
    n = len(h)
    least = -(-a * n // b)
    own = np.where(h < COUNTED, level[_counter(h)], 0)
    if own.any():
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    base = n - least
    most = min(MAX_MATCHES, least)
    read = np.cumsum(np.exp2(own[: base + most].astype(float)) - 1 + UNSEEN)
    cost = [read[base + m - 1] + base + m + read[base + m - 1] / 4 ** (m - 1) * n / 16 for m in range(1, most + 1)]
    m = int(np.argmin(cost)) + 1
    return h[: base + m], m


_ENTRY = "token long, sid long, n int, pos int, matches int"
_LISTED = _ENTRY + ", least int"


def entries(docs: DataFrame, k: int, level: np.ndarray, a: int, b: int) -> DataFrame:
    """Prefix tokens of every distinct set (equal sets of one partition once)."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for part in parts:
            h, edge, sids = shingle_sets(*text_bytes(part.column(1)), k)
            tokens, of, matches, pos = [], [], [], []
            for r in np.flatnonzero(np.diff(edge) > 0).tolist():
                sid = int(sids[r])
                if sid in seen:
                    continue
                seen.add(sid)
                t, m = prefix(h[edge[r] : edge[r + 1]], level, a, b)
                tokens.append(t)
                of.append(r)
                matches.append(m)
                pos.append(np.arange(len(t), dtype=np.int32))
            if not tokens:
                continue
            lens = [len(t) for t in tokens]
            rep = np.repeat(of, lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(tokens))), pa.array(signed(sids)[rep]), pa.array(np.diff(edge)[rep].astype(np.int32)), pa.array(np.concatenate(pos)), pa.array(np.repeat(matches, lens).astype(np.int32))],
                ["token", "sid", "n", "pos", "matches"],
            )

    return _parts(docs, run, _ENTRY)


def lists(found: DataFrame) -> DataFrame:
    """Entries of the tokens that two or more sets have, each (token, sid) once, with ``least``, the size of the list's smallest set.

    Spark deals and sorts the entries; the scan over a sorted partition keeps one row at a time.
    """
    names = ["token", "sid", "n", "pos", "matches", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told, last = None, False, None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
            if not len(rows):
                continue
            before = np.concatenate([last[None, :2] if last is not None else rows[:1, :2] + 1, rows[:-1, :2]])
            last = rows[-1]
            rows = rows[(rows[:, 0] != before[:, 0]) | (rows[:, 1] != before[:, 1])]
            if first is not None:
                rows = np.concatenate([first[None], rows])
            if not len(rows):
                continue
            group = np.concatenate([[0], np.cumsum(rows[1:, 0] != rows[:-1, 0])])
            many = (np.bincount(group) > 1)[group]
            out = many.copy()
            out[0] &= not told
            told = bool(many[-1]) or (told and group[-1] == 0)
            opens = np.searchsorted(group, group)
            first = rows[opens[-1]]
            own = np.column_stack([rows, rows[opens, 2]])[out]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, i].astype(np.int64 if i < 2 else np.int32)) for i in range(6)], names)

    return found.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(run, _LISTED)


def _leading(a: int, b: int) -> Column:
    """Whether a token can be the first that its set shares with any partner in the list.

    The ``pos`` tokens before it are then the set's alone, and a partner has at least ``least`` shingles.
    """
    partner = F.greatest("least", F.ceil(F.lit(a) * F.col("n") / b))
    return (a + b) * (F.col("n") - F.col("pos")) >= a * (F.col("n") + partner)


def _possible(x: str, y: str, a: int, b: int) -> Column:
    """Whether two sets can link if this is the first token that they share: by their sizes, and by what is left from here on."""
    n1, n2, p1, p2 = (F.col(f"{k}{c}") for c in ("n", "pos") for k in (x, y))
    return (b * F.least(n1, n2) >= a * F.greatest(n1, n2)) & ((a + b) * F.least(n1 - p1, n2 - p2) >= a * (n1 + n2))


def _apart(x: str, y: str) -> Column:
    """In how many bits the bitmaps of two sets differ."""
    return sum((F.bit_count(F.col(f"{x}bits")[i].bitwiseXOR(F.col(f"{y}bits")[i])) for i in range(BITMAP // 64)), F.lit(0))


def _near(x: str, y: str, a: int, b: int) -> Column:
    """Whether the bitmaps of two sets leave room for a link: a link's sets differ in (b - a) / (a + b) of their sizes at most."""
    return (a + b) * _apart(x, y) <= (b - a) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _one(sid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(sid.view(np.uint64) ^ mix(doc.view(np.uint64)))


def sets_of(docs: DataFrame, k: int, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, items) of the wanted sids, from the document with the least id of each; few come twice.

    The texts are read again, rather than shuffled, and filtered by a bounded Bloom filter of the
    wanted (sid, doc_id).
    """
    least = members.join(wanted.distinct(), "sid").groupBy("sid").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(_one(batch.column(0).to_numpy(), batch.column(1).to_numpy())))], ["key"])

    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(written(least.mapInArrow(keys, "key long"), "keys")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        for part in parts:
            h, edge, sids = shingle_sets(*text_bytes(part.column(1)), k)
            ids = part.column(0).fill_null(0).to_numpy()
            rows = np.flatnonzero((np.diff(edge) > 0) & bloom.holds(filt, _one(sids, ids)))
            if len(rows):
                flat = np.concatenate([h[edge[r] : edge[r + 1]] for r in rows])
                ends = np.concatenate([[0], np.cumsum([edge[r + 1] - edge[r] for r in rows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sids[rows])), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(flat)))], ["sid", "items"])

    return _parts(docs, run, "sid long, items array<long>")


def more_sets(docs: DataFrame, k: int, pairs: DataFrame, sets: DataFrame | None, members: DataFrame) -> DataFrame:
    """The sets of all ends of the pairs, with those that are there already."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    if sets is not None:
        wanted = wanted.join(sets.select("sid"), "sid", "left_anti")
    wanted = written(wanted, "wanted")
    if wanted.isEmpty() and sets is not None:
        return sets
    new = written(sets_of(docs, k, wanted, members), "sets")
    return new if sets is None else sets.unionByName(new)


def verified(pairs: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    x = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return both.where((a + b) * F.col("i") >= a * F.col("s")).select("a", "b").distinct()


def hub_pairs(rows: DataFrame, a: int, b: int, turn: int) -> DataFrame:
    """(a, b): for each component that meets another in a long list, its nearest pair with a hub of such a list.

    Hubs are the member with the fewest tokens of its own before the list's and others drawn by a
    hash: in the first round alike in all lists, so that near copies meet the same hubs, later by
    list and round. Near is told by the bitmaps, so that one test joins most of what belongs together.
    The pairs only join large groups with tests in proportion to the members; no other step relies on them.
    """
    big = rows.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") >= LONG).select("token")
    rows = written(rows.join(big, "token", "left_semi"), "long")
    one = F.struct("sid", "comp", "n", "pos", "bits")
    drawn = [F.xxhash64("sid", F.lit(turn * HUBS + i), *(["token"] if turn else [])) for i in range(HUBS)]
    hubs = rows.groupBy("token").agg(F.array_distinct(F.array(F.min_by(one, F.struct("pos", drawn[0])), *(F.max_by(one, d) for d in drawn[1:]))).alias("hubs"))
    met = rows.join(hubs, "token").withColumn("h", F.explode("hubs")).where((F.col("comp") != F.col("h.comp")) & _possible("", "h.", a, b) & _near("", "h.", a, b))
    best = met.groupBy("comp").agg(F.min(F.struct(_apart("", "h.").alias("apart"), F.col("sid"), F.col("h.sid").alias("hub"))).alias("p"))
    out = written(best.select(F.least("p.sid", "p.hub").alias("a"), F.greatest("p.sid", "p.hub").alias("b")).distinct(), "star")
    discard(rows)
    return out


def asked_pairs(pairs: DataFrame, found: DataFrame, a: int, b: int) -> DataFrame:
    """The pairs (a, b) that share as many tokens of their prefixes as the smaller demand, and as their sizes, ask for."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    own = found.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.collect_list("token").alias("tokens"), F.first("n").alias("n"), F.first("matches").alias("m"))
    own = own.withColumn("rest", F.ceil(F.col("n") * a / b) - F.col("m"))
    x, y = (own.select(F.col("sid").alias(k), F.struct("tokens", "n", "m", "rest").alias(f"of_{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b")
    short = F.ceil(F.lit(a) * (F.col("of_a.n") + F.col("of_b.n")) / (a + b)) - F.greatest("of_a.rest", "of_b.rest")
    return both.where(F.size(F.array_intersect("of_a.tokens", "of_b.tokens")) >= F.greatest(F.least("of_a.m", "of_b.m"), short)).select("a", "b")


def placed(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows of lists that more than one component meets in, with their components; a set without links is its own."""
    if comp is None:
        return rows.withColumn("comp", F.col("sid"))
    out = rows.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    out = written(out, "placed")
    mixed = out.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return out.join(mixed, "token", "left_semi")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Documents link when the Jaccard similarity of their sets of k-word shingles is at least
    percent/100; component_id is the smallest doc_id that links reach. Equal sets are one vertex.
    The rest is found through prefixes (see prefix()). First, rounds of hub tests join large groups
    (see hub_pairs()), until most tests of a round fail. Then the pairs of a list whose members are still
    in different components are taken at the first token that they may share, kept where sizes,
    places and bitmaps leave room for a link, asked for as many shared prefix tokens as they demand,
    and verified on whole sets. Pairs inside one component need no test, so a group of near copies
    costs about as many tests as members, and no link between components is missed. Prefixes of any
    length are exact; nothing is capped.

    A text without words (null, empty, blank) has no shingles, links with nothing and is its own
    component. A null id takes part, but a component of null ids only has a null id. Rows that
    repeat an id are vertices of their own and share its results. Other columns are ignored.
    """
    a, b = percent, 100
    base = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    members, level = members_and_levels(base, k)
    found = written(lists(entries(base, k, level, a, b)), "lists")
    lead = found.where(_leading(a, b))
    bits = members.join(lead.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("bits").alias("bits"))
    lead = written(lead.join(bits, "sid").select("token", "sid", "n", "pos", "bits"), "leading")

    comp = links = sets = tested = None
    for turn in range(ROUNDS):
        star = hub_pairs(placed(lead, comp), a, b, turn)
        if star.isEmpty():
            break
        sets = more_sets(base, k, star, sets, members)
        new = written(verified(star, sets, a, b), "links")
        tested = star if tested is None else tested.unionByName(star)
        links = new if links is None else links.unionByName(new)
        comp = components(links)
        if 2 * new.count() < star.count():
            break

    live = written(placed(lead, comp), "live")
    x, y = live.alias("x"), live.alias("y")
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp")) & _possible("x.", "y.", a, b) & _near("x.", "y.", a, b))
    cross = cross.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    cross = written(cross if tested is None else cross.join(tested, ["a", "b"], "left_anti"), "cross")
    discard(live, lead)
    cross = written(asked_pairs(cross, found, a, b), "asked")
    if not cross.isEmpty():
        sets = more_sets(base, k, cross, sets, members)
        more = written(verified(cross, sets, a, b), "links")
        links = more if links is None else links.unionByName(more)
    discard(found)

    named = members.drop("bits")
    if links is None:
        named = named.withColumn("comp", F.when(F.col("n") > 0, F.col("sid")))
    else:
        named = named.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "sid")))
    named = written(named, "named")
    least = named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    hot = named.where("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return hot.unionByName(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
