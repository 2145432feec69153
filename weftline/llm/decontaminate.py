"""Benchmark decontamination by template canonicalisation: typed placeholders, a hash join of template windows, slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_VALUES, Rolling, mix, signed, slices, text_bytes, word_bounds, written

#: Parameters: words a window, least literal words of a template window, words that an item has at least, least share of an item's windows, windows that one
#: pass holds, and the share of an item's windows (a window's words at least) that neighbouring alignments may differ by.
WINDOW = 8
MIN_LITERAL = 4
MIN_ITEM = 4
MIN_SHARE = 0.5
BLOCK_WINDOWS = 1_000_000
DRIFT = 0.25

#: Words that are units after a number (compared without case).
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz kb mb gb tb w kw kwh v a"
).split()

#: Number words and the digits that they stand for ("one" is no number: it is a pronoun as often).
NUMBER_WORDS = {
    "zero": 0, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000,
}

#: The bytes that words keep: letters, digits and all of a multi-byte character; the rest is punctuation.
KEEP = np.zeros(256, bool)
KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGITS = np.zeros(256, bool)
DIGITS[range(48, 58)] = True
ROLL = Rolling(0x8F14E45FCEEA1677, LOWER_VALUES)
NUM, NAME, UNIT, QUANTITY = (np.uint64(x) for x in mix(np.arange(11, 15, dtype=np.uint64)))
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?:\n"]] = True


def _hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, words)])
    return ROLL.ranges(ROLL.sums(raw), offs[:-1], offs[1:])


UNIT_HASHES = np.sort(_hashes(UNITS))
_SPELLED = _hashes(list(NUMBER_WORDS))
_ORDER = np.argsort(_SPELLED)
NUMBER_HASHES, NUMBER_VALUES = _SPELLED[_ORDER], _hashes([str(v) for v in NUMBER_WORDS.values()])[_ORDER]


def _within(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is among the sorted known ones, where)."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values, at


def canonical(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, values, literal, bounds) of all words of the rows.

    A word is a run of bytes other than white space, without its punctuation, compared without the
    case of Latin-1 letters; words of punctuation alone go. Its symbol is its hash, or a placeholder: a number, a
    quantity (digits with letters), a unit after a number or quantity, a name (with one
    capital, its first letter, that opens no sentence). Number words are numbers, with the value of
    their digits; a run of names is one name, so that a longer name fills the same slot. A word's
    value is the hash of what it stands for.
    """
    starts, ends, _ = word_bounds(raw, offs)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return none, none, np.zeros(0, bool), np.zeros(len(offs), np.int64)
    kept = KEEP[raw]
    small = raw[kept]
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kept, out=place[1:])
    lo, hi = place[starts], place[ends]
    some = hi > lo
    starts, ends, lo, hi = starts[some], ends[some], lo[some], hi[some]
    if not len(starts):
        return none, none, np.zeros(0, bool), np.zeros(len(offs), np.int64)
    bounds = np.searchsorted(starts, offs)
    small = small.copy()
    wide = np.flatnonzero((small[:-1] == 0xC3) & (small[1:] >= 0x80) & (small[1:] <= 0x9E) & (small[1:] != 0x97))
    head = small[lo]
    capital = ((head >= 65) & (head <= 90)) | np.isin(lo, wide)
    upper = (small >= 65) & (small <= 90)
    upper[wide + 1] = True
    n_upper = np.zeros(len(small) + 1, np.int64)
    np.cumsum(upper, out=n_upper[1:])
    capital &= n_upper[hi] - n_upper[lo] == 1
    small[wide + 1] += 0x20
    values = ROLL.ranges(ROLL.sums(small), lo, hi)
    n_digits = np.zeros(len(small) + 1, np.int64)
    np.cumsum(DIGITS[small], out=n_digits[1:])
    digits, length = n_digits[hi] - n_digits[lo], hi - lo
    number, quantity = digits == length, (digits > 0) & (digits < length)
    spelled, which = _within(values, NUMBER_HASHES)
    values[spelled] = NUMBER_VALUES[which[spelled]]
    number |= spelled
    capital &= ~spelled
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(STOPS[raw], out=stops[1:])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[starts[:-1]]
    opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] | quantity[:-1]
    unit = after & _within(values, UNIT_HASHES)[0]
    name = capital & ~opens
    symbols = values.copy()
    symbols[name] = NAME
    symbols[unit] = UNIT
    symbols[quantity] = QUANTITY
    symbols[number] = NUM
    literal = ~(number | quantity | unit | name)
    more = np.zeros(len(starts), bool)  # a name that goes on
    more[1:] = (symbols[1:] == NAME) & (symbols[:-1] == NAME)
    more[bounds[:-1][bounds[:-1] < len(starts)]] = False
    if more.any():
        head = np.flatnonzero(~more)
        run = np.diff(np.append(head, len(starts)))
        values = np.where(run > 1, mix(np.add.reduceat(mix(values), head) + run.astype(np.uint64)), values[head])
        symbols, literal, bounds = symbols[head], literal[head], np.searchsorted(starts[head], offs)
    return symbols, values, literal, bounds


def windows(symbols: np.ndarray, values: np.ndarray, literal: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row, exact) of every window of k words inside a row; one with less than MIN_LITERAL literal words is exact: hashed by its values."""
    n = len(symbols) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[i : i + n])
    run = np.concatenate([[0], np.cumsum(literal)])
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    inside = np.arange(n) + k <= bounds[row + 1]
    exact = run[k:] - run[:-k] < min(MIN_LITERAL, k)
    few = np.flatnonzero(inside & exact)
    own = np.full(len(few), QUANTITY ^ NUM)
    for i in range(k):
        own = mix(own * np.uint64(0x9E3779B97F4A7C15) + values[few + i])
    h[few] = own
    first = np.flatnonzero(inside)
    return signed(h)[first], first, row[first], exact[first]


_WINDOW = "id long, at int, h long, length int, slots array<long>, exact boolean, total int, templates int"


def _rows(part: pa.RecordBatch, lengths: list[int], block: np.ndarray | None) -> pa.RecordBatch:
    """Windows of the rows, of each length; with a block, only those whose hash is in it.

    Without a block the rows are items, of which one with fewer words than the longest length is one
    window as a whole. slots: the values of what is not literal; an exact window has none.
    """
    raw, offs = text_bytes(part.column(1))
    symbols, values, literal, bounds = canonical(raw, offs)
    words, sv, columns = np.diff(bounds), signed(values), [[] for _ in range(8)]
    for k in lengths:
        h, first, row, exact = windows(symbols, values, literal, bounds, k)
        keep = np.ones(len(h), bool)
        if block is None and k < max(lengths):
            keep = words[row] == k
        elif block is not None:
            keep = _within(h, block)[0] if len(block) else np.zeros(len(h), bool)
        total, templates = np.bincount(row, minlength=part.num_rows), np.bincount(row[~exact], minlength=part.num_rows)
        h, first, row, exact = h[keep], first[keep], row[keep], exact[keep]
        slots = [sv[f + np.flatnonzero(~literal[f : f + k])].tolist() if not e else [] for f, e in zip(first.tolist(), exact.tolist())]
        for column, own in zip(columns, (row, first - bounds[row], h, np.full(len(h), k), slots, exact, total[row], templates[row])):
            column.append(own)
    row, at, h, length, exact, total, templates = (np.concatenate(columns[i]) for i in (0, 1, 2, 3, 5, 6, 7))
    number = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(pa.array(row)), number(at), pa.array(h), number(length), pa.array([x for own in columns[4] for x in own], pa.list_(pa.int64())), pa.array(exact.astype(bool)), number(total), number(templates)],
        ["id", "at", "h", "length", "slots", "exact", "total", "templates"],
    )


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """Windows of the benchmark items; an item with fewer than k words is one window, one with fewer than MIN_ITEM has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield _rows(part, [*range(min(MIN_ITEM, k), k), k], None)

    return items.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text").where("id is not null").mapInArrow(run, _WINDOW)


def matching_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Windows of the documents whose hash is in ``wanted`` (h, length).

    The hashes go to the tasks in blocks of at most BLOCK_WINDOWS or so (8 MB), one pass over the
    texts each, so that what is broadcast stays bounded whatever the benchmark's size.
    """
    n, out = wanted.count(), None
    lengths = [r[0] for r in wanted.select("length").distinct().collect()] or [WINDOW]  # as many as a window has words at most
    blocks = max(1, -(-n * 5 // (BLOCK_WINDOWS * 4)))
    for i in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == i).select("h").distinct()
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(part.toPandas().h.to_numpy(np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, 1):
                    yield _rows(piece, lengths, shared.value)

        found = docs.mapInArrow(run, _WINDOW)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WINDOW, share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, matched, windows, share, reworded): a row for each document and item that it leaks.

    A document leaks an item when at least ``share`` of the item's windows are found along one
    alignment (the document's word minus the item's) or along neighbouring ones, as words that were
    put in or left out shift the rest, and the slots are consistent: there each value of an item's slot
    stands for one value in the document. Neighbouring alignments differ by up to DRIFT of the item's
    windows, or k words; of a window's places among them the one on the best-filled alignment counts.
    Windows with few literal words have no slots and match by their values only, so the share of the
    item's template windows alone, or of all its windows, is enough; the larger one is told.
    ``reworded`` tells that some slot differs, a re-parameterised question; otherwise it is a verbatim passage.
    Texts are compared without case and punctuation. An item of fewer than k words is one window; one
    of fewer than MIN_ITEM matches nothing, as such words stand in clean documents too, and so do null
    and empty texts. A null id matches nothing; rows that repeat an id are one document;
    repeated items are one. Other columns are ignored. No window is left out for being common.
    """
    theirs = written(item_windows(items, item_id, item_text, k), "items").dropDuplicates(["id", "at", "h"])
    base = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text").where("id is not null")
    ours = written(matching_windows(base, theirs.select("h", "length").distinct()), "windows")
    d, i = ours.alias("d"), theirs.alias("i")
    pairs = d.join(i, "h").select(
        F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), (F.col("d.at") - F.col("i.at")).alias("shift"), F.col("i.at").alias("at"), F.col("i.exact").alias("exact"), F.col("i.total").alias("total"), F.col("i.templates").alias("templates"),
        F.transform(F.arrays_zip(F.col("i.slots").alias("a"), F.col("d.slots").alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("slots"),
    )
    line = ["doc_id", "item_id", "shift"]
    pairs = pairs.dropDuplicates([*line, "at"]).withColumn("filled", F.count("*").over(Window.partitionBy(*line)))
    drift = F.greatest(F.lit(k), F.floor(F.col("total") * DRIFT)).cast("long")
    near = F.floor(F.col("shift") / drift)
    band = lambda wide, no: F.struct(F.lit(wide).alias("wide"), no.cast("long").alias("no"))
    pairs = pairs.withColumn("band", F.explode(F.array(band(False, F.col("shift")), band(True, near), band(True, near - 1))))
    key = ["doc_id", "item_id", "wide", "no"]
    one = F.max_by(F.struct("slots", "exact", "total", "templates"), F.struct("filled", -F.col("shift"))).alias("w")
    pairs = written(pairs.select("*", "band.*").groupBy(*key, "at").agg(one).select(*key, "at", "w.*"), "pairs")
    found = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col("exact")).alias("n_templates"), F.max("total").alias("total"), F.max("templates").alias("templates"))
    rate = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    told = F.greatest(F.struct(rate("n", "total").alias("share"), F.col("n").alias("matched"), F.col("total").alias("windows")), F.struct(rate("n_templates", "templates").alias("share"), F.col("n_templates").alias("matched"), F.col("templates").alias("windows")))
    found = found.withColumn("told", told).select(*key, "told.*").where(F.col("matched") >= F.lit(share) * F.col("windows"))
    slots = pairs.select(*key, F.explode("slots").alias("s")).groupBy(*key, F.col("s.a").alias("a")).agg(F.min("s.b").alias("lo"), F.max("s.b").alias("hi"))
    checked = slots.groupBy(*key).agg(F.min((F.col("lo") == F.col("hi")).cast("int")).alias("steady"), F.max((F.col("lo") != F.col("a")).cast("int")).alias("moved"))
    good = found.join(checked, key, "left").where(F.coalesce("steady", F.lit(1)) == 1)
    best = F.max(F.struct("share", "matched", "windows", (F.coalesce("moved", F.lit(0)) == 1).alias("reworded")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.windows").cast("long").alias("windows"), F.col("b.share").alias("share"), F.col("b.reworded").alias("reworded"))
