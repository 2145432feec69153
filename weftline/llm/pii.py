"""PII: fixed patterns find protected entities; corpus co-occurrence finds the terms that reveal them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.common import LOWER_VALUES, Rolling, signed, slices, text_bytes, written

#: Fixed values of the base patterns; possessive parts only save backtracking.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(rb"[0-9]")
KINDS = ("email", "ip", "card", "phone", "term")

#: Parameters of the disclosure test.
CONTEXT_WORDS = 6
MIN_SUPPORT = 3
MIN_SHARE = 0.5
MIN_BITS = 8.0
#: Terms that one pass over the texts holds (8 bytes each); more are taken in further passes.
BLOCK_TERMS = 2_000_000

TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
ROLL = Rolling(0x9E6F2C3B5A7D1E43, LOWER_VALUES)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@ and DOMAIN, each character looked at a bounded number of times."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _any(doc: bytes) -> bool:
    return b"@" in doc or DIGIT.search(doc) is not None


def _term_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = TERM_BYTES[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return signed(ROLL.ranges(ROLL.sums(raw), starts, ends))


def _hash_one(terms: list[bytes]) -> np.ndarray:
    raw, offs = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([0, *map(len, terms)])
    return _hashes(raw, offs[:-1], offs[1:])


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, context, term, n): 64-bit hashes of each entity, the words around it, and each term there, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                raw, offs = text_bytes(part.column(0))
                data, bounds = raw.tobytes(), offs.tolist()
                ent, ctx, term = [], [], []
                for i in range(part.num_rows):
                    doc = data[bounds[i] : bounds[i + 1]]
                    if not _any(doc):
                        continue
                    text = doc.decode("utf-8", "replace")
                    spans = base_spans(text)
                    bare = masked(text, merged(spans))
                    for kind, s, e in spans:
                        if words := before(bare, s) + after(bare, e):
                            h = int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)
                            who = int.from_bytes(hashlib.blake2b(f"{kind}:{text[s:e].lower()}".encode(), digest_size=8).digest(), "little", signed=True)
                            ent += [who] * len(words)
                            ctx += [h] * len(words)
                            term += words
                if term:
                    yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(ctx, pa.int64()), pa.array(_hash_one(term))], ["entity", "context", "term"])

    return docs.select("text").mapInArrow(run, "entity long, context long, term long")


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of (kind, start, end) spans as separate intervals in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def meets(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether the span meets one of the separate intervals in order."""
    n = bisect_left(taken, (e, 0))
    return n > 0 and taken[n - 1][1] > s


def masked(text: str, taken: list[tuple[int, int]]) -> str:
    """The text with blanks in place of the intervals."""
    out, at = [], 0
    for s, e in taken:
        out += [text[at:s], " " * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def _terms(found: Iterator[re.Match]) -> Iterator[bytes]:
    """Terms of three bytes or more, in lower case."""
    return (w for w in (m.group().encode("utf-8", "replace").lower() for m in found) if len(w) >= 3)


def before(text: str, at: int) -> list[bytes]:
    """The last CONTEXT_WORDS terms before a place; looks back twice as far until there are as many whole ones."""
    far = 128
    while True:
        lo = max(0, at - far)
        found = (m for m in TERM.finditer(text, lo, at) if m.start() > lo or lo == 0)
        words = list(_terms(found))[-CONTEXT_WORDS:]
        if len(words) == CONTEXT_WORDS or lo == 0:
            return words
        far *= 2


def after(text: str, at: int) -> list[bytes]:
    """The first CONTEXT_WORDS terms after a place."""
    return list(islice(_terms(TERM.finditer(text, at)), CONTEXT_WORDS))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """Terms (hashes) that reveal an entity, with the strongest entity's figures.

    A term t reveals an entity e when it stands within CONTEXT_WORDS words of e in at least
    MIN_SUPPORT different contexts (copies of a passage count once), at least MIN_SHARE of all
    occurrences of t in the corpus are such, and the pointwise mutual information
    log2(P(e|t)/P(e)), P(e) being e's share of all corpus terms, reaches MIN_BITS. All counts are
    over all texts; per-entity counts are pre-aggregated before they are shuffled.
    """
    found = written(contexts(docs).groupBy("entity", "context", "term").agg(F.count("*").alias("n")), "contexts")
    joint = found.groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("n").alias("joint")).where(F.col("support") >= MIN_SUPPORT)
    joint = written(joint, "joint")
    candidates = written(joint.select("term").distinct(), "candidates")
    total = written(corpus_counts(docs, candidates), "terms")
    every = total.where("term is null").first()
    size = found.groupBy("entity").agg(F.sum("n").alias("near")).withColumn("corpus", F.lit(every["n"] if every else 0))
    scored = (
        joint.join(total.where("term is not null").withColumnRenamed("n", "total"), "term")
        .join(size, "entity")
        .withColumn("share", F.col("joint") / F.col("total"))
        .withColumn("bits", F.log2(F.col("share") * F.col("corpus") / F.col("near")))
    )
    kept = scored.where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS))
    return written(kept.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")), "disclosing")


def blocks(terms: DataFrame) -> Iterator[np.ndarray]:
    """The terms in sorted arrays of at most BLOCK_TERMS or so, dealt by hash; the driver holds one at a time."""
    n = terms.count()
    k = max(1, -(-n * 5 // (BLOCK_TERMS * 4)))
    for i in range(k if n else 0):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(k)) == i).select("term").toPandas().term.to_numpy(np.int64)
        yield np.sort(part)


def _find(hashes: np.ndarray, block: np.ndarray) -> np.ndarray:
    at = np.searchsorted(block, hashes)
    at[at == len(block)] = 0
    return block[at] == hashes


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all texts for the given terms, and a row with a null term for all occurrences of any term.

    One pass and one aggregate, however many terms: a task counts the terms of a slice of its texts,
    leaves out what a bounded Bloom filter tells to be none of the given ones, and the join is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = 0
        for batch in batches:
            for part in slices(batch, 0):
                raw, offs = text_bytes(part.column(0))
                starts, ends = _term_bounds(raw, offs)
                every += len(starts)
                if len(starts):
                    found, n = np.unique(_hashes(raw, starts, ends), return_counts=True)
                    some = bloom.holds(shared.value, found)
                    yield pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(n[some])], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([every], pa.int64())], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(terms.withColumn("asked", F.lit(True)), "term", "left").where("asked or term is null").select("term", "n")


def generalised(word: str) -> str:
    """The placeholder of a term: numbers and names stay recognisable as such, others are removed."""
    return "<NUM>" if word.isdigit() else "<NAME>" if word[:1].isupper() else ""


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, clean string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: counts, the hash of the base spans, all spans and the sanitised text.

    The columns in ``carry`` come along in a struct ``row`` (only if there are any).
    Protected entities become <EMAIL>, <IP>, <CARD> and <PHONE>; terms that reveal one (see
    disclosing_terms, or ``terms``) are generalised or removed. A null text is empty (its sanitised
    text stays null), a null id stays null, repeated rows give repeated results, other columns are
    ignored. Spans of terms inside a base span are not added.
    """
    base = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    terms = disclosing_terms(base) if terms is None else terms
    row = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []
    spark = docs.sparkSession
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(None).cast("string").alias("marks"), *row)
    tail = f", row {df.schema['row'].dataType.simpleString()}" if carry else ""
    parts = list(blocks(terms)) or [np.zeros(0, np.int64)]
    for i, block in enumerate(parts):
        shared = spark.sparkContext.broadcast(block)
        last = i == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    yield (_result if last else _marked)(part, shared.value)

        df = df.mapInArrow(run, (SCHEMA if last else "doc_id long, text string, marks string") + tail)
    return df


def _hits(part: pa.RecordBatch, block: np.ndarray) -> tuple[bytes, list[int], list[list[tuple[int, int]]]]:
    """The bytes of all rows, their bounds, and each row's (start, end) of terms in code points, with earlier marks."""
    raw, offs = text_bytes(part.column(1))
    data, bounds = raw.tobytes(), offs.tolist()
    found: list[list[tuple[int, int]]] = [[tuple(map(int, x.split(":"))) for x in m.split(",")] if m else [] for m in part.column(2).to_pylist()]
    if len(block) and len(raw):
        starts, ends = _term_bounds(raw, offs)
        at = np.flatnonzero(_find(_hashes(raw, starts, ends), block))
        points = np.zeros(len(raw) + 1, np.int64)  # code points before each byte
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        rows = np.searchsorted(offs, starts[at], "right") - 1
        first = points[offs[rows]]
        for row, lo, hi in zip(rows.tolist(), (points[starts[at]] - first).tolist(), (points[ends[at]] - first).tolist()):
            found[row].append((lo, hi))
    return data, bounds, found


def _marked(part: pa.RecordBatch, block: np.ndarray) -> pa.RecordBatch:
    _, _, found = _hits(part, block)
    marks = pa.array([",".join(f"{s}:{e}" for s, e in f) or None for f in found], pa.string())
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), marks, *part.columns[3:]], ["doc_id", "text", "marks", *part.schema.names[3:]])


def _result(part: pa.RecordBatch, block: np.ndarray) -> pa.RecordBatch:
    data, bounds, found = _hits(part, block)
    n = part.num_rows
    counts = [[0] * n for _ in KINDS]
    digest, spans, clean = [_EMPTY] * n, [""] * n, part.column(1).to_pylist()
    for i in range(n):
        doc = data[bounds[i] : bounds[i + 1]]
        if not found[i] and not _any(doc):
            continue
        text = doc.decode("utf-8", "replace")
        base = base_spans(text)
        taken = merged(base)
        more = [(4, s, e) for s, e in sorted(found[i]) if not meets(taken, s, e)]
        for k, _, _ in base + more:
            counts[k][i] += 1
        digest[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)
        if base or more:
            out, at = [], 0
            for s, e, k in sorted((s, e, k) for k, s, e in base + more):
                if e > at:
                    out += [text[at:s], generalised(text[s:e]) if k == 4 else f"<{KINDS[k].upper()}>" if s >= at else ""]
                    at = e
            clean[i] = "".join([*out, text[at:]])
    return pa.RecordBatch.from_arrays(
        [part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts[:4]), pa.array(digest), pa.array(spans), pa.array(counts[4], pa.int64()), pa.array(clean, pa.string()), *part.columns[3:]],
        ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "clean", *part.schema.names[3:]],
    )
