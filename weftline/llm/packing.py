"""Packing token ids into sequences with minimum bin slack: bitset subset sums choose what fills each window best."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices

#: Tokens of a window; the id that ends every document.
WINDOW, END = 2048, 1
#: Text bytes whose documents a task packs together; a longer text goes alone.
GROUP_BYTES = 1 << 25
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def subset(counts: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` closest without passing it: {length: times}; counts: (length, available), in order of preference.

    Bit s of a bitset tells whether the lengths so far can sum to s. A length with m copies is
    added in powers of two; the scan ends when room itself is reached. The bitsets before each
    length lead the way back to the counts.
    """
    bits, trail, full = 1, [], (1 << (room + 1)) - 1
    for length, available in counts:
        if length > room:
            continue
        trail.append((length, available, bits))
        left, step = min(available, room // length), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * length)) & full
            left, step = left - take, 2 * step
        if bits >> room & 1:
            break
    s, used = bits.bit_length() - 1, {}
    for length, available, before in reversed(trail):
        n = 0
        while not before >> s & 1:
            s, n = s - length, n + 1
        if n:
            used[length] = n
    return used


def fill(pieces: list[tuple[int, int, int]], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) of all pieces, none longer than ``window``.

    Each window takes the longest piece that is left and the multiset of lengths that leaves least
    slack beside it; the choice is repeated as often as the counts allow. Where slack is left, the
    longest other piece is cut to fill it. What is left at the end is cut into sequences of a power
    of two, so that no sequence needs padding.
    """
    pool: dict[int, list[tuple[int, int, int]]] = {}
    for p in pieces:
        pool.setdefault(p[2], []).append(p)
    order = sorted(pool, reverse=True)

    def taken(length: int) -> tuple[int, int, int]:
        p = pool[length].pop()
        if not pool[length]:
            del pool[length]
            order.remove(length)
        return p

    def put(p: tuple[int, int, int]) -> None:
        if p[2] not in pool:
            pool[p[2]] = []
            order.append(p[2])
            order.sort(reverse=True)
        pool[p[2]].append(p)

    while order:
        most = order[0]
        used = subset([(n, len(pool[n]) - (n == most)) for n in order], window - most)
        used[most] = used.get(most, 0) + 1
        slack = window - sum(n * k for n, k in used.items())
        for _ in range(1 if slack else min(len(pool[n]) // k for n, k in used.items())):
            sequence = [taken(n) for n, k in used.items() for _ in range(k)]
            if slack and order:
                doc, start, length = taken(order[0])
                sequence.append((doc, start, slack))
                put((doc, start + slack, length - slack))
            elif slack:
                yield from powers(sequence)
                continue
            yield sequence


def powers(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two of their sum, the largest first."""
    left, rest = sum(p[2] for p in sequence), sequence[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left, out = left - size, []
        while size:
            doc, start, length = rest.pop()
            own = min(length, size)
            out.append((doc, start, own))
            size -= own
            if own < length:
                rest.append((doc, start + own, length - own))
        yield out


#: Between a letter or digit and a sign, a pre-tokenizer that separates them cuts anyway, whatever follows.
SIGNS = ("([A-Za-z0-9À-ÖØ-öø-ɏ])([.,;:!?)#$%&*])", r"\1 \2")
#: What special tokens begin with: words that hold it are encoded as they are written.
SPECIAL = "<|"


class WordIds:
    """Token ids of texts by their words: a tokenizer that splits at white space and before SIGNS gives a text the ids of its words, in order.

    Words of ASCII alone are lower-cased first, as the tokenizer does it anyway; words with other
    letters are not, since composed letters may depend on the case of what is composed.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, END after each, and the bounds of each text in them."""
        apart = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), *SIGNS)
        split = pc.ascii_split_whitespace(apart)
        words = split.flatten().dictionary_encode()
        plain = pc.and_(pc.string_is_ascii(words.dictionary), pc.invert(pc.match_substring(words.dictionary, SPECIAL)))
        keys = pc.if_else(plain, pc.ascii_lower(words.dictionary), words.dictionary).dictionary_encode()
        sizes, flat = self.encoded(keys.dictionary)
        codes = keys.indices.to_numpy()[words.indices.to_numpy()]
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = np.full(ends[-1] + len(texts), END, np.uint32)
        free, keep = np.empty(ends[-1], np.uint32), np.ones(len(out), bool)
        keep[bounds[1:] + np.arange(len(texts))] = False
        for lo in range(0, len(codes), 1 << 18):
            # the ids of some words, one after the other: a run of places for each word
            own, at = codes[lo : lo + (1 << 18)], ends[lo : lo + (1 << 18) + 1]
            places = np.repeat(starts[own] - at[:-1], sizes[own]) + np.arange(at[0], at[-1])
            free[at[0] : at[-1]] = flat[places]
        out[keep] = free
        return out, bounds + np.arange(len(texts) + 1)

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them; some words at a time, as encodings are large."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for lo in range(0, len(words), 1 << 12):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words.slice(lo, 1 << 12).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, sizes[-1].sum()))
        return np.concatenate(sizes), np.concatenate(flat)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row a piece of a document: (doc_id, start, length, ids, doc_tokens, sequence_id, offset), ids as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file on the driver, one whose pre-tokenizer splits at
    white space and between letters and signs, so that equal words of a group are encoded once. Every task packs the
    documents that it reads, in groups of GROUP_BYTES of text, so nothing is shuffled: whole windows
    of a long document are sequences of their own, and what is left of each document is packed by
    ``fill``. A group's last windows become sequences of a power of two, at most eleven a group.

    Null and empty texts are documents of the id END alone. Rows that repeat an id, or have none,
    are documents each. Long texts are whole; one longer than a group is a group. Sequence ids are
    unique but not dense; an empty table gives no rows. Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = WordIds(spec.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, GROUP_BYTES):
                ids, bounds = words.texts(part.column(1))
                sizes = np.diff(bounds)
                whole = [[(d, s, window)] for d in np.flatnonzero(sizes >= window).tolist() for s in range(0, sizes[d] - window + 1, window)]
                rest = [(d, int(k - k % window), int(k % window)) for d, k in enumerate(sizes.tolist()) if k % window]
                rows = []
                for sequence in (*whole, *fill(rest, window)):
                    at = 0
                    for d, start, length in sequence:
                        rows.append((d, start, length, n, at))
                        at += length
                    n += 1
                yield from pieces(part, ids, bounds, sizes, np.array(sorted(rows), np.int64).reshape(-1, 5))

    def pieces(part: pa.RecordBatch, ids: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 4096):
            d, start, length, sequence, at = rows[lo : lo + 4096].T
            first = bounds[d] + start
            data = [ids[a:b].astype("<u4", copy=False).tobytes() for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(data, pa.binary()), pa.array(sizes[d]), pa.array(sequence), pa.array(at)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of every sequence joined in order, as they go to training; a window's pieces meet in one task."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
