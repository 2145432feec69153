"""Source divergence audit: how far the sources of a language are from each other and which terms set one apart, from mergeable byte tries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import discard, slices, text_bytes, written
from weftline.llm.tries import Leaves, Trie

#: Documents that a kept term occurs in, the scale and prior of a share, and terms a group.
LEAST_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Counters that a task's tries hold before they are sent on, bytes of text counted at once (a longer text alone); terms and sources that are compared at once.
LEAVES, TEXT_BYTES, TERMS, SOURCES = 1 << 21, 1 << 24, 1 << 13, 128
#: Terms are runs of ASCII letters and all that is not ASCII, in lower case: every other byte becomes a space.
TO_TERMS = np.array([b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256)], np.uint8)
LEAF = "lang string, term string, source string, n long, docs long"
LEAF_NAMES = [f.split()[0] for f in LEAF.split(", ")]


def leaf_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs): occurrences and documents of every term by source, as each task's tries hold them, a trie a language, read in the order of bytes.

    The empty term stands for the documents of a group themselves.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, sources, leaves = {}, {}, 0
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                for lang, own in counted(part, sources):
                    tries.setdefault(lang, Trie()).add(own)
                    leaves += len(own.n)
                if leaves > LEAVES:
                    yield from sent(tries, sources)
                    tries, leaves = {}, 0
        yield from sent(tries, sources)

    def sent(tries: dict[str, Trie], sources: dict[str, int]) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(sources), pa.string())
        for lang, trie in tries.items():
            for c in trie.containers():
                terms = c.terms.cast(pa.string()).take(pa.array(c.place))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(c.n)), terms, names.take(pa.array(c.source)), pa.array(c.n), pa.array(c.docs)], LEAF_NAMES)

    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))).mapInArrow(task, LEAF)


def counted(part: pa.RecordBatch, sources: dict[str, int]) -> Iterator[tuple[str, Leaves]]:
    """(lang, leaves) of some documents; ``sources`` numbers the sources as they come."""
    raw, bounds = text_bytes(part.column(0))
    data = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(TO_TERMS[raw]))
    split = pc.ascii_split_whitespace(data)
    coded = split.flatten().dictionary_encode()
    terms = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
    of_source = np.array([sources.setdefault(s, len(sources)) for s in part.column(2).to_pylist()], np.int64)
    langs = part.column(1).dictionary_encode()
    ends = split.offsets.to_numpy()
    # a pair of document and term once, with its number of occurrences; the empty term once a document
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    pairs, n = np.unique(doc * len(terms) + coded.indices.to_numpy(), return_counts=True)
    pairs, n = np.concatenate([pairs, np.arange(len(bounds) - 1) * len(terms) + len(terms) - 1]), np.concatenate([n, np.zeros(len(bounds) - 1, np.int64)])
    doc, term = np.divmod(pairs, len(terms))
    own_lang = langs.indices.to_numpy()[doc]
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        at = np.flatnonzero(own_lang == i)
        used, place = np.unique(term[at], return_inverse=True)
        yield lang, Leaves.of(terms.take(pa.array(used)), place, of_source[doc[at]], n[at], np.ones(len(at), np.int64))


KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


KEPT = "lang string, term string, sources array<string>, n array<long>"


def kept_terms(leaves: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, sources, n): terms of ``least`` documents of their language, merged by ranges of terms.

    A range's tries come as sorted leaves, so equal leaves follow each other and are summed as they
    pass: a range of any size is merged in little memory.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            whole = whole.combine_chunks()
            first = starts(whole)
            yield merged(whole.slice(0, first[-1]), first)
            rest = whole.slice(first[-1])
            if rest.num_rows > 1 << 16:  # one term from many tasks: sum what there is of it
                rest = rest.group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(LEAF_NAMES)
        if rest is not None:
            yield merged(rest, np.array([0, rest.num_rows]))

    def starts(rows: pa.Table) -> np.ndarray:
        """Where terms begin."""
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in ("term", "lang"):
            c = rows.column(name)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows.num_rows - 1)).to_numpy()
        return np.flatnonzero(new)

    def merged(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """The kept ones of the terms that begin at ``first``; the last entry ends the last term."""
        out = []
        docs = np.add.reduceat(rows.column("docs").to_numpy(), first[:-1]) if len(first) > 1 else first[:0]
        for i in np.flatnonzero(docs >= least).tolist():
            lang, term, sources, n, _ = (c.to_pylist() for c in rows.slice(first[i], first[i + 1] - first[i]).columns)
            own = Counter()
            for source, k in zip(sources, n, strict=True):
                own[source] += k
            out.append((lang[0], term[0], list(own), list(own.values())))
        return _batch(out, KEPT)

    ranges = leaves.where("term <> ''").repartitionByRange("term", "lang").sortWithinPartitions("term", "lang")
    return ranges.mapInArrow(task, KEPT)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exact at any size: as 64-bit integers where they suffice, else as Python's."""
    if (int(counts.max(initial=0)) + PRIOR) * SCALE >= 1 << 63:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + (counts + PRIOR) * SCALE // totals).astype(np.int64)


FOUND = "lang string, source string, part string, item string, value long"


def compared(terms: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """What a chunk of a language's terms adds to the distance of every two sources, and each source's TOP terms in it.

    Sources are compared in blocks of SOURCES, so the arrays are bounded whatever their number.
    """
    lang = groups.column("lang")[0].as_py()
    groups = groups.sort_by("source")
    sources, prior = groups.column("source").to_pylist(), PRIOR * (groups.column("v")[0].as_py() or 0)
    totals = np.array([(n or 0) + prior for n in groups.column("n").to_pylist()], np.int64)
    of = {s: i for i, s in enumerate(sources)}
    names, all_counts = terms.column("term").to_pylist(), terms.column("n").to_pylist()
    sizes = np.array([len(c) for c in all_counts], np.int64)
    row = np.repeat(np.arange(len(names)), sizes)
    column = np.array([of[s] for row_sources in terms.column("sources").to_pylist() for s in row_sources], np.int64)
    count = np.array([c for counts in all_counts for c in counts], np.int64)
    whole = np.zeros(len(names), np.int64)
    np.add.at(whole, row, count)
    total = np.array([sum((n or 0) for n in groups.column("n").to_pylist()) + prior], np.int64)

    def block(lo: int) -> tuple[np.ndarray, np.ndarray]:
        dense = np.zeros((len(names), min(SOURCES, len(sources) - lo)), np.int64)
        at = (column >= lo) & (column < lo + dense.shape[1])
        dense[row[at], column[at] - lo] = count[at]
        return dense, shares(dense, totals[lo : lo + dense.shape[1]]) if len(names) else dense

    q = shares(whole, total) if len(names) else whole
    for a in range(0, len(sources), SOURCES):
        counts, p = block(a)
        rows = []
        for i in range(p.shape[1]):
            over = np.where(counts[:, i] > 0, p[:, i] - q, 0)
            some = np.flatnonzero(over > 0)
            # terms are in the order of bytes, so a stable sort leaves ties in it
            best = some[np.argsort(-over[some], kind="stable")[:TOP]]
            rows += [(lang, sources[a + i], "term", names[t], int(over[t])) for t in best.tolist()]
        yield _batch(rows, FOUND)
        for b in range(0, len(sources), SOURCES):
            other = p if a == b else block(b)[1]
            for i in range(p.shape[1]):
                value = np.abs(other - p[:, i : i + 1]).sum(0).tolist()
                yield _batch([(lang, sources[a + i], "pair", sources[b + j], value[j]) for j in range(len(value)) if a + i != b + j], FOUND)


def divergence(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of a language, and up to TOP terms that set a source apart.

    Shares and distances are exact integers. Null texts, languages and sources are read as '', which
    is a language or source of its own; doc_id is not read, so repeated rows are documents each. A
    group without kept terms has pairs of value 0 or of the others' shares, and no terms; a language
    of one source has no pairs. Ties are ordered by the bytes of the item. Long texts are whole. An
    empty table gives no rows; other columns are not read.

    What is shuffled are leaves, a row a task, term and source, and kept terms; a term of all
    documents comes once from each task. All pairs of a language's sources are asked for, so the
    result itself grows with their square; beside it, partial sums of a chunk do.
    """
    leaves = written(leaf_counts(docs), "leaves")
    kept = written(kept_terms(leaves, least), "kept")
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.n").alias("n"))
    groups = leaves.where("term = ''").select("lang", "source").distinct().join(counts, ["lang", "source"], "left")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = written(groups.join(sizes, "lang", "left"), "groups")
    discard(leaves)
    # chunks of about TERMS terms; each of them meets all sources of its language, and a language without terms has one for its pairs
    chunks = groups.select("lang", F.explode(F.sequence(F.lit(0), F.floor(F.coalesce("v", F.lit(0)) / TERMS).cast("int"))).alias("chunk"), "source", "n", "v")
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.floor(F.col("v") / TERMS) + 1).cast("int"))
    key = ["lang", "chunk"]

    def chunk_compared(terms: pa.Table, sources: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(compared(terms.sort_by("term"), sources)))

    found = dealt.groupBy(key).cogroup(chunks.groupBy(key)).applyInArrow(chunk_compared, FOUND)
    found = written(found, "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
