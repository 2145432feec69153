"""Centroids by kd-tree filtering, packing with minimum bin slack, and divergences from tries, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import centroids, divergence, packing, queries, tries

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_clusters(rows, k, rounds, seed, dims):
    """{vec_id: (cluster, distance)} and the centroids, of (vec_id, list) rows."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    z = [v for _, v in by_hash[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(z))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        z = [[sum(x) // len(own[i]) for x in zip(*own[i])] if own[i] else c for i, c in enumerate(z)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), z


@pytest.mark.parametrize("kind", ["table", "grid", "copies"])
def test_clusters_equal_plain_rounds(spark, kind):
    rng = random.Random(5)
    if kind == "table":
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
        dims, k = 64, 8
    elif kind == "grid":  # few values, so many vectors are as near to two centroids
        rows, dims, k = [(i, [rng.randrange(3) / 1024 for _ in range(2)]) for i in range(300)], 2, 8
    else:
        rows, dims, k = [(i % 5, [0.5, 0.25] if i % 3 else [float(i), -float(i)]) for i in range(90)], 2, 8
    rows += [(None, [0.1] * dims), (7, None), (8, [0.1] * (dims - 1)), (9, [None] + [0.1] * (dims - 1)), (9, [float("nan")] + [0.1] * (dims - 1)), (9, [float("-inf")] + [0.1] * (dims - 1))]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    want, z = plain_clusters(rows, k, 4, "3", dims)
    got = centroids.clusters(df, k, 4, "3", dims).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert {r.cluster: r.centroid for r in got} == {c: z[c] for _, c, _ in want}
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    assert {r.cluster: r.cluster_inertia for r in got} == {c: sum(d for _, o, d in want if o == c) for _, c, _ in want}


def test_few_vectors_and_large_components(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.clusters(df, 8, 10, "3", 2).collect()}
    assert {d for _, d in got.values()} == {0} and {c for c, _ in got.values()} == {0, 1}
    assert centroids.clusters(df.limit(0), 8, 10, "3", 2).collect() == []


def test_filtering_prunes_and_stays_exact():
    """Well separated groups are assigned by whole nodes; every vector has the nearest centroid, the smaller number of equals."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 50, (2000, 4)) + shift for shift in (0, 1000, 2000)]).astype(np.int32)
    t = centroids.Tree(v)
    tree = {n: getattr(t, n) for n in ("v", "lo", "hi", "left", "right", "sums", "least", "most")}
    z = np.array([[25] * 4, [1025] * 4, [2025] * 4, [1025] * 4])
    whole, rows, clusters = centroids.nearest(tree, z)
    own = np.full(len(v), -1)
    for node, c in whole:
        own[t.lo[node] : t.hi[node]] = c
        assert (t.sums[node] == t.v[t.lo[node] : t.hi[node]].sum(0)).all()
    own[rows] = clusters
    assert (own == ((t.v[:, None].astype(int) - z) ** 2).sum(2).argmin(1)).all() and sorted(t.order) == list(range(len(v)))
    assert len(rows) <= 2100  # only what ties between the two equal centroids needs its leaves


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 5)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_subset_is_the_best(counts, room):
    used = packing.subset(counts, room)
    sums = {0}
    for n, k in counts:
        sums = {s + j * n for s in sums for j in range(k + 1) if s + j * n <= room}
    assert all(0 < k <= dict(counts)[n] for n, k in used.items()) and sum(n * k for n, k in used.items()) == max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_fill_needs_no_padding(sizes):
    out = list(packing.fill([(d, 0, n) for d, n in enumerate(sizes)], 64))
    ids = Counter((d, i) for s in out for d, start, n in s for i in range(start, start + n))
    assert ids == Counter((d, i) for d, n in enumerate(sizes) for i in range(n))
    lengths = [sum(p[2] for p in s) for s in out]
    assert all(n & (n - 1) == 0 and 0 < n <= 64 for n in lengths) and sum(n < 64 for n in lengths) <= 6


def test_equal_lengths_are_cut(spark):
    assert all(sum(p[2] for p in s) == 2048 for s in packing.fill([(d, 0, 700) for d in range(2048)]))


def test_packing_keeps_every_id(spark):
    """The query on a whole table, and texts where cutting into words could matter."""
    odd = ["don't stop.'s x,'ll A.B (c)d", "H̱ ẖ İ K é .́ ,̸x", "<|endoftext|> <|ENDOFTEXT|> a.<|startoftext|>b <|", "  \x1c\x85nbsp\x0b\x0c\r\n", "1,234.5!?)z", "é,ß&&&ÿ%% ɏ#1$́ ø*̸", "", None, "日本語。テキスト、", "🙂👍🏽! ﬁne", "w " * 9000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (3, "again")], "doc_id long, text string")).withColumn("ids", docs["doc_id"])
    texts = defaultdict(list)
    t = Tokenizer.from_file(TOKENIZER)
    for r in docs.collect():
        texts[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, TOKENIZER).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, wanted in texts.items():
        if len(wanted) == 1:
            assert [x for _, ids, _ in sorted(by_doc[i]) for x in ids] == wanted[0] and {n for *_, n in by_doc[i]} == {len(wanted[0])}, i
    assert sum(len(ids) for rows in by_doc.values() for _, ids, _ in rows) == sum(len(w) for ws in texts.values() for w in ws)
    ends = {s: sum(n for _, n in rows) for s, rows in by_sequence.items()}
    for s, rows in by_sequence.items():
        assert [a for a, _ in sorted(rows)] == list(np.cumsum([0] + [n for _, n in sorted(rows)])[:-1])
    assert all(n & (n - 1) == 0 and n <= 2048 for n in ends.values())
    assert packing.pack(docs.limit(0), TOKENIZER).collect() == []


def test_query_digests_and_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three " * 1500), (2, "four")], "doc_id long, text string")
    rows = packing.pack(docs, TOKENIZER)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(rows).collect()}
    assert sum(map(len, whole.values())) == 4 * (4501 + 2)
    for r in rows.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    got = queries.op12_packing(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t = Tokenizer.from_file(TOKENIZER)
    for r in got[:100]:
        ids = (t.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [1])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abé日🙂", max_size=5), st.integers(0, 2), st.integers(1, 3)), max_size=30), min_size=1, max_size=4), st.integers(1, 6), st.integers(0, 3))
def test_tries_merge_and_read_in_order(parts, burst, deepest):
    """However early containers burst and however deep, merged tries hold all counters and are read in the order of bytes."""
    before = tries.BURST, tries.DEEPEST
    tries.BURST, tries.DEEPEST = burst, deepest
    try:
        whole, want = tries.Trie(), Counter()
        for part in parts:
            own = tries.Trie()
            for lo in range(0, len(part), 7):
                some = part[lo : lo + 7]
                own.add(tries.Leaves.of(pa.array([t for t, *_ in some], pa.large_string()), np.arange(len(some)), *np.array([(s, n, 1) for _, s, n in some]).T))
                want.update({(t, s): 0 for t, s, _ in some})
            for t, s, n in part:
                want[t, s] += n
            whole.merge(own)
        got = [(c.terms[int(p)].as_py(), int(s), int(n)) for c in whole.containers() for p, s, n in zip(c.place, c.source, c.n)]
    finally:
        tries.BURST, tries.DEEPEST = before
    assert [g[:2] for g in got] == sorted(want, key=lambda k: (k[0].encode(), k[1])) and {g[:2]: g[2] for g in got} == dict(want)


def plain_divergence(rows, least):
    import re

    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs = Counter(t for a, _, ts in found if a == lang for t in set(ts))
        kept = {t for t, d in docs.items() if d >= least}
        counts = defaultdict(Counter)
        for a, s, ts in found:
            if a == lang:
                counts[s].update(t for t in ts if t in kept)
                counts[s].update([])
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, by = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(abs(by[s][t] - by[o][t]) for t in kept), o.encode(), "pair") for o in counts if o != s]
            terms = sorted((q[t] - by[s][t], t.encode(), "term") for t in kept if counts[s][t] and by[s][t] > q[t])[:50]
            for ranked in (sorted(pairs), terms):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item, part) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_plain_version(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ünï", "日本", "Zz", "a", "aa", "ab", "🙂", "straße", "É", "é", "x1y", "don't"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(" ".join(rng.choices(words[: 6 + 4 * (i % 4)], k=rng.randrange(30))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", "z", None])) for i in range(300)]
    rows += [(None, "fr", "only"), ("", "xx", "a"), (" 12 ", "xx", "b"), ("rare", "xx", "c"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, source string, n int, part string").repartition(4)
    for least in (1, 8, 30):
        got = divergence.divergence(df, least)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_divergence(rows, least)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_chunks_blocks_and_full_tries(spark, monkeypatch):
    """What bounds memory changes nothing: few terms a chunk, few sources a block, tries sent on early."""
    rows = [(f"common w{chr(97 + i % 26)} {chr(97 + i % 7)}x", "en", f"s{i % 9}") for i in range(200)]
    groups = pa.table({"lang": ["en"] * 5, "source": list("abcde"), "n": [3, 4, 5, 6, None], "v": [3] * 5})
    terms = pa.table({"term": ["x", "y", "z"], "sources": [["a", "b"], ["c"], ["d", "a"]], "n": [[1, 4], [5], [6, 2]]})
    one = sorted(r for t in divergence.compared(terms, groups) for r in map(str, t.to_pylist()))
    monkeypatch.setattr(divergence, "SOURCES", 2)
    assert sorted(r for t in divergence.compared(terms, groups) for r in map(str, t.to_pylist())) == one
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    leaves = divergence.leaf_counts(df).groupBy("term").sum("n").collect()
    assert {r[0]: r[1] for r in leaves if r[0]} == Counter(w for t, *_ in rows for w in t.split())


def test_shares_are_exact_at_any_size():
    counts, totals = np.array([[0, 10**13, 7 * 10**9]]), np.array([10**13 + 5, 3 * 10**13, 10**10])
    assert divergence.shares(counts, totals).tolist() == [[1 + (int(c) + 5) * 10**9 // int(t) for c, t in zip(counts[0], totals)]]
