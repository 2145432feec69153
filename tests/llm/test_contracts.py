"""The registered queries against plain versions, over the whole small tables."""

import random

import brute
import duckdb
import pyarrow.parquet as pq
import pytest

from weftline.llm import decontaminate, jaccard_join, queries, suffix_dedup

SF = "/root/testdata/sf0.01"


def rows_of(name, *cols, sf=SF):
    t = pq.read_table(f"{sf}/{name}.parquet", columns=list(cols))
    return list(zip(*(t.column(c).to_pylist() for c in cols)))


@pytest.fixture(scope="module")
def docs():
    return rows_of("documents", "doc_id", "text")


def test_secret_counts_and_spans(spark, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op3_secret_scan(spark, SF).collect()}
    assert got == {i: brute.secrets(t) for i, t in docs} and sum(sum(x[:3]) for x in got.values()) > 0


def test_personal_data_counts_and_spans(spark, docs):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op9_pii(spark, SF).collect()}
    assert got == {i: brute.personal(t) for i, t in docs} and sum(x[0] for x in got.values()) > 0


def test_quality_counts(spark, docs):
    rows = queries.op10_quality_rules(spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: brute.counting_rules(t) for i, t in docs}
    assert not any(r.kept and r.base_failed for r in rows)
    good = {i for i, q in rows_of("labels", "doc_id", "quality") if q == 1}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_classifier_on_held_out_documents(spark, docs):
    rows = {r.doc_id: r for r in queries.op1_quality_crf(spark, SF).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(rows[i].score, q) for i, q in rows_of("labels", "doc_id", "quality") if q is not None and rows[i].held_out]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9


def test_warc_round_trip_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    q = db.execute(queries.OP2_SQL)
    names = [d[0] for d in q.description]
    want = sorted((dict(zip(names, r)) for r in q.fetchall()), key=lambda r: r["page_id"])
    got = sorted((r.asDict() for r in queries.op2_warc(spark, SF).collect()), key=lambda r: r["page_id"])
    assert got == want


def test_mix_meets_its_targets(spark):
    texts = rows_of("documents", "doc_id", "text", "source")
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _ in texts}
    total = {}
    for i, _, s in texts:
        total[s] = total.get(s, 0) + size[i]
    want = brute.mix_targets(total)
    rows = queries.op4_mixing(spark, SF).collect()
    again = queries.op4_mixing(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert {r.doc_id: r["size"] for r in rows} == size
    source, taken = {i: s for i, _, s in texts}, dict.fromkeys(total, 0)
    for r in rows:
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s)


def test_jaccard_classes(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, SF).collect()}
    assert got == brute.jaccard_components(docs, 4, 85) and any(i != c for i, (_, c) in got.items())


def test_jaccard_classes_of_near_copies_around_the_threshold(spark):
    """Many texts with one long passage and few words of their own, so that similarities lie on both sides of the threshold."""
    draw = random.Random(5)
    stem = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(stem)
        for _ in range(draw.choice([0, 1, 2, 3, 8])):
            words[draw.randrange(60)] = f"x{draw.randrange(400)}"
        rows.append((i, " ".join(words + [f"y{draw.randrange(9)}"] * draw.randrange(3))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, k=k, percent=percent).collect()}
        assert got == brute.jaccard_components(rows, k, percent)


def test_repeats_are_removed(spark):
    rows = rows_of("documents", "doc_id", "text", sf="/root/testdata/sf0.001")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute.without_repeats(rows, 400) and any(x[1] for x in got.values())


def test_repeats_of_any_shape(spark):
    """Short alphabets, periods, overlaps and partial copies; with few contexts allowed, the way for very many is taken."""
    draw = random.Random(3)
    stock = "".join(draw.choice("abcd ") for _ in range(3000))
    rows = [(0, "ab" * 300), (1, "z" * 500), (2, None), (3, "é" * 100)]
    for i in range(4, 60):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(2800)
            parts += [stock[at : at + draw.randrange(20, 200)], "".join(draw.choice("abcd ") for _ in range(draw.randrange(60)))]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.without_repeats(rows, 50)
    for most in (256, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=50, most=most).collect()}
        assert got == want


def test_leaks_of_whole_items(spark, docs):
    items = rows_of("benchmark", "item_id", "text")
    flat = lambda t: " ".join(brute.WORD.findall((t or "").lower()))
    texts = [(i, flat(t)) for i, t in docs]
    want = {(i, j) for j, item in items for i, t in texts if len(flat(item).split()) >= 12 and flat(item) in t}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert want and want <= got


def test_reworded_questions_are_leaks(spark):
    item = "A train from Oslo covers 120 km in 3 hours before it stops, so how fast did the train from Oslo move on average during the trip?"
    same = "Intro words here. A train from Bergen covers 450 km in 5 hours before it stops, so how fast did the train from Bergen move on average during the trip?"
    odd = "Intro words here. A train from Bergen covers 450 km in 5 hours before it stops, so how fast did the train from Narvik move on average during the trip?"
    d = spark.createDataFrame([(1, same), (2, odd), (3, item), (4, "nothing of the kind is told in this other text at all")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.reworded for r in decontaminate.leaks(d, b).collect()}
    assert got[1] is True and got[3] is False and 2 not in got and 4 not in got


def test_licenses(spark):
    from weftline.llm.license_scan import scan_licenses

    text = "Some text before.\nLicensed under the Apache License, Version 2.0.\nAnd after."
    rows = [(1, text), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "no such thing"), (5, None), (6, "Our license to operate is a word of thanks.")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "GPL-3.0"}
    assert text[got[1].start : got[1].stop] == "Licensed under the Apache License, Version 2.0." and not got[1].missing and not got[1].added
    assert queries.op7_license_scan(spark, SF).count() > 0
