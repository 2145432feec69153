"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest

import corpus_pipeline
from weftline.llm import decontaminate, jaccard_join, license_scan, mixing, pii, quality_crf, quality_rules, secret_scan, suffix_dedup, warc
from weftline.llm.common import looked_up

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, token string, component_id int, block int, th long, p double, kept string, term string"
LONG = "word other thing " * 40_000
ROWS = [
    (1, "Mail me at ann@example.org or call +1 555 123 4567 today.", "en", "web", 10),
    (1, "Mail me at ann@example.org or call +1 555 123 4567 today.", "en", "web", 10),
    (1, "another text under the same id", None, None, None),
    (None, "text without an id", "xx", None, 3),
    (None, None, None, None, None),
    (2, None, "en", "web", 0),
    (3, "", "de", "books", 0),
    (4, " \t\n ", "fr", "books", 4),
    (5, LONG, "en", "web", len(LONG)),
    (6, LONG, "en", None, len(LONG)),
    (7, "ünïcödé 🙂 text 🙂", "es", "", 17),
]
ITEM = "item_id long, text string"
OPERATORS = {
    "crf": lambda s, d: quality_crf.quality_scores(d, s.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")),
    "secrets": lambda s, d: secret_scan.scan_secrets(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "repeats": lambda s, d: suffix_dedup.remove_repeats(d),
    "jaccard": lambda s, d: jaccard_join.jaccard_classes(d),
    "pii": lambda s, d: pii.sanitise(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
}


def tables(spark):
    extra = tuple([9, "x", 1, 2, 3, 0.5, "k", "t"])
    return spark.createDataFrame([r + extra for r in ROWS], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, tables(spark)).collect()
    key = lambda i: -1 if i is None else i
    assert sorted(key(r.doc_id) for r in got) == sorted(key(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, tables(spark).limit(0)).collect() == []


def test_scans_that_return_findings(spark):
    docs, empty = tables(spark), tables(spark).limit(0)
    items = spark.createDataFrame([(1, None), (None, "a b c d e f g h i j"), (2, ""), (3, "word other thing " * 6)], ITEM)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(5, 3), (6, 3)}
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(docs, items.limit(0)).collect() == []
    assert license_scan.scan_licenses(docs).collect() == [] and license_scan.scan_licenses(empty).collect() == []


def test_jaccard_edges(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(tables(spark)).collect()]
    assert {(5, 3, 5), (6, 3, 5), (3, 0, 3), (4, 0, 4), (2, 0, 2)} <= set(got) and [r for r in got if r[0] is None]


def test_pages(spark, tmp_path):
    schema = "page_id long, url string, html string, type string, record_id string"
    big = "<p>" + "é" * 700 + "\r\n\r\nWARC/1.1 inside</p>"
    rows = [(1, "http://a.b/c", big), (2, "http://a.b/d", big), (2, "http://a.b/d", big), (3, None, None), (4, "http://x", ""), (5, "u r\r\nl", "small"), (6, "u", "small")]
    df = spark.createDataFrame([(*r, "t", "r") for r in rows], schema)
    got = sorted(tuple(r) for r in warc.pages_through_warc(df, f"file://{tmp_path}/a").select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    n = len(big.encode())
    assert set(got) == {(1, n, "revisit", 2), (2, n, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)}
    assert warc.pages_through_warc(df.limit(0), f"file://{tmp_path}/b").collect() == []


def test_captures_join_through_concurrent_to(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<b>{i}</b>") for i in range(5)], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    rows = warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/w")).collect()
    assert len(rows) == 5 and all(len(r.requests) == len(r.metadata) == len(r.mains) == 1 and not r.others for r in rows)
    assert {bytes(r.main.payload) for r in rows} == {f"<b>{i}</b>".encode() for i in range(5)}


def test_pipeline_stages(spark):
    docs = tables(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            assert stage(spark, d, "/root/testdata/sf0.001").columns == docs.columns
    assert corpus_pipeline.mix(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.mix(spark, docs, "").count() > 0


def test_a_key_of_most_rows_is_looked_up(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else 7 if i % 3 else i) for i in range(300)], "id long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in (3, 7, 9)], "k long, v string")
    want = sorted((r.id, r.k, r.v) for r in rows.join(small, "k", "left").select("id", "k", "v").collect())
    key = lambda t: t[0]
    for least in (20, 10_000):
        assert sorted((tuple(r) for r in looked_up(rows, "k", small, least).select("id", "k", "v").collect()), key=key) == sorted(want, key=key)
    assert looked_up(rows.limit(0), "k", small).collect() == []


def test_hot_payload(spark, tmp_path):
    """One payload with most of the pages: all but the largest id revisit it."""
    big = "<p>" + "x" * 1500 + "</p>"
    df = spark.createDataFrame([(i, f"http://h/{i}", big if i % 4 else f"{i}") for i in range(400)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.pages_through_warc(df, f"file://{tmp_path}/hot").collect()}
    assert got == {i: ("response", None) if i % 4 == 0 or i == 399 else ("revisit", 399) for i in range(400)}


def test_no_record_is_lost_between_read_buffers(spark, tmp_path):
    """Records with empty or CRLF-ending bodies, so many that their ends fall on the ends of the reader's buffers."""
    df = spark.range(0, 40_000, 1, 2).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "CASE WHEN id % 3 > 0 THEN repeat('\\r\\n', int(id % 7)) END AS html")
    got = warc.pages_through_warc(df, f"file://{tmp_path}/many").selectExpr("count(*)", "count(DISTINCT page_id)", "sum(payload_bytes)").first()
    want = sum(2 * (i % 7) for i in range(40_000) if i % 3)
    assert tuple(got) == (40_000, 40_000, want)
