"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality_crf import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from weftline.llm.common import shared_dir
    from weftline.llm.warc import pages_through_warc

    return pages_through_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/weftline-warc-{uuid.uuid4().hex}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import sanitise

    return sanitise(table(spark, sf_dir, "documents")).drop("clean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.centroids import clusters

    return clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_crf, op2_warc, op3_secret_scan, op4_mixing, op5_suffix_dedup, op6_decontaminate, op7_license_scan, op8_jaccard_join, op9_pii, op10_quality_rules, op11_centroids, op12_packing, op13_source_divergence)}


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id < m.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < m.top THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.b >= 1000
"""


def op11_sql() -> str:
    """Ten rounds as ten pairs of tables: the nearest centroid of every vector, and the floors of the means."""
    rounds = "".join(
        f""",
     a{i} AS MATERIALIZED (SELECT vec_id, r, v, min_by(c, d * 8 + c) AS c, min(d) AS d FROM (
         SELECT v.*, z.c, CAST(list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - z.v[j]) * (v.v[j] - z.v[j]))) AS BIGINT) AS d FROM v, z{i} AS z) GROUP BY ALL)"""
        + f""",
     z{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, z.v) AS v FROM z{i} AS z LEFT JOIN (
         SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
             SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) AS g(j) GROUP BY c, j) GROUP BY c) AS n USING (c))"""
        * (i < 10)
        for i in range(11)
    )
    return f"""
WITH v AS MATERIALIZED (
         SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
         WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
     z0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM v) WHERE c < 8){rounds},
     t AS (SELECT c, CAST(sum(d) AS BIGINT) AS own FROM a10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(own) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(z10.v, ',')) AS centroid_sha256
FROM a10 JOIN t USING (c) JOIN z10 USING (c)
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     w AS (SELECT lang, source, r, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
     k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
     v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
     n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + 1000000000 * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (k.c + 5) // (v.n + 5 * v.v) AS BIGINT) AS q
           FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
     f AS (SELECT a.lang, a.source, b.source AS item FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS s FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     o AS (SELECT f.lang, f.source, 'pair' AS part, f.item, CAST(coalesce(s.s, 0) AS BIGINT) AS value FROM f LEFT JOIN s USING (lang, source, item)
           UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op11_centroids": op11_sql(), "op13_source_divergence": OP13_SQL}
