"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", ["packed_sentences", "document_sections", "adjacent_turn_similarity", "model_slides", "ranked_images", "rect_clusters", "spaced_calls", "formatted_runs", "keyword_hints"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
