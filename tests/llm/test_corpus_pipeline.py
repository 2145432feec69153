"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weftline.llm import quality_rules
from weftline.llm.common import table, written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_rules_drop_what_they_reject(stages):
    kept = {r.doc_id for r in quality_rules.quality_rules(stages[0]).where("kept").collect()}
    assert {r.doc_id for r in stages[1].select("doc_id").collect()} == kept


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, (_, c) in brute.jaccard_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == want and len(want) < len(rows)


def test_benchmark_passages_go(spark, stages):
    flat = lambda t: " ".join(brute.WORD.findall((t or "").lower()))
    items = [x for x in (flat(r.text) for r in table(spark, SF, "benchmark").collect()) if len(x.split()) >= 12]
    before, after = ({r.doc_id: flat(r.text) for r in s.collect()} for s in stages[2:4])
    assert any(x in t for t in before.values() for x in items) and not any(x in t for t in after.values() for x in items)
    assert len(after) > 0.5 * len(before)


def test_personal_data_goes(stages):
    assert {r.doc_id for r in stages[3].select("doc_id").collect()} == {r.doc_id for r in stages[4].select("doc_id").collect()}
    texts = [r.text for r in stages[4].select("text").collect()]
    assert sum(sum(brute.personal(t)[:1]) for t in texts) == 0 and any("<EMAIL>" in t for t in texts)


def test_mix_is_near_its_targets(stages):
    size = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    before, after = ({r.source: (r.n, r.most) for r in s.groupBy("source").agg(F.sum(size).alias("n"), F.max(size).alias("most")).collect()} for s in (stages[4], stages[5]))
    want = brute.mix_targets({s: n for s, (n, _) in before.items()})
    for s, (n, most) in before.items():
        assert abs(after.get(s, (0, 0))[0] - want[s]) <= most
    assert stages[5].agg(F.max("copy")).first()[0] <= 2


def test_registered_run_gives_the_same_rows(spark, stages):
    key = lambda df: sorted((r.doc_id, r.copy) for r in df.select("doc_id", "copy").collect())
    assert key(cp.run(spark, SF)) == key(stages[-1])
