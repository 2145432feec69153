"""Answers from memory: many keys share a group's state, and each lives and ends as if it had its own."""

import random
from datetime import datetime, timedelta

import pytest

from weftline.streaming import stream


@pytest.mark.parametrize("groups", [1, 5])
def test_keys_of_a_group(spark, tmp_path, monkeypatch, groups):
    """300 keys in three batches: at most a state for each group (before, one for each key), the answers of a plain fold."""
    monkeypatch.setattr(stream, "GROUPS", groups)
    rng, start = random.Random(9), datetime(2024, 1, 1)
    calls = sorted((start + timedelta(minutes=rng.randrange(600)), i, f"p{rng.randrange(300)}", None if i % 50 == 0 else f"a{i}") for i in range(1500))
    for n in range(3):
        part = [(i, ts, p, 5, own) for ts, i, p, own in calls[n * 500 : n * 500 + 500]]
        spark.createDataFrame(part, "id long, ts timestamp, prompt string, requested int, answer string").coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
    source = spark.readStream.schema("id long, ts timestamp, prompt string, requested int, answer string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    told = stream.answered_from_memory(source, 1800, "1 minute")
    query = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want, held = {}, {}
    for ts, i, p, own in calls:
        alive = p in held and ts <= held[p][1] + timedelta(minutes=30)
        held[p] = held[p] if alive else (own, ts)
        want[i] = (held[p][0], alive)
    assert {r.id: (r.answer, r.served) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want and any(s for _, s in want.values())
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= groups
