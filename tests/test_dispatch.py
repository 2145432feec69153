"""Templates, waves of providers, answers from memory over several batches, and wrapping."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.operators import dispatch
from weftline.plans import dispatch_queries as q
from weftline.sources import sinks
from weftline.streaming import stream


def test_placeholders(spark):
    rows = [("{a} and {b}{a}", {"a": "{b}", "b": None}), ("{none} {a", {"a": "x"}), ("", {}), ("{a}", {}), (None, {"a": "x"}), ("no {1} {} names", {"a": "x"}), ("{z}{z}{y}", {})]
    df = spark.createDataFrame(rows, "t string, v map<string,string>")
    got = [(r.f.text, r.f.missing) if r.f.text is not None else None for r in df.select(dispatch.filled(F.col("t"), F.col("v")).alias("f")).collect()]
    assert got == [("{b} and {b}", []), ("{none} {a", ["none"]), ("", []), ("{a}", ["a"]), None, ("no {1} {} names", []), ("{z}{z}{y}", ["z", "y"])]


def waves(spark, responses, chain, prompts=((1, "d", 1), (2, "d", 2), (3, "d", 3), (4, "e", 1), (5, None, 1))):
    r = spark.createDataFrame(responses, "provider string, prompt_id long, body string, quota boolean")
    out = dispatch.answered_in_waves(spark.createDataFrame(list(prompts), "prompt_id long, day string, turn long"), r, chain)
    return {x.prompt_id: (x.answer, x.provider, x.tried) for x in out.collect()}


def test_waves(spark):
    responses = [("a", 1, "a1", False), ("a", 2, "over", True), ("a", 3, "a3", False), ("a", 4, " ", False), ("b", 2, "b2", None), ("b", 3, None, False), ("b", 4, "b4", False), ("b", 1, "b1", False), ("x", 3, "x3", False)]
    assert waves(spark, responses, ["a", "b"]) == {1: ("a1", "a", []), 2: ("b2", "b", ["a"]), 3: (None, None, ["a", "b"]), 4: ("b4", "b", ["a"]), 5: (None, None, ["a", "b"])}
    assert waves(spark, responses, ["a", "b", "x"])[3] == ("x3", "x", ["a", "b"])
    assert waves(spark, responses, []) == {i: (None, None, []) for i in range(1, 6)}
    assert waves(spark, responses, ["none", "a"])[1] == ("a1", "a", ["none"])
    # a quota error in a later call takes nothing back, and one day's error leaves the next alone
    assert waves(spark, [("a", i, f"a{i}", i == 3) for i in range(1, 6)], ["a"]) == {1: ("a1", "a", []), 2: ("a2", "a", []), 3: (None, None, ["a"]), 4: ("a4", "a", []), 5: ("a5", "a", [])}
    assert dispatch.answered_in_waves(spark.createDataFrame([], "prompt_id long, day string, turn long"), spark.createDataFrame([], "provider string, prompt_id long, body string, quota boolean"), ["a"]).collect() == []


def test_memory_lives_over_batches(spark, tmp_path):
    """Three files, a batch each: answers are served across batches until the time to live ends, and forgotten then."""
    start = datetime(2024, 1, 1)
    calls = [(i, start + timedelta(minutes=m), p, 5, f"a{i}") for i, (m, p) in enumerate([(0, "x"), (1, "y"), (10, "x"), (29, "x"), (30, "x"), (31, "x"), (40, "y"), (61, "x"), (62, "x"), (62, "z"), (300, "x")])]
    schema = "id long, ts timestamp, prompt string, requested int, answer string"
    for n, part in enumerate((calls[:3], calls[3:8], calls[8:])):
        spark.createDataFrame([*part, (99, None, "x", 5, "lost")], schema).coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    told = stream.answered_from_memory(source, 1800, "1 minute")
    told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.answer, r.served) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, held = {}, {}
    for i, ts, p, _, own in calls:
        alive = p in held and ts <= held[p][1] + timedelta(minutes=30)
        held[p] = held[p] if alive else (own, ts)
        want[i] = (held[p][0], alive)
    assert got == want and sum(s for _, s in want.values()) == 4


def test_wrapped_lines_of_a_whole_table(spark):
    width = lambda w: sum(q.WIDTHS.get(c, q.OTHER) for c in w)
    want = {}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        for n, line in enumerate((d.text or "").split("\n") if d.text is not None else []):
            rows, room = [], 0.0
            for w in line.split():
                fits = rows and room + q.SPACE + width(w) <= q.MOST
                rows = [*rows[:-1], f"{rows[-1]} {w}"] if fits else [*rows, w]
                room = room + q.SPACE + width(w) if fits else width(w)
            want |= {(d.doc_id, n, i): r for i, r in enumerate(rows)}
    got = q.wrapped_lines(spark, "/root/testdata/sf0.001")
    assert {(r.doc_id, r.line_no, r.row): r.text for r in got.collect()} == want


def test_upserts(spark, tmp_path):
    """Late and repeated batches change nothing; buckets that no update touches keep their files."""
    path, schema = str(tmp_path / "t"), "id long, batch long, status string"
    put = lambda *rows: sinks.upserted(spark.createDataFrame(list(rows), schema), path, "id", 8)
    table = lambda: {r.id: (r.batch, r.status) for r in spark.read.parquet(path).collect()}
    files = lambda: {f.parent.name: f.name for f in sorted((tmp_path / "t").rglob("*.parquet"))}
    put()
    put(*((i, 1, "queued") for i in range(20)), (None, 1, "none"))
    before = files()
    put((3, 2, "done"), (3, 1, "late"), (50, 2, "new"))
    after = files()
    assert table() == {i: (1, "queued") for i in range(20)} | {None: (1, "none"), 3: (2, "done"), 50: (2, "new")}
    assert 0 < sum(before[b] == after[b] for b in before) < len(before)
    put((3, 1, "queued"), (50, 2, "new"), (50, 2, "a"))
    assert table()[3] == (2, "done") and table()[50] == (2, "new")
