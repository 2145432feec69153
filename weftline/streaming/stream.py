"""Streaming forms, an extension: lines and sections are per document, so they run on any stream of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weftline.operators.structure import structure


def document_stream(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of Parquet files as they arrive under a path or pattern."""
    return spark.readStream.schema(schema).parquet(path)


def memoised(prompts: DataFrame, seconds: int = 1800) -> DataFrame:
    """The first of equal prompts within the time to live; prompts: ts, prompt, requested."""
    keyed = prompts.withColumn("prompt_hash", F.sha2(F.concat_ws("\u0001", "prompt", F.col("requested").cast("string")), 256))
    return keyed.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["prompt_hash"])


ANSWERED = "prompt_hash string, id long, ts timestamp, answer string, served boolean"

#: Keys are dealt by hash over so many groups, which a stream keeps from its first batch on: a call of Python for each key costs far more than its rows.
GROUPS = 1024


def answered_from_memory(calls: DataFrame, seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(prompt_hash, id, ts, answer, served): every call with the answer that is stored for its prompt, while it lives, else with its own.

    calls: id, ts, prompt, requested, answer (what a call at that time gets). A key's answer is kept
    from the call that got it until ``seconds`` later, the last moment included; then it is dropped,
    by the group's next batch or, if none comes, by a timer on the watermark. Calls of a batch are
    taken by time and id, those of a group of keys in memory, so bound batches by maxFilesPerTrigger;
    null times are left out. State is one answer for each key that lives, by groups.
    """
    ttl = seconds * 1_000_000

    def task(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {h: (answer, at) for h, answer, at in zip(*state.get, strict=True)} if state.exists else {}
        out = None
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "id"])
            answers, served = [], []
            for h, ts, own in zip(rows["prompt_hash"], rows["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), rows["answer"], strict=True):
                stored = held.get(h)
                alive = stored is not None and ts <= stored[1] + ttl
                if not alive:
                    stored = held[h] = (own, ts)
                answers.append(stored[0])
                served.append(alive)
            out = pd.DataFrame({"prompt_hash": rows["prompt_hash"].to_numpy(), "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "answer": answers, "served": served})
        ends = {h: (at + ttl) // 1000 + 1 for h, (_, at) in held.items()}
        alive = [h for h, end in ends.items() if end > state.getCurrentWatermarkMs()]
        if alive:
            state.update((alive, [held[h][0] for h in alive], [held[h][1] for h in alive]))
            state.setTimeoutTimestamp(min(ends[h] for h in alive))
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    keyed = calls.where("ts is not null").withColumn("prompt_hash", F.sha2(F.concat_ws("\u0001", "prompt", F.col("requested").cast("string")), 256))
    told = keyed.select(F.pmod(F.xxhash64("prompt_hash"), F.lit(GROUPS)).alias("group"), "prompt_hash", "id", "ts", "answer").withWatermark("ts", late).groupBy("group")
    return told.applyInPandasWithState(task, ANSWERED, "hashes array<string>, answers array<string>, ats array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sections_sink(docs: DataFrame, out: str, checkpoint: str, normalise):
    """Sections of arriving documents, batch by batch; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        structure(normalise(batch))[1].write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window, closed by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
