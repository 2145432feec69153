"""Mixing sources to target weights: pivotal dependent rounding in a distributed reduction tree."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of a block at the leaves, and residuals that meet in a block above.
LEAF, FAN = 4096, 512
WORDS = "[^ \\t-\\r]+"


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target): one row a source.

    Sources in code point order, null last, take the weights in turn. The level L at which
    min(most * size, L * weight) adds up to share * all sizes is found by raising L over the sources
    that are not capped yet; the driver sees two sums a round.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)  # one row a source
    by = written(by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        held, free, count = by.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        if not free or count == capped:
            break
        capped, level = count, (share * total - most * held) / free
    return by.select("source", "source_size", "n", F.least(F.col("source_size") * F.lit(most), F.lit(level) * F.col("weight")).alias("target"))


def pivot(p: np.ndarray, s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities p of items of size s so that sum(p * s) stays, up to one item left fractional.

    Two fractional items meet; mass moves from one to the other, in words, either way with the
    probabilities that keep each one's expectation, until one of them is 0 or 1.
    """
    out, draws = p.copy(), rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not 0.0 < out[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        sa, sb = s[held], s[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        if draws[i] * (up + down) < down:
            if (1 - a) * sa <= b * sb:
                out[held], out[i] = 1.0, b - up / sb
                held = i if 0.0 < out[i] < 1.0 else -1
            else:
                out[held], out[i] = a + up / sa, 0.0
        elif a * sa <= (1 - b) * sb:
            out[held], out[i] = 0.0, b + down / sb
            held = i if 0.0 < out[i] < 1.0 else -1
        else:
            out[held], out[i] = a - down / sa, 1.0
    return out


def _step(seed: int, depth: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Round one block; the last residual of a source goes to the nearer side."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("spot", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("base", "ascending")])
        name, number = block.column("source")[0].as_py(), block.column("block")[0].as_py()
        rng = np.random.default_rng([seed, depth, number, *(name.encode() if name is not None else b"\xff")])
        p = pivot(block.column("p").to_numpy(), block.column("size").to_numpy().astype(float), rng)
        if last:
            odd = (p > 0) & (p < 1)
            p[odd] = p[odd] >= 0.5
        parent = pa.array(np.full(len(p), number // FAN, np.int64))
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p)).set_column(block.schema.get_field_index("block"), "block", parent)

    return run


SCHEMA = "doc_id long, source string, size long, base int, p double, spot long, block long"


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: int = 11,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row for each row of docs.

    Every document of a source starts with target / source_size copies; the whole part is kept and
    the rest is rounded by pivot() in blocks of about LEAF documents that are dealt by a hash of the
    id, so that a source with a third of all rows spreads over many tasks. Each block leaves one
    fractional document at most; FAN blocks' residuals meet in the next level, and the last one of a
    source goes to the nearer of 0 and 1, so that words taken miss the target by half a document at most. Decisions depend on
    ids, sizes and the seed alone, so reruns agree. A null source is a source of its own (last); null
    texts and texts without words have size 0 and keep the whole part; a null id is hashed like a
    value; rows that repeat an id are rounded as documents of their own; a source without words has
    target 0; no document is taken more than ceil(most) times.
    """
    rows = written(sizes(docs, id_col, text_col, source_col), "sizes")
    by = written(targets(rows, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = rows["source"].eqNullSafe(by["source"])
    spot = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 40))
    blocks = F.ceil(F.col("n") / LEAF)
    at = (
        rows.join(by, same)
        .select(rows["doc_id"], rows["source"], "size", rate.alias("rate"), spot.alias("spot"), (F.floor(spot / F.lit(float(1 << 40)) * blocks)).alias("block"))
        .select("doc_id", "source", "size", F.floor("rate").cast("int").alias("base"), F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("p"), "spot", "block")
    )
    widest = by.agg(F.max(F.ceil(F.col("n") / LEAF))).first()[0] or 1
    done, depth = None, 0
    while True:
        last = widest == 1

        out = written(at.groupBy("source", "block").applyInArrow(_step(seed, depth, last), SCHEMA), "rounded")
        whole = out.where("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        at, widest, depth = out.where("p > 0 and p < 1"), -(-widest // FAN), depth + 1
    copies = (F.col("base") + F.col("p")).cast("int")
    return done.join(by, done["source"].eqNullSafe(by["source"])).select("doc_id", "size", done["source"], "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def taken_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as planned, with ``copy`` from 1; rows that repeat an id each as the most planned of them.

    A column of docs that is called ``copy`` (in any case) stays, and the number is then called ``copy_``, and so on.
    """
    names = {c.lower() for c in docs.columns}
    copy, key = "copy", "weftline_id"
    while copy in names:
        copy += "_"
    while key in names:
        key += "_"
    p = plan.groupBy("doc_id").agg(F.max("copies").alias("n")).where("n > 0").select(F.col("doc_id").alias(key), F.explode(F.sequence(F.lit(1), "n")).alias(copy))
    return docs.join(p, docs["doc_id"].eqNullSafe(p[key])).drop(key)
