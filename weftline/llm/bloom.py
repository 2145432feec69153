"""A Bloom filter of 64-bit keys, of bounded size, built by the tasks and sent to the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import mix

#: 8 MB at most; more keys than that suits only let more rows through.
MAX_BITS = 1 << 26
PART = 4096
GOLD = 0x9E3779B97F4A7C15


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(keys.view(np.uint64) + np.uint64(i * GOLD % (1 << 64))) & np.uint64(bits - 1) for i in (1, 2, 3)]


def holds(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; all that were put in are."""
    ok = np.ones(len(keys), bool)
    for p in places(keys, 8 * len(packed)):
        ok &= (packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def build(keys: DataFrame) -> np.ndarray:
    """The filter of the first column of ``keys`` (long, no nulls): a row a task and part, or-ed, at most MAX_BITS to the driver."""
    n = keys.count()
    bits = min(MAX_BITS, max(8 * PART, 1 << (16 * n).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for p in places(batch.column(0).to_numpy(), bits):
                own[p] = True
        packed = np.packbits(own, bitorder="little")
        some = [i for i in range(len(packed) // PART) if packed[i * PART : (i + 1) * PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i * PART : (i + 1) * PART].tobytes() for i in some], pa.binary())], ["part", "bits"])

    def either(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([both.tobytes()], pa.binary())})

    packed = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(either, "part int, bits binary").toLocalIterator():
        packed[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["bits"], np.uint8)
    return packed
