"""What the operators share: the shared folder, written tables, reading, Arrow slices and text hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that a numpy pass holds at once; one longer document goes alone.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on one machine only (tests), one set here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for frame in frames:
        jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(conf).delete(path, True)


def looked_up(rows: DataFrame, key: str, small: DataFrame, least: int = 10_000) -> DataFrame:
    """Left join of rows with ``small``, one row a ``key``; no key's rows meet in one task, however many there are.

    Hot keys have more than a thousandth of all keyed rows and more than ``least`` rows, so at most a
    thousand keys are hot: their rows of ``small`` are broadcast. All other rows are shuffled by
    key, or stay where they are if they have none. Both inputs are read more than once.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > max(least, total // 1000)).select(key).collect()]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    keyed = rows.where(F.col(key).isNotNull() & ~is_hot).join(small.where(~is_hot), key, "left")
    new = [F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name != key]
    out = keyed.unionByName(rows.where(F.col(key).isNull()).select("*", *new))
    return out.unionByName(rows.where(is_hot).join(F.broadcast(small.where(is_hot)), key, "left")) if hot else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text in ``column`` together (a longer row alone)."""
    offs = offsets(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's bounds in them; nulls are empty."""
    offs = offsets(col)
    data = col.buffers()[2] if len(col) else None
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words in byte positions, and for each row the first word's number and the last's + 1."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~SPACES[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any byte range by prefix sums modulo 2**64, over bytes mapped to 64-bit values."""

    def __init__(self, base: int, values: np.ndarray):
        self.base, self.inv, self.values = np.uint64(base), np.uint64(pow(base, -1, 1 << 64)), values
        self.pows = self.invs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.pows) <= n:
            size = max(n + 1, 2 * len(self.pows), 1 << 16)
            for name, by in (("pows", self.base), ("invs", self.inv)):
                step = np.full(size, by)
                step[0] = 1
                setattr(self, name, np.cumprod(step, dtype=np.uint64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.pows[: len(raw)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[hi] - sums[lo]) * self.invs[lo] + (hi - lo).astype(np.uint64))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
