"""Quality classifier: a linear-chain conditional random field over lines, with neighbouring-line features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER_VALUES, Rolling, slices, text_bytes, word_bounds

#: Parameters: labelled documents that the model is fitted on at most, bins a feature, fitting steps, ridge, threshold.
MAX_TRAIN = 4000
BINS = 10
STEPS = 80
RIDGE = 1e-3
THRESHOLD = 0.3

#: Byte classes, as the bytes in each.
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "symbol": [ord(c) for c in "#*$%&|<>@=+~^_{}[]\\/"],
    "shout": [ord("!"), ord("?")],
    "point": [ord(c) for c in ".,;:'\"()-"],
    "high": [*range(192, 256)],
}
ROLL = Rolling(0xB5297A4D3F84D5A7, LOWER_VALUES)
NAMES = ("words", "word_len", "upper", "digit", "symbol", "shout", "point", "high", "again", "copied", "short")


def line_features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, row): one row for each line with a word, in order; row is the document's number."""
    starts, ends, _ = word_bounds(raw, offs)
    if not len(starts):
        return np.zeros((0, len(NAMES)), np.float32), np.zeros(0), np.zeros(0, np.int64)
    breaks = np.union1d(np.flatnonzero(raw == 10) + 1, offs)
    line = np.searchsorted(breaks, starts, "right") - 1
    used, first = np.unique(line, return_index=True)
    lo, hi = breaks[used], ends[np.append(first[1:], len(starts)) - 1]
    count = np.diff(np.append(first, len(starts)))
    total = (hi - lo).astype(float)
    sums = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, np.int32)
        table[members] = 1
        run = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(table[raw], out=run[1:])
        sums[name] = (run[hi] - run[lo]).astype(float)
    hashes = ROLL.ranges(ROLL.sums(raw), starts, ends)
    again = np.zeros(len(starts))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    short = (ends - starts <= 3).astype(float)
    row = np.searchsorted(offs, lo, "right") - 1
    whole = ROLL.ranges(ROLL.sums(raw), starts[first], hi) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    copied = np.ones(len(used))
    copied[np.unique(whole, return_index=True)[1]] = 0
    chars = np.add.reduceat(ends - starts, first)
    letters = np.maximum(sums["upper"] + sums["lower"] + sums["high"], 1)
    cols = [
        np.log1p(count), chars / count, sums["upper"] / letters, sums["digit"] / total, sums["symbol"] / count, sums["shout"] / count, sums["point"] / count,
        sums["high"] / letters, np.add.reduceat(again, first) / count, copied, np.add.reduceat(short, first) / count,
    ]
    return np.stack(cols, 1).astype(np.float32), total, row


def chain(score: np.ndarray, trans: np.ndarray, starts: np.ndarray, lens: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    score: log-odds of state 1 of every line; trans[a, b]: log-weight of b after a. Returns each
    line's marginal of state 1 and, if asked, the expected transition counts of each chain.
    """
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    n, most = len(score), int(lens[0]) if len(lens) else 0
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    live = np.searchsorted(-lens, -np.arange(most), "left")
    emit = np.stack([np.zeros(n), score], 1)
    for t in range(most):
        at = starts[: live[t]] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            before = alpha[at - 1]
            alpha[at] = emit[at] + np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
            alpha[at] -= alpha[at].max(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        after = beta[at + 1] + emit[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + after[:, :1], trans[:, 1] + after[:, 1:])
        beta[at] -= beta[at].max(1, keepdims=True)
    both = alpha + beta
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    expected = np.zeros((0, 2, 2))
    if pairs:
        inner = np.ones(n, bool)
        inner[starts[lens > 0]] = False
        at = np.flatnonzero(inner)
        joint = alpha[at - 1][:, :, None] + trans[None] + (emit[at] + beta[at])[:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        expected = np.exp(joint)
        expected /= expected.sum((1, 2), keepdims=True)
    return marginal, expected


@dataclass
class Model:
    """Bin edges a feature; weights (own, previous, next line) x feature x bin, the last bin for no such line; transitions; calibration."""

    edges: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], "right") for j in range(x.shape[1])], 1) if len(x) else np.zeros((0, len(NAMES)), np.int64)

    def neighbours(self, b: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """The bins of the line itself, the one before and the one after it in the same document."""
        none = np.full((1, b.shape[1]), BINS)
        same = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
        before = np.concatenate([none, np.where(same[:, None], b[:-1], BINS)])[: len(b)]
        after = np.concatenate([np.where(same[:, None], b[1:], BINS), none])[: len(b)]
        return [b, before, after]

    def line_scores(self, x: np.ndarray, row: np.ndarray) -> np.ndarray:
        out, cols = np.zeros(len(x)), np.arange(x.shape[1])
        for k, b in enumerate(self.neighbours(self.bins(x), row)):
            out += self.weights[k][cols, b].sum(1)
        return out

    def documents(self, x: np.ndarray, length: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean of the lines' marginals for each of n documents; NaN without lines."""
        found, starts, lens = np.unique(row, return_index=True, return_counts=True)
        out = np.full(n, np.nan)
        if len(found):
            good, _ = chain(self.line_scores(x, row), self.trans, starts, lens)
            out[found] = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
        return out

    def score(self, mean: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(mean), 0.0, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(mean) + self.shift))))


def _adam(params: list[np.ndarray], grads, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, steps + 1):
        for k, g in enumerate(grads()):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] += rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)


def _edges(values: np.ndarray) -> np.ndarray:
    """BINS - 1 bin edges: quantiles, of the values above 0 where a tenth or more are 0, which have the first bin."""
    if np.count_nonzero(values <= 0) * BINS < len(values) or not (values > 0).any():
        return np.quantile(values, np.arange(1, BINS) / BINS) if len(values) else np.zeros(BINS - 1)
    return np.concatenate([[1e-9], np.quantile(values[values > 0], np.arange(1, BINS - 1) / (BINS - 1))])


def fit(x: np.ndarray, length: np.ndarray, row: np.ndarray, label: np.ndarray) -> Model:
    """Fit to documents whose every line carries the document's label; each document weighs alike.

    Maximises the conditional likelihood of the label chains less a ridge, then fits a logistic
    curve of the document label over the aggregated marginals. Deterministic.
    """
    d = len(NAMES)
    edges = np.stack([_edges(x[:, j]) for j in range(d)])
    model = Model(edges, np.zeros((3, d, BINS + 1)), np.zeros((2, 2)), 0.0, 0.0)
    if len(np.unique(label)) < 2:
        model.shift = 0.0 if not len(label) else 4.0 * float(label[0]) - 2.0
        return model
    found, starts, lens = np.unique(row, return_index=True, return_counts=True)
    y = label[row]
    weight = (1 / lens)[np.searchsorted(found, row)] / len(found)
    inner = np.ones(len(x), bool)
    inner[starts] = False
    stays = np.zeros((2, 2))
    np.add.at(stays, (y[inner], y[inner]), weight[inner])
    bins = model.neighbours(model.bins(x), row)
    cols = np.arange(d)

    def grads() -> list[np.ndarray]:
        good, expected = chain(model.line_scores(x, row), model.trans, starts, lens, pairs=True)
        gap, gw = (y - good) * weight, np.zeros_like(model.weights)
        for k, b in enumerate(bins):
            for j in cols:
                gw[k, j] = np.bincount(b[:, j], gap, BINS + 1)
        gt = stays - (expected * weight[inner][:, None, None]).sum(0)
        return [gw - RIDGE * model.weights, gt - RIDGE * model.trans]

    _adam([model.weights, model.trans], grads, STEPS, 0.1)
    mean = model.documents(x, length, row, len(label))
    use = ~np.isnan(mean)
    ab = np.array([4.0, -2.0])

    def curve() -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-(ab[0] * mean[use] + ab[1])))
        gap = label[use] - p
        return [np.array([(gap * mean[use]).mean(), gap.mean()]) - 1e-4 * ab]

    _adam([ab], curve, 1500, 0.05)
    model.slope, model.shift = float(ab[0]), float(ab[1])
    return model


_LINE = "doc long, label int, f array<float>, length double"


def training_lines(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Line features of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # ``most`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                x, length, row = line_features(*text_bytes(part.column(2)))
                ids, label = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(label[row].astype(np.int32)), f, pa.array(length)], ["doc", "label", "f", "length"])

    return some.mapInArrow(run, _LINE)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fit on the driver; what reaches it is the line features of ``most`` documents."""
    got = training_lines(docs.selectExpr("doc_id", "cast(text as string) as text"), labels, most).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(NAMES)), np.float32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    doc = got.column("doc").to_numpy()
    order = np.argsort(doc, kind="stable")
    x = got.column("f").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))[order]
    found, row = np.unique(doc[order], return_inverse=True)
    label = np.zeros(len(found), np.int64)
    label[row] = got.column("label").to_numpy()[order]
    return fit(x, got.column("length").to_numpy()[order], row, label)


def quality_scores(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, good_share), one row for each row of docs.

    Lines are the parts between line feeds that hold a word. A text without words (null, empty,
    blank) has score 0. A null id is not held out. Repeated rows and ids give repeated results;
    repeated labels of an id count as 1 if any is; null labels and ids are left out of the fit; with
    no label, or only one kind, the score is constant. Other columns are ignored.
    """
    base = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    model = model or fitted(base, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                x, length, row = line_features(*text_bytes(part.column(1)))
                mean = model.documents(x, length, row, part.num_rows)
                score = model.score(mean)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.nan_to_num(mean))], ["doc_id", "score", "predicted", "good_share"])

    out = base.mapInArrow(run, "doc_id long, score double, predicted int, good_share double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "good_share")
