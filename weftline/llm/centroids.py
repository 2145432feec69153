"""Centroid clustering by kd-tree filtering: trees over blocks of vectors hold counts, sums and boxes; all arithmetic is of integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, written

#: Components of a vector, units of a component, and the largest integer of one: distances then fit in 64 bits.
DIMS, UNITS, MOST = 64, 1024, 1 << 27
CENTROIDS, ROUNDS, SEED = 8, 10, "3"
#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 1 << 14, 16
#: A tree: ids and integers of its vectors in the order of the leaves; for every node its run of them, its children (-1: leaf), sums and box.
TREE = "n int, ids binary, known binary, v binary, lo binary, hi binary, left binary, right binary, sums binary, least binary, most binary"


def integer_vectors(df: DataFrame, dims: int = DIMS, units: int = UNITS) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` finite components as integers floor(units * x), held within MOST either way."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = (F.size("embedding") == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.floor(F.greatest(F.least(units * c, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return df.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.transform(x, held).alias("v"))


class Tree:
    """A kd-tree over the rows of v: each node is cut at the median of its widest dimension, until LEAF rows are left.

    Rows are reordered (``order``), so that a node is a run lo:hi of them. Equal rows are cut like
    others, so depth is bounded whatever repeats.
    """

    def __init__(self, v: np.ndarray):
        self.order, nodes, children = np.arange(len(v)), [(0, len(v))], []
        self.least, self.most = [], []
        for lo, hi in nodes:  # grows while it is read: children come after their parent
            own = v[self.order[lo:hi]]
            low, high = own.min(0), own.max(0)
            self.least.append(low)
            self.most.append(high)
            if hi - lo <= LEAF:
                children.append((-1, -1))
                continue
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, int(np.argmax(high.astype(np.int64) - low))], mid)]
            children.append((len(nodes), len(nodes) + 1))
            nodes += [(lo, lo + mid), (lo + mid, hi)]
        self.v = v[self.order]
        self.lo, self.hi = np.array(nodes, np.int32).T
        self.left, self.right = np.array(children, np.int32).T
        self.least, self.most = np.array(self.least), np.array(self.most)
        ends = np.concatenate([np.zeros((1, v.shape[1]), np.int64), np.cumsum(self.v, 0, dtype=np.int64)])
        self.sums = ends[self.hi] - ends[self.lo]


def trees(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """Trees over the vectors as each task reads them, in blocks of BLOCK; nothing is shuffled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                tree = Tree(part.column(1).flatten().to_numpy().reshape(-1, dims))
                ids, known = part.column(0).fill_null(0).to_numpy()[tree.order], part.column(0).is_valid().to_numpy(zero_copy_only=False)[tree.order]
                data = (ids, known, tree.v, tree.lo, tree.hi, tree.left, tree.right, tree.sums, tree.least, tree.most)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data)], [f.split()[0] for f in TREE.split(", ")])

    return vectors.mapInArrow(build, TREE)


def nearest(tree: dict[str, np.ndarray], z: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Centroids of a tree's vectors by filtering: whole nodes as (node, centroid), then vectors of leaves and their centroids.

    Level by level, a centroid that is strictly farther from every point of a node's box than
    another is pruned there; the corner of the box that favours it most decides. Ties keep both, so
    that they go to the smaller number. A node with one centroid left is assigned whole; in leaves,
    vectors are compared with the centroids that are left.
    """
    nodes, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    whole, leaves, masks = [], [], []
    while len(nodes):
        low, high = tree["least"][nodes].astype(np.int64), tree["most"][nodes].astype(np.int64)
        far = np.stack([((low + high - 2.0 * c) ** 2).sum(1) for c in z.astype(np.float64)], 1)
        best = np.where(left, far, np.inf).argmin(1)
        keep = left.copy()
        for c in range(len(z)):
            rows = np.flatnonzero(left[:, c] & (best != c))
            own = z[best[rows]]
            corner = np.where(z[c] > own, high[rows], low[rows])
            keep[rows, c] = ((corner - z[c]) ** 2).sum(1) <= ((corner - own) ** 2).sum(1)
        one = keep.sum(1) == 1
        whole += zip(nodes[one].tolist(), keep[one].argmax(1).tolist(), strict=True)
        leaf = ~one & (tree["left"][nodes] < 0)
        leaves.append(nodes[leaf])
        masks.append(keep[leaf])
        on = ~one & ~leaf
        nodes, left = np.concatenate([tree["left"][nodes[on]], tree["right"][nodes[on]]]), np.concatenate([keep[on], keep[on]])
    leaf, mask = np.concatenate(leaves), np.concatenate(masks)
    sizes = tree["hi"][leaf] - tree["lo"][leaf]
    rows = np.repeat(tree["lo"][leaf] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    asked = np.repeat(mask, sizes, axis=0)
    distance = np.full((len(rows), len(z)), np.iinfo(np.int64).max)
    for c in range(len(z)):
        at = np.flatnonzero(asked[:, c])
        distance[at, c] = ((tree["v"][rows[at]] - z[c]) ** 2).sum(1)
    return whole, rows, distance.argmin(1)


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[dict[str, np.ndarray]]:
    kinds = {"ids": np.int64, "known": bool, "v": np.int32, "lo": np.int32, "hi": np.int32, "left": np.int32, "right": np.int32, "sums": np.int64, "least": np.int32, "most": np.int32}
    for batch in batches:
        for row in range(batch.num_rows):
            t = {name: np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in kinds.items() if name in batch.schema.names}
            t |= {name: t[name].reshape(-1, dims) for name in ("v", "sums", "least", "most")}
            yield t


def assigned_sums(forest: DataFrame, z: np.ndarray) -> list:
    """(cluster, d, n, s) of every centroid that gets vectors and every dimension: summed in the tasks, then over them, a row a number of z to the driver at most."""
    dims = z.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
        for t in _read(batches, dims):
            whole, rows, clusters = nearest(t, z)
            for node, c in whole:
                n[c] += t["hi"][node] - t["lo"][node]
                sums[c] += t["sums"][node]
            n += np.bincount(clusters, minlength=len(z))
            for c in np.unique(clusters):
                sums[c] += t["v"][rows[clusters == c]].sum(0, dtype=np.int64)
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(n[got]), pa.array(sums[got].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = forest.drop("ids", "known").mapInArrow(task, "cluster int, n long, sums array<long>")
    return parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def assigned(forest: DataFrame, z: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = z.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _read(batches, dims):
            whole, rows, clusters = nearest(t, z)
            own = np.zeros(len(t["v"]), np.int64)
            for node, c in whole:
                own[t["lo"][node] : t["hi"][node]] = c
            own[rows] = clusters
            distance = ((t["v"] - z[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(t["ids"], mask=~t["known"]), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(task, "vec_id long, cluster int, distance long")


def clusters(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dims: int = DIMS, units: int = UNITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every kept vector after ``rounds`` rounds of exact k-means.

    Vectors of another length and those with null or non-finite components are left out; components
    beyond MOST / units are held there, so that every distance fits in 64 bits. The first centroids
    are the k vectors with the least hashes of seed and id, of equal ones those with the smaller
    components; fewer vectors make fewer centroids. A null id hashes last. Rows that repeat an id are
    vectors each. An empty table gives no rows. Only vec_id and embedding are read.

    Trees are built once over the vectors as they are read, and written; each round reads the trees
    and brings counts and sums of k centroids to the driver, whatever the number of vectors.
    """
    vectors = integer_vectors(df, dims, units)
    first = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    z = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    forest = written(trees(vectors, dims), "trees")
    for _ in range(rounds if len(z) else 0):
        new = z.copy()
        for r in assigned_sums(forest, z):
            new[r["cluster"], r["d"]] = r["s"] // r["n"]
        if (new == z).all():
            break  # all further rounds would repeat this one
        z = new
    out = written(assigned(forest, z), "assigned")
    discard(forest)
    totals = out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    inertia, of = sum(r["d"] for r in totals), {r["cluster"]: r["d"] for r in totals}
    named = [(c, of.get(c, 0), inertia, row.tolist(), hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(z)]
    centroids = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return out.join(F.broadcast(centroids), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
