"""Clustering by centroids, the nearest found by Orchard's search.

Each centroid has a list of the others by their distance from it. A vector
starts at one centroid and goes down its list; where a nearer centroid is met, the
search jumps to that one's list, those already compared being marked. It ends
where a list's next centroid stands strictly beyond twice the distance to the
best one, as by the triangle inequality neither it nor what follows can be as near.

All arithmetic is in whole numbers: components are floor(64 * x), distances are
squared, new centroids are floors of exact means. A pass adds up, in each task, the
vectors of each cluster; only these sums (a number for each cluster and component)
come to the driver.

What it makes of unusual input: vectors that are null, of another length or with a
null or non-finite component are left out. Ties go to the smaller number of a
centroid. Rows that repeat are vectors of their own; of equal ids the smaller vector
comes first among the starts, and a null id is never a start. With fewer vectors than
centroids there are fewer clusters, with none an empty result. Where components are
so large that a squared distance or a sum of them does not fit a long, it is null.
Columns other than the two named are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

DIMENSIONS, CLUSTERS, ROUNDS, STEPS = 64, 16, 3, 64
#: The seed of the order in which starts are taken.
SEED = 1
# Below these sizes of a component, sums of squares are whole in a double, or in a long.
_DOUBLE, _LONG = 1 << 20, 1 << 27
_MOST = (1 << 63) - 1
_LIMB = 60


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): vectors of the right length whose components are all finite, as doubles."""
    v = F.col("embedding").cast("array<double>").alias("v")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.size("v") == dimensions)
    # A comparison with a null is null, and NaN is larger than all numbers, so neither passes.
    return plain.where(F.coalesce(F.forall("v", lambda x: F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def first_centroids(kept: DataFrame, k: int, steps: int = STEPS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, as whole numbers; k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return [[int(x) for x in np.floor(np.array(r.v) * steps).tolist()] for r in rows]


def whole(flat: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) of components: in doubles or longs where these hold all distances, else in Python's integers."""
    with np.errstate(over="ignore"):
        x = np.floor(flat * steps)
    most = np.abs(x).max(initial=0)
    if most < _DOUBLE:
        return x
    if most < _LONG:
        return x.astype(np.int64)
    return np.array([int(y * steps // 1) if np.isfinite(y * steps) else int(y) * steps for y in flat.ravel().tolist()], dtype=object).reshape(flat.shape)


class Orchard:
    """The lists of some centroids, and the search in them."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, dtype=object)
        most = max((abs(x) for c in centroids for x in c), default=0)
        self.kind = np.float64 if most < _DOUBLE else np.int64 if most < _LONG else object
        gaps = self.exact[:, None, :] - self.exact[None, :, :]
        self.between = (gaps * gaps).sum(axis=2)
        self.lists = np.array([sorted((j for j in range(len(centroids)) if j != i), key=lambda j: (self.between[i, j], j)) for i in range(len(centroids))], dtype=np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; of equal ones the smallest number.

        All rows take a step at a time. ``x`` is what ``whole`` gives.
        """
        kind = max((x.dtype.type, self.kind), key=(np.float64, np.int64, object, np.object_).index)
        x, centroids, between = x.astype(kind, copy=False), self.exact.astype(kind), self.between.astype(kind)

        def distance(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
            gap = x[rows] - centroids[c]
            return (gap * gap).sum(axis=1)

        n, k = len(x), len(centroids)
        best, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        open_, seen = np.arange(n), np.zeros((n, k), dtype=bool)
        seen[:, 0] = True
        near = distance(open_, best)
        while k > 1 and len(open_):
            open_ = open_[place[open_] < k - 1]
            other = self.lists[best[open_], place[open_]]
            go = between[best[open_], other] <= 4 * near[open_]
            open_, other = open_[go], other[go]
            place[open_] += 1
            new = ~seen[open_, other]
            rows, other = open_[new], other[new]
            seen[rows, other] = True
            d = distance(rows, other)
            # At equal distance the smaller number wins; its list serves as well, and only unmarked ones are compared.
            nearer = (d < near[rows]) | ((d == near[rows]) & (other < best[rows]))
            rows, other, d = rows[nearer], other[nearer], d[nearer]
            best[rows], near[rows], place[rows] = other, d, 0
        return best, near


def _batches(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
            yield batch["vec_id"], whole(flat.reshape(batch.num_rows, -1), steps)


def assign(kept: DataFrame, centroids: list[list[int]], steps: int = STEPS) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for ids, x in _batches(batches, steps):
            best, near = search.nearest(x)
            near = [d if d <= _MOST else None for d in map(int, near.tolist())] if near.dtype == object else near.astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(near, pa.int64())], schema=schema)

    return kept.mapInArrow(work, "vec_id long, cluster int, distance long")


def _limbs(n: int) -> list[tuple[int, int]]:
    """A whole number of any size as longs that can be added: (place, part), the last one with the sign."""
    out = []
    while not -1 << 62 < n < 1 << 62:
        out.append((len(out), n & (1 << _LIMB) - 1))
        n >>= _LIMB
    return [*out, (len(out), n)]


def moved(kept: DataFrame, centroids: list[list[int]], steps: int = STEPS) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors; one without vectors stays."""
    k, width = len(centroids), len(centroids[0])
    schema = pa.schema([("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums = Orchard(centroids), np.zeros((k, width + 1), dtype=object)
        for _, x in _batches(batches, steps):
            best, _ = search.nearest(x)
            for c in np.unique(best).tolist():
                own = x[best == c]
                sums[c, :width] += [int(s) for s in own.sum(axis=0).tolist()]
                sums[c, width] += len(own)
        rows = [(i, *limb) for i, s in enumerate(sums.ravel().tolist()) if s for limb in _limbs(s)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)] if rows else [[], [], []], schema=schema)

    parts = kept.mapInArrow(work, "place int, limb int, value long")
    rows = parts.groupBy("place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = np.zeros(k * (width + 1), dtype=object)
    for r in rows:
        sums[r.place] += int(r.value) << _LIMB * r.limb
    sums = sums.reshape(k, width + 1)
    return [[int(s) // int(own[width]) for s in own[:width]] if own[width] else c for own, c in zip(sums, centroids)]


def cluster_report(vectors: DataFrame, dimensions: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, steps: int = STEPS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions)
    centroids = first_centroids(kept, k, steps, seed)
    if not centroids:
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], none)
    for _ in range(rounds):
        centroids = moved(kept, centroids, steps)
    found = written(assign(kept, centroids, steps))
    # A row for each cluster.
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    missing = F.max(F.col("distance").isNull())
    rows = found.groupBy("cluster").agg(total.alias("total"), missing.alias("missing")).collect()
    own = {r.cluster: None if r.missing or r.total > _MOST else int(r.total) for r in rows}
    every = None if None in own.values() or sum(own.values()) > _MOST else sum(own.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame(
        [(c, own[c], every, digests[c]) for c in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
