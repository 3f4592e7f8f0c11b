"""Nearest vectors through an inverted file: vectors lie on disk by their nearest coarse centre, and a search reads the lists it needs.

The centres are learned by spherical k-means on a bounded sample of the vectors;
then every vector is assigned and written to the folder of its list. A query
probes the lists whose centres are nearly as near as its nearest one. How nearly
(``margin``) is set on the sample, so that a wanted share of true neighbours is
found; a search can also be made exact, as each list's radius bounds how near
its vectors can be. What the probed lists hold is compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dense import _best, _unit
from tessera.operators.sparse import top
from tessera.session import shared_folder

#: Vectors that centres and the margin are learned on, taken by a hash of the id, and queries among them.
SAMPLE, SAMPLE_QUERIES = 32_768, 512
#: Lists at the most; there are about as many as the square root of the vectors.
MOST_LISTS = 4096
#: Vectors and queries of a list that one task compares.
VECTORS, QUERIES = 8192, 512


@dataclass
class VectorIndex:
    """An index at ``path``: vectors (by list), and of its lists the centre, number of vectors and largest angle."""

    path: str
    vectors: DataFrame
    #: Centres of length 1, a row for each list.
    centres: np.ndarray
    sizes: np.ndarray
    #: The largest angle (radians) between a list's centre and its vectors.
    radii: np.ndarray
    margin: float

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        """A saved index; its lists' table is one row for each of at most ``MOST_LISTS``."""
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
        centres = np.array([r["centre"] for r in rows])
        sizes, radii = (np.array([r[c] for r in rows]) for c in ("n", "radius"))
        return VectorIndex(path, _read(spark, f"{path}/vectors"), centres, sizes, radii, rows[0]["margin"] if rows else 0.0)


_SCHEMA = "id long, embedding array<double>, list int"


def _read(spark: SparkSession, path: str) -> DataFrame:
    # The folder's name has the list, so its number comes from there, and a filter on it prunes folders.
    return spark.read.schema(_SCHEMA).parquet(path)


def _sphere(x: np.ndarray, k: int, seed: int, turns: int = 25) -> np.ndarray:
    """k directions by Lloyd's steps on the sphere; one that no vector is nearest to goes to a vector that is far from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        sims = x @ centres.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        new = sums / np.where(norm < 1e-12, 1, norm)[:, None]
        new[empty] = x[np.argsort(sims[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres


def _margin(x: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int) -> float:
    """How far below its best centre a query must go, so that so great a share of its k nearest in the sample is found."""
    if len(x) <= 1:
        return 2.0
    rng = np.random.default_rng(seed)
    asked = np.sort(rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False))
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -2
    k = min(k, len(x) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    own = (x @ centres.T).argmax(axis=1)
    to_centres = x[asked] @ centres.T
    # For each neighbour, how far its list's centre lies below the query's best.
    gap = to_centres.max(axis=1)[:, None] - np.take_along_axis(to_centres, own[near], axis=1)
    return float(np.quantile(gap, recall)) + 1e-12


def _usable(df: DataFrame, key: str) -> DataFrame:
    """(id, embedding) with an id and finite components that are not all zero."""
    plain = df.select(F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id IS NOT NULL")
    finite = F.forall("embedding", lambda x: F.abs(x) < F.lit(float("inf")))
    return plain.where(F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))


def build(vectors: DataFrame, lists: int | None = None, recall: float = 0.985, k: int = 20, seed: int = 42, path: str | None = None) -> VectorIndex:
    """The index of vectors(doc_id, embedding), written to ``path`` or to the folder that executors share.

    Vectors that are null, zero, or hold null or non-finite components are left out.
    ``lists`` is about the square root of their number where it is not given.
    ``recall`` is the share of the k nearest that the margin keeps on the sample.
    """
    spark = vectors.sparkSession
    path = path or shared_folder(spark)
    usable = _usable(vectors, "doc_id")
    n = usable.count()
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 30)))
    table = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
    x = _unit(table["embedding"]) if n else np.zeros((0, 0))
    count = max(1, min(lists or round(n**0.5), MOST_LISTS, len(x))) if n else 0
    centres = _sphere(x, count, seed) if n else x
    margin = _margin(x, centres, k, recall, seed) if n else 0.0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = (_unit(pa.chunked_array([batch["embedding"]])) @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["embedding"], pa.array(own)], names=["id", "embedding", "list"])

    assigned = usable.mapInArrow(assign, _SCHEMA)
    # A list's rows come from several tasks where it is long: as many as its share of an even deal, with room for chance.
    salts = max(1, -(-n // (VECTORS * 64)))
    spread = assigned.repartition("list", F.pmod(F.xxhash64("id"), F.lit(salts)))
    spread.write.partitionBy("list").mode("overwrite").parquet(f"{path}/vectors")
    stored = _read(spark, f"{path}/vectors") if n else spark.createDataFrame([], _SCHEMA)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, lowest = np.zeros(count, dtype=np.int64), np.full(count, 1.0)
        for batch in batches:
            if batch.num_rows:
                own = batch["list"].to_numpy()
                near = (_unit(pa.chunked_array([batch["embedding"]])) * centres[own]).sum(axis=1)
                size += np.bincount(own, minlength=count)
                np.minimum.at(lowest, own, near)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some]), pa.array(lowest[some])], names=["list", "n", "lowest"])

    # Each task gives a row for each list; the rows that come to the driver are one for each list.
    told = {r["list"]: r for r in stored.mapInArrow(spans, "list int, n long, lowest double").groupBy("list").agg(F.sum("n").alias("n"), F.min("lowest").alias("lowest")).collect()}
    rows = [
        (i, [float(v) for v in centres[i]], told[i]["n"] if i in told else 0, float(np.arccos(np.clip(told[i]["lowest"], -1, 1))) if i in told else 0.0, margin)
        for i in range(count)
    ]
    spark.createDataFrame(rows, "list int, centre array<double>, n long, radius double, margin double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return VectorIndex.load(spark, path) if n else VectorIndex(path, stored, centres, np.zeros(0, int), np.zeros(0), 0.0)


def _probes(index: VectorIndex, queries: DataFrame, wanted) -> DataFrame:
    """(id, embedding, list) of each query and list that ``wanted(sims, bound)`` (a row for each query) picks; empty lists are left out."""
    centres, full = index.centres, index.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = np.clip(_unit(pa.chunked_array([batch["embedding"]])) @ centres.T, -1, 1)
                bound = batch["bound"].to_numpy(zero_copy_only=False)
                row, own = np.nonzero(wanted(sims, bound) & full)
                out = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([out["id"], out["embedding"], pa.array(own.astype(np.int32))], names=["id", "embedding", "list"])

    return queries.mapInArrow(run, _SCHEMA)


def _compare(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k of each list's block for each query that probes it."""
    spark = probes.sparkSession
    # A row for each list that is probed.
    asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cuts = [(c, max(1, -(-int(index.sizes[c]) // VECTORS)), max(1, -(-n // QUERIES))) for c, n in asked.items()]
    cut = F.broadcast(spark.createDataFrame(cuts, "list int, nv int, nq int"))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # The lists that are probed are named in the scan, so that others' folders are not read.
    stored = index.vectors.where(F.col("list").isin(*asked)) if asked else index.vectors.where("false")
    left = probes.join(cut, "list").select("id", "embedding", "list", spot("nq").alias("i"), every("nv").alias("j"), F.lit(0).alias("side"))
    right = stored.join(cut, "list").select("id", "embedding", "list", every("nq").alias("i"), spot("nv").alias("j"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("list", "i", "j").applyInArrow(_best(k), "query_id long, doc_id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 20, margin: float | None = None, exact: bool = False) -> DataFrame:
    """The k nearest of each query: query_id, doc_id, score (cosine, 6 digits), rank; ties by id.

    queries(query_id, embedding); those without a usable vector find nothing. A
    query probes the lists whose centre's cosine is within ``margin`` (the index's own
    where it is not given) of its best. An ``exact`` search probes once more: the
    lists that can still hold something as near as the query's k-th best, by the
    angle to the centre and the list's radius.
    """
    spark = queries.sparkSession
    asked = _usable(queries, "query_id")
    if not len(index.centres) or k < 1:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    within = index.margin if margin is None else margin
    near = lambda sims: sims >= sims.max(axis=1, keepdims=True) - within
    first = _compare(index, _probes(index, asked.withColumn("bound", F.lit(0.0)), lambda sims, _: near(sims)), k)
    if not exact:
        return top(first, k)
    from tessera.session import kept

    first = kept(top(first, k))
    radii = index.radii
    # With fewer than k found, nothing can be left out.
    worst = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-1.0).alias("bound"))
    told = asked.join(worst.withColumnRenamed("query_id", "id"), "id", "left").select("id", "embedding", F.coalesce("bound", F.lit(-1.0)).alias("bound"))

    def rest(sims: np.ndarray, bound: np.ndarray) -> np.ndarray:
        # Scores have 6 digits: what rounds to the bound may lie a little below it.
        least = np.arccos(sims) - radii[None, :]
        return ~near(sims) & (np.cos(np.maximum(least, 0)) >= bound[:, None] - 2e-6)

    more = _compare(index, _probes(index, told, rest), k)
    return top(first.select("query_id", "doc_id", "score").unionByName(more), k)
