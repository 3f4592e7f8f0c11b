"""Dense retrieval: exact nearest vectors by cosine, worked out block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sparse import top

#: Rows of a block of vectors and of queries.
VECTORS, QUERIES = 8192, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def check_dimension(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``vectors``, failing as it is read where a vector has another length."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit(f"a vector has not {dim} dimensions")).isNull())


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(norm == 0, 1, norm)


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        q, v = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out: tuple[list, list, list] = ([], [], [])
        if q.num_rows and v.num_rows:
            sims = np.round(_unit(q["embedding"]) @ _unit(v["embedding"]).T, 6)
            ids = v["id"].to_numpy()
            for row, query in zip(sims, q["id"].to_pylist()):
                best = np.lexsort((ids, -row))[:k]
                out[0].extend([query] * len(best))
                out[1].extend(ids[best].tolist())
                out[2].extend(row[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k vectors nearest to each query: query_id, doc_id, score (cosine, 6 digits), rank; ties by id.

    vectors(doc_id, embedding), queries(query_id, embedding). Null vectors are
    left out. Each block of vectors gives its best k for each block of queries,
    so what is shuffled is the vectors once for each block of queries.
    """
    v = vectors.select(F.col("doc_id").alias("id"), "embedding").where("embedding is not null and id is not null")
    q = queries.select(F.col("query_id").alias("id"), "embedding").where("embedding is not null and id is not null")
    count = lambda df, size: max(1, -(-df.count() // size))
    nv, nq = count(v, VECTORS), count(q, QUERIES)
    spot = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("i", spot(nq)).withColumn("j", every(nv)).withColumn("side", F.lit(0))
    right = v.withColumn("j", spot(nv)).withColumn("i", every(nq)).withColumn("side", F.lit(1))
    part = left.unionByName(right).groupBy("i", "j").applyInArrow(_best(k), "query_id long, doc_id long, score double")
    return top(part, k)
