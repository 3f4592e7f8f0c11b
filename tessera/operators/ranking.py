"""Merging, capping, reranking and diversifying ranked lists.

A ranked list has query_id, doc_id and rank (from 1) and may carry more columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def _first_wins(df: DataFrame, *order: str) -> DataFrame:
    """Each document of a query once, at its first place; rank anew by ``order``."""
    seen = Window.partitionBy("query_id", "doc_id").orderBy(*order)
    rank = Window.partitionBy("query_id").orderBy(*order)
    once = df.withColumn("_seen", F.row_number().over(seen)).where("_seen = 1").drop("_seen")
    return once.withColumn("rank", F.row_number().over(rank))


def merge(*lists: DataFrame) -> DataFrame:
    """All of the first list, then what is new in the next, and so on: query_id, doc_id, rank."""
    parts = [x.select("query_id", "doc_id", F.lit(i).alias("_list"), F.col("rank").alias("_pos")) for i, x in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _first_wins(out, "_list", "_pos").select("query_id", "doc_id", "rank")


def quota_merge(a: DataFrame, b: DataFrame, k: int, quota: int) -> DataFrame:
    """``quota`` of list a and k - quota of b, each document once, then filled up to k with the rest of a, then of b."""
    quota = min(max(0, quota), max(0, k))
    part = lambda df, n, first, rest: df.select(
        "query_id", "doc_id", F.when(F.col("rank") <= n, first).otherwise(rest).alias("_list"), F.col("rank").alias("_pos")
    )
    both = part(a, quota, 0, 2).unionByName(part(b, k - quota, 1, 3))
    return _first_wins(both, "_list", "_pos").where(F.col("rank") <= max(0, k)).select("query_id", "doc_id", "rank")


def cap_parents(ranked: DataFrame, parent: Column, cap: int = 2) -> DataFrame:
    """The first ``cap`` rows of each parent by rank; a row without a parent is alone. The rank stays."""
    own = F.when(parent.isNull(), F.col("doc_id"))
    group = Window.partitionBy("query_id", parent, own).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(group)).where(F.col("_n") <= cap).drop("_n")


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's distinct tokens that the text has."""
    wanted = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(wanted, tokens(text))) / F.nullif(F.size(wanted), F.lit(0)), F.lit(0.0))


def rerank(ranked: DataFrame, score: Column, pool: int = 0) -> DataFrame:
    """By score (clamped to 0..1, null is 0), ties in the order before; with ``pool`` the first so many."""
    clean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "_before")
    out = ranked.withColumn("rerank_score", F.round(clean, 6)).withColumnRenamed("rank", "_before")
    out = out.withColumn("rank", F.row_number().over(order)).drop("_before")
    return out.where(F.col("rank") <= pool) if pool > 0 else out


def mmr_order(query: np.ndarray, docs: np.ndarray, k: int, weight: float, fixed: int = 3) -> list[int]:
    """Places of the documents that maximal marginal relevance picks; the first ``fixed`` are taken as they come.

    Each next one has the most of weight * sim(query, d) - (1 - weight) * the
    largest similarity to one that is picked; the first of equals wins. A zero
    query picks the first k.
    """
    n = len(docs)
    size = np.linalg.norm(query)
    if n <= fixed or k <= fixed or size == 0:
        return list(range(min(k, n)))
    weight = min(1.0, max(0.0, weight))
    norms = np.linalg.norm(docs, axis=1, keepdims=True)
    docs = docs / np.where(norms == 0, 1, norms)
    to_query, among = np.round(docs @ (query / size), 9), np.round(docs @ docs.T, 9)
    picked = list(range(fixed))
    nearest = among[:, picked].max(axis=1)
    while len(picked) < min(k, n):
        value = np.round(weight * to_query - (1 - weight) * nearest, 9)
        value[picked] = -np.inf
        best = int(np.argmax(value))
        picked.append(best)
        nearest = np.maximum(nearest, among[:, best])
    return picked


def diversify(ranked: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's pool: ranked with embedding and query_embedding.

    A query's pool is a bounded list, so it is one small group. Where the query or
    one of its pool has no vector, or one of another length, the order stays.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank")
        query, docs = pool["query_embedding"].iloc[0], list(pool["embedding"])
        if query is None or any(x is None or len(x) != len(query) for x in docs):
            picked = list(range(min(k, len(pool))))
        else:
            picked = mmr_order(np.asarray(query, dtype=float), np.stack([np.asarray(x, dtype=float) for x in docs]), k, weight)
        return pd.DataFrame({"query_id": pool["query_id"].iloc[0], "doc_id": pool["doc_id"].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    return ranked.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int")


def last_n(rows: DataFrame, scope: str, order: str, n: int) -> DataFrame:
    """The last n rows of each scope by ``order``."""
    w = Window.partitionBy(scope).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def cited(ranked: DataFrame, numbers: DataFrame, limit: int = 3) -> DataFrame:
    """Documents that answers cite by place: numbers(query_id, source) with ranked, best score first, ties by place."""
    found = ranked.join(numbers.select("query_id", F.col("source").alias("rank")).distinct(), ["query_id", "rank"])
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
