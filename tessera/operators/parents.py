"""Joins between chunks and what they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: lookup tables keep what came first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def restore(hits: DataFrame, originals: DataFrame, keys: list[str], sparse: Column, order: list[str]) -> DataFrame:
    """Hits of the sparse stage with the text of their original chunk, others and unmatched ones as they are."""
    # Only originals that a hit asks for are put in order; none move where no hit can be sparse.
    asked = originals.join(hits.where(sparse).select(*keys).distinct(), keys, "left_semi")
    known = first_of(asked, keys, order).select(*keys, F.col("text").alias("_original"))
    out = hits.join(known, keys, "left")
    return out.withColumn("text", F.when(sparse, F.coalesce("_original", "text")).otherwise(F.col("text"))).drop("_original")


def root_parent(hits: DataFrame, second: DataFrame, source: str = "source") -> DataFrame:
    """Adds parent_id, the first-level chunk of each hit: a proposition's parent is a second-level chunk, whose parent it is.

    hits(source, chunk_stage, parent_chunk_id), second(source, chunk_id, parent_chunk_id).
    """
    proposition = F.col("chunk_stage") == "proposition"
    wanted = hits.where(proposition).select(source, F.col("parent_chunk_id").alias("chunk_id")).distinct()
    up = first_of(second.join(wanted, [source, "chunk_id"], "left_semi"), [source, "chunk_id"], ["parent_chunk_id"]).select(
        source, F.col("chunk_id").alias("parent_chunk_id"), F.col("parent_chunk_id").alias("_up")
    )
    out = hits.join(up, [source, "parent_chunk_id"], "left")
    return out.withColumn("parent_id", F.when(proposition, F.col("_up")).otherwise(F.col("parent_chunk_id"))).drop("_up")


def expand(parents: DataFrame, summaries: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that stand for parents: all summaries of a parent, or else its first-level chunk, or else nothing.

    summaries and firsts have ``keys`` and the same other columns.
    """
    wanted = parents.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
    summed = wanted.join(summaries, keys)
    rest = wanted.join(summaries.select(*keys).distinct(), keys, "left_anti")
    return summed.unionByName(rest.join(firsts, keys))


def append_parents(selected: DataFrame, parents: DataFrame) -> DataFrame:
    """Selected rows by rank, then the new parents of each query in reverse order; (query_id, doc_id, rank)."""
    both = selected.select("query_id", "doc_id", F.lit(0).alias("_list"), F.col("rank").alias("_pos")).unionByName(
        parents.select("query_id", "doc_id", F.lit(1).alias("_list"), (-F.col("rank")).alias("_pos"))
    )
    seen = Window.partitionBy("query_id", "doc_id").orderBy("_list", "_pos")
    once = both.withColumn("_n", F.row_number().over(seen)).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy("_list", "_pos")
    return once.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))


def fresh(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inputs that are newer (src_mtime) than what the manifest has done (done_mtime), or that it lacks."""
    known = manifest.groupBy(key).agg(F.max("done_mtime").alias("done_mtime"))
    return inputs.join(known, key, "left").where(F.col("done_mtime").isNull() | (F.col("src_mtime") > F.col("done_mtime")))


def stale(outputs: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Outputs whose input is gone; none when there are no inputs at all, so that an empty listing deletes nothing."""
    any_input = inputs.select(F.lit(1).alias("_any")).limit(1)
    return outputs.join(inputs.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(any_input)).drop("_any")


def newest(files: DataFrame, name: str = "name", mtime: str = "mtime", path: str = "path") -> DataFrame:
    """One file of each output name: the newest, then the first by path."""
    w = Window.partitionBy(name).orderBy(F.desc(mtime), path)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
