"""Filters, counters and look-ups that stand before or beside retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Kinds of documents that can be exported as text: a document and a sheet; fixed values.
DOCUMENT_KINDS = ["application/vnd.google-apps.document", "application/vnd.google-apps.spreadsheet"]


def allowed(rows: DataFrame, places: list[str], column: str, readable: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows of the listed places (an empty list allows all), and of those the ones whose key may be read."""
    out = rows.where(F.col(column).isin(places)) if places else rows
    return out.join(readable.select(key).distinct(), key, "left_semi") if readable is not None else out


def of_kinds(files: DataFrame, column: str = "mime", kinds: list[str] | None = None) -> DataFrame:
    """Files of the kinds that can be read as text; one without a kind is left out."""
    return files.where(F.col(column).isin(kinds or DOCUMENT_KINDS))


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by ``order``; all where n is 0 or less."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def best_score(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """The best score of each key; a null score is no score, and a key without any has null."""
    return scored.groupBy(*keys).agg(F.max(score).alias(score))


def counters(rows: DataFrame, **groups: str) -> DataFrame:
    """One row: how many rows there are, and how many different values of each named column."""
    return rows.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(name) for name, c in groups.items()])


def counted(rows: DataFrame, **groups: str) -> tuple[DataFrame, Observation]:
    """``rows``, and what ``counters`` says of them once they are written: no second job reads them.

    The observation's ``get`` waits for the first action on the rows. Different values of a column are held as a set, so a
    column named here must have few. A task that runs again after its results were lost may be counted twice: counts that
    must be exact come from ``counters`` on what was written.
    """
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.size(F.collect_set(c)).alias(name) for name, c in groups.items()]), seen


def with_cached_scores(pairs: DataFrame, cache: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Pairs with their score from the cache, or else with ``score``; cached says which."""
    known = cache.select(*keys, F.col("score").alias("_known")).groupBy(*keys).agg(F.max("_known").alias("_known"))
    out = pairs.join(known, keys, "left")
    return out.withColumn("score", F.coalesce("_known", score)).withColumn("cached", F.col("_known").isNotNull()).drop("_known")


def one_export(files: DataFrame, key: str, keep: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Of files of one key: the one at ``keep`` if it is there, else the first by path; and the others, which are left over."""
    order = Window.partitionBy(key).orderBy((F.col(path) != F.coalesce(F.col(keep), F.lit(""))).cast("int"), path)
    ranked = files.withColumn("_n", F.row_number().over(order))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")
