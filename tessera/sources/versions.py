"""Tables in versions: a new one is written beside the old, and a row in a log makes it the current one.

A job that is killed while it writes leaves the version before in place: the log's
row comes last, as one file that is there or is not. Nothing is deleted under a
reader; ``forget`` tells which versions are no longer needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """A table below ``path``: data in a folder for each version, and the log of those that are whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, schema string").parquet(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def version(self) -> int:
        """The current version's number; -1 before the first."""
        log = self._log()
        row = log.agg(F.max("version")).first() if log is not None else None
        return -1 if row is None or row[0] is None else row[0]

    def current(self) -> DataFrame | None:
        """The current version, None before the first."""
        log = self._log()
        row = log.orderBy(F.desc("version")).first() if log is not None else None
        if row is None:
            return None
        return self.spark.read.schema(row["schema"]).parquet(f"{self.path}/data/{row['version']}")

    def replace(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """``df`` as the next version, or as ``version``, which is left as it is if it is current already, as when a batch comes again.

        An older version than the current one is an error.
        """
        here = self.version()
        number = here + 1 if version is None else version
        if number < here:
            raise ValueError(f"version {number} is older than {here}")
        if number > here:
            # What a killed job has left under this number is written over.
            df.write.mode("overwrite").parquet(f"{self.path}/data/{number}")
            self._switch(number, df)
        return self.current()

    def _switch(self, number: int, df: DataFrame) -> None:
        # Types alone: a reader may find nulls wherever they come from.
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        row = self.spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(fields).alias("schema"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def upsert(self, df: DataFrame, keys: list[str], newer: Column, version: int | None = None) -> DataFrame:
        """The next version with a row for each key: of the rows with it, old and new, that with the largest ``newer``, the old one of equals."""
        old = self.current()
        both = df.withColumn("_new", F.lit(1))
        if old is not None:
            both = both.unionByName(old.withColumn("_new", F.lit(0)))
        order = Window.partitionBy(*keys).orderBy(newer.desc_nulls_last(), "_new")
        return self.replace(both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new"), version)

    def append_numbered(self, df: DataFrame, group: list[str], order: list[str], number: str, version: int | None = None) -> DataFrame:
        """The next version with ``df`` added, ``number`` running on in each group from what there is: the first row of a group has 0."""
        old = self.current()
        first = F.lit(0).cast("long")
        new = df
        if old is not None:
            used = old.groupBy(*group).agg((F.max(number) + 1).alias("_used"))
            new = new.join(used, group, "left")
            first = F.coalesce("_used", first)
        new = new.withColumn(number, (first + F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))
        new = new.select(*df.columns, number) if number not in df.columns else new.select(*df.columns)
        return self.replace(new if old is None else old.unionByName(new), version)

    def forget(self, keep: int = 1) -> DataFrame:
        """(path) of the versions before the last ``keep``, which may be deleted when no reader is left on them."""
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], "path string")
        here = self.version()
        old = log.where(F.col("version") <= here - keep).select("version").distinct()
        return old.select(F.concat(F.lit(f"{self.path}/data/"), F.col("version").cast("string")).alias("path"))
