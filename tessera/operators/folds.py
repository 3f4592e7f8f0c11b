"""Aggregates over groups, and folds whose step depends on what went before.

A fold runs over sorted rows in a stream and holds one group's running state
only, however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_or_mixed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each column the one value that a group's rows have: "" if none has any, "mixed" if they differ. Empty values don't count."""
    def one(c: str):
        own = F.when(F.col(c) != "", F.col(c))
        return F.when(F.min(own).isNull(), "").when(F.min(own) == F.max(own), F.min(own)).otherwise("mixed").alias(c)

    return rows.groupBy(*keys).agg(*[one(c) for c in columns])


def metric_means(rows: DataFrame) -> DataFrame:
    """metric, mean, n of each numeric column (booleans are no metrics)."""
    numeric = [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric])))
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def _streamed(rows: DataFrame, key: str, order: list[str], value: str, step, out_type: pa.DataType, ddl: str) -> DataFrame:
    """Rows with ``fold``: step(state, value) gives the state and the result; the state is new for each key."""
    spark_order = rows.select(key, *order, F.col(value).cast("double").alias("_value"))
    sorted_ = spark_order.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            results = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not begun or k != last:
                    state, last, begun = None, k, True
                state, result = step(state, v or 0.0)
                results.append(result)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(results, out_type)], [*batch.schema.names[:-1], "fold"])

    schema = spark_order.drop("_value").schema.add("fold", ddl)
    return sorted_.mapInArrow(run, schema)


def pack_tokens(rows: DataFrame, key: str, order: list[str], size: str, limit: float) -> DataFrame:
    """Adds pack (from 1): a new one begins where the open one isn't empty and the row would exceed the limit."""

    def step(state, value):
        pack, total = state or (1, None)
        if total is not None and total + value > limit:
            pack, total = pack + 1, None
        return (pack, (total or 0.0) + value), pack

    return _streamed(rows, key, order, size, step, pa.int64(), "long").withColumnRenamed("fold", "pack")


def pending(rows: DataFrame, key: str, order: list[str], seconds: str, summary: float = 300.0, check: float = 60.0) -> DataFrame:
    """Adds summarise and check_end: which of two running totals of seconds reach their threshold at the row; each then starts anew."""

    def step(state, value):
        a, b = state or (0.0, 0.0)
        a, b = a + value, b + value
        fire = (a >= summary, b >= check)
        return (0.0 if fire[0] else a, 0.0 if fire[1] else b), int(fire[0]) + 2 * int(fire[1])

    out = _streamed(rows, key, order, seconds, step, pa.int64(), "long")
    return out.select(key, *order, (F.col("fold") % 2 == 1).alias("summarise"), (F.col("fold") >= 2).alias("check_end"))
