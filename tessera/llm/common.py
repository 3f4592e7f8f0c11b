"""Helpers that several operators share: written tables, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors reach.

    Only where the setting is absent (a local session, as in tests) is a
    temporary folder taken, and made the context's own, so that later calls agree.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than its running tasks.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Salts of a key that may hold a large share of the rows; they are bits of a long.
SALTS = 60


def salt(column: str, salts: int = SALTS) -> Column:
    """A row's salt, by a hash of ``column``."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salts_seen(column: str = "salt") -> Column:
    """An aggregate: the salts of a group's rows, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, {column})"))


def each_salt(bits: str, salts: int = SALTS) -> Column:
    """A row for each of the salts in ``bits``."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col(bits), s) == 1))


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node reaches: (node, component).

    ``nodes`` has a column node (long); ``links`` has a and b (long), each pair
    once in either order. Nodes without links are left out of the work and
    come back as their own component. Each round takes the smallest label of
    the neighbours, then jumps to that label's own label; labels are written
    every round. Rounds are about the logarithm of the longest path. The edges of
    a node with many links, and the nodes of a large component, are dealt to
    tasks by salts: what they look up has a row for each salt they occur with.
    """
    both = links.select("a", "b").where("a <> b")
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both.withColumn("salt", salt("a")))
    if edges.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    ends = written(edges.groupBy("b").agg(salts_seen().alias("salts"), F.least(F.min("a"), F.first("b")).alias("label")))
    ends = ends.withColumnRenamed("b", "node")
    labels = ends.select("node", "label")
    for _ in range(max_rounds):
        told = labels.join(ends.select("node", "salts"), "node").select(F.col("node").alias("b"), "label", each_salt("salts").alias("salt"))
        near = edges.join(told, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        low = written(low.withColumn("salt", salt("node")))
        asked = low.groupBy("label").agg(salts_seen().alias("salts"))
        jump = asked.join(low.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        jump = jump.select("label", "far", each_salt("salts").alias("salt"))
        stepped = written(low.join(jump, ["label", "salt"]).select("node", "old", F.least("label", "far").alias("label")))
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(labels, "node", "left").select(
        "node", F.coalesce("label", "node").alias("component")
    )
