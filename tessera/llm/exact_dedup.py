"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies meet in three steps, and each compares the whole normalised text, not
its digest alone: within a task (Spark's partial aggregation), within a digest
and salt, and over the salts of a digest. One row for each group, task and salt
is the most that is shuffled, so a group that holds a third of all rows is no
larger a load than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of a digest group; they are bits of a long.
SALTS = 60

_TOP = 9223372036854775807
_STEP = "20000000000000000000"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (ASCII). Of
    equal texts the row with the most code points in its original text stays,
    then the smallest id. A null text counts as empty; empty texts are one
    group. A null id loses every tie, and keep_id is null where all ids of the
    winning length are null. Rows that repeat the winning id are all kept.
    Texts of any length are compared whole.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be 1 to 62")
    source = docs.select(docs[id].cast("long").alias("_id"), docs[text].alias("_text"))
    keyed = source.select("_id", normalised(F.col("_text")).alias("_norm"), F.length(F.coalesce("_text", F.lit(""))).alias("_len"))
    keyed = keyed.select(
        "_id",
        "_norm",
        F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"),
        # Larger is better: longer text, then smaller id, then no id.
        (
            F.col("_len").cast("decimal(10,0)") * F.lit(_STEP).cast("decimal(20,0)")
            + F.coalesce(F.lit(_TOP).cast("decimal(19,0)") - F.col("_id").cast("decimal(19,0)") + 1, F.lit(0).cast("decimal(20,0)"))
        ).cast("decimal(38,0)").alias("_rank"),
    )
    salted = keyed.groupBy("_sha", "_norm", "_salt").agg(F.max("_rank").alias("_rank"), F.count("*").alias("_n"))
    whole = salted.groupBy("_sha", "_norm").agg(
        F.max("_rank").alias("_rank"),
        F.sum("_n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"),
    )
    # A digest has one text (a collision of SHA-256 together with MD5 aside), so members find their
    # group by digests; the group has a row for each salt it occurs with.
    low = F.col("_rank") % F.lit(_STEP).cast("decimal(20,0)")
    groups = whole.select(
        "_sha",
        F.md5(F.col("_norm")).alias("_md5"),
        "group_size",
        F.when(low > 0, (F.lit(_TOP).cast("decimal(19,0)") + 1 - low).cast("long")).alias("keep_id"),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.getbit(F.col("_salts"), s) == 1)).alias("_salt"),
    )
    members = keyed.select("_id", "_sha", F.md5(F.col("_norm")).alias("_md5"), "_salt")
    return members.join(groups, ["_sha", "_md5", "_salt"]).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
