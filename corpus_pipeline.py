"""A training corpus from documents, in five stages; each stage works on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, extra ones with any names included.

What stages make of unusual rows: a null or empty text has no language and goes in
the first stage; where a later stage is called by itself, it is empty text (exact:
such rows are one group; near: linked with nothing; secrets: untouched; packing:
the end id alone). A null doc_id is kept, in exact as one document for each text,
in near always. Rows that repeat are one document from the exact stage on. Ties go
to the longer original text, then the smaller id (exact), and to the smallest id
(near). Texts of any length are worked on whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.exact_dedup import exact_dedup, normalised
from tessera.llm.language_id import held_out, identify, train
from tessera.llm.minhash import near_groups
from tessera.llm.packing import pack_documents
from tessera.llm.secret_scan import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised: those without text or letters go."""
    model = train(docs.where(~held_out()))
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    found = identify(plain, model, text=f"_{docs.columns.index('text')}", keep=tuple(plain.columns))
    return found.where("lang_pred <> 'und'").drop("lang_pred", "score").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows with one id and text, any one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    kept = exact_dedup(docs).where("kept").select(key.alias("_key"), F.col("text_sha256").alias("_own")).distinct()
    marked = docs.withColumn("_key", key).withColumn("_own", F.sha2(normalised(F.col("text")), 256))
    # One shuffle of the texts serves the join and what follows it, as both go by these keys.
    return marked.join(kept, ["_key", "_own"], "left_semi").dropDuplicates(["_key", "_own"]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words: that with the smallest id."""
    kept = near_groups(docs, size=5).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    clean = redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("secret_scan", secrets),
    ("lexical_packing", packing),
]

#: Learned models, signatures and token windows are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
