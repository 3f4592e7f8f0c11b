"""Sparse retrieval: an inverted index of DataFrames and BM25."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import counted, tokens
from tessera.operators.ranking import merge
from tessera.session import kept, shared_folder

#: Terms in more than half of the documents get this share of the mean weight instead of a negative one.
FLOOR = 0.25
#: Scores (a query's for a document) that one task works out, and parts at most; beyond them a task has more.
SCORED, MOST_PARTS = 2_000_000, 10_000


@dataclass
class SparseIndex:
    """postings(term, doc_id, tf, dl), terms(term, df, idf), stats(n, avg_dl), of one parameter set."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float = 1.5
    b: float = 0.75
    #: Works out terms from postings, and the statistics from postings and the one row of ``documents``, their number n.
    count: Callable[[DataFrame], DataFrame] | None = None
    documents: DataFrame | None = None

    def save(self, path: str) -> None:
        """Parquet tables; postings are sorted by term, so that a query's terms prune row groups.

        They stay where their documents were counted, so no shuffle is needed and a
        frequent term's postings lie in all files. Terms and the mean length, which is
        that of all occurrences, are counted on the saved postings, so the texts are
        analysed once.
        """
        spread = self.postings.sortWithinPartitions("term", "doc_id")
        spread.write.mode("overwrite").parquet(f"{path}/postings")
        if self.count:
            saved = spread.sparkSession.read.parquet(f"{path}/postings")
            self.terms = self.count(saved)
            # One row each.
            total = saved.agg(F.sum("tf").alias("total"))
            self.stats = self.documents.crossJoin(total).select("n", (F.col("total") / F.nullif("n", F.lit(0))).alias("avg_dl"))
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        params = {"version": 1, "k1": self.k1, "b": self.b}
        self.stats.select("n", "avg_dl", *[F.lit(v).alias(k) for k, v in params.items()]).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    def kept(self) -> SparseIndex:
        """The index saved in the folder that executors share, and read from there: later searches build nothing anew."""
        spark = self.postings.sparkSession
        path = shared_folder(spark)
        self.save(path)
        return SparseIndex.load(spark, path, self.k1, self.b)

    def with_parameters(self, k1: float, b: float) -> SparseIndex:
        """The same tables scored with other parameters, which the tables don't depend on."""
        return SparseIndex(self.postings, self.terms, self.stats, k1, b)

    @staticmethod
    def load(spark, path: str, k1: float, b: float) -> SparseIndex | None:
        """A saved index, or None if its version or parameters differ."""
        stats = spark.read.parquet(f"{path}/stats")
        row = stats.first()
        if row is None or row["version"] != 1 or abs(row["k1"] - k1) > 1e-9 or abs(row["b"] - b) > 1e-9:
            return None
        return SparseIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats.select("n", "avg_dl"), k1, b)


def build_index(docs: DataFrame, k1: float = 1.5, b: float = 0.75, terms=tokens) -> SparseIndex:
    """The index of docs(doc_id, text). Documents without tokens count in n and the mean length.

    A row's terms are counted inside it, so postings are made without a shuffle.
    Rows that share a doc_id, which are looked for first by their ids, are one
    document: only their terms are brought together.
    """
    repeated = kept(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    analysed = lambda df: df.select("doc_id", terms(F.col("text")).alias("tokens"))
    counts = lambda df: analysed(df).select("doc_id", F.size("tokens").alias("dl"), F.inline(counted(F.col("tokens")))).select("term", "doc_id", "tf", "dl")
    if repeated.isEmpty():
        postings = counts(docs)
    else:
        again = counts(docs.join(repeated, same, "left_semi")).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        postings = counts(docs.join(repeated, same, "left_anti")).unionByName(again)
    stats = analysed(docs).agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_dl"))
    count = lambda p: term_weights(p, stats)
    return SparseIndex(postings, count(postings), stats, k1, b, count, docs.agg(F.count(F.lit(1)).alias("n")))


def term_weights(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): a negative weight becomes a share of the mean over all terms, negative ones included."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    # One row each: the number of documents, and the mean.
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select(
        "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    mean = raw.agg((F.avg("raw") * FLOOR).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def staged_terms(text: Column, stage: Column) -> Column:
    """Tokens of a chunk: those of the sparse stage are analysed already and stand between spaces; others are analysed."""
    ready = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.when(F.coalesce(stage == "second_recursive_sparse", F.lit(False)), ready).otherwise(tokens(text))


def both_searches(index: SparseIndex, queries: DataFrame, changed: DataFrame, k: int = 20, original: bool = True) -> DataFrame:
    """Hits of the questions and of what a model made of them: query_id, doc_id, rank.

    changed(query_id, text). The second list follows the first; it is sought
    where it is not empty and differs from the question, or where the question
    itself is not (``original`` is off).
    """
    first = queries.select("query_id", F.col("text").alias("_own"))
    other = changed.join(first, "query_id").where("trim(text) <> ''")
    other = (other.where("text <> _own") if original else other).select("query_id", "text")
    made = search(index, query_terms(other), k)
    return merge(search(index, query_terms(queries), k), made) if original else merge(made)


def query_terms(queries: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, term, times) of queries(query_id, text); with ``first`` only the first so many distinct tokens."""
    words = tokens(F.col("text"))
    if first:
        words = F.slice(F.array_distinct(words), 1, first)
    return queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def score(index: SparseIndex, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of documents with a positive score, rounded to 6 digits.

    Postings of the asked terms are dealt by document before they meet the
    queries that ask for them, so of a frequent term one row a document moves and
    not one a query and document; a document's sums then need no other shuffle.
    """
    k1, b = index.k1, index.b
    # Saved, so that Spark knows its size and broadcasts it if it is small: then no posting of another term moves.
    wanted = kept(terms.join(index.terms.where("idf <> 0").select("term", "idf"), "term").select("query_id", "term", "times", "idf"))
    hits = index.postings.join(wanted.select("term"), "term", "left_semi").repartition(_parts(index, wanted), "doc_id")
    hits = hits.join(wanted, "term").crossJoin(F.broadcast(index.stats.select("avg_dl")))
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def _parts(index: SparseIndex, wanted: DataFrame) -> int:
    """Into how many parts documents are dealt: about ``SCORED`` scores in each, all cores used, and no more than ``MOST_PARTS``."""
    n, queries = index.stats.select("n").first()[0] or 0, wanted.agg(F.countDistinct("query_id")).first()[0]
    return min(MOST_PARTS, max(index.postings.sparkSession.sparkContext.defaultParallelism, -(-n * queries // SCORED)))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k documents of each query, ties by document: adds rank from 1. Any k below 1 gives none."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(0, k))


def search(index: SparseIndex, terms: DataFrame, k: int = 20) -> DataFrame:
    """The best k documents of each query.

    The terms of a batch of queries are few beside the postings; where Spark
    finds them small enough they are broadcast, else a frequent term's postings
    are split by adaptive execution. Each task keeps its own best k of a query
    before they meet.
    """
    return top(score(index, terms), k)
