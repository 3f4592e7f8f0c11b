"""Retrieval for many questions at once: dense and sparse lists, merged, reranked, capped and diversified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators.dense import nearest
from tessera.operators.parents import append_parents, expand, first_of, restore, root_parent
from tessera.operators.ranking import cap_parents, diversify, merge, overlap_score, rerank
from tessera.operators.sparse import SparseIndex, both_searches, query_terms, search
from tessera.plans.models import score_with
from tessera.session import kept


def retrieve(
    queries: DataFrame, chunks: DataFrame, index: SparseIndex, config: Config = Config(), scorer=overlap_score, first_terms: int | None = None,
    use_rerank: bool = True, changed: DataFrame | None = None, embed=None, fallback: DataFrame | None = None,
) -> DataFrame:
    """(query_id, doc_id, rank) of queries(query_id, text, embedding) over chunks(doc_id, text, embedding, parent).

    ``changed``(query_id, text), where given, is what a model made of the questions
    for the sparse search. With an ``embed`` hook (df with text -> df with
    embedding) chunks of the pool without a vector get one; without it, and for
    questions without a vector, the reranked order stays. ``scorer`` is a function of the columns of question
    and text, or a ``Scorer`` whose model scores pairs. A question that finds
    nothing gets the nearest of ``fallback``(doc_id, text, embedding, parent), where given.
    """
    vectors = chunks.where("embedding is not null")
    dense = nearest(vectors, queries, config.dense_k)
    sparse = search(index, query_terms(queries, first_terms), config.sparse_k) if changed is None else both_searches(index, queries, changed, config.sparse_k)
    known = chunks.select("doc_id", "text", "embedding", "parent")
    lists = [dense, sparse]
    if fallback is not None:
        # A chunk that is in both is the collection's own.
        both = known.withColumn("_from", F.lit(0)).unionByName(fallback.select(*known.columns).withColumn("_from", F.lit(1)))
        known = first_of(both, ["doc_id"], ["_from"]).drop("_from")
        empty = queries.join(dense.select("query_id"), "query_id", "left_anti").join(sparse.select("query_id"), "query_id", "left_anti")
        lists.append(nearest(fallback.where("embedding is not null"), empty, config.top_k))
    # A bounded list for each question. Saved, its size is known, so the few chunks in it are picked before texts or vectors move.
    pool = kept(merge(*lists))
    known = known.join(pool.select("doc_id"), "doc_id", "left_semi")
    asked = queries.select("query_id", F.col("text").alias("query_text"), F.col("embedding").alias("query_embedding"))
    full = pool.join(known, "doc_id").join(asked, "query_id")
    if use_rerank and callable(getattr(scorer, "score", None)):
        full = rerank(score_with(full, scorer), F.col("model_score"))
    elif use_rerank:
        full = rerank(full, scorer(F.col("query_text"), F.col("text")))
    capped = cap_parents(full, F.col("parent"), config.parent_cap)
    order = rerank(capped, F.lit(0.0), config.rerank_pool)
    if embed is not None:
        made = embed(order.where("embedding is null").select("doc_id", "text").dropDuplicates(["doc_id"])).select("doc_id", F.col("embedding").alias("_made"))
        order = order.join(made, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", F.col("_made").cast(order.schema["embedding"].dataType))).drop("_made")
    return diversify(order, config.top_k, config.mmr_lambda)


def with_parents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked chunks with their originals' texts and, after them, what stands for their parents: query_id, doc_id, rank, text.

    chunks(doc_id, source, chunk_stage, chunk_id, parent_chunk_id, text) holds all
    stages. A hit of the sparse stage gets the text of the second-level chunk of
    its number; a hit's parent is its first-level chunk, for which the summaries
    of that chunk stand, if it has any. New parents follow in reverse order.
    """
    hits = ranked.select("query_id", "doc_id", "rank").join(chunks, "doc_id")
    second = chunks.where("chunk_stage = 'second_recursive'")
    hits = restore(hits, second, ["source", "chunk_id"], F.col("chunk_stage") == "second_recursive_sparse", ["doc_id"])
    up = root_parent(hits, second).where("parent_id is not null and source is not null")
    wanted = up.groupBy("query_id", "source", "parent_id").agg(F.min("rank").alias("at"))
    keyed = lambda stage, key: chunks.where(F.col("chunk_stage") == stage).select("source", F.col(key).alias("parent_id"), "doc_id", "text")
    stands = expand(wanted.select("source", "parent_id"), keyed("summery", "parent_chunk_id"), keyed("first_recursive", "chunk_id"), ["source", "parent_id"])
    order = Window.partitionBy("query_id").orderBy("at", "doc_id")
    parents = wanted.join(stands, ["source", "parent_id"]).select("query_id", "doc_id", "text", F.row_number().over(order).alias("rank"))
    texts = hits.select("query_id", "doc_id", "text").unionByName(parents.select("query_id", "doc_id", "text")).dropDuplicates(["query_id", "doc_id"])
    return append_parents(ranked, parents).join(texts, ["query_id", "doc_id"])


def context(text: Column, source_type: Column, path: Column, meeting: Column, title: Column, channel: Column, date: Column) -> Column:
    """A chunk as the answering model sees it: a line on where it is from, then the text."""
    head = (
        F.when(source_type == "vc", F.concat(F.lit("meeting: "), meeting))
        .when(source_type == "blog", F.concat_ws(" ", F.lit("article:"), title, date))
        .when(source_type == "messages", F.concat_ws(" ", F.lit("channel:"), channel, date))
        .otherwise(F.concat(F.lit("path: "), F.coalesce(path, F.lit("unknown"))))
    )
    return F.concat_ws("\n", head, text)


def embedding_text(text: Column, footer: list[tuple[str, Column]]) -> Column:
    """A chunk as it is embedded: the trimmed text, then a line for each thing known about it."""
    lines = [F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value)) for name, value in footer]
    return F.concat_ws("\n", F.trim(text), *lines)


def source_url(channel_url: Column, blog_url: Column, doc_id: Column, mime: Column, meeting: Column, base: str = "https://docs.example/") -> Column:
    """Where a chunk can be looked up: its message, else article, else document (sheets apart), else the meeting's label."""
    kind = F.when(mime.contains("spreadsheet"), F.lit("sheets/")).otherwise(F.lit("documents/"))
    named = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(named(channel_url), named(blog_url), F.concat(F.lit(base), kind, named(doc_id)), named(meeting))
