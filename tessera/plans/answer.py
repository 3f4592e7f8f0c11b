"""The loop that answers questions: reply, read it, and search again where the reply asks for it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.parsing import answer_payload
from tessera.operators.ranking import cited
from tessera.plans.models import Router, TextGenerator, generate_with
from tessera.session import kept


def ask(prompts: DataFrame, model: TextGenerator, config: Config = Config()) -> DataFrame:
    """prompts(query_id, prompt, n_sources) with payload; replies that can't be read are asked for again, then null."""
    done, todo = None, prompts
    for _ in range(config.json_retries + 1):
        replies = generate_with(todo, model, F.col("prompt"), 0)
        # A reply is written before it is looked at, so that no question is put to the model twice.
        read = replies.withColumn("payload", answer_payload(F.col("reply"), F.col("n_sources"))).drop("reply")
        read = kept(read)
        good = read.where("payload is not null")
        done = good if done is None else done.unionByName(good)
        todo = read.where("payload is null").drop("payload")
        if todo.isEmpty():
            return done
    return done.unionByName(todo.withColumn("payload", F.lit(None).cast(done.schema["payload"].dataType)))


def answer(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], prompt: Callable[[DataFrame, DataFrame], DataFrame], model: TextGenerator,
    config: Config = Config(), history: Callable[[DataFrame, int], DataFrame] | None = None, contexts: bool = False,
) -> DataFrame:
    """Answers of questions(query_id, text): query_id, answer, sources; with ``contexts`` also the doc_ids that the last prompt stood on, by rank.

    ``search`` gives ranked lists (query_id, doc_id, rank, score) of queries;
    ``prompt`` gives (query_id, prompt, n_sources). What a question has come to is a row of a
    table that each round writes anew: how much memory it has, its reply, and whether it is open. A round asks for the
    open ones. A reply with follow-up queries that were not searched yet has them searched; one that needs more
    memory, where ``history(questions, n)`` gives (query_id, history), has the longer history from
    then on, once. A question is closed when its reply asks for neither, or at the limit of rounds.
    """
    asked = questions.select("query_id", "text")
    ranked = kept(search(asked))
    seen = asked
    state = kept(asked.withColumns({"level": F.lit(config.history_short), "open": F.lit(True)}))
    replies = None
    for turn in range(config.research_rounds + 1):
        open_ = state.where("open").select("query_id", "text", "level")
        new = kept(ask(_with_history(prompt(open_.select("query_id", "text"), ranked.join(open_.select("query_id"), "query_id", "left_semi")), open_, history, config), model, config))
        replies = new if replies is None else kept(replies.join(new.select("query_id"), "query_id", "left_anti").unionByName(new))
        if turn == config.research_rounds:
            break
        more = new.select("query_id", F.explode("payload.follow_up_queries").alias("text"))
        more = kept(more.join(seen, ["query_id", "text"], "left_anti"))
        longer = new.where(F.coalesce("payload.needs_additional_memory", F.lit(False))).select("query_id", F.lit(True).alias("longer"))
        if history is None:
            longer = longer.where("false")
        wanted = more.select("query_id").distinct().withColumn("searched", F.lit(True))
        grows = F.coalesce("longer", F.lit(False)) & (F.col("level") < config.history_long)
        state = state.join(longer, "query_id", "left").join(wanted, "query_id", "left")
        state = state.withColumn("open", F.col("open") & (grows | F.coalesce("searched", F.lit(False))))
        state = kept(state.withColumn("level", F.when(grows, config.history_long).otherwise(F.col("level"))).drop("longer", "searched"))
        if state.where("open").isEmpty():
            break
        seen = seen.unionByName(more)
        if not more.isEmpty():
            both = ranked.withColumn("_turn", F.lit(0)).unionByName(search(more).withColumn("_turn", F.lit(1)))
            once = both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_turn", "rank"))).where("_n = 1")
            ranked = kept(once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_turn", "rank", "doc_id"))).drop("_turn", "_n"))
    numbers = replies.select("query_id", F.explode("payload.sources").alias("source"))
    sources = cited(ranked, numbers).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("s"))
    out = replies.select("query_id", F.col("payload.answer").alias("answer")).join(sources, "query_id", "left").select(
        "query_id", "answer", F.coalesce(F.transform("s", lambda x: x["doc_id"]), F.array().cast("array<bigint>")).alias("sources")
    )
    if contexts:
        lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("c"))
        out = out.join(lists, "query_id", "left").withColumn("contexts", F.coalesce(F.transform("c", lambda x: x["doc_id"]), F.array().cast("array<bigint>"))).drop("c")
    return out


def _with_history(prompts: DataFrame, open_: DataFrame, history, config: Config) -> DataFrame:
    """Prompts after what is remembered of their questions' conversations, as much as each question's level says."""
    if history is None:
        return prompts
    texts = None
    for n in sorted({config.history_short, config.history_long}):
        own = history(open_.where(F.col("level") == n).select("query_id", "text"), n).select("query_id", "history")
        texts = own if texts is None else texts.unionByName(own)
    with_text = prompts.join(texts, "query_id", "left")
    return with_text.withColumn("prompt", F.concat_ws("\n\n", F.nullif("history", F.lit("")), "prompt")).drop("history")


def answer_with_contexts(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], prompt: Callable[[DataFrame, DataFrame], DataFrame], model: TextGenerator,
    texts: DataFrame, config: Config = Config(), history: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Answers with the texts they stand on, as evaluation records have them: query_id, question, answer, sources, contexts.

    texts(doc_id, text) has what ``search`` finds; contexts are by rank.
    """
    found = answer(questions, search, prompt, model, config, history, contexts=True)
    places = found.select("query_id", F.posexplode("contexts").alias("at", "doc_id")).join(texts.select("doc_id", "text"), "doc_id")
    lists = places.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("c"))
    out = found.drop("contexts").join(lists, "query_id", "left").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    return out.select("query_id", "question", "answer", "sources", F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>")).alias("contexts"))


def routed(questions: DataFrame, router: Router, retries: int = 2) -> DataFrame:
    """Adds retrieve: whether the router's tools for a question hold the search; where it fails again and again, retrieval is chosen."""

    def needs(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bool:
            for _ in range(retries + 1):
                try:
                    return "search" in router.tools(text)
                except Exception:  # noqa: BLE001  a model's failure is no reason not to answer
                    continue
            return True

        return texts.map(one)

    return questions.withColumn("retrieve", F.pandas_udf(needs, "boolean")(F.coalesce("text", F.lit(""))))


def answer_plain(questions: DataFrame, model: TextGenerator, history: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Answers without a search: query_id, answer, sources (none). history(query_id, history), where given, stands before the question."""
    asked = questions.select("query_id", "text")
    if history is not None:
        asked = asked.join(history, "query_id", "left")
        asked = asked.withColumn("text", F.concat_ws("\n\n", F.nullif("history", F.lit("")), "text"))
    replies = kept(ask(asked.select("query_id", F.col("text").alias("prompt"), F.lit(0).alias("n_sources")), model, config))
    return replies.select("query_id", F.col("payload.answer").alias("answer"), F.array().cast("array<bigint>").alias("sources"))


def answer_all(
    questions: DataFrame, router: Router, search: Callable[[DataFrame], DataFrame], prompt: Callable[[DataFrame, DataFrame], DataFrame],
    model: TextGenerator, history: Callable[[DataFrame, int], DataFrame] | None = None, config: Config = Config(),
) -> DataFrame:
    """Answers of all questions, with a search where the router wants one: query_id, answer, sources, retrieved.

    ``history(questions, n)`` gives (query_id, history), the last n exchanges. A
    reply that needs more memory, with a search or without, is asked for once more with
    all that is remembered.
    """
    way = kept(routed(questions, router))
    found = answer(way.where("retrieve").drop("retrieve"), search, prompt, model, config, history)
    rest = way.where("not retrieve").select("query_id", "text")
    if history is None:
        plain = answer_plain(rest, model, None, config)
    else:
        asked = rest.join(history(rest, config.history_short), "query_id", "left")
        asked = asked.select("query_id", F.concat_ws("\n\n", F.nullif("history", F.lit("")), "text").alias("prompt"), F.lit(0).alias("n_sources"))
        first = kept(ask(asked, model, config))
        more = F.coalesce(F.col("payload.needs_additional_memory"), F.lit(False))
        again = rest.join(first.where(more).select("query_id"), "query_id", "left_semi")
        plain = first.where(~more).select("query_id", F.col("payload.answer").alias("answer"), F.array().cast("array<bigint>").alias("sources"))
        plain = plain.unionByName(answer_plain(again, model, history(again, config.history_long), config))
    return found.withColumn("retrieved", F.lit(True)).unionByName(plain.withColumn("retrieved", F.lit(False)))


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started within carry ``tag``; ``spark.interruptTag(tag)`` from elsewhere ends them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)
