"""Hooks for models, and stand-ins that need none and always give the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import keyword_query


class TextGenerator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Transcriber(Protocol):
    def recognise(self, pcm: bytes) -> list[tuple[float | None, str]]: ...


class Router(Protocol):
    def tools(self, question: str) -> list[str]: ...


class FirstSentences:
    """A stand-in for a summarising model: the beginning of what follows the prompt's last blank line."""

    def __init__(self, most: int = 200):
        self.most = most

    def generate(self, prompt: str) -> str:
        return " ".join(prompt.rsplit("\n\n", 1)[-1].split())[: self.most]


class HashEmbedder:
    """A stand-in for an embedding model: signed counts of hashed words, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed_with(df: DataFrame, embedder: Embedder, text: str = "text", batch: int = 256, prefix: str = "") -> DataFrame:
    """``df`` with embedding; an empty text is embedded as a space, a prefix is put where it isn't already."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or " " for t in s.fillna("")]
            texts = [t if t.startswith(prefix) else prefix + t for t in texts]
            rows = [v for a in range(0, len(texts), batch) for v in embedder.embed(texts[a : a + batch]).astype("float32").tolist()]
            yield pd.Series(rows, index=s.index)

    udf = F.pandas_udf("array<float>")(_typed(run))
    return df.withColumn("embedding", udf(F.col(text)))


def _typed(run: Callable) -> Callable:
    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return typed


def generate_with(df: DataFrame, model: TextGenerator, prompt: Column, retries: int = 2) -> DataFrame:
    """``df`` with reply; null where the model fails again and again."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str | None:
            for _ in range(retries + 1):
                try:
                    reply = model.generate(text)
                except Exception:  # noqa: BLE001  a model that fails leaves its row without a reply
                    continue
                if reply and reply.strip():
                    return reply
            return None

        for s in batches:
            yield s.map(one)

    return df.withColumn("reply", F.pandas_udf("string")(_typed(run))(prompt))


def summaries(first: DataFrame, model: TextGenerator, most: int = 200) -> DataFrame:
    """Summaries of first-level chunks: they keep source and parent_chunk_id; rows for which the model fails go."""
    from tessera.functions.parsing import summary_text

    prompt = F.concat(F.lit(f"Summarise in at most {most} characters.\n\n"), "text")
    out = generate_with(first, model, prompt)
    out = out.withColumn("text", summary_text(F.col("reply"))).where("text is not null and text <> ''")
    return out.withColumn("parent_chunk_id", F.col("chunk_id")).withColumn("chunk_stage", F.lit("summery")).drop("reply")


def propositions(second: DataFrame, model: TextGenerator) -> DataFrame:
    """Statements of second-level chunks, a row each, from a model that replies with a list."""
    from tessera.functions.parsing import chunk_list

    out = generate_with(second, model, F.concat(F.lit("List the statements as a JSON array of strings.\n\n"), "text"))
    out = out.withColumn("parent_chunk_id", F.col("chunk_id")).drop("text")
    keep = [c for c in out.columns if c != "reply"]
    return out.select(*keep, F.posexplode(chunk_list(F.col("reply"))).alias("pos", "text")).withColumn("chunk_stage", F.lit("proposition"))


def score_with(ranked: DataFrame, scorer: Scorer, query: str = "query_text", text: str = "text") -> DataFrame:
    """Adds model_score: the scorer's, clamped to 0..1; what is no number, and all where it fails, is 0, so that the order stays."""

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=texts.index)
        for q, own in texts.groupby(queries, dropna=False):
            try:
                found = pd.to_numeric(pd.Series(scorer.score(q or "", own.fillna("").tolist()), index=own.index), errors="coerce")
            except Exception:  # noqa: BLE001  a model's failure leaves the order
                continue
            out.loc[own.index] = found.fillna(0.0).clip(0.0, 1.0)
        return out

    return ranked.withColumn("model_score", F.pandas_udf(run, "double")(F.col(query), F.col(text)))


def keywords_with(queries: DataFrame, model: TextGenerator) -> DataFrame:
    """What a model makes of questions for the sparse search: query_id, text; an empty reply leaves nothing to seek."""
    prompt = F.concat(F.lit("List the keywords of this question, separated by spaces.\n\n"), "text")
    replies = generate_with(queries, model, prompt)
    return replies.select("query_id", keyword_query(F.coalesce("reply", F.lit(""))).alias("text")).where("text <> ''")


def metrics_with(records: DataFrame, metrics: dict[str, Callable[[str, str, list[str], list[str]], float]]) -> DataFrame:
    """Adds a column for each metric of (question, answer, contexts, ground_truths); one that fails on a record is null there."""

    def column(metric):
        def run(q: pd.Series, a: pd.Series, c: pd.Series, g: pd.Series) -> pd.Series:
            def one(*x):
                try:
                    return float(metric(*x))
                except Exception:  # noqa: BLE001  a metric may ask a model
                    return None

            return pd.Series([one(*x) for x in zip(q, a, map(list, c), map(list, g))], dtype="float64")

        return F.pandas_udf(run, "double")("question", "answer", "contexts", "ground_truths")

    return records.withColumns({name: column(metric) for name, metric in metrics.items()})
