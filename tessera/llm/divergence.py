"""How the sources of a language differ in their words: divergence by run-length columns.

Each source of a language is a column of counts over the language's vocabulary.
Terms are put in the order of their rows of counts, so that equal counts stand
together; the ordered vocabulary is cut into blocks, and a block's column is kept
as runs of one count. Two sources are compared by the intersections of their
runs: inside one both counts are the same, so the divergence of one term, times the
run's length, is that of all its terms.

What it makes of unusual input: a null text, lang or source is the empty string,
and rows that repeat are documents of their own. A group without terms has
count 0 of every kept term, and a language that keeps no term has pairs of value 0.
Ties go to the smaller item by its UTF-8 bytes. A text of any length is counted
whole. An empty table gives an empty report; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCUMENTS = 10
#: Terms of a block of run-length columns.
BLOCK = 1 << 16
#: Counted terms that a task holds before it hands them on.
HELD = 400_000
#: What all of a group's or language's terms share.
SCALE = 1_000_000_000

# Letters A to Z and all bytes beyond ASCII make terms, the former in lower case; other bytes separate.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in their order, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a term's occurrences in a group, and the documents that have it.

    A task counts what it reads and hands on sums; all sums of a term then meet.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[x].to_pylist() for x in ("lang", "source", "text"))):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                n, docs = held[lang, source]
                size -= len(n)
                own = terms(text)
                n.update(own)
                docs.update(set(own))
                size += len(n)
                if size >= HELD:
                    yield from _sums(held, schema)
                    held, size = {}, 0
        yield from _sums(held, schema)

    plain = docs.select(*_group_columns(), F.coalesce("text", F.lit("")).alias("text"))
    parts = plain.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _sums(held: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        own = [pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array([source]).take(pa.array(np.zeros(len(n), np.int32)))]
        names = pa.array(list(n), pa.binary()).cast(pa.string())
        columns = [*own, names, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
        for at in range(0, len(n), BLOCK):
            yield pa.RecordBatch.from_arrays([c.slice(at, BLOCK) for c in columns], schema=schema)


def vocabulary(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, total, row): the kept terms of each language with their row of counts, by source.

    A row has an entry for each source that has the term; a report has a row for
    each two sources of a language, so their number is small enough for that.
    """
    own = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row")
    )
    return own.where(F.col("docs") >= least).select("lang", "term", "total", "row")


def run_columns(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, block, size, source, starts, counts): the run-length columns of the ordered vocabulary.

    Terms are ordered by their rows of counts, and dealt to tasks in that order, a row that
    many terms share to several. A source without a row here has count 0 in the whole block.
    """
    schema = pa.schema([
        ("lang", pa.string()), ("block", pa.int64()), ("size", pa.int32()), ("source", pa.string()),
        ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lang, held, size = None, {}, 0

        def column_rows() -> Iterator[pa.RecordBatch]:
            rows = []
            for source, (places, counts) in held.items():
                dense = np.zeros(size, dtype=np.int64)
                dense[places] = counts
                starts = np.concatenate([[0], np.flatnonzero(np.diff(dense)) + 1]).astype(np.int32)
                rows.append((lang, number, size, source, starts, dense[starts]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            entries = batch["row"].flatten()
            sources, counts = entries.field("source").to_pylist(), entries.field("n").to_pylist()
            at = 0
            for own, width in zip(batch["lang"].to_pylist(), batch["row"].value_lengths().to_pylist()):
                if own != lang or size >= block:
                    yield from column_rows()
                    lang, held, size, number = own, {}, 0, number + 1
                for i in range(at, at + width):
                    if sources[i] not in held:
                        held[sources[i]] = [], []
                    places, values = held[sources[i]]
                    places.append(size)
                    values.append(counts[i])
                at, size = at + width, size + 1
        yield from column_rows()

    order = ["lang", "row", "term"]
    ordered = kept.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "row")
    return ordered.mapInArrow(work, "lang string, block long, size int, source string, starts array<int>, counts array<long>")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) of each count, exact for all longs."""
    return np.array([1 + SCALE * (c + 2) // total for c in counts.tolist()], dtype=np.int64)


def run_divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """The divergence of two columns of one block, each as (starts of runs, share in each run)."""
    starts = np.union1d(a[0], b[0])
    lengths = np.diff(np.append(starts, size))
    p = a[1][np.searchsorted(a[0], starts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], starts, side="right") - 1]
    return int(((p - q) * (p - q) // (p + q) * lengths).sum())


def pair_sums(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergence of each two sources a < b of a language that keeps terms.

    ``groups`` has lang, source, total (its count over kept terms) and width (the language's kept terms).
    """
    blocks = runs.select("lang", "block", "size").distinct()
    columns = blocks.join(groups, "lang").join(runs.drop("size"), ["lang", "block", "source"], "left")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", key=lambda s: s.str.encode("utf-8"))
        size, own = int(pdf["size"].iloc[0]), []
        for starts, counts, total, width in zip(pdf["starts"], pdf["counts"], pdf["total"], pdf["width"]):
            if starts is None:
                starts, counts = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int64)
            own.append((starts, shares(counts, int(total) + 2 * int(width))))
        n, names = len(own), pdf["source"].tolist()
        at = [(i, j) for i in range(n) for j in range(i + 1, n)]
        value = [run_divergence(own[i], own[j], size) for i, j in at]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": [names[i] for i, _ in at], "b": [names[j] for _, j in at], "value": pd.array(value, dtype="int64")})

    parts = columns.groupBy("lang", "block").applyInPandas(work, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(n: Column, total: Column, width: Column) -> Column:
    """``shares`` as an expression."""
    whole = (F.lit(SCALE).cast("decimal(19,0)") * (n + 2).cast("decimal(19,0)"))
    return F.lit(1) + F.call_function("div", whole, (total + 2 * width).cast("decimal(19,0)"))


def divergence_report(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the divergence from the other sources
    of its language (``pair``), and the ``top`` terms that it has more of than its language (``term``)."""
    kept = written(vocabulary(term_counts(docs), least))
    entries = kept.select("lang", "term", F.col("total").alias("all_n"), F.explode("row").alias("e")).select("lang", "term", "all_n", "e.source", "e.n")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    widths = kept.groupBy("lang").agg(F.count("*").alias("width"), F.sum("total").alias("all_total"))
    groups = docs.select(*_group_columns()).distinct().join(totals, ["lang", "source"], "left").join(widths, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "width", "all_total"))))

    sums = pair_sums(run_columns(kept, block), groups.select("lang", "source", "total", "width"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    own = entries.join(groups, ["lang", "source"]).withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("width")), "q": _share(F.col("all_n"), F.col("all_total"), F.col("width")),
    }).where("p > q")
    best = own.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    listed = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return listed.unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def _group_columns() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
