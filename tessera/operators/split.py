"""Splitting texts into chunks of two levels, with true places in the text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Separators in the order in which they are tried; fixed values.
DOCUMENT = ("\n## ", "\n### ", "\n\n", "\n", " ", "")
SHEET = ("\n|", "\n\n", "\n", " ", "")
MESSAGE = ("\n", " ", "")


def _pieces(text: str, begin: int, separator: str) -> list[tuple[int, int]]:
    """Spans of the text's pieces; a separator begins the piece after it."""
    if separator == "":
        return [(begin + i, begin + i + 1) for i in range(len(text))]
    cuts, at = [0], text.find(separator)
    while at >= 0:
        cuts.append(at)
        at = text.find(separator, at + len(separator))
    cuts.append(len(text))
    return [(begin + a, begin + b) for a, b in zip(cuts, cuts[1:]) if b > a]


def split_spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = DOCUMENT) -> list[tuple[int, int]]:
    """Spans (start, end) of a text's chunks, in code points; white space at a chunk's ends is left out.

    The first separator that occurs cuts the text; small pieces are joined up to
    ``size``, and a chunk begins with pieces of up to ``overlap`` from the end of
    the one before; a piece of ``size`` or more is cut by the next separators.
    """

    def joined(pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        window: list[tuple[int, int]] = []
        total = 0
        for a, b in pieces:
            if window and total + b - a > size:
                yield window[0][0], window[-1][1]
                while total > overlap or (total + b - a > size and total > 0):
                    first = window.pop(0)
                    total -= first[1] - first[0]
            window.append((a, b))
            total += b - a
        if window:
            yield window[0][0], window[-1][1]

    def cut(begin: int, end: int, rest: tuple[str, ...]) -> Iterator[tuple[int, int]]:
        part = text[begin:end]
        k = next((i for i, s in enumerate(rest) if s == "" or s in part), len(rest) - 1)
        small: list[tuple[int, int]] = []
        for a, b in _pieces(part, begin, rest[k]):
            if b - a < size:
                small.append((a, b))
                continue
            yield from joined(small)
            small = []
            if k + 1 < len(rest):
                yield from cut(a, b, rest[k + 1 :])
            else:
                yield a, b
        yield from joined(small)

    out = []
    for a, b in cut(0, len(text), separators) if text else ():
        own = text[a:b]
        lead, kept = len(own) - len(own.lstrip()), own.strip()
        if kept:
            out.append((a + lead, a + lead + len(kept)))
    return out


def split(rows: DataFrame, size: int, overlap: int, separators: tuple[str, ...] = DOCUMENT, text: str = "text") -> DataFrame:
    """A row for each chunk: the columns of ``rows`` with ``text`` being the chunk's, and chunk_pos, chunk_start, chunk_end."""
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, texts, pos, starts, ends = [], [], [], [], []
                for i, value in enumerate(part.column(part.num_columns - 1)):
                    own = value.as_py() or ""
                    for k, (a, b) in enumerate(split_spans(own, size, overlap, separators)):
                        owner.append(i)
                        texts.append(own[a:b])
                        pos.append(k)
                        starts.append(a)
                        ends.append(b)
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [c.take(take) for c in part.columns[:-1]]
                    + [pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (pos, starts, ends)]],
                    [*keep, "text", "chunk_pos", "chunk_start", "chunk_end"],
                )

    source = rows.select(*keep, F.col(text).alias("text"))
    extra = source.select("*", *[F.lit(0).cast("long").alias(c) for c in ("chunk_pos", "chunk_start", "chunk_end")])
    return source.mapInArrow(run, extra.schema)


def number(chunks: DataFrame, file: list[str], order: list[str]) -> DataFrame:
    """Adds chunk_id, from 0 in each file."""
    return chunks.withColumn("chunk_id", (F.row_number().over(Window.partitionBy(*file).orderBy(*order)) - 1).cast("long"))


def first_level(docs: DataFrame, size: int = 1024, overlap: int = 128, separators: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """First-level chunks of docs(doc_id, text): doc_id, chunk_id, text, chunk_start, chunk_end, chunk_stage."""
    out = split(docs.select("doc_id", "text"), size, overlap, separators)
    return out.select(
        "doc_id", F.col("chunk_pos").alias("chunk_id"), "text", "chunk_start", "chunk_end", F.lit("first_recursive").alias("chunk_stage")
    )


def second_level(first: DataFrame, size: int = 128, overlap: int = 32, separators: tuple[str, ...] = DOCUMENT) -> DataFrame:
    """Chunks of first-level chunks: doc_id, chunk_id (through all parents of a document), parent_chunk_id, text, chunk_stage."""
    out = split(first.select("doc_id", F.col("chunk_id").alias("parent_chunk_id"), "text"), size, overlap, separators)
    out = number(out, ["doc_id"], ["parent_chunk_id", "chunk_pos"])
    return out.select("doc_id", "chunk_id", "parent_chunk_id", "text", F.lit("second_recursive").alias("chunk_stage"))


def sparse_text(chunks: DataFrame, analyzer) -> DataFrame:
    """Chunks whose text is their analysed tokens with spaces between; those without tokens go; ids stay."""
    out = chunks.withColumn("text", F.array_join(analyzer(F.col("text")), " "))
    return out.where("text <> ''").withColumn("chunk_stage", F.lit("second_recursive_sparse"))


def first_in_span(spans: DataFrame, lines: DataFrame, key: str, value: str, width: int = 512) -> DataFrame:
    """Adds ``value`` of the first line (that has one) of those that a span touches.

    spans(key, span_id, start, end), lines(key, start, value); a line reaches to
    the next line's start, so the line end belongs to it. Both are entered under
    pieces of ``width`` characters, so the join is an equi join.
    """
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    own = lines.select(key, "start", value).withColumn("_until", after).where(f"{value} is not null")
    # A line without a successor reaches to the end of all spans, but is entered only where it can be the first: where it starts, and where a span begins.
    piece = lambda c: F.floor(F.col(c) / width)
    last = spans.groupBy(key).agg(F.max("end").alias("_last"))
    own = own.join(last, key).withColumn("_until", F.coalesce("_until", F.greatest("_last", F.col("start") + 1)))
    own = own.select(key, F.col("start").alias("_from"), "_until", value, F.explode(F.sequence(piece("start"), F.floor((F.greatest(F.col("_until"), F.col("start") + 1) - 1) / width))).alias("_piece"))
    wide = spans.select(key, "span_id", "start", "end", F.explode(F.sequence(piece("start"), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))).alias("_piece"))
    met = wide.join(own, [key, "_piece"]).where((F.col("_from") < F.col("end")) & (F.col("_until") > F.col("start")))
    found = met.groupBy(key, "span_id").agg(F.min_by(value, "_from").alias(value))
    return spans.join(found, [key, "span_id"], "left")
