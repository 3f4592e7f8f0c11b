"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to three bytes is counted on a bounded
sample of labelled texts and then frozen. A byte's probability in a context is
its share there; a byte unseen in the context escapes, with the share of
distinct bytes, to the context that is a byte shorter, and at last to a uniform
byte (escape method C, without exclusions). A text is scored by its exact code
length under each language's tree; the shortest wins.

The frozen trees are tabulated by pairs of bytes: a row for each pair of a
context's first two and last two bytes that the sample has, so that a text is
scored with a few array look-ups. Bytes outside the tabulated pairs walk the
trees themselves, to the same figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import buffers, chunks

#: Labelled texts of a language that the trees are counted on, on average. Which ones: by a hash of the row.
SAMPLE_DOCS = 3000
_PARTS = 1 << 24
#: Bytes of the tabulated code lengths, at the most.
TABLE_BYTES = 64 << 20
#: Bytes of the longest context.
ORDER = 3


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last four bytes at each byte of some texts in a row, as one number; a text begins after three zero bytes."""
    data = raw[offsets[0] : offsets[-1]].astype(np.uint32)
    at = offsets - offsets[0]
    out = data.copy()
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for back in (1, 2, 3):
        earlier = np.zeros(len(data), dtype=np.uint32)
        earlier[back:] = data[:-back] if len(data) > back else data[:0]
        earlier[place < back] = 0
        out |= earlier << np.uint32(8 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n): four-byte strings of the texts, counted in each batch."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            own = batch.filter(pa.array([x == lang for x in langs]))
            raw, offsets = buffers(own.column(1))
            for a, b in chunks(offsets, 8 << 20):
                gram, n = np.unique(_grams(raw, offsets[a : b + 1]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


class _Tree:
    """Counts of the contexts of each order: sorted keys, with counts, totals and distinct bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders = []
        for order in range(ORDER + 1):
            # The string of the context and its byte; and the context alone.
            strings, inverse = np.unique(gram & np.uint64(2 ** (8 * order + 8) - 1), return_inverse=True)
            counts = np.bincount(inverse, weights=n)
            contexts, back = np.unique(strings >> np.uint64(8), return_inverse=True)
            totals = np.bincount(back, weights=counts)
            distinct = np.bincount(back).astype(float)
            self.orders.append((strings, counts, contexts, totals, distinct))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length, in bits, of the last byte of each four-byte string in the context of the others."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            strings, counts, contexts, totals, distinct = self.orders[order]
            mine = gram[open_].astype(np.uint64) & np.uint64(2 ** (8 * order + 8) - 1)
            if not len(strings):
                continue
            ctx = np.minimum(np.searchsorted(contexts, mine >> np.uint64(8)), len(contexts) - 1)
            known = contexts[ctx] == mine >> np.uint64(8)
            byte = np.minimum(np.searchsorted(strings, mine), len(strings) - 1)
            hit = strings[byte] == mine
            whole = totals[ctx] + distinct[ctx]
            out[open_] += np.where(hit, -np.log2(counts[byte] / whole), np.where(known, -np.log2(distinct[ctx] / whole), 0.0))
            open_ = open_[~hit]
        out[open_] += 8.0
        return out


class Model:
    """Frozen trees of some languages and their tabulated code lengths."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(grams)
        self.trees = [_Tree(*grams[x]) for x in self.langs]
        # Frequent pairs of bytes get a number; 0 is any other.
        often = np.zeros(65536)
        for gram, n in grams.values():
            np.add.at(often, (gram & np.uint64(0xFFFF)).astype(np.int64), n)
        most = int((TABLE_BYTES / 4 / max(1, len(self.langs))) ** 0.5) - 1
        pairs = np.sort(np.argsort(-often, kind="stable")[: min(most, int((often > 0).sum()))])
        self.pairs = np.concatenate([[0], pairs]).astype(np.int64)
        self.number = np.zeros(65536, dtype=np.int64)
        self.number[pairs] = np.arange(1, len(pairs) + 1)
        self.table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def _tabulate(self) -> None:
        """Code lengths of all strings of two numbered pairs: made where they are used, not shipped."""
        n = len(self.pairs)
        table = np.zeros((n * n, len(self.langs)), dtype=np.float32)
        for i in range(1, n):
            gram = (self.pairs[i] << 16) | self.pairs[1:]
            rows = slice(i * n + 1, (i + 1) * n)
            for k, tree in enumerate(self.trees):
                table[rows, k] = tree.bits(gram)
        self.table = table

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of some texts in a row under each language: an array of (text, language)."""
        if self.table is None:
            self._tabulate()
        gram = _grams(raw, offsets)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(gram):
            return out
        left, right = self.number[gram >> np.uint32(16)], self.number[gram & np.uint32(0xFFFF)]
        bits = self.table[left * len(self.pairs) + right]
        rare = np.flatnonzero((left == 0) | (right == 0))
        if len(rare):
            strings, inverse = np.unique(gram[rare], return_inverse=True)
            for k, tree in enumerate(self.trees):
                bits[rare, k] = tree.bits(strings)[inverse]
        at = offsets - offsets[0]
        full = np.flatnonzero(np.diff(at))
        out[full] = np.add.reduceat(bits, at[full], axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, lang: str = "lang", text: str = "text", id: str = "doc_id") -> Model:
    """Counts the trees on some ``sample_docs`` labelled texts of each language, or on all if there are fewer.

    Rows without text, or with a null or empty label, are no examples. Which
    texts: those whose hash (of id and text) is below the language's share, so
    the sample is the same in each run. What reaches the driver is a number for
    each language, and the counted strings of the sample, whose size it bounds.
    """
    rows = docs.select(docs[id].cast("string").alias("id"), docs[text].alias("text"), docs[lang].alias("lang"))
    rows = rows.where("text is not null and lang is not null and lang <> ''")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    shares = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, min(_PARTS, -(-_PARTS * sample_docs // n)))])
    # A share is at most the whole, and by it the sample is a little over or under what is asked for.
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(_PARTS)) < shares[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = found["lang"].to_numpy(zero_copy_only=False)
    gram, n = found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy().astype(float)
    return Model({x: (gram[langs == x], n[langs == x]) for x in sorted(set(langs))})


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then lang_pred and score, for each row.

    lang_pred is ``und`` and the score 0 where the text is null or has no
    letter, or where no language was learned; ties go to the first language by
    name. The score is the winner's share of the languages' likelihoods. Only
    the text is looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias("_lid_text"))
    names = [f.name for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw, offsets = buffers(texts)
            preds, scores = [], []
            for a, b in chunks(offsets):
                bits = known.lengths(raw, offsets[a : b + 1])
                for i, row in enumerate(bits):
                    if not known.langs or not _has_letter(texts[a + i].as_py()):
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row.argmin())
                    preds.append(known.langs[best])
                    scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                [*names, "lang_pred", "score"],
            )

    schema = kept.drop("_lid_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return kept.mapInArrow(run, schema)


def held_out(id: str = "doc_id"):
    """Whether a document is kept from the training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from those not held out.

    A null text, an empty one and one without a letter are und; a text of any
    length is scored whole; of equal scores the language first by name wins;
    repeated rows are each scored; a null id is not held out. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
