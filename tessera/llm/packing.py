"""Packing of documents into token windows by lexical retrieval.

Token ids are written once. Document frequencies are counted over all documents.
Documents are then ordered by a lexical key, whose terms lead from a wide group of
documents to a narrow one, and dealt in that order, so that related ones are in one
shard wherever they stood; a group too large for a shard is split by a hash of the
id. An inverted index with BM25 weights is built for each shard of documents, and a
window is filled from its seed: the unused documents of the shard that score for the
seed's weightiest terms follow it, best first, until the window is full or none is left.
The document that runs over the window's end goes on in the next window and is its
seed, so only the last window of a partition is short; that one is cut into powers
of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.tokens import id_type, rank_tokenizer, texts_of, tokenizer_path, vocabulary_size

#: Tokens of a window.
WINDOW = 2048
#: The id that ends each document.
END = 1
#: A shard is closed at so many documents or tokens; its index is in memory.
SHARD_DOCS, SHARD_TOKENS = 4096, 4_000_000
#: Terms of a query: the weightiest quarter of the seed's terms, but so many at the least and at the most.
LEAST_TERMS, MOST_TERMS = 16, 64
K1, B = 1.5, 0.75
#: Partitions that documents are dealt to, at the most: the bounds between them come from SAMPLED keys for each.
MOST_PARTS = 8192
#: Documents of a partition whose keys are sampled to set its bounds.
SAMPLED = 64


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a document in order, and how often each occurs."""
    own = np.sort(ids)
    at = np.flatnonzero(own[1:] != own[:-1]) + 1
    first = np.concatenate([[0], at])
    return own[first], np.diff(first, append=len(own))


def _tokenise(vocabulary: str, ranks: str | None, size: int):
    """(doc_id, ids) of each document; the last row of a partition has df instead, each id's number of documents, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = rank_tokenizer(tokenizer_path(vocabulary), ranks and tokenizer_path(ranks))
        end = np.array([END], dtype=tokenizer.dtype).tobytes()
        df, docs, tokens = np.zeros(size, dtype="<i8"), 0, 0
        names = ["doc_id", "ids", "df", "docs", "tokens"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [tokenizer.encode(t) + end for t in texts_of(part.column(1))]
                for x in ids:
                    own = np.frombuffer(x, dtype=tokenizer.dtype)
                    df[_terms(own)[0]] += 1
                    tokens += len(own)
                docs += len(ids)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary()), none, none], names)
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary()), pa.array([docs]), pa.array([tokens])], names
            )

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of counts."""
    df, docs, tokens = None, 0, 0
    for batch in batches:
        for raw, n, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(raw.as_py(), dtype="<i8")
            df = own.copy() if df is None else df + own
            docs, tokens = docs + n, tokens + k
    if df is not None:
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([docs]), pa.array([tokens])], ["df", "docs", "tokens"])


def _keys(df: np.ndarray, idf: np.ndarray, least: tuple[int, ...], bounds: np.ndarray | None):
    """(key, part, doc_id, ids) of (doc_id, ids, salt); without ``bounds`` the key alone.

    For each of ``least`` in turn, the key holds the last 16 bits of the term of
    greatest weight among those that so many documents have; the last 15 are the salt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=np.int64)
            for i, raw in enumerate(batch.column(1)):
                t, tf = _terms(np.frombuffer(raw.as_py(), dtype=id_type(len(df))))
                weight = idf[t] * tf / (tf + K1)
                for n in least:
                    fit = np.where(df[t] >= n, weight, -1.0)
                    best = int(fit.argmax())
                    keys[i] = keys[i] << 16 | (int(t[best]) & 0xFFFF if fit[best] >= 0 else 0)
            keys = keys << 15 | batch.column(2).to_numpy()
            if bounds is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])
            else:
                part = np.searchsorted(bounds, keys, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part), batch.column(0), batch.column(1)], ["key", "part", "doc_id", "ids"])

    return run


def _dealt(tokens: DataFrame, df: np.ndarray, idf: np.ndarray, n: int, total: int) -> DataFrame:
    """(doc_id, ids) with related documents beside each other, in partitions of about a shard each."""
    shards = int(np.ceil(max(n / SHARD_DOCS, total / SHARD_TOKENS)))
    if shards <= 1:
        return tokens.coalesce(1)
    # Beyond MOST_PARTS a partition has several shards, one after the other, so the sample of keys stays bounded.
    parts = min(shards, MOST_PARTS)
    salted = tokens.select("doc_id", "ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 15)).alias("salt"))
    # Groups of a quarter of a shard, of a few windows, and of near copies.
    least = (max(4, n // (4 * shards)), max(3, n // (64 * shards)), 2)
    rate = min(1.0, SAMPLED * parts / n)
    picked = salted.where(F.pmod(F.xxhash64("ids", "doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    found = picked.mapInArrow(_keys(df, idf, least, None), "key long").toArrow()["key"].to_numpy()
    keys = np.sort(found) if len(found) else np.zeros(1, dtype=np.int64)
    bounds = keys[np.arange(1, parts) * len(keys) // parts]
    keyed = salted.mapInArrow(_keys(df, idf, least, bounds), "key long, part int, doc_id long, ids binary")
    return keyed.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")


class Shard:
    """An inverted index of some documents with BM25 weights, and which of them are unused."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.idf, self.unused, n = idf, np.ones(len(ids), dtype=bool), len(ids)
        terms, counts = zip(*map(_terms, ids))
        every, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        sizes = np.array([len(t) for t in terms])
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        length = np.array([len(x) for x in ids], dtype=np.float32)[owner]
        weight = idf.astype(np.float32)[every] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        order = np.argsort(every, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        # Of each document's terms, where their postings begin and end.
        known, first = np.unique(every[order], return_index=True)
        ends = np.append(first[1:], len(every))
        place = np.searchsorted(known, every)
        # A document's own terms, the weightiest first, and the first so many of them.
        by_weight = np.lexsort((-weight, owner))
        rank = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wanted = np.minimum(sizes, np.clip(sizes // 4, LEAST_TERMS, MOST_TERMS))
        asked = by_weight[rank < np.repeat(wanted, sizes)]
        cuts = np.cumsum(wanted)[:-1]
        self.begin, self.end = np.split(first[place[asked]], cuts), np.split(ends[place[asked]], cuts)
        self.n = n

    def neighbours(self, seed: int) -> Iterator[int]:
        """The unused documents that score for the seed's weightiest terms, best first, ties by place."""
        begin, sizes = self.begin[seed], self.end[seed] - self.begin[seed]
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        scores = np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)
        hit = np.flatnonzero((scores > 0) & self.unused)
        scores = scores[hit]
        # The best few are most often enough; the rest is put in order when they aren't.
        some = min(len(hit), 32)
        while len(hit):
            if some < len(hit):
                bar = -np.partition(-scores, some - 1)[some - 1]
                now = scores >= bar
            else:
                now = np.ones(len(hit), dtype=bool)
            best = hit[now]
            yield from best[np.lexsort((best, -scores[now]))].tolist()
            hit, scores = hit[~now], scores[~now]
            some *= 8


def _order(shard: Shard, lengths: list[int], filled: int) -> Iterator[int]:
    """The shard's documents in the order in which they fill windows; ``filled``: of the window that is open."""
    fresh = 0
    seed = None
    while True:
        if seed is None:
            while fresh < len(lengths) and not shard.unused[fresh]:
                fresh += 1
            if fresh == len(lengths):
                return
            seed = fresh
            shard.unused[seed] = False
            filled = (filled + lengths[seed]) % WINDOW
            yield seed
        overrun = None
        for i in shard.neighbours(seed) if filled else ():
            shard.unused[i] = False
            yield i
            filled += lengths[i]
            if filled >= WINDOW:
                filled %= WINDOW
                overrun = i
                break
        seed = overrun if filled else None


def _pack(idf: np.ndarray, mean_length: float):
    dtype = id_type(len(idf))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        # Pieces of the window that isn't full yet: (doc_id, start, ids, doc_tokens).
        held: list[tuple] = []
        filled = 0
        out: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, own, whole in pieces:
                crc = zlib.crc32(own.astype("<u4").tobytes())
                out.append((doc, start, len(own), crc, whole, sequence, offset))
                offset += len(own)
            sequence += 1

        def flush() -> pa.RecordBatch:
            rows = list(zip(*out)) if out else [()] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in rows], columns)

        def add(doc, own: np.ndarray) -> None:
            nonlocal filled
            start = 0
            while start < len(own):
                piece = own[start : start + WINDOW - filled]
                held.append((doc, start, piece, len(own)))
                start += len(piece)
                filled += len(piece)
                if filled == WINDOW:
                    close(held)
                    held.clear()
                    filled = 0

        def pack(docs: list, ids: list[np.ndarray]) -> None:
            if ids:
                shard = Shard(ids, idf, mean_length)
                for i in _order(shard, [len(x) for x in ids], filled):
                    add(docs[i], ids[i])

        docs: list = []
        ids: list[np.ndarray] = []
        tokens = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(raw.as_py(), dtype=dtype)
                docs.append(doc)
                ids.append(own)
                tokens += len(own)
                if len(docs) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    pack(docs, ids)
                    docs, ids, tokens = [], [], 0
                    yield flush()
        pack(docs, ids)
        # The last window: sequences of a power of two each have no padding.
        rest, held = held, []
        size = 1 << max(0, filled.bit_length() - 1)
        while filled:
            while size > filled:
                size >>= 1
            part, left = [], size
            while left:
                doc, start, own, whole = rest.pop(0)
                part.append((doc, start, own[:left], whole))
                if len(own) > left:
                    rest.insert(0, (doc, start + left, own[left:], whole))
                left -= min(left, len(own))
            close(part)
            filled -= size
        yield flush()

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and the end id; a null or empty text is the end id
    alone. Every id is in one piece, pieces fill a sequence from offset 0
    without gaps, and a sequence has WINDOW tokens or a power of two. A long text
    fills as many windows as it needs. Neighbours of equal score come in the
    order of their shard. Rows that repeat are packed each; a null id stays null.
    Other columns are ignored, whatever their names; an empty table gives an
    empty result. Neighbours are sought among the SHARD_DOCS documents (or
    SHARD_TOKENS tokens) that the lexical key puts together.
    """
    source = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"))
    # As many ids as the vocabulary has, those of added tokens included; END is one of them.
    size = vocabulary_size(tokenizer_path(vocabulary))
    both = written(source.mapInArrow(_tokenise(vocabulary, ranks, size), "doc_id long, ids binary, df binary, docs long, tokens long"), {"compression": "zstd"})
    tokens = both.where("docs is null").select("doc_id", "ids")
    counts, schema = both.where("docs is not null").select("df", "docs", "tokens"), "df binary, docs long, tokens long"
    # The counts of all ids in one row for each task, then in eight rows at the most, which the driver adds up.
    df, n, total = np.zeros(size), 0, 0
    for r in counts.mapInArrow(_add_up, schema).repartition(8).mapInArrow(_add_up, schema).collect():
        df, n, total = df + np.frombuffer(r["df"], dtype="<i8"), n + r["docs"], total + r["tokens"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return _dealt(tokens, df, idf, n, total).mapInArrow(_pack(idf, max(1.0, total / max(1, n))), schema)
