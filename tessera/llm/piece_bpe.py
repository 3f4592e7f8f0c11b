"""Byte-level BPE through sentencepiece: a BPE model written straight from a rank file's vocabulary.

Each token becomes a piece, its bytes standing as letters; a piece's score is its
negative rank, and nothing is normalised, so the model merges the pair of lowest
rank first, leftmost first, as the rank file asks for. Texts are cut into
pre-tokens by the vocabulary's pattern; a worker keeps the ids of pre-tokens it
has seen and sends the others to the model together. Ids are turned back by
looking up each one's bytes.

What it makes of unusual input: a null or empty text has no ids, and the digests
of nothing. Texts of any length are worked on whole; one beyond ``LONG`` code
points is cut pre-token by pre-token, so that its parts are never all in memory.
A null doc_id, repeated rows and ties are rows like others; an empty table gives
an empty one. Columns other than those named are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.merges import byte_letters
from tessera.llm.tokens import texts_of, tokenizer_path

#: Pre-tokens that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 1_000_000
#: Only pre-tokens of up to so many characters are remembered.
LONGEST = 64
#: Texts of more code points are cut into pre-tokens by and by, so many of these at a time.
LONG, STRETCH = 1 << 20, 1 << 16

# Stand-ins of the three classes that the pattern knows, none of them in a contraction.
_LETTER, _NUMBER, _OTHER = "ª", "²", "§"


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of ``tokens``, which stand by rank: a piece's id is its token's place.

    The unknown piece that every model needs comes last; as each byte is a
    piece, it is never used.
    """
    # Numbers of fields and kinds are those of sentencepiece's published model format: fixed values.
    pieces, trainer, normalizer = 1, 2, 3
    normal, unknown, bpe = 1, 2, 2
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        name = "".join([letters[b] for b in token]).encode()
        out.append(_chunk(pieces, _chunk(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal)))
    out.append(_chunk(pieces, _chunk(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown)))
    out.append(_chunk(trainer, _number(3, bpe) + _number(4, len(tokens) + 1)))
    # Identity: no table of characters, no dummy prefix, white space neither removed nor escaped.
    out.append(_chunk(normalizer, _chunk(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


def _classed(pattern: str, points: str) -> set[str]:
    """The characters that the library's own pattern engine puts into a class."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
    return set(bytes(engine.encode_ordinary(points)).decode())


def odd_characters() -> dict[int, str]:
    """Stand-ins of the characters that the two pattern engines put into different classes.

    The engines follow different versions of Unicode; a character that only one of them
    knows as a letter would move the borders of pre-tokens.
    """
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: dict[int, str] = {}
    theirs = {name: _classed(rf"\p{{{name}}}", points) for name in ("L", "N")}
    space = _classed(r"\s", points)
    if space != set(regex.findall(r"\s", points)):
        raise ValueError("the pattern engines disagree on white space")
    for name in ("L", "N"):
        for c in theirs[name] ^ set(regex.findall(rf"\p{{{name}}}", points)):
            out[ord(c)] = _LETTER if c in theirs["L"] else _NUMBER if c in theirs["N"] else _OTHER
    return out


class PieceModel:
    """Encodes and decodes texts as the library of a rank file does, by a sentencepiece model."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import sentencepiece

        ranks = read_ranks(path)
        order = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(order))
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.odd = odd_characters()
        self.odd_set = frozenset(map(chr, self.odd))
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        # A token's rank is its id; where ranks have gaps, places and ids differ.
        self.ids = np.array([ranks[t] for t in order], dtype=np.uint32)
        self.bytes = np.full(int(self.ids.max()) + 1, None, dtype=object)
        self.bytes[self.ids] = order
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in stretches."""
        if not text.isascii() and not self.odd_set.isdisjoint(text):
            same = self.pattern.finditer(text.translate(self.odd))
            while some := [text[m.start() : m.end()] for m in islice(same, STRETCH)]:
                yield some
        elif len(text) > LONG:
            found = self.pattern.finditer(text)
            while some := [m.group() for m in islice(found, STRETCH)]:
                yield some
        else:
            yield self.pattern.findall(text)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens by the model, as little-endian integers in bytes."""
        mapped = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [self.ids[x].tobytes() for x in self.model.encode(mapped, out_type=int, num_threads=1)]

    def look_up(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token; those that the worker has not seen are merged together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found) if x is None})
            ids = dict(zip(new, self.merge(new)))
            found = [ids[w] if x is None else x for w, x in zip(words, found)]
            known.update((w, x) for w, x in ids.items() if len(w) <= LONGEST)
        return found

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in stretches."""
        for words in self.words(text):
            if words:
                yield np.frombuffer(b"".join(self.look_up(words)), dtype="<u4")

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """The ids of several texts in their order: a text's place and a stretch of its ids, once or more often."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in self.words(text):
                held.append((i, words))
                size += len(words)
                if size >= STRETCH:
                    yield from self._encoded(held)
                    held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        found, at = self.look_up([w for _, words in held for w in words]), 0
        for i, words in held:
            yield i, np.frombuffer(b"".join(found[at : at + len(words)]), dtype="<u4")
            at += len(words)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id outside the vocabulary is an error."""
        return b"".join(self.bytes[ids].tolist())


_LOADED: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """A worker's model of a rank file; kept between its tasks."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, ids): the ids of each text as an array."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(tokenizer_path(vocabulary))
        for batch in batches:
            for some in _slices(batch):
                ids = [[np.empty(0, "<u4")] for _ in range(some.num_rows)]
                for i, part in model.encode_all(list(texts_of(some["text"]))):
                    ids[i].append(part)
                ids = pa.array([np.concatenate(x).astype(np.int32) for x in ids], type=schema.field(1).type)
                yield pa.RecordBatch.from_arrays([some["doc_id"], ids], schema=schema)

    return _plain(docs, "text", "string").mapInArrow(work, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, content): the bytes that ids stand for; null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(tokenizer_path(vocabulary))
        for batch in batches:
            out = [model.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, type=pa.binary())], schema=schema)

    return _plain(ids, "ids", "array<int>").mapInArrow(work, "doc_id long, content binary")


def round_trip_report(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document: its ids in decimal, and what these decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(tokenizer_path(vocabulary))
        decimal = np.array([b"%d" % i for i in range(len(model.bytes))], dtype=object)
        for batch in batches:
            for some in _slices(batch):
                counts = [0] * some.num_rows
                ids_sha, text_sha = ([hashlib.sha256() for _ in counts] for _ in range(2))
                for i, ids in model.encode_all(list(texts_of(some["text"]))):
                    ids_sha[i].update((b"," if counts[i] else b"") + b",".join(decimal[ids].tolist()))
                    text_sha[i].update(model.decode(ids))
                    counts[i] += len(ids)
                columns = [pa.array(counts, pa.int64()), *(pa.array([x.hexdigest() for x in own]) for own in (ids_sha, text_sha))]
                yield pa.RecordBatch.from_arrays([some["doc_id"], *columns], schema=schema)

    return _plain(docs, "text", "string").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast(kind).alias(column))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that what a part becomes stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
