"""Byte-pair encoding and decoding with a lexicon in a minimal acyclic transducer.

The corpus's frequent words are compiled, with the place of their ids as output,
into an automaton in which equal suffixes are one state. Outputs lie on the arcs
and add up along a word to its number. The arcs are flat arrays in one file,
which workers map into memory. Words that are not in it are merged exactly, pair
by pair in the order of the merge list.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir
from tessera.llm.merges import MergeList, pieces
from tessera.llm.token_codec import open_folder
from tessera.llm.tokens import plain_words, texts_of, tokenizer_path

#: Words of the lexicon, the most frequent of the corpus, at the most.
LEXICON = 65_536
#: Words that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 900_000
#: Texts whose unseen words are looked up together.
TOGETHER = 256
#: Distinct words that are counted together before they are handed on.
COUNTED = 400_000
MAGIC = b"TLEX0001"

# White space of the vocabulary's library; Python takes four control characters for it as well.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_ODD = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{_WHITE}]+")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer file of words and their ids.

    Words are added in order; when a word leaves a branch, that branch is final
    and its states are replaced by equal ones that exist (from the end on), so
    the automaton is minimal at any time.
    """
    order = sorted(w for w in words if w)
    arcs: list[list[list]] = [[]]  # of each state: [byte, target]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[int] = [0]

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(map(tuple, arcs[state])))
            arcs[path[-1]][-1][1] = register.setdefault(key, state)

    previous = b""
    for word in order:
        common = 0
        while common < len(previous) and common < len(word) and previous[common] == word[common]:
            common += 1
        settle(common)
        for b in word[common:]:
            arcs.append([])
            final.append(False)
            arcs[path[-1]].append([b, len(arcs) - 1])
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        previous = word
    settle(0)
    # States in use, numbered from the start on; how many words each accepts; outputs on the arcs.
    number, stack = {0: 0}, [0]
    while stack:
        for _, target in arcs[stack.pop()]:
            if target not in number:
                number[target] = len(number)
                stack.append(target)
    accepts: dict[int, int] = {}

    def count(state: int) -> int:
        todo = [state]
        while todo:
            s = todo[-1]
            open_ = [t for _, t in arcs[s] if t not in accepts]
            if open_:
                todo += open_
            else:
                accepts[s] = final[s] + sum(accepts[t] for _, t in arcs[s])
                todo.pop()
        return accepts[state]

    count(0)
    keys, targets, outputs = [], [], []
    for state, n in number.items():
        sofar = int(final[state])
        for b, target in arcs[state]:
            keys.append(n << 8 | b)
            targets.append(number[target])
            outputs.append(sofar)
            sofar += accepts[target]
    place = np.argsort(keys) if keys else np.zeros(0, dtype=int)
    ends = np.zeros(len(number), dtype="<u4")
    for state, n in number.items():
        ends[n] = final[state]
    at = np.concatenate([[0], np.cumsum([len(words[w]) for w in order])]) if order else np.zeros(1)
    flat = np.array([i for w in order for i in words[w]])
    parts = [np.array(keys)[place] if keys else [], np.array(targets)[place] if keys else [], np.array(outputs)[place] if keys else [], ends, at, flat]
    parts = [np.asarray(p, dtype="<u4") for p in parts]
    return MAGIC + np.array([len(p) for p in parts], dtype="<u4").tobytes() + b"".join(p.tobytes() for p in parts)


class Transducer:
    """A lexicon file mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if raw[:8] != MAGIC:
            raise ValueError("not a lexicon")
        sizes = np.frombuffer(raw, dtype="<u4", count=6, offset=8)
        at, parts = 8 + 24, []
        for n in sizes.tolist():
            parts.append(np.frombuffer(raw, dtype="<u4", count=n, offset=at))
            at += 4 * n
        self.keys, self.targets, self.outputs, self.final, self.at, self.ids = parts

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None: all words take a step together."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state, total = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = np.flatnonzero(sizes > 0)
        found = np.zeros(n, dtype=bool)
        step = 0
        while len(alive):
            key = state[alive] << 8 | flat[begin[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[arc] == key
            alive, arc = alive[good], arc[good]
            total[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
            step += 1
            ended = sizes[alive] == step
            done = alive[ended]
            found[done] = self.final[state[done]] > 0
            alive = alive[~ended]
        return [self.ids[self.at[k] : self.at[k + 1]].tolist() if f else None for f, k in zip(found.tolist(), total.tolist())]


def _cut(text: str) -> list[str]:
    """Words whose ids in a row are the text's."""
    return [x for x in _SPLIT.split(text) if x] if _ODD.search(text) else plain_words(text)


class LexiconTokenizer:
    """Encodes and decodes texts; words go through the transducer, then the merge list."""

    def __init__(self, vocabulary: str, lexicon: str | None):
        self.merges = MergeList(vocabulary)
        self.transducer = Transducer(lexicon) if lexicon else None
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.known: dict[str, tuple[int, str, str]] = {}

    def _learn(self, words: list[str]) -> dict[str, list[int]]:
        cut = {w: [p.encode() for p in pieces(w)] for w in words}
        every = list({p for x in cut.values() for p in x})
        ids = dict(zip(every, self.transducer.look_up(every) if self.transducer else [None] * len(every)))
        unseen = [p for p, found in ids.items() if found is None]
        ids.update(zip(unseen, self.merges.merge_all(unseen)))
        return {w: [i for p in x for i in ids[p]] for w, x in cut.items()}

    def decode(self, ids: list[int]) -> str:
        """What the library makes of ids where the file names no decoder: the tokens, with a space between them."""
        return " ".join([self.merges.tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.forms(text)[1].split()]

    def forms(self, text: str) -> tuple[int, str, str]:
        """The number of ids of a text, the ids in decimal, and what they decode to, each joined by spaces."""
        if self.special and self.special.search(text):
            found, at = [], 0
            for m in self.special.finditer(text):
                i = self.merges.special[m[0]]
                found += [self._plain(text[at : m.start()]), (1, str(i), self.decode([i]))]
                at = m.end()
            found.append(self._plain(text[at:]))
            found = [x for x in found if x[0]]
            return sum(x[0] for x in found), " ".join(x[1] for x in found), " ".join(x[2] for x in found)
        return self._plain(text)

    def _plain(self, text: str) -> tuple[int, str, str]:
        words = _cut(text)
        self._learn_all([words])
        return self._joined(words)

    def _learn_all(self, texts: list[list[str]]) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for words in texts for w in words if w not in known}
        if new:
            for w, ids in self._learn(list(new)).items():
                known[w] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def _joined(self, words: list[str]) -> tuple[int, str, str]:
        found = [x for x in map(self.known.__getitem__, words) if x[0]]
        if not found:
            return 0, "", ""
        sizes, ids, decoded = zip(*found)
        return sum(sizes), " ".join(ids), " ".join(decoded)

    def forms_of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """``forms`` of some texts, their unseen words learned together."""
        cut = [None if self.special and self.special.search(t) else _cut(t) for t in texts]
        self._learn_all([words for words in cut if words])
        # Those without added tokens first: a text with them may make the worker forget words.
        plain = [None if words is None else self._joined(words) for words in cut]
        return [self.forms(t) if x is None else x for t, x in zip(texts, plain)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of texts as they stand, counted; handed on whenever there are many."""
    counts: Counter = Counter()

    def hand_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(_cut(text))
            if len(counts) > COUNTED:
                yield hand_on()
                counts.clear()
    yield hand_on()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for p in pieces(word):
                counts[p] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, size: int = LEXICON, text: str = "text") -> list[str]:
    """The corpus's ``size`` most frequent pre-tokens, counted over all texts; of equal counts the first in order of bytes.

    The driver gets these words and nothing else.
    """
    counted = docs.select(docs[text].alias("text")).mapInArrow(_count, "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_pieces, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r["word"] for r in words.orderBy(F.desc("n"), "word").limit(size).collect())


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = LEXICON) -> tuple[str, str]:
    """Compiles the lexicon of ``docs`` into a file of the shared folder; the folder and the file's name."""
    words = [w.encode() for w in frequent_words(docs, size)]
    raw = compile_lexicon(dict(zip(words, MergeList(tokenizer_path(vocabulary)).merge_all(words))))
    folder = shared_dir(docs.sparkSession)
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/words.lex") as f:
        f.write(raw)
    return folder, "words.lex"


_LOADED: dict[tuple, LexiconTokenizer] = {}


def lexicon_tokenizer(vocabulary: str, folder: str, name: str) -> LexiconTokenizer:
    """A worker's tokenizer; the lexicon is mapped where it lies, or from a copy where its store has no local path."""
    key = (vocabulary, folder, name)
    if key not in _LOADED:
        system, path = open_folder(folder)
        place = f"{path}/{name}"
        _LOADED.clear()
        if system.type_name == "local":
            _LOADED[key] = LexiconTokenizer(tokenizer_path(vocabulary), place)
        else:
            # The copy goes when it is mapped; the map holds on to its bytes.
            with tempfile.NamedTemporaryFile() as copy:
                with system.open_input_file(place) as f:
                    copy.write(f.read())
                copy.flush()
                _LOADED[key] = LexiconTokenizer(tokenizer_path(vocabulary), copy.name)
    return _LOADED[key]


def bpe_report(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = LEXICON, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``.

    ids_sha256 is of the decimal ids joined by a space, decoded_sha256 of the
    text that the ids decode to. A null text counts as empty and has no ids.
    A text of any length is encoded whole; repeated rows are each encoded; words
    of equal count enter the lexicon in order of their bytes. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    folder, name = build_lexicon(docs, vocabulary, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = lexicon_tokenizer(vocabulary, folder, name)
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for at in range(0, batch.num_rows, TOGETHER):
                for n, ids, decoded in tokenizer.forms_of(list(texts_of(batch.column(1).slice(at, TOGETHER)))):
                    for column, value in zip(rows, (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
