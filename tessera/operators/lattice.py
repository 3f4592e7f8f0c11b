"""A morphological analyser: words of a dictionary and unknown words form a lattice, whose cheapest path is the analysis.

A dictionary is in the public format of four text files: words (surface, left and
right context, cost, features), the cost of each right context before each left
one, classes of characters, and templates of unknown words. It is read by
Spark, bounded in size, and broadcast; a worker builds a trie of it once. White
space parts a text into stretches that are analysed apart, and a worker remembers short
stretches it has seen. The analyser is a Column function that ``build_index`` takes.
"""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and connections that a dictionary may hold: it is broadcast, so a larger one is an error.
MOST_WORDS, MOST_CONNECTIONS = 4_000_000, 64_000_000
#: Stretches that a worker remembers, each of up to so many characters.
REMEMBERED, LONGEST = 200_000, 32
# Parts of speech that are left out, and those that give their dictionary form: fixed values.
STOP_POS = frozenset({"助詞", "助動詞", "補助記号"})
LEMMA_POS = frozenset({"動詞", "形容詞"})


class Word(NamedTuple):
    """A node of the lattice: its contexts, cost, part of speech, dictionary form and normal form (empty: the surface)."""

    left: int
    right: int
    cost: int
    pos: str
    base: str = ""
    normal: str = ""


class Morph(NamedTuple):
    surface: str
    pos: str
    base: str
    normal: str


class Category(NamedTuple):
    """Whether unknown words are tried beside known ones, whether a whole run is one, and up to how many characters otherwise."""

    invoke: bool
    group: bool
    length: int


@dataclass
class Dictionary:
    """words by surface; connections[right, left]; ranges (first, last, names) of which later ones win; unknown words by category."""

    words: dict[str, list[Word]]
    connections: dict[tuple[int, int], int] = field(default_factory=dict)
    categories: dict[str, Category] = field(default_factory=lambda: {"DEFAULT": Category(False, True, 0)})
    ranges: list[tuple[int, int, str]] = field(default_factory=list)
    unknown: dict[str, list[Word]] = field(default_factory=lambda: {"DEFAULT": [Word(0, 0, 20_000, "unknown")]})


@dataclass(frozen=True)
class Layout:
    """Columns (from 0) of a dictionary's word file, beyond surface, left, right and cost: part of speech, dictionary form, normal form."""

    pos: int = 4
    base: int | None = 10
    normal: int | None = None


def read_dictionary(spark: SparkSession, words: str, matrix: str, chars: str, unknown: str, layout: Layout = Layout(), encoding: str = "UTF-8") -> Dictionary:
    """A dictionary from paths that Spark reads (a folder or pattern may name several word files)."""

    def rows(path: str, most: int) -> list[str]:
        # One row more shows that there are too many.
        found = spark.read.option("encoding", encoding).text(path).where("trim(value) <> ''").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{path} has more than {most} rows, too many to broadcast")
        return [r[0] for r in found]

    def word(cells: list[str]) -> Word:
        cell = lambda i: cells[i] if i is not None and i < len(cells) and cells[i] != "*" else ""
        return Word(int(cells[1]), int(cells[2]), int(cells[3]), cell(layout.pos), cell(layout.base), cell(layout.normal))

    known: dict[str, list[Word]] = {}
    for cells in csv.reader(rows(words, MOST_WORDS)):
        known.setdefault(cells[0], []).append(word(cells))
    # The first row has the numbers of contexts; a text source may give rows in any order, so rows are told by their width.
    connections = {}
    for line in rows(matrix, MOST_CONNECTIONS):
        cells = line.split()
        if len(cells) == 3 and int(cells[2]):
            connections[int(cells[0]), int(cells[1])] = int(cells[2])
    categories: dict[str, Category] = {}
    ranges: list[tuple[int, int, str]] = []
    for line in rows(chars, 100_000):
        cells = line.split("#")[0].split()
        if not cells:
            continue
        if cells[0].startswith("0x"):
            first, _, last = cells[0].partition("..")
            ranges.append((int(first, 16), int(last or first, 16), cells[1]))
        else:
            categories[cells[0]] = Category(cells[1] == "1", cells[2] == "1", int(cells[3]))
    templates: dict[str, list[Word]] = {}
    for cells in csv.reader(rows(unknown, 100_000)):
        templates.setdefault(cells[0], []).append(word(cells))
    return Dictionary(known, connections, categories, ranges, templates)


class Lattice:
    """Cheapest paths through the words of texts."""

    def __init__(self, dictionary: Dictionary):
        self.words, self.connections = dictionary.words, dictionary.connections
        self.categories, self.ranges, self.unknown = dictionary.categories, dictionary.ranges, dictionary.unknown
        self.classes: dict[str, str] = {}
        self.alone: dict[str, tuple[bool, Word | None]] = {}
        # The trie: of each node its children, and the words that end there.
        self.trie: dict = {}
        # Of each surface the first of its cheapest words, which is enough where connections cost nothing.
        self.cheapest = {surface: min(words, key=lambda w: w.cost) for surface, words in dictionary.words.items() if words}
        for surface, words in dictionary.words.items():
            node = self.trie
            for c in surface:
                node = node.setdefault(c, {})
            if surface and words:
                node[""] = words

    def category(self, c: str) -> str:
        if c not in self.classes:
            at = ord(c)
            own = [name for first, last, name in self.ranges if first <= at <= last]
            self.classes[c] = own[-1] if own and own[-1] in self.categories else "DEFAULT"
        return self.classes[c]

    def single(self, c: str) -> tuple[bool, Word | None]:
        """Whether unknown words are tried beside known ones at a character, and the cheapest if all are of that one character."""
        name = self.category(c)
        kind = self.categories.get(name, Category(False, True, 0))
        one = not kind.group and kind.length < 2
        self.alone[c] = kind.invoke, min(self.templates(name), key=lambda w: w.cost) if one else None
        return self.alone[c]

    def pieces(self) -> re.Pattern | None:
        """What a text's stretches fall into without a change of the cheapest path, if connections cost nothing.

        A character that no known word has is an unknown word of its own where all unknown
        words are of one character, so what lies before and after it is analysed apart.
        """
        kinds = [*self.categories.values(), *([] if "DEFAULT" in self.categories else [Category(False, True, 0)])]
        own = {c for surface in self.words for c in surface if not c.isspace()}
        if self.connections or any(kind.group or kind.length > 1 for kind in kinds) or not own:
            return None
        return re.compile("[" + "".join(map(re.escape, sorted(own))) + "]+|\\S")

    def edges(self, text: str, at: int) -> Iterable[tuple[int, Word]]:
        """Words that begin at a place, with their ends: known ones by length, then unknown ones."""
        node, known = self.trie, False
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            for w in node.get("", ()):
                known = True
                yield end + 1, w
        yield from self.unknown_edges(text, at, known)

    def unknown_edges(self, text: str, at: int, known: bool) -> Iterable[tuple[int, Word]]:
        """Unknown words that begin at a place; where known ones do, only those of a category that is tried beside them."""
        name = self.category(text[at])
        kind = self.categories.get(name, Category(False, True, 0))
        if known and not kind.invoke:
            return
        run = at + 1
        while run < len(text) and self.category(text[run]) == name:
            run += 1
        ends = {at + n for n in range(1, kind.length + 1) if at + n <= run} | ({run} if kind.group else set()) or {at + 1}
        for end in sorted(ends):
            for w in self.templates(name):
                yield end, w

    def templates(self, name: str) -> list[Word]:
        return self.unknown.get(name) or self.unknown.get("DEFAULT") or [Word(0, 0, 20_000, "unknown")]

    def path(self, text: str) -> tuple[int, list[Morph]]:
        """The cheapest path's cost and words; of equal paths that whose last word came first among the edges, and so on back."""
        if not self.connections:
            return self._unconnected(text)
        n = len(text)
        # Of each place the nodes that end there: cost so far, right context, beginning, word, number of the node before.
        nodes: list[list[tuple[int, int, int, Word | None, int]]] = [[] for _ in range(n + 1)]
        nodes[0].append((0, 0, 0, None, -1))
        cost_of = self.connections.get
        for at in range(n):
            if not nodes[at]:
                continue
            # Nodes with one right context differ in cost alone: of each the best is enough.
            best: dict[int, tuple[int, int]] = {}
            for i, (cost, right, *_) in enumerate(nodes[at]):
                if right not in best or cost < best[right][0]:
                    best[right] = cost, i
            found: dict[int, tuple[int, int]] = {}
            for end, w in self.edges(text, at):
                if w.left not in found:
                    found[w.left] = min((cost + cost_of((right, w.left), 0), i) for right, (cost, i) in best.items())
                cost, i = found[w.left]
                nodes[end].append((cost + w.cost, w.right, at, w, i))
        total, i = min((cost + cost_of((right, 0), 0), i) for i, (cost, right, *_) in enumerate(nodes[n]))
        out, end = [], n
        while end:
            _, _, at, w, i = nodes[end][i]
            surface = text[at:end]
            out.append(Morph(surface, w.pos, w.base, w.normal or surface))
            end = at
        return total, out[::-1]

    def _unconnected(self, text: str) -> tuple[int, list[Morph]]:
        """The same where connections cost nothing: nodes that end at one place differ in cost alone, so each place has one."""
        n, trie, cheapest = len(text), self.trie, self.cheapest
        costs: list[int | None] = [0] + [None] * n
        back: list[tuple[int, Word] | None] = [None] * (n + 1)
        for at in range(n):
            cost = costs[at]
            if cost is None:
                continue
            node, end, known = trie, at, False
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                if "" in node:
                    known = True
                    w = cheapest[text[at:end]]
                    if costs[end] is None or cost + w.cost < costs[end]:
                        costs[end], back[end] = cost + w.cost, (at, w)
            c = text[at]
            alone = self.alone.get(c) or self.single(c)
            if alone[1] is None:
                unknown = self.unknown_edges(text, at, known)
            elif known and not alone[0]:
                continue
            else:
                unknown = ((at + 1, alone[1]),)
            for end, w in unknown:
                if costs[end] is None or cost + w.cost < costs[end]:
                    costs[end], back[end] = cost + w.cost, (at, w)
        out, end = [], n
        while end:
            at, w = back[end]
            surface = text[at:end]
            out.append(Morph(surface, w.pos, w.base, w.normal or surface))
            end = at
        return costs[n], out[::-1]


class Analyser:
    """Tokens of texts: words of the cheapest path in their normal or dictionary form, without stop parts of speech and symbols."""

    def __init__(self, dictionary: Dictionary, normal: bool = True, stop: frozenset[str] = STOP_POS, lemma: frozenset[str] = LEMMA_POS, symbols: bool = False):
        self.lattice, self.normal, self.stop, self.lemma, self.symbols = Lattice(dictionary), normal, stop, lemma, symbols
        # The stretches since the last ``REMEMBERED`` new ones, and those before: what is seen again stays.
        self.known: dict[str, list[str]] = {}
        self.older: dict[str, list[str]] = {}
        pieces = self.lattice.pieces()
        self.parts = pieces.findall if pieces else str.split

    def stretch(self, text: str) -> list[str]:
        out = []
        for m in self.lattice.path(text)[1]:
            token = m.base if m.pos in self.lemma and m.base else m.normal if self.normal else m.surface
            token = token.strip()
            if token and m.pos not in self.stop and (self.symbols or any(_visible(c) for c in token)):
                out.append(token)
        return out

    def tokens(self, text: str | None) -> list[str]:
        out: list[str] = []
        for part in self.parts(text or ""):
            own = self.known.get(part)
            if own is None:
                own = self.older.get(part)
                if own is None:
                    own = self.stretch(part)
                if len(part) <= LONGEST:
                    if len(self.known) >= REMEMBERED:
                        self.known, self.older = {}, self.known
                    self.known[part] = own
            out += own
        return out


def _visible(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM"


_LOADED: dict[int, Analyser] = {}


def analyser_terms(spark: SparkSession, dictionary: Dictionary, lower: bool = True, **options) -> Callable[[Column], Column]:
    """A function of a text column that gives its tokens as an array: for ``build_index``, ``query_terms`` and the sparse stage.

    A null or empty text has no tokens. ``options`` are those of ``Analyser``.
    """
    shared = spark.sparkContext.broadcast((dictionary, options))
    number = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") else id(shared)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        if number not in _LOADED:
            own, how = shared.value
            _LOADED[number] = Analyser(own, **how)
        tokens = _LOADED[number].tokens
        return pd.Series([tokens(t) for t in texts], dtype=object)

    return lambda text: run(F.lower(text) if lower else text)


def frequency_dictionary(docs: DataFrame, most: int = 65_536, stop_share: float = 0.5, scale: float = 100.0) -> Dictionary:
    """A dictionary of the ``most`` frequent words of docs(text): a word's cost is its information, ``scale`` to a nat.

    Words of more than ``stop_share`` of the documents get the part of speech ``stop``,
    others ``word``. Connections cost nothing; a run of letters that no words
    make up is one unknown word, dearer than any known one and the more so by its length.
    """
    from math import log

    from tessera.functions.text import counted, tokens
    from tessera.session import kept

    n = docs.count()
    each = docs.select(F.inline(counted(tokens(F.col("text")))).alias("w", "n"))
    # Read twice, so counted once and saved: a row for each distinct word.
    counts = kept(each.groupBy("w").agg(F.sum("n").alias("n"), F.count("*").alias("df")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    rows = counts.orderBy(F.desc("n"), "w").limit(most).collect()
    words = {r["w"]: [Word(0, 0, round(scale * log(total / r["n"])), "stop" if r["df"] > stop_share * n else "word", r["w"])] for r in rows}
    dearest = round(scale * log(total + 1))
    return Dictionary(words, unknown={"DEFAULT": [Word(0, 0, 2 * dearest, "unknown")]}, categories={"DEFAULT": Category(False, False, 1)})
