"""Merge lists of byte-pair vocabularies with word ends, applied to single words or to many at once."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

#: Words of up to so many bytes are merged together with others of their length.
SHORT = 40
#: Words that are merged together, at the most.
TOGETHER = 1 << 15

# The pre-tokenizer's pattern for a word without white space; a fixed value.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


# Letters below this are composed and have one lower-case form, except for the dotted capital I.
_OTHER_LETTER = re.compile("[\u0130\u0250-\U0010ffff]")


def normal(word: str) -> str:
    """The vocabulary's normal form of a word: composed, then each character lower-cased by itself."""
    if word.isascii():
        return word.lower()
    return "".join(map(str.lower, unicodedata.normalize("NFC", word)))


def pieces(word: str) -> list[str]:
    """The pre-tokens of a word without white space, in its normal form."""
    if word.isalpha() and (word.isascii() or not _OTHER_LETTER.search(word)):
        return [word.lower()]
    return _PIECE.findall(normal(word))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class MergeList:
    """The vocabulary and merges of a file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # By ids: the rank of a pair, and what the pair of a rank becomes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.becomes: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.becomes.append(self.vocab[a + b])
        letters = byte_letters()
        self.inner = [self.vocab.get(x) for x in letters]
        self.last = [self.vocab.get(x + self.end) for x in letters]
        self.keys = np.array([a << 32 | b for a, b in self.ranks], dtype=np.int64)
        order = np.argsort(self.keys)
        self.keys, self.key_rank = self.keys[order], np.array(list(self.ranks.values()), dtype=np.int32)[order]
        self.becomes_array = np.array(self.becomes, dtype=np.int32)
        self.whole = None not in self.inner and None not in self.last
        if self.whole:
            self.first, self.final = np.array(self.inner, dtype=np.int32), np.array(self.last, dtype=np.int32)
            # Ranks of two bytes, the second of which doesn't or does end the word.
            self.byte_rank, self.last_rank = (self._rank(np.repeat(self.first, 256), np.tile(x, 256)) for x in (self.first, self.final))

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token: the pair that comes first in the list is merged, then again, leftmost first."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        # Without an unknown token, letters outside the vocabulary are left out.
        ids = [x for x in ids if x is not None]
        get, n = self.ranks.get, len(ids)
        # A queue of pairs by rank and place; entries that a merge has overtaken no longer fit what stands there.
        queue = [(rank, i) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if ids[i] is not None else n
            if j >= n or get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = self.becomes[rank], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (rank, i))
            h = before[i]
            if h >= 0 and (rank := get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (rank, h))
        return [x for x in ids if x is not None]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], len(self.becomes)).astype(np.int32)

    def _merge_alike(self, words: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``merge`` of words of one length, a step of all of them at a time: places of words with as many ids, and a row of ids for each."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, size)
        ids = self.first[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        who, width, never = np.arange(len(words)), size, len(self.becomes)
        pairs = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks = self.byte_rank.take(pairs)
        ranks[:, -1:] = self.last_rank.take(pairs[:, -1:])
        # Each step takes a pair from every word that still has one, so these stay of one width.
        while width > 1:
            at, rows = ranks.argmin(axis=1), np.arange(len(who))
            best = ranks[rows, at]
            live = best < never
            if not live.all():
                yield who[~live], ids[~live]
                who, ids, ranks, at, best = who[live], ids[live], ranks[live], at[live], best[live]
                rows = np.arange(len(who))
                if not len(who):
                    return
            ids[rows, at] = self.becomes_array[best]
            width -= 1
            ids = ids[np.arange(width + 1) != at[:, None] + 1].reshape(-1, width)
            if width == 1:
                break
            # Of the pairs, that at the place goes; its neighbours' ranks are new.
            ranks = ranks[np.arange(width) != at[:, None]].reshape(-1, width - 1)
            left, right = (at > 0).nonzero()[0], (at < width - 1).nonzero()[0]
            a = at[left]
            ranks[left, a - 1] = self._rank(ids[left, a - 1], ids[left, a])
            a = at[right]
            ranks[right, a] = self._rank(ids[right, a], ids[right, a + 1])
        yield who, ids

    def _merged(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
        """``merge`` of each of some pre-tokens, the short ones together by length: places, and a row of ids for each."""
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(map(len, words)):
            by_size.setdefault(n if self.whole and n <= SHORT else 0, []).append(i)
        for i in by_size.pop(0, ()):
            yield [i], np.array([self.merge(words[i]) if words[i] else []], dtype=np.int32)
        for size, own in by_size.items():
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                for places, ids in self._merge_alike([words[i] for i in some], size):
                    yield [some[k] for k in places.tolist()], ids

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of each of some pre-tokens."""
        out: list[list[int]] = [[]] * len(words)
        for places, ids in self._merged(words):
            for i, own in zip(places, ids.tolist()):
                out[i] = own
        return out

    def merge_bytes(self, words: list[bytes], dtype: str) -> list[bytes]:
        """``merge`` of each of some pre-tokens, as integers in bytes."""
        out = [b""] * len(words)
        for places, ids in self._merged(words):
            raw = ids.astype(dtype).tobytes()
            if step := len(raw) // len(places):
                for i, at in zip(places, range(0, len(raw), step)):
                    out[i] = raw[at : at + step]
        return out
