"""Token ids of whole texts, the same as the tokenizers library gives.

Under a vocabulary with word ends a text's ids are those of its words in a row;
words come again and again, and each worker keeps the ids of those it has seen.
A byte-level vocabulary goes by its public rank file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from tessera.llm.merges import MergeList, pieces

#: Words that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 1_200_000
#: Only words of up to so many characters are remembered.
LONGEST = 64

# What Python takes as white space and the library doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# A full stop or comma that ends a word: a boundary of the pre-tokenizer (the dotted capital I becomes a letter and a mark).
_STOP = re.compile(r"\.(?<=[^\W_\u0130]\.)(?=\s|$)")
_COMMA = re.compile(r",(?<=[^\W_\u0130],)(?=\s|$)")
_SPACES = re.compile(r"\s\s")
_OTHER_LETTER = re.compile("[\u0130\u0250-\U0010ffff]")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, found where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_words(text: str) -> list[str]:
    """Words of a text for a vocabulary in lower case that drops white space; marks that end a word stand alone."""
    # Letters that have one lower-case form, which the vocabulary's normaliser takes as well.
    if not _OTHER_LETTER.search(text):
        text = text.lower()
    return _COMMA.sub(" ,", _STOP.sub(" .", text)).split()


class WordTokenizer:
    """Ids of texts under a vocabulary with word ends, word by word, as little-endian integers in bytes.

    Texts that hold the string of an added token, or white space that Python
    alone takes for such, go to the library whole.
    """

    def __init__(self, path: str):
        self.library, self.special, self.dtype = _library(path)
        self.merges = MergeList(path)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; words that the worker has not seen are merged together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        whole = [bool(_ODD_SPACE.search(t)) or any(s in t for s in self.special) for t in texts]
        cut = [[] if w else plain_words(t) for t, w in zip(texts, whole)]
        new = list(set(chain.from_iterable(cut)).difference(known))
        if new:
            own = list(map(pieces, new))
            every = list(set(chain.from_iterable(own)))
            ids = dict(zip(every, self.merges.merge_bytes([p.encode() for p in every], self.dtype)))
            known.update((w, ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x])) for w, x in zip(new, own))
        out = [
            np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes() if w else b"".join(map(known.__getitem__, words))
            for t, w, words in zip(texts, whole, cut)
        ]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out


class RankTokenizer:
    """Ids of texts under a byte-level vocabulary, from a public file of the same vocabulary as ranks.

    The ids are those of the tokenizers library, several times as fast; a text
    that holds the string of an added token, and all texts without ``ranks``, go
    to the library.
    """

    def __init__(self, path: str, ranks: str | None):
        self.library, self.special, self.dtype = _library(path)
        self.fast, self.single = _by_ranks(ranks) if ranks else (None, None)

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.fast if _SPACES.search(text) else self.single)(text)
        return np.array(ids, dtype=self.dtype).tobytes()


def id_type(size: int) -> str:
    """The integers that hold ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return max([library.get_vocab_size(), *[i + 1 for i in library.get_added_tokens_decoder()]])


def _library(path: str):
    """The library's tokenizer without padding and truncation, the strings of its added tokens, and its ids' type."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library, [t.content for t in library.get_added_tokens_decoder().values()], id_type(vocabulary_size(path))


def _by_ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = {"mergeable_ranks": ranks, "special_tokens": {}}
    # The look-ahead only matters to white space of two characters or more; without it, matching is faster.
    single = tiktoken.Encoding("single", pat_str=public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""), **own)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, **own).encode_ordinary, single.encode_ordinary


_LOADED: dict[tuple, WordTokenizer | RankTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """A worker's tokenizer for a vocabulary with word ends; kept between its tasks."""
    if (path,) not in _LOADED:
        _LOADED[path,] = WordTokenizer(path)
    return _LOADED[path,]


def rank_tokenizer(path: str, ranks: str | None) -> RankTokenizer:
    """A worker's tokenizer for a byte-level vocabulary; kept between its tasks."""
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = RankTokenizer(path, ranks)
    return _LOADED[path, ranks]


def texts_of(column) -> Iterator[str]:
    """A string column's texts; nulls are empty."""
    return ((x.as_py() or "") for x in column)
