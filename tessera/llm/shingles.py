"""Words, shingles and their hashes, worked out over whole batches of texts with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.tobytes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed together up to so many bytes, which keeps the arrays in a core's cache; a longer text goes alone.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit moves about half of the output (murmur's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int, known: dict) -> np.ndarray:
    have = known.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        known[base] = have = np.multiply.accumulate(steps)
    return have[:n]


_KNOWN: dict = {}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of texts of up to ``most`` bytes together, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in a row, and each text's first word (with the end).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    """
    data = raw[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_P, n, _KNOWN) if n else sums[:0], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _powers(_P_INVERSE, n + 1, _KNOWN)[starts])
    return words, np.searchsorted(starts, at)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, and each text's first shingle (with the end).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    shingles = np.maximum(counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(counts)), shingles)
    place = np.arange(begin[-1]) - begin[owner] + first[owner]
    out = np.zeros(begin[-1], dtype=np.uint64)
    short = counts[owner] < size
    full = place[~short]
    acc = np.zeros(len(full), dtype=np.uint64)
    for k in range(size):
        acc += words[full + k] * _ORDER[k]
    out[~short] = acc
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[first[i] : first[i + 1]]
        length = np.full(1, len(own), dtype=np.uint64)
        out[begin[i]] = np.concatenate([own * _ORDER[: len(own)], length * _ORDER[63:]]).sum(dtype=np.uint64)
    return mix(out), begin


def sequence_digest(text: bytes) -> bytes:
    """16 bytes that stand for the whole word sequence of a text."""
    return hashlib.blake2b(b" ".join(text.translate(_LOWER_BYTES).split()), digest_size=16).digest()
