"""Token files coded by a context-mixing range coder, in blocks that stand alone.

A block starts from nothing. Its ids are numbered by their first appearance, and
three adaptive distributions are kept over these numbers: order 0, how often each
has come; order 1, the two numbers that came most after the last id; order 2, the
number that came after the last two. The candidates of orders 2 and 1 are tried
in turn: whether the next id is the candidate is a binary decision whose
probability mixes what the three orders say of that candidate with weights that
are learned as the block goes on. An id that is no candidate is coded by the
order-0 counts (the candidates taken out), or as new with its bits. Blocks are
coded in step, so that each model operation works on an array of blocks.

A file is a row of segments of a bounded number of ids, each with its own tables,
so writer and reader hold one segment. Segment: magic, u32 length of a JSON head,
head, document table, block table, CRC-32 of all so far, blocks. Each block has a
CRC-32 of its ids; with its table entry it decodes alone.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, written
from tessera.llm.tokens import texts_of, tokenizer_path, word_tokenizer

MAGIC = b"TCMX0003"
#: The id that ends each document.
END = 1
#: Ids of a block.
BLOCK = 4096
#: Blocks of a segment, which are worked on together; a block's model takes some 100 KB.
LANES = 2048
#: Places of a block's order-2 table, hashed; a power of two.
PLACES = 2 * BLOCK
#: The order-0 table is renewed from the counts every so many ids (and at the powers of two before); its sizes add up to TOTAL.
RENEWED, TOTAL_BITS = 256, 13
TOTAL = 1 << TOTAL_BITS
#: Probabilities of the candidates are parts of this many.
PARTS_BITS = 16
#: Rows of the order-0 table, each with an entry a lane: the numbers from 0 on, then the full size for what is coded already.
WIDTH = BLOCK + 2
_CODED = BLOCK + 1
_FULL, _LOW, _MASK = 1 << 48, 1 << 32, (1 << 32) - 1

# Logistic table in integers, so that coder and decoder agree on any machine.
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + 2.718281828459045 ** (-x / 256))))) for x in range(-2048, 2048)], dtype=np.int32)
_MIDDLE = np.int32(2048 << 8)
# An entry of a context: its guess in 13 bits, then how sure it is, up to 7.
_GUESS, _SURE_AT = (1 << 13) - 1, 13
# The sureness after a miss, by that before: a sure one is halved, another gives way to what came; and after a hit.
_DOUBTED = np.where(np.arange(8) > 2, np.arange(8) >> 1, 1)
_SURENESS = (np.concatenate([_DOUBTED, np.minimum(np.arange(8) + 1, 7)]) << _SURE_AT).astype(np.int32)
# Powers of two in an order-0 size.
_LOG = np.floor(np.log2(np.arange(TOTAL + 1) + 1)).astype(np.uint8)
# Runs of hits 0 to 32 in eight classes, and the run after a miss and after a hit; order 2's sureness in four.
_RUN8 = np.minimum(7, np.ceil(np.log2(np.arange(33) + 1)).astype(np.int64)) << 3
_NEXT_RUN = np.concatenate([np.minimum(np.arange(33) + 1, 32), np.minimum(np.arange(33) + 1, 32), np.arange(33) >> 2])
_CONF = np.minimum(np.arange(8), 3) << 1
_EIGHT = np.array([0, 8], dtype=np.int32)


class _Coder:
    """Range coder of many lanes: emits 16-bit words with carries, which are settled at the end."""

    def __init__(self, lanes: int):
        self.low, self.range, self.every = np.zeros(lanes, dtype=np.int64), np.full(lanes, _FULL), np.arange(lanes)
        self.words: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []

    def take(self, lanes: np.ndarray, start: np.ndarray, wide: np.ndarray) -> None:
        """Narrows each of ``lanes`` to the part of its range from ``start``, ``wide`` long; emits what is settled."""
        low = self.low.take(lanes) + start
        while len(short := (wide < _LOW).nonzero()[0]):
            own = low.take(short)
            self.words.append((own >> 32).astype(np.uint32))
            self.owners.append(lanes.take(short).astype(np.uint32))
            low[short] = (own & _MASK) << 16
            wide[short] <<= 16
        self.low[lanes] = low
        self.range[lanes] = wide

    def narrow(self, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows all lanes to ``size`` of their parts of width r from ``start``; ``settle`` has to follow."""
        self.low += r * start
        self.range = r * size

    def settle(self) -> None:
        while len(short := (self.range < _LOW).nonzero()[0]):
            own = self.low.take(short)
            self.words.append((own >> 32).astype(np.uint32))
            self.owners.append(short.astype(np.uint32))
            own &= _MASK
            own <<= 16
            self.low[short] = own
            self.range[short] = self.range.take(short) << 16

    def finish(self) -> list[bytes]:
        lanes = len(self.low)
        for _ in range(3):
            self.words.append((self.low >> 32).astype(np.uint32))
            self.owners.append(self.every)
            self.low = (self.low & _MASK) << 16
        # Integers of 16 bits are put in order by radix.
        owners = np.concatenate(self.owners).astype(np.uint16 if lanes <= 1 << 16 else np.uint32)
        words = np.concatenate(self.words)[np.argsort(owners, kind="stable")]
        while len(over := np.flatnonzero(words > 0xFFFF)):
            words[over] &= 0xFFFF
            words[over - 1] += 1
        ends = np.cumsum(np.bincount(owners, minlength=lanes)).tolist()
        raw = words.astype("<u2")
        return [raw[a:b].tobytes() for a, b in zip([0, *ends], ends)]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) // 2 for b in blocks])
        self.words = np.frombuffer(b"".join(blocks) + bytes(16), dtype="<u2")
        self.at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.range = np.full(len(blocks), _FULL)
        self.code = np.zeros(len(blocks), dtype=np.int64)
        for _ in range(3):
            self.code = self.code << 16 | self.words[self.at]
            self.at += 1

    def target(self, lanes: np.ndarray | None, r: np.ndarray, last: np.ndarray | int) -> np.ndarray:
        """The part of width r where the code of each of ``lanes`` (None: all) lies, ``last`` at most."""
        return np.minimum((self.code if lanes is None else self.code.take(lanes)) // r, last)

    def take(self, lanes: np.ndarray, start: np.ndarray, wide: np.ndarray) -> None:
        code = self.code.take(lanes) - start
        while len(short := (wide < _LOW).nonzero()[0]):
            own = lanes.take(short)
            at = self.at.take(own)
            code[short] = code.take(short) << 16 | self.words.take(at)
            self.at[own] = at + 1
            wide[short] <<= 16
        self.code[lanes] = code
        self.range[lanes] = wide

    def narrow(self, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= r * start
        self.range = r * size

    def settle(self) -> None:
        while len(short := (self.range < _LOW).nonzero()[0]):
            at = self.at.take(short)
            self.code[short] = self.code.take(short) << 16 | self.words.take(at)
            self.at[short] = at + 1
            self.range[short] = self.range.take(short) << 16


def _symbol(coder, lanes: np.ndarray, cumulative: np.ndarray, symbol: np.ndarray | None) -> np.ndarray:
    """Codes, or decodes where None, one of the columns of ``cumulative`` counts (a row for each of lanes)."""
    total = cumulative[:, -1]
    r = coder.range[lanes] // total
    if symbol is None:
        symbol = (cumulative <= coder.target(lanes, r, total - 1)[:, None]).sum(axis=1)
    rows = np.arange(len(lanes))
    end = cumulative[rows, symbol]
    start = np.where(symbol > 0, cumulative[rows, symbol - 1], 0)
    coder.take(lanes, r * start, r * (end - start))
    return symbol


def _plain(coder, lanes: np.ndarray, total: np.ndarray, value: np.ndarray | None) -> np.ndarray:
    """Codes, or decodes where None, values below ``total`` (up to 65536), all alike likely."""
    r = coder.range[lanes] // total
    if value is None:
        value = coder.target(lanes, r, total - 1)
    coder.take(lanes, r * value, r)
    return value


def _spread(counts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts (symbols, lanes), of which ``symbols`` a lane are not 0: sizes that add up to TOTAL in each lane, and their starts."""
    scale = ((TOTAL - symbols << 16) // counts.sum(axis=0)).astype(np.int32)
    size = (counts * scale >> 16) + (counts > 0)
    size[0] += TOTAL - size.sum(axis=0, dtype=np.int32)
    return size, np.cumsum(size, axis=0, dtype=np.int32) - size


def _logits(p: np.ndarray) -> np.ndarray:
    return (np.log(p / (1 - p)) * 65536).astype(np.int32)


class _Decisions:
    """Whether a candidate comes next: what the three orders say of it is added up as learned log-odds.

    Each lane has two decisions, that on the first candidate and that on the second if
    the first fails; arrays hold the first decisions of all lanes, then the second.
    """

    def __init__(self, lanes: int):
        state = np.arange(64)
        run, conf, agree = state >> 3, state >> 1 & 3, state & 1
        by2 = _logits(np.clip(0.06 + 0.1 * run + 0.06 * conf + 0.1 * agree, 0.03, 0.93))
        self.by2 = np.tile(by2, lanes * 2)
        self.by1 = np.zeros(lanes * 2 * 16, dtype=np.int32)
        self.by0 = np.zeros(lanes * 2 * 16, dtype=np.int32)
        row = np.arange(lanes)
        self.row2 = np.concatenate([row * 64, (row + lanes) * 64])
        self.row = np.concatenate([row * 16, (row + lanes) * 16])

    def expect(self, s2: np.ndarray, s1: np.ndarray, s0: np.ndarray) -> np.ndarray:
        """Probabilities of 4096 that the candidates come, in the states that the orders are in."""
        self.j2, self.j1, self.j0 = self.row2 + s2, self.row + s1, self.row + s0
        self.w2, self.w1, self.w0 = self.by2.take(self.j2), self.by1.take(self.j1), self.by0.take(self.j0)
        total = self.w2 + self.w1
        total += self.w0
        total += _MIDDLE
        total >>= 8
        return _SQUASH.take(total, mode="clip")

    def learn(self, error: np.ndarray, made: np.ndarray) -> None:
        """Moves the log-odds of the decisions that were ``made`` (1 or 0) towards what came."""
        # Each log-odds stays within 2**20 or one step more, so the sum is within the table or clipped to its ends.
        self.by2[self.j2] = self.w2 + (error - (self.w2 >> 10)) * made
        error >>= 1
        self.by1[self.j1] = self.w1 + (error - (self.w1 >> 10)) * made
        self.by0[self.j0] = self.w0 + (error - (self.w0 >> 10)) * made


def _learned(guess: np.ndarray, sure: np.ndarray, came: np.ndarray) -> np.ndarray:
    """The entries of contexts after ``came``: a guess that holds grows surer; one that fails is halved, then replaced."""
    held = guess == came
    new = np.where(held | (sure > 2), guess, came)
    new |= _SURENESS.take(sure + 8 * held)
    return new.astype(np.uint16)


def _numbers(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each row of ids (lanes, steps), the numbers by first appearance, from 1 on, and the ids in this order."""
    out, own = np.empty(ids.shape, dtype=np.int16), []
    place = np.arange(ids.shape[1])
    first_at = np.zeros(int(ids.max(initial=0)) + 1 if ids.max(initial=0) < 1 << 17 else 0, dtype=np.int64)
    for k, row in enumerate(ids):
        if len(first_at):
            # Of places that are written twice the last stays, which here is the first.
            first_at[row[::-1]] = place[::-1]
            first = first_at.take(row)
        else:
            _, at, which = np.unique(row, return_index=True, return_inverse=True)
            first = at[which]
        new = first == place
        out[k] = np.cumsum(new).take(first)
        own.append(row[new])
    return out, own


def _literals(coder, lanes: int, own: list[np.ndarray] | None) -> list[np.ndarray]:
    """Codes, or decodes where None, the ids of each block in the order of their first appearance."""
    every = np.arange(lanes)
    many = _plain(coder, every, np.full(lanes, 2 * BLOCK), None if own is None else np.array([len(x) for x in own]))
    most = int(many.max(initial=0))
    grid = np.zeros((most, lanes), dtype=np.int64)
    for k, x in enumerate(own or ()):
        grid[: len(x), k] = x
    # An id's number of bits, by its counts; the bits after the first are plain.
    classes = np.ones((lanes, 33), dtype=np.int64)
    for t in range(most):
        active = (many > t).nonzero()[0]
        ids = None if own is None else grid[t].take(active)
        size = None if ids is None else np.where(ids > 0, np.floor(np.log2(np.maximum(ids, 1))).astype(np.int64) + 1, 0)
        size = _symbol(coder, active, np.cumsum(classes[active], axis=1), size)
        classes[active, size] += 8
        bits = np.maximum(size - 1, 0)
        top = np.where(size > 0, np.int64(1) << bits, 0)
        rest = None if ids is None else ids - top
        upper = np.int64(0)
        if (bits > 16).any():
            upper = _plain(coder, active, np.int64(1) << np.maximum(bits - 16, 0), None if rest is None else rest >> 16)
        grid[t, active] = top + (upper << 16) + _plain(coder, active, np.int64(1) << np.minimum(bits, 16), None if rest is None else rest & 0xFFFF)
    return [grid[:n, k] for k, n in enumerate(many.tolist())]


def _outside(coder, lanes: np.ndarray, given: np.ndarray, share: np.ndarray, number: np.ndarray | None) -> np.ndarray:
    """Codes, or decodes where None, ids outside the order-0 table: one of the numbers ``given`` since, or 0 for the next new one.

    ``share`` has each block's probability, of 4096, of the former; it is learned.
    """
    own = share.take(lanes)
    p = own * (given > 0)
    r = coder.range.take(lanes) >> 12
    new, many = r * (4096 - p), np.maximum(given, 1)
    each = r * p // many
    if number is None:
        beyond = coder.code.take(lanes) - new
        number = np.where(beyond < 0, 0, np.minimum(beyond // np.maximum(each, 1), many - 1) + 1)
    is_new = number == 0
    coder.take(lanes, np.where(is_new, 0, new + each * (number - 1)), np.where(is_new, new, each))
    # So the probability stays from 15 to 4081.
    learned = own + np.where(is_new, -(own >> 4), 4096 - own >> 4)
    share[lanes] = np.where(given > 0, learned, own)
    return number


def _run(coder, lanes: int, ids: np.ndarray | None) -> np.ndarray:
    """Codes ``ids`` (lanes, BLOCK), or decodes them where None: the model is the same."""
    numbers, own = (None, None) if ids is None else _numbers(ids)
    own = _literals(coder, lanes, own)
    steps = np.empty((BLOCK, lanes), dtype=np.int16)
    if numbers is not None:
        steps[:] = numbers.T
    every = np.arange(lanes)
    both, place_row = np.tile(every, 2), every * TOTAL
    # Counts of the numbers, a row for each; 0 stands for ids outside the table. Tables have rows for numbers too:
    # lanes mostly work on low ones, so what they need lies together.
    counts, outside = np.zeros((WIDTH, lanes), dtype=np.int32), np.ones(lanes, dtype=np.int32)
    # Order 0: a number's start and size in one, and the size's logarithm.
    table, logs = np.zeros(lanes * WIDTH, dtype=np.int32), np.zeros(lanes * WIDTH, dtype=np.uint8)
    table[_CODED * lanes : (_CODED + 1) * lanes] = TOTAL
    # Entries of order 1, then those of order 2.
    contexts = np.zeros(lanes * (BLOCK + 1 + PLACES), dtype=np.uint16)
    row2 = lanes * (BLOCK + 1) + every * PLACES
    decisions = _Decisions(lanes)
    share = np.full(lanes, 2048, dtype=np.int64)
    seen, before_table = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    run = np.zeros(lanes, dtype=np.int64)
    last, hashed, last_at = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64), every
    edges = np.zeros((4, lanes), dtype=np.int64)
    edges[3] = 1 << PARTS_BITS
    start_of, end_of = edges.reshape(-1), edges.reshape(-1)[lanes:]
    i, asked = np.empty(2 * lanes, dtype=np.int64), np.empty(2 * lanes, dtype=np.int64)
    s2, s1 = np.empty(2 * lanes, dtype=np.int64), np.empty(2 * lanes, dtype=np.int64)
    came, made = np.empty(2 * lanes, dtype=np.int32), np.ones(2 * lanes, dtype=np.int32)
    hits = np.zeros(2 * lanes, dtype=np.int32)
    counted, place = 0, np.zeros(0, dtype=np.int16)
    for t in range(BLOCK):
        if t % RENEWED == 0 or (t < RENEWED and t & (t - 1) == 0):
            # The counts so far become the table.
            wide = int(seen.max(initial=0)) + 1
            if t > counted:
                at = steps[counted:t] * np.int64(lanes)
                at += every
                counts[:wide] += np.bincount(at.ravel(), minlength=lanes * wide).reshape(wide, lanes)
                counted = t
            counts[0] = outside
            own_size, own_start = _spread(counts[:wide], seen + 1)
            table[: wide * lanes] = (own_start << 16 | own_size).ravel()
            logs[: wide * lanes] = _LOG.take(own_size).ravel()
            before_table = seen.copy()
            if ids is None:
                place = np.repeat(np.tile(np.arange(wide, dtype=np.int16), lanes), own_size.T.ravel())
        i[:lanes] = last_at
        mixed = last * 40503
        hashed += mixed
        hashed >>= 3
        hashed &= PLACES - 1
        np.add(row2, hashed, out=i[lanes:])
        entry = contexts.take(i).astype(np.int32)
        guess, sure = entry & _GUESS, entry >> _SURE_AT
        a, c, sure1 = guess[:lanes], guess[lanes:], sure[:lanes]
        # The candidate of order 2, or that of order 1 where there is none; then that of order 1, if it is another.
        first = c + a * (c == 0)
        agree = first == a
        other = (a > 0) > agree
        state = _RUN8.take(run)
        state += _CONF.take(sure[lanes:])
        state += agree
        s2[:lanes] = s2[lanes:] = state
        np.add(sure1, _EIGHT.take(agree), out=s1[:lanes])
        s1[lanes:] = sure1
        asked[:lanes], asked[lanes:] = first, a
        asked *= lanes
        asked += both
        p = decisions.expect(s2, s1, logs.take(asked))
        # What the first leaves is shared by the second and all else; each has a part at least.
        np.left_shift(p[:lanes], PARTS_BITS - 12, out=edges[1])
        second = ((1 << PARTS_BITS) - edges[1]) * p[lanes:] >> 12
        second |= 1
        second *= other
        np.add(edges[1], second, out=edges[2])
        r = coder.range >> PARTS_BITS
        if ids is None:
            part = coder.target(None, r, (1 << PARTS_BITS) - 1)
            which = (part >= edges[1]).astype(np.int64)
            which += part >= edges[2]
        else:
            now = steps[t].astype(np.int64)
            missed = now != first
            which = missed.astype(np.int64)
            which += missed & ~(other & (now == a))
        at = which * lanes
        at += every
        start = start_of.take(at)
        coder.narrow(r, start, end_of.take(at) - start)
        # Order 0; what is not in its table is a number given since then, or an id new to the block.
        r = coder.range >> TOTAL_BITS
        open_ = which == 2
        if ids is None:
            x = place.take(place_row + coder.target(None, r, TOTAL - 1)).astype(np.int64)
        else:
            x = now * (now <= before_table)
        symbol = np.where(open_, x, _CODED)
        symbol *= lanes
        symbol += every
        symbol = table.take(symbol).astype(np.int64)
        coder.narrow(r, symbol >> 16, symbol & 0xFFFF)
        coder.settle()
        if ids is None:
            now = np.where(open_, x, np.where(which == 0, first, a))
        new = (open_ & (x == 0)).nonzero()[0]
        if len(new):
            outside[new] += 1
            old, so_far = before_table.take(new), seen.take(new)
            found = None
            if ids is not None:
                found = now.take(new) - old
                found[found > so_far - old] = 0
            found = _outside(coder, new, so_far - old, share, found)
            fresh = new[found == 0]
            seen[fresh] += 1
            if ids is None:
                now[new] = np.where(found > 0, old + found, so_far + 1)
        steps[t] = now
        hits[:lanes] = which == 0
        hits[lanes:] = which == 1
        np.logical_and(other, which, out=made[lanes:], casting="unsafe")
        decisions.learn((hits << 12) - p, made)
        came[:lanes] = came[lanes:] = now
        contexts[i] = _learned(guess, sure, came)
        run = _NEXT_RUN.take(run + 33 * which)
        hashed, last, last_at = last * 60493, now, now * lanes + every
    if ids is not None:
        return ids
    out = np.empty((lanes, BLOCK), dtype="<u4")
    for k, x in enumerate(own):
        out[k] = x.astype("<u4")[steps[:, k] - 1]
    return out


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """The coded blocks of ``ids`` and the checksums of their ids; the last block is filled up with zeros."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return [], []
    padded = np.zeros(n * BLOCK, dtype=ids.dtype)
    padded[: len(ids)] = ids
    coder = _Coder(n)
    _run(coder, n, padded.reshape(n, BLOCK))
    return coder.finish(), [zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()) for at in range(0, len(ids), BLOCK)]


def decode_blocks(coded: list[bytes], lengths: list[int], crcs: list[int]) -> list[np.ndarray]:
    """The ids of some blocks; raises where a checksum differs."""
    if not coded:
        return []
    grid = _run(_Decoder(coded), len(coded), None)
    out = [ids[:n] for ids, n in zip(grid, lengths)]
    for ids, crc in zip(out, crcs):
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum differs")
    return out


def encode_segment(ids: np.ndarray, docs: list[tuple[int | None, int, bool]]) -> bytes:
    """A segment of ``ids``; docs: each document's id, its number of ids here, and whether it goes on in the next."""
    coded, crcs = encode_blocks(ids)
    known = np.array([d is not None for d, _, _ in docs], dtype=bool)
    numbers = np.array([d or 0 for d, _, _ in docs], dtype="<i8")
    more = np.array([m for _, _, m in docs], dtype=bool)
    with np.errstate(over="ignore"):
        steps = np.diff(numbers, prepend=np.int64(0)).astype("<i8")
    parts = [
        zlib.compress(
            steps.tobytes() + np.array([k for _, k, _ in docs], dtype="<i8").tobytes() + np.packbits(known).tobytes() + np.packbits(more).tobytes()
        ),
        zlib.compress(np.array([[len(c), x] for c, x in zip(coded, crcs)], dtype="<u4").tobytes()),
    ]
    head = json.dumps({"ids": len(ids), "docs": len(docs), "block": BLOCK, "parts": [len(p) for p in parts], "bytes": sum(map(len, coded))}).encode()
    head = MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)
    return head + zlib.crc32(head).to_bytes(4, "little") + b"".join(coded)


class Segment:
    """The tables of the segment that begins at the file's place; its blocks are read when asked for."""

    def __init__(self, f):
        begin = f.read(12)
        if begin[:8] != MAGIC:
            raise ValueError("not a token file")
        head = f.read(int.from_bytes(begin[8:], "little"))
        self.f, self.head = f, json.loads(head)
        if self.head["block"] != BLOCK:
            raise ValueError("blocks of another size")
        parts = [f.read(n) for n in self.head["parts"]]
        if zlib.crc32(b"".join([begin, head, *parts])) != int.from_bytes(f.read(4), "little"):
            raise ValueError("the head's checksum differs")
        n = self.head["docs"]
        listed = zlib.decompress(parts[0])
        numbers = np.cumsum(np.frombuffer(listed[: 8 * n], dtype="<i8")).tolist()
        sizes = np.frombuffer(listed[8 * n : 16 * n], dtype="<i8").tolist()
        bits = np.frombuffer(listed[16 * n :], dtype=np.uint8)
        known, more = (np.unpackbits(x, count=n).astype(bool).tolist() for x in (bits[: -(-n // 8)], bits[-(-n // 8) :]))
        self.docs = [(d if k else None, s, m) for d, s, k, m in zip(numbers, sizes, known, more)]
        table = np.frombuffer(zlib.decompress(parts[1]), dtype="<u4").reshape(-1, 2)
        self.sizes, self.crcs = table[:, 0].tolist(), table[:, 1].tolist()
        self.begin = f.tell()
        self.end = self.begin + self.head["bytes"]

    def _length(self, k: int) -> int:
        return min(BLOCK, self.head["ids"] - k * BLOCK)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        self.f.seek(self.begin + sum(self.sizes[:k]))
        return decode_blocks([self.f.read(self.sizes[k])], [self._length(k)], [self.crcs[k]])[0]

    def ids(self) -> np.ndarray:
        """All ids of the segment."""
        self.f.seek(self.begin)
        coded = [self.f.read(n) for n in self.sizes]
        found = decode_blocks(coded, [self._length(k) for k in range(len(coded))], self.crcs)
        return np.concatenate(found) if found else np.zeros(0, dtype="<u4")


def segments_of(ids: Iterator[tuple[int | None, np.ndarray]], most: int = LANES * BLOCK) -> Iterator[bytes]:
    """Segments of documents (id, ids); one that runs over a segment's end goes on in the next."""
    docs: list[tuple[int | None, int, bool]] = []
    held: list[np.ndarray] = []
    filled = 0
    for doc, own in ids:
        while True:
            piece = own[: most - filled]
            own = own[len(piece) :]
            docs.append((doc, len(piece), len(own) > 0))
            held.append(piece)
            filled += len(piece)
            if filled == most:
                yield encode_segment(np.concatenate(held), docs)
                docs, held, filled = [], [], 0
            if not len(own):
                break
    if docs:
        yield encode_segment(np.concatenate(held), docs)


def read_documents(f, size: int) -> Iterator[tuple[int | None, int, int]]:
    """(id, number of ids, CRC-32 of the ids) of a file's documents, a segment in memory at a time."""
    total = crc = 0
    f.seek(0)
    while f.tell() < size:
        segment = Segment(f)
        ids, at = segment.ids(), 0
        for doc, n, more in segment.docs:
            crc = zlib.crc32(ids[at : at + n].tobytes(), crc)
            total, at = total + n, at + n
            if not more:
                yield doc, total, crc
                total = crc = 0
        f.seek(segment.end)


def open_folder(uri: str):
    """Arrow's file system of a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, pieces: Iterator[bytes]) -> str:
    """Writes a file under another name and moves it, so that a task run twice leaves one whole file."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(own) as f:
        for p in pieces:
            f.write(p)
    system.move(own, f"{path}/{name}")
    return name


def _write(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path(vocabulary))
        end = np.array([END], dtype=tokenizer.dtype).tobytes()
        docs = total = 0

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            nonlocal docs, total
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    for doc, own in zip(part.column(0).to_pylist(), tokenizer.encode_all(list(texts_of(part.column(1))))):
                        ids = np.frombuffer(own + end, dtype=tokenizer.dtype)
                        docs, total = docs + 1, total + len(ids)
                        yield doc, ids

        part = TaskContext.get().partitionId()
        name = put_file(folder, f"part-{part:06d}.tok", segments_of(encoded()))
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "ids": [total], "docs": [docs]})

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["base"].to_pylist()):
                system, path = open_folder(folder)
                size = system.get_file_info(f"{path}/{name}").size
                with system.open_input_file(f"{path}/{name}") as f:
                    rows: list[tuple] = []
                    for doc, n, crc in read_documents(f, size):
                        rows.append((doc, start, n, crc))
                        start += n
                        if len(rows) >= 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> tuple[str, DataFrame]:
    """Token files of ``docs`` in ascending order of id; their folder, and a row for each file: part, name, ids, docs."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    # The hash deals rows that share an id to several ranges.
    source = docs.select(docs[id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return folder, written(ordered.mapInArrow(_write(folder, vocabulary), "part long, name string, ids long, docs long"))


def token_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Writes ``docs`` as token files and reads them back: doc_id, start, n_tokens, ids_crc32 for each row.

    A null text, like an empty one, is the end id alone; null ids come first;
    rows with one id follow each other in an order that their texts alone set,
    and rows that repeat are each written. A text of any length is coded whole:
    it runs over as many blocks and segments as it needs. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    folder, files = write_token_files(docs, vocabulary)
    # A row for each file: few enough for one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("name", "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    dealt = based.select("name", "base").repartition(max(1, files.count()))
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
