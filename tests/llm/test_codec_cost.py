"""The work of the token codec for an id, counted in calls rather than seconds."""

import random
import sys

import numpy as np
import pytest

from tessera.llm import token_codec as codec
from tessera.llm.merges import MergeList, pieces
from tessera.llm.tokens import tokenizer_path


def calls(work):
    """The result of ``work`` and how many functions it called."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = work()
    finally:
        sys.setprofile(None)
    return out, n


@pytest.mark.parametrize("ids", [(np.random.default_rng(3).zipf(1.3, 40 * codec.BLOCK) % 49408).astype("<u2"), np.tile(np.arange(700), 6 * 40)[: 40 * codec.BLOCK].astype("<u2")], ids=["zipf", "again"])
def test_calls_for_a_step(ids):
    (coded, crcs), there = calls(lambda: codec.encode_blocks(ids))
    blocks, back = calls(lambda: codec.decode_blocks(coded, [codec.BLOCK] * len(coded), crcs))
    assert (np.concatenate(blocks) == ids).all()
    # Two hundred and more each way where every decision was coded by itself.
    assert there < 130 * codec.BLOCK and back < 130 * codec.BLOCK


def test_blocks_of_all_kinds_in_one_segment():
    rng = np.random.default_rng(5)
    kinds = [np.zeros(codec.BLOCK), np.arange(codec.BLOCK) + 2**31, rng.integers(0, 2**32, codec.BLOCK), rng.integers(0, 3, codec.BLOCK), np.arange(codec.BLOCK)[::-1], np.arange(100)]
    ids = np.concatenate(kinds).astype("<u4")
    coded, crcs = codec.encode_blocks(ids)
    lengths = [min(codec.BLOCK, len(ids) - k * codec.BLOCK) for k in range(len(coded))]
    assert (np.concatenate(codec.decode_blocks(coded, lengths, crcs)) == ids).all()
    for k in range(len(coded)):
        assert (codec.decode_blocks([coded[k]], [lengths[k]], [crcs[k]])[0] == ids[k * codec.BLOCK :][: lengths[k]]).all()


def test_ids_as_bytes_are_ids_as_lists():
    merges, rng = MergeList(tokenizer_path("word_bpe_49k.json")), random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 60))).encode() for _ in range(2000)] + [b"a", b"", b"xy"]
    assert [np.frombuffer(x, "<u2").tolist() for x in merges.merge_bytes(words, "<u2")] == merges.merge_all(words)
    assert merges.merge_bytes([], "<u2") == []


def test_letters_alone_are_one_piece():
    import unicodedata

    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
    for c in map(chr, [*range(33, 0x3000), 0xAC00, 0x1F600]):
        for word in (c, f"a{c}b", f"{c}S"):
            if not any(map(str.isspace, word)):
                assert pieces(word) == pattern.findall("".join(map(str.lower, unicodedata.normalize("NFC", word)))), hex(ord(c))
