import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tessera.llm import token_codec as codec
from tessera.llm.bpe_lexicon import LexiconTokenizer, Transducer, bpe_report, compile_lexicon, frequent_words
from tessera.llm.merges import MergeList
from tessera.llm.packing import WINDOW, Shard, pack_documents
from tessera.llm.token_codec import token_files
from tessera.llm.tokens import RankTokenizer, WordTokenizer, tokenizer_path
from tessera.llm.warc_zip import PackageReader, PackageWriter, package_report, parse_record, warc_record

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = [
    "", "  a  b\n c", "x\x1cy z", "don't  stop\t now \n\n ok", "<|endoftext|> hi", "İstanbul. ΣΑΣ ǅ", "é ́x", " lead", "trail  ", "日本語 テキスト　x",
    "a.b, c!? 3.14 100,000", "\n\n", "'s 't 're", "a\x85 b", "﻿x y", "a​ b", "<|startoftext|>a b<|endoftext|>", "a\x00b", "½ ² ⅷ", "¶ a", "x..., y.",
]
ALPHABET = ["a", "B", "é", "É", " ", "  ", "\n", ".", ",", "'", "s", "3", "_", "ß", "ẞ", "İ", "ǅ", "σ", "Σ", "中", "\x00", "\x85", "́", "-", "\t", "¶", "...", "x."]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


LONG_RUNS = ["a" * 20_000, "ab1-" * 5_000, " " * 9_000 + "x", "\n" * 5_000, "中文" * 3_000, "x" * 41 + " " + "é" * 30]


@pytest.mark.parametrize("tokenizer, path", [
    (WordTokenizer(WORD), WORD), (RankTokenizer(BYTE, None), BYTE), (RankTokenizer(BYTE, tokenizer_path("byte_bpe_50k.tiktoken")), BYTE),
], ids=["words", "library", "ranks"])
def test_tokenizers_give_the_librarys_ids(tokenizer, path):
    texts = fuzz(3000, 1) + LONG_RUNS
    assert [np.frombuffer(tokenizer.encode(t), "<u2").tolist() for t in texts] == library(path, texts)


def test_ranks_and_library_agree_on_characters():
    tokenizer, rng = RankTokenizer(BYTE, tokenizer_path("byte_bpe_50k.tiktoken")), random.Random(6)
    points = [*range(1, 0x3000), *rng.sample([c for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000], 20_000)]
    texts = ["\n".join(f"a{chr(c)}1{chr(c)} {chr(c)}-" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert [np.frombuffer(tokenizer.encode(t), "<u2").tolist() for t in texts] == library(BYTE, texts)


def test_merging_together_is_merging_alone():
    merges, rng = MergeList(WORD), random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 60))).encode() for _ in range(2000)] + ["日本é".encode(), b"a", b""]

    def plain(word):
        ids = [merges.inner[b] for b in word[:-1]] + [merges.last[b] for b in word[-1:]]
        while ranked := [(merges.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges.ranks]:
            rank, i = min(ranked)
            ids[i : i + 2] = [merges.becomes[rank]]
        return ids

    truth = [plain(w) for w in words]
    assert [list(map(int, x)) for x in merges.merge_all(words)] == truth
    assert [merges.merge(w) for w in words if w] == [x for w, x in zip(words, truth) if w]


def test_lexicon_tokenizer_is_the_library(tmp_path):
    merges = MergeList(WORD)
    words = [w.encode() for w in "the of and a in to tion ing reading readings reader nation ration é 日本 , . 3".split()]
    (tmp_path / "x").write_bytes(compile_lexicon({w: merges.merge(w) for w in words}))
    texts, own = fuzz(3000, 2) + ["The reading of a Nation, and readings."], Tokenizer.from_file(WORD)
    for tokenizer in (LexiconTokenizer(WORD, str(tmp_path / "x")), LexiconTokenizer(WORD, None)):
        for text, ids in zip(texts, library(WORD, texts)):
            n, joined, decoded = tokenizer.forms(text)
            assert (n, joined, decoded) == (len(ids), " ".join(map(str, ids)), own.decode(ids, skip_special_tokens=False)), text


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): [i, i + 1][: i % 3] for i in range(500)}
    (tmp_path / "x").write_bytes(compile_lexicon(words))
    t = Transducer(str(tmp_path / "x"))
    asked = list(words) + [bytes(rng.choices(b"abcd", k=rng.randint(0, 8))) for _ in range(500)]
    assert t.look_up(asked) == [words.get(w) for w in asked]
    # The states of a minimal automaton are the different sets of endings.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    endings = {p: frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(t.final) == len(set(endings.values()))
    (tmp_path / "y").write_bytes(compile_lexicon({}))
    assert Transducer(str(tmp_path / "y")).look_up([b"a", b""]) == [None, None]


def test_bpe_report(edge_docs, no_docs):
    own = Tokenizer.from_file(WORD)
    texts = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    truth = [(i, len(x), sha(" ".join(map(str, x))), sha(own.decode(x, skip_special_tokens=False))) for (i, _), x in zip(texts, library(WORD, [t for _, t in texts]))]
    assert sorted(map(repr, map(tuple, bpe_report(edge_docs, size=50).collect()))) == sorted(map(repr, truth))
    assert bpe_report(no_docs).count() == 0


def read_back(raw):
    return list(codec.read_documents(io.BytesIO(raw), len(raw)))


def written_segments(docs, most):
    return list(codec.segments_of(iter(docs), most))


@pytest.mark.parametrize("ids", [
    np.zeros(0, np.uint32), np.array([1], np.uint32), np.full(3000, 7, np.uint32), np.arange(20000).astype(np.uint32),
    np.random.default_rng(1).integers(0, 49408, 5000).astype(np.uint32), (np.random.default_rng(2).zipf(1.3, 20000) % 49408).astype(np.uint32),
    np.tile(np.array([5, 9, 65535, 65536, 2**32 - 1, 0], np.uint32), 2000),
], ids=range(7))
def test_codec_round_trip(ids):
    cuts = [0, len(ids) // 3, len(ids) // 3, len(ids)]
    docs = [(name, ids[a:b]) for name, a, b in zip((None, -5, 2**62), cuts, cuts[1:])]
    truth = [(name, len(x), zlib.crc32(x.astype("<u4").tobytes())) for name, x in docs]
    # One segment, and segments that cut the documents.
    for most in (codec.LANES * codec.BLOCK, codec.BLOCK + 100):
        assert read_back(b"".join(written_segments(docs, most))) == truth


def zipf_text(n, seed):
    """Ids in which what comes next depends on the last two, with noise."""
    rng = np.random.default_rng(seed)
    out = [1, 2]
    noise = (rng.zipf(1.4, n) % 3000).tolist()
    for x, u in zip(noise, rng.random(n).tolist()):
        out.append((out[-1] * 7 + out[-2] * 3) % 50 + 10 if u < 0.4 else x)
    return np.array(out, np.uint32)


def test_codec_beats_order_0_and_zstandard():
    ids = zipf_text(8 * codec.BLOCK, 2)[: 8 * codec.BLOCK]
    size = sum(map(len, written_segments([(1, ids)], codec.LANES * codec.BLOCK)))
    order0 = blocks = 0.0
    for at in range(0, len(ids), codec.BLOCK):
        own = ids[at : at + codec.BLOCK]
        blocks += len(zstandard.compress(own.astype("<u2").tobytes(), 9))
        # Adaptive order 0: counts so far, an unseen id by 16 bits.
        seen, total = {}, 0
        for x in own.tolist():
            n = seen.get(x, 0)
            order0 -= np.log2(n / (total + len(seen) + 1)) if n else np.log2((len(seen) + 1) / (total + len(seen) + 1) / 65536)
            seen[x], total = n + 1, total + 1
    assert size < blocks and size < order0 / 8


def test_a_block_decodes_alone():
    ids = zipf_text(3 * codec.BLOCK + 77, 3)
    raw = b"".join(written_segments([(1, ids)], codec.LANES * codec.BLOCK))
    segment = codec.Segment(io.BytesIO(raw))
    for k in (2, 0, 3):
        assert (segment.block(k) == ids[k * codec.BLOCK : (k + 1) * codec.BLOCK]).all()
    # Nothing of another block is read: they may be lost.
    torn = bytearray(raw)
    torn[segment.begin : segment.begin + segment.sizes[0]] = bytes(segment.sizes[0])
    assert (codec.Segment(io.BytesIO(bytes(torn))).block(1) == ids[codec.BLOCK : 2 * codec.BLOCK]).all()


def test_codec_sees_damage():
    ids = (np.random.default_rng(2).zipf(1.3, 12000) % 49408).astype(np.uint32)
    raw = b"".join(written_segments([(1, ids)], codec.LANES * codec.BLOCK))
    for at in (20, len(raw) // 2, len(raw) - 40):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises(Exception):
            read_back(bytes(bad))


def test_token_files(edge_docs, no_docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in edge_docs.collect()), key=lambda x: x[:3])
    at, truth = 0, []
    for (_, _, _, i), ids in zip(rows, library(WORD, [r[2] for r in rows])):
        truth.append((i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        at += len(ids) + 1
    found = sorted(map(tuple, token_files(edge_docs).collect()), key=lambda r: r[1])
    # Rows without an id, or with one id, may come in either order.
    assert sorted((repr(i), n, c) for i, _, n, c in found) == sorted((repr(i), n, c) for i, _, n, c in truth)
    ends = [0, *np.cumsum([r[2] for r in found]).tolist()]
    assert [r[1] for r in found] == ends[:-1] and [r[0] for r in found if r[0] is not None] == [r[3] for r in rows if r[3] is not None]
    assert token_files(no_docs).count() == 0


def test_packing(edge_docs, no_docs):
    texts = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    whole = [(i, [*ids, 1]) for (i, _), ids in zip(texts, library(BYTE, [t for _, t in texts]))]
    pieces = pack_documents(edge_docs).collect()
    sequences, used = {}, []
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        used.append((repr(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens))
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        ends = [0, *np.cumsum([p.length for p in own]).tolist()]
        assert [p.offset for p in own] == ends[:-1] and (ends[-1] == WINDOW or ends[-1] & (ends[-1] - 1) == 0) and ends[-1] <= WINDOW
    # Each row's pieces: take them away by their checksums.
    for i, ids in whole:
        at = 0
        while at < len(ids):
            fits = [u for u in used if u[0] == repr(i) and u[1] == at and u[4] == len(ids) and zlib.crc32(np.array(ids[at : at + u[2]], "<u4").tobytes()) == u[3]]
            assert fits, (i, at)
            used.remove(fits[0])
            at += fits[0][2]
    assert not used and pack_documents(no_docs).count() == 0


def test_neighbours_are_bm25s_best():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, int(rng.integers(5, 60))).astype(np.uint16) for _ in range(80)]
    idf = np.zeros(1 << 16)
    for t in range(300):
        df = sum(t in d for d in docs)
        idf[t] = np.log(1 + (80 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    shard = Shard(docs, idf, mean)
    shard.unused[[0, 5, 9]] = False
    part = lambda d, t: (lambda tf: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean)))((d == t).sum())
    query = sorted(set(docs[0].tolist()), key=lambda t: (-part(docs[0], t), t))[:16]

    def score(d):
        tf = np.bincount(d, minlength=300)
        return sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query)

    scores = {i: score(d) for i, d in enumerate(docs) if shard.unused[i]}
    found = list(shard.neighbours(0))
    assert sorted(found) == sorted(i for i in scores if scores[i] > 0)
    assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_the_lexicon_takes_ties_by_word(spark):
    docs = spark.createDataFrame([(1, "b c a"), (2, "d c b"), (3, None)], "doc_id long, text string")
    # b and c come twice, a and d once.
    assert frequent_words(docs, 3) == ["a", "b", "c"] and frequent_words(docs, 1) == ["b"] and frequent_words(docs.where("false"), 3) == []


@pytest.mark.parametrize("limit", [0xFFFFFFFF, 100])
def test_packages(limit):
    out = io.BytesIO()
    writer = PackageWriter(out, limit)
    bodies = {f"m{i}.txt": bytes([65 + i]) * (50 + 60 * i) for i in range(6)}
    for name, body in bodies.items():
        writer.add(name, body)
    writer.close()
    raw = out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    reader = PackageReader(io.BytesIO(raw), len(raw))
    assert {n: reader.read(n) for n in reader.members} == bodies
    assert list(reader.read_ranges("m4.txt", [(0, 3), (5, 2)])) == [b"EEE", b"EE"]


def test_packages_of_others_and_broken_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"x" * 1000)
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as f:
            f.write(b"yy")
        z.comment = b"a comment with PK\x05\x06 in it, and then some more of it"
    raw = out.getvalue()
    reader = PackageReader(io.BytesIO(raw), len(raw))
    assert reader.read("a") == b"x" * 1000 and reader.read("b") == b"yy"
    with pytest.raises(ValueError):
        PackageReader(io.BytesIO(raw[:-60]), len(raw) - 60)
    damaged = raw.replace(b"xxxxx", b"xxzxx", 1)
    with pytest.raises(ValueError):
        PackageReader(io.BytesIO(damaged), len(damaged)).read("a")


def test_records():
    headers, payload = parse_record(warc_record(7, "http://x/\r\nInjected: 1", "é\r\n\r\nbody".encode(), "ab", None))
    assert payload == "é\r\n\r\nbody".encode() and headers["x-page-id"] == "7" and "injected" not in headers
    headers, payload = parse_record(warc_record(7, None, b"body", "ab", 9))
    assert payload == b"" and headers["warc-type"] == "revisit" and headers["x-refers-to-page-id"] == "9"


def test_package_report(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "u", big), (2, "u", big), (3, None, "y" * 999), (4, "u", "y" * 999), (5, "u", None), (6, "u", ""), (7, "u", other), (9, "u", big), (None, "u", other), (8, "u", other + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha1", "'x' as refers_to", "2 as n")
    truth = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = i is not None and len(raw) >= 1000 and i != max(same)
        truth.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(repr, map(tuple, package_report(pages).collect()))) == sorted(map(repr, truth))
    assert package_report(pages.where("false")).count() == 0


def test_packing_brings_related_documents_together(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    base = [" ".join(rng.choices(words, k=14)) for _ in range(4500)]
    docs = [(i, t) for i, t in enumerate(base)] + [(4500 + i, t + " and more") for i, t in enumerate(base)]
    where = {}
    for r in pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        where.setdefault(r.doc_id, set()).add(r.sequence_id)
    assert len(where) == 9000
    # Shards have 4,096 documents, so no copy stands in the shard of its original.
    assert sum(bool(where[i] & where[4500 + i]) for i in range(4500)) >= 0.8 * 4500
