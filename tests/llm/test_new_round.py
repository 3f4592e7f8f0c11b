"""Source divergence, byte-level BPE through sentencepiece, and clustering by centroids, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

from tessera.llm.divergence import divergence_report, run_columns, run_divergence, shares, terms, vocabulary
from tessera.llm.orchard import Orchard, _limbs, cluster_report, kept_vectors, whole
from tessera.llm.piece_bpe import PieceModel, decode_documents, encode_documents, read_ranks, round_trip_report, serialise_model
from tessera.llm.tokens import tokenizer_path

MULTI = tokenizer_path("byte_bpe_multi_50k.tiktoken")


# --- op11 ---

def plain_divergence(docs, least=10, top=10):
    """The report over (lang, source, text) rows, straight from its definition."""
    find = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = find.findall((text or "").translate(lower))
        counts[lang, source].update(own)
        df[lang].update(set(own))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        every = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def share(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // total for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(every)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            own = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", own, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(rows[:most])}
    return out


def words_docs(seed, n, sources=7):
    rng = random.Random(seed)
    vocab = [f"{rng.choice(['Ä', 'b', 'C', 'é', '日'])}{rng.choice('xyzXYZ')}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    docs = []
    for i in range(n):
        own = rng.choices(vocab, weights=[1 / (1 + j) for j in range(120)], k=rng.randint(0, 40))
        docs.append((rng.choice(["en", "de", None]), f"s{min(int(rng.expovariate(0.7)), sources)}", rng.choice([" ", ", ", "-1\x00"]).join(own)))
    return [*docs, ("en", None, None), ("xx", "lonely", "one two"), ("xx", "other", ""), ("en", "s1", docs[0][2]), ("en", "s1", docs[0][2])]


def report_rows(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_divergence_equals_its_definition(spark, block):
    docs = words_docs(1, 600)
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    assert report_rows(divergence_report(df, block=block)) == plain_divergence(docs)


def test_divergence_of_unusual_rows(spark, edge_docs, no_docs):
    docs = [tuple(r) for r in edge_docs.select("lang", "source", "text").collect()]
    assert report_rows(divergence_report(edge_docs, least=2)) == plain_divergence(docs, least=2)
    assert divergence_report(no_docs).collect() == []
    one = spark.createDataFrame([("en", "a", "x y"), ("en", "b", "x"), (None, None, None)], "lang string, source string, text string")
    assert report_rows(divergence_report(one)) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_terms_are_what_the_pattern_matches():
    rng, find = random.Random(3), re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    for _ in range(500):
        text = "".join(rng.choices(["A", "z", "É", "é", "İ", "日", " ", "\x00", "\x85", "　", "@", "[", "`", "{", "\x7f", "1", "_"], k=30))
        own = [re.sub("[A-Z]", lambda m: m.group().lower(), t).encode() for t in find.findall(text)]
        assert terms(text) == own


def test_runs_hold_the_ordered_columns(spark):
    rng = random.Random(5)
    rows = [("en", f"t{i}", f"s{s}", rng.choice([1, 1, 1, 2, 9]), 20) for i in range(300) for s in range(4) if rng.random() < 0.5]
    counts = spark.createDataFrame(rows, "lang string, term string, source string, n long, docs long")
    runs = run_columns(vocabulary(counts), block=64).collect()
    held = Counter()
    for r in runs:
        ends = [*r.starts[1:], r.size]
        assert r.starts[0] == 0 and r.size <= 64 and all(a < b for a, b in zip(r.starts, ends))
        assert all(a != b for a, b in zip(r["counts"], r["counts"][1:]))
        held[r.source] += sum((b - a) * n for a, b, n in zip(r.starts, ends, r["counts"]))
    assert held == {s: sum(n for _, _, o, n, _ in rows if o == s) for s in held}
    # Ordered, a column has fewer runs than terms.
    assert sum(len(r.starts) for r in runs) < 0.7 * sum(r.size for r in runs)


def test_run_divergence_and_shares_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        a, b = (np.sort(rng.integers(0, 3, size)) for _ in range(2))
        p, q = (shares(x, int(x.sum()) + 2 * size) for x in (a, b))

        def column(x):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
            return starts, x[starts]

        assert run_divergence(column(p), column(q), size) == sum((int(x) - int(y)) ** 2 // int(x + y) for x, y in zip(p, q))
    assert shares(np.array([10**15]), 3 * 10**15).tolist() == [1 + 10**9 * (10**15 + 2) // (3 * 10**15)]


# --- op12 ---

PIECES = [
    "", " ", "  a  b\n c", "don't  stop\t now \n\n ok 'S", "<|endoftext|> hi", "İstanbul ΣΑΣ ǅ", "日本語 テキスト　x", "½ ² ⅷ 12³", "a\x85 b\x1c c", "\x00\x01",
    "\U00010ee7a b\U000323e71 \U0003d027", "a" * 5000, " " * 3000 + "x", "é" * 2000, "🙂👍🏽 x",
]
ALPHABET = ["a", "B", "é", " ", "  ", "\n", ".", "'", "s", "'ll", "3", "_", "ß", "İ", "σ", "中", "\x00", "\x85", "́", "\t", "\U00010ee7", "\U000323e7", "ࢗ"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(MULTI)


def ids_of(model, texts):
    out = [[] for _ in texts]
    for i, ids in model.encode_all(texts):
        out[i] += ids.tolist()
    return out


def test_pieces_give_the_librarys_ids_and_texts(pieces, library):
    rng = random.Random(4)
    texts = PIECES + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(4000)]
    got = ids_of(pieces, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [pieces.decode(np.array(x, dtype=np.int64)).decode() for x in got] == texts
    assert [[int(i) for part in pieces.encode(t) for i in part] for t in PIECES] == got[: len(PIECES)]


def test_pieces_and_library_agree_on_characters(pieces, library):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for c in points if c < 0x3400 or c in pieces.odd or c % 17 == 0]
    texts = ["\n".join(f"a{chr(c)}1{chr(c)} {chr(c)}-{chr(c)}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert ids_of(pieces, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_by_and_by(pieces, library, monkeypatch):
    import tessera.llm.piece_bpe as module

    monkeypatch.setattr(module, "LONG", 100)
    monkeypatch.setattr(module, "STRETCH", 16)
    texts = ["some words, and more: " * 50, "x", "", "é日 " * 80]
    assert ids_of(pieces, texts) == [library.encode_ordinary(t) for t in texts]
    assert max(len(w) for t in texts[:1] for w in pieces.words(t)) == 16


def test_the_model_file_is_read_by_its_format():
    form = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = form.ModelProto.FromString(serialise_model([b"a", b"b", b" ", b"ab"]))
    assert [(p.piece, p.score, p.type) for p in model.pieces] == [("a", 0, 1), ("b", -1, 1), ("Ġ", -2, 1), ("ab", -3, 1), ("<unk>", 0, 2)]
    assert model.trainer_spec.model_type == 2 and model.normalizer_spec.name == "identity"
    assert not (model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces or model.normalizer_spec.escape_whitespaces)


def test_round_trip_report(spark, edge_docs, no_docs, library):
    docs = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    truth = []
    for i, text in docs:
        ids = library.encode_ordinary(text or "")
        digest = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        truth.append((i, len(ids), *digest))
    rows = [tuple(r) for r in round_trip_report(edge_docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert Counter(rows) == Counter(truth)
    assert round_trip_report(no_docs).collect() == []
    back = decode_documents(encode_documents(edge_docs)).collect()
    assert Counter((r.doc_id, bytes(r.content).decode()) for r in back) == Counter((i, t or "") for i, t in docs)


# --- op13 ---

def plain_clusters(rows, k=16, rounds=3, dims=64):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) of (vec_id, embedding) rows by comparing all, in Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [int(np.floor(64 * x)) if abs(x) < 2**900 else int(x) * 64 for x in v]) for i, v in kept]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, own) if c == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d

    def held(n):
        return n if n < 2**63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, held(d), held(inertia[j]), held(sum(inertia.values())), digests[j]) for (i, _), (d, j) in zip(kept, found))


def clustered(df, **options):
    rows = cluster_report(df, **options).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return Counter(map(tuple, rows))


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def test_clusters_equal_comparing_all(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 64))
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * rng.choice([0.05, 1.0])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]
    df = frame(spark, rows, "float")
    assert clustered(df) == plain_clusters([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("scale", [2.0**12, 2.0**19, 2.0**40, 1e300])
def test_clusters_of_large_components(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * scale).tolist()) for i in range(60)]
    assert clustered(frame(spark, rows), dimensions=4, k=5) == plain_clusters(rows, k=5, dims=4)


def test_clusters_of_unusual_rows(spark):
    good = [[float(i % 3), float(i), 0.5, -0.25] for i in range(12)]
    rows = [(i, v) for i, v in enumerate(good)] + [(3, good[3]), (3, good[5]), (None, good[1])]
    odd = [(50, None), (51, []), (52, [1.0] * 3), (53, [1.0, None, 0.0, 0.0]), (54, [float("nan")] * 4), (55, [float("inf"), 0.0, 0.0, 0.0]), (56, [1.0] * 5)]
    df = frame(spark, rows + odd).selectExpr("*", "1 AS cluster", "2 AS distance", "'x' AS v")
    assert clustered(df, dimensions=4, k=5) == plain_clusters(rows, k=5, dims=4)
    assert clustered(df, dimensions=4, k=100) == plain_clusters(rows, k=100, dims=4)
    assert not clustered(frame(spark, odd), dimensions=4)
    assert kept_vectors(frame(spark, odd), 4).count() == 0


def test_search_with_ties_and_equal_centroids():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k, n = int(rng.integers(1, 12)), 30
        centroids = rng.integers(-2, 3, (k, 2)).tolist()
        x = whole(rng.integers(-3, 4, (n, 2)).astype(float), 1)
        best, near = Orchard(centroids).nearest(x)
        truth = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for v in x.astype(int).tolist()]
        assert [(int(d), int(j)) for d, j in zip(near, best)] == truth


def test_search_leaves_far_centroids_out(monkeypatch):
    # Centroids far apart, vectors close to the first: one look-up in its list ends the search.
    search = Orchard([[i * 1000, 0] for i in range(16)])
    marked = []
    real = np.zeros

    def zeros(*a, **kw):
        out = real(*a, **kw)
        if kw.get("dtype") is bool:
            marked.append(out)
        return out

    monkeypatch.setattr(np, "zeros", zeros)
    search.nearest(whole(np.random.default_rng(1).random((50, 2)), 64))
    assert marked[0].sum() == 50


def test_limbs_add_up():
    for n in [0, 1, -1, 2**61, -(2**61), 2**62, -(2**62), 2**200 + 12345, -(2**200) - 7]:
        assert sum(v << 60 * p for p, v in _limbs(n)) == n and all(-(2**63) <= v < 2**63 for _, v in _limbs(n))
