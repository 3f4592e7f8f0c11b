import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import shingles
from tessera.llm.common import components
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm import itq_dedup
from tessera.llm.itq_dedup import _links, _tables, vector_groups
from tessera.llm.minhash import SLOTS, near_groups, signatures

SPACE = dict.fromkeys(b" \t\n\x0b\x0c\r")


def rows(df):
    return [tuple(r) for r in df.collect()]


def brute_exact(docs):
    groups = defaultdict(list)
    for i, text in docs:
        groups[(text or "").translate(SPACE)].append((i, text or ""))
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(own), i == keep, sha) for i, _ in own]
    return out


@pytest.mark.parametrize("salts", [1, 3, 60])
def test_exact(edge_docs, salts):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(map(repr, rows(exact_dedup(edge_docs, salts=salts)))) == sorted(map(repr, brute_exact(docs)))


def test_exact_hot_group(spark):
    docs = [(i, "hot text" + " " * (i % 5) if i % 3 else f"own {i}") for i in range(3000)]
    assert sorted(map(repr, rows(exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"))))) == sorted(map(repr, brute_exact(docs)))


def test_exact_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0


def shingle_set(text, k=4):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(table).translate(dict.fromkeys(b"\t\n\x0b\x0c\r", " ")).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute_near(docs, num=80, den=100):
    """(id, set size, smallest id of the component) with all pairs compared."""
    known = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in known if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return [(i, len(x), None if i is None else root(i), i is None or root(i) == i) for i, x in known]


def test_near_edge_cases(edge_docs):
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert sorted(map(repr, rows(near_groups(edge_docs)))) == sorted(map(repr, brute_near(docs)))


def test_near_groups_of_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(400, size=80)]
    docs = []
    for i in range(120):  # a group with more and more edits, of which some copies only reach others
        own = list(base)
        for _ in range(int(rng.integers(0, 6))):
            own[rng.integers(len(own))] = words[rng.integers(400)]
        docs.append((i, " ".join(own)))
    docs += [(200 + i, " ".join(words[j] for j in rng.integers(400, size=50))) for i in range(40)]
    docs += [(300, docs[0][1].upper()), (301, docs[5][1] + "\n")]
    found = near_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(rows(found)) == sorted(brute_near(docs))


def test_near_empty(no_docs):
    assert near_groups(no_docs).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    x, y = rng.integers(2**63, size=400, dtype=np.uint64), rng.integers(2**63, size=100, dtype=np.uint64)
    a, b = x, np.concatenate([x[:300], y])
    sig = signatures(np.concatenate([a, b, a[:3]]), np.array([0, 400, 800, 803]))
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.15
    # Each slot is filled, and no slot of a large set needs a high rank.
    assert (sig >> np.uint64(32)).max() < SLOTS and (sig[0] >> np.uint64(32)).max() < 10


def test_shingles_do_not_depend_on_chunks():
    texts = ["a b c d e", "", "x", "A B\tC  d E", "a b c d e"]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    hashes, begin = shingles.shingle_hashes(raw, at, 4)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(begin, begin[1:])]
    assert sets[0] == sets[3] == sets[4] and len(sets[0]) == 2 and sets[1] == set() and len(sets[2]) == 1
    alone, _ = shingles.shingle_hashes(raw, at[3:5], 4)
    assert set(alone.tolist()) == sets[3]


def test_components_of_a_chain(spark):
    nodes = spark.range(0, 60).toDF("node")
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 45), (45, 45)], "a long, b long")
    found = dict(rows(components(nodes, links)))
    assert all(found[i] == 1 for i in range(1, 41)) and found[0] == 0 and found[50] == 45 and found[59] == 59


def brute_vectors(data, least=0.93):
    """(id, links, component, kept) of rows with distinct ids."""
    def good(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    parent, links = {i: i for i, _, _ in data if i is not None}, defaultdict(int)
    ok = [(i, np.array(v, dtype=float), (l, len(v))) for i, v, l in data if i is not None and good(v, l)]
    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[:k]:
            if l == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    return [(i, links[i], None if i is None else root(i), i is None or root(i) == i) for i, _, _ in data]


def test_vectors(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(300):
        v = rng.normal(size=64)
        data.append((i, v.astype(np.float32).tolist(), i % 3))
        if i % 10 == 0:  # near copies, from close ones to some about the threshold
            for k, noise in enumerate((0.0, 0.02, 0.2, 0.35)):
                data.append((1000 + 10 * i + k, (v + noise * rng.normal(size=64)).astype(np.float32).tolist(), i % 3))
    nan, inf = float("nan"), float("inf")
    data += [(5000, None, 1), (5001, [0.0] * 64, 1), (5002, [nan] + [1.0] * 63, 1), (5003, [inf] + [1.0] * 63, 1), (5004, [None] + [1.0] * 63, 1)]
    data += [(5005, data[0][1], None), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1), (5009, [1e-30, 2e-30], 1), (None, data[0][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "'x' as v", "2L as n_links")
    found, truth = {r[0]: tuple(r) for r in vector_groups(df).collect()}, {r[0]: r for r in brute_vectors(data)}
    assert len(found) == len(truth)
    true_links, links = sum(r[1] for r in truth.values()), sum(r[1] for r in found.values())
    assert links <= true_links and links >= 0.95 * true_links
    assert all(found[i][1] <= truth[i][1] for i in truth)
    assert sum(found[i] == truth[i] for i in truth) >= 0.97 * len(truth)


def test_vectors_empty(spark):
    assert vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def directed_vectors(n, mean_cosine, seed):
    """Vectors about a common direction, and a partner at cosine 0.9301 of each fifth: (rows, planted pairs)."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(1 - mean_cosine) * unit(rng.normal(size=(n, 64))) + np.sqrt(mean_cosine) * unit(np.ones(64)))
    near = x[::5]
    side = rng.normal(size=near.shape)
    # Partners keep their length along the common direction as nearly as their distance lets them.
    side = unit(side - (side * near).sum(axis=1, keepdims=True) * near)
    y = 0.9301 * near + np.sqrt(1 - 0.9301**2) * side
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(n + i, v.tolist(), 0) for i, v in enumerate(y)]
    return rows, np.concatenate([x, y])


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5, 0.64, 0.8])
def test_vectors_with_a_common_direction(spark, mean_cosine):
    data, x = directed_vectors(1000, mean_cosine, 3)
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert links.sum() >= 400
    for block in (2048, 100):
        found = {r[0]: r[1] for r in vector_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), block=block).collect()}
        assert [found[i] for i in range(len(x))] == links.tolist()


def linked(spark, x, label="0", **options):
    """Links of each vector by ``_links``, and the rows that come out."""
    own = {"least": 0.93, "sample": 2000, "block": 2048, "miss": itq_dedup.MISS, **options}
    df = spark.createDataFrame([(i, v.tolist(), label, 1) for i, v in enumerate(x)], "rep long, v array<double>, label string, mult long").repartition(4)
    rows = [tuple(r) for r in _links(df, x.shape[1], own["least"], own["sample"], own["block"], own["miss"]).collect()]
    degree = np.zeros(len(x), dtype=int)
    for a, _, n in rows:
        degree[a] += n
    return degree, rows


@pytest.mark.parametrize("mean_cosine, n", [(0.0, 300), (0.0, 8000), (0.5, 8000), (0.8, 4000)])
def test_vector_tables_find_pairs_at_the_threshold(spark, mean_cosine, n):
    """Whatever the number of vectors, pairs at the threshold meet in the tables; few of the others become candidates."""
    _, x = directed_vectors(n, mean_cosine, 4)
    how = _tables(x[:2000], len(x), 0.93, 2048, itq_dedup.MISS)
    assert how.width >= itq_dedup.LEAST_WIDTH and how.tables > 4
    # Nearly all vectors go through the tables.
    assert (((x - how.mean) ** 2).sum(axis=1) < how.near).mean() < 0.02
    p, q = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    truth = np.bincount(np.concatenate([p, q]), minlength=len(x))
    degree, rows = linked(spark, x)
    # No pair is counted twice, though it may meet in several tables.
    assert (degree <= truth).all() and degree.sum() >= 0.998 * truth.sum()
    assert all(truth[a] and truth[b] for a, b, _ in rows)


def test_vectors_near_the_mean_are_compared_with_all(spark):
    """Vectors at the mean see wide angles: their pairs must not depend on the codes."""
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=32))
    x = unit(0.7 * centre + 0.714 * unit(rng.normal(size=(1500, 32))))
    mean = unit(x.mean(axis=0))
    near = unit(mean + 0.33 * unit(rng.normal(size=(40, 32))))
    x = np.concatenate([x, near])
    truth = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert truth[1500:].sum() > 50
    for block in (2048, 100):
        degree, _ = linked(spark, x, block=block)
        assert degree[1500:].tolist() == truth[1500:].tolist()


def test_a_large_group_of_near_vectors_gives_no_pairs(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    x = centre + 0.1 * rng.normal(size=(600, 64))
    df = spark.createDataFrame([(i, v.tolist(), "0", 1) for i, v in enumerate(x)], "rep long, v array<double>, label string, mult long")
    rows = _links(df, 64, 0.93, 500, 100, 1e-4).collect()
    # A row for each vector and cell at the most, though all 179,700 pairs link.
    assert len(rows) <= 21 * 230 and sum(r[2] for r in rows) == 600 * 599
    found = vector_groups(df.selectExpr("rep as vec_id", "v as embedding", "label"), block=100).collect()
    assert {(r[1], r[2]) for r in found} == {(599, 0)}


def test_near_groups_beyond_one_block(spark, monkeypatch):
    """One group of look-alikes, of which only neighbours in a chain are near copies, dealt over several blocks."""
    from tessera.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_ROWS", 40)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[3 * i : 3 * i + 100])) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_groups(df).collect()) == sorted(brute_near(docs))
