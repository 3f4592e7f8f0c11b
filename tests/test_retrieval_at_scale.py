"""The inverted file of vectors, the lattice analyser, divided clusters and the running voice stream, against plain versions."""

import random
import time
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, ivf, lattice
from tessera.operators.dense import nearest
from tessera.operators.sparse import build_index, query_terms, search
from tessera.streaming import windows

# --- inverted file ---


def vector_frame(spark, x, name="doc_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>").repartition(4)


def clustered(n, dims=16, groups=40, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dims)) * spread


def found(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def indexed(spark):
    x = clustered(6000)
    vectors = vector_frame(spark, x).cache()
    return x, vectors, ivf.build(vectors)


def test_recall_and_pruning(spark, indexed):
    x, vectors, index = indexed
    queries = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    truth = {(r.query_id, r.doc_id) for r in nearest(vectors, queries, 20).collect()}
    got = {(r.query_id, r.doc_id) for r in ivf.search(index, queries, 20).collect()}
    assert len(got & truth) / len(truth) >= 0.95
    # Queries of one neighbourhood read a few lists, and the scan names their folders.
    few = vector_frame(spark, x[:1], "query_id")
    plan = ivf.search(index, few, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert index.sizes.sum() == 6000 and len(index.sizes) == round(6000**0.5)
    near = index.centres @ (x[0] / np.linalg.norm(x[0]))
    assert (near >= near.max() - index.margin).mean() < 0.5


@pytest.mark.parametrize("margin", [None, 0.0])
def test_exact_search_equals_comparing_all(spark, indexed, margin):
    x, vectors, index = indexed
    queries = vectors.where("doc_id % 200 = 0").withColumnRenamed("doc_id", "query_id")
    assert found(ivf.search(index, queries, 10, margin=margin, exact=True)) == found(nearest(vectors, queries, 10))


def test_index_is_read_again_and_hot_lists_are_cut(spark, indexed, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "VECTORS", 100)
    monkeypatch.setattr(ivf, "QUERIES", 7)
    x = np.concatenate([np.tile([1.0, 0.0, 0.0, 0.0], (900, 1)), clustered(300, 4, 5)])
    vectors = vector_frame(spark, x)
    ivf.build(vectors, path=str(tmp_path / "i"))
    index = ivf.VectorIndex.load(spark, str(tmp_path / "i"))
    queries = vectors.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    assert found(ivf.search(index, queries, 30, exact=True)) == found(nearest(vectors, queries, 30))


def test_unusual_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.0, 2.0]), (6, [0.0, 2.0]), (7, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    index = ivf.build(vectors)
    got = found(ivf.search(index, vectors.withColumnRenamed("doc_id", "query_id"), 5, exact=True))
    assert {(q, d) for q, d, *_ in got} == {(q, d) for q in (1, 6) for d in (1, 6)} and ivf.search(index, vectors.withColumnRenamed("doc_id", "query_id"), 0).count() == 0
    empty = ivf.build(vectors.where("false"))
    assert ivf.search(empty, vectors.withColumnRenamed("doc_id", "query_id"), 5).collect() == []


# --- lattice ---


def cheapest(lat, text):
    """The least cost over all paths, by trying every one."""

    def rest(at, right):
        if at == len(text):
            return lat.connections.get((right, 0), 0)
        return min(lat.connections.get((right, w.left), 0) + w.cost + rest(end, w.right) for end, w in lat.edges(text, at))

    return rest(0, 0)


def test_cheapest_path_of_random_lattices():
    rng = random.Random(1)
    for _ in range(150):
        words = {}
        for _ in range(rng.randint(0, 25)):
            words.setdefault("".join(rng.choices("abc", k=rng.randint(1, 4))), []).append(lattice.Word(rng.randint(0, 3), rng.randint(0, 3), rng.randint(-20, 60), "n"))
        connections = {(i, j): rng.randint(-30, 30) for i in range(4) for j in range(4) if rng.random() < 0.7}
        kinds = {"DEFAULT": lattice.Category(rng.random() < 0.5, rng.random() < 0.5, rng.randint(0, 2)), "B": lattice.Category(rng.random() < 0.5, rng.random() < 0.5, rng.randint(0, 3))}
        unknown = {k: [lattice.Word(rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 90), "u") for _ in range(rng.randint(1, 2))] for k in kinds}
        lat = lattice.Lattice(lattice.Dictionary(words, connections, kinds, [(ord("b"), ord("b"), "B")], unknown))
        text = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        cost, path = lat.path(text)
        assert cost == cheapest(lat, text) and "".join(m.surface for m in path) == text


FILES = {
    "words.csv": "東京,1,1,3000,名詞,固有,*,*,*,*,東京\n京都,1,1,3000,名詞,固有,*,*,*,*,京都\n東,1,1,6000,名詞,一般,*,*,*,*,東\n都,1,1,4000,名詞,接尾,*,*,*,*,都\n"
    "に,2,2,1000,助詞,格,*,*,*,*,に\n行っ,3,3,2000,動詞,自立,*,*,*,*,行く\nた,4,4,500,助動詞,*,*,*,*,*,た\n。,5,5,200,補助記号,句点,*,*,*,*,。\n\"a,b\",1,1,10,名詞,*,*,*,*,*,*\n",
    "matrix.def": "6 6\n1 2 -500\n2 3 -400\n3 4 -800\n1 1 700\n0 0 0\n",
    "char.def": "# classes\nDEFAULT 0 1 0\nALPHA 1 1 0\nKANJI 0 0 2\n0x0041..0x005A ALPHA\n0x0061..0x007A ALPHA # small\n0x4E00..0x9FFF KANJI\n0x2605 SYMBOL\n",
    "unk.def": "DEFAULT,1,1,9000,補助記号,*\nALPHA,1,1,4000,名詞,*\nKANJI,1,1,8000,名詞,*\n",
}


@pytest.fixture(scope="module")
def dictionary(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dictionary")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return lattice.read_dictionary(spark, *(str(folder / n) for n in FILES))


def test_dictionary_and_analysis(dictionary):
    assert dictionary.words["a,b"] == [lattice.Word(1, 1, 10, "名詞")] and dictionary.connections[3, 4] == -800 and (0, 0) not in dictionary.connections
    lat = lattice.Lattice(dictionary)
    assert [m.surface for m in lat.path("東京都に行った。")[1]] == ["東京", "都", "に", "行っ", "た", "。"]
    assert lattice.Analyser(dictionary).tokens("東京都に行った。 Spark京都 ★") == ["東京", "都", "行く", "Spark", "京都"]
    assert lattice.Analyser(dictionary, stop=frozenset(), lemma=frozenset(), symbols=True).tokens("行った。★") == ["行っ", "た", "。", "★"]
    # Unknown characters of a class in runs or pieces; nothing at all.
    assert [m.surface for m in lat.path("xyz龍虎")[1]] == ["xyz", "龍虎"] and lattice.Analyser(dictionary).tokens(None) == lattice.Analyser(dictionary).tokens(" \n") == []


def test_a_dictionary_too_large_is_refused(spark, tmp_path, monkeypatch):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    monkeypatch.setattr(lattice, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="too many to broadcast"):
        lattice.read_dictionary(spark, *(str(tmp_path / n) for n in FILES))


def test_index_on_analysed_text(spark, dictionary):
    terms = lattice.analyser_terms(spark, dictionary, lower=False)
    docs = spark.createDataFrame([(1, "東京に行った。"), (2, "京都に行った。"), (3, "東京都"), (4, None), (5, ""), (6, "別の話"), (7, "遠い話")], "doc_id long, text string")
    index = build_index(docs, terms=terms)
    assert {r.term for r in index.terms.collect()} >= {"東京", "京都", "都", "行く"} and not {r.term for r in index.terms.collect()} & {"に", "た", "。"}
    asked = spark.createDataFrame([(1, "京都")], "query_id long, text string").select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # The whole word, not every text with its characters.
    assert [r.doc_id for r in search(index, asked).collect()] == [2]
    assert index.stats.first().n == 7 and query_terms(spark.createDataFrame([(1, "京都")], "query_id long, text string")).count() == 1


def test_frequency_dictionary_parts_words_without_spaces(spark):
    docs = spark.createDataFrame([("the cat sat",), ("the dog sat",), ("the cow",), ("a cat",)], "text string")
    found = lattice.frequency_dictionary(docs)
    own = lattice.Analyser(found, stop=frozenset({"stop"}))
    assert own.tokens("thecatsat dogzcow") == ["cat", "sat", "dog", "z", "cow"]
    assert set(lattice.frequency_dictionary(docs, most=2).words) == {"the", "cat"}


# --- clusters ---


def plain_division(x, tokens, limit, in_task, turns=clusters.TURNS):
    """``divided`` on one machine: the parts as sets of rows, and the rows that are packed."""
    whole = np.rint(x * 2**20).astype(np.int64)
    done, packed, todo = [], [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        own, exact = x[rows], whole[rows]
        if len(rows) <= in_task or tokens[rows].sum() <= limit:
            done.append(rows)
            continue
        low, high = exact.min(axis=0), exact.max(axis=0)
        if (low == high).all():
            packed.append(rows)
            continue
        middle = exact.sum(axis=0) / len(rows)
        variance = np.where(high == low, 0.0, (exact.astype(float) ** 2).sum(axis=0) / len(rows) - middle * middle)
        variance = np.round(variance / 2**40, 9)
        axis = max(range(x.shape[1]), key=lambda d: (high[d] > low[d], variance[d], -d))
        side = (own[:, axis] >= middle[axis] / 2**20).astype(int)
        before = None
        for _ in range(turns):
            sums = [(int((side == s).sum()), *exact[side == s].sum(axis=0).tolist()) for s in (0, 1)]
            if sums == before:
                break
            before = sums
            far = [((own - np.array(s[1:]) / s[0] / 2**20) ** 2).sum(axis=1) if s[0] else np.full(len(own), np.inf) for s in sums]
            side = (far[1] < far[0]).astype(int)
        todo += [rows[side == s] for s in (0, 1) if (side == s).any()]
    return {frozenset(r.tolist()) for r in done}, packed


def test_division_equals_the_plain_one(spark):
    x = clustered(5000, 8, 60, seed=3)
    x[4000:4600] = x[4000]
    tokens = np.random.default_rng(4).integers(1, 40, 5000)
    rows = spark.createDataFrame([(i, v.tolist(), int(t), "0") for i, (v, t) in enumerate(zip(x, tokens))], "id long, embedding array<double>, tokens long, part string").repartition(5)
    small, packed = clusters.divided(rows, 1024, 200)
    parts = {}
    for r in small.select("id", "part").collect():
        parts.setdefault(r.part, set()).add(r.id)
    truth, equal = plain_division(x, tokens, 1024, 200)
    assert set(map(frozenset, parts.values())) == truth
    groups = {}
    for r in packed.collect():
        groups.setdefault((r.group, r.cluster_id), []).append(r.id)
    assert sorted(i for g in groups.values() for i in g) == sorted(i for rows in equal for i in rows.tolist()) and len(groups) > 10
    assert all(tokens[g].sum() <= 1024 for g in groups.values())


def test_level_keeps_the_limit(spark):
    x = clustered(3000, 8, 30, seed=5)
    tokens = np.random.default_rng(6).integers(0, 700, 3000)
    tokens[17] = 5000
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, tokens))], "id long, embedding array<double>, tokens long")
    groups = {}
    for r in clusters.level(rows, 1024, in_task=400).collect():
        groups.setdefault((r.group, r.cluster_id), []).append(r.id)
    assert sorted(i for g in groups.values() for i in g) == list(range(3000))
    assert all(tokens[g].sum() <= 1024 or len(g) == 1 for g in groups.values())
    assert groups and clusters.level(rows.where("false")).count() == 0


def brute_silhouette(x, labels):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels.tolist()) - {c})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouettes_equal_all_pairs(spark):
    x = np.concatenate([clustered(295, 5, 4, seed=7), np.full((5, 5), 30.0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    centres, step = clusters._lloyd(rows, 6, 50, 42)
    got = clusters.silhouettes(rows, centres, step)
    for k in range(2, 7):
        labels = clusters._labels(x, centres[k])
        assert got[k] == pytest.approx(brute_silhouette(x, labels), abs=1e-5)
    best = max(got, key=got.get)
    assert clusters.silhouette_k(rows, 6) == best
    chosen = {r.id: r.cluster for r in clusters.top_clusters(rows, 6, choose="silhouette").collect()}
    assert [chosen[i] for i in range(300)] == clusters._labels(x, centres[best]).tolist()
    with pytest.raises(ValueError):
        clusters.top_clusters(rows, choose="none")


# --- voice stream ---


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs  # noqa: N815


class State:
    """State of one key, and its timers, in memory."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], set()
        self.handle = self

    def getValueState(self, *_):  # noqa: N802
        return self

    def getListState(self, *_):  # noqa: N802
        outer = self

        class Rows:
            appendList = staticmethod(lambda r: outer.rows.extend(r))  # noqa: N815
            get = staticmethod(lambda: iter(outer.rows))
            clear = staticmethod(lambda: outer.rows.clear())

            @staticmethod
            def put(r):
                outer.rows[:] = r

        return Rows

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


def recognise(pcm):
    return [(0.0, f"{len(pcm)} bytes")]


class Meeting:
    def __init__(self, seconds=10):
        self.state, self.out = State(), []
        self.processor = windows.VoiceWindows(recognise, seconds)
        self.processor.init(self.state)

    def send(self, now, *events):
        names = [c.split()[0] for c in windows.EVENTS.split(", ")]
        rows = [("m", kind, 1, name, at, 1.0 if kind == "audio" else None, b"x" * 4 if kind == "audio" else None, text) for kind, name, at, text in events]
        list(self.processor.handleInputRows(("m",), iter([pd.DataFrame(rows, columns=names)]), Clock(now)))

    def tick(self, now):
        for t in sorted(t for t in self.state.timers if t <= now):
            self.state.timers.discard(t)
            for df in self.processor.handleExpiredTimer(("m",), Clock(now), Clock(t)):
                self.out += list(df.itertuples(index=False, name=None))


def test_windows_wait_advance_and_end():
    m = Meeting()
    m.send(1000, ("chat", "a", 2.0, "first"), ("chat", "a", 12.5, "waits"), ("audio", "b", 3.0, None))
    m.tick(11_000)
    assert m.out == [("m", 0, 0.0, 10.0, "00:00:02 a: first\n00:00:03 b: 4 bytes", 10.0, False, False)] and len(m.state.rows) == 1
    # Late audio is dropped, late chat counts at the window's start.
    m.send(12_000, ("audio", "b", 9.0, None), ("chat", "c", 4.0, "late"))
    m.tick(21_000)
    assert m.out[1] == ("m", 1, 10.0, 20.0, "00:00:10 c: late\n00:00:12 a: waits", 10.0, False, False)
    # Empty windows advance without a number; a timer that fires late ends its window then.
    m.tick(31_000)
    m.tick(43_500)
    assert len(m.out) == 2 and m.state.value[2:4] == (42.5, 2)
    m.send(44_000, ("chat", "a", 43.0, "last"), ("chat", "a", 90.0, "later still"), ("end", None, None, None))
    assert m.state.timers == {44_000}
    m.tick(44_000)
    assert m.out[2] == ("m", 2, 42.5, 90.0, "00:00:43 a: last\n00:01:30 a: later still", 47.5, True, False)
    assert not m.state.exists() and not m.state.rows and not m.state.timers


def test_an_end_without_lines_is_a_marker():
    m = Meeting()
    m.send(0, ("chat", "a", 1.0, "x"))
    m.tick(10_000)
    m.send(11_000, ("end", None, None, None), ("chat", "a", 11.0, "  "))
    m.send(11_500, ("end", None, None, None))
    m.tick(12_000)
    assert m.out[1] == ("m", 0, 10.0, 12.0, "", 0.0, True, True) and len(m.out) == 2
    assert windows.flush_seconds(300, 60) == 60 and windows.flush_seconds(10, 5) == 30


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    names = [c.split()[0] for c in windows.EVENTS.split(", ")]

    def send(*events):
        rows = [(key, kind, 1, "a", at, None, None, text) for key, kind, at, text in events]
        spark.createDataFrame(rows, windows.EVENTS).coalesce(1).write.mode("append").parquet(folder)

    def start():
        stream = spark.readStream.schema(windows.EVENTS).parquet(folder)
        out = windows.voice_transcripts(stream, lambda pcm: [(0.0, f"{len(pcm)} bytes")], 4.0)
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def told():
        try:
            rows = spark.read.schema(windows.TRANSCRIPTS).parquet(str(tmp_path / "out")).collect()
        except Exception:  # noqa: BLE001
            return []
        return sorted(rows, key=lambda r: (r.meeting_key, r.start))

    def wait(n, query):
        for _ in range(240):
            if len(told()) >= n or query.exception():
                break
            time.sleep(0.5)
        assert query.exception() is None and len(told()) >= n

    assert len(names) == 8
    send(("m", "chat", 0.5, "one"), ("m", "chat", 1_000_000.0, "waits"), ("k", "chat", 0.1, "other"))
    query = start()
    wait(2, query)
    query.stop()
    send(("m", "end", None, None), ("k", "end", None, None))
    query = start()
    wait(4, query)
    query.stop()
    m = [r for r in told() if r.meeting_key == "m"]
    assert [(r.transcript_index, r.is_final, r.is_marker) for r in m] == [(0, False, False), (1, True, False)]
    assert "one" in m[0].text and "waits" in m[1].text and all(a.end <= b.start for a, b in pairwise(m))
    # Whatever windows passed empty, the last began where one ended.
    assert [(r.is_final, r.is_marker) for r in told() if r.meeting_key == "k"] == [(False, False), (True, True)]
