"""Each registered query of the library itself against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex

from tessera.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    truth = sorted(repr(tuple(map(_plain, r))) for r in result.fetchall())
    assert sorted(repr(tuple(map(_plain, r))) for r in df.select(*names).collect()) == truth and truth


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def _tokens(value):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", value.lower())


def _ranked_by_hand(query, vector, sparse, docs, vectors):
    """The chain for one question in plain Python; ``sparse`` is its list of ids by BM25."""
    cos = lambda a, b: float(a @ b) / (math.sqrt(a @ a) * math.sqrt(b @ b))
    dense = [] if vector is None else sorted((i for i in vectors if i in docs), key=lambda i: (-round(cos(vector, vectors[i]), 6), i))[:20]
    pool = list(dict.fromkeys([*dense, *sparse]))
    wanted = set(_tokens(query))
    share = {i: round(len(wanted & set(_tokens(docs[i][0]))) / len(wanted), 6) for i in pool}
    taken, kept = {}, []
    for i in sorted(pool, key=lambda i: -share[i]):
        parent = docs[i][1] or ("alone", i)
        taken[parent] = taken.get(parent, 0) + 1
        if taken[parent] <= 2:
            kept.append(i)
    kept = kept[:20]
    if vector is None or any(i not in vectors for i in kept):
        return kept[:5]
    picked, rest = kept[:3], kept[3:]
    while rest and len(picked) < 5:
        gain = {i: round(0.5 * round(cos(vector, vectors[i]), 9) - 0.5 * max(round(cos(vectors[i], vectors[j]), 9) for j in picked), 9) for i in rest}
        best = max(rest, key=gain.get)
        picked.append(best)
        rest.remove(best)
    return picked


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_retrieve_hybrid_against_plain_python(spark, size):
    """Small tables have a vector for each document; in larger ones some documents have none."""
    data = DATA.parent / size
    con = duckdb.connect()
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    docs = {i: (t or "", s) for i, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    vectors = {i: np.array(v, dtype=float) for i, v in con.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL").fetchall()}
    found = con.execute(f"SELECT query_id, doc_id FROM ({SQL['bm25_topk']}) ORDER BY query_id, rank").fetchall()
    truth = []
    for item, text in con.execute("SELECT item_id, text FROM benchmark").fetchall():
        ids = _ranked_by_hand(text, vectors.get(item), [d for q, d in found if q == item], docs, vectors)
        truth += [(item, d, n) for n, d in enumerate(ids, 1)]
    rows = QUERIES["retrieve_hybrid"](spark, str(data)).select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, rows)) == sorted(truth) and truth


def test_chunks_lie_in_their_texts(spark, duck):
    docs = {i: t or "" for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    first, covered = {}, {i: set() for i in docs}
    for r in QUERIES["chunk_first"](spark, str(DATA)).collect():
        assert r.text == docs[r.doc_id][r.chunk_start : r.chunk_end] and 0 < len(r.text) <= 1024
        first[r.doc_id, r.chunk_id] = r.text
        covered[r.doc_id].update(range(r.chunk_start, r.chunk_end))
    assert all(c.isspace() for i, t in docs.items() for k, c in enumerate(t) if k not in covered[i])
    second = QUERIES["chunk_second"](spark, str(DATA)).collect()
    assert all(r.text in first[r.doc_id, r.parent_chunk_id] and 0 < len(r.text) <= 128 for r in second)
    parents = {(r.doc_id, r.parent_chunk_id) for r in second}
    assert parents == set(first)
    words = lambda rows: {(r[0], w) for r in rows for w in r[1].split() if len(w) < 128}
    assert words([(k, t) for k, t in first.items()]) <= words([((r.doc_id, r.parent_chunk_id), r.text) for r in second])


def test_entry_works_without_the_training_operators():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['tessera.llm'] = None\n"
        "class Gone:\n    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('tessera.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
        "sys.modules.pop('tessera.llm'); sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), 'bm25_topk' in e.oracle_sql())"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False", "True"], out.stderr
