"""The pipeline's stages against plain Python on a small table."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.common import shared_dir
from tests_llm_brute import brute_exact, brute_near, expected_tokens


def _plain(df):
    return Counter(repr((r.doc_id, r.text)) for r in df.collect())


def test_stages(spark, edge_docs, tmp_path):
    docs, columns = edge_docs, edge_docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "minhash_near_dedup", "secret_scan", "lexical_packing"]

    def run(name, given):
        out = steps[name](spark, given, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        back = spark.read.parquet(path)
        return back

    lang = run("language_id", docs)
    assert lang.columns == columns
    want = Counter(repr((r.doc_id, r.text)) for r in docs.collect() if r.text and any(map(str.isalpha, r.text)))
    assert _plain(lang) == want
    exact = run("exact_dedup", lang)
    given = [(r.doc_id, r.text) for r in lang.collect()]
    kept = {(i, sha) for i, _, _, k, sha in brute_exact(given) if k}
    assert exact.columns == columns
    assert {(i, sha) for i, _, _, _, sha in brute_exact([(r.doc_id, r.text) for r in exact.collect()])} == kept and exact.count() == len(kept)
    near = run("minhash_near_dedup", exact)
    given = [(r.doc_id, r.text) for r in exact.collect()]
    kept = Counter(repr(i) for i, _, _, k in brute_near(given) if k)
    assert near.columns == columns and Counter(repr(r.doc_id) for r in near.collect()) == kept
    clean = run("secret_scan", near)
    assert clean.columns == columns and clean.count() == near.count()
    changed = {r.doc_id: r for r in clean.collect()}
    assert changed[13].text == "[SECRET] and [SECRET]" and changed[13].n_chars == 21
    assert all(changed[r.doc_id].text == r.text for r in near.collect() if r.doc_id != 13)
    pieces = run("lexical_packing", clean)
    total = {repr(r.doc_id): r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == expected_tokens([(r.doc_id, r.text) for r in clean.collect()])


def test_run_on_empty_and_whole_tables(spark, edge_docs, no_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    no_docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_shared_folders_are_new(spark):
    assert shared_dir(spark) != shared_dir(spark)


def test_near_copies_by_five_words(spark):
    def pair(i, n):
        words = [f"w{i}x{k}" for k in range(n)]
        return [(i, " ".join(words)), (i + 1, " ".join([*words[: n // 2], "other", *words[n // 2 + 1 :]]))]

    # One word of 40 changed: 33 of 41 shingles of four words agree, but 31 of 41 of five.
    docs = spark.createDataFrame(pair(10, 40) + pair(20, 60), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [10, 11, 20]
