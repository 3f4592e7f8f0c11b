"""Steps whose work must not grow faster than their tables: the same results as plain versions, and no more than is needed."""

import random

from pyspark.sql import functions as F

from tessera.operators import lattice

# --- the analyser without connections ---


def random_dictionary(rng, connections, categories=None):
    words = {}
    for _ in range(60):
        surface = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
        words.setdefault(surface, []).append(lattice.Word(0, 0, rng.randint(1, 9) * 10, rng.choice(["word", "stop"]), surface, rng.choice(["", surface.upper()])))
    return lattice.Dictionary(words, connections, categories or {"DEFAULT": lattice.Category(False, False, 1)}, unknown={"DEFAULT": [lattice.Word(0, 0, 95, "unknown"), lattice.Word(0, 0, 90, "other")]})


def test_analysis_without_connections_is_the_general_one():
    rng = random.Random(3)
    kinds = [None, {"DEFAULT": lattice.Category(True, False, 1)}, {"DEFAULT": lattice.Category(False, True, 0)}, {"DEFAULT": lattice.Category(True, True, 2)}]
    for i in range(40):
        seed = rng.random()
        # A connection that no word has takes the general way.
        quick, general = (lattice.Analyser(random_dictionary(random.Random(seed), c, kinds[i % 4]), stop=frozenset({"stop"})) for c in ({}, {(9, 9): 1}))
        for _ in range(30):
            text = "".join(rng.choice("aabbccddx.é 　") for _ in range(rng.randint(0, 30)))
            assert quick.tokens(text) == general.tokens(text)
            assert all(quick.lattice.path(p) == general.lattice.path(p) for p in text.split())


def test_a_stretch_seen_often_is_analysed_once(monkeypatch):
    monkeypatch.setattr(lattice, "REMEMBERED", 10)
    own = lattice.Analyser(lattice.Dictionary({"cat": [lattice.Word(0, 0, 1, "word")]}, categories={"DEFAULT": lattice.Category(False, False, 1)}))
    asked, stretch = [], own.stretch
    monkeypatch.setattr(own, "stretch", lambda part: asked.append(part) or stretch(part))
    for i in range(40):
        own.tokens("cat, " + "cat" * (i % 9 + 1) + " acat. " + chr(0x4E00 + i))
    assert asked.count("cat") == 1 and "cat," not in asked


# --- terms counted inside a row ---


def test_terms_are_counted_inside_their_row(spark):
    from collections import Counter

    from tessera.functions.text import counted

    rng = random.Random(5)
    rows = [[rng.choice(["a", "b", "é", "zz", ""]) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [None, ["b"] * 500]
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>").select("i", counted(F.col("w")).alias("c"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert [(x.term, x.tf) for x in r.c] == sorted(Counter(rows[r.i] or []).items(), key=lambda x: x[0].encode())


# --- meetings ---


def test_a_date_may_have_any_number_of_meetings(spark):
    import pytest

    from tessera.streaming.transcripts import meeting_keys

    meetings = spark.range(1500).select(F.col("id").alias("meeting_id"), F.lit("2024-01-01").alias("date"))
    taken = spark.createDataFrame([("2024-01-01", 4), ("2024-01-02", 9)], "date string, number long")
    found = {r.meeting_id: r.meeting_key for r in meeting_keys(meetings, taken).collect()}
    assert found == {i: f"2024-01-01_{i + 5:02d}" for i in range(1500)}
    with pytest.raises(Exception, match="too many meetings"):
        meeting_keys(meetings, taken, most=999).collect()


# --- index and search ---


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_without_a_shuffle(spark):
    from tessera.operators.sparse import build_index

    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("one two one").alias("text"))
    assert "Exchange" not in plan_of(build_index(docs).postings)


def test_rows_with_one_id_are_one_document(spark):
    from tessera.operators.sparse import build_index

    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (1, "b c"), (None, "c"), (None, "c d"), (3, None), (3, "d")], "doc_id long, text string")
    for index in (build_index(docs), build_index(docs).kept()):
        assert {(r.term, r.doc_id, r.tf) for r in index.postings.collect()} == {("a", 1, 2), ("b", 1, 2), ("c", 1, 1), ("a", 2, 1), ("c", None, 2), ("d", None, 1), ("d", 3, 1)}
        assert index.postings.count() == 7 and {r.term: r.df for r in index.terms.collect()} == {"a": 2, "b": 1, "c": 2, "d": 2}
        assert tuple(index.stats.first()) == (7, 10 / 7)


def test_scores_are_summed_where_their_document_is(spark, monkeypatch):
    from tessera.operators import sparse

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.format_string("w%d x%d", F.col("id") % 7, F.col("id") % 11)).alias("text"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.format_string("all w%d x%d all", F.col("id") % 5, F.col("id") % 3).alias("text"))
    index = sparse.build_index(docs).kept()
    scored = sparse.score(index, sparse.query_terms(asked))
    moved = [line for line in plan_of(scored).splitlines() if "hashpartitioning" in line]
    # One row a posting of an asked term, dealt by document alone.
    assert moved and not any("query_id" in line for line in moved)
    found = [tuple(r) for r in sparse.search(index, sparse.query_terms(asked), 9).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(sparse, "SCORED", 100)
    assert found == [tuple(r) for r in sparse.search(index, sparse.query_terms(asked), 9).orderBy("query_id", "rank").collect()]
    assert sparse._parts(index, asked) == 60 and len(found) == 180
    own = {r.query_id: r for r in asked.collect()}
    for query_id, doc_id, score, rank in found[:18]:
        assert rank > 1 or f"w{doc_id % 7}" in own[query_id].text and f"x{doc_id % 11}" in own[query_id].text


def test_only_texts_of_hits_move(spark, tmp_path):
    from tessera.operators.sparse import build_index
    from tessera.plans.retrieve import retrieve

    rows = [(i, f"common w{i} " + "filler " * 50, [float(i % 5), 1.0], f"p{i}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>, parent string").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    asked = spark.createDataFrame([(1, "w7", [1.0, 1.0]), (2, "w300", None)], "query_id long, text string, embedding array<double>")
    out = retrieve(asked, chunks, build_index(chunks))
    assert {r.doc_id for r in out.collect() if r.query_id == 2} == {300}
    assert "BroadcastHashJoin" in plan_of(out) and "LeftSemi" in plan_of(out)


# --- parents ---


def test_originals_do_not_move_where_no_hit_asks_for_one(spark, tmp_path):
    from tessera.operators.parents import restore, root_parent

    spark.createDataFrame([(i, i % 7, i % 3, f"text {i}") for i in range(60)], "doc_id long, source long, chunk_id long, text string").write.parquet(str(tmp_path / "second"))
    second = spark.read.parquet(str(tmp_path / "second")).withColumn("parent_chunk_id", F.col("chunk_id") * 10)
    hits = second.withColumn("chunk_stage", F.lit("second_recursive"))
    for out in (restore(hits, second, ["source", "chunk_id"], F.col("chunk_stage") == "second_recursive_sparse", ["doc_id"]), root_parent(hits, second)):
        assert "Exchange" not in plan_of(out) and out.count() == 60
    sparse = hits.withColumn("chunk_stage", F.when(F.col("doc_id") % 2 == 0, "second_recursive_sparse").otherwise("proposition"))
    first = {}
    for r in second.orderBy("doc_id").collect():
        first.setdefault((r.source, r.chunk_id), r.text)
    got = restore(sparse, second, ["source", "chunk_id"], F.col("chunk_stage") == "second_recursive_sparse", ["doc_id"]).collect()
    assert len(got) == 60 and all(r.text == (first[r.source, r.chunk_id] if r.doc_id % 2 == 0 else f"text {r.doc_id}") for r in got)


def test_chunks_of_parents_are_split_once(spark):
    from tessera.plans.queries import parents_of_hits

    assert "MapInArrow" not in plan_of(parents_of_hits(spark, "/root/testdata/sf0.001"))


# --- summary levels ---


def test_rows_are_labelled_once(spark, monkeypatch):
    from tessera.operators import clusters

    seen, divided = [], clusters.divided
    monkeypatch.setattr(clusters, "divided", lambda rows, *args: seen.append(rows) or divided(rows, *args))
    rows = spark.range(60).select("id", F.array((F.col("id") % 4).cast("double"), F.lit(1.0)).alias("embedding"), F.lit(100).alias("tokens"))
    assert clusters.level(rows).count() == 60
    assert "Python" not in plan_of(seen[0]) and "Pandas" not in plan_of(seen[0])
