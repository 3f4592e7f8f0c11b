import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing, text
from tessera.operators import clusters, parents, ranking, split
from tessera.operators.dense import check_dimension, nearest
from tessera.operators.folds import pack_tokens
from tessera.operators.messages import is_human, with_separators
from tessera.operators.sparse import SparseIndex, build_index, query_terms, search


def one(spark, column, **values):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names or "x int").select(column.alias("v")).first()[0]


@pytest.mark.parametrize("given, least", [("a b c", 3), ("word " * 400, 1), ("# T\n\n## A\n" + "x" * 300 + "\n\n## B\nshort", 4), ("", 0), (" \n ", 0), ("z" * 500, 5)])
def test_split_covers_the_text(given, least):
    spans = split.split_spans(given, 100, 20)
    chunks = [given[a:b] for a, b in spans]
    assert all(0 < len(c) <= 100 and c == c.strip() for c in chunks)
    assert all(a2 >= a1 for (a1, _), (a2, _) in zip(spans, spans[1:]))
    covered = set().union(*[range(a, b) for a, b in spans]) if spans else set()
    assert all(c.isspace() for i, c in enumerate(given) if i not in covered)
    assert bool(spans) == bool(given.strip()) and (least == 0 or len(spans) >= 1)


def test_split_overlap_and_separators():
    words = " ".join(f"w{i:03d}" for i in range(60))
    spans = split.split_spans(words, 50, 20)
    assert all(b1 - a2 <= 20 and a2 <= b1 for (_, b1), (a2, _) in zip(spans, spans[1:]))
    text_ = "intro\n## One\n" + "a " * 30 + "\n## Two\n" + "b " * 30
    assert [text_[a:b][:6] for a, b in split.split_spans(text_, 70, 0)][1:] == ["## One", "## Two"]


def test_chunks_of_two_levels(spark):
    docs = spark.createDataFrame([(1, "para one. " * 200), (2, None), (3, "short")], "doc_id long, text string")
    first = split.first_level(docs)
    second = split.second_level(first)
    ids = sorted((r.doc_id, r.chunk_id) for r in second.collect())
    assert ids == [(d, i) for d in (1, 3) for i in range(sum(x[0] == d for x in ids))]
    known = {(r.doc_id, r.chunk_id): r.text for r in first.collect()}
    assert all(r.text in known[(r.doc_id, r.parent_chunk_id)] for r in second.collect()) and (2, 0) not in known


def test_cleaning(spark):
    s = F.col("s")
    assert one(spark, text.strip_urls(s), s="see HTTPS://x.y/z?q  now　ok ") == "see now ok"
    assert one(spark, text.mask_mentions(s), s="<@12> <@!3> <@&9>") == "@user @user @role"
    assert one(spark, text.mentions(s), s="<@12> <@!3> <@12>") == ["12", "3"]
    assert one(spark, text.name_mentions(s, F.create_map(F.lit("12"), F.lit("Ann"))), s="hi <@12> <@5>") == "hi @Ann <@5>"
    assert one(spark, text.tidy_lines(s), s=" a  b \n\n\n\n c\t\n") == "a b\n\nc"
    assert one(spark, text.safe_file_name(s), s="..a/b: c_") == "a_b_c" and one(spark, text.safe_file_name(s), s="///") == "untitled"
    assert one(spark, text.id_of_name(s), s="d1__x.md") == "d1" and one(spark, text.id_of_name(s), s="x.md") is None
    assert one(spark, text.lines_of(s), s=" a \r\n\n b ") == ["a", "b"]
    assert one(spark, text.is_symbol_only(s), s="***") and not one(spark, text.is_symbol_only(s), s="*a*") and not one(spark, text.is_symbol_only(s), s="  ")
    assert one(spark, text.keyword_query(s), s='"alpha、beta", alpha; gamma') == "alpha beta gamma"
    assert one(spark, text.clock(F.col("s").cast("double")), s="3725.9") == "01:02:05"
    assert one(spark, text.message_date(s), s="2024-01-01T15:00:00Z") == "2024/01/02" and one(spark, text.message_date(s), s="2024-01-01T14:59:59") == "2024/01/01"
    assert one(spark, text.message_date(s), s="soon") is None
    assert [one(spark, text.as_bool(s), s=x) for x in ("true", "Yes", "1", "2.5", "0", "no", "")] == [True, True, True, True, False, False, False]
    assert one(spark, text.token_count(s), s="") == 0 and one(spark, text.token_count(s), s="--") == 1 and one(spark, text.token_count(s), s="a b") == 2
    assert one(spark, text.entry_key(s), s="x") == "11f6ad8ec52a2984"


def test_replies(spark):
    s, n = F.col("s"), F.lit(3)
    fenced = '```json\n{"answer": " yes ", "sources": [2, 2.0, "3", 9, 0], "follow_up_queries": ["a", " a ", "", "b", "c", "d"], "needs_additional_memory": "true"}\n```'
    got = one(spark, parsing.answer_payload(s, n), s=fenced)
    assert (got.answer, got.sources, got.follow_up_queries, got.needs_additional_memory) == ("yes", [2, 3], ["a", "b", "c"], True)
    got = one(spark, parsing.answer_payload(s, n), s='Sure: {"answer": "a\\_b", "sources": [1,], "follow_up_queries": "x"} done')
    assert got.answer == "a\\_b" and got.sources == [1] and got.follow_up_queries == ["x"] and not got.needs_additional_memory
    assert one(spark, parsing.answer_payload(s, n), s="no json") is None and one(spark, parsing.answer_payload(s, n), s='{"answer": ""}') is None
    assert one(spark, parsing.chunk_list(s), s='["a ", "", "b"]') == ["a", "b"] and one(spark, parsing.chunk_list(s), s='{"chunks": ["c"]}') == ["c"]
    assert one(spark, parsing.chunk_list(s), s="x") is None
    assert one(spark, parsing.summary_text(s), s='{"summary": "s"}') == "s" and one(spark, parsing.summary_text(s), s="plain") == "plain"
    assert one(spark, parsing.tool_calls(s), s='{"tool_calls": []}') == [] and one(spark, parsing.tool_calls(s), s='{"tool_calls": [{"name": "find"}]}') == ["find"]
    assert one(spark, parsing.clean_source(s), s=" [3] a [4]") == "a [4]"


def test_index_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a a b"), (2, ""), (3, None), (4, "a c"), (5, "a d")], "doc_id long, text string")
    index = build_index(docs)
    assert index.stats.first().n == 5 and abs(index.stats.first().avg_dl - 7 / 5) < 1e-9
    raw = {t: np.log(5 - d + 0.5) - np.log(d + 0.5) for t, d in {"a": 3, "b": 1, "c": 1, "d": 1}.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    assert {r.term: round(r.idf, 9) for r in index.terms.collect()} == {t: round(v if v >= 0 else floor, 9) for t, v in raw.items()}
    twice = query_terms(spark.createDataFrame([(1, "b b")], "query_id long, text string"))
    once = query_terms(spark.createDataFrame([(1, "b")], "query_id long, text string"))
    assert abs(search(index, twice).first().score - 2 * search(index, once).first().score) < 2e-6
    assert search(index, once, 0).count() == 0
    index.save(str(tmp_path))
    assert SparseIndex.load(spark, str(tmp_path), 1.2, 0.75) is None
    again = SparseIndex.load(spark, str(tmp_path), 1.5, 0.75)
    assert search(again, once).collect() == search(index, once).collect()
    assert build_index(docs.where("false")).postings.count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<float>")
    assert [(r.doc_id, r.rank) for r in nearest(v, q, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="dimensions"):
        check_dimension(v, 3).collect()


def ranked(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")


def test_merges(spark):
    a, b = ranked(spark, (1, 10, 1), (1, 11, 2), (1, 12, 3)), ranked(spark, (1, 11, 1), (1, 13, 2), (1, 14, 3))
    order = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert order(ranking.merge(a, b)) == [10, 11, 12, 13, 14]
    assert order(ranking.quota_merge(a, b, 4, 1)) == [10, 11, 13, 14]
    assert order(ranking.quota_merge(a, b, 5, 2)) == [10, 11, 13, 14, 12]
    assert order(parents.append_parents(a, ranked(spark, (1, 10, 1), (1, 20, 2), (1, 21, 3)))) == [10, 11, 12, 21, 20]
    capped = ranking.cap_parents(a.withColumn("p", F.expr("if(doc_id < 12, 'x', null)")), F.col("p"), 1)
    assert order(capped) == [10, 12]
    assert order(ranking.rerank(a, F.lit(None).cast("double"))) == [10, 11, 12]


def test_mmr():
    docs = np.array([[1, 0.0], [0.9, 0.1], [0.8, 0.2], [0.99, 0.01], [0.0, 1.0]])
    assert ranking.mmr_order(np.array([1.0, 0.2]), docs, 4, 0.3) == [0, 1, 2, 4]
    assert ranking.mmr_order(np.array([1.0, 0.2]), docs, 4, 7.0) == [0, 1, 2, 3]
    assert ranking.mmr_order(np.zeros(2), docs, 4, 0.5) == [0, 1, 2, 3] and ranking.mmr_order(np.ones(2), docs[:2], 5, 0.5) == [0, 1]


def test_parent_joins(spark):
    hits = spark.createDataFrame([("s", "proposition", 7), ("s", "second_recursive", 3), ("s", "proposition", 99)], "source string, chunk_stage string, parent_chunk_id long")
    second = spark.createDataFrame([("s", 7, 2)], "source string, chunk_id long, parent_chunk_id long")
    assert sorted(r.parent_id or -1 for r in parents.root_parent(hits, second).collect()) == [-1, 2, 3]
    out = spark.createDataFrame([(1,), (2,)], "k int")
    assert parents.stale(out, out.where("k = 1"), "k").count() == 1 and parents.stale(out, out.where("false"), "k").count() == 0
    files = spark.createDataFrame([("n", 1, "a"), ("n", 2, "c"), ("n", 2, "b")], "name string, mtime int, path string")
    assert parents.newest(files).first().path == "b"


def test_messages(spark):
    rows = spark.createDataFrame([("c", 1, None, "x"), ("c", 2, "d1", "y"), ("c", 3, None, "z"), ("c", 4, "d2", "w")], "channel string, i int, date string, line string")
    assert [r.line for r in with_separators(rows, "channel", ["i"]).orderBy("i", "part").collect()] == ["x", "y", "z", "d2", "w"]
    people = spark.createDataFrame([(1, False, None, False, "default"), (2, True, False, False, "default"), (3, False, False, False, "pin")], "i int, is_bot boolean, is_webhook boolean, is_system boolean, message_type string")
    assert [r.i for r in is_human(people).collect()] == [1]


def test_pack(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([50, 60, 200, 10, 0, 90])] + [("b", 0, 500)], "k string, i int, n int")
    packs = pack_tokens(rows, "k", ["i"], "n", 100).orderBy("k", "i").collect()
    assert [r.pack for r in packs] == [1, 2, 3, 4, 4, 4, 1]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, size=(30, 4)) for c in (0, 5, 10)])
    labels = clusters.kmeans(x, 3)
    assert [len(set(labels[i : i + 30].tolist())) for i in (0, 30, 60)] == [1, 1, 1] and len(set(labels.tolist())) == 3
    assert clusters.knee([5.0]) == 1 and clusters.knee([5.0, 1.0]) == 2 and clusters.knee([100.0, 20.0, 5.0, 4.0, 3.0, 2.0]) == 2
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    top = {r.id: r.cluster for r in clusters.top_clusters(frame).collect()}
    assert all(len({top[i] for i in range(a, a + 30)}) == 1 for a in (0, 30, 60)) and 2 <= len(set(top.values())) <= 3
    assert clusters.silhouette_k(frame, 6) == 3 and clusters.top_clusters(frame.where("id < 1")).first().cluster == 0
    # A cluster of more rows than a bucket is cut, near-equal rows too, and none is lost.
    many = spark.createDataFrame([(i, [1.0, float(i % 2)], 10) for i in range(3000)], "id long, embedding array<double>, tokens int")
    found = clusters.level(many, limit=200).collect()
    assert sorted(r.id for r in found) == list(range(3000))
    sizes = {}
    for r in found:
        sizes[r.group, r.cluster_id] = sizes.get((r.group, r.cluster_id), 0) + 10
    assert max(sizes.values()) <= 200
    tokens = np.full(90, 100)
    groups = clusters.limited(x, tokens, 1024)
    assert sorted(i for g in groups for i in g) == list(range(90)) and all(tokens[g].sum() <= 1024 for g in groups)
    assert clusters.limited(np.zeros((5, 2)), np.full(5, 600), 1024) == [[0], [1], [2], [3], [4]]
    rows = spark.createDataFrame([(i, f"text {i}", v.tolist()) for i, v in enumerate(x)], "id long, text string, embedding array<double>")
    embed = lambda df: df.withColumn("embedding", F.array(*[F.lit(1.0) * F.length("text") % (k + 3) for k in range(4)]))
    levels = clusters.tree(rows, lambda t: F.substring(F.array_join(t, " "), 1, 50), embed, stop=5, limit=20)
    counts = [90, *[d.count() for d in levels]]
    assert len(levels) >= 1 and all(b < a for a, b in zip(counts, counts[1:]))


def test_answer_loop(spark):
    from tessera.plans.answer import answer

    class Model:
        def generate(self, prompt):
            if "second" in prompt:
                return json.dumps({"answer": "done", "sources": [2, 1]})
            return json.dumps({"answer": "more", "sources": [1], "follow_up_queries": ["second"]})

    def search_(queries):
        return queries.select("query_id", F.when(F.col("text") == "second", 6).otherwise(5).cast("long").alias("doc_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))

    def prompt(questions, found):
        docs = found.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.max("doc_id").alias("m"))
        return questions.join(docs, "query_id").select("query_id", F.when(F.col("m") == 6, "second").otherwise("first").alias("prompt"), "n_sources")

    (row,) = answer(spark.createDataFrame([(1, "first")], "query_id long, text string"), search_, prompt, Model()).collect()
    assert (row.answer, row.sources) == ("done", [5, 6])


@pytest.fixture
def small_tables(spark, tmp_path):
    """Writes documents (doc_id, text, vector), all of one source each, and questions with the ids of their vectors."""
    from tessera.plans.queries import retrieve_hybrid

    def found(docs, questions):
        spark.createDataFrame([(i, t, f"s{i}") for i, t, _ in docs], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        vectors = [(i, v, 1) for i, _, v in docs if v]
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return {(r.query_id, r.doc_id): r["rank"] for r in retrieve_hybrid(spark, str(tmp_path)).collect()}

    return found


def test_retrieval_takes_whole_questions(small_tables):
    # 20 nearer vectors fill the dense list, so the document can only come by the question's last word.
    docs = [(i, f"filler{i}", [1.0, 0.01 * i]) for i in range(25)] + [(99, "needle", [-1.0, 0.0])]
    assert (0, 99) in small_tables(docs, [(0, "a b c d e needle")])


def test_retrieval_keeps_what_has_no_vector(small_tables):
    docs = [(0, "filler", [1.0, 0.0]), (1, "filler", [0.9, 0.1]), (2, "filler", [0.0, 1.0]), (3, "needle", None), (4, "filler", [0.5, 0.5])]
    found = small_tables(docs, [(0, "needle"), (50, "needle")])
    # The sparse hit without a vector is reranked first, for a question without a vector too.
    assert found[0, 3] == 1 and found[50, 3] == 1
    assert len([q for q, _ in found if q == 0]) == 5


def test_whole_retrieval(spark):
    """The hook for changed questions, embedding on demand, the fallback, and parents after the hits."""
    from tessera.plans.retrieve import retrieve, with_parents

    chunks = spark.createDataFrame(
        [(1, "alpha beta", [1.0, 0.0], "p"), (2, "gamma", None, "q"), (3, "delta", [0.0, 1.0], "r")], "doc_id long, text string, embedding array<double>, parent string"
    )
    asked = spark.createDataFrame([(1, "nothing known", None), (2, "alpha", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    changed = spark.createDataFrame([(1, "gamma"), (2, "alpha"), (2, " ")], "query_id long, text string")
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)))
    found = {(r.query_id, r.doc_id) for r in retrieve(asked, chunks, build_index(chunks), changed=changed, embed=embed).collect()}
    assert found == {(1, 2), (2, 1), (2, 3)}
    lost = spark.createDataFrame([(7, "zzz", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    no_vectors = chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
    args = (lost, no_vectors, build_index(chunks))
    assert retrieve(*args).count() == 0 and [r.doc_id for r in retrieve(*args, fallback=chunks).orderBy("rank").collect()] == [3, 1]
    stages = [
        (1, "s", "second_recursive_sparse", 5, 0, "x y"), (2, "s", "second_recursive", 5, 0, "X, y!"), (3, "s", "first_recursive", 0, None, "whole"),
        (4, "s", "proposition", 0, 6, "claim"), (5, "s", "second_recursive", 6, 1, "other"), (6, "s", "first_recursive", 1, None, "long"), (7, "s", "summery", 0, 1, "short"),
    ]
    table = spark.createDataFrame(stages, "doc_id long, source string, chunk_stage string, chunk_id long, parent_chunk_id long, text string")
    ranked = spark.createDataFrame([(1, 1, 1), (1, 4, 2)], "query_id long, doc_id long, rank int")
    rows = with_parents(ranked, table).orderBy("rank").collect()
    # The sparse hit has its original's words; parents come in reverse, the summary for the chunk that has one.
    assert [(r.doc_id, r.text) for r in rows] == [(1, "X, y!"), (4, "claim"), (7, "short"), (3, "whole")]


def test_routing_and_memory(spark):
    from tessera.plans.answer import answer_all, cancellable

    class Router:
        def tools(self, question):
            if question == "broken":
                raise RuntimeError
            return ["search"] if "find" in question else []

    class Model:
        def generate(self, prompt):
            return json.dumps({"answer": prompt.replace("\n", "|"), "sources": [1], "needs_additional_memory": "more" in prompt and "long" not in prompt})

    def search_(queries):
        return queries.select("query_id", F.lit(5).cast("long").alias("doc_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))

    prompt = lambda q, found: q.select("query_id", F.col("text").alias("prompt"), F.lit(1).alias("n_sources"))
    history = lambda q, n: q.select("query_id", F.lit("long" if n > 2 else "brief").alias("history"))
    questions = spark.createDataFrame([(1, "find it"), (2, "hello"), (3, "more please"), (4, "broken")], "query_id long, text string")
    with cancellable(spark, "t"):
        rows = {r.query_id: (r.answer, r.sources, r.retrieved) for r in answer_all(questions, Router(), search_, prompt, Model(), history).collect()}
    assert rows == {1: ("brief||find it", [5], True), 2: ("brief||hello", [], False), 3: ("long||more please", [], False), 4: ("brief||broken", [5], True)}
    plain = {r.query_id: r.answer for r in answer_all(questions, Router(), search_, prompt, Model()).collect()}
    assert plain[3] == "more please"


def test_model_hooks(spark):
    from tessera.plans.models import keywords_with, metrics_with, score_with

    class Scorer:
        def score(self, query, texts):
            if query == "bad":
                raise RuntimeError
            return [2.0 if "x" in t else "no" for t in texts]

    rows = spark.createDataFrame([("q", "x"), ("q", "y"), ("bad", "x"), (None, None)], "query_text string, text string")
    assert sorted((r.query_text or "", r.text or "", r.model_score) for r in score_with(rows, Scorer()).collect()) == [("", "", 0.0), ("bad", "x", 0.0), ("q", "x", 1.0), ("q", "y", 0.0)]

    class Words:
        def generate(self, prompt):
            return "- a, b、a" if "one" in prompt else ""

    asked = spark.createDataFrame([(1, "one"), (2, "two")], "query_id long, text string")
    assert [tuple(r) for r in keywords_with(asked, Words()).collect()] == [(1, "a b")]
    records = spark.createDataFrame([("q", "a", ["c"], ["g"])], "question string, answer string, contexts array<string>, ground_truths array<string>")
    row = metrics_with(records, {"n": lambda q, a, c, g: len(c) + len(g), "bad": lambda *x: 1 / 0}).first()
    assert row.n == 2.0 and row.bad is None


def test_settings(spark):
    from tessera.functions import settings as S

    row = spark.range(1).select(
        S.minute_of_day(F.lit(" 9:30")).alias("a"), S.minute_of_day(F.lit("24:00")).alias("b"), S.weekdays(F.lit("Tuesday, mon,x, 6,mon")).alias("c"),
        S.id_list(F.lit("12, x 7\n12")).alias("d"), S.question_of(F.lit("<@!5> hi "), F.lit("5"), F.lit("!"), F.lit(False)).alias("e"),
        S.question_of(F.lit("!go"), F.lit("5"), F.lit("!"), F.lit(False)).alias("f"), S.question_of(F.lit("hi"), F.lit("5"), F.lit("!"), F.lit(False)).alias("g"),
        S.question_of(F.lit(" hi"), F.lit("5"), F.lit("!"), F.lit(True)).alias("h"), S.weekdays(F.lit(None).cast("string")).alias("i"),
    ).first()
    assert tuple(row) == (570, None, [0, 1, 6], [12, 7], "hi", "go", None, "hi", [])
    made = []
    rules = S.DailyText(lambda day: made.append(day) or f"rules of {day}")
    assert [rules.of(d) for d in ("a", "a", "b")] == ["rules of a", "rules of a", "rules of b"] and made == ["a", "b"]


def test_message_chunks_by_hand(spark):
    """Chunks of lines that are all shorter than a chunk: each begins at a line, and knows the first message it touches."""
    from datetime import datetime, timezone

    from tessera.operators.messages import message_chunks

    at = lambda h: datetime.fromtimestamp(h * 3600, timezone.utc)
    rows = [("c", i, f"m{i}", at(t) if t is not None else None, "ann" if i % 2 else None, text) for i, (t, text) in enumerate([(0, "one\ntwo"), (None, "three"), (14, ""), (16, "four"), (16, "five")])]
    df = spark.createDataFrame(rows, "channel_id string, seq int, message_id string, ts timestamp, author string, text string")
    whole = "unknown: one\nunknown: two\nann: three\n1970/01/02\nann: four\nunknown: five"
    (one,) = message_chunks(df, 500, 0).collect()
    assert (one.text, one.first_message_id, one.first_message_date, one.chunk_id) == (whole, "m0", "1970/01/01", 0)
    found = message_chunks(df, 25, 0).orderBy("chunk_id").collect()
    assert "".join(r.text for r in found).replace("\n", "") == whole.replace("\n", "")
    start = {"m0": "unknown: one", "m1": "ann: three", "m3": "ann: four", "m4": "unknown: five"}
    for r in found:
        assert r.first_message_id in start and (start[r.first_message_id] in r.text or r.first_message_id == "m0")
    assert [r.first_message_date for r in found if "four" in r.text] == ["1970/01/02"]
