"""Tables in versions, names over a stream, the answer loop's memory, and the repair of damaged replies."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import parsing
from tessera.operators.filters import counted, counters
from tessera.plans.answer import answer, answer_with_contexts, routed
from tessera.sources import chunks
from tessera.sources.versions import VersionedTable
from tessera.sources.web import pages_of, read_feed
from tessera.streaming.names import named_messages


# --- versions ---

def test_a_job_killed_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None and table.version() == -1
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    table.replace(rows(1, 2))
    before = table.current()

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_switch", killed)
        with pytest.raises(KeyboardInterrupt):
            table.replace(rows(9))
    assert sorted(r.x for r in table.current().collect()) == [1, 2] and table.version() == 0
    # The next job writes over what was left; readers of the old version still have it.
    assert [r.x for r in table.replace(rows(3)).collect()] == [3] and sorted(r.x for r in before.collect()) == [1, 2]
    # A batch that comes again is not written twice, an older one is refused, and an empty table keeps its columns.
    assert [r.x for r in table.replace(rows(4), 1).collect()] == [3]
    with pytest.raises(ValueError):
        table.replace(rows(4), 0)
    assert table.replace(rows(1).where("false")).columns == ["x"] and table.current().count() == 0
    assert {r.path.rsplit("/", 1)[1] for r in table.forget().collect()} == {"0", "1"}


def test_running_numbers_and_upserts(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "s"))
    new = lambda *r: spark.createDataFrame(r, "meeting_key string, transcript_index int, text string")
    chunks.add_summaries(table, new(("a", 1, "x"), ("a", 0, "w"), ("b", 0, "y")))
    chunks.add_summaries(table, new(("a", 2, "z"), ("a", 1, "again"), ("c", 5, "v"), ("c", 5, "v")))
    got = sorted((r.meeting_key, r.transcript_index, r.chunk_id, r.text) for r in table.current().collect())
    assert got == [("a", 0, 0, "w"), ("a", 1, 1, "x"), ("a", 2, 2, "z"), ("b", 0, 0, "y"), ("c", 5, 0, "v")]
    read = lambda **k: sorted((r.meeting_key, r.chunk_id) for r in chunks.meeting_summaries(table.current(), **k).collect())
    assert read(last=2) == [("a", 1), ("a", 2), ("b", 0), ("c", 0)] and read(index=0) == [("a", 0), ("b", 0)] and len(read()) == 5 and read(last=0) == []

    names = VersionedTable(spark, str(tmp_path / "n"))
    seen = lambda *r: spark.createDataFrame(r, "id string, name string, ts long")
    names.upsert(seen(("1", "a", 5), ("2", "b", 5)), ["id"], F.col("ts"))
    names.upsert(seen(("1", "tie", 5), ("2", "newer", 6), ("3", "none", None)), ["id"], F.col("ts"))
    names.upsert(seen(("3", "some", 0), ("2", "older", 1)), ["id"], F.col("ts"))
    assert sorted((r.id, r.name) for r in names.current().collect()) == [("1", "a"), ("2", "newer"), ("3", "some")]


def test_prompt_rows(spark):
    df = spark.createDataFrame([(" t ", "T", "p", 0), ("t", None, "p", 1), ("t", " ", "", 0), (" ", "T", "p", 0)], "text string, title string, path string, level int")
    got = [r[0] for r in df.select(chunks.summary_prompt_row(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["t\ntitle: T\npath: p", "t", "t", ""]


def test_counters_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"g{i % 3}", None if i % 2 else "c") for i in range(100)], "i long, guild string, channel string").repartition(3)
    out, seen = counted(rows, guilds="guild", channels="channel")
    out.write.parquet(str(tmp_path / "o"))
    assert seen.get == counters(spark.read.parquet(str(tmp_path / "o")), guilds="guild", channels="channel").first().asDict()
    plan = out._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") == rows._jdf.queryExecution().toString().count("Scan ExistingRDD")
    # Of an empty table too, by the write alone.
    none, seen = counted(rows.where("false"), guilds="guild")
    none.write.parquet(str(tmp_path / "e"))
    assert seen.get == {"rows": 0, "guilds": 0}


def test_vectors_with_their_note(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    chunks.save_vectors(rows, str(tmp_path / "v"), "m", 2)
    table, told = chunks.load_vectors(spark, str(tmp_path / "v"), "m", 2)
    assert table.count() == 2 and told == [] and len(chunks.load_vectors(spark, str(tmp_path / "v"), "other", 2)[1]) == 1
    with pytest.raises(ValueError):
        chunks.load_vectors(spark, str(tmp_path / "v"), "m", 3)


def test_a_router_is_asked_again(spark, tmp_path):
    class Router:
        def tools(self, question):
            log = tmp_path / question
            log.write_text(log.read_text() + "x" if log.exists() else "x")
            if question == "never" or log.read_text() == "x":
                raise RuntimeError
            return []

    asked = spark.createDataFrame([(1, "never"), (2, "later")], "query_id long, text string").coalesce(1)
    assert {r.text: r.retrieve for r in routed(asked, Router()).collect()} == {"never": True, "later": False}
    assert (tmp_path / "never").read_text() == "xxx" and (tmp_path / "later").read_text() == "xx"


# --- names ---

def test_names_over_a_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "message_id long, author_id string, author_name string, ts long, text string"
    asked = str(tmp_path / "asked")

    def fetch(author):
        with open(f"{asked}-{author}", "a") as f:
            f.write("x")
        if author == "7":
            raise OSError
        return {"9": "nine"}.get(author)

    def out(batch, epoch):
        batch.select("message_id", "text").write.mode("overwrite").parquet(f"{tmp_path}/out/{epoch}")

    def run():
        sink = named_messages(str(tmp_path / "names"), out, fetch)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    def send(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    send((1, "1", "ann", 10, "hi"), (2, "2", "bob", 11, "<@1> <@!9> <@9> <@7>"), (3, "1", "tie", 10, "x"))
    run()
    # A rename, an older name that comes late, a time that ties, and a fetched name that a message replaces.
    send((4, "1", "anna", 20, "<@1> <@2>"), (5, "2", "late", 5, None), (6, "2", "tie", 11, "<@9> <@7>"))
    run()
    send((7, "9", "NINE", 1, "<@9>"))
    run()
    got = {r.message_id: r.text for i in range(3) for r in spark.read.parquet(f"{tmp_path}/out/{i}").collect()}
    assert got == {1: "hi", 2: "@ann @nine @nine <@7>", 3: "x", 4: "@anna @bob", 5: None, 6: "@nine <@7>", 7: "@NINE"}
    # One look-up of a missing id in each batch; a name that was found is not sought again.
    assert (tmp_path / "asked-9").read_text() == "x" and (tmp_path / "asked-7").read_text() == "xx"
    # A batch that comes again finds the names it left.
    again = spark.createDataFrame([(2, "2", "bob", 11, "<@1>")], schema)
    named_messages(str(tmp_path / "names"), out, fetch)(again, 2)
    assert spark.read.parquet(f"{tmp_path}/out/2").first().text == "@anna"


# --- answers ---

def ask_loop(spark, tmp_path, contexts=False):
    log = tmp_path / "log"

    class Model:
        def generate(self, prompt):
            with log.open("a") as f:
                f.write(json.dumps(prompt) + "\n")
            if prompt.startswith("long memory") and "doc 6" in prompt:
                return json.dumps({"answer": "both", "sources": [2, 1]})
            if prompt.startswith("long memory"):
                return json.dumps({"answer": "seek", "follow_up_queries": ["second"], "needs_additional_memory": True})
            if "easy" in prompt:
                return json.dumps({"answer": "at once", "sources": [1]})
            return json.dumps({"answer": "more", "needs_additional_memory": True})

    def search(queries):
        with (tmp_path / "searches").open("a") as f:
            f.write(json.dumps(sorted(r.text for r in queries.collect())) + "\n")
        return queries.select("query_id", F.when(F.col("text") == "second", 6).otherwise(5).cast("long").alias("doc_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("score"))

    def prompt(questions, found):
        docs = found.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.concat_ws(" ", F.lit("doc"), F.max("doc_id")).alias("d"))
        return questions.join(docs, "query_id").select("query_id", F.concat_ws(" ", "text", "d").alias("prompt"), "n_sources")

    def history(questions, n):
        return questions.select("query_id", F.lit("long memory" if n == Config().history_long else "short memory").alias("history"))

    asked = spark.createDataFrame([(1, "hard"), (2, "easy")], "query_id long, text string")
    if contexts:
        texts = spark.createDataFrame([(5, "five"), (6, "six")], "doc_id long, text string")
        rows = answer_with_contexts(asked, search, prompt, Model(), texts, history=history).collect()
    else:
        rows = answer(asked, search, prompt, Model(), history=history).collect()
    return rows, [json.loads(x) for x in log.read_text().splitlines()], [json.loads(x) for x in (tmp_path / "searches").read_text().splitlines()]


def test_memory_and_search_each_once(spark, tmp_path):
    rows, prompts, searches = ask_loop(spark, tmp_path)
    assert sorted((r.query_id, r.answer, r.sources) for r in rows) == [(1, "both", [5, 6]), (2, "at once", [5])]
    # The easy question is asked once; the hard one with short memory, long memory, and what the search found.
    assert Counter(p.split(" doc")[0].replace("\n\n", ": ") for p in prompts) == {"short memory: easy": 1, "short memory: hard": 1, "long memory: hard": 2}
    assert searches == [["easy", "hard"], ["second"]]


def test_answers_with_contexts(spark, tmp_path):
    rows, _, _ = ask_loop(spark, tmp_path, contexts=True)
    assert sorted((r.query_id, r.question, r.answer, r.contexts) for r in rows) == [(1, "hard", "both", ["five", "six"]), (2, "easy", "at once", ["five"])]


# --- repair ---

def damaged(seed, n):
    """(kind, damaged text, what it stood for) of random JSON objects."""
    rng = random.Random(seed)

    def value(depth=0):
        k = rng.randint(0, 7 if depth < 3 else 4)
        if k < 2:
            return rng.choice([rng.randint(-99, 99), 1.5, True, False, None])
        if k < 5:
            return "".join(rng.choices(["a", "word ", "é", "日本", "1", ". ", "!", ", "], k=rng.randint(0, 8)))
        return [value(depth + 1) for _ in range(rng.randint(0, 4))] if k == 5 else {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 4))}

    for _ in range(n):
        v = {"answer": "some text " + str(rng.random()), "x": value()}
        t = json.dumps(v, ensure_ascii=False, indent=rng.choice([None, 1]))
        at = rng.choice([i for i, c in enumerate(t) if c in "}]"])
        yield "intact", t, v
        yield "comma", t[:at] + "," + t[at:], v
        yield "end", t.rstrip("}] \n"), v
        yield "missing comma", t.replace(', "x"', ' "x"').replace(',\n "x"', '\n "x"'), v
        yield "quotes", t.replace('"answer"', "“answer”"), v
        for kind, new in (("backslash", "some \\q text"), ("inner", 'some "quoted" text'), ("newline", "some\ntext"), ("tab", "some\ttext")):
            yield kind, t.replace("some text", new), dict(v, answer=v["answer"].replace("some text", new))


def test_damaged_replies_are_recovered():
    good, every = Counter(), Counter()
    for kind, text, meant in damaged(1, 800):
        fixed = parsing.mend_json(text)
        if kind == "intact":
            assert fixed == text
        every[kind] += 1
        try:
            found = json.loads(fixed)
        except ValueError:
            continue
        # What was cut off at the end may lack an empty list or object.
        good[kind] += found == meant or (kind == "end" and found["answer"] == meant["answer"])
    assert all(good[k] >= 0.95 * every[k] for k in every), (good, every)


def test_repair_in_columns(spark):
    texts = ['{"answer": "a "b" c", "sources": [1,]', '{"answer": "ok", "sources": ["2"]}', "text", None, "{'answer': 'don't', 'needs_additional_memory': True}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parsing.answer_payload(F.col("t"), F.lit(3)).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    assert (got[0].answer, got[0].sources) == ('a "b" c', [1]) and (got[1].answer, got[1].sources) == ("ok", [2]) and got[2] is None and got[3] is None
    assert (got[4].answer, got[4].needs_additional_memory) == ("don't", True)


# --- feeds ---

def test_the_first_of_repeated_entries_stays(spark, tmp_path):
    entry = '<entry><id>{}</id><title>{}</title><link href="/{}"/></entry>'
    for name, titles in (("a.xml", ["first", "second"]), ("b.xml", ["third"])):
        (tmp_path / name).write_text("<feed>" + "".join(entry.format("same", t, t) for t in titles) + entry.format(name, "own", "x") + "</feed>")
    rows = read_feed(spark, str(tmp_path), "http://h/").collect()
    assert sorted((r.entry_id, r.title) for r in rows) == [("a.xml", "own"), ("b.xml", "own"), ("same", "first")]
    with pytest.warns(UserWarning, match="2 pages read"):
        assert len(list(pages_of(lambda u: ("", u + "x"), "http://h/", 2))) == 2
