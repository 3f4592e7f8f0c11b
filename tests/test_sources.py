import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.plans.models import FirstSentences, HashEmbedder, embed_with, propositions, summaries
from tessera.schemas import identity_key, lookup_key
from tessera.sources import chunks as C
from tessera.sources.chat import ChatSource
from tessera.sources.web import FeedSource, html_text, pages_of, read_feed, text_of_html
from tessera.streaming import transcripts as S

PAGES = {"u1": ("one", "u2"), "u2": ("two", "u1")}


def fetch(url):
    return PAGES[url]


def client(channel, after, limit):
    return [{"message_id": i, "text": f"{channel}{i}"} for i in range(1, 8) if i > after][:limit]


def test_html():
    page = "<p>One &amp; two</p><script>x<p>y</p></script><div class='my-Comments'><div>no<br></div>no</div><nav>n</nav>three<br/>four<style>z"
    assert [x for x in text_of_html(page).split("\n") if x] == ["One & two", "three", "four"]
    assert text_of_html(None) == ""


def test_html_column(spark):
    df = spark.createDataFrame([("<p> a </p>\n\n\n<p>b</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(html_text(F.col("h"))).collect()] == ["a\n\nb", ""]


def test_chunk_files(spark, tmp_path):
    lines = [
        {"text": "alpha", "metadata": {"source_type": "docs", "drive_file_id": "d1", "chunk_id": "5", "chunk_stage": "x", "other": 3, "guild_id": ""}},
        {"text": "beta", "metadata": None},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    rows = C.read_chunks(spark, str(tmp_path)).orderBy("text").collect()
    assert rows[0].chunk_id == 5 and rows[0].extra == {"other": "3"} and rows[0].guild_id is None and rows[1].extra == {}
    df = C.read_chunks(spark, str(tmp_path)).orderBy("text")
    keys = df.select(lookup_key().alias("l"), identity_key().alias("i")).collect()
    assert keys[0].l.source == "d1" and keys[1].l is None and keys[1].i.content == "beta" and keys[0].i.content is None
    for bad in ('{"text": 5}', "{", '{"text": "x", "metadata": [1]}'):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match="not a chunk"):
            C.read_chunks(spark, str(tmp_path)).collect()
    (tmp_path / "b.jsonl").unlink()
    out = str(tmp_path / "table")
    C.write_chunks(C.chunk_rows(df), out)
    assert C.corpus(spark, out, [["nope"], ["x"]], ["docs"]).count() == 1 and C.corpus(spark, out, [["nope"]], ["docs"]).count() == 0
    C.export_chunks(C.chunk_rows(df), str(tmp_path / "export"))
    assert C.read_chunks(spark, str(tmp_path / "export")).count() == 2


def test_texts_and_sidecars(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d1__a.md").write_text("hello")
    (tmp_path / "b.CSV").write_text("x")
    (tmp_path / "c.bin").write_text("y")
    files = C.read_texts(spark, str(tmp_path), [".md", ".csv"])
    assert sorted(r.name for r in files.collect()) == ["b.CSV", "d1__a.md"]
    side = files.select(F.concat("path", F.lit(".meta.json")).alias("path"), F.when(F.col("name") == "b.CSV", '{"drive_file_id": "z", "hatenablog_url": 3, "x": 1}').otherwise("broken").alias("json"))
    assert sorted(r.drive_file_id for r in C.with_sidecars(files, side).collect()) == ["d1", "z"]
    with pytest.raises(Exception):
        C.read_texts(spark, str(tmp_path / "none"), [".md"]).collect()
    day, label = C.meeting_of(F.col("p"))
    assert tuple(spark.createDataFrame([("/x/2024-05-01_02/03.txt",)], "p string").select(day, label).first()) == ("2024-05-01", "2024-05-01 #2")


def test_numbered(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    assert sorted((r.k, r.ord) for r in C.numbered(df, ["k"]).collect()) == [(i, i) for i in range(500)]


def test_eval_items(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"question": "q", "ground_truth": "t"}\n{"query": "r", "ground_truths": ["a", "b"]}\n{"query": "s"}\n')
    rows = {r.question: r.ground_truths for r in C.read_eval_items(spark, str(tmp_path)).collect()}
    assert rows == {"q": ["t"], "r": ["a", "b"], "s": []}
    (tmp_path / "e.jsonl").write_text('{"x": 1}\n')
    with pytest.raises(Exception, match="evaluation item"):
        C.read_eval_items(spark, str(tmp_path)).collect()


def test_index_metadata(spark, tmp_path):
    path = str(tmp_path / "m")
    assert C.check_index_metadata(spark, path, "m", 3) == []
    C.write_index_metadata(spark, path, "m", 3)
    assert C.check_index_metadata(spark, path, "m", 3) == [] and len(C.check_index_metadata(spark, path, "n", 3)) == 1
    with pytest.raises(ValueError):
        C.check_index_metadata(spark, path, "m", 4)


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>T</title><link rel="edit" href="e"/>'
        '<link rel="alternate" href="a"/><published>2024</published><content type="html">&lt;p&gt;x&lt;/p&gt;</content></entry>'
        "<entry><id>1</id><title>again</title><link href='b'/></entry><entry><id>2</id><title>no link</title></entry></feed>"
    )
    rows = read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert len(rows) == 1 and rows[0].entry_id == "1" and rows[0].url in ("a", "b")
    assert [u for u, _ in pages_of(fetch, "u1")] == ["u1"] or [b for _, b in pages_of(lambda u: PAGES[u[-2:]], "u1")]


def test_sources(spark):
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(ChatSource)
    import sys
    from pathlib import Path

    spark.sparkContext.addPyFile(str(Path(__file__)))
    sys.modules.setdefault("test_sources", sys.modules[__name__])
    pages = spark.read.format("feed").option("url", "u1").option("fetcher", "test_sources:fetch").load()
    assert sorted(r.body for r in pages.collect()) == ["one", "two"]


def test_chat_offsets():
    import sys

    sys.modules.setdefault("test_sources", sys.modules[__name__])
    reader = ChatSource({"client": "test_sources:client", "channels": "a,b", "batch": "3"}).streamReader(None)
    start = reader.initialOffset()
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    assert end == {"a": 3, "b": 3} and len(parts) == 2 and sum(len(list(reader.read(p))) for p in parts) == 6
    last = reader.latestOffset()
    assert [r[1] for p in reader.partitions(end, last) for r in reader.read(p)] == [4, 5, 6] * 2
    # All that lies between offsets is read, in batches, by a reader that starts anew.
    again = ChatSource({"client": "test_sources:client", "channels": "a,b", "batch": "3"}).streamReader(None)
    assert [r[1] for p in again.partitions(start, last) for r in again.read(p)] == [1, 2, 3, 4, 5, 6] * 2
    assert again.latestOffset()["a"] >= last["a"] and again.partitions(last, last) == []


def test_tags_of_html():
    for tag in "script style noscript template svg picture figure figcaption nav header footer aside form".split():
        assert text_of_html(f"a<{tag}>no<b>no</b></{tag}>b").replace("\n", "") == "ab", tag
    assert text_of_html("a<img alt='no'>b<source>c") == "abc"
    for tag in "article section div p li ul ol h1 h2 h3 h4 h5 h6 table tr td th blockquote pre".split():
        assert text_of_html(f"a<{tag}>b</{tag}>c").split("\n") == ["a", "b", "c"], tag
    assert text_of_html("<header>H</header>x<table><tr><td>a</td><td>b</td></tr></table>").split() == ["x", "a", "b"]


def test_formats_of_files(spark, tmp_path):
    sample = {"text": "alpha beta", "metadata": {"source_type": "docs", "source_file_name": "d1__x.md", "drive_file_id": "d1", "hatenablog_title": "T", "chunk_id": 0, "chunk_stage": "second_recursive", "parent_chunk_id": 0}}
    (tmp_path / "c.jsonl").write_text(json.dumps(sample))
    (row,) = C.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()
    assert (row.drive_file_id, row.hatenablog_title, row.chunk_id, row.extra) == ("d1", "T", 0, {})
    assert C.read_chunks(spark, str(tmp_path / "c.jsonl")).select(lookup_key().alias("l")).first().l.source == "d1"
    message = lambda **m: json.dumps({"text": m.pop("text"), "metadata": {"channel_id": "9", "channel_name": "n", **m}})
    lines = [
        message(text="a", message_id="1", message_timestamp="2024-05-01T14:59:59+00:00", author_name="Ann"), "", message(text="b", chunk_id=7, author_name=""),
        message(text="c", message_id="3", message_timestamp="2024-05-01T15:00:00", author_name="Bob"),
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    from tessera.operators.messages import message_chunks

    read = C.read_messages(spark, str(tmp_path / "m.jsonl"))
    assert [(r.message_id, r.author) for r in read.orderBy("seq").collect()] == [("1", "Ann"), ("7", "unknown"), ("3", "Bob")]
    (chunk,) = message_chunks(read).collect()
    assert (chunk.text, chunk.first_message_id, chunk.first_message_date) == ("Ann: a\nunknown: b\n2024/05/02\nBob: c", "1", "2024/05/01")


def test_writers(spark, tmp_path):
    out = str(tmp_path)
    C.write_manifest(spark.createDataFrame([("o", "s", 1, 2)], "output string, source_path string, src_mtime long, done_mtime long"), f"{out}/manifest")
    C.write_manifest(spark.createDataFrame([("o", "s", 5, 6)], "output string, source_path string, src_mtime long, done_mtime long"), f"{out}/manifest")
    assert spark.read.parquet(f"{out}/manifest").count() == 2
    chunks = spark.createDataFrame([(1, "x"), (2, " ")], "doc_id long, text string")
    assert C.write_vectors(chunks, lambda d: d.withColumn("embedding", F.array(F.lit(1.0))), f"{out}/v") and spark.read.parquet(f"{out}/v").count() == 1
    assert not C.write_vectors(chunks.where("false"), lambda d: d, f"{out}/none") and not (tmp_path / "none").exists()
    records = spark.createDataFrame([("q", "a", ["c, d"], ["g"]), ("r", "b", [], [])], "question string, answer string, contexts array<string>, ground_truths array<string>")
    C.write_evaluation(records, f"{out}/e")
    C.write_evaluation(records, f"{out}/csv", "csv")
    assert sorted((r.question, r.ground_truth) for r in spark.read.json(f"{out}/e").collect()) == [("q", "g"), ("r", "")]
    assert spark.read.option("header", True).csv(f"{out}/csv").count() == 2
    rows = spark.createDataFrame([("t", s) for s in ("a", "b")], "text string, chunk_stage string")
    C.write_chunks(C.chunk_rows(rows), f"{out}/table")
    assert C.reset_stages(spark, f"{out}/table", ["a", "zzz"]) == 1 and [r.stage for r in spark.read.parquet(f"{out}/table").collect()] == ["b"]
    lines = spark.createDataFrame([("2024-05-01_01", 2, 3.0, "a", "x", "l2"), ("2024-05-01_01", 2, 1.0, "b", "y", "l1")], "meeting_key string, transcript_index int, offset double, user_name string, text string, line string")
    C.write_transcripts(lines, f"{out}/tr")
    assert [r.value for r in spark.read.text(f"{out}/tr").collect()] == ["l1", "l2"]
    (tmp_path / "m" / "2024-05-01_02").mkdir(parents=True)
    (tmp_path / "m" / "2024-05-01_02" / "03.txt").write_text("00:00:01 a: b")
    assert [tuple(r)[:4] for r in C.read_transcripts(spark, f"{out}/m").collect()] == [("2024-05-01_02", 3, "2024-05-01", "2024-05-01 #2")]


def test_queue_and_feed_pages():
    from tessera.sources.web import next_page

    q = S.JobQueue()
    for j in (1, 2):
        q.put(j)
    first = q.take()
    q.paused = True
    assert first == 1 and q.take() is None
    q.again(first)
    q.paused = False
    assert [q.take(), q.take(), q.take()] == [1, 2, None]
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><link rel='alternate' href='/'/><link rel='next' href='?p=2'/><entry><link rel='next' href='no'/></entry></feed>"
    assert next_page(feed) == "?p=2" and next_page("<feed/>") is None


def test_transcribe():
    one = lambda at, n=1.0: (at, n, b"x", "Ann")
    events = pd.DataFrame([one(0.5), one(10.0), one(12.0), one(14.1, 0.2), one(20.0, 0.3)], columns=["offset_seconds", "duration_seconds", "pcm", "user_name"])
    lines = S.transcribe(events, 5.0, lambda pcm: [(None, f"{len(pcm)} "), (0.5, " ")])
    # A gap of exactly a second joins; the late event and the short block are gone.
    assert lines.values.tolist() == [[10.0, "Ann", "2"]]


def test_mono():
    pcm = np.array([[16384, -16384], [32767, 32767]], dtype="<i2").tobytes()
    assert np.allclose(S.mono(pcm, 2, 8000, 8000), [0.0, 32767 / 32768]) and len(S.mono(pcm, 2, 8000, 16000)) == 4 and len(S.mono(b"", 1, 1, 2)) == 0


def test_transcript_order(spark):
    spoken = spark.createDataFrame([(9.0, "b", "hi"), (3.0, "a", "x")], "offset double, user_name string, text string")
    chat = spark.createDataFrame([("c", 1.0, "typed")], "user_name string, offset_seconds double, text string")
    assert [r.line for r in S.transcript(spoken, chat, 2.0).collect()] == ["00:00:02 c: typed", "00:00:03 a: x", "00:00:09 b: hi"]


def _stream(spark, tmp_path, rows, schema, plan, name, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    df = plan(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_thresholds(spark, tmp_path):
    rows = [("m", 1, "a", 50.0, False), ("m", 2, "b", 20.0, False), ("m", 3, "c", 240.0, False), ("m", 4, "d", 10.0, True)]
    schema = "meeting_key string, transcript_index int, text string, seconds double, is_final boolean"
    got = _stream(spark, tmp_path, rows, schema, S.threshold_jobs, "jobs")
    assert sorted(map(tuple, got)) == [("m", 2, "end_check", "a\nb"), ("m", 3, "end_check", "c"), ("m", 3, "summary", "a\nb\nc"), ("m", 4, "summary", "d")]


def test_memory(spark, tmp_path):
    rows = [("s", i, f"u{i}", f"a{i}" if i != 2 else "") for i in range(8)]
    got = _stream(spark, tmp_path, rows, "scope string, seq int, user string, assistant string", lambda d: S.remember(d, 3), "memory", "update")
    assert got[-1].history == "\n".join(f"user: u{i}\nassistant: a{i}" for i in (5, 6, 7))


def test_blocks(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 0.5), (1, "2024-01-01 00:00:01", 0.5), (1, "2024-01-01 00:00:03", 0.5), (2, "2024-01-01 00:01:00", 0.5)]
    df = spark.createDataFrame(rows, "user_id long, t string, duration_seconds double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.user_id, r.n) for r in S.blocks(df).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_append_once(spark, tmp_path):
    sink = S.append_once(str(tmp_path / "out"))
    batch = spark.createDataFrame([("m", 1, "summary", "x"), ("m", 1, "summary", "x")], "meeting_key string, transcript_index int, kind string, texts string")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_models(spark):
    first = spark.createDataFrame([(1, 0, "Some text. More."), (2, 0, "")], "doc_id long, chunk_id long, text string")
    got = summaries(first, FirstSentences()).collect()
    assert {r.text for r in got} >= {"Some text. More."} and all(r.parent_chunk_id == 0 for r in got)

    class Lists:
        def generate(self, prompt):
            if "fail" in prompt:
                raise RuntimeError
            return '["a", "b"]'

    second = spark.createDataFrame([(1, 4, "x"), (2, 5, "fail")], "doc_id long, chunk_id long, text string")
    assert sorted((r.doc_id, r.parent_chunk_id, r.text) for r in propositions(second, Lists()).collect()) == [(1, 4, "a"), (1, 4, "b")]
    vectors = embed_with(first, HashEmbedder(8)).collect()
    assert all(len(r.embedding) == 8 for r in vectors)
