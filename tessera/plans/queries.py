"""The registered queries of retrieval and text preparation, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.parsing import json_object
from tessera.functions.settings import question_of
from tessera.operators import ivf
from tessera.operators.clusters import cluster_silhouettes, level
from tessera.operators.dense import nearest
from tessera.operators.folds import common_or_mixed, metric_means, pack_tokens, pending
from tessera.operators.filters import allowed, best_score, counters, of_kinds, one_export, with_cached_scores
from tessera.operators.lattice import analyser_terms, frequency_dictionary
from tessera.operators.messages import dated, gap_sessions, joined_lines, latest_name, lines, message_chunks
from tessera.operators.parents import append_parents, expand, first_of, fresh, newest, restore, root_parent, stale
from tessera.operators.ranking import cap_parents, cited, diversify, last_n, merge, overlap_score, quota_merge, rerank
from tessera.operators.sparse import both_searches, build_index, query_terms, search, staged_terms
from tessera.operators.split import first_in_span, first_level, second_level
from tessera.plans.retrieve import context, embedding_text, retrieve, source_url, with_parents
from tessera.session import kept
from tessera.sources.web import html_text
from tessera.streaming.transcripts import blocks, cut, due_once_a_day, final_jobs, in_schedule, meeting_keys


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark, sf_dir):
    """Each benchmark item is a question, with its whole text."""
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(spark, sf_dir):
    """Each vector whose id is divisible by 50 is a query."""
    return _vectors(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")


def _index(spark, sf_dir, k1=1.5, b=0.75):
    """The index of documents, built and saved by the query that asks for it."""
    return build_index(_docs(spark, sf_dir), k1, b).kept()


def _bm25(spark, sf_dir, index=None, k=20):
    return search(index or _index(spark, sf_dir), query_terms(_questions(spark, sf_dir)), k)


def term_document_frequency(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df")


def bm25_idf_floor(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


def dense_topk(spark, sf_dir):
    return nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20)


def ivf_exact_topk(spark, sf_dir):
    """The nearest vectors through the inverted file, the lists that can still matter included."""
    return ivf.search(ivf.build(_vectors(spark, sf_dir)), _vector_queries(spark, sf_dir), 20, exact=True)


def ivf_recall(spark, sf_dir):
    """How much of the true 20 nearest the inverted file finds with its own margin: one row, recall_ok from 0.95 on."""
    queries = _vector_queries(spark, sf_dir)
    truth = nearest(_vectors(spark, sf_dir), queries, 20).select("query_id", "doc_id", F.lit(1).alias("true"))
    found = ivf.search(ivf.build(_vectors(spark, sf_dir)), queries, 20).select("query_id", "doc_id", F.lit(1).alias("hit"))
    both = truth.join(found, ["query_id", "doc_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_true"), (F.count("hit") / F.count("*") >= 0.95).alias("recall_ok"))


def label_silhouette(spark, sf_dir):
    """The mean silhouette of each label's vectors, by sums of clusters."""
    rows = _vectors(spark, sf_dir).select("embedding", F.col("label").alias("cluster"))
    return cluster_silhouettes(rows).select(F.col("cluster").alias("label"), "n", F.round("silhouette", 6).alias("silhouette"))


def analysed_terms(spark, sf_dir):
    """Terms of documents by the lattice analyser, whose words and costs come from the documents: term, df."""
    docs = _docs(spark, sf_dir)
    terms = analyser_terms(spark, frequency_dictionary(docs), stop=frozenset({"stop"}))
    # The analyser is dearer than a shuffle of the texts, which a table of few row groups needs to be worked on by all cores.
    docs = docs.repartition("doc_id")
    return build_index(docs, terms=terms).kept().terms.select("term", "df")


def dense_topk_filtered(spark, sf_dir):
    return nearest(_vectors(spark, sf_dir).where(F.col("label").isin(1, 2, 3)), _vector_queries(spark, sf_dir), 20)


def _item_vectors(spark, sf_dir):
    items = _questions(spark, sf_dir).select("query_id")
    return items.join(_vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), "query_id").select("query_id", "embedding")


def hybrid_merge(spark, sf_dir):
    dense = nearest(_vectors(spark, sf_dir), _item_vectors(spark, sf_dir), 20)
    return merge(dense, _bm25(spark, sf_dir))


def quota_merge_lists(spark, sf_dir):
    index = _index(spark, sf_dir)
    return quota_merge(_bm25(spark, sf_dir, index), _bm25(spark, sf_dir, index.with_parameters(1.2, 0.5)), 20, 12)


def parent_cap(spark, sf_dir):
    source = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return cap_parents(kept(_bm25(spark, sf_dir)).join(source, "doc_id"), F.col("source"), 2).select("query_id", "doc_id", "rank")


def rerank_order(spark, sf_dir):
    # Saved, the hits are known to be few, so no text of another document moves.
    full = kept(_bm25(spark, sf_dir)).join(_docs(spark, sf_dir), "doc_id").join(_questions(spark, sf_dir).withColumnRenamed("text", "q"), "query_id")
    return rerank(full, overlap_score(F.col("q"), F.col("text"))).select("query_id", "doc_id", "rerank_score", "rank")


def mmr_select(spark, sf_dir):
    ranked = dense_topk(spark, sf_dir)
    v = _vectors(spark, sf_dir).select("doc_id", "embedding")
    q = _vector_queries(spark, sf_dir).select("query_id", F.col("embedding").alias("query_embedding"))
    return diversify(ranked.join(v, "doc_id").join(q, "query_id"), 5, 0.5)


def parent_expand(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hits = turns.where("turn % 3 = 2").select("conv_id")
    summaries = turns.where("role = 'assistant' and turn < 2").select("conv_id", "turn", F.lit("summary").alias("kind"))
    firsts = turns.where("turn = 0").select("conv_id", "turn", F.lit("first").alias("kind"))
    return expand(hits, summaries, firsts, ["conv_id"])


def message_lines(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return lines(turns, "conv_id", "turn", "role")


def date_separators(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    # Every seventh event has lost its time and is dated by the one before.
    events = events.withColumn("date", F.when(F.col("event_id") % 7 != 0, T.local_date(F.col("ts"))))
    return dated(events, "user_id", ["event_id"]).select("user_id", "event_id", "filled_date", "new_date")


def span_first_message(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = lines(turns, "conv_id", "turn", "role")
    ends = own.groupBy("conv_id").agg(F.max(F.col("start") + F.length("line")).alias("total"))
    spans = ends.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 200))).alias("span_id"), "total")
    spans = spans.select("conv_id", "span_id", (F.col("span_id") * 200).alias("start"), F.least(F.col("span_id") * 200 + 200, "total").alias("end"))
    # Messages with an even turn have no id.
    marked = own.select("conv_id", "start", F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("message"))
    return first_in_span(spans, marked, "conv_id", "message").select("conv_id", "span_id", "message")


def gap_sessions_of_users(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = gap_sessions(events.withColumn("until", F.col("at")), "user_id", "at", "until", 30 * 60 * 1_000_000, "event_id")
    return found.groupBy("user_id", "session").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


def token_pack(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_count(F.col("text")).alias("tokens"))
    return pack_tokens(turns, "conv_id", ["turn"], "tokens", 128)


def common_or_mixed_columns(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return common_or_mixed(docs.withColumn("n_lines", (F.size(F.split("text", "\n"))).cast("string")), ["source", "toxic"], ["lang", "n_lines"])


def latest_name_of_users(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return latest_name(events.withColumn("day", F.date_trunc("day", "ts")), "user_id", "event_type", "day", "event_id")


def stale_outputs(spark, sf_dir):
    return stale(_docs(spark, sf_dir).select("doc_id"), _table(spark, sf_dir, "labels"), "doc_id")


def fresh_inputs(spark, sf_dir):
    inputs = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("src_mtime"))
    sizes = inputs.withColumnRenamed("src_mtime", "n")
    done = _table(spark, sf_dir, "labels").join(sizes, "doc_id").select("doc_id", (F.col("n") - F.col("quality")).alias("done_mtime"))
    return fresh(inputs, done, "doc_id").select("doc_id", "src_mtime", "done_mtime")


def url_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_urls(F.concat("url", F.lit(" x "), "html")).cast("binary")).alias("text_md5"))


def mention_mask(spark, sf_dir):
    body = F.concat(F.lit("<@"), F.col("user_id").cast("string"), F.lit("> "), "event_type", F.lit(" <@&7>"))
    return _table(spark, sf_dir, "events").select("event_id", T.mask_mentions(body).alias("text"), F.element_at(T.mentions(body), 1).alias("first"))


def html_text_of_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def symbol_filter(spark, sf_dir):
    marks = F.filter(F.split("text", "[ \\t\\n\\r\\x0b\\x0c]+"), T.is_symbol_only)
    return _docs(spark, sf_dir).select("doc_id", F.size(marks).cast("long").alias("n_symbol_tokens"), F.size(F.array_distinct(marks)).cast("long").alias("n_distinct"))


def chunk_first(spark, sf_dir):
    return first_level(_docs(spark, sf_dir))


def chunk_second(spark, sf_dir):
    return second_level(first_level(_docs(spark, sf_dir)))


def history_last_n(spark, sf_dir):
    return last_n(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", 5)


def json_payload(spark, sf_dir):
    reply = F.concat(F.lit("Here: "), "props", F.lit(" ."))
    k = F.get_json_object(json_object(reply), "$.k").cast("long")
    return _table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 1).alias("odd"))


def source_refs(spark, sf_dir):
    docs, pages = _table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "pages")
    joined = docs.join(pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit("spreadsheet")).otherwise(F.lit("document"))
    ref = source_url(F.lit(None).cast("string"), F.col("url"), F.col("source"), kind, F.lit(""))
    return joined.select(ref.alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def pending_fold(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.abs(F.round("value")).alias("seconds"))
    return pending(events, "user_id", ["event_id"], "seconds", 300.0, 60.0)


def metric_mean(spark, sf_dir):
    return metric_means(_table(spark, sf_dir, "labels").select("quality", "toxic"))


def raptor_level(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("doc_id").alias("id"), "embedding").join(
        _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), T.token_count(F.col("text")).alias("tokens")), "id"
    )
    return level(rows)


def keyword_normalize(spark, sf_dir):
    reply = F.regexp_replace("text", " ", "、")
    return _table(spark, sf_dir, "benchmark").select("item_id", T.keyword_query(reply).alias("keywords"))


def retrieve_hybrid(spark, sf_dir):
    """The whole chain for each benchmark item, with its vector if it has one: both lists, rerank, cap, pool, diversity."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("parent"))
    chunks = docs.join(_vectors(spark, sf_dir).select("doc_id", "embedding"), "doc_id", "left")
    queries = _questions(spark, sf_dir).join(_item_vectors(spark, sf_dir), "query_id", "left")
    return retrieve(queries, chunks, _index(spark, sf_dir))


def _md5(text):
    return F.md5(text.cast("binary"))


def best_score_of_users(spark, sf_dir):
    return best_score(_table(spark, sf_dir, "events").select("user_id", "event_type", F.round("value", 6).alias("score")), ["user_id", "event_type"])


def source_counters(spark, sf_dir):
    return counters(_table(spark, sf_dir, "documents"), sources="source", langs="lang")


def allow_list(spark, sf_dir):
    readable = _table(spark, sf_dir, "labels").where("toxic = 0")
    return allowed(_table(spark, sf_dir, "documents").select("doc_id", "lang"), ["en", "de"], "lang", readable, "doc_id")


def mime_filter(spark, sf_dir):
    lang, base = F.col("lang"), "application/vnd.google-apps."
    mime = F.when(lang == "en", base + "document").when(lang == "fr", base + "spreadsheet").when(lang == "de", "image/png")
    return of_kinds(_table(spark, sf_dir, "documents").select("doc_id", mime.alias("mime")))


def score_cache(spark, sf_dir):
    cache = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    pairs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    found = with_cached_scores(pairs, cache, ["doc_id"], F.round(F.least(F.lit(1.0), F.col("n_chars") / 1000), 6))
    return found.select("doc_id", "score", "cached")


def restored_text(spark, sf_dir):
    hits = _docs(spark, sf_dir).withColumn("chunk_id", F.col("doc_id") % 60)
    originals = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    out = restore(hits, originals, ["chunk_id"], F.col("doc_id") % 2 == 0, ["text"])
    return out.select("doc_id", _md5(F.col("text")).alias("text_md5"))


def root_parents(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    second = docs.select("source", F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10).alias("parent_chunk_id"))
    stage = F.when(F.col("doc_id") % 2 == 0, F.lit("proposition")).otherwise(F.lit("second_recursive"))
    hits = docs.select("doc_id", "source", stage.alias("chunk_stage"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1).alias("parent_chunk_id"))
    return root_parent(hits, second).select("doc_id", "parent_id")


def first_match(spark, sf_dir):
    return first_of(_table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["n_chars", "doc_id"])


def cited_sources(spark, sf_dir):
    ranked = dense_topk(spark, sf_dir)
    numbers = ranked.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(n) for n in (7, 3, 12, 3, 15, 99)])).alias("source"))
    return cited(ranked, numbers).select("query_id", "doc_id", "place")


def parents_appended(spark, sf_dir):
    ranked = dense_topk(spark, sf_dir)
    return append_parents(ranked.where("rank <= 5"), ranked.select("query_id", (F.col("doc_id") % 40).alias("doc_id"), "rank"))


def newest_files(spark, sf_dir):
    files = _table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("name"), F.date_trunc("hour", "ts").alias("mtime"), F.col("event_id").alias("path")
    )
    return newest(files).select("name", "path")


def left_over_exports(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("path"), (F.length("source") * 10).cast("long").alias("keep"))
    return one_export(files.withColumn("path", F.format_string("%09d", "path")).withColumn("keep", F.format_string("%09d", "keep")), "source", "keep")[1].select("source", "path")


def event_blocks(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.abs("value"), 3).alias("duration_seconds"))
    found = blocks(events, gap="1 hour")
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("seconds", 3).alias("seconds"))


def turn_history(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return joined_lines(turns, ["conv_id"], ["turn"]).select("conv_id", _md5(F.col("text")).alias("text_md5"))


def event_clock(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", T.clock(F.col("event_id") * 7.5).alias("at"))


def schedule_filter(spark, sf_dir):
    return _table(spark, sf_dir, "events").where(in_schedule(F.col("ts").cast("timestamp"), [0, 2, 4], 600, 180)).select("event_id")


def daily_trigger(spark, sf_dir):
    checks = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"))
    return due_once_a_day(checks, [0, 1, 2, 3, 4], 540).select("day", F.unix_micros("at").alias("at"))


def _meeting_dates(spark, sf_dir):
    date = F.format_string("2024-01-%02d", F.col("conv_id") % 28 + 1)
    return _table(spark, sf_dir, "conversations").select("conv_id", date.alias("date")).distinct()


def meeting_numbers(spark, sf_dir):
    own = _meeting_dates(spark, sf_dir)
    taken = own.where("conv_id % 4 = 0").select("date", (F.col("conv_id") % 5).alias("number"))
    return meeting_keys(own.where("conv_id % 4 > 0").select(F.col("conv_id").alias("meeting_id"), "date"), taken).select("meeting_id", "meeting_key")


def window_cut(spark, sf_dir):
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("audio")).otherwise(F.lit("chat"))
    events = _table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_id") % 1000).cast("double").alias("offset_seconds"))
    own, waiting = cut(events, 200.0, 600.0)
    return own.select("event_id", "offset_seconds", F.lit(False).alias("waits")).unionByName(waiting.select("event_id", "offset_seconds", F.lit(True).alias("waits")))


def end_markers(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    meetings = turns.groupBy(F.col("conv_id").alias("meeting_key")).agg(F.max("turn").cast("int").alias("last_index"))
    last = turns.where("turn = 5").select(F.col("conv_id").alias("meeting_key"), F.col("turn").cast("int").alias("transcript_index"), "text", F.lit(2.5).alias("seconds"))
    return final_jobs(meetings, last)


def staged_terms_of_documents(spark, sf_dir):
    stage = F.when(F.col("doc_id") % 2 == 0, F.lit("second_recursive_sparse"))
    return _docs(spark, sf_dir).select("doc_id", F.size(staged_terms(F.col("text"), stage)).cast("long").alias("n"))


def transformed_search(spark, sf_dir):
    """Each question, and as what a model made of it the text of the item after it."""
    asked = _questions(spark, sf_dir)
    changed = asked.select((F.col("query_id") - 1).alias("query_id"), "text")
    return both_searches(_index(spark, sf_dir), asked, changed)


def asked_messages(spark, sf_dir):
    turn, text = F.col("turn"), F.col("text")
    message = F.when(turn % 3 == 0, F.concat(F.lit("<@!42> "), text)).when(turn % 3 == 1, F.concat(F.lit("!ask "), text)).otherwise(text)
    asked = question_of(message, F.lit("42"), F.lit("!ask"), F.col("conv_id") % 2 == 0)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("question")).where("question is not null")


def _with_pages(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return _table(spark, sf_dir, "documents").join(pages, "doc_id", "left")


def context_lines(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("vc", "blog", "messages", "docs")]), (F.col("doc_id") % 4 + 1).cast("int"))
    lang = F.col("lang")
    shown = context(F.col("text"), kind, F.col("url"), F.col("source"), F.col("source"), lang, lang)
    return _with_pages(spark, sf_dir).select("doc_id", _md5(shown).alias("text_md5"))


def embedding_lines(spark, sf_dir):
    shown = embedding_text(F.col("text"), [("source", F.col("source")), ("url", F.col("url"))])
    return _with_pages(spark, sf_dir).select("doc_id", _md5(shown).alias("text_md5"))


def chat_chunks(spark, sf_dir):
    """Conversations as channels: a message every seven hours, by its role, cut into chunks with their first message and date."""
    turns = _table(spark, sf_dir, "conversations")
    hours = (F.col("conv_id") * 24 + F.col("turn") * 7) * 3600
    return message_chunks(
        turns.select(
            F.col("conv_id").alias("channel_id"), F.col("turn").alias("seq"), F.col("turn").cast("string").alias("message_id"),
            F.when(F.col("turn") % 3 < 2, F.timestamp_seconds(hours)).alias("ts"), F.col("role").alias("author"), "text",
        ), 300, 50,
    )


def parents_of_hits(spark, sf_dir):
    """Each document asks and finds its first three second-level chunks; their first-level chunks follow."""
    docs = _docs(spark, sf_dir)
    # Both levels are saved: the joins below read them several times, and would split all texts anew each time.
    # Their stage stays a constant of the plan, so joins with stages that no chunk has fall away.
    saved = lambda chunks, stage: kept(chunks.drop("chunk_stage")).withColumnRenamed("doc_id", "source").withColumn("chunk_stage", F.lit(stage))
    first = saved(first_level(docs.select("doc_id", "text")), "first_recursive")
    second = saved(second_level(first.withColumnRenamed("source", "doc_id")), "second_recursive")
    number = lambda kind: F.xxhash64(F.lit(kind), "source", "chunk_id")
    chunks = first.select(number("1").alias("doc_id"), "source", "chunk_stage", "chunk_id", F.lit(None).cast("long").alias("parent_chunk_id"), "text")
    chunks = chunks.unionByName(second.select(number("2").alias("doc_id"), "source", "chunk_stage", "chunk_id", "parent_chunk_id", "text"))
    hits = second.where("chunk_id < 3").select(F.col("source").alias("query_id"), number("2").alias("doc_id"), (F.col("chunk_id") + 1).cast("int").alias("rank"))
    return with_parents(hits, chunks).select("query_id", "rank", _md5(F.col("text")).alias("text_md5"))


QUERIES = {
    "best_score": best_score_of_users,
    "source_counters": source_counters,
    "allow_list": allow_list,
    "mime_filter": mime_filter,
    "score_cache": score_cache,
    "restored_text": restored_text,
    "root_parents": root_parents,
    "first_match": first_match,
    "cited_sources": cited_sources,
    "parents_appended": parents_appended,
    "newest_files": newest_files,
    "left_over_exports": left_over_exports,
    "event_blocks": event_blocks,
    "turn_history": turn_history,
    "event_clock": event_clock,
    "schedule_filter": schedule_filter,
    "daily_trigger": daily_trigger,
    "meeting_numbers": meeting_numbers,
    "window_cut": window_cut,
    "end_markers": end_markers,
    "staged_terms": staged_terms_of_documents,
    "transformed_search": transformed_search,
    "asked_messages": asked_messages,
    "context_lines": context_lines,
    "embedding_lines": embedding_lines,
    "chat_chunks": chat_chunks,
    "parents_of_hits": parents_of_hits,
    "term_document_frequency": term_document_frequency,
    "bm25_idf_floor": bm25_idf_floor,
    "bm25_topk": bm25_topk,
    "dense_topk": dense_topk,
    "ivf_exact_topk": ivf_exact_topk,
    "ivf_recall": ivf_recall,
    "label_silhouette": label_silhouette,
    "analysed_terms": analysed_terms,
    "dense_topk_filtered": dense_topk_filtered,
    "hybrid_merge": hybrid_merge,
    "quota_merge": quota_merge_lists,
    "parent_cap": parent_cap,
    "rerank_order": rerank_order,
    "mmr_select": mmr_select,
    "parent_expand": parent_expand,
    "message_lines": message_lines,
    "date_separators": date_separators,
    "span_first_message": span_first_message,
    "gap_sessions": gap_sessions_of_users,
    "token_pack": token_pack,
    "common_or_mixed": common_or_mixed_columns,
    "latest_name": latest_name_of_users,
    "stale_outputs": stale_outputs,
    "fresh_inputs": fresh_inputs,
    "url_strip": url_strip,
    "mention_mask": mention_mask,
    "html_text": html_text_of_pages,
    "symbol_filter": symbol_filter,
    "chunk_first": chunk_first,
    "chunk_second": chunk_second,
    "history_last_n": history_last_n,
    "json_payload": json_payload,
    "source_refs": source_refs,
    "pending_fold": pending_fold,
    "metric_mean": metric_mean,
    "raptor_level": raptor_level,
    "keyword_normalize": keyword_normalize,
    "retrieve_hybrid": retrieve_hybrid,
}

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"
_INDEX = rf"""
a AS MATERIALIZED (SELECT doc_id, {_TOK} AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM a),
p AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM a) GROUP BY term, doc_id),
f AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, s),
t AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM r) ELSE raw END AS idf FROM r)"""
_ASKED = rf"""
q AS MATERIALIZED (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY query_id, term)"""


def _found(name: str, k1: float = 1.5, b: float = 0.75, asked: str = "q") -> str:
    return f"""
{name}_s AS MATERIALIZED (SELECT query_id, doc_id, round(sum(times * idf * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avg_dl))), 6) AS score
  FROM {asked} JOIN t USING (term) JOIN p USING (term), s WHERE idf <> 0 GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM {name}_s WHERE score > 0) WHERE rank <= 20)"""


def _near(queries: str, where: str = "true") -> str:
    return f"""
v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
vq AS ({queries}),
d AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM (SELECT query_id, doc_id, round(list_cosine_similarity(qe, e), 6) AS score FROM vq, v WHERE {where})) WHERE rank <= 20)"""


_FIFTIETH = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 50 = 0"
_OF_ITEMS = "SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM benchmark JOIN embeddings ON vec_id = item_id"
_LINES = r"""
l0 AS (SELECT conv_id, turn, role, unnest(x) AS l, generate_subscripts(x, 1) AS pos FROM (SELECT *, string_split(text, chr(10)) AS x FROM conversations)),
l1 AS (SELECT conv_id, turn, pos, role || ': ' || trim(l, ' ' || chr(9) || chr(13)) AS line FROM l0 WHERE trim(l, ' ' || chr(9) || chr(13)) <> ''),
ln AS (SELECT conv_id, turn, row_number() OVER w - 1 AS line_no,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, line
  FROM l1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, pos))"""

_PAGED = "FROM documents LEFT JOIN pages ON page_id = doc_id"
SQL = {
    "best_score": "SELECT user_id, event_type, max(round(value, 6)) AS score FROM events GROUP BY user_id, event_type",
    "source_counters": "SELECT count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents",
    "allow_list": "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "mime_filter": """
SELECT doc_id, 'application/vnd.google-apps.' || CASE lang WHEN 'en' THEN 'document' ELSE 'spreadsheet' END AS mime FROM documents WHERE lang IN ('en', 'fr')""",
    "score_cache": """
SELECT d.doc_id, coalesce(CAST(max(quality) AS DOUBLE), round(least(1.0, any_value(n_chars) / 1000), 6)) AS score, max(quality) IS NOT NULL AS cached
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id""",
    "restored_text": """
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 AND b.text IS NOT NULL THEN b.text ELSE d.text END) AS text_md5
FROM documents d LEFT JOIN (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id) b ON item_id = doc_id % 60""",
    "root_parents": """
WITH h AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN doc_id ELSE doc_id - 1 END AS p FROM documents)
SELECT h.doc_id, CASE WHEN h.doc_id % 2 = 0 THEN s.doc_id % 10 ELSE p END AS parent_id FROM h LEFT JOIN documents s ON s.source = h.source AND s.doc_id = p""",
    "first_match": """
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents) WHERE i = 1""",
    "cited_sources": f"""WITH {_near(_FIFTIETH)},
c AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS place FROM d WHERE rank IN (3, 7, 12, 15))
SELECT * FROM c WHERE place <= 3""",
    "parents_appended": f"""WITH {_near(_FIFTIETH)},
u AS (SELECT query_id, doc_id, 0 AS l, rank AS pos FROM d WHERE rank <= 5 UNION ALL SELECT query_id, doc_id % 40, 1, -rank FROM d),
o AS (SELECT query_id, doc_id, min((l, pos)) AS k FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS rank FROM o""",
    "newest_files": """
WITH f AS (SELECT event_type || '_' || (user_id % 10) AS name, date_trunc('hour', ts) AS m, event_id AS path FROM events)
SELECT name, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY m DESC, path) AS i FROM f) WHERE i = 1""",
    "left_over_exports": """
WITH f AS (SELECT source, printf('%09d', doc_id) AS path, printf('%09d', length(source) * 10) AS keep FROM documents)
SELECT source, path FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path <> keep, path) AS i FROM f) WHERE i > 1""",
    "event_blocks": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, round(abs(value), 3) AS v FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n, round(sum(v), 3) AS seconds FROM s GROUP BY user_id, b""",
    "turn_history": "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
    "event_clock": """
WITH s AS (SELECT event_id, CAST(floor(event_id * 7.5) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS at FROM s""",
    "schedule_filter": """
WITH l AS (SELECT event_id, ts + INTERVAL 9 HOUR AS l FROM events)
SELECT event_id FROM l WHERE isodow(l) IN (1, 3, 5) AND hour(l) * 60 + minute(l) BETWEEN 600 AND 780""",
    "daily_trigger": """
WITH l AS (SELECT ts, ts + INTERVAL 9 HOUR AS l FROM events)
SELECT strftime(l, '%Y-%m-%d') AS day, epoch_us(min(ts)) AS at FROM l WHERE isodow(l) <= 5 AND hour(l) * 60 + minute(l) >= 540 GROUP BY strftime(l, '%Y-%m-%d')""",
    "meeting_numbers": """
WITH o AS (SELECT DISTINCT conv_id, printf('2024-01-%02d', conv_id % 28 + 1) AS date FROM conversations),
u AS (SELECT date, max(conv_id % 5) AS used FROM o WHERE conv_id % 4 = 0 GROUP BY date)
SELECT conv_id AS meeting_id, o.date || '_' || printf('%02d', coalesce(used, 0) + row_number() OVER (PARTITION BY o.date ORDER BY conv_id)) AS meeting_key
FROM o LEFT JOIN u ON o.date = u.date WHERE conv_id % 4 > 0""",
    "window_cut": """
WITH e AS (SELECT event_id, CAST(event_id % 1000 AS DOUBLE) AS o FROM events)
SELECT event_id, CASE WHEN o > 600 THEN o ELSE greatest(o, 200.0) END AS offset_seconds, o > 600 AS waits FROM e WHERE o > 600 OR o >= 200 OR event_id % 2 = 1""",
    "end_markers": """
WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, turn, text FROM conversations WHERE turn = 5)
SELECT m.conv_id AS meeting_key, CAST(coalesce(turn, last + 1) AS INTEGER) AS transcript_index, coalesce(text, '') AS text,
  CASE WHEN turn IS NULL THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS seconds, true AS is_final, turn IS NULL AS is_marker FROM m LEFT JOIN t ON m.conv_id = t.conv_id""",
    "staged_terms": rf"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) ELSE len({_TOK}) END AS n FROM documents""",
    "transformed_search": f"""WITH {_INDEX},{_ASKED},
q2 AS MATERIALIZED (SELECT q.query_id - 1 AS query_id, term, times FROM q JOIN benchmark n ON n.item_id = q.query_id JOIN benchmark b ON b.item_id = q.query_id - 1 WHERE n.text <> b.text),
{_found('h')},{_found('g', asked='q2')},
u AS (SELECT query_id, doc_id, 0 AS l, rank FROM h UNION ALL SELECT query_id, doc_id, 1, rank FROM g),
o AS (SELECT query_id, doc_id, min((l, rank)) AS k FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS rank FROM o""",
    "asked_messages": """
SELECT conv_id, turn, trim(text, ' ') AS question FROM conversations WHERE trim(text, ' ') <> '' AND (turn % 3 < 2 OR conv_id % 2 = 0)""",
    "context_lines": f"""
SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN 'meeting: ' || source WHEN 1 THEN 'article: ' || source || ' ' || lang
  WHEN 2 THEN 'channel: ' || lang || ' ' || lang ELSE 'path: ' || coalesce(url, 'unknown') END || chr(10) || text) AS text_md5 {_PAGED}""",
    "embedding_lines": f"""
SELECT doc_id, md5(trim(text, ' ') || chr(10) || 'source: ' || source || CASE WHEN url <> '' THEN chr(10) || 'url: ' || url ELSE '' END) AS text_md5 {_PAGED}""",
    "term_document_frequency": f"WITH {_INDEX} SELECT term, df FROM t",
    "bm25_idf_floor": f"WITH {_INDEX} SELECT term, round(idf, 6) AS idf FROM t",
    "bm25_topk": f"WITH {_INDEX},{_ASKED},{_found('h')} SELECT query_id, doc_id, score, rank FROM h",
    "dense_topk": f"WITH {_near(_FIFTIETH)} SELECT query_id, doc_id, score, rank FROM d",
    "ivf_exact_topk": f"WITH {_near(_FIFTIETH)} SELECT query_id, doc_id, score, rank FROM d",
    "ivf_recall": """
SELECT count(*) AS n_queries, sum(least(20, (SELECT count(*) FROM embeddings)))::BIGINT AS n_true, true AS recall_ok FROM embeddings WHERE vec_id % 50 = 0""",
    "label_silhouette": """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (
  SELECT a.vec_id, a.label, b.label AS other, sum(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2))) AS total, count(*) AS n
  FROM v a JOIN v b ON true GROUP BY a.vec_id, a.label, b.label),
s AS (
  SELECT vec_id, label, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a, max(CASE WHEN label = other THEN n END) AS n,
         min(CASE WHEN label <> other THEN total / n END) AS b
  FROM d GROUP BY vec_id, label)
SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY label""",
    "dense_topk_filtered": f"WITH {_near(_FIFTIETH, 'label IN (1, 2, 3)')} SELECT query_id, doc_id, score, rank FROM d",
    "hybrid_merge": f"""WITH {_INDEX},{_ASKED},{_found('h')},{_near(_OF_ITEMS)},
u AS (SELECT query_id, doc_id, 0 AS l, rank FROM d UNION ALL SELECT query_id, doc_id, 1, rank FROM h),
o AS (SELECT query_id, doc_id, min((l, rank)) AS k FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS rank FROM o""",
    "quota_merge": f"""WITH {_INDEX},{_ASKED},{_found('h')},{_found('g', 1.2, 0.5)},
u AS (SELECT query_id, doc_id, CASE WHEN rank <= 12 THEN 0 ELSE 2 END AS l, rank FROM h
  UNION ALL SELECT query_id, doc_id, CASE WHEN rank <= 8 THEN 1 ELSE 3 END, rank FROM g),
o AS (SELECT query_id, doc_id, min((l, rank)) AS k FROM u GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER) AS rank FROM o) WHERE rank <= 20""",
    "parent_cap": f"""WITH {_INDEX},{_ASKED},{_found('h')}
SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS i
  FROM h JOIN documents USING (doc_id)) WHERE i <= 2""",
    "rerank_order": rf"""WITH {_INDEX},{_ASKED},{_found('h')},
b AS (SELECT item_id AS query_id, list_distinct({_TOK}) AS qt FROM benchmark),
x AS (SELECT query_id, doc_id, rank AS before, round(len(list_intersect(qt, list_distinct(w))) / len(qt), 6) AS rerank_score FROM h JOIN b USING (query_id) JOIN a USING (doc_id))
SELECT query_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, before) AS INTEGER) AS rank FROM x""",
    "mmr_select": f"""WITH RECURSIVE {_near(_FIFTIETH)},
c AS (SELECT d.query_id, d.doc_id, d.rank, e, round(list_cosine_similarity(qe, e), 9) AS rel FROM d JOIN v USING (doc_id) JOIN vq ON vq.query_id = d.query_id),
pool AS (SELECT query_id, list({{'id': doc_id, 'r': rank, 'e': e, 'rel': rel}} ORDER BY rank) AS xs FROM c GROUP BY query_id),
m AS (
  SELECT query_id, xs, list_transform(xs[1:3], lambda x: x.r) AS picked, 3 AS n FROM pool
  UNION ALL
  SELECT query_id, xs, list_append(picked, best), n + 1 FROM (
    SELECT query_id, xs, picked, n, (SELECT arg_min(r, (-val, r)) FROM (
      SELECT y.r AS r, round(0.5 * y.rel - 0.5 * list_max(list_transform(picked, lambda i: round(list_cosine_similarity(y.e, xs[i].e), 9))), 9) AS val
      FROM (SELECT unnest(xs) AS y)) WHERE NOT list_contains(picked, r)) AS best FROM m WHERE n < 5 AND n < len(xs))),
z AS (SELECT query_id, xs, unnest(picked) AS r, CAST(generate_subscripts(picked, 1) AS INTEGER) AS rank FROM m WHERE n = 5)
SELECT query_id, xs[r].id AS doc_id, rank FROM z""",
    "parent_expand": """
WITH h AS (SELECT DISTINCT conv_id FROM conversations WHERE turn % 3 = 2),
s AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn < 2)
SELECT conv_id, turn, 'summary' AS kind FROM h JOIN s USING (conv_id)
UNION ALL
SELECT conv_id, turn, 'first' FROM h JOIN conversations USING (conv_id) WHERE turn = 0 AND conv_id NOT IN (SELECT conv_id FROM s)""",
    "message_lines": f"WITH {_LINES} SELECT conv_id, turn, line_no, start, line FROM ln",
    "date_separators": """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d') END AS date FROM events),
w AS (SELECT *, last_value(date IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id, event_id, coalesce(date, before) AS filled_date, coalesce(date <> before, false) AS new_date FROM w""",
    "span_first_message": f"""WITH {_LINES},
nx AS (SELECT conv_id, turn, start, lead(start) OVER (PARTITION BY conv_id ORDER BY start) AS until FROM ln),
tot AS (SELECT conv_id, max(start + length(line)) AS total FROM ln GROUP BY conv_id),
sp AS (SELECT conv_id, unnest(range(0, CAST(floor((total - 1) / 200) AS BIGINT) + 1)) AS span_id, total FROM tot),
m AS (SELECT sp.conv_id, span_id, arg_min(turn, start) AS message FROM sp JOIN nx ON sp.conv_id = nx.conv_id AND turn % 2 = 1
  AND start < least(span_id * 200 + 200, total) AND (until IS NULL OR until > span_id * 200) GROUP BY ALL)
SELECT sp.conv_id, sp.span_id, message FROM sp LEFT JOIN m ON sp.conv_id = m.conv_id AND sp.span_id = m.span_id""",
    "gap_sessions": """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT user_id, t, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, min(t) AS first_at, max(t) AS last_at, count(*) AS n FROM s GROUP BY user_id, session""",
    "token_pack": rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, len({_TOK}) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (
  SELECT conv_id, turn, i, k AS total, CAST(1 AS BIGINT) AS pack FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.i, CASE WHEN total + k > 128 THEN k ELSE total + k END, CASE WHEN total + k > 128 THEN pack + 1 ELSE pack END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, turn, pack FROM f""",
    "common_or_mixed": """
WITH d AS (SELECT source, toxic, lang, CAST(len(string_split(text, chr(10))) AS VARCHAR) AS n_lines FROM documents JOIN labels USING (doc_id))
SELECT source, toxic,
  CASE count(DISTINCT lang) FILTER (WHERE lang <> '') WHEN 0 THEN '' WHEN 1 THEN max(lang) ELSE 'mixed' END AS lang,
  CASE count(DISTINCT n_lines) FILTER (WHERE n_lines <> '') WHEN 0 THEN '' WHEN 1 THEN max(n_lines) ELSE 'mixed' END AS n_lines
FROM d GROUP BY source, toxic""",
    "latest_name": """
SELECT user_id, event_type FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id) AS i FROM events WHERE event_type IS NOT NULL)
WHERE i = 1""",
    "stale_outputs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND EXISTS (SELECT 1 FROM labels)",
    "fresh_inputs": """
WITH m AS (SELECT doc_id, n_chars - quality AS done_mtime FROM labels JOIN documents USING (doc_id))
SELECT d.doc_id, n_chars AS src_mtime, done_mtime FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id WHERE done_mtime IS NULL OR n_chars > done_mtime""",
    "url_strip": r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(url || ' x ' || html, 'https?://[^\s]+', '', 'gi'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS text_md5 FROM pages""",
    "mention_mask": """
SELECT event_id, '@user ' || event_type || ' @role' AS text, CAST(user_id AS VARCHAR) AS first FROM events""",
    "symbol_filter": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '' AND NOT regexp_matches(x, '[\p{L}\p{N}\p{M}]')) AS m FROM documents)
SELECT doc_id, len(m) AS n_symbol_tokens, len(list_distinct(m)) AS n_distinct FROM w""",
    "history_last_n": """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 5""",
    "json_payload": """
SELECT event_id, k, k % 2 = 1 AS odd FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "source_refs": """
SELECT ref, count(*) AS n FROM (
  SELECT coalesce(url, 'https://docs.example/' || CASE WHEN doc_id % 2 = 0 THEN 'sheets/' ELSE 'documents/' END || source) AS ref
  FROM documents LEFT JOIN pages ON page_id = doc_id) GROUP BY ref""",
    "pending_fold": """
WITH RECURSIVE t AS (SELECT user_id, event_id, abs(round(value)) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT user_id, event_id, i, k >= 300 AS summarise, k >= 60 AS check_end, CASE WHEN k >= 300 THEN 0 ELSE k END AS a, CASE WHEN k >= 60 THEN 0 ELSE k END AS b FROM t WHERE i = 1
  UNION ALL
  SELECT t.user_id, t.event_id, t.i, a + k >= 300, b + k >= 60, CASE WHEN a + k >= 300 THEN 0 ELSE a + k END, CASE WHEN b + k >= 60 THEN 0 ELSE b + k END
  FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)
SELECT user_id, event_id, summarise, check_end FROM f""",
    "metric_mean": """
SELECT 'quality' AS metric, round(avg(quality), 6) AS mean, count(quality) AS n FROM labels
UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(toxic) FROM labels""",
    "keyword_normalize": r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(translate(text, ',;|/', '    '), '"''`[]', ''), '(^|\s)[-*•]+(\s)', '\1\2', 'g'), '\s+'), lambda x: x <> '') AS x FROM benchmark),
u AS (SELECT item_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM w),
d AS (SELECT item_id, word, min(pos) AS pos FROM u GROUP BY item_id, word)
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS keywords FROM d GROUP BY item_id""",
}
