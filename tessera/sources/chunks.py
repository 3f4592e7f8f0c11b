"""Readers and writers of chunk, document, evaluation and index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import id_of_name
from tessera.operators.dense import check_dimension
from tessera.operators.parents import first_of
from tessera.schemas import CHUNK_SCHEMA, ORIGIN, PLACE, exported
from tessera.sources.versions import VersionedTable

_FIELDS = [*ORIGIN, *[c for c, _ in PLACE]]
# Keys of the sidecar format; fixed values.
SIDECAR = [
    "drive_file_id", "drive_file_name", "drive_path", "drive_mime_type", "drive_modified_time",
    "hatenablog_entry_id", "hatenablog_title", "hatenablog_url", "hatenablog_created_at", "hatenablog_updated_at",
]


def read_texts(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files below a folder: path, name, text, mtime; each once. A missing folder is an error."""
    df = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    df = df.select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_modification_time")
    df = df.toDF("text", "path", "name", "mtime")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return df.where(suffix.isin([e.lower() for e in extensions])).dropDuplicates(["path"])


def read_chunks(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Chunk files (a JSON object with text and metadata in each line), in CHUNK_SCHEMA, with path.

    Blank lines are skipped; bad JSON, or a text that isn't a string, is an
    error. Empty values become null; other metadata go into ``extra``.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)
    raw = raw.select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    parsed = raw.select("path", F.try_parse_json("value").alias("v"), "value")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.text", "variant"))
    meta = F.schema_of_variant(F.try_variant_get("v", "$.metadata", "variant"))
    good = F.coalesce(kind == "STRING", F.lit(False)) & (F.coalesce(meta, F.lit("VOID")).startswith("OBJECT") | (F.coalesce(meta, F.lit("VOID")) == "VOID"))
    checked = parsed.where(F.assert_true(good, F.concat(F.lit("not a chunk: "), F.substring("value", 1, 80))).isNull())
    fields = F.from_json(F.get_json_object("value", "$.metadata"), T.MapType(T.StringType(), T.StringType()))
    named = checked.select("path", F.get_json_object("value", "$.text").alias("text"), fields.alias("m"))
    columns = [F.nullif(F.col("m")[c], F.lit("")).try_cast(t).alias(c) for c, t in [*[(c, T.StringType()) for c in ORIGIN], *PLACE]]
    rest = F.map_filter(F.coalesce("m", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(_FIELDS))
    return named.select("path", "text", *columns, rest.alias("extra"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ord, a document's place among all by ``order``: from 0, worked out over the partitions of a range sort.

    The places before a partition come from the partitions' counts, a row each,
    so the rows never meet in one task.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = sorted_.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return local.join(before, "_part").withColumn("ord", F.col("_base") + F.col("_local") - 1).drop("_part", "_local", "_base")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A Parquet table of chunks by stage and kind of source; only partitions that are written again are replaced."""
    out = chunks.withColumn("source_kind", F.coalesce("source_type", F.lit("none"))).withColumn("stage", F.coalesce("chunk_stage", F.lit("none")))
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("stage", "source_kind").parquet(path)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines of text and metadata, absent text values as ""."""
    meta = F.struct(*[exported(c).alias(c) for c in ORIGIN], *[F.col(c) for c, _ in PLACE])
    chunks.select("text", meta.alias("metadata")).write.mode("overwrite").json(path)


def corpus(spark: SparkSession, path: str, stages: list[list[str]], kinds: list[str]) -> DataFrame:
    """Chunks of the first list of stages that has any, of some kinds of source: later lists are fallbacks."""
    table = spark.read.parquet(path).where(F.col("source_kind").isin(kinds))
    for choice in stages:
        found = table.where(F.col("stage").isin(choice))
        if not found.isEmpty():
            return found
    return table.where("false")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files(path, name, …) with what sidecars(path, json) say of them: known, non-empty strings; a bad sidecar says nothing."""
    parsed = sidecars.select(
        F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.from_json("json", ", ".join(f"{c} string" for c in SIDECAR)).alias("m")
    )
    known = parsed.select("path", *[F.nullif(F.trim(F.col("m")[c]), F.lit("")).alias(c) for c in SIDECAR])
    # Of several sidecars of a file, that whose text comes first, so that the choice does not change from run to run.
    one = first_of(known, ["path"], list(SIDECAR))
    out = files.join(one, "path", "left")
    return out.withColumn("drive_file_id", F.coalesce("drive_file_id", id_of_name(F.col("name"))))


def meeting_of(path):
    """(meeting_date, meeting_label) of a transcript's path, whose folder is YYYY-MM-DD_N."""
    day = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})_(\d+)/[^/]*$", 1)
    turn = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})_(\d+)/[^/]*$", 2)
    return F.nullif(day, F.lit("")), F.when(day != "", F.concat_ws(" #", day, turn.cast("int")))


def chunk_rows(df: DataFrame) -> DataFrame:
    """``df`` in CHUNK_SCHEMA: missing columns are null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in CHUNK_SCHEMA])


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items: question, ground_truths. A line without a question, or bad JSON, is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    get = lambda p: F.get_json_object("value", p)
    question = F.coalesce(get("$.question"), get("$.query"))
    truths = F.coalesce(get("$.ground_truths"), get("$.ground_truth"))
    listed = F.coalesce(F.when(truths.startswith("["), F.from_json(truths, "array<string>")), F.when(truths.isNotNull(), F.array(truths)), F.array().cast("array<string>"))
    good = F.try_parse_json("value").isNotNull() & F.coalesce(F.trim(question) != "", F.lit(False))
    checked = raw.where(F.assert_true(good, F.concat(F.lit("not an evaluation item: "), F.substring("value", 1, 80))).isNull())
    return checked.select(question.alias("question"), listed.alias("ground_truths"))


def write_index_metadata(spark: SparkSession, path: str, model: str, dim: int) -> None:
    row = spark.range(1).select(F.lit(1).alias("schema_version"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), F.current_timestamp().alias("created_at"))
    row.write.mode("overwrite").parquet(path)


def check_index_metadata(spark: SparkSession, path: str, model: str, dim: int) -> list[str]:
    """Warnings about an index's model; another dimension is an error; an unreadable file says nothing."""
    try:
        row = spark.read.parquet(path).first()
    except Exception:  # noqa: BLE001  the file is only a note
        return []
    if row is None:
        return []
    if row["embedding_dim"] != dim:
        raise ValueError(f"the index has vectors of {row['embedding_dim']} dimensions, the model {dim}")
    return [] if row["embedding_model"] == model else [f"the index was made with {row['embedding_model']}"]


def read_messages(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Chat message files: channel_id, channel_name, message_id (or else chunk_id), seq, ts, author, text.

    The time is that of an ISO-8601 string (UTC where it has no offset); where a
    message has none, its date is later taken from the one before. seq orders
    the messages of a channel: by file, then by line number as they were written.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    raw = raw.select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    meta = lambda k: F.nullif(F.get_json_object("value", f"$.metadata.{k}"), F.lit(""))
    good = F.try_parse_json("value").isNotNull()
    checked = raw.where(F.assert_true(good, F.concat(F.lit("not a message: "), F.substring("value", 1, 80))).isNull())
    stamp = F.try_to_timestamp(F.regexp_replace(meta("message_timestamp"), "Z$", "+00:00"))
    return checked.select(
        F.coalesce(meta("channel_id"), meta("channel_name"), F.col("file")).alias("channel_id"), meta("channel_name").alias("channel_name"),
        F.coalesce(meta("message_id"), meta("chunk_id")).alias("message_id"), F.struct("file", "at").alias("seq"), stamp.alias("ts"),
        F.coalesce(meta("author_name"), F.lit("unknown")).alias("author"), F.get_json_object("value", "$.text").alias("text"),
    )


def write_manifest(outputs: DataFrame, path: str) -> None:
    """Adds what was made to the manifest: outputs(output, source_path, src_mtime, done_mtime); readers take the latest row of an output."""
    outputs.select("output", "source_path", "src_mtime", "done_mtime").write.mode("append").parquet(path)


def write_vectors(chunks: DataFrame, embed, path: str, text: str = "text") -> bool:
    """Embeds chunks (``embed(df) -> df`` with embedding) and saves them by id; without chunks nothing is written."""
    if chunks.isEmpty():
        return False
    embed(chunks.where(F.trim(text) != "")).write.mode("overwrite").parquet(path)
    return True


def write_evaluation(records: DataFrame, path: str, kind: str = "json") -> None:
    """Evaluation records as JSON lines or CSV with a header: question, answer, contexts, ground_truths, ground_truth."""
    out = records.select("question", "answer", "contexts", "ground_truths", F.coalesce(F.get("ground_truths", 0), F.lit("")).alias("ground_truth"))
    if kind == "csv":
        out = out.withColumns({c: F.to_json(c) for c in ("contexts", "ground_truths")})
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").json(path)


def reset_stages(spark: SparkSession, path: str, stages: list[str]) -> int:
    """Empties partitions of a chunk table (see ``write_chunks``); how many of the stages there were."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(bool(system.delete(spark._jvm.org.apache.hadoop.fs.Path(base, f"stage={s}"), True)) for s in stages)


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript files YYYY-MM-DD_N/NN.txt: meeting_key, transcript_index, meeting_date, meeting_label, text."""
    files = read_texts(spark, folder, [".txt"])
    day, label = meeting_of(F.col("path"))
    key = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2}_\d+)/[^/]*$", 1)
    index = F.regexp_extract("name", r"^(\d+)\.", 1).try_cast("int")
    return files.select(key.alias("meeting_key"), index.alias("transcript_index"), day.alias("meeting_date"), label.alias("meeting_label"), "text").where("meeting_key <> ''")


def load_vectors(spark: SparkSession, path: str, model: str, dim: int) -> tuple[DataFrame, list[str]]:
    """A vector table with its note: vectors of ``path``/vectors, and warnings of ``path``/metadata (see ``check_index_metadata``).

    Another dimension in the note is an error at once, in a vector as the table is read.
    """
    warnings = check_index_metadata(spark, f"{path}/metadata", model, dim)
    return check_dimension(spark.read.parquet(f"{path}/vectors"), dim), warnings


def save_vectors(vectors: DataFrame, path: str, model: str, dim: int) -> None:
    """A vector table(doc_id, embedding, ...) and its note."""
    check_dimension(vectors, dim).write.mode("overwrite").parquet(f"{path}/vectors")
    write_index_metadata(vectors.sparkSession, f"{path}/metadata", model, dim)


def meeting_summaries(chunks: DataFrame, last: int | None = None, index: int | None = None) -> DataFrame:
    """Summaries of meetings among chunks(meeting_key, transcript_index, chunk_id, chunk_stage, text): meeting_key, transcript_index, chunk_id, text.

    All of them, the ``last`` so many of each meeting by running number, or those of the transcript ``index``. Empty ones are left out.
    """
    out = chunks.where("chunk_stage = 'summery' AND meeting_key IS NOT NULL AND trim(text) <> ''").select("meeting_key", "transcript_index", "chunk_id", "text")
    if index is not None:
        out = out.where(F.col("transcript_index") == index)
    if last is not None:
        order = Window.partitionBy("meeting_key").orderBy(F.desc("chunk_id"), F.desc("transcript_index"))
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(0, last)).drop("_n")
    return out


def add_summaries(table: VersionedTable, new: DataFrame, version: int | None = None) -> DataFrame:
    """Summaries new(meeting_key, transcript_index, text) added to a meetings' table, chunk_id running on in each meeting.

    A transcript that has a summary already is left out, so a job may come again.
    """
    rows = new.select("meeting_key", F.col("transcript_index").cast("int").alias("transcript_index"), "text", F.lit("summery").alias("chunk_stage"))
    rows = rows.dropDuplicates(["meeting_key", "transcript_index"])
    old = table.current()
    if old is not None:
        rows = rows.join(old.select("meeting_key", "transcript_index"), ["meeting_key", "transcript_index"], "left_anti")
    return table.append_numbered(rows, ["meeting_key"], ["transcript_index"], "chunk_id", version)


def summary_prompt_row(text: Column, title: Column, path: Column, level: Column) -> Column:
    """A chunk as the summarising model sees it: its text, then a line for its title and, on the lowest level, one for its path; an empty text is empty."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.nullif(F.trim(c), F.lit("")))
    rows = F.concat_ws("\n", F.trim(text), line("title", title), F.when(level == 0, line("path", path)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("")).otherwise(rows)


def write_transcripts(lines: DataFrame, folder: str) -> None:
    """Transcript lines(meeting_key, transcript_index, offset, user_name, text, line) as text files, one for each transcript."""
    order = F.array_sort(F.collect_list(F.struct("offset", "user_name", "text", "line")))
    texts = lines.groupBy("meeting_key", "transcript_index").agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("value"))
    texts.repartition("meeting_key", "transcript_index").write.mode("append").partitionBy("meeting_key", "transcript_index").text(folder)
