"""Chat messages as lines, with dates, places and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import lines_of, local_date
from tessera.operators.split import MESSAGE, first_in_span, number, split


def is_human(df: DataFrame) -> DataFrame:
    """Without bots, webhooks, system messages, and types other than default and reply."""
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return df.where(off("is_bot") & off("is_webhook") & off("is_system") & F.col("message_type").isin("default", "reply"))


def lines(messages: DataFrame, channel: str = "channel", order: str = "order", author: str = "author") -> DataFrame:
    """A row for each line "author: text": channel, order, line_no (from 0 in the channel), start, line.

    start is the line's place in the channel's text, lines joined by a line end.
    """
    out = messages.select(channel, order, F.coalesce(author, F.lit("unknown")).alias("_author"), F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
    out = out.withColumn("line", F.concat("_author", F.lit(": "), "_line"))
    w = Window.partitionBy(channel).orderBy(order, "_pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        channel, order, (F.row_number().over(w) - 1).cast("long").alias("line_no"),
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"), "line",
    )


def dated(rows: DataFrame, channel: str, order: list[str], date: str = "date") -> DataFrame:
    """Adds filled_date (the last date so far) and new_date: whether a separator line comes before the row (not before the first date)."""
    w = Window.partitionBy(channel).orderBy(*order)
    last = F.last(date, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "*", F.coalesce(F.col(date), last).alias("filled_date"), F.coalesce(F.col(date) != last, F.lit(False)).alias("new_date")
    )


def with_separators(rows: DataFrame, channel: str, order: list[str], date: str = "date", line: str = "line") -> DataFrame:
    """Lines, and a line with the date before each line on which the date changes; part orders the two."""
    both = F.array_compact(F.array(F.when(F.col("new_date"), F.struct(F.lit(0).alias("part"), F.col(date).alias("line"))), F.struct(F.lit(1).alias("part"), F.col(line).alias("line"))))
    return dated(rows, channel, order, date).select(channel, *order, F.inline(both))


def gap_sessions(events: DataFrame, key: str, start: str, end: str, gap: float, order: str) -> DataFrame:
    """Adds session (from 1): a new one begins where the gap after the latest event's end exceeds ``gap``."""
    w = Window.partitionBy(key).orderBy(start, order)
    apart = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True))
    return events.withColumn("_new", apart.cast("long")).withColumn("session", F.sum("_new").over(w)).drop("_new")


def latest_name(names: DataFrame, key: str, name: str, seen: str, order: str) -> DataFrame:
    """The name that was seen last for each key; at equal times the one observed first."""
    best = F.max_by(name, F.struct(F.col(seen), -F.col(order)))
    return names.where(F.col(name).isNotNull()).groupBy(key).agg(best.alias(name))


def message_chunks(messages: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Chunks of channels' texts: channel_id, chunk_id, text, first_message_id, first_message_date, chunk_stage.

    messages(channel_id, seq, message_id, ts, author, text), as ``read_messages``
    gives them. A channel's text is its lines "author: text", with a line for the
    date before each line on which it changes; a message without a time has the
    date of the one before. A chunk knows the first message that it touches.
    """
    own = messages.select("channel_id", "seq", "message_id", local_date(F.col("ts")).alias("date"), F.coalesce("author", F.lit("unknown")).alias("author"), "text")
    shown = dated(own, "channel_id", ["seq"])
    # The date stands once before a message's first line, and every line after it has the message's id.
    parts = F.concat(
        F.when(F.col("new_date"), F.array(F.struct(F.col("filled_date").alias("line"), F.lit(False).alias("said")))).otherwise(F.array().cast("array<struct<line:string,said:boolean>>")),
        F.transform(lines_of(F.col("text")), lambda x: F.struct(F.concat("author", F.lit(": "), x).alias("line"), F.lit(True).alias("said"))),
    )
    rows = shown.where(F.size(lines_of(F.col("text"))) > 0).select("channel_id", "seq", "message_id", "filled_date", F.posexplode(parts).alias("pos", "x"))
    w = Window.partitionBy("channel_id").orderBy("seq", "pos")
    start = F.coalesce(F.sum(F.length("x.line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    rows = rows.select("channel_id", "seq", "pos", start.alias("start"), F.col("x.line").alias("line"), F.when(F.col("x.said"), F.struct("message_id", F.col("filled_date").alias("date"))).alias("first"))
    texts = rows.groupBy("channel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    chunks = split(texts, size, overlap, MESSAGE).withColumnsRenamed({"chunk_pos": "span_id", "chunk_start": "start", "chunk_end": "end"})
    found = first_in_span(chunks, rows.select("channel_id", "start", "first"), "channel_id", "first")
    return number(found, ["channel_id"], ["span_id"]).select(
        "channel_id", "chunk_id", "text", F.col("first.message_id").alias("first_message_id"), F.col("first.date").alias("first_message_date"),
        F.lit("first_recursive").alias("chunk_stage"),
    )


def joined_lines(rows: DataFrame, keys: list[str], order: list[str], line: str = "line", between: str = "\n") -> DataFrame:
    """The lines of each key in order, as one text: keys, text."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), between).alias("text"))
