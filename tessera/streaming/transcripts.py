"""Voice events to transcripts: windows, blocks, thresholds and memory of streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.text import clock

#: Blocks shorter than this are not recognised; events closer than the gap are one block.
LEAST_SECONDS, GAP_SECONDS = 0.35, 1.0


def mono(pcm: bytes, channels: int, rate: int, target: int) -> np.ndarray:
    """16-bit samples as floats of one channel, resampled by linear interpolation."""
    samples = np.frombuffer(pcm[: len(pcm) // (2 * channels) * 2 * channels], dtype="<i2").astype(np.float32) / 32768.0
    one = np.clip(samples.reshape(-1, channels).mean(axis=1), -1.0, 1.0)
    if rate == target or not len(one):
        return one
    n = max(1, round(len(one) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(one)), one).astype(np.float32)


def blocks(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "1 second") -> DataFrame:
    """Blocks of a user's events that lie within ``gap`` of each other: user, start, end, n; batch or stream (with a watermark)."""
    w = F.session_window(time, gap)
    out = events.groupBy(user, w.alias("w")).agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "seconds")


def transcribe(events: pd.DataFrame, start: float, recognise: Callable[[bytes], list[tuple[float | None, str]]]) -> pd.DataFrame:
    """Lines of one user's audio in a window: offset, user_name, text.

    events(offset_seconds, duration_seconds, pcm, user_name). What began before
    ``start`` is late and dropped; the gap between blocks counts from the latest
    event's end; short blocks go; a line's offset is never before ``start``. ``recognise`` is a
    function of samples or a ``Transcriber``.
    """
    rows, open_ = [], None
    recognise = getattr(recognise, "recognise", recognise)

    def close() -> None:
        if open_ and open_["seconds"] >= LEAST_SECONDS:
            for at, text in recognise(b"".join(open_["pcm"])):
                if text.strip():
                    rows.append((max(start, open_["at"] + (at or 0.0)), name, text.strip()))

    own = events[events["offset_seconds"] >= start].sort_values("offset_seconds", kind="stable")
    name = own["user_name"].iloc[-1] if len(own) else ""
    for e in own.itertuples():
        if open_ and e.offset_seconds - open_["end"] <= GAP_SECONDS:
            open_["pcm"].append(e.pcm)
            open_["seconds"] = e.offset_seconds + e.duration_seconds - open_["at"]
            open_["end"] = e.offset_seconds + e.duration_seconds
        else:
            close()
            open_ = {"at": e.offset_seconds, "pcm": [e.pcm], "seconds": e.duration_seconds, "end": e.offset_seconds + e.duration_seconds}
    close()
    return pd.DataFrame(rows, columns=["offset", "user_name", "text"])


def speech(audio: DataFrame, start: float, recognise) -> DataFrame:
    """Transcript lines of a window's audio(user_id, user_name, offset_seconds, duration_seconds, pcm), a user at a time."""
    return audio.groupBy("user_id").applyInPandas(lambda p: transcribe(p, start, recognise), "offset double, user_name string, text string")


def transcript(spoken: DataFrame, chat: DataFrame, start: float) -> DataFrame:
    """Lines of speech and chat in order of (offset, user, text): line is "HH:MM:SS name: text"."""
    typed = chat.select(F.greatest(F.col("offset_seconds"), F.lit(start)).alias("offset"), "user_name", "text")
    both = spoken.unionByName(typed).where(F.trim("text") != "")
    return both.select("*", F.concat(clock(F.col("offset")), F.lit(" "), "user_name", F.lit(": "), "text").alias("line")).orderBy("offset", "user_name", "text")


class Thresholds(StatefulProcessor):
    """Two totals of seconds for each meeting: what to do after each transcript.

    In: meeting_key, transcript_index, text, seconds, is_final. Out: meeting_key,
    transcript_index, kind (summary or end_check) and the texts since that kind's
    last one. A final transcript always gives a summary and never an end check.
    """

    def __init__(self, summary: float = 300.0, check: float = 60.0):
        self.limits = {"summary": summary, "end_check": check}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = {k: handle.getValueState(k, "texts string, seconds double") for k in self.limits}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("transcript_index").itertuples():
            for kind, state in self.state.items():
                texts, seconds = state.get() if state.exists() else ("", 0.0)
                texts = "\n".join(x for x in (texts, (row.text or "").strip()) if x)
                seconds += row.seconds
                fire = row.is_final if kind == "summary" and row.is_final else seconds >= self.limits[kind] and not (kind == "end_check" and row.is_final)
                if fire and texts:
                    out.append((key[0], row.transcript_index, kind, texts))
                if fire or row.is_final:
                    state.clear()
                else:
                    state.update((texts, seconds))
        yield pd.DataFrame(out, columns=["meeting_key", "transcript_index", "kind", "texts"])

    def close(self) -> None:
        pass


def threshold_jobs(transcripts: DataFrame, summary: float = 300.0, check: float = 60.0) -> DataFrame:
    """Jobs of a stream of transcripts (see Thresholds)."""
    return transcripts.groupBy("meeting_key").transformWithStateInPandas(
        Thresholds(summary, check), "meeting_key string, transcript_index int, kind string, texts string", "append", "none"
    )


class Memory(StatefulProcessor):
    """The last n exchanges of each scope: in scope, seq, user, assistant; out scope, history (oldest first)."""

    def __init__(self, n: int = 5):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "users array<string>, assistants array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        users, assistants = map(list, self.kept.get()) if self.kept.exists() else ([], [])
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            # Only whole exchanges are remembered.
            if (r.user or "").strip() and (r.assistant or "").strip():
                users, assistants = [*users, r.user][-self.n :], [*assistants, r.assistant][-self.n :]
        self.kept.update((users, assistants))
        yield pd.DataFrame({"scope": [key[0]], "history": ["\n".join(f"user: {u}\nassistant: {a}" for u, a in zip(users, assistants))]})

    def close(self) -> None:
        pass


def remember(exchanges: DataFrame, n: int = 5) -> DataFrame:
    return exchanges.groupBy("scope").transformWithStateInPandas(Memory(n), "scope string, history string", "update", "none")


def append_once(path: str, keys: tuple[str, ...] = ("meeting_key", "transcript_index", "kind")):
    """A foreachBatch sink that adds only rows whose keys the table lacks, so that a batch may come again."""

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        try:
            known = spark.read.schema(batch.schema).parquet(path).select(*keys)
            new = new.join(known, list(keys), "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return write


def in_schedule(now, weekdays: list[int], start_minute: int, minutes: int, zone: str = "Asia/Tokyo"):
    """Whether a UTC timestamp lies in a weekly window: weekday (0 is Monday), and from a minute of the day for so long."""
    local = F.from_utc_timestamp(now, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.weekday(local).isin(weekdays) & (minute >= start_minute) & (minute <= start_minute + minutes)


def cut(events: DataFrame, start: float, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """A window's events and those that wait: up to ``cutoff`` they belong to the window, later ones to a window to come.

    events(kind, offset_seconds, …): audio that began before ``start`` is late and
    dropped; what was typed before it counts at ``start``. A window without events
    is empty and the next begins at ``cutoff`` all the same.
    """
    late = (F.col("kind") == "audio") & (F.col("offset_seconds") < start)
    own = events.where((F.col("offset_seconds") <= cutoff) & ~late)
    return own.withColumn("offset_seconds", F.greatest("offset_seconds", F.lit(start))), events.where(F.col("offset_seconds") > cutoff)


def final_jobs(meetings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Jobs at the end of meetings(meeting_key, last_index): the last transcript's, marked final; a marker with no text where nothing new was said.

    transcripts(meeting_key, transcript_index, text, seconds) are those of the last window.
    """
    out = meetings.join(transcripts, "meeting_key", "left")
    index = F.coalesce("transcript_index", F.col("last_index") + 1).cast("int")
    return out.select(
        "meeting_key", index.alias("transcript_index"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.lit(True).alias("is_final"), F.col("transcript_index").isNull().alias("is_marker"),
    )


class JobQueue:
    """Jobs in their order, one at a time; while paused none is given out, and one that was interrupted is the next again."""

    def __init__(self):
        self.jobs: deque = deque()
        self.paused = False

    def put(self, job) -> None:
        self.jobs.append(job)

    def again(self, job) -> None:
        self.jobs.appendleft(job)

    def take(self):
        return None if self.paused or not self.jobs else self.jobs.popleft()


def due_once_a_day(checks: DataFrame, weekdays: list[int], minute: int, zone: str = "Asia/Tokyo") -> DataFrame:
    """Of checks(at, a UTC timestamp), the first of each local day that is at or after ``minute`` of a listed weekday: day, at."""
    local = F.from_utc_timestamp("at", zone)
    fits = F.weekday(local).isin(weekdays) & (F.hour(local) * 60 + F.minute(local) >= minute)
    return checks.where(fits).groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.min("at").alias("at"))


def meeting_keys(meetings: DataFrame, taken: DataFrame, most: int | None = None) -> DataFrame:
    """Adds meeting_key, date_NN with the next free number of its date: meetings(meeting_id, date), taken(date, number).

    Numbers have two digits at least and go on beyond. More than ``most`` meetings on a date are an error, where it is given.
    """
    used = taken.groupBy("date").agg(F.max("number").alias("_used"))
    w = Window.partitionBy("date").orderBy("meeting_id")
    out = meetings.join(used, "date", "left").withColumn("number", F.coalesce("_used", F.lit(0)) + F.row_number().over(w))
    if most is not None:
        out = out.where(F.assert_true(F.col("number") <= most, F.lit("too many meetings on a date")).isNull())
    return out.select("meeting_id", "date", "number", F.concat("date", F.lit("_"), F.format_string("%02d", F.col("number").cast("long"))).alias("meeting_key"))
