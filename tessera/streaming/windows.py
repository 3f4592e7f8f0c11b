"""The running voice stream: a meeting's events wait in state, and timers cut them into windows of transcripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.transcripts import transcribe

EVENTS = "meeting_key string, kind string, user_id long, user_name string, offset_seconds double, duration_seconds double, pcm binary, text string"
TRANSCRIPTS = "meeting_key string, transcript_index int, start double, end double, text string, seconds double, is_final boolean, is_marker boolean"
_COLUMNS = [c.split()[0] for c in TRANSCRIPTS.split(", ")]


def flush_seconds(summary: float, check: float, least: float = 30.0) -> float:
    """How often windows are cut: by the shorter of the two intervals, neither taken as less than ``least``."""
    return min(max(least, summary), max(least, check))


class VoiceWindows(StatefulProcessor):
    """A meeting's windows of processing time. In: ``EVENTS`` of kind audio, chat or end. Out: ``TRANSCRIPTS``.

    A meeting begins with its first event: offsets count from then. Every ``seconds`` a
    timer ends a window: events with offsets up to its cutoff are taken from the state and
    become a transcript, later ones wait. A window without events, or without lines, gives no transcript and no
    number, and the next begins at its cutoff all the same. Audio that began before the window is late and
    dropped; what was typed before it counts at its start. ``end`` sets a timer for now,
    which ends the last window up to everything there is: its transcript is final; where it has no
    lines a marker with the number before comes instead. Then the meeting's state goes, and
    events that still come begin a new one under that key.
    """

    def __init__(self, recognise: Callable[[bytes], list[tuple[float | None, str]]], seconds: float):
        self.recognise, self.step = recognise, max(1, round(seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Epoch milliseconds of the beginning and of the next timer, the last cutoff, the next number, and whether the end was told.
        self.meeting = handle.getValueState("meeting", "began long, due long, flushed double, number int, ending boolean")
        self.waiting = handle.getListState("waiting", EVENTS.split(", ", 1)[1])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        new, ends = [], False
        for part in rows:
            ends = ends or bool((part["kind"] == "end").any())
            own = part[part["kind"] != "end"]
            new += [
                (e.kind, _or_none(e.user_id, int), e.user_name, _or_none(e.offset_seconds, float), _or_none(e.duration_seconds, float), e.pcm, e.text)
                for e in own.itertuples()
                if pd.notna(e.offset_seconds)
            ]
        if self.meeting.exists():
            began, due, flushed, number, ending = self.meeting.get()
        else:
            began, due, flushed, number, ending = now, now + self.step, 0.0, 0, False
            self.handle.registerTimer(due)
        if new:
            self.waiting.appendList(new)
        if ends and not ending:
            # The end is a timer as well, so it comes with what arrives beside it.
            self.handle.deleteTimer(due)
            due, ending = now, True
            self.handle.registerTimer(due)
        self.meeting.update((began, due, flushed, number, ending))
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if not self.meeting.exists():
            return
        began, due, start, number, ending = self.meeting.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at != due:
            return
        held = list(self.waiting.get())
        # A timer may fire later than it was set for: the window then reaches to now, as its events do.
        now = max(at, timerValues.getCurrentProcessingTimeInMs())
        cutoff = max(0.0, (now - began) / 1000)
        own = held if ending else [e for e in held if e[3] <= cutoff]
        if ending and held:
            cutoff = max(cutoff, max(e[3] for e in held))
        lines = self._lines(own, start)
        out = []
        if lines:
            out.append((key[0], number, start, cutoff, "\n".join(lines), cutoff - start, ending, False))
        elif ending:
            out.append((key[0], max(0, number - 1), start, cutoff, "", 0.0, True, True))
        if ending:
            self.meeting.clear()
            self.waiting.clear()
        else:
            if own:
                later = [tuple(e) for e in held if e[3] > cutoff]
                if later:
                    self.waiting.put(later)
                else:
                    self.waiting.clear()
            self.handle.registerTimer(now + self.step)
            self.meeting.update((began, now + self.step, cutoff, number + bool(lines), False))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _lines(self, events: list[tuple], start: float) -> list[str]:
        """A window's lines in order of (offset, user, text)."""
        found: list[tuple[float, str, str]] = []
        audio: dict[int | None, list[tuple]] = {}
        for kind, user, name, offset, seconds, pcm, text in events:
            if kind == "audio":
                audio.setdefault(user, []).append((offset, seconds or 0.0, bytes(pcm or b""), name or ""))
            elif (text or "").strip():
                found.append((max(start, offset), name or "", text.strip()))
        for own in audio.values():
            frame = pd.DataFrame(own, columns=["offset_seconds", "duration_seconds", "pcm", "user_name"])
            found += list(transcribe(frame, start, self.recognise).itertuples(index=False, name=None))
        return [f"{_clock(at)} {name}: {text}" for at, name, text in sorted(found)]

    def close(self) -> None:
        pass


def _or_none(value, kind):
    return None if pd.isna(value) else kind(value)


def _clock(seconds: float) -> str:
    s = max(0, int(seconds))
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def voice_transcripts(events: DataFrame, recognise: Callable[[bytes], list[tuple[float | None, str]]], seconds: float) -> DataFrame:
    """The transcripts of a stream of events by meeting (see VoiceWindows), for a query in append mode.

    ``threshold_jobs`` takes them on: their seconds are those of their windows.
    """
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return events.select(*names).groupBy("meeting_key").transformWithStateInPandas(VoiceWindows(recognise, seconds), TRANSCRIPTS, "append", "processingTime")
