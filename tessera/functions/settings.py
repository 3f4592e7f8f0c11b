"""Settings given as text, and what changes with the day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def minute_of_day(text: Column) -> Column:
    """Minutes after midnight of "HH:MM"; null where it is no time."""
    hour, minute = (F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def weekdays(text: Column) -> Column:
    """Days of a list by commas as numbers from 0 (Monday), each once and in order: names, their first three letters, or numbers; others are left out."""
    parts = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda p: F.trim(p))
    names = F.array(*[F.lit(d) for d in DAYS])
    number = lambda p: F.when(p.rlike("^[0-6]$"), p.try_cast("int")).when(p.rlike("^[a-z]{3,}$"), F.nullif(F.array_position(names, F.substring(p, 1, 3)), F.lit(0)).cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, number), lambda x: x.isNotNull())))


def id_list(text: Column) -> Column:
    """Numbers of a list by commas or white space, each once, in the order given; what is no number is left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[,\s]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: p.try_cast("bigint")), lambda x: x.isNotNull()))


def question_of(message: Column, own_id: Column, prefix: Column, in_channel: Column) -> Column:
    """What a message asks: the text after a mention of ``own_id`` or after ``prefix``, or the whole text in a channel for questions; else null."""
    text = F.trim(message)
    mention = F.concat(F.lit(r"^<@!?"), own_id, F.lit(">"))
    asked = (
        F.when(F.regexp_like(text, mention), F.regexp_replace(text, mention, F.lit("")))
        .when(text.startswith(prefix), F.substring(text, F.length(prefix) + 1, F.length(text)))
        .when(in_channel, text)
    )
    return F.nullif(F.trim(asked), F.lit(""))


class DailyText:
    """A text that is made anew when the date changes."""

    def __init__(self, make: Callable[[str], str]):
        self.make, self.day, self.text = make, None, ""

    def of(self, day: str) -> str:
        if day != self.day:
            self.day, self.text = day, self.make(day)
        return self.text
