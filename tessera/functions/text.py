"""Cleaning, tokens, and names: all are Column functions of Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"
URL = r"(?i)https?://\S+"
_SPACES = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"
#: Line ends that split a text into lines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def tokens(text: Column) -> Column:
    """The default analyzer: runs of letters, marks and digits of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def counted(words: Column) -> Column:
    """Each distinct word of an array with its number, as structs (term, tf) in the order of the words; empty where the array is null.

    Words are sorted and their runs counted inside the row, so no shuffle brings a text's words together.
    """

    def runs(own: Column) -> Column:
        n = F.size(own)
        edges = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(own, i) != F.get(own, i - 1)))
        pair = lambda ends: lambda at, j: F.struct(F.get(own, at).alias("term"), (F.get(ends, j + 1) - at).cast("long").alias("tf"))
        return _let(edges, lambda ends: F.transform(F.slice(ends, 1, F.size(ends) - 1), pair(ends)))

    return _let(F.array_sort(F.coalesce(words, F.array().cast("array<string>"))), runs)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def token_count(text: Column) -> Column:
    """An estimate of model tokens: none for an empty text, else one at least."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.size(tokens(text))))


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, _SPACES, " "))


def strip_urls(text: Column) -> Column:
    return collapse(F.regexp_replace(text, URL, ""))


def mentions(text: Column) -> Column:
    """Ids of mentioned users, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<@!?(\d+)>"), F.lit(1)))


def mask_mentions(text: Column, user: str = "@user", role: str = "@role") -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<@!?\d+>", user), r"<@&\d+>", role)


def name_mentions(text: Column, names: Column) -> Column:
    """Mentions become @name where the map ``names`` knows the id; others stay."""
    return F.aggregate(
        mentions(text),
        text,
        lambda t, i: F.when(
            names[i].isNotNull(),
            F.replace(F.replace(t, F.concat(F.lit("<@"), i, F.lit(">")), F.concat(F.lit("@"), names[i])), F.concat(F.lit("<@!"), i, F.lit(">")), F.concat(F.lit("@"), names[i])),
        ).otherwise(t),
    )


def drop_image_placeholders(markdown: Column) -> Column:
    """Without image references and their definitions, as exporters leave them."""
    return F.regexp_replace(F.regexp_replace(markdown, r"!\[[^\]]*\]\[[^\]]*\]", ""), r"(?m)^\[image\d+\]:\s*<?data:[^\n]*\n?", "")


def safe_file_name(name: Column, default: str = "untitled") -> Column:
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}._-]+", "_")
    clean = F.regexp_replace(clean, r"^[._-]+|[._-]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(default)).otherwise(clean)


def entry_key(entry: Column) -> Column:
    return F.substring(F.sha1(entry.cast("binary")), 1, 16)


def output_name(key: Column, title: Column, ext: str) -> Column:
    return F.concat(key, F.lit("__"), safe_file_name(title), F.lit(ext))


def id_of_name(name: Column) -> Column:
    """What stands before the first ``__`` of a file name; null where there is none."""
    return F.when(F.instr(name, "__") > 1, F.substring_index(name, "__", 1))


def channel_of_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"(\d+)\.[^.]*$", 1)
    return F.when(found != "", found)


def tidy_lines(text: Column) -> Column:
    """White space collapsed in each line, and one blank line in a row at most."""
    lines = F.transform(F.split(text, "\n"), collapse)
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def is_symbol_only(token: Column) -> Column:
    """Something visible, but no letter, digit or mark."""
    return token.rlike(r"(?U)\S") & ~token.rlike(r"[\p{L}\p{N}\p{M}]")


def keyword_query(reply: Column) -> Column:
    """A model's keyword list as one query: separators become spaces, quotes go, each word once."""
    plain = F.regexp_replace(F.translate(F.translate(reply, "、，,;；|/\n\t\r", " " * 10), "\"'`「」[]", ""), r"(?m)(^|\s)[-*•]+(?=\s)", "$1")
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda x: x != "")
    return F.array_join(F.array_distinct(words), " ")


def clock(seconds: Column) -> Column:
    """Elapsed seconds as HH:MM:SS."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def local_date(timestamp: Column, zone: str = "Asia/Tokyo") -> Column:
    """yyyy/MM/dd in ``zone`` of a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(timestamp, zone), "yyyy/MM/dd")


def message_date(iso: Column, zone: str = "Asia/Tokyo") -> Column:
    """The local date of an ISO-8601 string; without an offset it is UTC; null where it can't be read."""
    return local_date(F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00")), zone)


def as_bool(value: Column) -> Column:
    """A model's yes or no: true, yes, 1 or a number other than 0; anything else is no."""
    low = F.lower(strip(value.cast("string")))
    return F.coalesce(low.isin("true", "yes", "1", "y", "on"), F.lit(False)) | F.coalesce(
        low.try_cast("double") != 0, F.lit(False)
    )


def chunk_number(value: Column) -> Column:
    return value.try_cast("bigint")
