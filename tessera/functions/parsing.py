"""Reading what models reply: JSON in fences, with slips, or plain text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import as_bool, strip

ANSWER = "answer string, sources array<string>, follow_up_queries array<string>, needs_additional_memory string"


def unfence(reply: Column) -> Column:
    """What a code fence encloses, or the whole reply."""
    inside = F.regexp_extract(reply, r"(?s)```[A-Za-z0-9_-]*\s*\n(.*?)\n?\s*```", 1)
    return strip(F.when(inside != "", inside).otherwise(reply))


def mend_json(text: str) -> str:
    """JSON with a writer's slips mended; text that is JSON already comes back as it is.

    An automaton goes over the characters once. It knows the open brackets and whether it
    stands in a string: a quote ends one only where what follows can follow a string, others are
    escaped, as are raw control characters and backslashes that escape nothing. Outside of strings
    commas before a closing bracket go, missing ones between values come, typographic and single quotes
    are quotes, and Python's names of constants become JSON's. What is open at the end is closed.
    """
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    out: list[str] = []
    open_: list[str] = []
    n, i = len(text), 0

    def after(at: int) -> str:
        while at < n and text[at].isspace():
            at += 1
        return text[at] if at < n else ""

    def last() -> str:
        k = len(out) - 1
        while k >= 0 and out[k].isspace():
            k -= 1
        return out[k][-1] if k >= 0 else ""

    def drop_comma() -> None:
        k = len(out) - 1
        while k >= 0 and out[k].isspace():
            k -= 1
        if k >= 0 and out[k] == ",":
            del out[k]

    def value_begins() -> None:
        # After a value, a comma must stand before the next one.
        if last() and last() not in "{[,:":
            out.append(",")

    while i < n:
        c = text[i]
        if c in _QUOTES:
            value_begins()
            # A key ends before a colon; a value before a comma, a closing bracket, or the end.
            key = bool(open_) and open_[-1] == "{" and last() in "{,"
            out.append('"')
            i += 1
            while i < n:
                c = text[i]
                if c == "\\":
                    follows = text[i + 1 : i + 2]
                    good = follows in '"\\/bfnrt' and follows or (follows == "u" and len(text[i + 2 : i + 6]) == 4 and all(x in "0123456789abcdefABCDEF" for x in text[i + 2 : i + 6]))
                    out.append(c + follows if good else "\\\\")
                    i += 2 if good else 1
                elif c in _QUOTES and _ends(text, i, key, after):
                    break
                elif c == '"':
                    out.append('\\"')
                    i += 1
                elif c < " ":
                    out.append(json.dumps(c)[1:-1])
                    i += 1
                else:
                    out.append(c)
                    i += 1
            out.append('"')
            i += 1
        elif c in "{[":
            value_begins()
            open_.append(c)
            out.append(c)
            i += 1
        elif c in "}]":
            drop_comma()
            # A bracket that closes an outer one closes what is open inside it; one that closes nothing goes.
            want = "{" if c == "}" else "["
            if want in open_:
                while open_[-1] != want:
                    out.append("}" if open_.pop() == "{" else "]")
                open_.pop()
                out.append(c)
            i += 1
        elif c in ",:" or c.isspace():
            if c != "," or last() not in ",{[":
                out.append(c)
            i += 1
        else:
            word = _WORD.match(text, i).group()
            value_begins()
            out.append(_CONSTANTS.get(word) or (word if _NUMBER.fullmatch(word) else json.dumps(word)))
            i += len(word)
    if open_:
        drop_comma()
        if last() == ":":
            out.append("null")
    while open_:
        out.append("}" if open_.pop() == "{" else "]")
    return "".join(out)


_QUOTES = "\"'“”„"
_WORD = re.compile(r"[^\s,:{}\[\]\"'“”„]+")
_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_CONSTANTS = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null"}
_NEXT_KEY = re.compile(r"\s*,\s*[\"'“„][^\"'“”„]{0,80}[\"'”]\s*:")

_MEMBER = re.compile(r"\s*[\"“„][^\"'“”„]{0,80}[\"”]\s*:")


def _ends(text: str, i: int, key: bool, after: Callable[[int], str]) -> bool:
    """Whether the quote at ``i`` ends its string, by what follows it."""
    follows = after(i + 1)
    if key:
        return follows == ":"
    if text[i] == "'" and text[i - 1 : i].isalnum() and text[i + 1 : i + 2].isalnum():
        return False
    if follows == ",":
        # A comma may be prose's own: then what comes after it is no value.
        rest = text[text.index(",", i + 1) + 1 :].lstrip()
        return not rest or rest[0] in "\"'“„{[-0123456789}]" or rest.startswith(("true", "false", "null", "True", "False", "None")) or bool(_NEXT_KEY.match(text, i + 1))
    # Another member may follow without its comma.
    return follows in ("", "}", "]") or bool(_MEMBER.match(text, i + 1))


def repair_json(text: Column) -> Column:
    """``mend_json`` of a column; null stays null."""
    return F.pandas_udf(lambda s: s.map(mend_json, na_action="ignore"), "string")(text)


def json_object(reply: Column) -> Column:
    """The reply if it is JSON, or its part from the first { to the last }, or what the repair makes of it; null if none is."""
    body = unfence(reply)
    part = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole = F.coalesce(*[F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in (body, part)])
    # Only what cannot be read goes to the repair; an object may lack its end, so the part from its beginning is tried.
    broken = F.when(whole.isNull(), F.regexp_extract(body, r"(?s)(\{.*)", 1))
    mended = repair_json(F.when(broken != "", broken))
    return F.coalesce(whole, F.when(F.try_parse_json(mended).isNotNull(), mended))


def chunk_list(reply: Column) -> Column:
    """Texts of a reply that is a list of strings or {"chunks": [...]}: trimmed, without empty ones; null if there are none."""
    body = unfence(reply)
    fixed = repair_json(F.when(F.try_parse_json(body).isNull(), body))
    found = F.coalesce(
        F.from_json(body, "array<string>"), F.from_json(body, "chunks array<string>")["chunks"],
        F.from_json(fixed, "array<string>"), F.from_json(fixed, "chunks array<string>")["chunks"],
    )
    clean = F.filter(F.transform(F.filter(found, lambda x: x.isNotNull()), strip), lambda x: x != "")
    return F.when(F.size(clean) > 0, clean)


def summary_text(reply: Column) -> Column:
    """The summary of a reply: the text of its JSON, or else the reply itself."""
    body = unfence(reply)
    parsed = F.from_json(body, "summary string, text string")
    return F.coalesce(parsed["summary"], parsed["text"], F.element_at(F.concat(chunk_list(reply), F.array(F.lit(None).cast("string"))), 1), body)


def answer_payload(reply: Column, n_sources: Column, max_queries: int = 3) -> Column:
    """Struct of an answer: answer, sources (valid numbers, each once), follow_up_queries, needs_additional_memory.

    Null where the reply has no JSON object or an empty answer. A number is
    valid from 1 to ``n_sources``; a single follow-up query may be a string.
    """
    body = json_object(reply)
    parsed = F.from_json(body, ANSWER)
    single = F.get_json_object(body, "$.follow_up_queries")
    numbers = F.transform(F.coalesce(parsed["sources"], F.array().cast("array<string>")), lambda x: x.try_cast("double").try_cast("int"))
    numbers = F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= n_sources)))
    queries = F.coalesce(parsed["follow_up_queries"], F.when(~single.startswith("["), F.array(single)), F.array().cast("array<string>"))
    queries = F.array_distinct(F.filter(F.transform(queries, strip), lambda x: x != ""))
    answer = strip(parsed["answer"])
    return F.when(
        answer != "",
        F.struct(
            answer.alias("answer"),
            numbers.alias("sources"),
            F.slice(queries, 1, max_queries).alias("follow_up_queries"),
            as_bool(parsed["needs_additional_memory"]).alias("needs_additional_memory"),
        ),
    )


def tool_calls(reply: Column) -> Column:
    """Names of the tools a reply calls, as JSON or in function-call blocks; an empty list means none, null unreadable."""
    body = json_object(reply)
    listed = F.from_json(body, "tool_calls array<struct<name:string>>")["tool_calls"]
    single = F.from_json(body, "name string")["name"]
    blocks = F.regexp_extract_all(reply, F.lit(r"(?s)<function(?:_call)?[^>]*name=\"([^\"]+)\""), F.lit(1))
    return F.coalesce(
        F.transform(listed, lambda x: x["name"]), F.when(single.isNotNull(), F.array(single)), F.when(F.size(blocks) > 0, blocks)
    )


def clean_source(source: Column) -> Column:
    return F.regexp_replace(source, r"^\s*\[\d+\]\s*", "")
