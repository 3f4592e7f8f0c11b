"""Secret scans: fixed patterns and a randomness test battery, in SQL functions only.

Fixed patterns give the base spans. The battery looks at every other long token,
and at what base spans leave of one: it infers the token's encoding from its characters, tests how well the symbols
fit a random string of that alphabet (chi-squared uniformity, runs about the
middle of the alphabet, correlation of neighbouring symbols), and takes the
token as a secret if a random string would look so and prose would not. The
chance under prose depends on the length; the Benjamini-Hochberg rule over the
tokens of a document controls the false discoveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What every assignment with a long enough value has; most texts lack it, which costs less to see.
_ASSIGNED = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
# The runs are greedy, so a shorter run never hides a longer one: the least length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A token that the battery tests: a run of base64 symbols, or else of those of its form for URLs; 20 are the least that it can tell.
LEAST = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{20,}+(?![_-])|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
KINDS = ("assign", "access", "hex", "random")
#: False discovery rate among the tokens of a document.
FDR = 0.01
#: A token that a random string would undercut this seldom is not random.
RANDOM_P = 0.001
#: Chance that two letters of prose are equal, at the least (languages have 0.065 and more).
PROSE_MATCH = 0.06
#: Share of prose letters that are a to f, at the most.
HEX_LETTERS = 0.35
#: Sums of lengths are made in blocks, so that many hits in a long text stay cheap.
_BLOCK = 256
#: Code points of a block of a text that is rewritten.
_PART = 4096

_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"
# Alphabets in the order of their encodings' symbols, tried in turn; fixed values.
_ALPHABETS = (
    ("decimal", "0123456789", "^[0-9]+$"),
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("hex_upper", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("lower", "abcdefghijklmnopqrstuvwxyz", "^[a-z]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "^[A-Za-z0-9]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[A-Za-z0-9_-]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[A-Za-z0-9+/]+$"),
)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(gaps: Column, hits: Column) -> Column:
    """The place of each hit: the lengths of all gaps and hits before it, and of its own gap."""
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    sums = lambda steps: F.transform(
        F.sequence(F.lit(0), block(F.size(steps) - 1)), lambda b: _sum(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    )
    before = lambda blocks: F.transform(blocks, lambda _, b: _sum(F.slice(blocks, F.lit(1), b)))
    return _let(
        F.slice(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), F.lit(1), F.size(hits)),
        lambda steps: _let(
            sums(steps),
            lambda blocks: _let(
                before(blocks),
                lambda sofar: F.transform(
                    hits,
                    lambda _, i: F.get(sofar, block(i))
                    + _sum(F.slice(steps, block(i) * _BLOCK + 1, i % _BLOCK))
                    + F.length(F.get(gaps, i)),
                ),
            ),
        ),
    )


def _with_spans(df: DataFrame, pattern: str, kind: int, out: str, least: int = 0) -> DataFrame:
    """Adds ``out``: the matches of ``pattern`` in _text as (start, kind, end, value)."""
    found = F.col("_text").rlike(_ASSIGNED if least else pattern)
    df = df.withColumn("_hits", F.when(found, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")))
    df = df.withColumn("_gaps", F.when(F.col("_hits").isNotNull(), F.split("_text", pattern, -1)))
    value = F.regexp_extract_all("_text", F.lit(pattern), F.lit(2)) if least else F.col("_hits")
    df = df.withColumn("_values", F.when(F.col("_hits").isNotNull(), value))
    df = df.withColumn("_at", F.when(F.col("_hits").isNotNull(), _starts(F.col("_gaps"), F.col("_hits"))))
    spans = F.transform(
        F.col("_hits"),
        lambda h, i: F.struct(
            F.get("_at", i).alias("s"),
            F.lit(kind).alias("k"),
            (F.get("_at", i) + F.length(h)).alias("e"),
            F.get("_values", i).alias("v"),
        ),
    )
    if least:
        spans = F.filter(spans, lambda x: F.length(x["v"]) >= least)
    return df.withColumn(out, F.coalesce(spans.cast(_SPAN), F.array().cast(_SPAN))).drop("_hits", "_gaps", "_values", "_at")


def _normal_below(z: Column) -> Column:
    """The normal distribution's share below z (a polynomial with error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = (
        F.exp(-a * a / 2) * 0.3989422804014327
        * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    )
    return F.when(z > 0, 1 - tail).otherwise(tail)


def battery(token: Column) -> Column:
    """Struct of the tests of a token: n, size of its alphabet, p_random and p_prose.

    p_random: three times the least of the p-values of uniformity (upper tail),
    of the runs (two tails) and of the serial correlation (two tails), at most 1,
    under a random string of the inferred alphabet. p_prose: the chance of so
    small a chi-squared under prose letters in that alphabet; it falls with the
    length for a random string, and stays near a half for prose.
    """
    alphabet = F.coalesce(*[F.when(token.rlike(rule), F.lit(letters)) for _, letters, rule in _ALPHABETS])
    return _let(
        alphabet,
        lambda letters: _let(
            F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(letters, c) - 1),
            lambda codes: _let(
                F.struct(
                    F.length(letters).cast("double").alias("size"),
                    F.size(codes).cast("double").alias("n"),
                    (_sum(codes) / F.size(codes)).alias("mean"),
                    F.transform(codes, lambda c: F.when(c * 2 >= F.length(letters), 1).otherwise(0)).alias("upper"),
                ),
                lambda x: _let(_statistics(token, codes, x), lambda y: _decision(x["n"], x["size"], y)),
            ),
        ),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _statistics(token: Column, codes: Column, x: Column) -> Column:
    n, size, mean = x["n"], x["size"], x["mean"]
    counts = F.transform(
        F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)).cast("double")
    )
    pairs = F.zip_with(F.slice(codes, F.lit(2), F.size(codes)), codes, lambda b, a: (a - mean) * (b - mean))
    turns = F.zip_with(F.slice(x["upper"], F.lit(2), F.size(codes)), x["upper"], lambda b, a: F.when(a != b, 1).otherwise(0))
    return F.struct(
        (F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * size / n - n).alias("chi"),
        _sum(x["upper"]).cast("double").alias("ups"),
        # The pair past the end has no second part and counts as nothing.
        (1 + F.aggregate(F.slice(turns, F.lit(1), F.size(codes) - 1), F.lit(0), lambda a, t: a + t)).alias("runs"),
        F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)).alias("spread"),
        F.aggregate(F.slice(pairs, F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda a, c: a + c).alias("shared"),
    )


def _decision(n: Column, size: Column, y: Column) -> Column:
    df, chi, ups = size - 1, y["chi"], y["ups"]
    # Of a short token, pairs of equal symbols are rare and so near to a Poisson count, whose upper tail is that of a
    # gamma variable; of a longer one, chi-squared itself. For both, Wilson and Hilferty: the cube root is near normal.
    pairs, expected = (chi * n / size + n * n / size - n) / 2, n * (n - 1) / (2 * size)
    p_few = F.when(pairs < 0.5, 1.0).otherwise(
        _normal_below(3 * F.sqrt(pairs) * (F.pow(expected / pairs, F.lit(1 / 3)) - 1 + 1 / (9 * pairs)))
    )
    p_many = 1 - _normal_below((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    p_uniform = F.when(n < size, p_few).otherwise(p_many)
    # Runs of symbols in the upper and the lower half of the alphabet, given how many there are of each.
    mixed = 2 * ups * (n - ups)
    run_sd = F.sqrt(F.greatest(mixed * (mixed - n) / (n * n * (n - 1)), F.lit(1e-9)))
    p_runs = F.when(mixed > 0, 2 * _normal_below(-F.abs(y["runs"] - mixed / n - 1) / run_sd)).otherwise(0.0)
    p_serial = F.when(y["spread"] > 0, 2 * _normal_below(-F.abs(y["shared"] / y["spread"] + 1 / n) * F.sqrt(n))).otherwise(0.0)
    # Under prose, pairs of equal symbols are PROSE_MATCH of all; the spread has a part from the
    # uneven letters that grows with the length.
    lift = (n - 1) * F.greatest(size * PROSE_MATCH - 1, F.lit(0.0))
    z_prose = (chi - df - lift) / F.sqrt(2 * df + 4 * lift)
    # Numbers are common in prose, so no decimal token counts; of prose letters few are hexadecimal.
    p_prose = F.when(size == 10, 1.0).when(size == 16, F.pow(F.lit(HEX_LETTERS), n)).otherwise(_normal_below(z_prose))
    return F.struct(
        n.alias("n"),
        size.alias("size"),
        F.least(F.lit(1.0), 3 * F.least(p_uniform, p_runs, p_serial)).alias("p_random"),
        p_prose.alias("p_prose"),
    )


def _stretches(spans: Column) -> Column:
    """The stretches (s, e) that spans, ordered by start, cover: spans that meet are one."""
    span = "array<struct<s:int,e:int>>"

    def joined(x: Column, tops: Column) -> Column:
        # The first span of each stretch begins beyond the ends of all before it.
        firsts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] > F.get(tops, i - 1)))
        return _let(firsts, lambda f: F.transform(f, lambda i, j: F.struct(F.get(x, i)["s"].alias("s"), F.get(tops, F.coalesce(F.get(f, j + 1), F.size(x)) - 1).alias("e"))))

    found = _let(spans, lambda x: _let(_tops(F.transform(x, lambda y: y["e"])), lambda tops: joined(x, tops)))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast(span))


def _tops(values: Column) -> Column:
    """The largest of each value and all before it, by blocks."""
    part = lambda v, b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))
    return _let(
        values,
        lambda v: _let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.array_max(part(v, b))),
            lambda blocks: _let(
                F.transform(blocks, lambda _, b: F.coalesce(F.array_max(F.slice(blocks, F.lit(1), b)), F.lit(-1))),
                lambda sofar: F.transform(
                    v,
                    lambda _, i: _let(
                        F.floor(i / _BLOCK).cast("int"),
                        lambda b: F.greatest(F.get(sofar, b), F.array_max(F.slice(v, b * _BLOCK + 1, i % _BLOCK + 1))),
                    ),
                ),
            ),
        ),
    )


def _count_below(n: Column, below) -> Column:
    """How many of the places 0 to n - 1 ``below`` holds for, which it does up to some place and not after it: by halving."""
    ends = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        go = (a["lo"] < a["hi"]) & below(middle)
        return F.struct(F.when(go, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(go, a["hi"]).otherwise(F.greatest(a["lo"], F.least(middle, a["hi"]))).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1), ends, step, lambda a: a["lo"])


def _outside(tokens: Column, stretches: Column) -> Column:
    """What the stretches leave of tokens, both in order: parts of LEAST symbols or more."""
    begin = F.concat(F.array(F.lit(0)), F.transform(stretches, lambda x: x["e"]))
    end = F.concat(F.transform(stretches, lambda x: x["s"]), F.array(F.lit(2**31 - 1)))
    part = "struct<s:int,k:int,e:int,v:string>"

    def parts(t: Column, free: Column) -> Column:
        # The free stretches that end after the token's beginning and begin before its end.
        first = _count_below(F.size(free), lambda i: F.get(free, i)["e"] <= t["s"])
        last = _count_below(F.size(free), lambda i: F.get(free, i)["s"] < t["e"])
        own = lambda f: F.struct(F.greatest(f["s"], t["s"]).alias("s"), F.least(f["e"], t["e"]).alias("e"))
        cut = lambda p: F.struct(p["s"].alias("s"), t["k"].alias("k"), p["e"].alias("e"), F.substring(t["v"], p["s"] - t["s"] + 1, p["e"] - p["s"]).alias("v"))
        some = _let(
            F.struct(first.alias("a"), last.alias("b")),
            lambda r: F.when(r["b"] > r["a"], F.transform(F.sequence(r["a"], r["b"] - 1), lambda i: own(F.get(free, i)))).otherwise(F.array().cast("array<struct<s:int,e:int>>")),
        )
        return F.transform(F.filter(some, lambda p: p["e"] - p["s"] >= LEAST), cut).cast(f"array<{part}>")

    return _let(F.arrays_zip(begin.alias("s"), end.alias("e")), lambda free: F.flatten(F.transform(tokens, lambda t: parts(t, free))))


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """``keep`` columns, the text (null: empty) as _text, base and spans for each row.

    Both are arrays of (s: start, k: place in KINDS, e: end, v: value), by start
    and kind; positions are code points, ends exclusive; assign spans are whole
    matches, its value the assigned string. spans is base plus the tokens that
    the battery takes; a token that a base span covers in part is tested by its
    parts outside. A text without hits has empty arrays, and so has an empty one;
    a text of any length is scanned whole; repeated rows are each scanned; an
    empty table gives an empty result. Columns to keep may have any names but
    _text, base and spans; others are ignored.
    """
    df = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(docs[text], F.lit("")).alias("_text"))
    df = _with_spans(df, ASSIGN, 0, "_assign", least=12)
    df = _with_spans(df, ACCESS, 1, "_access")
    df = _with_spans(df, HEX, 2, "_hex")
    df = df.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = _with_spans(df, TOKEN, 3, "_tokens")
    meets = (F.size("base") > 0) & (F.size("_tokens") > 0)
    df = df.withColumn("_cuts", F.when(meets, _stretches(F.col("base"))))
    df = df.withColumn("_tokens", F.when(meets, _outside(F.col("_tokens"), F.col("_cuts"))).otherwise(F.col("_tokens")))
    df = df.withColumn("_tests", F.transform("_tokens", lambda t: battery(t["v"])))
    df = df.withColumn("_ps", F.array_sort(F.transform("_tests", lambda t: t["p_prose"])))
    # Benjamini and Hochberg: the largest p that is within its rank's share of the rate.
    passed = _let(
        F.col("_ps"), lambda ps: F.filter(F.transform(ps, lambda p, i: F.when(p <= fdr * (i + 1) / F.size(ps), p)), lambda p: p.isNotNull())
    )
    df = df.withColumn("_most", F.coalesce(F.array_max(passed), F.lit(-1.0)))
    # A column that a lambda names once is worked out for every element: the bar is bound before.
    taken = _let(
        F.col("_most"),
        lambda most: F.filter(F.arrays_zip("_tokens", "_tests"), lambda x: (x["_tests"]["p_prose"] <= most) & (x["_tests"]["p_random"] >= RANDOM_P)),
    )
    df = df.withColumn("spans", F.array_sort(F.concat("base", F.transform(taken, lambda x: x["_tokens"]))))
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "_text", "base", "spans")


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Counts of the base kinds, the digest of the base spans, and all spans, as
    kind:start:end by start, then kind. A null or empty text, and one without
    hits, has no spans; texts of any length are scanned whole; rows that repeat
    are each reported; a null id stays null; other columns are ignored; an empty
    table gives an empty result.
    """
    found = secret_spans(docs)
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret spans in ``text`` replaced by ``mark``.

    All rows and columns stay; a text without secrets is untouched, null included.
    """
    columns, at = docs.columns, docs.columns.index("text")
    # Under other names, whatever the columns are called.
    own = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    found = secret_spans(own, text=f"c{at}", keep=tuple(own.columns))
    found = found.withColumn("_cuts", F.when(F.size("spans") > 0, _stretches(F.col("spans"))))
    # The text in blocks, so that a piece is sought in its own ones and not from the text's beginning.
    found = found.withColumn("_parts", F.when(F.size("spans") > 0, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))))

    def between(parts: Column, begin: Column, end: Column) -> Column:
        block = lambda at: F.floor(at / _PART).cast("int")
        inside = lambda j: F.greatest(begin - j * _PART, F.lit(0))
        own = F.transform(F.sequence(block(begin), block(end - 1)), lambda j: F.substring(F.get(parts, j), inside(j) + 1, F.least(end - j * _PART, F.lit(_PART)) - inside(j)))
        return F.when(end > begin, F.array_join(own, "")).otherwise("")

    def cleaned(cuts: Column, parts: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["e"])
        pieces = F.transform(cuts, lambda c, i: F.concat(between(parts, before(i), c["s"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), between(parts, F.get(cuts, F.size(cuts) - 1)["e"], F.length("_text")))

    clean = _let(F.col("_cuts"), lambda cuts: _let(F.col("_parts"), lambda parts: cleaned(cuts, parts)))
    text = F.when(F.col("_cuts").isNotNull(), clean).otherwise(F.col(f"c{at}"))
    return found.select(*[text.alias(c) if i == at else F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
