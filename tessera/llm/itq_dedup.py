"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learned on a bounded sample so that the signs
of the rotated vectors lose little; the signs are codes, cut into substrings, one for
each table, and the vectors with one substring are a bucket. In a bucket codes are
compared by the number of their differing bits; pairs within the radius are
candidates, whose cosine in double precision decides. Width and number of
the tables, and the radius, follow from the rows of a label and from the angle that the bits
see at the threshold: that of the centred vectors, which a common direction
widens. The few vectors so near the mean that their angles would be wider still are
compared with all of their label.

What goes through the tables is ids and codes. Vectors are looked up for candidates;
only where a bucket has many candidates for its size do its vectors meet there as a
whole, and what comes out is then each vector's number of links and one
connection, so a large group of near vectors never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, each_salt, salt, salts_seen, written

#: Vectors that the rotation is learned on, at the most; chosen by a hash of the id.
SAMPLE = 10_000
#: Bits of a code, at the most (no more than dimensions).
BITS = 64
#: Vectors of a block; two blocks are compared in a task.
BLOCK = 2048
#: Chance that a pair at the threshold meets in no table, at the most.
MISS = 1e-4
#: Bits of a substring, at the least.
LEAST_WIDTH = 4
#: Share of the sample that counts as near the mean, and the cosine of centred vectors at the threshold below which all do.
NEAR, WIDEST = 0.002, 0.3
#: Candidates for each row of a cell beyond which its vectors meet there as a whole.
DENSE = 8
# Rows of a block that are held against the other block at a time.
_ROWS = 256
TURNS = 30


def learn_rotation(x: np.ndarray, bits: int = BITS, turns: int = TURNS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The mean of unit vectors ``x`` and the projection whose signs are the code (iterative quantisation)."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(turns):
        # The best signs for the rotation, then the best rotation for the signs.
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype == np.int64 else flat.astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class _Tables:
    """How the vectors of one length are coded: ``per`` substrings of ``width`` bits in a code, ``tables`` in all; pairs within ``radius`` bits of all
    codes are candidates; vectors whose centred length squared is below ``near`` are compared with all."""

    width: int
    per: int
    tables: int
    radius: int
    near: float
    mean: np.ndarray
    turns: list[np.ndarray]


def _tables(x: np.ndarray, rows: int, least: float, block: int, miss: float) -> _Tables:
    """The tables for labels of up to ``rows`` vectors, learned on the unit vectors ``x``."""
    dim = x.shape[1]
    bits = min(BITS, dim)
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    length = ((x - mean) ** 2).sum(axis=1)
    # Unit vectors at the threshold are as far apart when centred, but both shorter: the shorter, the wider their angle.
    near = max(float(np.quantile(length, NEAR)) if len(x) else 0.0, (1 - least) / (1 - WIDEST))
    differ = np.arccos(1 - (1 - least) / near) / np.pi
    width = min(bits, max(LEAST_WIDTH, int(np.ceil(np.log2(max(1, rows) / block))) + 1))
    tables = int(np.ceil(np.log(miss) / np.log1p(-((1 - differ) ** width)))) if width else 1
    per = bits // width
    codes = -(-tables // per)
    n = codes * bits
    radius = int(min(n, np.ceil(n * differ + 5 * np.sqrt(n * differ * (1 - differ)))))
    turns = [learn_rotation(x, bits, seed=7 + k)[1] if len(x) else np.zeros((dim, bits)) for k in range(codes)]
    return _Tables(width, per, tables, radius, near, mean, turns)


def _encode(how: _Tables):
    """Adds codes, a long for each rotation, and whether a vector is near the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(2))) - how.mean
            codes = np.zeros((len(x), len(how.turns)), dtype=np.uint64)
            for c, axes in enumerate(how.turns):
                codes[:, c] = (x @ axes >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(axes.shape[1], dtype=np.uint64))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1])
            lists = pa.ListArray.from_arrays(at, pa.array(codes.view(np.int64).ravel()))
            near = pa.array((x * x).sum(axis=1) < how.near)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, near], ["rep", "label", "v", "mult", "codes", "near"])

    return run


def _keys(codes: np.ndarray, how: _Tables, tables: int) -> np.ndarray:
    """The substrings of the first ``tables`` tables, a column for each."""
    codes = codes.view(np.uint64)
    out = np.empty((len(codes), tables), dtype=np.uint64)
    for t in range(tables):
        out[:, t] = codes[:, t // how.per] >> np.uint64(t % how.per * how.width) & np.uint64((1 << how.width) - 1)
    return out


def _key(how: _Tables, t: int) -> Column:
    """``_keys`` of one table as an expression."""
    shifted = F.shiftrightunsigned(F.col("codes")[t // how.per], t % how.per * how.width)
    return shifted.bitwiseAND(F.lit((1 << how.width) - 1)) if how.width < 64 else shifted


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The places of a cell's two blocks, and whether it is one block with itself."""
    i, j, side = cell["i"][0].as_py(), cell["j"][0].as_py(), cell["block"].to_numpy()
    if i == j:
        return np.arange(len(side)), np.arange(len(side)), True
    return np.flatnonzero(side == i), np.flatnonzero(side != i), False


def _later(linked: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Takes out of ``linked`` the pairs that share a bucket of an earlier table: these are left to that."""
    for t in range(keys.shape[1]):
        linked &= keys[left, t][:, None] != keys[right, t][None, :]


def _candidates(how: _Tables):
    """A cell, two blocks of a bucket or one with itself: its candidates (a, b), or where they are many all its rows, b being null."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("rep").combine_chunks()
        rep, codes = cell["rep"].to_numpy(), _matrix(cell["codes"])
        signs = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        keys = _keys(codes, how, cell["t"][0].as_py())
        left, right, within = _sides(cell)
        found, count = [], 0
        for at in range(0, len(left), _ROWS):
            own = left[at : at + _ROWS]
            # Of signs, the product is the bits that agree less those that differ; unused bits agree.
            near = signs[own] @ signs[right].T >= signs.shape[1] - 2 * how.radius - 0.5
            if within:
                near &= own[:, None] < right[None, :]
            _later(near, keys, own, right)
            count += int(near.sum())
            if count > DENSE * len(rep):
                out = cell.select([*_CELL, "block"]).append_column("a", pa.array(rep))
                return out.append_column("b", pa.nulls(len(rep), pa.int64()))
            p, q = np.nonzero(near)
            found.append((own[p], right[q]))
        p, q = (np.concatenate([f[x] for f in found] or [np.zeros(0, dtype=np.int64)]) for x in (0, 1))
        return cell.select([*_CELL, "block"]).take(pa.array(p)).append_column("a", pa.array(rep[p])).append_column("b", pa.array(rep[q]))

    return run


def _decide(least: float):
    """Of pairs (a, b, va, vb, ma, mb) those that link, once from each side: (a, b, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            linked = (_unit(_matrix(batch["va"])) * _unit(_matrix(batch["vb"]))).sum(axis=1) >= least
            a, b, ma, mb = (batch[c].to_numpy()[linked] for c in ("a", "b", "ma", "mb"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (b, a), (mb, ma))], ["a", "b", "n"])

    return run


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the links between ``left`` (rows) and ``right`` (columns)."""
    root = np.arange(n)

    def least(m: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.concatenate([np.where(m[at : at + _ROWS], label[None, :], n).min(axis=1, initial=n) for at in range(0, len(m), _ROWS)] or [label[:0]])

    while True:
        low = root.copy()
        low[left] = np.minimum(low[left], least(linked, low[right]))
        low[right] = np.minimum(low[right], least(linked.T, low[left]))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(least: float, how: _Tables):
    """A cell whose vectors meet as a whole: of each vector with links there (a, b, n).

    n: how many rows a links with; b: the smallest that a reaches by the cell's
    links, so that what is connected stays so without all pairs coming out. A
    pair that shares a bucket of an earlier table is left to that. A cell of table -1 has vectors near
    the mean in block i, and any in block j.
    """

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("rep", "ascending"), ("block", "ascending")]).combine_chunks()
        rep, mult, t = cell["rep"].to_numpy(), cell["mult"].to_numpy(), cell["t"][0].as_py()
        x, keys = _unit(_matrix(cell["v"])), _keys(_matrix(cell["codes"]), how, max(t, 0))
        left, right, within = _sides(cell)
        # A bit for each pair of two blocks, of a bounded size: no list of pairs.
        linked = np.empty((len(left), len(right)), dtype=bool)
        for at in range(0, len(left), _ROWS):
            own = left[at : at + _ROWS]
            product = x[own] @ x[right].T
            linked[at : at + _ROWS] = product >= least
            # The product may round otherwise than the sum of a pair; close to the threshold the latter decides.
            p, q = np.nonzero(np.abs(product - least) < 1e-9)
            linked[at + p, q] = (x[own[p]] * x[right[q]]).sum(axis=1) >= least
        if within:
            np.fill_diagonal(linked, False)
        _later(linked, keys, left, right)
        n = np.zeros(len(rep), dtype=np.int64)
        n[left] += linked @ mult[right]
        if not within:
            n[right] += mult[left] @ linked
        has = np.flatnonzero(n)
        return pa.table({"a": rep[has], "b": rep[_roots(linked, left, right, len(rep))[has]], "n": n[has].astype(np.int64)})

    return run


_CELL = ["label", "t", "key", "i", "j"]


def _cells(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of buckets (label, t, key), those of more than a block dealt to cells of two blocks, or of one with itself."""
    rows = rows.join(large, ["label", "t", "key", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("label", "t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "codes")


def _near_cells(keyed: DataFrame, block: int) -> DataFrame:
    """Cells of table -1: each block of a label's vectors near the mean with itself and with each block of the label's vectors."""
    size = keyed.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("near").cast("int")).alias("near_n"), salts_seen().alias("salts")).where("near_n > 0")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block).cast("int"))
    size = size.select("label", parts(F.col("near_n")).alias("ni"), parts(F.col("n") - F.col("near_n")).alias("nj"), each_salt("salts").alias("salt"))
    rows = keyed.join(size, ["label", "salt"])
    # Blocks 0 to ni - 1 are of near vectors, those after them of the others.
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rows = rows.withColumn("block", F.when(F.col("near"), spot("ni")).otherwise(F.col("ni") + spot("nj")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("ni") + F.col("nj")).otherwise(F.col("ni")) - 1)))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return rows.select("label", F.lit(-1).alias("t"), F.lit(0).cast("long").alias("key"), *pair, "block", "rep", "mult", "v", "codes")


def _links(own: DataFrame, dim: int, least: float, sample: int, block: int, miss: float) -> DataFrame:
    """(a, b, n) of classes of one length: a's links in a cell, and what it is connected to there; own(label, v, rep, mult)."""
    most, total = own.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    picked = own.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, total or 0)) * (1 << 20)) + 1).select("v").limit(2 * sample)
    x = np.array([r[0] for r in picked.collect()], dtype=np.float64).reshape(-1, dim)
    how = _tables(_unit(x) if len(x) else x, most or 0, least, block, miss)
    plain = own.select("rep", "label", "v", "mult")
    keyed = plain.mapInArrow(_encode(how), "rep long, label string, v array<double>, mult long, codes array<long>, near boolean")
    keyed = written(keyed.withColumn("salt", salt("rep")))
    slim = keyed.where("NOT near").select("rep", "label", "codes", "salt", F.posexplode(F.array(*[_key(how, t) for t in range(how.tables)])).alias("t", "key"))
    large = slim.groupBy("label", "t", "key").agg(F.count("*").alias("count"), salts_seen().alias("salts")).where(F.col("count") > block)
    large = large.select("label", "t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"), each_salt("salts").alias("salt"))
    asked = _cells(slim, large).groupBy(*_CELL).applyInArrow(_candidates(how), "label string, t int, key long, i int, j int, block int, a long, b long")
    asked = written(asked)
    known = keyed.select("rep", "v", "mult", "codes")
    side = lambda c: known.select(F.col("rep").alias(c), F.col("v").alias(f"v{c}"), F.col("mult").alias(f"m{c}"))
    pairs = asked.where("b IS NOT NULL").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    sparse = pairs.select("a", "b", "va", "vb", "ma", "mb").mapInArrow(_decide(least), "a long, b long, n long")
    dense = asked.where("b IS NULL").select(*_CELL, "block", F.col("a").alias("rep")).join(known, "rep")
    whole = dense.select(*_CELL, "block", "rep", "mult", "v", "codes").unionByName(_near_cells(keyed, block))
    return sparse.unionByName(whole.groupBy(*_CELL).applyInArrow(_compare(least, how), "a long, b long, n long"))


def vector_groups(
    vectors: DataFrame, least: float = 0.93, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    sample: int = SAMPLE, block: int = BLOCK, miss: float = MISS,
) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of one label and length link where their cosine, in double
    precision, is ``least`` or more; a pair at ``least`` is missed with a chance of
    ``miss`` or so, one of a vector near the mean never. Null labels, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing.
    n_links counts the other rows linked directly, equal vectors included; they
    are one class within and so cost nothing. Rows with one id share its
    component; a null id has a null component and is kept. A vector of any length
    is compared whole. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    source = vectors.select(
        vectors[id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"), vectors[label].cast("string").alias("label")
    )
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = source.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.col("vec_id").isNotNull())
    usable = usable.withColumn("label", F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label")))
    usable = usable.withColumn("salt", salt("vec_id"))
    classes = written(usable.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), salts_seen().alias("salts")))
    found = None
    # Few different lengths occur in a table of embeddings; each has its own rotations.
    for dim in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        links = _links(classes.where(F.size("v") == dim), dim, least, sample, block, miss)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("mult").alias("n")).where("false")
    links = written(found)
    degree = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("beyond"))
    comp = components(classes.select(F.col("rep").alias("node")).distinct(), links).select(F.col("node").alias("rep"), "component")
    known = classes.join(degree, "rep", "left").join(comp, "rep")
    # Equal vectors find their class by salts, for which it has a row each.
    known = written(
        known.select("label", "v", (F.col("mult") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), "component", each_salt("salts").alias("salt"))
    )
    members = usable.select("vec_id", "label", "v", "salt").join(known, ["label", "v", "salt"]).select("vec_id", "n_links", "component")
    ids = members.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"), F.count("*").alias("n"))
    return source.select("vec_id").join(ids, "vec_id", "left").select(
        "vec_id",
        F.coalesce((F.col("n_links") / F.col("n")).cast("long"), F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
