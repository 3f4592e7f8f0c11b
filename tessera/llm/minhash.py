"""Near-duplicate groups by SuperMinHash, banding, verification and components.

A signature has SLOTS values. Each shingle offers the value j + r to the slot
that is j-th in the shingle's own order of the slots, r a fraction; a slot keeps
the least. Rounds j stop early for a text when no slot could still fall. As each
shingle visits every slot at a different rank, the slots are negatively
correlated, and the estimate varies less than with independent hashes.

Texts with one word sequence are one class and only its smallest id goes on.
Classes that share a band are compared with a leader of that bucket, not with
each other, and look-alikes (by the share of equal slots) form groups. Each text
is verified with the leader that looks nearest. What this leaves outside the
largest component of its group is then compared with the whole group, exactly
and block by block, so that no pairs are written but links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SALTS, components, each_salt, salt, salts_seen, written
from tessera.llm.shingles import buffers, chunks, mix, sequence_digest, shingle_hashes

#: Slots of a signature; a power of two.
SLOTS = 128
#: Slots of a band, and bands: a pair at 0.8 shares a band but for 5 of 100,000 such pairs.
BAND, BANDS = 5, 25
#: Estimates below the threshold less this are not verified; it is nearly five standard deviations.
SLACK = 0.17


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures of some texts: rank times 2**32 plus a fraction, in each slot."""
    n = len(begin) - 1
    out = np.full(n * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(begin))
    keys = [((hashes >> np.uint64(8 * k)) & np.uint64(0xFF)).astype(np.uint8) for k in range(6)]
    mask = np.uint8(SLOTS - 1)
    for rank in range(SLOTS):
        if not len(hashes):
            break
        # The slot of this rank in each shingle's order: a keyed bijection of the ranks.
        slot = (np.uint8(rank) * (keys[0] | np.uint8(1)) + keys[1]) & mask
        slot ^= slot >> np.uint8(3)
        slot = (slot * (keys[2] | np.uint8(1)) + keys[3]) & mask
        slot ^= slot >> np.uint8(4)
        slot = (slot * (keys[4] | np.uint8(1)) + keys[5]) & mask
        value = (mix(hashes + np.uint64(rank * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)) | np.uint64(rank << 32)
        np.minimum.at(out, owner * SLOTS + slot, value)
        # A text is done when no slot has more than the next rank can offer.
        open_texts = out.reshape(n, SLOTS).max(axis=1) >= np.uint64((rank + 1) << 32)
        still = open_texts[owner]
        if not still.all():
            hashes, owner = hashes[still], owner[still]
            keys = [k[still] for k in keys]
    return out.reshape(n, SLOTS)


_SKETCH = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                hashes, begin = shingle_hashes(raw, offsets[a : b + 1], size)
                counts = [len(np.unique(hashes[begin[i] : begin[i + 1]])) for i in range(b - a)]
                sig = signatures(hashes, begin)
                bands = np.empty((b - a, BANDS), dtype=np.uint64)
                for k in range(BANDS):
                    key = np.full(b - a, k + 1, dtype=np.uint64)
                    for j in range(BAND):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * BAND + j])
                    bands[:, k] = key
                small = (mix(sig) & np.uint64(0xFF)).astype(np.uint8)
                has = [c > 0 for c in counts]
                texts = [raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(counts, pa.int64()),
                        pa.array([sequence_digest(t) if h else None for t, h in zip(texts, has)], pa.binary()),
                        pa.array([s.tobytes() if h else None for s, h in zip(small, has)], pa.binary()),
                        pa.array([list(x) if h else None for x, h in zip(bands.view(np.int64), has)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "sig", "bands"],
                )

    return run


def _agreeing(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = share >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "estimate"]
            ).filter(pa.array(keep))

    return run


def _verify(size: int, num: int, den: int):
    """Pairs (a, b, text of a, text of b) with den * intersection >= num * union on their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for i in (2, 3):
                raw, offsets = buffers(batch.column(i))
                sets = []
                for a, b in chunks(offsets):
                    hashes, begin = shingle_hashes(raw, offsets[a : b + 1], size)
                    sets += [np.unique(hashes[begin[k] : begin[k + 1]]) for k in range(b - a)]
                sides.append(sets)
            keep = []
            for x, y in zip(*sides):
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(both) - common) and len(both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    pairs = pairs.select("a", "b").withColumn("salt", salt("a"))
    with_a = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    with_a = with_a.withColumn("salt", salt("a"))
    led = pairs.groupBy("b").agg(salts_seen().alias("salts")).join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_a.join(led.select("b", "tb", each_salt("salts").alias("salt")), ["b", "salt"])
    return both.select("a", "b", "ta", "tb").mapInArrow(_verify(size, num, den), "a long, b long")


def _compare(size: int, num: int, den: int):
    """A block of texts against another: links between components, one for each text and component at most."""

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        raw, offsets = buffers(table["text"].combine_chunks())
        out = []
        for a, b in chunks(offsets):
            hashes, begin = shingle_hashes(raw, offsets[a : b + 1], size)
            out += [np.unique(hashes[begin[k] : begin[k + 1]]) for k in range(b - a)]
        return out

    def run(table: pa.Table) -> pa.Table:
        left = table.filter(pa.array(table["side"].to_numpy() == 0))
        right = table.filter(pa.array(table["side"].to_numpy() == 1))
        found: tuple[list[int], list[int]] = ([], [])
        if left.num_rows and right.num_rows:
            theirs = sets_of(right)
            sizes = np.array([len(x) for x in theirs])
            ids, comps = right["rep"].to_numpy(), right["comp"].to_numpy()
            every = np.concatenate(theirs)
            order = np.argsort(every, kind="stable")
            owner = np.repeat(np.arange(len(theirs)), sizes)[order]
            keys, first = np.unique(every[order], return_index=True)
            ends = np.append(first[1:], len(every))
            for mine, rep, comp in zip(sets_of(left), left["rep"].to_pylist(), left["comp"].to_pylist()):
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                at = at[keys[at] == mine]
                if not len(at):
                    continue
                common = np.bincount(np.concatenate([owner[first[k] : ends[k]] for k in at]), minlength=len(theirs))
                hit = np.flatnonzero((den * common >= num * (sizes + len(mine) - common)) & (comps != comp))
                _, one = np.unique(comps[hit], return_index=True)
                found[0].extend([rep] * len(one))
                found[1].extend(ids[hit[one]].tolist())
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


#: A block that is compared with another has so many texts, and bytes of them, on average.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20


def _rest(groups: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links that leaders left open: (node, component: the group of look-alikes, comp) against their whole group.

    Of each group the texts outside its largest component are compared with
    all of the group, a block with a block, so that only links come out.
    """
    sized = groups.groupBy("component", "comp").agg(F.count("*").alias("n"))
    whole = sized.groupBy("component").agg(
        F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "comp")).alias("top")
    )
    # The one pair of a group of two is known already.
    open_groups = whole.where("parts > 1 and n > 2").select("component", F.col("top.comp").alias("main"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    rows = groups.withColumn("salt", salt("node")).join(open_groups.select("component", "main", every_salt), ["component", "salt"]).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    rows = written(rows.select("component", "main", F.col("node").alias("rep"), "comp", "text"))
    outside = F.col("comp") != F.col("main")
    size_of = F.length("text").cast("long")
    blocks = lambda n, chars: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(chars / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("component").agg(
        blocks(F.count("*"), F.sum(size_of)).alias("whole"),
        blocks(F.sum(F.when(outside, 1).otherwise(0)), F.sum(F.when(outside, size_of).otherwise(0))).alias("part"),
    )
    # As above, a row for each salt, so that a large group's texts are dealt to many tasks.
    rows = rows.withColumn("salt", salt("rep")).join(counts.select("component", "whole", "part", every_salt), ["component", "salt"])
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["component", "i", "j", "side", "rep", "comp", "text"]
    left = rows.where(outside).withColumn("i", spot("part")).withColumn("j", every("whole")).withColumn("side", F.lit(0))
    right = rows.withColumn("j", spot("whole")).withColumn("i", every("part")).withColumn("side", F.lit(1))
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.groupBy("component", "i", "j").applyInArrow(_compare(size, num, den), "a long, b long")


def near_groups(docs: DataFrame, size: int = 4, num: int = 80, den: int = 100, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    The set of a text is its distinct shingles of ``size`` words (lower-cased
    A-Z, split at ASCII white space); shorter texts have their whole sequence as
    one; texts that are null or without words have an empty set and link with
    nothing. Texts with den * intersection >= num * union are linked, and
    component_id is the smallest id that links reach. Rows with one id count as
    one document; a null id links with nothing, its component is null and it is
    kept. A text of any length is hashed and compared whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    source = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"))
    sketches = written(source.mapInArrow(_sketch(size), _SKETCH))
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    salted = usable.select("doc_id", "digest", salt("doc_id").alias("salt"))
    classes = salted.groupBy("digest").agg(F.min("doc_id").alias("rep"), salts_seen().alias("salts"))
    # Members find their class by digest and salt, for which it has a row each: so a large class is dealt out.
    spread = classes.select("digest", "rep", each_salt("salts").alias("salt"))
    member = salted.join(spread, ["digest", "salt"]).select("doc_id", "rep")
    reps = written(
        usable.join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("own")), "doc_id")
        .where("digest = own")
        .select(F.col("doc_id").alias("rep"), "sig", "bands")
        .dropDuplicates(["rep"])
    )
    # A class's text is that of any row of its id and word sequence.
    texts = source.where("doc_id is not null")
    buckets = reps.select("rep", F.explode("bands").alias("k"), salt("rep").alias("salt"))
    # The leader is the member nearest to the key by exclusive or: as good as random, and another one in each bucket.
    leaders = (
        buckets.groupBy("k")
        .agg(F.min(F.col("rep").bitwiseXOR(F.col("k"))).alias("x"), F.count("*").alias("n"), salts_seen().alias("salts"))
        .where("n > 1")
        .select("k", F.col("x").bitwiseXOR(F.col("k")).alias("leader"), each_salt("salts").alias("salt"))
    )
    found = buckets.join(leaders, ["k", "salt"]).where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    # A leader of many has its signature once for each salt of those it leads; so with its text below.
    found = written(found.withColumn("salt", salt("a")))
    own = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    led = found.groupBy("b").agg(salts_seen().alias("salts")).join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    led = led.select("b", "sb", each_salt("salts").alias("salt"))
    near = written(
        found.join(own, "a").join(led, ["b", "salt"]).select("a", "b", "sa", "sb")
        .mapInArrow(_agreeing(num / den - SLACK), "a long, b long, estimate double")
    )
    # Each text is verified against the leader that looks nearest; this links most copies.
    ends = written(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    # The texts of look-alikes, taken out once; all else needs only these.
    texts = written(texts.join(ends.select(F.col("node").alias("doc_id")), "doc_id"))
    best = near.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    linked = written(_verified(best, texts, size, num, den))
    alike = components(ends, near)
    first = components(ends, linked).select("node", F.col("component").alias("comp"))
    groups = written(alike.join(first, "node"))
    more = _rest(groups, texts, size, num, den)
    links = written(linked.unionByName(more))
    final = components(ends, links).select(F.col("node").alias("rep"), "component")
    # A class stands for all its rows; where an id occurs in several classes, they are joined by it.
    ids = member.join(final, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    ids = ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    return sketches.select("doc_id", "n_shingles").join(ids, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )
