"""Queries that SQL cannot express, over their whole tables, against plain versions written from their contracts."""

import datetime
import hashlib
import html
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, lattice
from tessera.operators.split import DOCUMENT, MESSAGE
from tessera.plans.queries import QUERIES
from tessera.sources.web import BLOCKS, SKIPPED, VOID

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def table(name, *columns):
    return pq.read_table(DATA / f"{name}.parquet", columns=list(columns)).to_pylist()


def plain_split(text, size, overlap, separators):
    """Chunks by the recursive contract, on strings: the first separator that occurs, kept before its piece; small pieces merged."""
    separator, rest = "", []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            separator, rest = s, separators[i + 1 :]
            break
    if separator == "":
        pieces = list(text)
    else:
        first, *others = text.split(separator)
        pieces = [p for p in [first, *[separator + o for o in others]] if p]
    out, good = [], []

    def merged():
        docs, here, total = [], [], 0
        for p in good:
            if total + len(p) > size and here:
                docs.append("".join(here).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(here[0])
                    here = here[1:]
            here.append(p)
            total += len(p)
        docs.append("".join(here).strip())
        good.clear()
        return [d for d in docs if d]

    for p in pieces:
        if len(p) < size:
            good.append(p)
            continue
        out += merged()
        if rest:
            out += plain_split(p, size, overlap, rest)
        elif p.strip():
            out.append(p.strip())
    return out + merged()


def firsts():
    return {r["doc_id"]: plain_split(r["text"] or "", 1024, 128, DOCUMENT) for r in table("documents", "doc_id", "text")}


def seconds():
    """By document: (chunk_id, parent, text), numbered through all parents."""
    out = {}
    for d, parents in firsts().items():
        rows = [(p, t) for p, text in enumerate(parents) for t in plain_split(text, 128, 32, DOCUMENT)]
        out[d] = [(i, p, t) for i, (p, t) in enumerate(rows)]
    return out


def test_first_level_chunks(spark):
    got = sorted((r.doc_id, r.chunk_id, r.text) for r in QUERIES["chunk_first"](spark, str(DATA)).collect())
    assert got == sorted((d, i, t) for d, own in firsts().items() for i, t in enumerate(own)) and len(got) > 200


def test_second_level_chunks(spark):
    got = sorted((r.doc_id, r.chunk_id, r.parent_chunk_id, r.text) for r in QUERIES["chunk_second"](spark, str(DATA)).collect())
    assert got == sorted((d, *x) for d, own in seconds().items() for x in own) and len(got) > 1000


def test_parents_of_hits(spark):
    parents, truth = firsts(), []
    for d, own in seconds().items():
        hits = own[:3]
        texts = [t for _, _, t in hits] + [parents[d][p] for p in reversed(list(dict.fromkeys(p for _, p, _ in hits)))]
        truth += [(d, i + 1, hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(texts)]
    got = [(r.query_id, r["rank"], r.text_md5) for r in QUERIES["parents_of_hits"](spark, str(DATA)).collect()]
    assert sorted(got) == sorted(truth) and len(got) > 400


def test_chat_chunks(spark):
    channels, truth = {}, []
    for r in sorted(table("conversations", "conv_id", "turn", "role", "text"), key=lambda r: (r["conv_id"], r["turn"])):
        channels.setdefault(r["conv_id"], []).append(r)
    for channel, rows in channels.items():
        lines, date = [], None
        for r in rows:
            own = [x.strip() for x in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", r["text"] or "")]
            own = [x for x in own if x]
            new = None
            if r["turn"] % 3 < 2:
                at = datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=channel * 24 + r["turn"] * 7 + 9)
                new = at.strftime("%Y/%m/%d")
            if own and new and date and new != date:
                lines.append((new, None, None))
            date = new or date
            lines += [(f"{r['role'] or 'unknown'}: {x}", str(r["turn"]), date) for x in own]
        text = "\n".join(x for x, _, _ in lines)
        starts = np.cumsum([0, *[len(x) + 1 for x, _, _ in lines]])
        after = 0
        for i, chunk in enumerate(plain_split(text, 300, 50, MESSAGE)):
            # A chunk begins after the beginning of the one before it.
            begin = text.index(chunk, after)
            after = begin + 1
            touched = [k for k in range(len(lines)) if starts[k] < begin + len(chunk) and starts[k + 1] > begin and lines[k][1] is not None]
            first = min(touched, default=None)
            truth.append((channel, i, chunk, *((lines[first][1], lines[first][2]) if first is not None else (None, None))))
    got = [(r.channel_id, r.chunk_id, r.text, r.first_message_id, r.first_message_date) for r in QUERIES["chat_chunks"](spark, str(DATA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, truth)) and len(got) > 50


def plain_text_of(page):
    """The text of a page by its tags alone, as a stack of what is open."""
    out, skipping = [], []
    for m in re.finditer(r"(?s)<!--.*?-->|<![^>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", page):
        closing, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            if not m[0].startswith("<!") and not skipping:
                out.append(html.unescape(m[0]))
        elif closing:
            if skipping and tag in skipping:
                while skipping.pop() != tag:
                    pass
            elif not skipping and tag in BLOCKS:
                out.append("\n")
        else:
            if not skipping and tag in BLOCKS:
                out.append("\n")
            marks = " ".join(a or b for a, b in re.findall(r"(?i)\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attributes)).lower()
            if tag not in VOID and not attributes.rstrip().endswith("/") and (skipping or tag in SKIPPED or "comment" in marks):
                skipping.append(tag)
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def test_html_text(spark):
    truth = {r["page_id"]: plain_text_of(r["html"] or "") for r in table("pages", "page_id", "html")}
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, str(DATA)).collect()}
    assert got == truth and any(truth.values())


def test_raptor_level(spark):
    """One level of clusters: Lloyd's steps for each number of clusters, the knee's, then each cluster cut to the limit."""
    count = lambda t: max(1, len(re.findall(r"[^\W_]+", t))) if t else 0
    texts = {r["doc_id"]: r["text"] for r in table("documents", "doc_id", "text")}
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table("embeddings", "vec_id", "embedding") if r["vec_id"] in texts}
    order = [r[0] for r in spark.createDataFrame([(i,) for i in vectors], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    ids = sorted(vectors)
    x, sample = np.stack([vectors[i] for i in ids]), np.stack([vectors[i] for i in order])
    labels, spreads = {}, []
    for k in range(1, 9):
        centres, before = clusters._spread_out(sample, k, 42), None
        for _ in range(51):
            held, own = centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            sums = [np.rint(x[own == c] * 2**20).sum(axis=0) for c in range(k)]
            key = [s.tolist() for s in sums]
            if key == before:
                break
            before = key
            centres = np.stack([s / 2**20 / (own == c).sum() if (own == c).any() else held[c] for c, s in enumerate(sums)])
        labels[k] = own
        spreads.append(sum((((x[i] - held[own[i]]) ** 2).sum()) ** 2 for i in range(len(x))))
    best = labels[clusters.knee(spreads)]
    tokens = np.array([count(texts[i]) for i in ids])
    truth = set()
    for c in set(best.tolist()):
        rows = np.flatnonzero(best == c)
        truth |= {frozenset(ids[rows[j]] for j in own) for own in clusters.limited(x[rows], tokens[rows], 1024)}
    groups = {}
    for r in QUERIES["raptor_level"](spark, str(DATA)).collect():
        groups.setdefault((r.group, r.cluster_id), set()).add(r.id)
    assert set(map(frozenset, groups.values())) == truth and len(truth) > 20


def test_analysed_terms(spark):
    docs = table("documents", "doc_id", "text")
    frame = spark.createDataFrame([(r["text"],) for r in docs], "text string")
    own = lattice.Analyser(lattice.frequency_dictionary(frame), stop=frozenset({"stop"}))
    df = {}
    for r in docs:
        for t in set(own.tokens((r["text"] or "").lower())):
            df[t] = df.get(t, 0) + 1
    assert {r.term: r.df for r in QUERIES["analysed_terms"](spark, str(DATA)).collect()} == df and len(df) > 500
