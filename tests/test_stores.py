"""A store of nested folders, and chat channels that appear while a stream runs."""

import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators.filters import DOCUMENT_KINDS
from tessera.sources.chat import ChatSource
from tessera.sources.chunks import with_sidecars
from tessera.sources.store import FOLDER, sync, walk, with_revisions
from tessera.sources.versions import VersionedTable

DOC, SHEET = DOCUMENT_KINDS


def make_store(log, folders, files, failing=()):
    """A client over folders {id: [(id, name)]} of folders and files {id: (folder, name, mime, revision)}, in pages of three."""

    class Store:
        def entries(self, folder, page):
            with open(log, "a") as f:
                f.write(f"{folder} {page or ''}\n")
            own = [{"id": i, "name": n, "mime": FOLDER} for i, n in folders.get(folder, [])]
            own += [{"id": i, "name": n, "mime": m, "modified": "2024", "revision": r} for i, (places, n, m, r) in files.items() if folder in places]
            at = int(page or 0)
            return own[at : at + 3], str(at + 3) if at + 3 < len(own) else None

        def revision(self, file):
            if file == "lost":
                raise OSError
            return "asked"

        def export(self, file, mime):
            with open(log + ".exports", "a") as f:
                f.write(f"{file} {mime}\n")
            if file in failing:
                raise OSError("no")
            return f"text of {file} é".encode()

    return Store()


def lines(path):
    return sorted(Path(path).read_text().splitlines()) if Path(path).exists() else []


def test_a_thousand_folders_with_cycles_are_listed_once(spark, tmp_path):
    log = str(tmp_path / "log")
    folders = {f"f{i}": [(f"f{j}", f"n{j}") for j in (2 * i + 1, 2 * i + 2) if j < 1000] for i in range(1000)}
    folders["f999"] += [("f0", "up"), ("f999", "self"), ("f500", "side")]
    files = {f"d{i}": ([f"f{i}"], f"doc{i}", DOC if i % 2 else SHEET, "r") for i in range(1000)}
    files |= {"pdf": (["f1"], "x", "application/pdf", "r"), "twice": (["f3", "f999"], "t", DOC, "r")}
    store = make_store(log, folders, files)
    found = walk(spark, store, ["f0", "f0"]).collect()
    assert sorted(r.id for r in found) == sorted(i for i in files if i != "pdf")
    own = {r.id: r for r in found}
    assert (own["d0"].path, own["d4"].path, own["twice"].path) == ("doc0", "n1/n4/doc4", "n1/n3/t") and own["twice"].parent == "f3"
    first = [x.split()[0] for x in lines(log) if x.endswith(" ")]
    assert len(first) == len(set(first)) == 1000
    few = walk(spark, store, ["f0"], most=5).collect()
    assert [r.path for r in few] == sorted(r.path for r in found)[:5]


def test_exports_follow_revisions(spark, tmp_path):
    log = str(tmp_path / "log")
    files = {"a": (["r"], "A b", DOC, "1"), "b": (["r"], "B", SHEET, "1"), "c": (["r"], "C", DOC, None), "gone": (["r"], "G", DOC, "1")}
    table = VersionedTable(spark, str(tmp_path / "t"))
    first = {r.id: r for r in sync(table, make_store(log, {}, files), ["r"]).collect()}
    assert (first["a"].name, first["a"].text, first["b"].name) == ("a__A_b.md", "text of a é", "b__B.csv") or first["a"].name.startswith("a__")
    assert json.loads(first["b"].sidecar) == {
        "drive_file_id": "b", "drive_file_name": "B", "drive_path": "B", "drive_mime_type": SHEET, "drive_modified_time": "2024",
    } and first["c"].revision == "asked"
    assert lines(log + ".exports") == [f"a {'text/markdown'}", "b text/csv", "c text/markdown", "gone text/markdown"]
    # Only what is new or changed is exported; a failure leaves the last text; what is gone goes.
    del files["gone"]
    files |= {"a": (["r"], "A b", DOC, "2"), "b": (["r"], "B", SHEET, "2"), "new": (["r"], "N", DOC, "1")}
    second = {r.id: (r.revision, r.text) for r in sync(table, make_store(log, {}, files, failing=("b",)), ["r"]).collect()}
    assert second == {"a": ("2", "text of a é"), "b": ("1", "text of b é"), "c": ("asked", "text of c é"), "new": ("1", "text of new é")}
    assert len(lines(log + ".exports")) == 7
    # An empty listing deletes nothing.
    assert sync(table, make_store(log, {}, {}), ["r"]).count() == 4
    docs = table.current()
    known = with_sidecars(docs.select(F.col("name").alias("path"), "name", "text"), docs.select(F.concat("name", F.lit(".meta.json")).alias("path"), F.col("sidecar").alias("json")))
    assert {(r.drive_file_id, r.drive_path) for r in known.collect()} == {("a", "A b"), ("b", "B"), ("c", "C"), ("new", "N")}


def test_revisions_fall_back_to_the_time_of_change(spark):
    files = spark.createDataFrame([("lost", None, "2024"), ("x", None, "2024"), ("y", "7", "2024")], "id string, revision string, modified string")
    assert {r.id: r.revision for r in with_revisions(files, make_store("/dev/null", {}, {})).collect()} == {"lost": "2024", "x": "asked", "y": "7"}


# Channels of the chat: this module is imported by its name, on the driver and in tasks.
CHANNELS = {"a": 4, "b": 3}
FETCHED: list[str] = []


def discover():
    return [{"channel_id": c, "channel_name": f"n{c}", "guild_id": "g", "guild_name": "G", "category_id": None} for c in CHANNELS]


def last_id(channel):
    return CHANNELS[channel]


def messages(channel, after, limit):
    FETCHED.append(channel)
    return [{"message_id": i, "ts": "2024", "author_id": "1", "author_name": "x", "text": f"{channel}{i}"} for i in range(after + 1, CHANNELS[channel] + 1)][:limit]


@pytest.fixture
def reader(monkeypatch):
    monkeypatch.setitem(sys.modules, "chat_stand_in", sys.modules[__name__])
    monkeypatch.setitem(CHANNELS, "a", 4)
    FETCHED.clear()
    yield lambda: ChatSource({"client": "chat_stand_in:messages", "discover": "chat_stand_in:discover", "last": "chat_stand_in:last_id", "batch": "2"}).streamReader(None)
    CHANNELS.pop("thread", None)


def test_channels_that_appear_are_read_from_their_first_message(reader):
    r = reader()
    start, end = r.initialOffset(), r.latestOffset()
    assert start == {"a": 0, "b": 0} and end == {"a": 4, "b": 3} and not FETCHED
    rows = [x for p in r.partitions(start, end) for x in r.read(p)]
    assert sorted(x[1] for x in rows if x[0] == "a") == [1, 2, 3, 4] and rows[0][8:] == ("na", None, None, "g", "G")
    # A thread appears and a channel grows; another is read no more and keeps its place.
    CHANNELS.update(thread=2, a=6)
    after = r.latestOffset()
    assert after == {"a": 6, "b": 3, "thread": 2}
    assert sorted((x[0], x[1]) for p in r.partitions(end, after) for x in r.read(p)) == [("a", 5), ("a", 6), ("thread", 1), ("thread", 2)]
    del CHANNELS["thread"]
    assert r.latestOffset() == after and r.partitions(after, after) == []
    # A reader that starts anew reads what lies between the offsets that the checkpoint has.
    CHANNELS["thread"] = 2
    again = reader()
    assert len([x for p in again.partitions(end, after) for x in again.read(p)]) == 4 and again.latestOffset() == after
