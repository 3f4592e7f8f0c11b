"""Documents of a store with folders: the walk, exports of what has changed, and their table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import output_name
from tessera.operators.filters import DOCUMENT_KINDS, first_n, of_kinds
from tessera.operators.parents import first_of
from tessera.session import kept
from tessera.sources.versions import VersionedTable

#: What a folder is; a fixed value.
FOLDER = "application/vnd.google-apps.folder"
# What each kind is exported as, in the order of DOCUMENT_KINDS.
_EXPORT = dict(zip(DOCUMENT_KINDS, ("text/markdown", "text/csv")))
_ENDING = dict(zip(DOCUMENT_KINDS, (".md", ".csv")))

_ENTRY = "id string, name string, mime string, modified string, revision string, parent string, path string"


class StoreClient(Protocol):
    """A store's interface; it is pickled to the tasks."""

    def entries(self, folder: str, page: str | None) -> tuple[list[dict], str | None]:
        """A page of a folder's entries (id, name, mime, modified and, where the store tells, revision), and the next page's mark."""

    def revision(self, file: str) -> str | None:
        """A file's latest revision, asked where its entry does not tell."""

    def export(self, file: str, mime: str) -> bytes:
        """A file's content in a format."""


def _listed(folders: DataFrame, client: StoreClient) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, path in zip(pdf["id"], pdf["path"]):
                page = None
                while True:
                    found, page = client.entries(folder, page)
                    rows = [
                        (e["id"], e["name"], e.get("mime") or "", e.get("modified"), e.get("revision"), folder, f"{path}/{e['name']}" if path else e["name"])
                        for e in found
                        if e.get("id") and e.get("name")
                    ]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])
                    if not page:
                        break

    # A folder is one task's work, and so is dealt by itself.
    return folders.select("id", "path").repartition("id").mapInPandas(run, _ENTRY)


def walk(spark: SparkSession, client: StoreClient, roots: list[str], most: int = 0, kinds: list[str] | None = None) -> DataFrame:
    """Files of some kinds (documents and sheets) below ``roots``: id, name, mime, modified, revision, parent, path.

    Each round lists the folders that the one before has found, in tasks, and writes
    what it finds. A folder that is in several places, or in itself, is listed once, at the place that
    is found first, of equal rounds the first path; a file in several folders comes once in the same
    way. ``most``, where it is above 0, keeps the first so many files by path.
    """
    frontier = spark.createDataFrame([(r, "") for r in dict.fromkeys(roots)], "id string, path string")
    seen, found, rounds = frontier.select("id"), None, 0
    while True:
        entries = kept(_listed(frontier, client).withColumn("round", F.lit(rounds)))
        found = entries if found is None else found.unionByName(entries)
        inner = entries.where(F.col("mime") == FOLDER).join(seen, "id", "left_anti")
        frontier = kept(first_of(inner, ["id"], ["path", "parent"]).select("id", "path"))
        if frontier.isEmpty():
            break
        seen, rounds = seen.unionByName(frontier.select("id")), rounds + 1
    files = first_of(of_kinds(found, kinds=kinds), ["id"], ["round", "path", "parent"]).drop("round")
    return first_n(files, most, "path", "id")


def with_revisions(files: DataFrame, client: StoreClient) -> DataFrame:
    """Files with their revision: the entry's, or else the store's, asked in the tasks; where both fail, the time of change."""

    def look(ids: pd.Series) -> pd.Series:
        def one(file: str) -> str | None:
            try:
                return client.revision(file)
            except Exception:  # noqa: BLE001  without a revision the time of change stands for it
                return None

        return ids.map(one, na_action="ignore")

    asked = F.pandas_udf(look, "string")(F.when(F.col("revision").isNull(), F.col("id")))
    return files.withColumn("revision", F.coalesce("revision", asked, "modified"))


def exported(files: DataFrame, client: StoreClient) -> DataFrame:
    """Files with their text and error: one that cannot be exported has a null text and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # A file at a time: a text may be long.
            for i in range(len(pdf)):
                row = pdf.iloc[i : i + 1].copy()
                try:
                    text, error = client.export(row["id"].iloc[0], _EXPORT.get(row["mime"].iloc[0], "text/plain")).decode("utf-8", "replace"), None
                except Exception as e:  # noqa: BLE001  one file's failure must not end the others' export
                    text, error = None, f"{type(e).__name__}: {e}"
                yield row.assign(text=text, error=error)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition("id").mapInPandas(run, f"{schema}, text string, error string")


def sync(table: VersionedTable, client: StoreClient, roots: list[str], most: int = 0) -> DataFrame:
    """The next version of the store's documents: name, path, text, sidecar (JSON) and revision of each file.

    Only files whose revision is new are exported; a failed export leaves the file's last text,
    and is tried again by the next run. Files that are no longer listed go, unless the listing is
    empty, which deletes nothing. ``with_sidecars`` reads the sidecars.
    """
    spark = table.spark
    files = kept(with_revisions(walk(spark, client, roots, most), client))
    old = table.current()
    if files.isEmpty():
        return old if old is not None else table.replace(_rows(exported(files, client)))
    known = old.select("id", F.col("revision").alias("_known")) if old is not None else files.select("id", F.lit(None).cast("string").alias("_known")).where("false")
    changed = files.join(known, "id", "left").where("_known IS NULL OR NOT (revision <=> _known)").drop("_known")
    new = kept(exported(changed, client))
    good = _rows(new.where("error IS NULL"))
    if old is None:
        return table.replace(good)
    still = old.join(files.select("id"), "id", "left_semi").join(good.select("id"), "id", "left_anti")
    return table.replace(still.unionByName(good))


def _rows(files: DataFrame) -> DataFrame:
    ending = F.coalesce(*[F.when(F.col("mime") == m, F.lit(e)) for m, e in _ENDING.items()], F.lit(".txt"))
    keys = {"drive_file_id": "id", "drive_file_name": "name", "drive_path": "path", "drive_mime_type": "mime", "drive_modified_time": "modified"}
    sidecar = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(k) for k, c in keys.items()]))
    return files.select("id", output_name(F.col("id"), F.col("path"), ending).alias("name"), "path", "revision", "text", sidecar.alias("sidecar"))
