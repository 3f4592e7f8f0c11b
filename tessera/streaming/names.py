"""The latest name of each author, kept over the batches of a stream of messages, and mentions resolved by it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import mentions, name_mentions
from tessera.session import kept
from tessera.sources.versions import VersionedTable


def fetched(ids: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """(author_id, name) of ids(author_id) by a look-up in the tasks, each id once; what fails or has no name is left out."""

    def one(author: str) -> str | None:
        try:
            return fetch(author)
        except Exception:  # noqa: BLE001  a look-up that fails is tried again with a later batch
            return None

    def run(batches):
        for pdf in batches:
            found = pdf["author_id"].map(one)
            yield pd.DataFrame({"author_id": pdf["author_id"], "name": found})[found.fillna("").astype(str).str.strip() != ""]

    return ids.select("author_id").distinct().mapInPandas(run, "author_id string, name string")


def named_messages(path: str, out: Callable[[DataFrame, int], None], fetch: Callable[[str], str | None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for messages(message_id, author_id, author_name, ts, text): ``out`` gets them with their mentions named.

    Names are a versioned table at ``path``, a version for each batch, so that a batch that comes
    again finds the names it left. Of an author's names that with the latest time holds, the earliest
    seen of equal times (the smaller message_id within a batch). A mentioned id without a name is looked up by ``fetch``,
    once a batch; a fetched name gives way to any that a message shows. A mention that stays unknown stays as it is.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        names = VersionedTable(batch.sparkSession, path)
        messages = kept(batch)
        shown = messages.where("author_id IS NOT NULL AND trim(author_name) <> ''")
        first = F.max_by(F.struct(F.col("author_name").alias("name"), "ts"), F.struct(F.col("ts"), -F.col("message_id"))).alias("x")
        new = shown.groupBy("author_id").agg(first).select("author_id", "x.name", "x.ts")
        asked = messages.select("message_id", F.explode(mentions(F.col("text"))).alias("author_id"))
        if names.version() < epoch:
            if fetch is not None:
                old = names.current()
                known = new.select("author_id") if old is None else new.select("author_id").unionByName(old.select("author_id"))
                missing = asked.select("author_id").join(known, "author_id", "left_anti")
                # A name without a time is older than any.
                new = new.unionByName(fetched(missing, fetch).withColumn("ts", F.lit(None).cast(new.schema["ts"].dataType)))
            names.upsert(new, ["author_id"], F.col("ts"), epoch)
        found = asked.join(names.current(), "author_id")
        own = found.groupBy("message_id").agg(F.map_from_entries(F.collect_set(F.struct("author_id", "name"))).alias("_names"))
        full = messages.join(own, "message_id", "left")
        none = F.create_map().cast("map<string,string>")
        out(full.withColumn("text", name_mentions(F.col("text"), F.coalesce("_names", none))).drop("_names"), epoch)

    return run
