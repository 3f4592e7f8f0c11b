"""Chat channels as a streaming source that goes on where it stopped."""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fields of a message; ids are numbers that grow with time. The last ones are of its channel.
PLACE = ["channel_name", "category_id", "category_name", "guild_id", "guild_name"]
SCHEMA = (
    "channel_id string, message_id long, ts string, author_id string, author_name string, message_type string, is_bot boolean, text string, "
    + ", ".join(f"{c} string" for c in PLACE)
)


class ChatSource(DataSource):
    """Messages of channels, oldest first; option ``client`` names a function (module:name).

    The function takes (channel, after, limit) and gives messages as dicts with
    ids greater than ``after``. The offset holds the last id of each channel, of
    messages that later filters drop as well. Options:

    - channels: ids, separated by commas; or
    - discover: a function (module:name) without arguments that gives dicts of channel_id and of what is known
      of the channel's place; threads are channels as well. It is asked for each batch, so a channel that appears while
      the stream runs is read from its first message on; one that is gone keeps its place.
    - last: a function of a channel that gives its last message's id. With it the driver learns
      where a batch ends without a message being fetched; without it a batch of messages is looked at for that.
    - batch: messages of one call.
    """

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _ChatReader(self.options)


class _Channel(InputPartition):
    def __init__(self, channel: str, after: int, until: int, place: dict | None = None):
        self.channel, self.after, self.until, self.place = channel, after, until, place or {}


def _named(option: str):
    module, _, name = option.partition(":")
    return getattr(importlib.import_module(module), name)


class _ChatReader(DataSourceStreamReader):
    """A partition for each channel: the driver asks only for the last ids, tasks fetch the messages."""

    def __init__(self, options):
        self.name, self.batch = options["client"], int(options.get("batch", "500"))
        self.channels = [c for c in (options.get("channels") or "").split(",") if c]
        self.discover, self.last = options.get("discover"), options.get("last")
        self.reached: dict[str, int] = {}
        self.places: dict[str, dict] = {}

    def _client(self):
        return _named(self.name)

    def _known(self) -> list[str]:
        """The channels there are now, listed ones first."""
        here = [str(c["channel_id"]) for c in self._discovered()]
        return list(dict.fromkeys([*self.channels, *here]))

    def _discovered(self) -> list[dict]:
        found = _named(self.discover)() if self.discover else []
        for c in found:
            self.places[str(c["channel_id"])] = {k: c.get(k) for k in PLACE}
        return found

    def initialOffset(self) -> dict:
        return {c: 0 for c in self._known()}

    def latestOffset(self) -> dict:
        # The last id of the next messages of each channel; without the option ``last``, a batch at the most beyond what was reached.
        for c in self._known():
            after = self.reached.get(c, 0)
            if self.last:
                self.reached[c] = max(after, int(_named(self.last)(c) or 0))
            else:
                self.reached[c] = max([int(m["message_id"]) for m in self._client()(c, after, self.batch)], default=after)
        return dict(self.reached)

    def partitions(self, start: dict, end: dict):
        # After a restart the reader goes on from where the stream stood.
        for c, last in end.items():
            self.reached[c] = max(self.reached.get(c, 0), last)
        return [_Channel(c, start.get(c, 0), last, self.places.get(c)) for c, last in end.items() if last > start.get(c, 0)]

    def read(self, partition: _Channel):
        client, after = self._client(), partition.after
        while after < partition.until:
            some = [m for m in client(partition.channel, after, self.batch) if int(m["message_id"]) <= partition.until]
            if not some:
                return
            for m in some:
                yield (
                    partition.channel, int(m["message_id"]), m.get("ts"), m.get("author_id"), m.get("author_name"),
                    m.get("message_type", "default"), bool(m.get("is_bot", False)), m.get("text"), *[partition.place.get(k) for k in PLACE],
                )
            after = max(int(m["message_id"]) for m in some)

    def commit(self, end: dict) -> None:
        pass
