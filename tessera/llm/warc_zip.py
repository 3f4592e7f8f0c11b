"""WARC records in ZIP packages, read by ranges.

A package has stored members only: WARC files, in which each record is a gzip
member of its own, and a JSON-lines index of their places. The reader finds the
end record (and the ZIP64 one), parses the central directory, takes the index,
and reads and inflates each record by its own range; no package member is
extracted and no package read whole.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import each_salt, salt, salts_seen, shared_dir, written
from tessera.llm.token_codec import open_folder

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 1000
#: A WARC member is closed at so many bytes; a package at so many members.
MEMBER_BYTES, PACKAGE_MEMBERS = 8 << 20, 16
#: Sizes and places from here on are in ZIP64 fields; lower in tests.
ZIP64_FROM = 0xFFFFFFFF
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 1 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class PackageWriter:
    """Writes stored members one after the other, then the central directory."""

    def __init__(self, out, zip64_from: int = ZIP64_FROM):
        self.out, self.at, self.members, self.limit = out, 0, [], zip64_from

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, name: str, body: bytes) -> int:
        """Adds a member and returns where its bytes begin in the package."""
        encoded, crc, size, at = name.encode(), zlib.crc32(body), len(body), self.at
        extra = struct.pack("<HHQQ", 1, 16, size, size) if size >= self.limit else b""
        shown = 0xFFFFFFFF if extra else size
        # Bit 11: the name is UTF-8. The date is the format's first day, so that packages don't depend on the time.
        self._put(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45 if extra else 20, 0x800, 0, 0, 33, crc, shown, shown, len(encoded), len(extra)))
        self._put(encoded + extra)
        begin = self.at
        self._put(body)
        self.members.append((encoded, crc, size, at))
        return begin

    def close(self) -> None:
        begin = self.at
        for name, crc, size, at in self.members:
            fields = [size, size] if size >= self.limit else []
            fields += [at] if at >= self.limit else []
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            shown = 0xFFFFFFFF if size >= self.limit else size
            self._put(
                struct.pack(
                    "<4s6H3L5H2L", b"PK\x01\x02", 45, 45 if extra else 20, 0x800, 0, 0, 33, crc, shown, shown,
                    len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if at >= self.limit else at,
                )
                + name + extra
            )
        size, n, end = self.at - begin, len(self.members), self.at
        if n >= 0xFFFF or size >= self.limit or begin >= self.limit:
            self._put(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, size, begin, 0))


class PackageReader:
    """Members of a package and ranges of their bytes; ``f`` seeks and reads."""

    def __init__(self, f, length: int):
        self.f, self.members = f, {}
        tail_at = max(0, length - 22 - 0xFFFF)
        tail = self._range(tail_at, length - tail_at)
        spot = tail.rfind(b"PK\x05\x06")
        # A comment may hold the signature: the record's comment must end with the file.
        while spot >= 0 and (spot + 22 > len(tail) or spot + 22 + struct.unpack_from("<H", tail, spot + 20)[0] != len(tail)):
            spot = tail.rfind(b"PK\x05\x06", 0, spot)
        if spot < 0:
            raise ValueError("no end of a central directory")
        n, size, begin = struct.unpack_from("<H2L", tail, spot + 10)
        locator = self._range(tail_at + spot - 20, 20) if tail_at + spot >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            record = self._range(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            n, size, begin = struct.unpack_from("<3Q", record, 32)
        directory, at = self._range(begin, size), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            crc, stored, plain, names, extras, comments = struct.unpack_from("<3L3H", directory, at + 16)
            place = struct.unpack_from("<L", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode()
            extra = directory[at + 46 + names : at + 46 + names + extras]
            plain, stored, place = self._wide(extra, plain, stored, place)
            if method != 0 or stored != plain:
                raise ValueError(f"{name} is not stored")
            self.members[name] = (place, plain, crc)
            at += 46 + names + extras + comments

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The values, those that are all ones from the ZIP64 field, in its order."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + size]
            at += 4 + size
        out, at = [], 0
        for v in values:
            if v == 0xFFFFFFFF and at + 8 <= len(wide):
                v = struct.unpack_from("<Q", wide, at)[0]
                at += 8
            out.append(v)
        return out

    def _range(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(size)
        if len(raw) != size:
            raise ValueError("the package ends early")
        return raw

    def begin(self, name: str) -> int:
        """Where a member's bytes begin: after its local header, whose extra field may differ from the directory's."""
        place = self.members[name][0]
        head = self._range(place, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<2H", head, 26)
        return place + 30 + names + extras

    def read(self, name: str) -> bytes:
        """A whole member, its checksum compared."""
        raw = self._range(self.begin(name), self.members[name][1])
        if zlib.crc32(raw) != self.members[name][2]:
            raise ValueError(f"the checksum of {name} differs")
        return raw

    def read_ranges(self, name: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
        """Bytes of a member at (place, size), which ascend; near ones are read together."""
        begin, i = self.begin(name), 0
        while i < len(ranges):
            j, at = i + 1, ranges[i][0]
            while j < len(ranges) and ranges[j][0] + ranges[j][1] - at <= READ_BYTES:
                j += 1
            raw = self._range(begin + at, ranges[j - 1][0] + ranges[j - 1][1] - at)
            for a, n in ranges[i:j]:
                yield raw[a - at : a - at + n]
            i = j


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def warc_record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record of an identical payload, which it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        # A line break in a URL would end the header.
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, by lower-case name, and its payload (after the HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


class _Packages:
    """Packages of a task: members are written as they fill, so that one member and the package's index are in memory."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.folder, self.part, self.attempt = folder, part, attempt
        self.names: list[str] = []
        self.buffer: list[bytes] = []
        self.index: list[dict] = []
        self.filled = self.members = 0
        self.package = self.out = None

    def _paths(self) -> tuple[str, str]:
        name = f"part-{self.part:06d}-{len(self.names):04d}.wacz"
        return name, f".{name}.{self.attempt}"

    def add(self, page: int | None, record: bytes) -> None:
        member = f"archive/data-{self.members:05d}.warc.gz"
        self.index.append({"page": page, "member": member, "offset": self.filled, "length": len(record)})
        self.buffer.append(record)
        self.filled += len(record)
        if self.filled >= MEMBER_BYTES:
            self._end_member()
            if self.members >= PACKAGE_MEMBERS:
                self.end()

    def _end_member(self) -> None:
        if not self.buffer:
            return
        if self.package is None:
            system, path = open_folder(self.folder)
            system.create_dir(path, recursive=True)
            self.out = system.open_output_stream(f"{path}/{self._paths()[1]}")
            self.package = PackageWriter(self.out)
        self.package.add(f"archive/data-{self.members:05d}.warc.gz", b"".join(self.buffer))
        self.members, self.filled = self.members + 1, 0
        self.buffer.clear()

    def end(self) -> None:
        """Closes the package under way; it gets its name when it is whole, so a task run twice leaves one."""
        self._end_member()
        if self.package is None:
            return
        self.package.add("indexes/index.jsonl", "".join(json.dumps(x) + "\n" for x in self.index).encode())
        self.package.close()
        self.out.close()
        name, own = self._paths()
        system, path = open_folder(self.folder)
        system.move(f"{path}/{own}", f"{path}/{name}")
        self.names.append(name)
        self.index.clear()
        self.members, self.package, self.out = 0, None, None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packages = _Packages(folder, context.partitionId(), context.taskAttemptId())
        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page, url, html, sha1, refers = (c[i].as_py() for c in columns)
                # No time stamp, so that a task run twice writes the same bytes.
                packages.add(page, gzip.compress(warc_record(page, url, (html or "").encode(), sha1, refers), 5, mtime=0))
        packages.end()
        yield pa.RecordBatch.from_arrays([pa.array(packages.names, pa.string())], ["name"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = open_folder(folder)
                length = system.get_file_info(f"{path}/{name}").size
                with system.open_input_file(f"{path}/{name}") as f:
                    package = PackageReader(f, length)
                    by_member: dict[str, list[tuple[int, int]]] = {}
                    for line in package.read("indexes/index.jsonl").splitlines():
                        x = json.loads(line)
                        by_member.setdefault(x["member"], []).append((x["offset"], x["length"]))
                    for member, ranges in by_member.items():
                        rows: tuple[list, ...] = ([], [], [], [], [], [])
                        for raw in package.read_ranges(member, ranges):
                            headers, payload = parse_record(gzip.decompress(raw))
                            kind = headers["warc-type"]
                            page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                            sha1 = hashlib.sha1(payload).hexdigest() if kind == "response" else None
                            if sha1 is not None and headers["warc-payload-digest"] != f"sha1:{sha1}":
                                raise ValueError(f"the payload digest of page {page} differs")
                            values = (
                                None if page is None else int(page), len(payload) if sha1 else None, sha1, kind,
                                None if refers is None else int(refers), headers["warc-payload-digest"].removeprefix("sha1:"),
                            )
                            for column, v in zip(rows, values):
                                column.append(v)
                        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r, t) for r, t in zip(rows, types)],
                            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "named_digest"],
                        )

    return run


def write_packages(pages: DataFrame, least: int = LEAST_REVISIT) -> tuple[str, DataFrame]:
    """Packages of a WARC record for each row of ``pages``; their folder, and a row for each: name.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest
    page_id is a response and the others are revisits that refer to it.
    """
    folder = shared_dir(pages.sparkSession)
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("sha1"), F.sha2(html, 256).alias("sha2"), F.octet_length(html).alias("n"),
    )
    rows = rows.withColumn("salt", salt("page_id"))
    narrow = rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).select("sha1", "sha2", "n", "page_id", "salt")
    # A payload with copies has a row for each salt of its pages, so that many copies are dealt to many tasks.
    firsts = narrow.groupBy("sha1", "sha2", "n").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least"), salts_seen().alias("salts"))
    firsts = firsts.where("first <> least").select("sha1", "sha2", "n", "first", each_salt("salts").alias("salt"))
    marked = rows.join(firsts, ["sha1", "sha2", "n", "salt"], "left")
    marked = marked.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    files = marked.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(_write(folder), "name string")
    return folder, written(files)


def package_report(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as packages and reads them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row for each row of ``pages``. Bytes and the SHA-1 (lower-case hex) are
    of the full payload: a revisit's are those of the response it refers to. A
    null html is an empty payload; a null page_id is written as a response;
    rows with one page_id and payload are all responses if that id is the
    largest. A page of any length is one record, read whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    folder, files = write_packages(pages)
    dealt = files.repartition(max(1, files.count()))
    records = written(
        dealt.mapInArrow(
            _read(folder),
            "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, named_digest string",
        )
    )
    records = records.withColumn("salt", salt("page_id"))
    asked = records.where("refers_to is not null").groupBy("refers_to", "named_digest").agg(salts_seen().alias("salts"))
    responses = (
        records.where("record_type = 'response' and page_id is not null")
        .select(F.col("page_id").alias("refers_to"), F.col("named_digest"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
        .join(asked, ["refers_to", "named_digest"])
        .distinct()
        .select("refers_to", "named_digest", "n", "d", each_salt("salts").alias("salt"))
    )
    # The digest keeps rows apart that share an id.
    return records.join(responses, ["refers_to", "named_digest", "salt"], "left").select(
        "page_id",
        F.coalesce("payload_bytes", "n").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
