"""WARC archives as a Spark data source.

Every record is a gzip member of its own whose header tells the member's length
(extra field ``RW``), so a reader can step over a record it doesn't want.  A
writer task rolls its files at a size; committing writes a manifest with the
files and with offsets to start from, which become the read partitions.  Files
of other writers are read as well, one partition each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from rankweave.llm.rows import named
from rankweave.llm.scratch import Scratch

MANIFEST = "_manifest.json"
FILE_BYTES = 128 << 20
SPLIT_BYTES = 16 << 20
#: A payload that more than this share of the pages has is looked up by a broadcast; there are at most as many as shares.
HOT_SHARES = 1000
_HEAD = "<4s4x2sH2sHI"  # magic and flags, (mtime), xfl and os, extra length, subfield, its length, member length

SCHEMA = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"
#: Columns that the record's own headers give; filters on them are decided before a payload is decoded, but for digest and length where it is.
HEADER_COLUMNS = ("record_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes")


#: Schemes that Spark uses for stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: Arrow's own, or Hadoop's client for any other scheme that Spark can use."""
    parts = re.match(r"([a-z][a-z0-9+.-]*):/(?:/([^/]*))?", path)
    if not parts:
        return pafs.LocalFileSystem(), path
    scheme = SCHEMES.get(parts[1], parts[1])
    try:
        return pafs.FileSystem.from_uri(scheme + path[len(parts[1]) :])
    except pa.ArrowInvalid:  # a scheme that Arrow doesn't know
        return pafs.HadoopFileSystem(f"{scheme}://{parts[2] or ''}"), path[parts.end() :] or "/"


def sha1_label(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as one gzip member that tells its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = struct.calcsize(_HEAD) + len(body) + 8
    head = struct.pack(_HEAD, b"\x1f\x8b\x08\x04", b"\x04\xff", 8, b"RW", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def one_line(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """The bytes of one record; ``payload`` is left out of revisits."""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + (row["payload"] or b"")
    head = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Refers-To": f"<{row['refers_to']}>" if row["refers_to"] else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = [b"WARC/1.1", *(f"{k}: {one_line(v)}".encode() for k, v in head.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list  # [name, bytes, offsets to start from]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, record_type, url, refers_to, payload_sha1 (hex), payload_bytes, payload."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files: list = []
        out, at, size, last = None, 0, 0, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                row["payload_digest"] = sha1_label(bytes.fromhex(row["payload_sha1"]))
                data = member(record(row))
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                        files[-1][1] = size
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]])  # a new name for each attempt of a task
                    out, size, last = fs.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0, 0
                if size - last >= SPLIT_BYTES:
                    files[-1][2].append(size)
                    last = size
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages) -> None:
        """Only files of committed tasks enter the manifest; what lost tasks wrote is never read."""
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name, *_ in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


class Piece(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, IN, prefix and not-null tests on header columns."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.wanted.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = open_fs(self.path)
        there = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))}
        if MANIFEST in there:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                listed = json.loads(f.read())
        else:
            listed = [[n, s, [0]] for n, s in sorted(there.items()) if re.search(r"\.warc(\.gz)?$", n)]
        return [Piece(n, a, b) for n, size, starts in listed for a, b in zip(starts, [*starts[1:], size], strict=True)] or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = open_fs(self.path)
        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            walk = gzip_records if partition.name.endswith(".gz") else plain_records
            for head, rest in walk(f, partition.start, partition.end):
                row = self.row(head, rest)
                if row is not None:
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size >= 8 << 20:
                        yield as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows)

    def row(self, head: bytes, rest) -> tuple | None:
        """Columns of a record from its headers; ``rest()`` gives its block, and is only called for rows that are wanted."""
        h = headers(head)
        digest = h.get("warc-payload-digest", "")
        row = {
            "record_id": strip(h.get("warc-record-id")),
            "record_type": h.get("warc-type"),
            "url": h.get("warc-target-uri"),
            "refers_to": strip(h.get("warc-refers-to")),
            "payload_digest": digest.removeprefix("sha1:") or None,
        }
        # what is reported of a decoded payload is its own digest and length, so filters on them wait for it
        decoded = self.payload and row["record_type"] != "revisit"
        later = ("payload_bytes", "payload_digest") if decoded else ("payload_bytes",)
        for column, kind, value in self.wanted:
            if column not in later and not holds(kind, row[column], value):
                return None
        block = rest(self.payload)
        http, found, payload = block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"x", block)
        told = headers(http).get("content-length")
        row["payload_bytes"] = int(told) if told is not None and told.isdigit() else (len(payload) if self.payload else None)
        ok = None
        if decoded:
            own = sha1_label(hashlib.sha1(payload).digest())
            ok = own == row["payload_digest"] or not digest.startswith("sha1:")
            row["payload_digest"], row["payload_bytes"] = own, len(payload)
        else:
            payload = None
        for column, kind, value in self.wanted:
            if column in later and not holds(kind, row[column], value):
                return None
        return (*row.values(), ok, payload)


def strip(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">") if value else None


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines belong to the line before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def holds(kind: str, have, value) -> bool:
    if have is None:
        return False
    return {"EqualTo": lambda: have == value, "In": lambda: have in value, "StringStartsWith": lambda: have.startswith(value), "IsNotNull": lambda: True}[kind]()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload"]
    types = [*[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def plain_records(f, start: int, end: int):
    """Headers of each record and a function for its block, which is stepped over unless asked for."""
    at = start
    while at < end:
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = f.read(4096)
            if not more:
                return
            head += more
        head, _, _ = head.partition(b"\r\n\r\n")
        skipped = len(head) - len(head.lstrip(b"\r\n"))
        size = int(headers(head[skipped:]).get("content-length", 0))
        begin = at + len(head) + 4

        def rest(whole: bool, begin=begin, size=size) -> bytes:
            f.seek(begin)
            return f.read(size if whole else min(size, 4096))

        yield head[skipped:], rest
        at = begin + size + 4


def gzip_records(f, start: int, end: int):
    """The same for gzip files: members that tell their length hold one record and are stepped over without inflating; what follows others is inflated in one go, however many records a member holds."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(4096)
        if len(data) < 18:
            return
        told = struct.unpack_from(_HEAD, data) if len(data) >= struct.calcsize(_HEAD) else None
        length = told[5] if told and told[3] == b"RW" and data[3] & 4 else None
        if length is None:
            yield from streamed_records(f, at)
            return
        unpacker, out = zlib.decompressobj(31), b""
        feed = data
        while b"\r\n\r\n" not in out and not unpacker.eof and feed:
            out += unpacker.decompress(feed, 4096)
            feed = unpacker.unconsumed_tail or f.read(1 << 16)
        head, _, begun = out.partition(b"\r\n\r\n")
        size = int(headers(head).get("content-length", 0))
        state = {"feed": feed, "out": [begun], "n": len(begun)}

        def rest(whole: bool, unpacker=unpacker, state=state, size=size) -> bytes:
            need = size if whole else min(size, 4096)
            while state["n"] < need and not unpacker.eof and state["feed"]:
                got = unpacker.decompress(state["feed"], max(4096, need - state["n"]))
                state["out"].append(got)
                state["n"] += len(got)
                state["feed"] = unpacker.unconsumed_tail or f.read(1 << 16)
            return b"".join(state["out"])[:need]

        yield head, rest
        at += length


def streamed_records(f, at: int):
    """Records of a gzip stream from a member's start to the end of the file; records and members need not begin together."""
    f.seek(at)
    state = {"unpacker": zlib.decompressobj(31), "feed": b"", "out": bytearray()}

    def more() -> bool:
        """Inflate some more; false at the end."""
        while True:
            if state["unpacker"].eof:
                state["feed"] = state["unpacker"].unused_data.lstrip(b"\0")
                state["unpacker"] = zlib.decompressobj(31)
            state["feed"] = state["feed"] or f.read(1 << 16)
            if not state["feed"]:
                return False
            got = state["unpacker"].decompress(state["feed"], 1 << 18)
            state["feed"] = state["unpacker"].unconsumed_tail
            if got:
                state["out"] += got
                return True

    def filled(n: int) -> bytearray:
        while len(state["out"]) < n and more():
            pass
        return state["out"]

    while True:
        while True:
            while filled(1)[:1] in (b"\r", b"\n"):
                del state["out"][:1]
            cut = state["out"].find(b"\r\n\r\n")
            if cut >= 0:
                break
            if not more():
                return
        head = bytes(state["out"][:cut])
        del state["out"][: cut + 4]
        size = int(headers(head).get("content-length", 0))
        yield head, lambda whole, size=size: bytes(filled(size if whole else min(size, 4096))[: size if whole else min(size, 4096)])
        left = size
        while left and (state["out"] or more()):
            n = min(left, len(state["out"]))
            del state["out"][:n]
            left -= n


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` with options ``path`` and ``payload`` (decode payloads, default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record for every row: a response, or a revisit of the response with the same payload.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is the response; rows that share this id and payload are
    all responses.  A null html is an empty payload; a null id never owns a
    payload that a row with an id has.  Only ids and digests are compared,
    equal digests are pre-aggregated, and only responses carry their payload.
    Other columns are not written; no rows give an empty archive.
    """
    register(pages.sparkSession)
    body = F.coalesce(named(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(named(id_col).cast("long").alias("id"), named(url_col).alias("url"), body.alias("payload")).withColumns(
        {"payload_sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    scratch = Scratch(pages.sparkSession)
    slim = scratch.keep(rows.where(F.col("payload_bytes") >= min_bytes).select("id", "url", "payload_sha1", "payload_bytes"), "slim")
    owners = scratch.keep(slim.groupBy("payload_sha1").agg(F.min("id").alias("owner"), F.count("*").alias("n")), "owners")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    # revisits need no payload; those of a payload that a large share of the pages has get its owner by a broadcast
    most = max(64, slim.count() // HOT_SHARES)
    hot = F.broadcast(owners.where(F.col("n") > most).select("payload_sha1", F.col("owner").alias("hot_owner")))  # HOT_SHARES rows at most
    told = slim.join(hot, "payload_sha1", "left")
    cold = told.where("hot_owner IS NULL").drop("hot_owner").join(owners.where((F.col("n") > 1) & (F.col("n") <= most)).drop("n"), "payload_sha1")
    again = cold.unionByName(told.where("hot_owner IS NOT NULL").withColumnRenamed("hot_owner", "owner")).where("owner IS NOT NULL AND NOT id <=> owner")
    revisits = again.select(
        name(F.col("id")).alias("record_id"), F.lit("revisit").alias("record_type"), "url", name(F.col("owner")).alias("refers_to"),
        "payload_sha1", "payload_bytes", F.lit(None).cast("binary").alias("payload"),
    )
    # a response is met by its own id and digest, so equal payloads go to different tasks
    first = owners.select(F.col("payload_sha1").alias("o_sha1"), "owner")
    own = (F.col("payload_sha1") == F.col("o_sha1")) & F.col("id").eqNullSafe(F.col("owner"))
    met = rows.join(first, own, "left").where((F.col("payload_bytes") < min_bytes) | F.col("o_sha1").isNotNull())
    responses = met.select(
        name(F.col("id")).alias("record_id"), F.lit("response").alias("record_type"), "url", F.lit(None).cast("string").alias("refers_to"),
        "payload_sha1", "payload_bytes", "payload",
    )
    responses.unionByName(revisits).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive folder.  Without ``payload`` only headers are read; filters on header columns are pushed down.

    Where a payload is decoded its own digest and length are reported, and
    ``digest_ok`` says whether the digest is the one its headers tell.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(column: str) -> Column:
    return F.expr(f"try_cast(nullif(replace({column}, 'urn:page:', ''), '') AS BIGINT)")
