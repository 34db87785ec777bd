"""Token ids of documents as binary shards with one shared zstandard dictionary.

A shard holds documents in ascending order of their id.  Each is a zstandard
frame of its own, so that a short document is read by its offset alone; what
short frames lack in context comes from a dictionary trained on serialized id
arrays, which all shards of a folder share and name by its SHA-256.  Layout:

    TOKSHARD, width (1 byte), SHA-256 of the dictionary (32 bytes)
    the frames
    index: a zstandard frame of little-endian arrays of documents: id (int64),
           whether it has one (byte), length of its frame, number of ids, CRC-32
           of its ids as 32-bit integers (uint64 each)
    length of the index (uint64), number of documents (uint64), TOKSHARD

``_manifest.json`` lists the shards of committed tasks in order.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from rankweave.llm.rows import named
from rankweave.llm.scratch import received, send
from rankweave.llm.warc import open_fs

MAGIC = b"TOKSHARD"
MANIFEST, DICTIONARY = "_manifest.json", "dictionary.zdict"
LEVEL = 1
#: The dictionary's size, and the sample it is trained on: so many documents of up to so many characters.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 112_640, 2_000, 16_384
#: Ids of pieces of text of up to so many characters are kept by a worker: the last so many pieces, and those of the time before.
CACHE_PIECES, CACHE_CHARS, CACHE_TAILS = 600_000, 48, 10_000
#: Texts are encoded together up to about so many characters.
GROUP_CHARS = 2 << 20
SHARD_BYTES = 256 << 20
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
_END = "<QQ8s"
_INDEX_DOC = 8 + 1 + 3 * 8


class Pieces(dict):
    """Ids of pieces of text that follow a space, learnt when they are first asked for.

    Letters and the signs after them are put together from each other's ids;
    other pieces are split by the vocabulary's pattern.  Those of the time
    before (``older``) are taken over.
    """

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            head = piece.rstrip(SIGNS)
            if not head.isalpha():
                ids = self.encoder.split_ids(piece)
            elif head == piece:
                ids = self.encoder.word_ids(piece)
            else:
                ids = self[head] + self.encoder.tail_ids(piece[len(head) :])
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """A tokenizer of the tokenizers library, with the ids of frequent pieces of text at hand.

    A byte-level vocabulary splits a text before each space that stands before
    anything but white space, whatever comes before, so the ids of such pieces
    can be put together.  Other vocabularies take whole texts.  Unpickling makes
    it anew from the vocabulary, so that all tasks of a worker share its pieces.
    """

    def __init__(self, vocabulary: str, end_id: int | None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.source = vocabulary, end_id
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        rules = json.loads(vocabulary)
        before = rules.get("pre_tokenizer") or {}
        splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.by_piece = bool(splits) and rules.get("normalizer") is None
        self.model, self.before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        # the character that stands for each byte: those of one byte tell their own, others follow from the bytes of a longer character
        self.letters = dict(zip(range(128), "".join(shown.pre_tokenize_str(chr(b))[0][0] for b in range(128)), strict=True))
        for c in map(chr, (*range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000))):
            if not 0xD800 <= ord(c) < 0xE000:
                self.letters.update(zip(c.encode(), shown.pre_tokenize_str(c)[0][0], strict=True))
        wide = max(self.tokenizer.get_vocab_size() - 1, end_id or 0) >= 1 << 16
        self.kind, self.width = ("I", 4) if wide else ("H", 2)
        self.end = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        self.pieces = Pieces(self, {})
        self.tails: dict[str, bytes] = {}

    def __reduce__(self):
        return Encoder, self.source

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, word: str) -> bytes:
        """The ids of letters with a space before them, which the pattern leaves whole, straight from the model."""
        shown = f" {word}".encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [x.id for x in self.model.tokenize(shown)]).tobytes()

    def split_ids(self, piece: str) -> bytes:
        """The ids of a piece with a space before it."""
        ids = [x.id for shown, _ in self.before.pre_tokenize_str(f" {piece}") for x in self.model.tokenize(shown)]
        return array(self.kind, ids).tobytes()

    def tail_ids(self, tail: str) -> bytes:
        """The ids of signs after a word."""
        if tail not in self.tails:
            if len(self.tails) > CACHE_TAILS:
                self.tails.clear()
            self.tails[tail] = self._encoded([tail])[0]
        return self.tails[tail]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian numbers."""
        if not self.by_piece:
            return [x + self.end for x in self._encoded(texts)]
        cut = [pieces_of(text) for text in texts]
        begins = self._encoded([x[0] for x in cut])
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.older = {}
            self.pieces = Pieces(self, dict(self.pieces))
        ids_of = self.pieces.__getitem__
        return [begin + b"".join(map(ids_of, islice(x, 1, None))) + self.end for begin, x in zip(begins, cut, strict=True)]


#: Signs, of which the pattern takes any run after a word together, and white space as Python tells it.
SIGNS = string.punctuation
_ASCII_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f "
_OTHER_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_cut = re.compile(r" (?=\S)").split


def pieces_of(text: str) -> list[str]:
    """A text cut at every space before anything but white space."""
    if text.endswith(" ") or any(" " + c in text for c in _ASCII_SPACE) or not text.isascii() and any(c in text for c in _OTHER_SPACE):
        return _cut(text)
    return text.split(" ")


def _encoder(sent):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = received(sent)
        for batch in batches:
            raw = batch["text"].cast(pa.large_binary()).fill_null(b"")
            at = 0
            while at < len(raw):  # some texts at a time, at least one
                size, end = 0, at
                texts: list[str] = []
                while end < len(raw) and size < GROUP_CHARS:
                    texts.append(raw[end].as_py().decode("utf-8", "replace"))
                    size += len(texts[-1])
                    end += 1
                yield pa.RecordBatch.from_arrays([batch["doc_id"][at:end], pa.array(encoder(texts), pa.binary())], names=["doc_id", "ids"])
                at = end

    return encode


def encode(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text by the vocabulary file, then ``end_id``, as little-endian numbers of two bytes (four if the vocabulary needs them).

    A null or empty text has no ids but the end; strings of special tokens in a
    text are ordinary text.  The file is read here and sent to the executors,
    which need no copy of it.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    own = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return own.mapInArrow(_encoder(send(docs.sparkSession, Encoder(text, end_id))), "doc_id long, ids binary")


def id_width(vocabulary: str, end_id: int | None) -> int:
    with open(vocabulary, encoding="utf-8") as f:
        return Encoder(f.read(), end_id).width


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the id arrays of at most ``sample`` whole texts of up to ``chars`` characters, the first by a hash of id and text.

    It helps to compress and nothing else.  Where there are too few texts to
    train on it is their arrays themselves, and empty where there are none.
    """
    own = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).where(F.length("text").between(1, chars))
    some = own.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample)
    arrays = [bytes(r["ids"]) for r in encode(some, vocabulary, end_id).collect()]  # at most sample * chars ids
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


@dataclass
class Written(WriterCommitMessage):
    part: int
    shards: list  # {name, docs, tokens, first, last, starts}


class ShardWriter(DataSourceArrowWriter):
    """Writes rows of doc_id and ids, which come in order, to the shards of one task."""

    def __init__(self, path: str, width: int, shard_bytes: int):
        self.path, self.width, self.shard_bytes = path, width, shard_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{DICTIONARY}") as f:
            data = f.read()
        shared = as_dictionary(data)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        shards: list[dict] = []
        out, index, size = None, [], 0

        def close() -> None:
            ids, known, lengths, counts, crcs = (np.array(x) for x in zip(*index, strict=True))
            table = ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + b"".join(x.astype("<u8").tobytes() for x in (lengths, counts, crcs))
            table = zstandard.ZstdCompressor(level=3).compress(table)
            out.write(table)
            out.write(struct.pack(_END, len(table), len(index), MAGIC))
            out.close()
            some = ids[known]
            shards[-1] |= {"docs": len(index), "tokens": int(counts.sum()), "first": int(some.min()) if len(some) else None, "last": int(some.max()) if len(some) else None}

        for batch in iterator:
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if out is not None and size >= self.shard_bytes:
                    close()
                    out, index = None, []
                if out is None:
                    shards.append({"name": f"part-{uuid.uuid4().hex}.tok"})  # a new name for each attempt of a task
                    out, size = fs.open_output_stream(f"{root}/{shards[-1]['name']}", compression=None), 0
                    out.write(MAGIC + bytes([self.width]) + hashlib.sha256(data).digest())
                frame = packer.compress(ids)
                out.write(frame)
                size += len(frame)
                numbers = np.frombuffer(ids, f"<u{self.width}")
                index.append((doc or 0, doc is not None, len(frame), len(numbers), zlib.crc32(numbers.astype("<u4"))))
        if out is not None:
            close()
        return Written(TaskContext.get().partitionId(), shards)

    def commit(self, messages) -> None:
        """Only shards of committed tasks enter the manifest, in the order of the partitions; what lost tasks wrote is never read."""
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{DICTIONARY}") as f:
            name = hashlib.sha256(f.read()).hexdigest()
        start, listed = 0, []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for shard in m.shards:
                listed.append(shard | {"start": start})
                start += shard["tokens"]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"dictionary": name, "width": self.width, "tokens": start, "shards": listed}).encode())

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for shard in m.shards if m is not None else ():
                fs.delete_file(f"{root}/{shard['name']}")


class Piece(InputPartition):
    def __init__(self, shard: dict | None):
        self.shard = shard


class ShardReader(DataSourceReader):
    def __init__(self, path: str, ids: bool):
        self.path, self.ids = path, ids
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and IN tests on doc_id: only shards that can hold the ids are opened, and only their frames are read."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Piece]:
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        holds = lambda s: self.wanted is None or s["first"] is not None and any(s["first"] <= i <= s["last"] for i in self.wanted)
        return [Piece(s) for s in shards if holds(s)] or [Piece(None)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.shard is None:
            return
        fs, root = open_fs(self.path)
        with fs.open_input_stream(f"{root}/{DICTIONARY}") as f:
            data = f.read()
        shared = as_dictionary(data)
        unpacker = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        with fs.open_input_file(f"{root}/{partition.shard['name']}") as f:
            index = read_index(f)
            f.seek(0)
            head = f.read(len(MAGIC) + 33)
            if head[:8] != MAGIC or head[9:] != hashlib.sha256(data).digest():
                raise ValueError(f"{partition.shard['name']} is no shard of this dictionary")
            width = head[8]
            rows: list[tuple] = []
            size, at, start = 0, len(head), partition.shard["start"]
            f.seek(at)
            moved = at
            for doc, known, length, n, crc in zip(*(x.tolist() for x in index), strict=True):
                if self.wanted is None or known and doc in self.wanted:
                    if moved != at:
                        f.seek(at)
                    ids = np.frombuffer(unpacker.decompress(f.read(length), max_output_size=n * width), f"<u{width}").astype("<u4")
                    moved = at + length
                    own = zlib.crc32(ids)
                    if own != crc or len(ids) != n:
                        raise ValueError(f"a document of {partition.shard['name']} is damaged")
                    rows.append((doc if known else None, start, n, own, ids))
                    size += 4 * n + 100
                at += length
                start += n
                if size >= 8 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        doc, start, n, crc, ids = zip(*rows, strict=True)
        if self.ids:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids).view(np.int32)))
        else:
            lists = pa.nulls(len(rows), pa.list_(pa.int32()))
        own = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(own, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_index(f) -> list[np.ndarray]:
    """Ids, whether there is one, lengths of frames, numbers of ids and their CRC-32 of an open shard."""
    tail = struct.calcsize(_END)
    f.seek(f.size() - tail)
    length, n, magic = struct.unpack(_END, f.read(tail))
    if magic != MAGIC:
        raise ValueError("no token shard")
    f.seek(f.size() - tail - length)
    table = zstandard.ZstdDecompressor().decompress(f.read(length), max_output_size=n * _INDEX_DOC)
    parts, at = [], 0
    for kind in ("<i8", "u1", "<u8", "<u8", "<u8"):
        size = n * np.dtype(kind).itemsize
        parts.append(np.frombuffer(table[at : at + size], kind))
        at += size
    parts[1] = parts[1].astype(bool)
    return parts


class TokenShards(DataSource):
    """``spark.read.format("token_shards")`` with options ``path`` and ``ids`` (give the ids themselves, default true)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], self.options.get("ids", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options["width"]), int(self.options.get("shardBytes", SHARD_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)


def ascending(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) by ranges of the id, sorted there; rows of one id stand in order of a hash of their text, those without an id come last.

    Rows of one id and text go to as many ranges as they need, parted by the
    place in the table read.
    """
    own = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    own = own.withColumns({"tie": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    keys: list[Column] = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("at")]
    return own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the ids to a new folder of shards, in ascending order of the id.

    Texts are dealt by ranges of the id before they are encoded, so that they
    are encoded once, and ids go from the tokenizer to the file.  Repeated rows
    are written each; an empty table gives a folder without shards.
    """
    spark = docs.sparkSession
    register(spark)
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{DICTIONARY}", compression=None) as out:
        out.write(train_dictionary(docs, vocabulary, end_id, id_col, text_col))
    ids = encode(ascending(docs, id_col, text_col), vocabulary, end_id)
    ids.write.format("token_shards").mode("append").option("width", id_width(vocabulary, end_id)).option("shardBytes", shard_bytes).save(path)


def read_shards(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents of a folder; ``start`` counts the ids of all before.

    Every document is decoded and its checksum compared; without ``ids`` the
    last column stays null.  A filter for some ids reads their frames alone.
    """
    register(spark)
    return spark.read.format("token_shards").option("ids", str(ids).lower()).load(path)
