"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import Scratch, lean, received, send
from rankweave.llm.words import ALNUM, SMALL_PIECE, Words, member, mix, run_hash, split_words

#: The largest Bloom filter that is sent to every executor has 2 ** SIEVE_BITS bits (16 MB).
SIEVE_BITS = 27
#: Most keys of texts (64 characters) and items of theirs that are sent to every executor; more are shuffled.
BROADCAST_KEYS = 200_000


def winnow(rows: np.ndarray, at: np.ndarray, hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions (word indices) of the rightmost least hash in every window of w consecutive k-grams of a row.

    ``at`` holds the start words of the k-grams, ``rows`` the row of each.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    full = rows[:n] == rows[w - 1 : w - 1 + n]
    best, place = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        other = hashes[j : j + n]
        less = other <= best
        best = np.where(less, other, best)
        place[less] = j
    return at[np.unique((np.arange(n) + place)[full])]


def prints(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of the k-grams that winnowing selects: every run of ``window`` words holds one."""
    at, hashes = words.grams(k)
    chosen = winnow(words.rows[at], at, hashes, window - k + 1)
    return chosen, run_hash(words.hashes, chosen, k)


def digests(words: Words, starts: np.ndarray, n: int) -> list[bytes]:
    """SHA-256 of runs of n words."""
    raw, edge = words.spaced()
    return [hashlib.sha256(raw[a : b - 1]).digest() for a, b in zip(edge[starts].tolist(), edge[starts + n].tolist(), strict=True)]


class Sieve:
    """A Bloom filter of a fixed number of bits: tells which hashes can't be among those that it was made from."""

    def __init__(self, bits: int, slots: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.table = np.zeros(1 << (bits - 6), np.uint64)
        self.table[slots] = values

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for place in places(hashes, self.bits):
            out &= (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of a filter for each hash."""
    return [hashes >> np.uint64(64 - bits), mix(hashes) >> np.uint64(64 - bits)]


def build_sieve(found: DataFrame) -> Sieve:
    """A filter of the hashes ``h``, with about ten bits for each up to SIEVE_BITS; words of the filter are put together by Spark."""
    bits = min(SIEVE_BITS, max(10, int(10 * found.count() + 1).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(places(batch["h"].to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["slot", "value"])

    table = found.mapInArrow(lean(spread), "slot long, value long").groupBy("slot").agg(F.bit_or("value").alias("value")).toArrow()  # 2 ** (bits - 6) rows at most
    return Sieve(bits, table["slot"].to_numpy(), table["value"].to_numpy().view(np.uint64))


def _indexer(window: int, k: int):
    """Benchmark rows (item, text) to fingerprints (h) and windows (digest, n, item)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in split_words(batch["text"], ALNUM, piece=SMALL_PIECE):
                sizes = np.diff(words.first)
                whole, _ = words.grams(window)
                _, chosen = prints(words, window, k)
                runs = [(window, whole, chosen)]
                for n in range(1, window):
                    starts = words.first[np.flatnonzero(sizes == n)]
                    runs.append((n, starts, run_hash(words.hashes, starts, n)))
                for n, starts, hashes in runs:
                    if len(starts):
                        owner = batch["item"].slice(row).take(pa.array(words.rows[starts]))
                        empty = pa.nulls(len(starts), pa.int64())
                        yield pa.RecordBatch.from_arrays([empty, pa.array(digests(words, starts, n), pa.binary()), pa.array(np.full(len(starts), n, np.int32)), owner], names=["h", "digest", "n", "item"])
                        hashes = np.unique(hashes)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes.view(np.int64)), pa.nulls(len(hashes), pa.binary()), pa.array(np.full(len(hashes), n, np.int32)), pa.nulls(len(hashes), owner.type)], names=["h", "digest", "n", "item"]
                        )

    return index


def _places_of(words: Words, lengths: list[int], window: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window lengths with the starts and hashes of the document's fingerprints for them."""
    for n in lengths:
        if n == window:
            yield n, *prints(words, window, k)
        else:
            yield n, *words.grams(n)


def _finder(sent, lengths: list[int], window: int, k: int):
    """Texts to (text_key, h) of the fingerprints that the sieve lets through."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = received(sent)
        for batch in batches:
            for row, count, words in split_words(batch["text"], ALNUM, piece=SMALL_PIECE):
                rows, hashes = [], []
                for _, starts, h in _places_of(words, lengths, window, k):
                    through = sieve.holds(h)
                    rows.append(words.rows[starts[through]])
                    hashes.append(h[through])
                pairs = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(hashes)], names="row,h"))
                names = {int(r): hashlib.sha256(batch["text"][row + int(r)].as_py().encode()).hexdigest() for r in np.unique(pairs["row"])}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[int(r)] for r in pairs["row"]], pa.string()), pa.array(np.ascontiguousarray(pairs["h"]).view(np.int64))], names=["text_key", "h"]
                )

    return find


def _extender(lengths: list[int], window: int, k: int):
    """Texts with their shared fingerprints to all windows that cover one: (text_key, start, n, digest)."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, count, words in split_words(batch["text"], ALNUM, piece=SMALL_PIECE):
                shared = [np.sort(np.array(batch["hashes"][row + r].as_py(), np.int64).view(np.uint64)) for r in range(count)]
                for n, starts, hashes in _places_of(words, lengths, window, k):
                    mine = np.zeros(len(starts), dtype=bool)
                    edge = np.searchsorted(words.rows[starts], np.arange(count + 1))
                    for r in range(count):
                        mine[edge[r] : edge[r + 1]] = member(hashes[edge[r] : edge[r + 1]], shared[r])
                    at = starts[mine]
                    if n == window:
                        at = np.unique((at[:, None] - np.arange(window - k + 1)[None, :]).ravel())
                        at = at[(at >= 0) & (at + n <= len(words.rows))]
                        at = at[words.rows[at] == words.rows[at + n - 1]]
                    owner = words.rows[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch["text_key"].slice(row).take(pa.array(owner)), pa.array((at - words.first[owner]).astype(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(digests(words, at, n), pa.binary())],
                        names=["text_key", "start", "n", "digest"],
                    )

    return extend


@F.arrow_udf(T.LongType())
def word_counts(texts: pa.Array) -> pa.Array:
    """Words of every text."""
    counts = [np.diff(words.first) for _, _, words in split_words(texts, ALNUM, hashed=False, piece=SMALL_PIECE)]
    return pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64())


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    window: int = 10,
    k: int = 5,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Find the words of every document that lie inside a benchmark window.

    Adds to the columns ``carry`` of ``docs`` (all of them if not given; equal
    names, in any case, are replaced): ``n_words``, ``n_hit`` (words inside any
    occurrence of any window), ``items`` (ids of the items with such windows,
    unordered) and ``contaminated`` (n_hit > 0).

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  Fingerprints of both sides are the k-grams that winnowing
    selects (for shorter items their only window); they are joined on their
    hashes, after a Bloom filter of bounded size has left out most that have
    no partner.  Texts with shared fingerprints are extended to the windows
    around them, and these are joined with the benchmark's windows by SHA-256.
    Equal texts are looked at once.

    Texts are lower-cased in A-Z only; a word is a run of digits, a-z and
    characters beyond ASCII.  A null or empty text has no words.  Items without
    words take no part; rows with one id are one item, and so are all rows with
    a null id (which is then one of ``items``).  No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = named(text_col)
    work = docs.select(packed(docs, ("n_words", "n_hit", "items", "contaminated"), carry).alias("row"), F.sha2(text, 256).alias("text_key"), word_counts(text).alias("n_words"))

    usable = benchmark.select(named(item_col).alias("item"), named(item_text_col).alias("text")).where("text IS NOT NULL")
    item = usable.schema["item"].dataType
    shape = T.StructType([T.StructField("h", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("item", item)])
    index = scratch.keep(usable.mapInArrow(lean(_indexer(window, k)), shape), "benchmark")
    known = scratch.keep(index.where("h IS NOT NULL").select("h").distinct(), "prints")
    windows = scratch.keep(index.where("digest IS NOT NULL").select("digest", "item").distinct(), "windows")
    lengths = sorted(r["n"] for r in index.select("n").distinct().collect())  # ``window`` numbers at most
    none = F.array().cast(T.ArrayType(item))
    if not lengths:
        return work.select(*unpacked(work), "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.lit(False).alias("contaminated"))

    sieve = send(spark, build_sieve(known))
    texts = docs.select(text.alias("text")).where("text IS NOT NULL")
    maybe = texts.mapInArrow(lean(_finder(sieve, lengths, window, k)), "text_key string, h long")
    shared = scratch.keep(maybe.join(known, "h").distinct().groupBy("text_key").agg(F.collect_list("h").alias("hashes")), "shared")
    keys = shared.select("text_key")
    keys = F.broadcast(keys) if shared.count() <= broadcast_keys else keys
    own = texts.withColumn("text_key", F.sha2("text", 256)).join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    around = own.join(shared, "text_key").mapInArrow(lean(_extender(lengths, window, k)), "text_key string, start long, n int, digest binary")
    hits = scratch.keep(around.join(windows.select("digest").distinct(), "digest"), "hits")

    before = Window.partitionBy("text_key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    inside = hits.select("text_key", F.greatest(F.col("start") + F.col("n") - reach, F.lit(0)).alias("new")).groupBy("text_key").agg(F.sum("new").alias("n_hit"))
    owners = hits.select("text_key", "digest").distinct().join(windows, "digest").select("text_key", F.struct("item").alias("item")).distinct()  # structs, as lists leave nulls out
    items = owners.groupBy("text_key").agg(F.transform(F.collect_list("item"), lambda x: x["item"]).alias("items"))
    found = scratch.keep(inside.join(items, "text_key"), "found")
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    found = F.broadcast(found) if max(size) <= broadcast_keys else found
    out = work.join(found, "text_key", "left")
    return out.select(
        *unpacked(out), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bn, unnest(range(1, len(w) - n + 2)) AS t(i)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
