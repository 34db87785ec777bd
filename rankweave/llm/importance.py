"""Resampling of documents towards a target distribution of hashed n-grams.

A feature is a run of up to ``max_n`` words joined by one space; its bucket is
the CRC-32 of its bytes modulo the number of buckets.  CRCs form an algebra over
GF(2): the CRC of two strings one after the other is that of the first, moved by
a matrix that depends on the second's length alone, plus that of the second.  So
each word's CRC is computed once, n-grams are composed from them, and no string
of an n-gram is ever made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.order import numbered
from rankweave.llm.rows import named, packed, unpacked
from rankweave.llm.scratch import Scratch, received, send
from rankweave.llm.words import ALNUM, Words, split_words

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
ADDED = ("n_words", "n_features", "weight", "score", "rank")


class Shift:
    """Moves CRCs over a number of bytes: what appending that many bytes does to a CRC, but for the bytes' own.

    The step over one zero bit is linear over GF(2), a 32 x 32 matrix; squaring
    it gives the matrices for 8, 16, 32, ... bits, and a length is a product of
    those of its binary digits.  A matrix is applied to many CRCs at once through
    the images of all values of each of their four bytes.
    """

    def __init__(self):
        bit = [POLYNOMIAL, *(1 << k for k in range(31))]  # images of the unit vectors
        for _ in range(3):
            bit = self._times(bit, bit)
        self.columns = [bit]  # of one byte; then of 2, 4, 8, ...
        self.tables = [self._images(bit)]

    @staticmethod
    def _times(a: list[int], b: list[int]) -> list[int]:
        out = []
        for column in b:
            total, k = 0, 0
            while column >> k:
                if column >> k & 1:
                    total ^= a[k]
                k += 1
            out.append(total)
        return out

    @staticmethod
    def _images(columns: list[int]) -> np.ndarray:
        images = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for k in range(8):
                images[byte, 1 << k : 2 << k] = images[byte, : 1 << k] ^ np.uint32(columns[8 * byte + k])
        return images

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = crcs.astype(np.uint32, copy=True)
        for k in range(int(lengths.max(initial=0)).bit_length()):
            if k == len(self.tables):
                self.columns.append(self._times(self.columns[-1], self.columns[-1]))
                self.tables.append(self._images(self.columns[-1]))
            at = np.flatnonzero(lengths >> k & 1)
            x, t = out[at], self.tables[k]
            out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRCs of strings followed by others of the given lengths."""
        return self(first, lengths) ^ second


def run_crcs(words: Words, max_n: int, shift: Shift) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``max_n``: the first word of every run of n words inside a row, and the run's CRC."""
    names, which = words.distinct()
    own = np.fromiter((zlib.crc32(w) for w in names), np.uint32, len(names))[which]
    at, crcs = np.arange(len(own)), own
    yield at, crcs
    if max_n > 1:
        size = words.ends - words.starts
        space = np.full(len(own), zlib.crc32(b" "), np.uint32)
        spaced = shift.joined(space, own, size)  # each word with a space before it
    for n in range(2, max_n + 1):
        inside = at[at + n - 1 < len(own)]
        inside = inside[words.rows[inside] == words.rows[inside + n - 1]]
        crcs = crcs[np.searchsorted(at, inside)]
        last = inside + n - 1
        crcs = shift.joined(crcs, spaced[last], size[last] + 1)
        at = inside
        yield at, crcs


def _counter(max_n: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = Shift(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words in split_words(batch["text"], ALNUM):
                for _, crcs in run_crcs(words, max_n, shift):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all texts: a task sums its own and gives a row for each bucket that it met."""
    own = texts.select(named(text_col).alias("text"))
    return own.mapInArrow(_counter(max_n, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandfold log ratio of smoothed shares of each bucket, rounded down; at most ``buckets`` rows of each side come to the driver."""
    s, t = [0] * buckets, [0] * buckets
    for counts, rows in ((s, source.collect()), (t, target.collect())):
        for row in rows:
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * all_s) / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def _weigher(sent, max_n: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(received(sent), np.int64)
        shift, buckets = Shift(), np.uint32(len(gain))
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for _, rows, words in split_words(batch["text"], ALNUM):
                n, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for at, crcs in run_crcs(words, max_n, shift):
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[crcs % buckets])])
                    edge = np.searchsorted(words.rows[at], np.arange(rows + 1))
                    n += np.diff(edge)
                    weight += sums[edge[1:]] - sums[edge[:-1]]
                for part, x in zip(parts, (np.diff(words.first), n, weight), strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(np.concatenate(p)) for p in parts)], names=["row", *ADDED[:3]])

    return weigh


def score_documents(docs: DataFrame, target: DataFrame, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight`` and ``score`` to the columns ``carry`` of ``docs`` (all by default; equal names, in any case, are replaced).

    Words are runs of ASCII letters (lower-cased), digits and all characters
    beyond ASCII, of whole texts.  ``weight`` sums the gains of a document's
    features; ``score`` adds Gumbel noise that depends on the seed and the id
    alone, so that the highest scores are a draw without replacement in
    proportion to exp(weight / 1000).  A null or empty text has no words and
    weighs 0; a null id is hashed like an empty one, equal ids share their noise;
    an empty target only smooths.  Texts are read twice, and neither time
    shuffled; the gains (``buckets`` numbers) are sent to every task.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets), buckets)
    work = docs.select(packed(docs, ADDED, carry).alias("row"), named(id_col).cast("string").alias("id"), named(text_col).alias("text"))
    work = work.select(F.struct("row", "id").alias("row"), "text")
    shape = T.StructType([work.schema["row"], *(T.StructField(c, T.LongType()) for c in ADDED[:3])])
    out = work.mapInArrow(_weigher(send(spark, gain.tobytes()), max_n), shape)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("row.id", F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise).select(F.col("row.row").alias("row"), *ADDED[:4])


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``score_documents`` with ``rank``: 1, 2, 3, ... for the documents drawn, null for all others.

    Of the N documents with at least ``min_words`` words the floor(percent * N /
    100) highest scores are drawn; ties go to the smaller id, those without an id
    come last.  Each of repeated rows is a document of its own.  Ranks come from
    range partitions (see ``order.numbered``).
    """
    carry = docs.columns if carry is None else carry
    scratch = Scratch(docs.sparkSession)
    packed_docs = docs.select(packed(docs, ADDED, carry).alias("row"), named(id_col).alias("id"), named(text_col).alias("text"), F.lit(0).alias("n_words"))
    scored = score_documents(packed_docs, target, max_n, buckets, seed, "id", "text", target_col, carry=["row", "id"])
    scored = scratch.keep(scored.select(F.col("row.row").alias("row"), F.col("row.id").alias("id"), *ADDED[:4]), "scored")
    fit = F.col("n_words") >= min_words
    most = scored.where(fit).count() * percent // 100
    placed = numbered(scored.withColumn("left_out", ~fit), [F.col("left_out"), F.col("score").desc(), F.col("id").asc_nulls_last()], scratch, "place")
    rank = F.when(F.col("place") < most, F.col("place") + 1)
    return placed.select(*unpacked(placed), *ADDED[:4], rank.alias("rank"))


ORACLE = r"""
WITH tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS r(i))),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, unnest(w) AS x FROM dw),
names AS (SELECT DISTINCT x FROM (SELECT x FROM df UNION ALL SELECT x FROM bw)),
crc AS MATERIALIZED (
  SELECT x, xor(4294967295, list_reduce(
           list_transform(range(1, length(hex(encode(x))), 2), lambda p: 16 * (instr('0123456789ABCDEF', hex(encode(x))[p]) - 1) + instr('0123456789ABCDEF', hex(encode(x))[p + 1]) - 1),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
  FROM names, tbl),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crc USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (x) GROUP BY 1),
g AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
                                      / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
wt AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN crc USING (x) JOIN g USING (bucket) GROUP BY 1),
sc AS MATERIALIZED (
  SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(
           list_transform(range(1, 9), lambda p: instr('0123456789abcdef', sha256('2024:' || dw.doc_id)[p]) - 1), lambda a, b: 16 * a + b, CAST(0 AS BIGINT)) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM dw LEFT JOIN wt ON dw.doc_id = wt.doc_id),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM sc LEFT JOIN rk ON sc.doc_id = rk.doc_id
"""
