"""Exact top-k inner products by length buckets with local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.rows import named
from rankweave.llm.scratch import Scratch, received, send

#: Queries that are sent to every executor at once; more queries take several passes.
BLOCK_QUERIES = 8192
#: Longest candidates whose products give every query a first threshold.
SEED_ROWS = 1000


#: Vectors with a squared length under this go through 64-bit integers; others through exact ones of any size.
SHORT = 2.0**62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite_vector(vec: Column) -> Column:
    """The components as doubles; null where one is null or not finite."""
    whole = F.transform(vec, lambda x: x.cast("double"))
    return F.when(F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), whole)


def length_bucket(vec: Column, scale: int) -> Column:
    """Vectors of one bucket differ in length by less than an eighth of an octave; all beyond the doubles' range are in one."""
    squares = F.aggregate(vec, F.lit(0.0), lambda s, x: s + (x * float(scale)) * (x * float(scale)))
    return F.when(squares > 0, F.floor(F.log2(F.least(squares, F.lit(1e308))) * 4)).otherwise(-5000).cast("int")


def whole(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x): short rows as 64-bit integers, the numbers of the long rows, and these as exact integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
        long = ~((y * y).sum(1) < SHORT)
    exact = [[int(v) if np.isfinite(v) else int(w) * scale for v, w in zip(a, b, strict=True)] for a, b in zip(y[long].tolist(), x[long].tolist(), strict=True)]
    wide = np.empty((len(exact), x.shape[1]), object)
    for i, row in enumerate(exact):
        wide[i] = row
    return np.where(long[:, None], 0.0, y).astype(np.int64), np.flatnonzero(long), wide


class Block:
    """Some queries of one dimension and the best scores known for them.

    ``short`` are the numbers of the queries that go through 64-bit integers,
    ``long`` of all others; the latter have no floor.
    """

    def __init__(self, ids, x: np.ndarray, k: int, scale: int):
        self.ids = np.asarray(ids, np.int64)
        self.k, self.scale = k, scale
        self.vectors, self.long, self.exact = whole(x, scale)
        self.short = np.setdiff1d(np.arange(len(self.ids)), self.long)
        self.lengths = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.floor = np.full(len(self.ids), -np.inf)  # no score under it can be among the best

    def raise_floor(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Products with some candidates give the k-th best score at least."""
        for a in range(0, len(self.short), 512):
            own = self.short[a : a + 512]
            score = products(self.vectors[own], vectors).astype(np.float64)
            score[self.ids[own, None] == ids[None, :]] = -np.inf
            if score.shape[1] >= self.k:
                self.floor[own] = np.maximum(self.floor[own], np.partition(score, -self.k, axis=1)[:, -self.k])


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point where that is exact."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def exact_products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of integers of any size, held at the ends of a long where they are beyond it."""
    out = np.array([[max(LEAST, min(MOST, sum(a * b for a, b in zip(x, y, strict=True)))) for y in p.tolist()] for x in q.tolist()], np.int64)
    return out.reshape(len(q), len(p))


class Best:
    """The k best (score, smaller id first) of every query so far."""

    def __init__(self, block: Block):
        self.block, self.floor = block, block.floor.copy()
        self.q = self.id = self.score = np.zeros(0, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.block.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        last = place == self.block.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])

    def verify(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compute the products of some queries with some candidates and keep what may be among the best."""
        for a in range(0, len(queries), 256):
            own = queries[a : a + 256]
            score = products(self.block.vectors[own], vectors)
            least = self.floor[own]
            k = self.block.k
            mine = self.block.ids[own, None] == ids[None, :]  # any number of rows may have the query's own id
            if len(ids) > k:
                score[mine] = np.iinfo(np.int64).min
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero((score >= least[:, None]) & ~mine)
            self.add(own[i], ids[j], score[i, j])


def scan_long(best: Best, ids: np.ndarray, vectors: np.ndarray, long: np.ndarray, exact: np.ndarray) -> None:
    """Meet candidates that are long with all queries, and the others with the long queries."""
    block = best.block
    short = np.setdiff1d(np.arange(len(ids)), long)
    every, known = np.concatenate([block.short, block.long]), np.concatenate([block.vectors[block.short].astype(object), block.exact])
    for queries, own, rows, there in ((every, known, long, exact), (block.long, block.exact, short, vectors[short])):
        for a in range(0, len(queries), 256):
            for b in range(0, len(rows), 256):
                score = exact_products(own[a : a + 256], there[b : b + 256])
                i, j = np.nonzero(block.ids[queries[a : a + 256], None] != ids[rows[b : b + 256]][None, :])
                best.add(queries[a : a + 256][i], ids[rows[b : b + 256]][j], score[i, j])


def scan_bucket(best: Best, ids: np.ndarray, vectors: np.ndarray, dense_share: float = 0.25) -> None:
    """Meet all queries with the candidates of one length bucket.

    A query whose floor divided by both lengths is above 1 can skip the bucket
    (length pruning).  Else this quotient is a cosine threshold; where it leaves
    few candidates, a candidate's largest-weight coordinates must lie in the
    intervals that the threshold allows (coordinate pruning, by a binary search
    in the sorted coordinate).  Where it leaves many, the bucket is verified
    whole.
    """
    block = best.block
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    longest = lengths.max()
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = best.floor / (block.lengths * longest)
    cosine = np.where(np.isnan(cosine), -np.inf, cosine) - 1e-9
    # a zero vector has product 0 with all: it can skip only under a positive floor
    skip = (cosine > 1) | ((block.lengths * longest == 0) & (best.floor > 0))
    open_ = block.short[~skip[block.short]]
    dense = [open_[cosine[open_] <= 0]]
    pruned = open_[cosine[open_] > 0]
    if len(pruned) and vectors.shape[1]:
        unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        weights = block.vectors[pruned] / block.lengths[pruned][:, None]
        focus = np.argsort(-np.abs(weights), axis=1)[:, :3]
        slack = np.sqrt(np.maximum(0.0, 1 - cosine[pruned] ** 2))
        for f in np.unique(focus[:, 0]):
            column = np.argsort(unit[:, f], kind="stable")
            values = unit[column, f]
            mine = np.flatnonzero(focus[:, 0] == f)
            low, high = interval(weights[mine, f], cosine[pruned[mine]], slack[mine])
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            many = (b - a) > dense_share * len(ids)
            dense.append(pruned[mine[many]])
            for n in np.flatnonzero(~many):
                rows, q = column[a[n] : b[n]], mine[n]
                for g in focus[q, 1:]:
                    lo, hi = interval(weights[q, g], cosine[pruned[q]], slack[q])
                    rows = rows[(unit[rows, g] >= lo) & (unit[rows, g] <= hi)]
                if len(rows):
                    best.verify(pruned[q : q + 1], ids[rows], vectors[rows])
    else:
        dense.append(pruned)
    rest = np.concatenate(dense)
    if len(rest):
        best.verify(rest, ids, vectors)


def interval(weight, cosine, slack):
    """Least and greatest coordinate of a unit vector whose cosine with a query of this coordinate reaches the threshold."""
    room = slack * np.sqrt(np.maximum(0.0, 1 - weight**2))
    low = np.where(weight <= -cosine, -1.0, weight * cosine - room)
    high = np.where(weight >= cosine, 1.0, weight * cosine + room)
    return low - 1e-9, high + 1e-9


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def _scanner(sent, dim: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(received(sent))
        for batch in batches:
            ids, bucket = batch["id"].to_numpy(), batch["bucket"].to_numpy()
            vectors, long, exact = whole(matrix(batch["v"], dim), best.block.scale)
            bucket = bucket.copy()
            bucket[long] = np.iinfo(bucket.dtype).max
            for b in -np.unique(-bucket[np.setdiff1d(np.arange(len(ids)), long)].astype(np.int64)):  # longest first
                rows = np.flatnonzero(bucket == b)
                scan_bucket(best, ids[rows], vectors[rows])
            if len(long) or len(best.block.long):
                scan_long(best, ids, vectors, long, exact)
        q = best.q
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(best.block.ids[q]), pa.array(best.id), pa.array(best.score)],
            names=["q", "query_id", "vec_id", "score"],
        )

    return scan


def top_products(
    queries: DataFrame,
    candidates: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    block_queries: int = BLOCK_QUERIES,
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """The k candidates with the greatest inner products for every query.

    Both tables have ``id_col`` and ``vec_col``; components become
    floor(scale * x).  Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller id, and a query never meets rows of its own id.  Fewer than
    k candidates give fewer rows.

    Candidates are stored once by dimension and length bucket, without a
    shuffle.  Queries go through in blocks of about ``block_queries``, one after
    the other: a block is sent to the executors, the products with the
    ``seed_rows`` longest candidates give every query a floor, from which
    ``scan_bucket`` derives its thresholds and which rises as a task goes on,
    tasks return k rows a query at most, and the block's result is written.

    Rows with a null id or vector, or with null or non-finite components, take
    no part.  All other vectors do: those with a length of 2**31 or more after
    scaling are multiplied as exact integers, one by one; a result that a long
    can't hold is an error.  Only vectors of equal dimension meet; vectors
    without components have products of 0.  A query row that is repeated gets
    its result once for each row; no rows give no rows.
    """
    spark = candidates.sparkSession
    scratch = Scratch(spark)

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(named(id_col).cast("long").alias("id"), finite_vector(named(vec_col)).alias("v"))
        return own.where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))

    there = usable(candidates).withColumn("bucket", length_bucket(F.col("v"), scale)).sortWithinPartitions("dim", F.col("bucket").desc())
    there = scratch.keep(there, "candidates")
    asked = scratch.keep(usable(queries).groupBy("dim", "id", "v").agg(F.count("*").alias("times")), "queries")
    folder = scratch.path("found")
    shape = "q long, query_id long, vec_id long, score long"
    part = 0
    for row in asked.groupBy("dim").count().orderBy("dim").toLocalIterator():
        dim, blocks = row["dim"], -(-row["count"] // block_queries)
        own = there.where(F.col("dim") == dim)
        seeds = own.where(F.col("bucket") < 4 * 61).orderBy(F.col("bucket").desc(), "id").limit(seed_rows).toArrow()
        for b in range(blocks):
            # a block holds about block_queries rows: distinct queries are dealt by hash
            some = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b)).toArrow().combine_chunks()
            if not some.num_rows:
                continue
            block = Block(some["id"].to_numpy(), matrix(some["v"].combine_chunks(), dim), k, scale)
            if seeds.num_rows:
                block.raise_floor(seeds["id"].to_numpy(), whole(matrix(seeds["v"].combine_chunks(), dim), scale)[0])
            sent = send(spark, block)
            hits = own.select("id", "bucket", "v").mapInArrow(_scanner(sent, dim), shape)
            times = spark.createDataFrame(pa.table({"q": pa.array(np.arange(some.num_rows)), "times": some["times"]}))
            order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
            best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(times, "q")
            best.select(F.explode(F.sequence(F.lit(1).cast("long"), "times")), "query_id", "rank", "vec_id", "score").drop("col").write.mode("append").parquet(folder)
            sent.destroy()
            part += 1
    out = "query_id long, rank int, vec_id long, score long"
    found = spark.read.schema(out).parquet(folder) if part else spark.createDataFrame([], out)
    beyond = F.raise_error(F.lit("a score is beyond a long")).cast("long")
    return found.withColumn("score", F.when(F.col("score").isin(LEAST, MOST), beyond).otherwise(F.col("score")))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scored)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 10
"""
