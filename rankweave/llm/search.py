"""Ranked lexical search over compressed postings.

The index is cut into shards of a bounded number of documents and terms.  A
shard has, for each of its terms, the documents that hold it in order of their
id and how often, as variable-length numbers.  A query walks the postings of its
terms document by document: a heap merges the cursors, and the best documents
so far stand in a heap of bounded size, whose worst is the bar that a document
has to pass.  The best of all shards are merged at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.rows import named
from rankweave.llm.scratch import Scratch, received, send
from rankweave.llm.words import ALNUM, split_words, whole_words

#: A shard ends where it has so many documents or distinct (document, term) pairs; one longer document is a shard.
SHARD_DOCS, SHARD_PAIRS = 1 << 16, 1 << 21
#: Queries that are searched together; their terms' postings of one shard are in memory at once.
QUERY_BLOCK = 4096
#: Postings that are merged before the bar is looked at again: few at first, then up to so many.
FIRST_RUN, LONGEST_RUN = 1 << 9, 1 << 15
#: Bits of a merged number that tell the cursor; a query may have as many terms in one merge.
CURSOR_BITS = 20
#: Rows of one batch of the index.
ROWS = 1 << 14


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative numbers as groups of seven bits, lowest first (all but a number's last byte have the high bit set), and where each begins (and the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        byte = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[ends[some] - size[some] + k] = byte | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), np.concatenate([np.zeros(1, np.int64), ends])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


class ShardBuilder:
    """Gathers documents and gives a shard's rows: one for every term, and one of facts on its documents."""

    def __init__(self, number: int):
        self.number = number
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, ids: list, words) -> None:
        names, which = words.distinct()
        slots = np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in names), np.int64, len(names))
        own = slots[which]
        doc = words.rows + len(self.ids)
        self.ids += ids
        self.lengths += np.diff(words.first).tolist()
        if len(own):
            key, tf = np.unique(own << 32 | doc, return_counts=True)
            self.parts.append(((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32)))
            self.pairs += len(key)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.pairs >= SHARD_PAIRS

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))  # documents without an id stand last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        yield facts_batch(self.number, ids[order], known[order], lengths)
        if not self.parts:
            return
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        key = term.astype(np.int64) << 32 | place[doc]
        del term, doc
        sort = np.argsort(key, kind="stable")
        key, tf = key[sort], tf[sort]
        del sort
        term, doc = (key >> 32).astype(np.int32), key & 0xFFFFFFFF
        del key
        edge = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        gap = np.diff(doc, prepend=0)
        gap[edge[:-1]] = doc[edge[:-1]]
        both = np.empty(2 * len(doc), np.int64)
        both[::2], both[1::2] = gap, tf
        names = list(self.terms)
        data, begins = pack(both)
        begins = begins[2 * edge]
        for a in range(0, len(edge) - 1, ROWS):
            own = slice(a, min(a + ROWS, len(edge) - 1))
            some = [data[x:y] for x, y in zip(begins[own].tolist(), begins[own.start + 1 : own.stop + 1].tolist(), strict=True)]
            yield index_batch(self.number, [names[i].decode("utf-8", "replace") for i in term[edge[own]].tolist()], np.diff(edge[own.start : own.stop + 1]), some)


_SHAPE = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), *((c, pa.binary()) for c in ("postings", "ids", "known", "lengths")), ("n", pa.int64()), ("total", pa.int64())])
_COLUMNS = "shard long, term string, df long, postings binary, ids binary, known binary, lengths binary, n long, total long"


def facts_batch(number: int, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    facts = {"shard": number, "ids": ids.tobytes(), "known": np.packbits(known).tobytes(), "lengths": lengths.tobytes(), "n": int((lengths > 0).sum()), "total": int(lengths.sum())}
    return pa.RecordBatch.from_pylist([facts], _SHAPE)


def index_batch(number: int, terms: list[str], df: np.ndarray, postings: list[bytes]) -> pa.RecordBatch:
    n = len(terms)
    own = {"shard": pa.array(np.full(n, number)), "term": pa.array(terms, pa.string()), "df": pa.array(df), "postings": pa.array(postings, pa.binary())}
    return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in _SHAPE], schema=_SHAPE)


def _builder():
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        shard = ShardBuilder(first)
        for batch in batches:
            ids = batch["id"].to_pylist()
            for row, n, words in split_words(batch["text"], ALNUM):
                shard.add(ids[row : row + n], words)
                if shard.full():
                    yield from shard.batches()
                    shard = ShardBuilder(shard.number + 1)
        yield from shard.batches()

    return build


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of all rows: no shuffle, as a task makes shards of what it reads.

    Terms are runs of ASCII letters (lower-cased), digits and all characters
    beyond ASCII, of whole texts.  Each row is a document, repeated rows too; a
    null or empty text has no terms.
    """
    own = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return scratch.keep(own.mapInArrow(_builder(), _COLUMNS), "index")


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Shard:
    """Postings of the terms of a block of queries: places of documents and what a term gives each of them."""

    def __init__(self, facts: dict, postings: dict[str, bytes], weights: dict[str, int], n: int, total: int):
        lengths = np.frombuffer(facts["lengths"], np.int64)
        self.ids = np.frombuffer(facts["ids"], np.int64)
        self.known = np.unpackbits(np.frombuffer(facts["known"], np.uint8), count=len(lengths)).astype(bool)
        # a product beyond 64 bits needs 10**9 documents of 10**8 words
        m = 10 + 90 * n * lengths // max(total, 1)
        self.lists: dict[str, tuple[np.ndarray, np.ndarray, int]] = {}
        for term, data in postings.items():
            both = unpack(data)
            at, tf = np.cumsum(both[::2]), both[1::2]
            score = weights[term] * impacts(tf, m[at])
            self.lists[term] = at, score, int(score.max())


def merged(lists: list[np.ndarray]) -> Iterable[int]:
    """All postings of some lists, document by document, as document << CURSOR_BITS | cursor: a heap holds one number a list."""
    return heapq.merge(*((x << CURSOR_BITS | c).tolist() for c, x in enumerate(lists)))


def search_shard(shard: Shard, terms: list[str], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents of a shard with a score above 0, best first; equal scores in order of the place.

    Lists are put aside, least first, while all of them together cannot lift a
    document over the bar; the others are merged, and only a document that could
    pass with all that was put aside is looked up there.
    """
    lists = sorted((shard.lists[t] for t in terms if t in shard.lists), key=lambda x: x[2])
    best: list[tuple[int, int]] = []  # a heap of (score, -place): the worst is first
    bar, done, run = 0, 0, FIRST_RUN
    bounds = np.cumsum([x[2] for x in lists])
    aside = 0
    stream = None
    while True:
        may_rest = int(np.searchsorted(bounds, bar, "right"))  # these lists alone stay at the bar or under it: a later document doesn't pass
        if stream is None or may_rest > aside:
            aside = may_rest
            live = [x[0][np.searchsorted(x[0], done) :] for x in lists[aside:]]
            if not live or not any(len(x) for x in live):
                break
            gain = [x[1][len(x[1]) - len(y) :] for x, y in zip(lists[aside:], live, strict=True)]
            used = np.zeros(len(live), np.int64)
            stream = iter(merged(live))
            held: list[int] = []
        chunk = np.fromiter((*held, *islice(stream, run)), np.int64)
        if not len(chunk):
            break
        more = next(stream, None)
        place = chunk >> CURSOR_BITS
        keep = len(chunk)
        if more is not None and more >> CURSOR_BITS == place[-1]:  # the last document isn't whole yet
            keep = int(np.searchsorted(place, place[-1]))
        held = [*chunk[keep:].tolist(), *([] if more is None else [more])]
        chunk, place = chunk[:keep], place[:keep]
        if keep:
            cursor = chunk & ((1 << CURSOR_BITS) - 1)
            score = np.empty(keep, np.int64)
            for c in np.unique(cursor):  # postings of a cursor come in its own order
                at = np.flatnonzero(cursor == c)
                score[at] = gain[c][used[c] : used[c] + len(at)]
                used[c] += len(at)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            docs, sums = place[first], np.add.reduceat(score, first)
            rest = int(bounds[aside - 1]) if aside else 0
            for x in reversed(lists[:aside]):  # greatest first, as long as what is left could still lift a document
                pass_ = sums + rest > bar
                docs, sums = docs[pass_], sums[pass_]
                at = np.searchsorted(x[0], docs)
                at[at == len(x[0])] = 0
                there = x[0][at] == docs
                sums[there] += x[1][at[there]]
                rest -= x[2]
            pass_ = sums > bar
            docs, sums = docs[pass_], sums[pass_]
            if len(sums) > k:
                top = np.partition(sums, len(sums) - k)[len(sums) - k]
                docs, sums = docs[sums >= top], sums[sums >= top]
            for s, d in zip(sums.tolist(), docs.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -d))
                elif (s, -d) > best[0]:
                    heapq.heapreplace(best, (s, -d))
            bar = best[0][0] if len(best) == k else 0
            done = int(place[-1]) + 1
        run = min(2 * run, LONGEST_RUN) if keep else 2 * run
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _searcher(sent, k: int):
    columns = ["query", "missing", "doc_id", "score"]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        queries, weights, n, total = received(sent)
        facts = rows[rows["term"].isna()]
        terms = rows[rows["term"].notna()]
        shard = Shard(facts.iloc[0].to_dict(), dict(zip(terms["term"], terms["postings"], strict=True)), weights, n, total)
        found = [(q, not shard.known[d], int(shard.ids[d]), s) for q, own in queries for s, d in search_shard(shard, own, k)]
        return pd.DataFrame(found, columns=columns).astype({"query": "int64", "missing": bool, "doc_id": "int64", "score": "int64"})

    return search


def query_terms(texts: list[str | None]) -> list[list[str]]:
    """The distinct terms of each text, in order."""
    words = whole_words(pa.array(texts, pa.string()), ALNUM)
    names, which = words.distinct()
    names = [w.decode("utf-8", "replace") for w in names]
    return [[names[i] for i in dict.fromkeys(which[a:b].tolist())] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query with a score above 0; equal scores in ascending order of the id.

    With N documents that have terms, L terms in them, df documents that hold a
    term, and a document of n terms that holds it tf times, a term that a query
    has (once or more) adds w * (1000000000 * tf div (1000 * tf + 8 * m)), where
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 10 + (90 * n * N div L).

    Documents without an id stand after all others of their score; rows of one
    id are ranked one by one, and so are queries of one id.  A query without
    terms, or with none that a document holds, finds nothing.  Queries go in blocks of ``block``, whose
    terms and weights are sent to every task; the documents of a shard are
    bounded, so is what one task holds of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    index = build_index(docs, scratch, id_col, text_col)
    n, total = index.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    own = scratch.keep(queries.select(named(query_id).alias("item_id"), named(query_text).alias("text")), "queries").withColumn("query", F.monotonically_increasing_id())
    out = None
    ids = [r["query"] for r in own.select("query").collect()]  # one number a query
    ids.sort()
    for a in range(0, max(len(ids), 1), block):
        some = own.where(F.col("query").between(ids[a], ids[min(a + block, len(ids)) - 1])) if ids else own
        texts = some.select("query", "text").collect()  # a block of queries
        terms = list(zip([r["query"] for r in texts], query_terms([r["text"] for r in texts]), strict=True))
        every = sorted({t for _, own_terms in terms for t in own_terms})
        wanted = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": every}, dtype="object"), "term string"))
        postings = scratch.keep(index.where("term IS NOT NULL").join(wanted, "term", "left_semi"), "postings")
        held = postings.groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln((F.lit(2.0) * n + 2) / (2.0 * F.col("df") + 1)))
        weights = {r["term"]: r["w"] for r in held.select("term", weight.alias("w")).collect()}  # the terms of a block of queries
        groups = index.where("term IS NULL").select("shard", "term", "postings", "ids", "known", "lengths").unionByName(postings.select("shard", "term", "postings"), allowMissingColumns=True)
        found = groups.groupBy("shard").applyInPandas(_searcher(send(spark, (terms, weights, n, total)), k), "query long, missing boolean, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "missing", "doc_id")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named_best = best.join(own.select("query", "item_id"), "query")
    return named_best.select("item_id", "rank", F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "score")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS MATERIALIZED (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
tf AS MATERIALIZED (
  SELECT doc_id, n, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
w AS MATERIALIZED (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, c GROUP BY t, c.n),
p AS MATERIALIZED (
  SELECT tf.t, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tf.n * c.n) // c.l))) AS s FROM tf JOIN w USING (t), c),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN p USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10
"""
