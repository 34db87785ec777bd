"""Near-duplicate groups by HyperMinHash registers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.scratch import Scratch, lean
from rankweave.llm.words import NOT_SPACE, SMALL_PIECE, Words, mix, run_hash, split_words, whole_words

BANDS, ROWS = 44, 8
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Most ids that are sent to every executor to pick out the texts of candidates; more are shuffled.
BROADCAST_IDS = 1_000_000
#: A key that holds more than this share of the rows is split, or its partner sent to all; there are at most as many such keys as shares.
HOT_SHARES = 1000
#: Tries to fill an empty register from a random other one, before the next one to the right is taken.
FILL_TRIES = 64

_BUCKET_MIX = np.uint64(0xD6E8FEB86659FD93)
_FILL = np.stack([(mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(t * 1_000_003 + 1)) % np.uint64(REGISTERS)).astype(np.int64) for t in range(FILL_TRIES)])


def shingle_sets(words, count: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of the rows of a piece, by row and hash: hashes, their rows, and where each row begins.

    A row of fewer words, but not none, has its whole sequence as its only shingle.
    """
    at, hashes = words.grams(k)
    rows = words.rows[at]
    sizes = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(sizes == n)
        hashes = np.concatenate([hashes, run_hash(words.hashes, words.first[short], n)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    again = np.flatnonzero(~new)  # only runs of k words can repeat in a row
    if not all(words.same(at[order[again]] + j, at[order[again - 1]] + j).all() for j in range(k)):
        return _apart(words, at, k, hashes, rows, order, count)
    hashes, rows = hashes[new], rows[new]
    return hashes, rows, np.searchsorted(rows, np.arange(count + 1))


def _apart(words: Words, at: np.ndarray, k: int, hashes: np.ndarray, rows: np.ndarray, order: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_sets`` where different shingles of a row share a hash: repeated hashes give way to longer ones of the words themselves."""
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    group = np.cumsum(new) - 1
    for i in np.flatnonzero(np.bincount(group)[group] > 1).tolist():
        hashes[i] = int.from_bytes(hashlib.sha256(words.text(int(at[order[i]]), k)).digest()[:8], "little")
    found = np.unique(np.rec.fromarrays([rows, hashes], names="row,hash"))
    rows, hashes = np.ascontiguousarray(found["row"]), np.ascontiguousarray(found["hash"])
    return hashes, rows, np.searchsorted(rows, np.arange(count + 1))


def exact_sets(words: Words, count: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows as numbers that stand for their words themselves: rows and numbers, in order."""
    names, which = words.distinct()
    at, _ = words.grams(k)
    sizes = np.diff(words.first)
    owners, numbers, used = [], [], 0
    for n, starts in [(k, at), *((n, words.first[np.flatnonzero(sizes == n)]) for n in range(1, k))]:
        run = which[starts]
        for j in range(1, n):
            run = np.unique(run * len(names) + which[starts + j], return_inverse=True)[1]
        owners.append(words.rows[starts])
        numbers.append(run + used)
        used += int(run.max()) + 1 if len(run) else 0
    owner, number = np.concatenate(owners), np.concatenate(numbers)
    key = np.unique(owner * max(1, used) + number)
    return key // max(1, used), key % max(1, used)


def registers(hashes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers of each row's set (sorted by row and hash), as 16-bit numbers.

    The upper half of a hash picks a bucket; of the bucket's least second hash
    a register keeps the number of leading zeros (6 bits) and the bits after
    the first one.  Empty buckets take over registers of others, chosen by hash,
    so that two registers agree about as often as the sets overlap, for small
    sets too.
    """
    out = np.zeros((count, REGISTERS), np.uint16)
    if not len(hashes):
        return out
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    cell = rows.astype(np.int64) * REGISTERS + bucket.astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    least = np.minimum.reduceat(mix(hashes ^ _BUCKET_MIX), begins)
    least = np.maximum(least, np.uint64(1))
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))  # exact: 53 bits
    zeros = (53 - exponent).astype(np.uint64)
    after = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    value = ((zeros << np.uint64(MANTISSA_BITS)) | after).astype(np.int64) + 1
    flat = np.zeros(count * REGISTERS, np.int64)
    flat[cell[begins]] = value
    own = flat.reshape(count, REGISTERS)
    filled = own.copy()
    todo = np.flatnonzero((own == 0).any(1) & (own > 0).any(1))
    for t in range(FILL_TRIES):
        if not len(todo):
            break
        part, other = filled[todo], own[todo][:, _FILL[t]]
        filled[todo] = np.where(part == 0, other, part)
        todo = todo[(filled[todo] == 0).any(1)]
    for r in todo:
        have = np.flatnonzero(own[r])
        gaps = np.flatnonzero(filled[r] == 0)
        filled[r, gaps] = own[r, have[np.searchsorted(have, gaps) % len(have)]]
    return filled.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of ROWS registers."""
    parts = np.ascontiguousarray(regs).reshape(len(regs), BANDS, ROWS).view(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(parts.shape[2]):
        total = mix(total ^ parts[:, :, j]) + np.uint64(j)
    return total


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less the share that agrees by chance.

    The share for disjoint sets of n and m elements is the HyperMinHash paper's
    0.1699 * 2**-bits * 4nm / (n + m)**2.
    """
    chance = 0.1699 / (1 << MANTISSA_BITS) * 4 * n_a * n_b / np.maximum(1.0, (n_a + n_b)) ** 2
    return ((a == b).mean(1) - chance) / (1 - chance)


def _digests(words: Words) -> pa.Array:
    """SHA-256 of each row's words, joined by single spaces."""
    return pa.array([hashlib.sha256(x).digest() for x in words.normal()], pa.binary())


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, count, words in split_words(batch["text"], NOT_SPACE, piece=SMALL_PIECE):
            part = batch.slice(row, count)
            yield pa.RecordBatch.from_arrays([part["doc_id"], _digests(words), part["text"]], names=["least", "digest", "text"])


def _sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, count, words in split_words(batch["text"], NOT_SPACE, piece=SMALL_PIECE):
                hashes, rows, first = shingle_sets(words, count, k)
                regs = registers(hashes, rows, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, count),
                        pa.array(np.diff(first).astype(np.int64)),
                        _digests(words),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), count, [None, pa.py_buffer(np.ascontiguousarray(regs))]).cast(pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "registers"],
                )

    return sketch


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            keys = band_keys(_as_registers(part["registers"]))
            ids = np.repeat(part["id"].to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _verifier(k: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            likely = estimate(_as_registers(batch["registers_a"]), _as_registers(batch["registers_b"]), n_a.astype(float), n_b.astype(float))
            share = percent / 100
            spread = np.sqrt(share * (1 - share) / np.minimum(REGISTERS, np.maximum(1, np.maximum(n_a, n_b))))
            rows = np.flatnonzero(likely >= share - 6 * spread)
            ok = np.zeros(batch.num_rows, dtype=bool)
            some = batch.take(pa.array(rows))
            size = np.cumsum(pc.add(pc.binary_length(some["text_a"]), pc.binary_length(some["text_b"])).to_numpy(zero_copy_only=False)) if len(rows) else rows
            at = 0
            while at < len(rows):  # as many pairs as make a piece
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SMALL_PIECE, "right")))
                ok[rows[at:end]] = linked(some["text_a"].slice(at, end - at), some["text_b"].slice(at, end - at), k, percent)
                at = end
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ok)], names=["a", "b", "linked"])

    return verify


def linked(a: pa.Array, b: pa.Array, k: int, percent: int) -> np.ndarray:
    """Which pairs of texts reach the similarity, by the words themselves."""
    n = len(a)
    rows, numbers = exact_sets(whole_words(pa.concat_arrays([a, b]), NOT_SPACE), 2 * n, k)
    sizes = np.bincount(rows, minlength=2 * n)
    order = np.lexsort((numbers, rows % n))
    pair, numbers = rows[order] % n, numbers[order]
    both = (pair[1:] == pair[:-1]) & (numbers[1:] == numbers[:-1])
    common = np.bincount(pair[1:][both], minlength=n)
    return (common > 0) & (100 * common >= percent * (sizes[:n] + sizes[n:] - common))


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    k: int = 5,
    percent: int = 80,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """Groups of documents whose sets of k-word shingles overlap by ``percent`` or more, directly or through others.

    Returns, for every row: doc_id, n_shingles (distinct ones), component_id
    (smallest id of its group) and kept (doc_id = component_id).

    1. Rows with equal word sequences (by SHA-256) form a class, and one row of
       it goes on.
    2. Band keys of registers give buckets.  With 44 bands of 8, a pair at a
       similarity of 0.85 (0.8) shares none with a chance of 1e-6 (3e-4).
    3. Every class meets the most central one of its buckets; links are confirmed
       on full sets of the words themselves, after the estimate has ruled out
       what cannot be one.
    4. Where a bucket still holds different groups, its members meet again by
       their rarest shingles, with the filters of exact set joins, which lose no
       link.  So a large group costs about one comparison a member, and only
       pairs that can be links are made.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text
    with fewer than k words has its word sequence as its only shingle; a null
    text, or one without words, has none and is linked with nothing.  Rows of
    one id are one document with the links of all of them.  A row with a null
    id takes no part: its component is null and it is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sketches = scratch.keep(texts.mapInArrow(lean(_sketcher(k)), "doc_id long, n long, digest binary, registers binary"), "sketches")
    whole = sketches.where("n > 0 AND doc_id IS NOT NULL")
    # the smallest id names a class, unless an id in several rows can be the smallest of several classes
    repeated = not whole.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = whole.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id() if repeated else F.col("least")), "classes")

    banded = classes.select("id", "registers").mapInArrow(lean(_bander), "key long, id long")
    shared = scratch.keep(banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size"), "shared")
    members = scratch.keep(banded.join(shared, "key").select("key", "id", "size"), "members")

    out = sketches.drop("registers").join(classes.select("digest", "id", "least"), "digest", "left").select("doc_id", "n", "id", "least")
    out = scratch.keep(out, "rows")
    # rows of one id with different texts are in several classes, which belong together
    several = out.where("doc_id IS NOT NULL AND id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    same = out.join(several.select("doc_id", "a"), "doc_id").where("a < id").select("a", F.col("id").alias("b")).distinct()
    groups = _groups(members, classes, texts, same, scratch, k, percent, broadcast_ids, repeated)
    if repeated:  # from numbers of classes to the smallest id of each group
        placed = classes.select("id", "least").join(groups, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("group"), "least")
        placed = scratch.keep(placed, "placed")
        groups = placed.select("node", "group").join(placed.groupBy("group").agg(F.min("least").alias("component")), "group").select("node", "component")
    out = out.join(groups, out["id"] == groups["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "least", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _groups(members, classes, texts, same, scratch: Scratch, k: int, percent: int, broadcast_ids: int, repeated: bool) -> DataFrame:
    """Component of every class that is linked to a smaller one, as (node, component)."""
    spark = scratch.spark
    wanted = scratch.keep(members.select("id").distinct(), "wanted")
    picked = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    if repeated:  # one text of each class, picked by its fingerprint
        chosen = scratch.keep(classes.join(picked, "id", "left_semi"), "chosen")
        ids = chosen.select("least").distinct()
        ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
        own = texts.join(ids, F.col("doc_id") == F.col("least"), "left_semi").mapInArrow(lean(_marker), "least long, digest binary, text string")
        own = own.groupBy("least", "digest").agg(F.first("text").alias("text"))
        sets = chosen.join(own, ["least", "digest"]).select("id", "n", "registers", "text")
    else:
        own = texts.join(picked, texts["doc_id"] == wanted["id"], "left_semi")
        sets = classes.join(picked, "id", "left_semi").select("id", "n", "registers").join(own, F.col("id") == F.col("doc_id")).drop("doc_id")
    sets = scratch.keep(sets, "sets")

    def check(pairs: DataFrame) -> DataFrame:
        """Verify pairs (a < b)."""
        sizes = sets.select("id", "n")
        fit = (
            pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("x")), "a")
            .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("y")), "b")
            .where(F.least("x", "y") * 100 >= F.greatest("x", "y") * percent)
            .select("a", "b").distinct()
        )
        fit = scratch.keep(fit, "fit")
        most = max(256, fit.count() // HOT_SHARES)
        degree = fit.select("a").unionAll(fit.select("b")).groupBy("a").count().where(F.col("count") > most)
        hot = F.broadcast(degree.select(F.col("a").alias("hot"), F.ceil(F.col("count") / most).cast("int").alias("parts")))  # 2 * HOT_SHARES rows at most
        parts = F.coalesce("parts", F.lit(1))
        for x, y in ("ab", "ba"):
            fit = fit.join(hot, F.col(x) == F.col("hot"), "left").withColumns({f"slot_{x}": F.pmod(F.xxhash64(y), parts), f"hot_{x}": F.col("hot").isNotNull()}).drop("hot", "parts")
        # a text that many pairs share is met last, in parts, so that it isn't copied before the pairs are dealt
        late = F.col("hot_a") & ~F.col("hot_b")
        side = lambda c, x, y: F.when(late, F.col(c + y)).otherwise(F.col(c + x))
        full = fit.select("a", "b", *(side(c, x, y).alias(f"{name}_{x}") for c, name in (("", "id"), ("slot_", "slot")) for x, y in ("ab", "ba")))
        dealt = sets.join(hot, F.col("id") == F.col("hot"), "left").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("hot", "parts")
        for x in "ab":
            full = full.join(dealt.toDF(*(f"{c}_{x}" for c in dealt.columns)), [f"id_{x}", f"slot_{x}"]).drop(f"id_{x}", f"slot_{x}")
        return full.mapInArrow(lean(_verifier(k, percent)), "a long, b long, linked boolean")

    # the member of a bucket whose own buckets are the fullest has least of its own, so most others link to it
    central = members.groupBy("id").agg(F.sum("size").alias("rank"))
    ranked = scratch.keep(members.join(central, "id"), "ranked")
    centres = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("minus"))).alias("top"))
    first = (
        ranked.join(centres, "key").groupBy("id").agg(F.max("top").alias("top"))
        .select("id", (-F.col("top.minus")).alias("centre")).where("id != centre")
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    )
    tried = scratch.keep(check(first), "tried")
    links = tried.where("linked").select("a", "b").unionByName(same)
    groups = components(links, scratch) if not links.isEmpty() else spark.createDataFrame([], "node long, component long")
    placed = members.select("key", "id").join(groups, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_ = scratch.keep(placed.join(mixed, "key").select("id", "component").distinct(), "open")
    if open_.isEmpty():
        return groups
    pairs = scratch.keep(_rare_pairs(open_.join(sets, "id"), scratch, k, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = scratch.keep(check(pairs).where("linked").select("a", "b"), "more")
    if more.isEmpty():
        return groups
    return components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)


def _rare_pairs(docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """All pairs (a < b) of different components that can still be linked, and few others.

    Of two linked sets, each ordered by how many of ``docs`` hold a shingle, the
    first ones (n less percent of n, plus 1) share a member, and the places of
    the first shared one leave room for the overlap (prefix and position
    filters).  Shingles that a document alone has come first, so documents
    with too many of their own drop out before they meet anything.
    """
    held = docs.select("id", "component", "n", "text").mapInArrow(lean(_lister(k)), "id long, component long, n long, h long")
    held = scratch.keep(held, "shingles")
    often = scratch.keep(held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    most = max(64, held.count() // HOT_SHARES)
    usual = often.where(F.col("df") > most).select("h", F.col("df").alias("hot_df"))  # HOT_SHARES rows at most
    told = held.join(F.broadcast(usual), "h", "left")
    told = told.where("hot_df IS NULL").drop("hot_df").join(often.where(F.col("df") <= most), "h", "left").unionByName(told.where("hot_df IS NOT NULL").withColumnRenamed("hot_df", "df"))
    ordered = (
        told
        .groupBy("id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("all"))
        .select("id", "component", "n", F.posexplode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))))
        .where("col.df > 1")
    )
    # an overlap of at most n - pos must make (100 + percent) * overlap >= percent * (n + other n)
    most = F.floor(F.lit(100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n")
    posted = scratch.keep(ordered.select(F.col("col.h").alias("h"), "id", "component", "n", most.alias("most")), "postings")
    for _ in range(2):  # leave out what finds no partner of a fitting size, then what has partners of its own component alone
        span = posted.groupBy("h").agg(F.min("n").alias("least"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h", "least")
        posted = scratch.keep(posted.join(span, "h").where("least <= most").select("h", "id", "component", "n", "most"), "postings")
    a, b = posted.alias("a"), posted.alias("b")
    fits = (
        (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
        & (F.col("a.n") <= F.col("b.most")) & (F.col("b.n") <= F.col("a.most"))
        & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
    )
    return a.join(b, fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _lister(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, count, words in split_words(batch["text"], NOT_SPACE, piece=SMALL_PIECE):
                hashes, owner, _ = shingle_sets(words, count, k)
                part = batch.slice(row, count)
                columns = [part[c].take(pa.array(owner)) for c in ("id", "component", "n")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes.view(np.int64))], names=["id", "component", "n", "h"])

    return rows


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM w, unnest(range(1, greatest(2, len(w) - 1))) AS t(i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT sym.b, r.comp FROM r JOIN sym ON sym.a = r.node),
g AS (SELECT node, min(comp) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN c USING (doc_id) JOIN g ON g.node = w.doc_id
"""
