"""Two-way multiplicative scaling of ratings: rating ~ user factor * item factor.

The least-squares fit of ln(rating) by user and item terms, by alternating
grouped means.  A half sweep after one of the same side changes nothing, so each
step updates one side only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.storage import written
from rankweave.operators import blocks
from rankweave.operators.ranking import top_items

#: Cells of one batch of ``complete_all``.
OUTER_ROWS = 1 << 17

_TERM = {"user": "a", "item": "b"}
_KEY = {"user": "user_id", "item": "item_id"}


def _logs(ratings: DataFrame) -> DataFrame:
    return ratings.where("rating > 0").select("user_id", "item_id", F.ln("rating").alias("y"))


def _half(logs: DataFrame, side: str, other: DataFrame | None) -> DataFrame:
    """New terms of one side given the other's (zero where it has none yet)."""
    key, value = _KEY[side], _TERM[side]
    if other is None:
        return logs.groupBy(key).agg(F.avg("y").alias(value))
    far = "item" if side == "user" else "user"
    return logs.join(other, _KEY[far]).groupBy(key).agg(F.avg(F.col("y") - F.col(_TERM[far])).alias(value))


@dataclass
class Fit:
    """Log factors of users (user_id, a) and items (item_id, b) with ratings; what has none has factor 1."""

    users: DataFrame
    items: DataFrame
    steps: int
    converged: bool


def fit_sweeps(ratings: DataFrame, sweeps: int = 4, first_side: str = "item") -> Fit:
    """A fixed number of sweeps, as one lazy plan."""
    logs = _logs(ratings)
    second = "user" if first_side == "item" else "item"
    one: DataFrame | None = None
    two: DataFrame | None = None
    for _ in range(sweeps):
        one = _half(logs, first_side, two)
        two = _half(logs, second, one)
    users, items = (two, one) if first_side == "item" else (one, two)
    return Fit(users, items, sweeps, False)


def fit_until(ratings: DataFrame, epsilon: float = 1e-9, first_side: str = "item", max_steps: int = 200) -> Fit:
    """Sweep until the squared changes of a step fall under ``epsilon``; the terms of each half sweep are written.

    The first step changes both sides, every later one the side that did not
    come last.
    """
    logs = written(_logs(ratings), "logs")
    order = ["item", "user"] if first_side == "item" else ["user", "item"]
    terms: dict[str, DataFrame] = {}
    error, steps = 0.0, 0
    for side in order:
        terms[side] = written(_half(logs, side, terms.get(order[0]) if side != order[0] else None), f"{side}-terms")
        error += terms[side].agg(F.coalesce(F.sum(F.pow(_TERM[side], F.lit(2))), F.lit(0.0))).first()[0]
    steps, turn = 1, 0
    while error >= epsilon and steps < max_steps:
        side = order[turn % 2]
        new = written(_half(logs, side, terms[order[(turn + 1) % 2]]), f"{side}-terms")
        old = terms[side].withColumnRenamed(_TERM[side], "old")
        error = new.join(old, _KEY[side]).agg(F.coalesce(F.sum(F.pow(F.col(_TERM[side]) - F.col("old"), F.lit(2))), F.lit(0.0))).first()[0]
        terms[side] = new
        steps, turn = steps + 1, turn + 1
    return Fit(terms["user"], terms["item"], steps, error < epsilon)


def factors(fit: Fit) -> tuple[DataFrame, DataFrame]:
    """(user_id, factor) and (item_id, factor)."""
    return fit.users.select("user_id", F.exp("a").alias("factor")), fit.items.select("item_id", F.exp("b").alias("factor"))


def residuals(ratings: DataFrame, fit: Fit) -> DataFrame:
    """What the factors leave of each rating: rating = user factor * residual * item factor."""
    rows = ratings.where("rating > 0").join(fit.users, "user_id").join(fit.items, "item_id")
    return rows.select("user_id", "item_id", "rating", F.exp(F.ln("rating") - F.col("a") - F.col("b")).alias("residual"))


def score_cells(cells: DataFrame, fit: Fit) -> DataFrame:
    """Adds ``score`` = user factor * item factor to rows with user_id and item_id; unseen users and items have factor 1."""
    joined = cells.join(fit.users, "user_id", "left").join(fit.items, "item_id", "left")
    return joined.withColumn("score", F.exp(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)))).drop("a", "b")


def complete(cells: DataFrame, ratings: DataFrame, fit: Fit) -> DataFrame:
    """Values of cells (user_id, item_id): the rating where there is one, else the product of factors."""
    known = ratings.where("rating > 0").select("user_id", "item_id", "rating")
    return score_cells(cells, fit).join(known, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("rating", "score").alias("value"))


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of all cells of a block of users and a block of items: products of factors, known ratings in their places."""
    for batch in batches:
        for i in range(batch.num_rows):
            ub, ib, users, items = (batch[c][i].as_py() for c in ("ub", "ib", "us", "its"))
            a, b = (np.array([x["term"] for x in own]) for own in (users, items))
            value = np.exp(a[:, None] + b[None, :])
            if batch["users"][i].is_valid:
                near, far = (np.frombuffer(batch[c][i].as_py(), "<i4") for c in ("users", "items"))
                value[near, far] = np.frombuffer(batch["values"][i].as_py())
            ids = np.array([x["id"] for x in items], np.int64)
            step = max(1, OUTER_ROWS // len(ids))
            for at in range(0, len(users), step):
                own = np.array([x["id"] for x in users[at : at + step]], np.int64)
                n = len(own) * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ub, np.int32)), pa.array(np.full(n, ib, np.int32)), pa.array(np.repeat(own, len(ids))), pa.array(np.tile(ids, len(own))), pa.array(value[at : at + step].ravel())],
                    names=["user_block", "item_block", "user_id", "item_id", "value"],
                )


def complete_all(ratings: DataFrame, fit: Fit) -> DataFrame:
    """(user_block, item_block, user_id, item_id, value) of every user and item with a rating: the rating where there is one, else the product of factors.

    Users and items are packed in blocks of a bounded size, which meet on the
    grid of their numbers by equi-joins; known ratings, compressed by the same
    grid, are put in inside each block.  A pair may be rated once.
    """
    m = blocks.blocked(ratings.where("rating > 0").select("user_id", "item_id", "rating"))
    number = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias(name)

    def packed(ids: DataFrame, terms: DataFrame, key: str, term: str, size: int, block: str, name: str) -> DataFrame:
        own = ids.join(terms, key, "left").select(F.expr(f"int({key[:4]}_idx div {size})").alias(block), F.struct(F.col(f"{key[:4]}_idx").alias("place"), F.col(key).alias("id"), F.coalesce(term, F.lit(0.0)).alias("term")).alias("x"))
        return own.groupBy(block).agg(F.array_sort(F.collect_list("x")).alias(name))  # size at most

    users = packed(m.users, fit.users, "user_id", "a", blocks.USER_BLOCK, "ub", "us")
    items = packed(m.items, fit.items, "item_id", "b", blocks.ITEM_BLOCK, "ib", "its")
    grid = users.select("ub", "us", number("ib", -(-m.n_items // blocks.ITEM_BLOCK))).join(items, "ib")
    met = grid.join(m.cells, ["ub", "ib"], "left").select("ub", "ib", "us", "its", "users", "items", "values")
    return met.mapInArrow(_outer, "user_block int, item_block int, user_id long, item_id long, value double")


def completed_sums(ratings: DataFrame, fit: Fit) -> DataFrame:
    """(user_id, n, total, greatest) of ``complete_all`` by user, without its cells.

    A user's products of factors add up to the user's factor times the sum of
    all items' factors, and known ratings replace their own products in it.
    The greatest product is that of the first unrated item in order of the factor.
    """
    users, items = written(fit.users, "user-terms"), written(fit.items, "item-terms")
    n, whole = items.agg(F.count("*"), F.coalesce(F.sum(F.exp("b")), F.lit(0.0))).first()
    known = ratings.where("rating > 0").select("user_id", "item_id", "rating")
    changed = known.join(items, "item_id").join(users, "user_id").groupBy("user_id").agg(F.sum(F.col("rating") - F.exp(F.col("a") + F.col("b"))).alias("change"), F.max("rating").alias("rated"))
    first = top_items(items.select("item_id", F.col("b").alias("score")), known, 1).select("user_id", "score")
    rows = users.join(changed, "user_id", "left").join(first, "user_id", "left")
    return rows.select(
        "user_id", F.lit(n).cast("long").alias("n"), (F.exp("a") * F.lit(whole) + F.coalesce("change", F.lit(0.0))).alias("total"),
        F.greatest("rated", F.exp(F.col("a") + F.col("score"))).alias("greatest"),
    )


def write_completed(ratings: DataFrame, fit: Fit, path: str) -> None:
    """``complete_all`` as Parquet, partitioned by the grid, so that a block of users or items is read alone."""
    complete_all(ratings, fit).write.partitionBy("user_block", "item_block").parquet(path)
