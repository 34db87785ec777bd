"""Splits and samples in the order of a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.hashing import pair_hash
from rankweave.operators.filters import at_least, min_ratings, users_with_both, users_with_levels


def hashed(*partition: str, seed: int = 42):
    return Window.partitionBy(*partition).orderBy(pair_hash("user_id", "item_id", seed), "item_id")


def holdout(ratings: DataFrame, test_ratio: float = 0.2, min_user: int = 5, threshold: float = 4.0, seed: int = 42, min_item: int = 1) -> DataFrame:
    """Positive ratings of users with enough of them, with ``is_test`` for a share of each user's (one at least)."""
    good = min_ratings(at_least(ratings, threshold), "user_id", min_user)
    if min_item > 1:
        good = min_ratings(good, "item_id", min_item)
    n = F.count("*").over(Window.partitionBy("user_id"))
    most = F.greatest(F.lit(1), F.floor(n * F.lit(float(test_ratio))).cast("int"))
    return good.withColumn("is_test", F.row_number().over(hashed("user_id", seed=seed)) <= most)


def one_per_level(ratings: DataFrame, levels: tuple[float, float], seed: int = 42) -> DataFrame:
    """One rating of each level for users who gave both: (user_id, item_id, rating)."""
    low, high = levels
    own = ratings.where(F.col("rating").isin(*levels)).join(users_with_both(ratings, low, high), "user_id", "left_semi")
    return own.withColumn("place", F.row_number().over(hashed("user_id", "rating", seed=seed))).where("place = 1").drop("place")


def qualified_pairs(ratings: DataFrame, levels: tuple[float, float], seed: int = 42, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test) of users who gave all levels 1 to 5: one rating of each of two levels is held out.

    An item that loses its only rating this way is gone, and its test row too.
    """
    own = ratings.join(users_with_levels(ratings, dense=dense), "user_id", "left_semi")
    test = one_per_level(own, levels, seed)
    train = own.join(test, ["user_id", "item_id"], "left_anti")
    return train, test.join(train.select("item_id").distinct(), "item_id", "left_semi").select(*test.columns)


def long_tail_pairs(ratings: DataFrame, tail: DataFrame, levels: tuple[float, float], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): test has two long-tail ratings of each qualified user; train has all other ratings of all users."""
    inside = ratings.join(tail.select("item_id"), "item_id", "left_semi").join(users_with_levels(ratings), "user_id", "left_semi")
    test = one_per_level(inside.select(*ratings.columns), levels, seed)
    train = ratings.join(test, ["user_id", "item_id"], "left_anti")
    return train, test.join(train.select("item_id").distinct(), "item_id", "left_semi").select(*test.columns)
