"""Filters, dictionaries and the long tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.ranges import numbered, running_sum

LEVELS = (1, 2, 3, 4, 5)


def at_least(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    return ratings.where(F.col("rating") >= threshold)


def clean(ratings: DataFrame, threshold: float, min_user: int, min_item: int) -> DataFrame:
    """Threshold, then both degree filters on the same counts (one pass, not until nothing changes)."""
    good = at_least(ratings, threshold)
    users = good.groupBy("user_id").count().where(F.col("count") >= min_user)
    items = good.groupBy("item_id").count().where(F.col("count") >= min_item)
    return good.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi").select(*ratings.columns)


def min_ratings(ratings: DataFrame, key: str, n: int) -> DataFrame:
    own = ratings.groupBy(key).count().where(F.col("count") >= n)
    return ratings.join(own, key, "left_semi").select(*ratings.columns)


def users_with_levels(ratings: DataFrame, levels=LEVELS, dense: bool = False) -> DataFrame:
    """Users who gave every one of ``levels``; with ``dense`` also only those who left some item unrated."""
    own = ratings.groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("rating").isin(*levels), F.col("rating"))).alias("levels"),
        F.count_distinct("item_id").alias("n"),
    )
    own = own.where(F.col("levels") == len(set(levels)))
    if dense:
        # the number of items is one row
        own = own.crossJoin(F.broadcast(ratings.agg(F.count_distinct("item_id").alias("all")))).where("n < all")
    return own.select("user_id")


def rating_pivot(ratings: DataFrame, levels=LEVELS) -> DataFrame:
    """Counts of each level by user, in columns r1, r2, ..."""
    return ratings.groupBy("user_id").agg(*(F.count(F.when(F.col("rating") == v, 1)).alias(f"r{v}") for v in levels))


def users_with_both(ratings: DataFrame, low: float, high: float = 5.0) -> DataFrame:
    own = ratings.groupBy("user_id").agg(F.max(F.col("rating") == low).alias("a"), F.max(F.col("rating") == high).alias("b"))
    return own.where("a AND b").select("user_id")


def popularity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count("*").alias("n_ratings"))


def long_tail(ratings: DataFrame, share: float = 0.33) -> DataFrame:
    """Items beyond the most popular ones that have ``share`` of all ratings: (item_id, n_ratings, cum_share).

    The item that crosses the share is among them.  Ties in popularity stand in
    order of the id.  The running sum goes by ranges of popularity and id (see
    ``ranges``), so that no task sees all items of one count.
    """
    summed = running_sum(popularity(ratings), [F.col("n_ratings").desc(), F.col("item_id")], "n_ratings", "reached", "every")
    return summed.select("item_id", "n_ratings", (F.col("reached").cast("double") / F.col("every")).alias("cum_share")).where(F.col("cum_share") > share)


def dictionary(ratings: DataFrame, key: str, name: str) -> DataFrame:
    """Dense numbers from 0 in order of the id: (key, name)."""
    return numbered(ratings.select(key).distinct(), [key], name)


def indexed(ratings: DataFrame) -> DataFrame:
    """Ratings with user_idx and item_idx."""
    users, items = dictionary(ratings, "user_id", "user_idx"), dictionary(ratings, "item_id", "item_idx")
    return ratings.join(users, "user_id").join(items, "item_id")


def known_items(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose item some train row has."""
    return test.join(train.select("item_id").distinct(), "item_id", "left_semi").select(*test.columns)
