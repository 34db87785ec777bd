"""Explicit ratings as (user_id LONG, item_id LONG, rating DOUBLE, ts LONG)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.sources.files import listed
from rankweave.sources.matrix import read_matrix_ratings
from rankweave.sources.rating_blocks import read_blocks

_RAW = "user_id long, item_id long, rating double, ts long"


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str, header: bool = False) -> DataFrame:
    """Rows of user, item, rating, time in this order, whatever their names."""
    return spark.read.schema(_RAW).option("sep", sep).option("header", header).option("enforceSchema", True).csv(paths)


def read_ml100k(spark: SparkSession, folder: str) -> DataFrame:
    """Both files of the published first split, one after the other."""
    return read_delimited(spark, [f"{folder}/movielens_100k_u1.base", f"{folder}/movielens_100k_u1.test"], "\t")


def read_ml100k_split(spark: SparkSession, folder: str) -> DataFrame:
    """The published split kept apart, in a column ``part`` (train or test)."""
    parts = [read_delimited(spark, f"{folder}/movielens_100k_u1.{end}", "\t").withColumn("part", F.lit(name)) for end, name in (("base", "train"), ("test", "test"))]
    return parts[0].unionByName(parts[1])


def read_ml1m(spark: SparkSession, folder: str) -> DataFrame:
    return read_delimited(spark, f"{folder}/movielens_1m_dataset.dat", "::")


def read_ml20m(spark: SparkSession, folder: str) -> DataFrame:
    return read_delimited(spark, f"{folder}/ratings.csv", ",", header=True)


def read_triples(spark: SparkSession, folder: str, swap_axes: bool = False) -> DataFrame:
    """A rating matrix that was exported as Parquet triples (user_id, item_id, rating).

    ``swap_axes`` exchanges users and items, for exports with the axes the other way round.
    """
    rows = spark.read.parquet(folder)
    user, item = ("item_id", "user_id") if swap_axes else ("user_id", "item_id")
    return rows.select(F.col(user).cast("long").alias("user_id"), F.col(item).cast("long").alias("item_id"), F.col("rating").cast("double"), F.lit(None).cast("long").alias("ts"))


def read_douban(spark: SparkSession, folder: str) -> DataFrame:
    """The set's matrix file ``M`` (users x items), a folder of compressed columns, or Parquet triples exported from it."""
    names = {path.rsplit("/", 1)[-1]: path for path, _ in listed(folder)}
    if "douban_monti_dataset.mat" in names:
        return read_matrix_ratings(spark, names["douban_monti_dataset.mat"])
    return read_matrix_ratings(spark, folder) if "jc.npy" in names else read_triples(spark, folder)


def ratings_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate parts: 1 to 5 by quantity, the greatest where a pair occurs again."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    level = (1 + (F.col("l_quantity").cast("long") - 1) % 5).cast("double")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), level.alias("rating"))
    return deduplicate(rows, "max")


def deduplicate(ratings: DataFrame, on_duplicate: str) -> DataFrame:
    """One row for each (user, item): their ``sum``, ``max``, the ``last`` by ts, or an ``error``."""
    key = ratings.groupBy("user_id", "item_id")
    if on_duplicate in ("sum", "max"):
        return key.agg(getattr(F, on_duplicate)("rating").alias("rating"))
    if on_duplicate == "last":
        return key.agg(F.max_by("rating", F.struct("ts", "rating")).alias("rating"))
    if on_duplicate == "error":
        n = F.count("*")
        return key.agg(F.when(n > 1, F.raise_error(F.lit("a pair is rated twice"))).otherwise(F.max("rating")).cast("double").alias("rating"))
    raise ValueError(f"unknown policy {on_duplicate!r}")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ML-100K": read_ml100k,
    "ML-1M": read_ml1m,
    "ML-20M": read_ml20m,
    "Netflix": lambda spark, folder: read_blocks(spark, [f"{folder}/combined_data_2.txt", f"{folder}/combined_data_4.txt"]).drop("source_item_id"),
    "Douban_monti": read_douban,
}


#: How repeated pairs of a set are brought together: the last one by time wins, or they add up.
ON_DUPLICATE = {"ML-100K": "last", "ML-1M": "last", "ML-20M": "sum", "Netflix": "sum"}


def load_ratings(spark: SparkSession, dataset: str, folder: str, on_duplicate: str | None = None) -> DataFrame:
    """Ratings of a known set; zero and missing ratings are no ratings.

    Pairs that are rated again become one row (user_id, item_id, rating) by
    ``on_duplicate`` (see ``deduplicate``; ON_DUPLICATE has what a set's matrix
    is put together by); None keeps all rows and their times.
    """
    if dataset not in READERS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(READERS)}")
    rows = READERS[dataset](spark, folder).where("rating > 0")
    if on_duplicate is None:
        return rows
    return deduplicate(rows, on_duplicate)


def load_config(path: str) -> dict:
    """A JSON file; ``~`` and variables in the path are expanded."""
    with open(os.path.normpath(os.path.expandvars(os.path.expanduser(path))), encoding="utf-8") as f:
        return json.load(f)
