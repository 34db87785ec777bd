"""Summary statistics of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.hashing import PRIME
from rankweave.functions.ranges import numbered
from rankweave.functions.storage import written


def macro_stats(scores: DataFrame, column: str) -> DataFrame:
    """n, mean and the standard error (population deviation over the root of n)."""
    return scores.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        (F.stddev_pop(column) / F.sqrt(F.expr(f"nullif(count({column}), 0)").cast("double"))).alias("std_error"),
    )


#: Distinct scores whose counts a task draws together.
BLOCK = 4096
#: Counts of a resample are looked for within so many deviations (and so many places) of their mean.
DEVIATIONS, PLACES = 12, 10


def uniform(resample: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for every resample, from integer arithmetic that SQL can repeat (cubic, modulo a prime)."""
    u = (resample.astype(np.int64) * 1000003 + (seed * 104729) % PRIME) % PRIME
    return ((u * u % PRIME * u + 12345) % PRIME + 0.5) / PRIME


def binomial_quantiles(n: int, ones: int, u: np.ndarray) -> np.ndarray:
    """The least k whose binomial distribution function (n draws, a share of ones / n) reaches u."""
    if ones in (0, n):
        return np.full(len(u), ones, np.int64)
    p = ones / n
    wide = DEVIATIONS * math.sqrt(n * p * (1 - p)) + PLACES
    low, high = max(0, math.floor(n * p - wide)), min(n, math.ceil(n * p + wide))
    k = np.arange(low + 1, high + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) / k * (p / (1 - p))))])
    reach = np.cumsum(np.exp(logs - logs.max()))
    return low + np.searchsorted(reach / reach[-1], u)


def _two_valued(seed: int):
    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (n, ones, low, high), own in batch.groupby(["n", "ones", "low", "high"], dropna=False):
                k = binomial_quantiles(int(n), int(ones), uniform(own["resample"].to_numpy(), seed))
                yield pd.DataFrame({"mean": low + (high - low) * (k / n)})

    return means


def _block_sums(resamples: int, seed: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, values, counts, drawn = (batch[c][i].as_py() for c in ("block", "values", "counts", "drawn"))
                rng = np.random.default_rng([seed, block])
                share = np.array(counts, float)
                share /= share.sum()
                values = np.array(values)
                total = np.fromiter((rng.multinomial(m, share) @ values for m in drawn), float, resamples)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total)], names=["resample", "total"])

    return sums


def bootstrap(scores: DataFrame, column: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of the means of resamples of as many scores, with replacement; null and NaN scores are left out.

    A resample is a count for each distinct score.  Two distinct scores: the
    count of the greater is a binomial quantile of a hashed uniform number.
    More: the counts of blocks of BLOCK distinct scores are multinomial, and so
    are those inside a block, which a task draws and sums up.  No draw is a row.
    """
    spark = scores.sparkSession
    value = F.col(column).cast("double")
    own = written(scores.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("value")).agg(F.count("*").alias("n")), "histogram")
    facts = own.agg(F.count("*").alias("distinct"), F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("n", "value").alias("ones")).first()
    tries = spark.range(resamples).withColumnRenamed("id", "resample")
    if facts["distinct"] == 0:
        return spark.createDataFrame([(None, None, None)], "mean double, low double, high double").limit(1)
    if facts["distinct"] <= 2:
        rows = tries.select("resample", *(F.lit(facts[c]).alias(c) for c in ("n", "ones", "low", "high")))
        means = rows.mapInPandas(_two_valued(seed), "mean double")
    else:
        place = numbered(own, ["value"], "place")
        packed = written(
            place.groupBy(F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("x"), F.sum("n").alias("size"))
            .select("block", "size", F.col("x.value").alias("values"), F.col("x.n").alias("counts")),
            "score-blocks",
        )  # BLOCK values each
        sizes = packed.select("block", "size").orderBy("block").collect()  # a number for BLOCK distinct scores
        share = np.array([r["size"] for r in sizes], float)
        counts = np.random.default_rng(seed).multinomial(facts["n"], share / share.sum(), size=resamples)
        drawn = spark.createDataFrame([(r["block"], counts[:, i].tolist()) for i, r in enumerate(sizes)], "block long, drawn array<long>")
        totals = packed.join(drawn, "block").mapInArrow(_block_sums(resamples, seed), "resample long, total double")
        means = totals.groupBy("resample").agg((F.sum("total") / facts["n"]).alias("mean"))
    return means.agg(
        F.avg("mean").alias("mean"),
        F.percentile("mean", F.lit(0.025)).alias("low"),
        F.percentile("mean", F.lit(0.975)).alias("high"),
    )


def rmse(scored: DataFrame) -> DataFrame:
    """Root mean squared difference of ``score`` and ``rating``."""
    return scored.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("rating"), F.lit(2)))).alias("rmse"))


def best_k(sweep: DataFrame) -> DataFrame:
    """From rows (k, rmse, ndcg...): the k of the least rmse and of the greatest value of each ndcg column; the smallest k on ties."""
    gains = [c for c in sweep.columns if c.startswith("ndcg")]
    return sweep.agg(
        F.min(F.struct("rmse", "k"))["k"].alias("k_rmse"),
        *((-F.max(F.struct(c, (-F.col("k")).alias("minus")))["minus"]).alias(f"k_{c}") for c in gains),
    )
