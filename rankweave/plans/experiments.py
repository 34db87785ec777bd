"""The whole experiments: ranking, long tail, strong and subtle pairs, and the sweep over numbers of components."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.measures import measured
from rankweave.functions.storage import written
from rankweave.operators import filters, ranking, sampling, scaling, scoring, stats, svd

log = logging.getLogger(__name__)
_OWN = ["user_id", "item_id", "rating"]
#: Sets whose pair scores are strict about predicted ties, and those that are lenient.
POLICIES = {"ML-100K": "strict", "ML-1M": "strict", "Douban_monti": "strict", "ML-20M": "lenient", "Netflix": "lenient"}


def _long(rows: DataFrame, method: str, columns: list[str], suffix: str = "") -> DataFrame:
    """One row of metrics as (method, metric, value)."""
    pairs = F.array(*(F.struct(F.lit(f"{c}{suffix}").alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))
    return rows.select(F.lit(method).alias("method"), F.explode(pairs).alias("x")).select("method", "x.metric", "x.value")


def run_ranking(ratings: DataFrame, ks=(5, 10, 20), threshold: float = 4.0, test_ratio: float = 0.2, seed: int = 42, epsilon: float = 1e-9, first_side: str = "item") -> tuple[DataFrame, DataFrame]:
    """Holdout, fit, lists over all items, metrics at every k and the global rank distance.

    Returns (metrics, per_user): (method, metric, value), the seconds of fit and lists (of the run, and of all tasks) and the peak memory of a stage among them, and a row for each user and k.  Failures are raised.
    """
    both = written(sampling.holdout(ratings.select(*_OWN), test_ratio, 5, threshold, seed), "split")
    train, test = both.where("NOT is_test").select(*_OWN), both.where("is_test").select(*_OWN)
    spark = ratings.sparkSession
    with measured(spark, "train") as training:
        fit = scaling.fit_until(train, epsilon, first_side)
    log.info("fitted in %d steps (converged: %s), %.1f s", fit.steps, fit.converged, training.seconds)
    items = both.select("item_id").distinct().join(fit.items, "item_id", "left").select("item_id", F.coalesce("b", F.lit(0.0)).alias("score"))
    with measured(spark, "infer") as inferring:
        items = written(items, "item-scores")
        top = written(ranking.top_items(items, train, max(ks)), "lists")
    seconds = {"Train(s)": training.seconds, "Infer(s)": inferring.seconds, "TrainTasks(s)": training.task_seconds, "InferTasks(s)": inferring.task_seconds, "PeakMemory(MB)": max(training.peak_mb, inferring.peak_mb)}
    metrics, users = None, None
    for k in ks:
        own = ranking.ranking_metrics(top, test, k).withColumn("k", F.lit(k))
        users = own if users is None else users.unionByName(own)
    users = written(users, "per-user")
    for k in ks:
        one = _long(ranking.macro(users.where(F.col("k") == k)), "UC", ["precision", "recall", "ndcg"], f"@{k}")
        metrics = one if metrics is None else metrics.unionByName(one)
    order = ranking.kendall(both.select(*_OWN).join(items, "item_id"))
    times = order.sparkSession.range(1).select(*(F.lit(x).alias(c) for c, x in seconds.items()))
    return metrics.unionByName(_long(order, "UC", ["concordant", "discordant", "ties", "distance"])).unionByName(_long(times, "UC", list(seconds))), users


def _pair_metrics(train: DataFrame, test: DataFrame, policy: str, epsilon: float, seed: int, method: str) -> DataFrame:
    train, test = written(train.select(*_OWN), "train"), written(test.select(*_OWN), "test")
    fit = scaling.fit_until(train, epsilon, first_side="user")
    scored = test.join(fit.items, "item_id").select(*_OWN, F.col("b").alias("score"))
    scores = written(scoring.pair_scores(scored, policy), "pair-scores")
    plain = _long(stats.macro_stats(scores, "contradicts"), method, ["n", "mean", "std_error"])
    again = _long(stats.bootstrap(scores, "contradicts", 1000, seed), method, ["mean", "low", "high"], "_bootstrap")
    return plain.unionByName(again)


def run_long_tail(ratings: DataFrame, policy: str = "strict", starts=(1.0, 4.0), share: float = 0.33, seed: int = 42, epsilon: float = 1e-9) -> DataFrame:
    """Pairs of long-tail items that a user rated ``start`` and 5, for users with all levels; train is all the rest."""
    own = written(ratings.select(*_OWN), "ratings")
    tail = written(filters.long_tail(own, share), "tail")
    out = None
    for start in starts:
        train, test = sampling.long_tail_pairs(own, tail, (start, 5.0), seed)
        one = _pair_metrics(train, test, policy, epsilon, seed, f"long_tail_{start:g}_5")
        out = one if out is None else out.unionByName(one)
    return out


def run_strong_and_subtle(ratings: DataFrame, policy: str = "strict", starts=(1.0, 4.0), seed: int = 42, epsilon: float = 1e-9) -> DataFrame:
    """Pairs of levels 1 and 5 (strong) and 4 and 5 (subtle) of users with all levels; train has only their ratings."""
    own = written(ratings.select(*_OWN), "ratings")
    out = None
    for start in starts:
        train, test = sampling.qualified_pairs(own, (start, 5.0), seed, dense=policy == "strict")
        one = _pair_metrics(train, test, policy, epsilon, seed, f"strong_and_subtle_{start:g}_5")
        out = one if out is None else out.unionByName(one)
    return out


def run_sweep(ratings: DataFrame, ks: list[int], tops: tuple[int, ...] = (10, 20), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, best): error and ndcg of truncated SVD for each k, and the k that is best by each.

    ``Time(s)`` of a k has the seconds of all it needs of the one decomposition
    and its errors, and the task seconds of the lists up to that k; the run's
    seconds, task seconds and peak memory stand in columns of their own.
    """
    with measured(ratings.sparkSession, "sweep") as whole:
        both = written(sampling.holdout(ratings.select(*_OWN), 0.2, 5, 1.0, seed), "split")
        rows = written(svd.sweep(both.where("NOT is_test").select(*_OWN), both.where("is_test").select(*_OWN), ks, tops), "sweep")
    lists = rows.agg(F.sum("seconds")).first()[0] or 0.0
    fixed = max(0.0, whole.task_seconds - lists)  # the decomposition and the errors
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each k
    timed = rows.withColumn("Time(s)", F.lit(fixed) + F.sum("seconds").over(upto)).drop("seconds")
    run = {"sweep_s": whole.seconds, "sweep_task_s": whole.task_seconds, "peak_mb": whole.peak_mb}
    return timed.withColumns({c: F.lit(x) for c, x in run.items()}), stats.best_k(rows.drop("seconds"))
