"""``python -m rankweave.plans.cli --experiment ranking --dataset ML-1M --data_path ...``"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession

from rankweave.functions.storage import written
from rankweave.plans import experiments
from rankweave.sources import ratings as sources
from rankweave.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--experiment", choices=["strong_and_subtle", "long_tail", "ranking", "sweep"], required=True)
    p.add_argument("--dataset", required=True, help=", ".join(sources.READERS))
    p.add_argument("--data_path", help="folder of the set; default: its entry in --paths, else data")
    p.add_argument("--paths", default="paths.json", help="JSON object of folders by dataset")
    p.add_argument("--out", default="results")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--ks", type=int, nargs="+")
    return p


def data_path(args: argparse.Namespace) -> str:
    if args.data_path:
        return args.data_path
    return sources.load_config(args.paths).get(args.dataset, "data") if os.path.exists(args.paths) else "data"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("rankweave").getOrCreate()
    ratings = sources.load_ratings(spark, args.dataset, data_path(args), sources.ON_DUPLICATE.get(args.dataset))
    os.makedirs(args.out, exist_ok=True)
    policy = experiments.POLICIES[args.dataset]
    if args.experiment == "ranking":
        metrics, users = experiments.run_ranking(ratings, tuple(args.ks or (5, 10, 20)), seed=args.seed)
        sinks.write_summary(metrics, f"{args.out}/ranking_{args.dataset}_seed{args.seed}.csv")
        sinks.write_details(users, f"{args.out}/ranking_{args.dataset}_seed{args.seed}_users")
    elif args.experiment == "sweep":
        rows, best = experiments.run_sweep(ratings, args.ks or list(range(1, 101, 2)), seed=args.seed)
        rows.orderBy("k").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args.out}/sweep_{args.dataset}.csv")
        best.show()
        return
    else:
        run = experiments.run_long_tail if args.experiment == "long_tail" else experiments.run_strong_and_subtle
        metrics = written(run(ratings, policy, seed=args.seed), "metrics")
        for start in (1, 4):  # one file for each pair of levels
            own = metrics.where(metrics["method"].endswith(f"_{start}_5"))
            sinks.write_json(own, f"{args.out}/{sinks.result_name(args.experiment, [start, 5], args.dataset, args.seed)}")
    metrics.show(100, truncate=False)


if __name__ == "__main__":
    main()
