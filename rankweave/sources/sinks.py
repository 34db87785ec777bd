"""Writers of results: large tables as Parquet, small summaries as CSV or JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summary(metrics: DataFrame, path: str, order: Iterable[str] | None = None) -> None:
    """Rows (method, metric, value) as one CSV with a column for each metric."""
    wide = metrics.groupBy("method").pivot("metric", list(order) if order else None).agg(F.first("value"))
    wide.orderBy("method").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_details(per_user: DataFrame, path: str) -> None:
    per_user.write.mode("overwrite").parquet(path)


def write_json(metrics: DataFrame, path: str) -> None:
    """Aggregates (method, metric, value) as nested JSON with an indent of 4, replacing the file."""
    nested: dict[str, dict[str, float]] = {}
    for row in metrics.orderBy("method", "metric").toLocalIterator():
        nested.setdefault(row["method"], {})[row["metric"]] = row["value"]
    save_json(path, nested)


def save_json(path: str, data: object) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=4)


def result_name(experiment: str, levels: Iterable[int], dataset: str, seed: int) -> str:
    return f"{experiment}_{list(levels)}_{dataset}_seed{seed}_UC.json"
