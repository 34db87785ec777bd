"""Rows that go through an operator whole, whatever the names of their columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, added: Iterable[str], carry: list[str] | None = None) -> Column:
    """The columns ``carry`` (all by default) of ``df`` in one struct, but for those whose names (in any case) are ``added`` later.

    An operator's own columns then stand beside the struct and can't clash with any of them.
    """
    gone = {a.lower() for a in added}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in gone]
    return F.struct(*(named(c).alias(c) for c in kept)) if kept else F.struct(F.lit(None).cast("int").alias("none"))


def unpacked(df: DataFrame, row: str = "row") -> list[Column]:
    """The columns that were packed."""
    return [F.col(row).getField(f.name).alias(f.name) for f in df.schema[row].dataType.fields if f.name != "none" or len(df.schema[row].dataType.fields) > 1]
