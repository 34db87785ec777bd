"""One portable hash for every random choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def pair_hash(user: Column | str, item: Column | str, seed: int = 42) -> Column:
    """Seeded hash of two ids, from 0 to PRIME - 1, in plain integer arithmetic (so that any SQL engine can repeat it)."""
    u, i = (F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(PRIME)) for c in (user, item))
    mixed = (u * 1000003 + i * 7919 + seed * 104729) % PRIME
    return (mixed * 48271) % PRIME


def pair_hash_sql(user: str, item: str, seed: int = 42) -> str:
    return f"((({user} * 1000003 + {item} * 7919 + {seed} * 104729) % {PRIME}) * 48271) % {PRIME}"
