"""Portable hashing: md5 of ``cast(key as string) || '|' || seed`` gives the same
order and thresholds in Spark and in any SQL engine with md5, so every split,
shuffle and draw is reproducible and checkable without ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column | str, seed: int | str = 42) -> Column:
    """Lower-case hex md5 of ``key|seed``."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit("|"), F.lit(str(seed))))


def salted_hash(key: Column | str, seed: Column) -> Column:
    """md5 of ``key|seed`` where the seed is itself a column (repeated splits)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit("|"), seed.cast("string")))


def hash_threshold(fraction: float) -> str:
    """Hex text t such that ``md5 < t`` keeps about ``fraction`` of keys."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    v = min(int(fraction * 16 ** 8), 16 ** 8 - 1) if fraction < 1.0 else 16 ** 8
    return "g" if v >= 16 ** 8 else format(v, "08x")


def hash_below(key: Column | str, fraction: float, seed: int | str = 42) -> Column:
    """True for about ``fraction`` of the keys, deterministically."""
    return F.substring(key_hash(key, seed), 1, 8) < F.lit(hash_threshold(fraction))


def hash_int(key: Column | str, seed: int | str = 42) -> Column:
    """Non-negative 32-bit integer from the first 8 hex digits of the md5."""
    return F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("bigint")
