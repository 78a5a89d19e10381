"""Randomness as a pure function of a seed and row keys: the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_key(seed: int, *keys) -> Column:
    """32 hex digits drawn for the seed and the keys."""
    parts = [F.lit(str(seed)), *[_col(k).cast("string") for k in keys]]
    return F.md5(F.concat_ws(":", *parts))


def threshold(p: float) -> str:
    return format(round(p * 65536), "04x")


def chance(key: Column, p: float, digit: int = 1) -> Column:
    """True with probability `p`, read from four hex digits of a key."""
    return F.substring(key, digit, 4) < F.lit(threshold(p))


def draw(key: Column, n: Column, digit: int = 9) -> Column:
    """A whole number in `[0, n)`, read from eight hex digits of a key."""
    return F.pmod(F.conv(F.substring(key, digit, 8), 16, 10).cast("bigint"), n)
