"""Running totals, ranks and exact quantiles over a whole table.

A window without a partition key runs in one task. Here rows are dealt into
consecutive ranges of the whole order, ties included, so that one value that
holds most rows is split like any other. The dealt rows are written once; every
range is summed, the few sums are accumulated, and a window runs inside each
range. Keys may be of any type that has an order; nulls come first, as in a sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossvec.session import stored_table

ROWS_PER_BUCKET = 1_000_000
# Ranges come from a sample; twice as many keep every range under its bound.
SPARE = 2


def with_order_bucket(df: DataFrame, order: list[Column], rows_per_bucket: int | None = None) -> tuple[DataFrame, int]:
    """Add `__o0`, `__o1` ... (the order) and `__b`, a range number that rises with it; and the number of ranges.

    Beyond one range the rows are written to the checkpoint folder with their
    range, so every later pass sees the same ranges.
    """
    per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    keyed = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    rows = df.count()
    if rows <= per_bucket:
        return keyed.withColumn("__b", F.lit(0)), 1
    buckets = math.ceil(SPARE * rows / per_bucket)
    dealt = keyed.repartitionByRange(buckets, *[f"__o{i}" for i in range(len(order))]).withColumn("__b", F.spark_partition_id())
    return stored_table(dealt, "order"), buckets


def _fold_before(df, key, ties, value, out, fold, combine, rows_per_bucket, within):
    order = [key, *ties]
    names = [f"__o{i}" for i in range(len(order))]
    rows, buckets = with_order_bucket(df.withColumn("__x", value), order, rows_per_bucket)
    inside = Window.partitionBy(*within, "__b").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    here = fold("__x").over(inside)
    if buckets == 1:  # the row count was checked: one window task is enough
        return rows.withColumn(out, combine(F.lit(None), here)).drop("__b", "__x", *names)
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*within, "__b").agg(fold("__x").alias("__t"))
    before = totals.select(*[F.col(w).alias(f"__w{i}") for i, w in enumerate(within)], F.col("__b").alias("__c"), fold("__t").over(earlier).alias("__before"))
    meet = F.col("__b") == F.col("__c")
    for i, w in enumerate(within):
        meet = meet & F.col(w).eqNullSafe(F.col(f"__w{i}"))
    joined = rows.join(before, meet)
    drop = ["__b", "__c", "__x", "__before", *names, *[f"__w{i}" for i in range(len(within))]]
    return joined.withColumn(out, combine(F.col("__before"), here)).drop(*drop)


def running_total(
    df: DataFrame,
    key: Column,
    ties: list[Column],
    value: Column,
    out: str,
    rows_per_bucket: int | None = None,
    within: list[str] | None = None,
) -> DataFrame:
    """Sum of the whole number `value` over all rows before this one in the order (key, ties).

    `within` restarts the sum for every value of those columns; a value that
    holds most of the rows is still cut into buckets.
    """

    def combine(before, here):
        return F.coalesce(before, F.lit(0).cast("bigint")) + F.coalesce(here, F.lit(0).cast("bigint"))

    return _fold_before(df, key, ties, value.cast("bigint"), out, F.sum, combine, rows_per_bucket, within or [])


def global_rank(
    df: DataFrame,
    key: Column,
    ties: list[Column],
    out: str,
    rows_per_bucket: int | None = None,
    within: list[str] | None = None,
) -> DataFrame:
    """0-based position of every row in the order (key, ties), restarted `within` columns."""
    return running_total(df, key, ties, F.lit(1), out, rows_per_bucket, within)


def running_max(
    df: DataFrame,
    key: Column,
    ties: list[Column],
    value: Column,
    out: str,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Largest whole number `value` over all rows before this one in the order (key, ties); null for the first."""

    def combine(before, here):
        return F.greatest(before.cast("bigint"), here)

    return _fold_before(df, key, ties, value.cast("bigint"), out, F.max, combine, rows_per_bucket, [])


def exact_quantiles(
    df: DataFrame, col: str, probs: list[float], rows_per_bucket: int | None = None
) -> list[float | None]:
    """Linearly interpolated exact quantiles of a numeric column.

    Under the row bound the built-in exact `percentile` is used. Beyond it the
    values are counted, the counts accumulated in value order, and only the
    values that cover a wanted rank reach the driver (two per quantile at most).
    """
    limit = rows_per_bucket or ROWS_PER_BUCKET
    values = df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL")
    n = values.count()
    if n == 0:
        return [None] * len(probs)
    if n <= limit:
        return list(values.agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probs]))).first()[0])
    counted = values.groupBy("x").agg(F.count("*").alias("c"))
    placed = running_total(counted, F.col("x"), [], F.col("c"), "first", rows_per_bucket)
    ranks = [p * (n - 1) for p in probs]
    wanted = sorted({r for p in ranks for r in (math.floor(p), math.ceil(p))})
    hits = placed.where(
        F.exists(
            F.array(*[F.lit(w) for w in wanted]),
            lambda w: (w >= F.col("first")) & (w < F.col("first") + F.col("c")),
        )
    ).collect()

    def at(rank: int) -> float:
        return next(h["x"] for h in hits if h["first"] <= rank < h["first"] + h["c"])

    out = []
    for r in ranks:
        lo, hi = math.floor(r), math.ceil(r)
        out.append(at(lo) + (at(hi) - at(lo)) * (r - lo))
    return out
