"""Data-quality checks: each returns (check, n_violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.operators.summaries import duplicate_rows


def _violations(df: DataFrame, name: str, broken: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check"), F.count_if(broken).alias("n_violations"))


def label_domain_check(df: DataFrame, allowed: dict[str, list[int]], split: str = "split", label: str = "label") -> DataFrame:
    """Labels outside the values allowed for their split; a split without a rule and a null label break it."""
    ok = F.lit(False)
    for name, values in allowed.items():
        ok = ok | ((F.col(split) == name) & F.col(label).isin(values))
    return _violations(df, "label_domain", ~F.coalesce(ok, F.lit(False)))


def no_duplicate_rows(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).select(F.lit("no_duplicate_rows").alias("check"), F.col("n_extra").alias("n_violations"))


def non_empty_sequences(df: DataFrame, col: str = "input_ids") -> DataFrame:
    return _violations(df, "non_empty_sequences", F.coalesce(F.size(col) == 0, F.lit(True)))


def tokens_match_vectors(df: DataFrame, tokens: str = "tokens", vectors: str = "vectors") -> DataFrame:
    return _violations(df, "tokens_match_vectors", ~F.coalesce(F.size(tokens) == F.size(vectors), F.lit(False)))


def non_empty_dataset(df: DataFrame) -> DataFrame:
    """One violation if there is no row; reads one row at most."""
    seen = df.select(F.lit(1)).limit(1).agg(F.count("*").alias("n"))
    return seen.select(F.lit("non_empty_dataset").alias("check"), (1 - F.col("n")).cast("bigint").alias("n_violations"))


def valid_range_bounds(lo: float, hi: float) -> None:
    """An argument check, before any plan is built."""
    if not lo <= hi:
        raise ValueError(f"range must be (min, max), got ({lo}, {hi})")


def min_fields(lines: DataFrame, col: str = "value", n: int = 3) -> DataFrame:
    """Dictionary lines with fewer than `n` whitespace fields."""
    fields = F.size(F.regexp_extract_all(F.col(col), F.lit(r"\S+"), F.lit(0)))
    return _violations(lines, "min_fields", fields < n)
