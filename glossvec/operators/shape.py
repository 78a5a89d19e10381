"""Columns, rows and tables: selecting, renaming, reshaping, comparing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.plans.joins import lookup_join


def column_symmetric_difference(df: DataFrame, keep: list[str]) -> list[str]:
    """Columns in exactly one of the schema and the keep-list, in schema order."""
    return [c for c in df.columns if c not in keep] + [c for c in keep if c not in df.columns]


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def keep_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Only the named columns; an unknown name is an error."""
    unknown = [c for c in column_symmetric_difference(df, cols) if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not present: {unknown}")
    return df.select(*cols)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_to_string(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def explode_list(df: DataFrame, col: str) -> DataFrame:
    """One row per list item; an empty or null list gives one null."""
    return df.withColumn(col, F.explode_outer(col))


def melt(df: DataFrame, key: str) -> DataFrame:
    """Wide to long; every value as text."""
    cols = [c for c in df.columns if c != key]
    return cast_to_string(df, cols).unpivot(key, cols, "variable", "value").withColumnRenamed(key, "id")


def dict_to_table(df: DataFrame, col: str) -> DataFrame:
    """A map column to rows: key, value."""
    return df.select(F.explode(col).alias("key", "value"))


def concat_languages(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def select_language(df: DataFrame, languages: str | list[str] = "all") -> DataFrame:
    """One language, several, or all."""
    if languages == "all":
        return df
    wanted = [languages] if isinstance(languages, str) else list(languages)
    return df.where(F.col("language").isin(wanted))


def read_named_split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def compare_tables(a: DataFrame, b: DataFrame, on: str, suffixes: tuple[str, str] = ("_1", "_2")) -> DataFrame:
    """Inner merge; shared columns get the suffixes, duplicate keys multiply. `b` is the side that is broadcast or copied."""
    shared = [c for c in a.columns if c in b.columns and c != on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return lookup_join(left, right, on)
