"""Joins against a lookup table whose size is measured before it is broadcast."""

from __future__ import annotations

import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 64 << 20
LOOKUP_SALTS = 32
#: A key with so many rows is spread by salts; at most so many keys are.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 1_024

_measured: "weakref.WeakKeyDictionary[DataFrame, int]" = weakref.WeakKeyDictionary()


def task_count(df: DataFrame) -> int:
    """The cores of the session, for a table that is gone through many times."""
    return max(df.sparkSession.sparkContext.defaultParallelism, 1)


# File bytes per task under which a table is spread before work on it starts.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small stored table by key over all tasks.

    A few row groups would leave most cores idle through all text work. A table
    with enough bytes for every task is read as it lies.
    """
    tasks = task_count(df)
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(tasks, key) if stored < tasks * SPREAD_BYTES else df


def _value_bytes(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(col)
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(col.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(col) * 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)):
        return F.octet_length(F.to_json(F.struct(col))) * 4
    return F.lit(8)


def _column_bytes(field: T.StructField) -> Column:
    size = _value_bytes(F.col(f"`{field.name}`"), field.dataType)
    return F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)) + 8


def measured_bytes(df: DataFrame) -> int:
    """Upper-side estimate of the in-memory size of `df`, from one aggregate over its rows."""
    if df not in _measured:
        row = sum((_column_bytes(f) for f in df.schema.fields), F.lit(16).cast("bigint"))
        _measured[df] = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]
    return _measured[df]


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_LIMIT if limit is None else limit)


def vector_blocks(vectors: DataFrame, limit: int | None = None) -> int:
    """Number of blocks of (token_id, v) of which each is under the size limit."""
    room = max(BROADCAST_LIMIT if limit is None else limit, 1 << 10)
    return max(1, -(-measured_bytes(vectors) * 5 // (room * 4)))


def block_of(vectors: DataFrame, block: int, blocks: int) -> DataFrame:
    """The vectors of one of `blocks` blocks of about equal size."""
    return vectors.where(F.pmod(F.xxhash64("token_id"), F.lit(blocks)) == block) if blocks > 1 else vectors


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "inner",
    limit: int | None = None,
    salts: int = LOOKUP_SALTS,
) -> DataFrame:
    """Join many rows with a lookup table on `on`.

    A lookup under the size limit is broadcast. Beyond it both sides are shuffled
    by key. The rows of a heavy key, and those of a null one, carry a salt derived
    from their other columns, and only the lookup rows of heavy keys are copied
    once per salt: a key that holds a large share of the rows is spread over
    `salts` tasks, and the lookup is shuffled about once.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(lookup, limit):
        return rows.join(F.broadcast(lookup), keys, how)
    others = [c for c in rows.columns if c not in keys] or keys
    heavy = _heavy_keys(rows, keys)
    spread_out = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    copied = F.lit(False)
    if heavy is not None:
        rows = rows.join(F.broadcast(heavy), keys, "left")
        lookup = lookup.join(F.broadcast(heavy), keys, "left")
        copied = F.col("__heavy").isNotNull()
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]), F.lit(salts)).cast("int")
    salted = rows.withColumn("__salt", F.when(copied | spread_out, salt).otherwise(0))
    every = F.when(copied, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = lookup.withColumn("__salt", F.explode(every)).drop("__heavy")
    return salted.drop("__heavy").join(copies, keys + ["__salt"], how).drop("__salt")


def _heavy_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with the most rows, if any has HEAVY_ROWS: keys, __heavy. At most HEAVY_KEYS rows."""
    counts = rows.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY_ROWS)
    found = counts.orderBy(F.desc("n"), *keys).limit(HEAVY_KEYS).drop("n").collect()
    if not found:
        return None
    made = rows.sparkSession.createDataFrame(found, rows.select(*keys).schema)
    return made.withColumn("__heavy", F.lit(True))
