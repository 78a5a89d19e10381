"""Counts over a corpus that grows by files: a new file costs its own count only.

A store holds increments. Each has the counts of the files that were new when it
was made, and the list of these files with their lengths and times. An increment
is written aside and renamed when it is whole, so a lost attempt counts nothing,
and counting again finds no new file. Counts are sums over all increments; what
is distinct (an alphabet) is what has a count. One writer adds to a store at a time.

A file that was counted and has changed since raises an error: its old counts
cannot be told from the others. A file that is gone stays counted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossvec.plans.derived import _path, source_files
from glossvec.session import drop_table

_FILES = "name string, length bigint, time bigint"


def _increments(spark: SparkSession, store: str, part: str) -> list[str]:
    where, fs = _path(spark, f"{store}/increment-*/{part}")
    return [s.getPath().toString() for s in fs.globStatus(where) or []]


def counted_files(spark: SparkSession, store: str) -> DataFrame:
    """(name, length, time) of every file whose counts the store holds."""
    held = _increments(spark, store, "files")
    return spark.read.schema(_FILES).parquet(*held) if held else spark.createDataFrame([], _FILES)


def add_new_files(spark: SparkSession, store: str, source: str, count: Callable[[DataFrame], DataFrame]) -> int:
    """Count the Parquet files of `source` that the store has not counted yet, and return how many they were.

    `count` turns their rows into keys and a sum `n`, such as `word_frequencies`.
    """
    known = {r["name"]: (r["length"], r["time"]) for r in counted_files(spark, store).toLocalIterator()}
    found = source_files(spark, source)
    changed = [name for name, *state in found if name in known and known[name] != tuple(state)]
    if changed:
        raise ValueError(f"{len(changed)} counted files have changed, the first is {changed[0]}")
    new = [f for f in found if f[0] not in known]
    if not new:
        return 0
    name = hashlib.sha256(json.dumps(new).encode()).hexdigest()[:32]
    aside = f"{store}/_aside-{uuid.uuid4().hex}"
    count(spark.read.parquet(*[f[0] for f in new])).write.parquet(f"{aside}/counts")
    spark.createDataFrame(new, _FILES).coalesce(1).write.parquet(f"{aside}/files")
    where, fs = _path(spark, f"{store}/increment-{name}")
    if fs.exists(where) or not fs.rename(_path(spark, aside)[0], where):
        drop_table(spark, aside)
        raise RuntimeError(f"another writer added to {store}")
    return len(new)


def merged_counts(spark: SparkSession, store: str) -> DataFrame:
    """The counts of all files of the store: the keys and their sum `n`."""
    held = _increments(spark, store, "counts")
    if not held:
        raise ValueError(f"nothing was counted in {store}")
    parts = spark.read.parquet(*held)
    return parts.groupBy(*[c for c in parts.columns if c != "n"]).agg(F.sum("n").alias("n"))
