"""Tables derived once from stored sources and read by everything after.

A table lies in a folder named by a fingerprint of what it is made of: the files of
its sources with their lengths and times, and its parameters. Another file or
parameter gives another folder, so what is read is never stale. A table is written
aside and renamed when it is whole: a lost attempt leaves nothing that is read, and
of two sessions that make the same table one wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossvec.session import drop_table, ensure_checkpoint_dir


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def source_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time) of the files of a stored table, a file or a folder of files."""
    where, fs = _path(spark, path)
    found, listed = [], fs.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().toString()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, sources: list[str], params: dict) -> str:
    """Of all files of `sources` and the parameters."""
    held = [source_files(spark, s) for s in sources]
    return hashlib.sha256(json.dumps([held, params], sort_keys=True, default=str).encode()).hexdigest()[:32]


def derived_folder(spark: SparkSession) -> str:
    """Where derived tables lie: the folder of `spark.glossvec.derived.dir`, which outlives a session, or else the checkpoint folder."""
    return spark.conf.get("spark.glossvec.derived.dir", None) or f"{ensure_checkpoint_dir(spark)}/derived"


def derived_table(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame], **params) -> DataFrame:
    """The stored table `name` of these sources and parameters, made by `make` if it is not there."""
    path = f"{derived_folder(spark)}/{name}-{fingerprint(spark, sources, params)}"
    where, fs = _path(spark, path)
    if not fs.exists(where):
        aside = f"{path}.{uuid.uuid4().hex}"
        make().write.parquet(aside)
        if not fs.rename(_path(spark, aside)[0], where):
            drop_table(spark, aside)  # another session was first
        else:
            inner = f"{path}/{aside.rsplit('/', 1)[1]}"  # some stores move into a folder that is there
            if fs.exists(_path(spark, inner)[0]):
                drop_table(spark, inner)
    return spark.read.parquet(path)
