"""Helpers of the training-data operators: row identity, written tables, hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossvec.session import ensure_checkpoint_dir

#: Space and the control characters tab to carriage return: what separates words in every contract.
BLANKS = " \t\n\x0b\f\r"
#: The same set as a character class that Java, RE2 and Python read alike.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key that holds more than one row in so many is a hot key; there are never more hot keys than this.
HOT_SHARE = 2_000


def text_of(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def without_blanks(text: Column) -> Column:
    """The text with every blank deleted: byte searches, no regular expression."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the byte path of `lower`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bound(value: Column, body) -> Column:
    """`body(v)` with `value` computed once per row.

    Inside a higher-order function an outer expression is evaluated again for
    every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the session's shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs no more than its own tasks.
    Column pruning and compression hold, unlike for `checkpoint()`. The folder
    belongs to the job and is removed with its checkpoints.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Join rows with one-row-per-key `groups` whose column `size` counts the rows of the key, `total` over all keys.

    Keys over 1/HOT_SHARE of `total` rows are at most HOT_SHARE many. Their names
    are broadcast, their rows are dealt over as many tasks as they need, and the
    group is copied to those; every other key is small. There are no more than
    HOT_SHARE copies in all beyond the groups themselves.
    """
    limit = max(total // HOT_SHARE, 1)
    sized = groups.withColumn("__tasks", F.ceil(F.col(size) / limit).cast("int"))
    hot = sized.where("__tasks > 1").select(*on, F.col("__tasks").alias("__dealt")).limit(HOT_SHARE)
    others = [c for c in rows.columns if c not in on] or on
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*others), F.coalesce("__dealt", F.lit(1))).cast("int"))
    copies = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1)))
    return salted.join(copies, [*on, "__salt"]).drop("__salt", "__tasks", "__dealt")


def tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
