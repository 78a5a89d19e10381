"""Code corpora, issue records, stored datasets, vocabularies and vector sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.constants import CODE_LANGUAGES
from glossvec.operators.filters import last_wins

# Stored key and published column of a code record, in published order.
CODE_COLUMNS = [
    ("repo", "repository_name"),
    ("path", "func_path_in_repository"),
    ("func_name", "func_name"),
    ("original_string", "whole_func_string"),
    ("language", "language"),
    ("code", "func_code_string"),
    ("code_tokens", "func_code_tokens"),
    ("docstring", "func_documentation_string"),
    ("docstring_tokens", "func_documentation_tokens"),
    ("partition", "split_name"),
    ("url", "func_code_url"),
]

CODE_SPLITS = ["train", "test", "valid"]

_SEQUENCES = {"code_tokens", "docstring_tokens"}

CODE_SCHEMA = T.StructType(
    [
        T.StructField(k, T.ArrayType(T.StringType()) if k in _SEQUENCES else T.StringType())
        for k, _ in CODE_COLUMNS
    ]
)

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("html_url", T.StringType()),
        T.StructField("comments", T.ArrayType(T.StringType())),
        T.StructField("is_pull_request", T.BooleanType()),
    ]
)


def code_columns(df: DataFrame) -> list:
    return [F.col(k).alias(name) for k, name in CODE_COLUMNS]


def read_code_jsonl(
    spark: SparkSession, root: str, languages: str | list[str] = "all", split: str | None = None
) -> DataFrame:
    """Code records under `<root>/<language>/final/jsonl/<split>/`, plain or gzipped.

    Only the folders asked for are listed and read. `split` is the folder's
    name and `row_key` is unique per record: file, block and place in the block.
    """
    wanted = CODE_LANGUAGES if languages == "all" else [languages] if isinstance(languages, str) else list(languages)
    unknown = [x for x in wanted if x not in CODE_LANGUAGES]
    if unknown:
        raise ValueError(f"unknown languages {unknown}; known are {CODE_LANGUAGES}")
    if split is not None and split not in CODE_SPLITS:
        raise ValueError(f"unknown split {split!r}; known are {CODE_SPLITS}")
    folders = "{" + ",".join(wanted) + "}"
    parts = split or "{" + ",".join(CODE_SPLITS) + "}"
    rows = spark.read.schema(CODE_SCHEMA).json(f"{root.rstrip('/')}/{folders}/final/jsonl/{parts}/*.jsonl*")
    place = F.concat_ws(
        "_",
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start").cast("string"),
        F.monotonically_increasing_id().cast("string"),
    )
    return rows.select(place.alias("row_key"), *code_columns(rows), split_from_path(F.col("_metadata.file_path")).alias("split"))


def split_from_path(path):
    return F.regexp_extract(path, r"/final/jsonl/([^/]+)/[^/]*$", 1)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ISSUE_SCHEMA).json(path)


def write_split(df: DataFrame, folder: str) -> None:
    """A dataset of named splits as Parquet, one folder per split."""
    df.write.mode("errorifexists").partitionBy("split").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """A stored dataset, or one of its splits; only that folder is read."""
    df = spark.read.parquet(folder)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def write_text_corpus(df: DataFrame, folder: str, col: str = "text") -> None:
    """One text per line; a newline in a text starts a new line."""
    df.select(F.col(col).alias("value")).where("value IS NOT NULL").write.mode("errorifexists").text(folder)


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).withColumnRenamed("value", "text")


def write_vocabulary(vocab: DataFrame, folder: str) -> None:
    vocab.select("word", "token_id").write.mode("errorifexists").parquet(folder)


def read_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("word", "token_id")


def vector_sheet(predicted: DataFrame, names: DataFrame, order: str = "token_id") -> DataFrame:
    """Predicted vectors by word; a repeated word keeps its last vector: word, v."""
    named = predicted.join(names.select("token_id", "word"), "token_id")
    return last_wins(named.select("word", "v", order), "word", F.col(order)).select("word", "v")


def write_vector_sheet(sheet: DataFrame, folder: str) -> None:
    sheet.select("word", "v").write.mode("errorifexists").parquet(folder)


def read_vector_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("word", "v")
