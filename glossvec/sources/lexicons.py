"""Dictionary text, lexicon tables and recall results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.functions.text import words
from glossvec.operators.filters import last_wins

# Column names of the lexicon table as stored, in both revisions, and as used here.
LEXICON_NAMES = {"norms": "norm", "words": "word", "word_ids": "token_id", "embeddings_ids": "token_id"}

_STORED = {
    "norms": T.DoubleType(),
    "norm": T.DoubleType(),
    "word_ids": T.LongType(),
    "embeddings_ids": T.LongType(),
    "token_id": T.LongType(),
}


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a dictionary text with their place in the input: value, ord."""
    lines = spark.read.text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("value", place.alias("ord"))


def read_dictionary_text(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """`pos sense [word] definition…` lines to word, definition; a later line for a word replaces an earlier.

    Lines with fewer than three fields fail the query, or are left out with
    `on_bad="skip"` (`bad_dictionary_lines` lists them). Words without a
    definition are left out.
    """
    if on_bad not in ("fail", "skip"):
        raise ValueError(f"on_bad must be 'fail' or 'skip', got {on_bad!r}")
    parts = dictionary_lines(spark, path).withColumn("f", words("value"))
    if on_bad == "fail":
        message = F.concat(F.lit("dictionary line with fewer than three fields: "), F.col("value"))
        checked = F.when(F.size("f") < 3, F.raise_error(message).cast("array<string>")).otherwise(F.col("f"))
        parts = parts.withColumn("f", checked)
    else:
        parts = parts.where(F.size("f") >= 3)
    rest = F.slice("f", F.lit(4), F.greatest(F.size("f") - 3, F.lit(0)))
    entries = parts.select(
        F.btrim(F.element_at("f", 3), F.lit("[]")).alias("word"),
        F.array_join(rest, " ").alias("definition"),
        "ord",
    ).where("word <> '' AND definition <> ''")
    return last_wins(entries, "word", F.col("ord")).select("word", "definition")


def bad_dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_lines(spark, path).where(F.size(words("value")) < 3).select("value")


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def drop_index_column(df: DataFrame) -> DataFrame:
    """Remove an unnamed leading index column."""
    return df.drop("_c0", "Unnamed: 0")


def read_table_csv(
    spark: SparkSession, path: str, types: dict[str, T.DataType] | None = None, multi_line: bool = False
) -> DataFrame:
    """A header CSV with given column types, all others text; the index column is removed.

    A file is split over tasks; `multi_line` reads cells with line breaks, one
    task per file. A file whose header differs from the first one's fails the
    read, rather than have its columns named by position.
    """
    kinds = types or {}
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    read = spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=False).csv(path)
    return drop_index_column(read)


def read_lexicon_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Lexicon table in either revision of its column names: word, definition, token_id, norm (those present)."""
    df = read_table_csv(spark, path, _STORED, multi_line).withColumnsRenamed(LEXICON_NAMES)
    order = [c for c in ("word", "definition", "token_id", "norm") if c in df.columns]
    return df.select(*order, *[c for c in df.columns if c not in order])


def parse_recall_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """Flattened lists such as `'a' "b's"`, `['x', 'y']` or `[]` back to arrays; a backslash makes the next character plain."""
    item = F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""")
    return df.withColumns({c: F.transform(F.regexp_extract_all(c, item, F.lit(0)), _plain) for c in cols})


def _plain(quoted: Column) -> Column:
    inner = F.substr(quoted, F.lit(2), F.char_length(quoted) - 2)
    return F.regexp_replace(inner, r"(?s)\\(.)", "$1")


def _flat(col: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        texts = F.transform(F.col(col), lambda x: F.concat(F.lit("'"), F.regexp_replace(x.cast("string"), r"(['\\\\])", r"\\$1"), F.lit("'")))
        return F.array_join(texts, " ").alias(col)
    return F.col(col)


def write_results_csv(df: DataFrame, folder: str, run_id: str | None = None) -> str:
    """Results to CSV under a folder of their own; array columns as quoted text that `parse_recall_lists` reads."""
    target = f"{folder.rstrip('/')}/run={run_id}" if run_id else folder
    flat = df.select(*[_flat(f.name, f.dataType) for f in df.schema.fields])
    flat.write.mode("errorifexists").options(header=True, escape='"', quote='"').csv(target)
    return target
