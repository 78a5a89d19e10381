"""Vocabulary building and word-level lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossvec.constants import UNK_ID
from glossvec.functions.text import chars, word_runs
from glossvec.plans.joins import fits_broadcast, lookup_join
from glossvec.plans.lookups import words_of


def token_rows(documents: DataFrame, tokens: Column | None = None, key: str = "doc_id") -> DataFrame:
    """One row per token: key, 0-based pos, tok."""
    toks = word_runs("text") if tokens is None else tokens
    return documents.select(key, F.posexplode(toks).alias("pos", "tok")).withColumn("pos", F.col("pos").cast("bigint"))


def word_frequencies(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Count of each pre-token."""
    toks = word_runs("text") if tokens is None else tokens
    return documents.select(F.explode(toks).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def build_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The `size` most frequent words, numbered by falling count and then by word.

    Only the kept words are numbered; the cut is a top-k, never a sort of all words.
    """
    top = counts.orderBy(F.desc("n"), "w").limit(size)
    return top.select(
        F.col("w").alias("word"),
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "w")) - 1).cast("bigint").alias("token_id"),
        F.col("n").alias("freq"),
    )


def alphabet(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Distinct characters of all pre-tokens, sorted."""
    toks = word_runs("text") if tokens is None else tokens
    per_row = F.array_distinct(F.flatten(F.transform(toks, chars)))
    return documents.select(F.explode(per_row).alias("ch")).distinct().orderBy("ch")


def char_vocabulary(documents: DataFrame, share: float = 0.0) -> DataFrame:
    """Visible characters holding at least `share` of the text; all of them by default."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\S"), F.lit(0))
    counts = documents.select(F.explode(found).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") >= total * F.lit(share))


def token_to_id(tokens: DataFrame, vocab: DataFrame, unk: int | None = UNK_ID) -> DataFrame:
    """Add `token_id` of `tok`; unknown tokens get `unk`, or are dropped when `unk` is None."""
    names = vocab.select(F.col("word").alias("tok"), F.col("token_id").alias("id"))
    if unk is None:
        return lookup_join(tokens, names, "tok")
    found = lookup_join(tokens, names, "tok", "left")
    return found.withColumn("id", F.coalesce("id", F.lit(unk).cast("bigint")))


def id_to_token(seq: DataFrame, vocab: DataFrame, key: str = "key", ids: str = "ids", limit: int | None = None) -> DataFrame:
    """Array of ids to the array of words, order kept; unknown ids give `[UNK]`.

    A vocabulary under the size limit travels to the tasks and nothing is
    shuffled; beyond it ids are exploded, joined and put back by `key`.
    """
    if fits_broadcast(vocab.select("word", "token_id"), limit):
        return seq.select(key, words_of(F.col(ids), vocab).alias("tokens"))
    names = vocab.select(F.col("token_id").alias("id"), F.col("word"))
    rows = seq.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    found = lookup_join(rows, names, "id", "left", limit)
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("word", F.lit("[UNK]")).alias("w")))
    return found.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda z: z["w"]).alias("tokens")
    )


def vocab_dictionary_overlap(lexicon: DataFrame, vocab: DataFrame) -> DataFrame:
    """Lexicon rows whose word is in the vocabulary."""
    return lookup_join(lexicon, vocab.select("word"), "word", "left_semi")


def oov_words(def_tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct tokens absent from the vocabulary."""
    names = vocab.select(F.col("word").alias("tok"))
    return lookup_join(def_tokens.select("tok").distinct(), names, "tok", "left_anti")


def overlap_counts(a: DataFrame, b: DataFrame, col: str = "word") -> DataFrame:
    """Distinct words of both sides and of their intersection."""
    sides = a.select(col, F.lit(1).alias("s")).unionByName(b.select(col, F.lit(2).alias("s")))
    seen = sides.groupBy(col).agg(
        F.max(F.col("s") == 1).alias("in_a"), F.max(F.col("s") == 2).alias("in_b")
    )
    return seen.agg(
        F.count_if("in_a").alias("n_a"),
        F.count_if("in_b").alias("n_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"),
    )


def word_intersection(a: DataFrame, b: DataFrame, col: str = "word") -> DataFrame:
    return a.select(col).intersect(b.select(col))


def word_union(a: DataFrame, b: DataFrame, col: str = "word") -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def distinct_words(a: DataFrame, col: str = "word") -> DataFrame:
    return a.select(col).distinct()
