"""Ordered reports over norms: top lists, thirds, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.functions.hashing import draw, order_key
from glossvec.functions.vectors import l2_norm
from glossvec.operators.pooling import norms
from glossvec.operators.vocabulary import vocab_dictionary_overlap
from glossvec.plans.ordering import global_rank


def _named(top: DataFrame, vocab: DataFrame) -> DataFrame:
    return vocab.select("token_id", "word").join(F.broadcast(top), "token_id").select("word", "norm")


def longest_norms(vectors: DataFrame, vocab: DataFrame, k: int = 20) -> DataFrame:
    """The k vectors of greatest norm with their words; ties to the lower id."""
    return _named(norms(vectors).orderBy(F.desc("norm"), "token_id").limit(k), vocab)


def shortest_norms(vectors: DataFrame, vocab: DataFrame, k: int = 20) -> DataFrame:
    return _named(norms(vectors).orderBy("norm", "token_id").limit(k), vocab)


def common_words_by_norm(lexicon: DataFrame, vocab: DataFrame, k: int = 20, end: str = "first") -> DataFrame:
    """Words of both dictionary and vocabulary, the k of lowest (`first`) or highest (`last`) norm."""
    common = vocab_dictionary_overlap(lexicon, vocab).select("word", "norm").distinct()
    order = F.asc("norm") if end == "first" else F.desc("norm")
    return common.orderBy(order, "word").limit(k)


def sort_token_ids(seq: DataFrame, first: int = 5, last: int = 3, key: str = "doc_id") -> DataFrame:
    """Ids of a sequence in rising order: the first few and the last few."""
    ordered = F.array_sort("ids")
    tail = F.slice(ordered, F.greatest(F.size("ids") - last + 1, F.lit(1)), F.lit(last))
    return seq.select(key, F.slice(ordered, 1, first).alias("first_ids"), tail.alias("last_ids"))


def norm_rank_thirds(lexicon: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """Rank by norm, cut into three runs of floor(n/3); the remainder goes to the last."""
    size = max(1, lexicon.count() // 3)
    ranked = global_rank(lexicon, F.col("norm"), [F.col("word")], "__at", rows_per_bucket)
    third = F.least(F.floor(F.col("__at") / size), F.lit(2)).cast("bigint")
    return ranked.select("word", "norm", third.alias("third"))


def sample_per_group(
    df: DataFrame,
    group: str = "third",
    k: int = 10,
    seed: int = 42,
    col: str = "word",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """k draws per group with replacement: draw j takes the row whose rank in the group is a hash of (seed, group, j).

    Rows of a group are ranked by a hash, in buckets of that hash, so no group
    is gathered in a task however large it is.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    draws = sizes.withColumn("draw", F.explode(every))
    picked = draws.select(group, "draw", draw(order_key(seed, group, "draw"), F.col("n"), 1).alias("__at"))
    keyed = df.select(group, col, F.substring(order_key(seed, col), 1, 8).alias("h"))
    ranked = global_rank(
        keyed, F.col("h"), [F.col(col)], "__at", rows_per_bucket, within=[group]
    )
    # A place is one row of its group, so no key is large; a null group is one like others.
    wanted = picked.select(F.col(group).alias("__g"), "draw", F.col("__at").alias("__p"))
    return ranked.join(wanted, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__at") == F.col("__p"))).select(group, "draw", col)


def norm_compare(v1: DataFrame, v2: DataFrame, vocab: DataFrame) -> DataFrame:
    """Norm of every word in two tables: word, norm_1, norm_2."""
    a = v1.select("token_id", l2_norm("v").alias("norm_1"))
    b = v2.select("token_id", l2_norm("v").alias("norm_2"))
    return a.join(b, "token_id").join(vocab.select("token_id", "word"), "token_id").select("word", "norm_1", "norm_2")
