"""Row filters and simple projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.functions.text import strip_chars as strip_chars_of
from glossvec.functions.text import word_count, words
from glossvec.plans.joins import fits_broadcast, lookup_join
from glossvec.plans.lookups import places_of
from glossvec.plans.ordering import exact_quantiles, global_rank, running_max


def in_open_band(norm: Column, lo: float, hi: float) -> Column:
    if lo > hi:
        raise ValueError(f"norm band must be (low, high), got ({lo}, {hi})")
    return (norm > lo) & (norm < hi)


def norm_band_filter(lexicon: DataFrame, lo: float, hi: float) -> DataFrame:
    """Rows with lo < norm < hi; both ends are open."""
    return lexicon.where(in_open_band(F.col("norm"), lo, hi))


def norm_quartile_bands(lexicon: DataFrame, top: float | None = None) -> DataFrame:
    """Open bands 0..3 between the norm quartiles; a norm equal to a cut, or at `top` or above, has none."""
    q1, q2, q3 = exact_quantiles(lexicon, "norm", [0.25, 0.5, 0.75])
    norm = F.col("norm")
    last = norm > q3
    if top is not None:
        last = last & (norm < top)
    band = (
        F.when(norm < q1, 0)
        .when((norm > q1) & (norm < q2), 1)
        .when((norm > q2) & (norm < q3), 2)
        .when(last, 3)
    )
    return lexicon.select("word", "norm", band.cast("bigint").alias("band"))


def band_words(lexicon: DataFrame, lo: float, hi: float) -> DataFrame:
    """Distinct non-null words of a norm band."""
    return string_type_guard(norm_band_filter(lexicon, lo, hi), "word").select("word").distinct()


def definition_contains_band_word(lexicon: DataFrame, lo: float, hi: float, key: str = "token_id") -> DataFrame:
    """Rows whose definition holds at least one band word (case-sensitive whole words)."""
    rows = lexicon.select(key, F.explode(F.array_distinct(words("definition"))).alias("word"))
    hit = lookup_join(rows, band_words(lexicon, lo, hi), "word", "left_semi").select(key).distinct()
    return lexicon.join(hit, key, "left_semi")


def band_word_positions(
    lexicon: DataFrame, lo: float, hi: float, offset: int = 1, key: str = "token_id", limit: int | None = None
) -> DataFrame:
    """0-based positions of band words in the encoded definition, whose first token shifts them by `offset`: key, word, positions.

    While the band's words fit the broadcast limit, places are found where the definition lies, and only these lists are
    shuffled. Beyond it every word of a definition becomes a row.
    """
    band = band_words(lexicon, lo, hi)
    if fits_broadcast(band, limit):
        places = lexicon.select(key, "word", places_of(F.col("definition"), band, offset).alias("at"))
        return places.groupBy(key, "word").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))
    rows = lexicon.select(key, F.col("word").alias("head"), F.posexplode_outer(words("definition")).alias("p", "word"))
    at = F.when(F.col("hit"), F.col("p").cast("bigint") + offset)
    return (
        lookup_join(rows, band.withColumn("hit", F.lit(True)), "word", "left", limit)
        .groupBy(key, F.col("head").alias("word"))
        .agg(F.array_sort(F.collect_list(at)).alias("positions"))
        .select(key, "word", "positions")
    )


def definition_band_words(lexicon: DataFrame, lo: float, hi: float) -> DataFrame:
    """Band words that occur in any definition."""
    used = lexicon.select(F.explode(words("definition")).alias("word")).distinct()
    return band_words(lexicon, lo, hi).join(used, "word", "left_semi")


def _covered(char_vocab: DataFrame, cols: list[str], check_space: bool) -> Column:
    # One row per character at most, so the list is bounded by Unicode itself.
    # Longer entries of a vocabulary say nothing about single characters.
    single = char_vocab.select("ch").where(F.char_length("ch") == 1).distinct()
    known = "".join(r["ch"] for r in single.collect())
    if not check_space:
        known += " \t\n\r\f\v"
    left = [F.translate(c, known, "") == "" for c in cols]
    test = F.lit(True)
    for ok in left:
        test = test & ok
    return test


def char_coverage_filter(
    df: DataFrame, char_vocab: DataFrame, cols: list[str], check_space: bool = False
) -> DataFrame:
    """Rows whose every character, in all `cols`, is in the character vocabulary; a null column drops the row."""
    return df.where(_covered(char_vocab, cols, check_space))


def clean_word_filter(df: DataFrame, char_vocab: DataFrame, col: str = "word") -> DataFrame:
    """Rows whose word belongs to the set of fully covered words: a property of the word itself."""
    return df.where(_covered(char_vocab, [col], check_space=True))


def issue_filter(issues: DataFrame) -> DataFrame:
    """Not a pull request, and at least one comment."""
    pr = "is_pull_request" if "is_pull_request" in issues.columns else "is_pr"
    return issues.where(~F.col(pr) & (F.size("comments") > 0))


def min_words_filter(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Strictly more than `n` whitespace words."""
    return df.where(word_count(col) > n)


def string_type_guard(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def lookup_word(df: DataFrame, word: str, col: str = "word") -> DataFrame:
    return df.where(F.col(col) == F.lit(word))


def head_slice(df: DataFrame, order: list, n: int) -> DataFrame:
    """First `n` rows of an ordering."""
    return df.orderBy(*order).limit(n)


def row_range(df: DataFrame, order: str, a: int, b: int) -> DataFrame:
    """Rows `[a, b)` of the ordering by a numeric unique column."""
    ranked = global_rank(df, F.col(order), [F.col(order)], "__at")
    return ranked.where((F.col("__at") >= a) & (F.col("__at") < b)).drop("__at")


def with_length(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("length", F.char_length(col).cast("bigint"))


def with_word_count(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("word_count", word_count(col))


def concat_text(df: DataFrame, cols: list[str], sep: str = " \n ") -> DataFrame:
    """Columns joined by `sep`; a null part makes the text null."""
    parts = []
    for c in cols:
        parts += [F.lit(sep), F.col(c)] if parts else [F.col(c)]
    return df.withColumn("text", F.concat(*parts))


def strip_chars(df: DataFrame, col: str, chars: str) -> DataFrame:
    return df.withColumn(col, strip_chars_of(col, chars))


def record_holders(lexicon: DataFrame, order: str = "token_id", rows_per_bucket: int | None = None) -> DataFrame:
    """Rows whose definition has more words than every earlier row's: word, n_words."""
    sized = lexicon.select(order, "word", word_count("definition").alias("n_words"))
    best = running_max(sized, F.col(order), [F.col(order)], F.col("n_words"), "__best", rows_per_bucket)
    return best.where(F.col("__best").isNull() | (F.col("n_words") > F.col("__best"))).select("word", "n_words")


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of every key in `order`; one candidate per key and task is shuffled."""
    cols = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*cols), order)
    return df.groupBy(key).agg(last.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


