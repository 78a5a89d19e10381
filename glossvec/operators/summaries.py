"""Descriptions, histograms, losses and profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.functions.text import word_runs
from glossvec.operators.vocabulary import token_rows, word_frequencies
from glossvec.plans.joins import lookup_join
from glossvec.plans.lookups import as_list, list_parts, row_slices
from glossvec.plans.ordering import ROWS_PER_BUCKET, exact_quantiles
from glossvec.session import stored_table

#: Words whose losses travel to the tasks.
FREQUENT_WORDS = 250_000
# Words that are looked up at a time.
WORDS_AT_A_TIME = 1 << 20


def describe_column(df: DataFrame, col: str, rows_per_bucket: int | None = None, rows: int | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max.

    `rows` is a bound of the rows if one is known; up to the bucket size all
    figures then come from one pass.
    """
    x = F.col(col)
    if rows is not None and rows <= (rows_per_bucket or ROWS_PER_BUCKET):
        at = F.percentile(x.cast("double"), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
        q = [at[i] for i in range(3)]
    else:
        q = [F.lit(v) for v in exact_quantiles(df, col, [0.25, 0.5, 0.75], rows_per_bucket)]
    return df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).cast("double").alias("min"),
        *[v.cast("double").alias(n) for v, n in zip(q, ("p25", "p50", "p75"))],
        F.max(x).cast("double").alias("max"),
    )


def describe_first_n(df: DataFrame, order: str, col: str, n: int = 100) -> DataFrame:
    """Description of the first `n` rows of an ordering, ties by the described value."""
    return describe_column(df.orderBy(order, col).limit(n).select(col), col, rows=n)


def norm_histogram(lexicon: DataFrame, col: str = "norm", bins: int = 10) -> DataFrame:
    """Equal-width histogram: bin, lo, hi, n. The last bin is closed; empty bins are listed."""
    ends = lexicon.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    a, b = ends["a"], ends["b"]
    spark = lexicon.sparkSession
    if a is None:
        return spark.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    width = (b - a) / bins or 1.0
    at = F.least(F.floor((F.col(col) - F.lit(a)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = lexicon.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = spark.range(bins).withColumnRenamed("id", "bin")
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(a) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(a) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Per column its type and its number of non-null values, from one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"`{c}`").alias("non_null"))
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*entries)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of second and later copies of fully equal rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0).cast("bigint")).alias("n_extra"))


def perplexity(df: DataFrame, loss: str = "loss", by: str | None = None) -> DataFrame:
    """exp(mean loss); an overflow gives infinity."""
    grouped = df.groupBy(by) if by else df
    return grouped.agg(F.exp(F.avg(loss)).alias("ppl"))


def running_mean_loss(df: DataFrame, step: str = "step", loss: str = "loss", every: int = 200) -> DataFrame:
    """Mean loss of every block of `every` steps: block, loss."""
    block = F.floor(F.col(step) / every).cast("bigint")
    return df.groupBy(block.alias("block")).agg(F.avg(loss).alias("loss"))


def unigram_counts(documents: DataFrame, by: str) -> DataFrame:
    """Count of every word per group, with its loss -log p over all groups: by, w, n, loss."""
    # The filter keeps nothing out; with it all three uses below share one exchange.
    rows = token_rows(documents, key=by).where(F.col("tok").isNotNull())
    counts = rows.groupBy(by, F.col("tok").alias("w")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("w").agg(F.sum("n").alias("nw"))
    total = counts.agg(F.sum("n")).scalar()
    losses = totals.withColumn("loss", -F.log(F.col("nw") / total)).select("w", "loss")
    # A frequent word has a row in nearly every group.
    return lookup_join(counts, losses, "w")


def corpus_perplexity(documents: DataFrame, by: str) -> DataFrame:
    """exp of the mean unigram loss per group. Words are counted per group first, so a frequent word is one row each."""
    mean = F.sum(F.col("n") * F.col("loss")) / F.sum("n")
    return unigram_counts(documents, by).groupBy(by).agg(F.exp(mean).alias("ppl"))



def mean_word_losses(documents: DataFrame, key: str = "doc_id", frequent: int = FREQUENT_WORDS) -> DataFrame:
    """Mean over a group's words of their loss -log p over all documents: key, loss.

    The `frequent` most frequent words travel to the tasks, which sum them where
    the text lies. Only the other words of a document are rows that are shuffled.
    """
    words = stored_table(word_frequencies(documents).where("w IS NOT NULL"), "word-counts")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    losses = words.withColumn("loss", -F.log(F.col("n") / F.lit(total)))
    top = losses.orderBy(F.desc("n"), "w").limit(frequent).select("w", "loss").toArrow()
    known = top.column("w").combine_chunks().cast(pa.string()), top.column("loss").combine_chunks().to_numpy()
    shipped = documents.sparkSession.sparkContext.broadcast(known)

    def add(batches):
        names, loss = shipped.value
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for lo, hi in row_slices(lengths, WORDS_AT_A_TIME):
                part = batch.slice(lo, hi - lo)
                values, n = list_parts(part.column(1))
                at = pc.index_in(values.cast(pa.string()), value_set=names)
                held = np.asarray(pc.is_valid(at))
                owner = np.repeat(np.arange(part.num_rows), n)
                sums = np.bincount(owner[held], weights=loss[np.asarray(at.drop_null())], minlength=part.num_rows)
                counts = np.bincount(owner[held], minlength=part.num_rows)
                others = np.bincount(owner[~held], minlength=part.num_rows)
                rare = as_list(values.filter(pa.array(~held)).cast(pa.string()), others)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums.astype(float)), pa.array(counts), rare], [key, "s", "n", "rare"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, word_runs("text").alias("tokens")).mapInArrow(add, f"`{key}` {kind}, s double, n bigint, rare array<string>")
    summed = stored_table(rows, "word-losses")
    counts = summed.select(key, F.explode("rare").alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    rare = lookup_join(counts, losses.select("w", "loss"), "w").select(key, (F.col("loss") * F.col("n")).alias("s"), "n")
    both = summed.where("n > 0").select(key, "s", "n").unionByName(rare)
    return both.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("loss"))
