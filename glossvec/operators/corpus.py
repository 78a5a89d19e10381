"""Training-corpus jobs: batches, chunks, masks, shuffles, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.constants import IGNORED_LABEL, MASK_ID
from glossvec.functions.hashing import chance, draw, order_key
from glossvec.plans.joins import measured_bytes
from glossvec.plans.lookups import TOKENS_AT_A_TIME, as_list, list_parts, row_slices
from glossvec.plans.ordering import ROWS_PER_BUCKET, global_rank, running_total

# Bytes of text that are ranked in one range.
RANGE_BYTES = 64 << 20


def corpus_batches(documents: DataFrame, size: int = 1000, key: str = "doc_id") -> DataFrame:
    """Consecutive batches in key order, null keys first: batch_id, key, text.

    Texts are ranked with their keys, so a range holds about RANGE_BYTES of them.
    """
    held = documents.select(key, "text")
    n = held.count()
    per_range = min(ROWS_PER_BUCKET, max(1, RANGE_BYTES * n // max(1, measured_bytes(held))))
    ranked = global_rank(held, F.col(key), [F.xxhash64("text")], "__at", per_range)
    return ranked.select(F.floor(F.col("__at") / size).cast("bigint").alias("batch_id"), key, "text")


def group_texts(
    seq: DataFrame,
    chunk: int = 128,
    key: str = "doc_id",
    ids: str = "ids",
    group_key: str | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Concatenate sequences in key order and cut into full chunks: chunk, input_ids[], labels[].

    `group_key` restarts the concatenation for every value of that column,
    dropping each group's remainder. Sequences are cut at chunk borders where
    they lie; a piece that fills its chunk stays in its task, and only the
    pieces at the two ends of a sequence are shuffled.
    """
    groups = [group_key] if group_key else []
    # Only keys and lengths are ordered; the sequences themselves meet their place by key.
    sizes = seq.select(*groups, key, F.size(ids).alias("__n"))
    starts = running_total(sizes, F.col(key), [F.col(key)], F.col("__n"), "__at", rows_per_bucket, within=groups)
    rows = seq.select(*groups, key, F.col(ids).alias("__ids"))
    placed = rows.join(starts.where("__n > 0").select(key, "__at"), key)
    width = F.lit(chunk)
    first = F.floor(F.col("__at") / width)
    last = F.floor((F.col("__at") + F.size("__ids") - 1) / width)
    cut = placed.select(*groups, "__at", "__ids", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("chunk") * width - F.col("__at"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * width - F.col("__at"), F.size("__ids"))
    pieces = cut.select(
        *groups,
        F.col("chunk").cast("bigint").alias("chunk"),
        (F.col("__at") + begin).alias("__p"),
        F.slice("__ids", (begin + 1).cast("int"), (end - begin).cast("int")).alias("__s"),
    )
    whole = pieces.where(F.size("__s") == chunk).select(*groups, "chunk", F.col("__s").alias("input_ids"))
    ordered = F.array_sort(F.collect_list(F.struct("__p", "__s")))
    merged = (
        pieces.where(F.size("__s") < chunk)
        .groupBy(*groups, "chunk")
        .agg(F.flatten(F.transform(ordered, lambda z: z["__s"])).alias("input_ids"))
        .where(F.size("input_ids") == chunk)
    )
    return whole.unionByName(merged).withColumn("labels", F.col("input_ids"))


def mlm_mask(token_rows: DataFrame, p: float = 0.15, seed: int = 42, vocab_size: int | None = None) -> DataFrame:
    """Mask tokens with probability p: doc_id, pos, input_id, label.

    Of the chosen, 80 % become the mask, 10 % a random id below `vocab_size`,
    10 % stay. The choice is a hash of (seed, doc, pos).
    """
    key = order_key(seed, "doc_id", "pos")
    chosen = chance(key, p, 1)
    fate = F.substring(key, 5, 4)
    random_id = draw(key, F.lit(vocab_size), 9) if vocab_size else F.col("id")
    changed = F.when(fate < "cccd", F.lit(MASK_ID).cast("bigint")).when(fate < "e666", random_id).otherwise(F.col("id"))
    return token_rows.select(
        "doc_id",
        "pos",
        F.when(chosen, changed).otherwise(F.col("id")).alias("input_id"),
        F.when(chosen, F.col("id")).otherwise(F.lit(IGNORED_LABEL).cast("bigint")).alias("label"),
    )


def whole_word_mask(
    seq: DataFrame, p: float = 0.2, seed: int = 42, key: str = "doc_id", ids: str = "ids", word_ids: str = "word_ids"
) -> DataFrame:
    """Choose words and mask all their tokens: doc_id, pos, input_id, label.

    `seq` holds the ids of a sequence and the word id of each; a null word id
    is never masked. A word is a run of equal word ids. The run index is
    carried through the sequence inside its row, so no row is shuffled.
    """
    rows = seq.select(key, F.col(ids).alias("i"), F.col(word_ids).alias("w"), _run_index(F.col(word_ids)).alias("run"))
    each = rows.select(key, F.posexplode(F.arrays_zip("i", "w", "run")).alias("pos", "z"))
    chosen = F.col("z.w").isNotNull() & chance(order_key(seed, key, F.col("z.run")), p)
    return each.select(
        key,
        F.col("pos").cast("bigint").alias("pos"),
        F.when(chosen, F.lit(MASK_ID).cast("bigint")).otherwise(F.col("z.i")).alias("input_id"),
        F.when(chosen, F.col("z.i")).otherwise(F.lit(IGNORED_LABEL).cast("bigint")).alias("label"),
    )


def _run_index(word_ids: Column) -> Column:
    """0-based index of the run of equal non-null word ids that every position belongs to."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            held = np.asarray(pc.fill_null(pc.list_value_length(batch), 0)).astype(np.int64)
            for lo, hi in row_slices(held, TOKENS_AT_A_TIME):
                values, lengths = list_parts(batch.slice(lo, hi - lo))
                known = np.asarray(pc.is_valid(values))
                rows = np.repeat(np.arange(len(lengths)), lengths)
                here, owner = np.asarray(values.drop_null()), rows[known]
                fresh = np.ones(len(here), dtype=np.int64)
                if len(here) > 1:
                    fresh[1:] = (here[1:] != here[:-1]) | (owner[1:] != owner[:-1])
                count = np.cumsum(fresh)
                first = np.searchsorted(owner, owner, side="left")
                index = np.full(len(rows), -1, dtype=np.int64)
                index[known] = count - (count[first] if len(count) else 0)
                yield as_list(pa.array(index), lengths)

    return runs(word_ids)


def fixed_eval_mask(token_rows: DataFrame, p: float = 0.15, seed: int = 42, vocab_size: int | None = None) -> DataFrame:
    """Masks drawn once, under the names an evaluation reads: doc_id, pos, masked_input_ids, masked_labels."""
    masked = mlm_mask(token_rows, p, seed, vocab_size)
    return masked.withColumnsRenamed({"input_id": "masked_input_ids", "label": "masked_labels"})


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded row order: adds `ord`, the key to sort by (ties by `key`)."""
    return df.withColumn("ord", order_key(seed, key))


def _place(df: DataFrame, key: str, seed: int, out: str, rows_per_bucket: int | None = None) -> DataFrame:
    keyed = df.withColumn("__h", order_key(seed, key))
    return global_rank(keyed, F.col("__h"), [F.col(key)], out, rows_per_bucket).drop("__h")


def train_test_split(
    df: DataFrame, key: str, n_train: int, n_test: int, seed: int = 42, rows_per_bucket: int | None = None
) -> DataFrame:
    """Exactly `n_train` and `n_test` rows in seeded order; the rest is left out."""
    at = _place(df, key, seed, "__at", rows_per_bucket)
    part = F.when(F.col("__at") < n_train, "train").when(F.col("__at") < n_train + n_test, "test")
    return at.withColumn("split", part).where(F.col("split").isNotNull()).drop("__at")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows: the first n of the seeded order."""
    return shuffle(df, key, seed).orderBy("ord", key).limit(n).drop("ord")
