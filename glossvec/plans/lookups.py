"""Array-wise vocabulary lookup inside a task, for vocabularies under the broadcast limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.plans.joins import fits_broadcast, lookup_join


# Tokens of a batch that are encoded at a time.
TOKENS_AT_A_TIME = 1 << 18
# Tokens of a batch whose distinct words are looked up together: a lookup hashes the whole vocabulary anew.
CODED_AT_A_TIME = 1 << 23
# Bytes of texts that are split into words at a time.
BYTES_AT_A_TIME = 1 << 24


def list_parts(col) -> tuple[pa.Array, np.ndarray]:
    """Flattened values and row lengths of an Arrow list column (null rows count as empty)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    return col.flatten(), lengths


def as_list(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def row_slices(lengths: np.ndarray, most: int):
    """Consecutive rows of about `most` items together, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def vocabulary_arrays(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Words and ids on the driver, lowest id first. Call only behind `fits_broadcast`."""
    table = vocab.select("word", "token_id").toArrow().sort_by("token_id")
    words = table.column("word").combine_chunks().cast(pa.string())
    return words, table.column("token_id").combine_chunks().cast(pa.int64())


def first_by_word(table: pa.Table) -> pa.Table:
    """The first row of every word of a sorted table, if it has a vector."""
    words = table.column("word").combine_chunks()
    first = pc.equal(pc.index_in(words, value_set=words), pa.array(np.arange(len(words)), pa.int32())) if len(words) else pa.array([], pa.bool_())
    return table.filter(pc.and_(first, pc.is_valid(table.column("v").combine_chunks()))) if len(words) else table


def unique_words(vocab: DataFrame) -> DataFrame:
    """word, token_id: a repeated word has its lowest id, whatever the size of the vocabulary."""
    return vocab.groupBy("word").agg(F.min("token_id").alias("token_id"))


def words_of(ids: Column, vocab: DataFrame, unknown: str = "[UNK]") -> Column:
    """Words of an array of ids, in the task. Call only behind `fits_broadcast`."""
    shipped = vocab.sparkSession.sparkContext.broadcast(vocabulary_arrays(vocab))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def decode(col: pa.Array) -> pa.Array:
        names, numbers = shipped.value
        values, lengths = list_parts(col)
        at = pc.index_in(values.cast(pa.int64()), value_set=numbers)
        return as_list(pc.fill_null(pc.take(names, at), unknown), lengths)

    return decode(ids)


def numbers_of(values: pa.Array, names: pa.Array, numbers: pa.Array, unk: int) -> np.ndarray:
    """The number of every value, by its place in `names`, or `unk`."""
    found = np.empty(len(values), np.int64)
    for s in range(0, len(values), CODED_AT_A_TIME):
        part = values.slice(s, CODED_AT_A_TIME).cast(pa.string()).dictionary_encode(null_encoding="encode")
        known = pc.fill_null(pc.take(numbers, pc.index_in(part.dictionary, value_set=names)), unk)
        found[s : s + len(part)] = np.asarray(known)[np.asarray(part.indices)]
    return found


def places_of(texts: Column, names: DataFrame, first: int = 0) -> Column:
    """Places of the words of a text that are in `names`, in the task: the first of its whitespace-separated words has `first`.

    `names` holds words in its only column. A null text has no places. Call only behind `fits_broadcast`.
    """
    shipped = names.sparkSession.sparkContext.broadcast(names.toArrow().column(0).combine_chunks().cast(pa.string()))

    def found(col: pa.Array) -> pa.Array:
        tokens, lengths = list_parts(pc.ascii_split_whitespace(col))
        is_word = np.asarray(pc.greater(pc.binary_length(tokens), 0))  # a space at an end leaves an empty item
        hits = np.flatnonzero(np.asarray(pc.is_in(tokens, value_set=shipped.value)) & is_word)
        before, ends = np.cumsum(is_word) - is_word, np.cumsum(lengths)
        rows = np.searchsorted(ends, hits, side="right")
        place = before[hits] - before[(ends - lengths)[rows]] + first
        return as_list(pa.array(place, pa.int64()), np.bincount(rows, minlength=len(lengths)))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def places(col: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        parts = [found(col.slice(lo, hi - lo).cast(pa.string())) for lo, hi in row_slices(sizes, BYTES_AT_A_TIME)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return places(texts)


def with_token_ids(
    df: DataFrame,
    tokens: Column,
    vocab: DataFrame,
    out: str = "ids",
    unk: int = -1,
    key: str = "doc_id",
    limit: int | None = None,
) -> DataFrame:
    """Add `out`, the ids of an array of tokens in order, unknown tokens as `unk`. A repeated word has its lowest id.

    Under the size limit the vocabulary travels to the tasks and no row is
    shuffled. Beyond it the tokens are exploded, joined and put back by `key`,
    which must be unique per row.
    """
    named = df.withColumn("__toks", tokens)
    if fits_broadcast(vocab.select("word", "token_id"), limit):
        words, ids = vocabulary_arrays(vocab)
        shipped = df.sparkSession.sparkContext.broadcast((words, ids))

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def encode(col: pa.Array) -> pa.Array:
            values, lengths = list_parts(col)
            return as_list(pa.array(numbers_of(values, *shipped.value, unk)), lengths)

        return named.withColumn(out, encode("__toks")).drop("__toks")
    names = unique_words(vocab).select(F.col("word").alias("__tok"), F.col("token_id").alias("__id"))
    rows = named.select(key, F.posexplode("__toks").alias("__pos", "__tok"))
    found = lookup_join(rows, names, "__tok", "left", limit)
    item = F.struct("__pos", F.coalesce("__id", F.lit(unk).cast("bigint")).alias("i"))
    packed = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda z: z["i"]).alias(out))
    empty = F.array().cast("array<bigint>")
    return named.drop("__toks").join(packed, key, "left").withColumn(out, F.coalesce(out, empty))
