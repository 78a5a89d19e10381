"""Pooling and standardising vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.functions.vectors import l2_norm
from glossvec.plans.fetching import vector_parts
from glossvec.plans.joins import block_of, fits_broadcast, lookup_join, measured_bytes, vector_blocks
from glossvec.plans.lookups import as_list, first_by_word, list_parts, row_slices, unique_words, with_token_ids
from glossvec.session import stored_table

#: Stands for a word without an id; no vocabulary has it.
NO_WORD = -(1 << 62)
# Words of definitions that are looked up at a time.
WORDS_AT_A_TIME = 1 << 20
# Blocks of vectors up to which the words of definitions are coded again for each instead of being stored.
RECODED = 2


def gather_vectors(
    ids: DataFrame, vectors: DataFrame, on: str = "token_id", unknown: list[float] | None = None, limit: int | None = None
) -> DataFrame:
    """Attach the matrix row of every id. An id without one gives no row, or the vector `unknown` if there is one.

    A matrix beyond the broadcast limit is first cut to the ids that are asked for. These are gone through several times
    then, so they are written once to the checkpoint folder.
    """
    side = vectors.select(F.col("token_id").alias(on), "v")
    if not fits_broadcast(side, limit):
        ids = stored_table(ids, "asked-ids")
        side = lookup_join(side, ids.select(on).distinct(), on, "left_semi", limit)
    if unknown is None:
        return lookup_join(ids, side, on, limit=limit)
    return lookup_join(ids, side, on, "left", limit).withColumn("v", F.coalesce("v", F.array(*[F.lit(float(x)) for x in unknown])))


def mean_vector(df: DataFrame, key: str, vec: str = "v", weight: str | None = None) -> DataFrame:
    """Element-wise mean per key. Partial sums are formed before the shuffle, so a hot key is one row per task."""
    packed = array_to_vector(F.col(vec))
    mean = Summarizer.mean(packed, F.col(weight).cast("double")) if weight else Summarizer.mean(packed)
    return df.groupBy(key).agg(vector_to_array(mean).alias("v"))


def definition_vectors(
    definitions: DataFrame, vocab: DataFrame, vectors: DataFrame, limit: int | None = None, key: str = "token_id"
) -> DataFrame:
    """Mean of the vectors of a definition's in-vocabulary words: key, v.

    `definitions` holds one row per unique key with its `tokens` array. While
    vocabulary and matrix fit the broadcast limit nothing is shuffled. Beyond
    it the vectors travel in slices of their dimensions, a slice is summed over
    the words of every definition where it lies, and only these sums are
    shuffled, each dimension of a definition once however many slices there
    are: no word of a definition is ever a row with a vector.
    A repeated word has its lowest id; that id needs a vector to count.
    Definitions without a known word give no row.
    """
    if fits_broadcast(vocab.select("word", "token_id"), limit) and fits_broadcast(vectors, limit):
        return _pooled_in_place(definitions, vocab, vectors, key)
    return _pooled_by_blocks(definitions, vocab, vectors, limit, key)


def _pooled_by_blocks(definitions: DataFrame, vocab: DataFrame, vectors: DataFrame, limit: int | None, key: str) -> DataFrame:
    side = vectors.where("v IS NOT NULL").select("token_id", "v")
    blocks, width = vector_blocks(vectors, limit), side.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1
    cuts = [width * i // min(blocks, width) for i in range(min(blocks, width) + 1)]
    row_blocks = -(-blocks // (len(cuts) - 1))  # more than one only where a single dimension is beyond the limit
    coded = _known_ids(definitions, vocab, limit, key)
    if blocks > RECODED:
        coded = stored_table(coded, "word-ids")
    parts = []
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        some = side.withColumn("v", F.slice("v", lo + 1, hi - lo))
        parts += [_block_sums(coded, block_of(some, b, row_blocks), key, part) for b in range(row_blocks)]
    kind = definitions.schema[key].dataType.simpleString()
    together = reduce(DataFrame.unionByName, parts).repartition(key).sortWithinPartitions(key, "part")
    return together.mapInArrow(_means_of_sums(cuts), f"`{key}` {kind}, v array<double>")


def _known_ids(definitions: DataFrame, vocab: DataFrame, limit: int | None, key: str) -> DataFrame:
    """Ids of a definition's words, in any order: key, ids[]. A word that is not known has none, or NO_WORD."""
    if fits_broadcast(vocab.select("word", "token_id"), limit):
        return with_token_ids(definitions.select(key, "tokens"), F.col("tokens"), vocab, "ids", NO_WORD, key).select(key, "ids")
    rows = definitions.select(key, F.explode("tokens").alias("tok"))
    names = unique_words(vocab).select(F.col("word").alias("tok"), F.col("token_id").alias("id"))
    return lookup_join(rows, names, "tok", limit=limit).groupBy(key).agg(F.collect_list("id").alias("ids"))


def _block_sums(coded: DataFrame, block: DataFrame, key: str, number: int = 0) -> DataFrame:
    """Sum of the vectors that a block has for a definition's words, and their number: key, part (the block's number), v, n."""
    parts = list(vector_parts(block, measured_bytes(block)))
    ids, at = np.unique(np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64), return_inverse=True)
    matrix, lo = np.zeros((len(ids), parts[0][1].shape[1] if parts else 0)), 0
    parts.reverse()
    while parts:  # a part is let go when it is in the matrix
        _, m = parts.pop()
        np.add.at(matrix, at[lo : lo + len(m)], m)  # an id with two vectors counts both
        lo += len(m)
    copies = np.bincount(at, minlength=len(ids)).astype(float)
    shipped = coded.sparkSession.sparkContext.broadcast((pa.array(ids, pa.int64()), matrix, copies))

    def add(batches):
        names, m, copies = shipped.value
        width = m.shape[1]
        if len(names) == 0:
            return
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for lo, hi in row_slices(lengths, WORDS_AT_A_TIME):
                part = batch.slice(lo, hi - lo)
                rows, ids, n = _word_counts(part.column(1), names)
                total = _weighted_sums(m, rows, ids, n, part.num_rows)
                weight = np.bincount(rows, weights=n * copies[ids], minlength=part.num_rows)
                keep = np.flatnonzero(weight > 0)
                vecs = as_list(pa.array(total[keep].ravel()), np.full(len(keep), width))
                columns = [part.column(0).take(pa.array(keep)), pa.array(np.full(len(keep), number, np.int32)), vecs, pa.array(weight[keep].astype(float))]
                yield pa.RecordBatch.from_arrays(columns, [key, "part", "v", "n"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, "ids").mapInArrow(add, f"`{key}` {kind}, part int, v array<double>, n double")


def _means_of_sums(cuts: list[int]):
    """Whole means of sums over slices of the dimensions, sorted by key; the sum of one key is held between batches."""

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            name, keys, part = batch.schema.names[0], batch.column(0).to_pylist(), batch.column(1).to_numpy()
            first = np.array([i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]])
            row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
            values, lengths = list_parts(batch.column(2))
            flat, start = values.to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            sums, n = np.zeros((len(first), cuts[-1])), np.bincount(row, weights=(part == 0) * batch.column(3).to_numpy())
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                new = np.flatnonzero(np.r_[True, np.diff(row[at]) > 0])
                cells = flat[start[at][:, None] + np.arange(cuts[p + 1] - cuts[p])]
                sums[row[at][new], cuts[p] : cuts[p + 1]] = np.add.reduceat(cells, new, axis=0)
            if held is not None and held[0].to_pylist()[0] == keys[0]:
                sums[0] += held[1][0]
                n[0] += held[2][0]
            elif held is not None:
                yield _means(name, *held)
            yield _means(name, batch.column(0).take(pa.array(first[:-1], pa.int64())), sums[:-1], n[:-1])
            held = batch.column(0).take(pa.array(first[-1:], pa.int64())), sums[-1:].copy(), n[-1:].copy()
        if held is not None:
            yield _means(name, *held)

    return run


def _means(name: str, keys: pa.Array, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, as_list(pa.array((sums / n[:, None]).ravel()), np.full(len(n), sums.shape[1]))], [name, "v"])


def _word_counts(tokens, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in `names` and count of every known word of every row, by row."""
    values, lengths = list_parts(tokens)
    at = pc.index_in(values.cast(names.type), value_set=names)
    known = np.asarray(pc.is_valid(at))
    rows = np.repeat(np.arange(len(lengths)), lengths)[known]
    ids = np.asarray(at.drop_null()).astype(np.int64)
    cells, n = np.unique(rows * len(names) + ids, return_counts=True)
    return cells // max(1, len(names)), cells % max(1, len(names)), n


def _weighted_sums(m: np.ndarray, rows: np.ndarray, ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros((size, m.shape[1]))
    step = max(1, (32 << 20) // (8 * m.shape[1]))  # entries expanded to vectors at a time
    for s in range(0, len(rows), step):
        r, w = rows[s : s + step], n[s : s + step]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        total[r[first]] += np.add.reduceat(m[ids[s : s + step]] * w[:, None], first, axis=0)
    return total


def _pooled_in_place(definitions: DataFrame, vocab: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    table = vocab.select("word", "token_id").join(vectors.select("token_id", "v"), "token_id", "left").toArrow().sort_by("token_id")
    table = first_by_word(table)
    words = table.column("word").combine_chunks().cast(pa.string())
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = values.reshape(len(words), -1) if len(words) else np.zeros((0, 1))
    shipped = definitions.sparkSession.sparkContext.broadcast((words, matrix))

    def pool(batches):
        names, m = shipped.value
        width = m.shape[1]
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for lo, hi in row_slices(lengths, WORDS_AT_A_TIME):
                part = batch.slice(lo, hi - lo)
                rows, ids, n = _word_counts(part.column(1), names)
                total = _weighted_sums(m, rows, ids, n, part.num_rows)
                weight = np.bincount(rows, weights=n, minlength=part.num_rows)
                keep = np.flatnonzero(weight > 0)
                mean = total[keep] / weight[keep, None]
                vecs = as_list(pa.array(mean.ravel()), np.full(len(keep), width))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), vecs], [key, "v"])

    kind = definitions.schema[key].dataType.simpleString()
    return definitions.select(key, "tokens").mapInArrow(pool, f"{key} {kind}, v array<double>")


def char_mean_word_vector(lexicon: DataFrame, char_vectors: DataFrame) -> DataFrame:
    """Mean of the vectors of a word's known characters: word, v."""
    rows = lexicon.select("word", F.explode(F.split("word", "")).alias("ch"))
    counted = rows.groupBy("word", "ch").agg(F.count("*").alias("n"))
    return mean_vector(lookup_join(counted, char_vectors.select("ch", "v"), "ch"), "word", weight="n")


def gather_positions(
    seq: DataFrame, positions: DataFrame, vectors: DataFrame, key: str = "doc_id", unknown: list[float] | None = None, limit: int | None = None
) -> DataFrame:
    """Vectors of a sequence at target positions, with the word ids there: key, pos, id, v.

    `seq` holds (key, ids[]) and `positions` (key, positions[]); only the
    wanted positions are expanded. A position beyond the sequence gives no row; one
    of an unknown word has the vector `unknown`, or no row where none is given.
    """
    wanted = seq.select(key, "ids").join(positions.select(key, "positions"), key)
    rows = wanted.select(key, "ids", F.explode("positions").alias("pos"))
    at = F.try_element_at("ids", (F.col("pos") + 1).cast("int"))
    found = rows.select(key, F.col("pos").cast("bigint").alias("pos"), at.alias("id"))
    return gather_vectors(found.where(F.col("id").isNotNull()), vectors, "id", unknown, limit).select(key, "pos", "id", "v")


def first_token_pool(seq: DataFrame, vectors: DataFrame, key: str = "doc_id", unknown: list[float] | None = None) -> DataFrame:
    """Vector of the first token of every sequence that has one: key, v. An unknown token has the vector `unknown` if there is one."""
    first = seq.where(F.size("ids") > 0).select(key, F.try_element_at("ids", F.lit(1)).alias("id"))
    return gather_vectors(first, vectors, "id", unknown).select(key, "v")


def vectors_long(df: DataFrame, key: str = "token_id", vec: str = "v") -> DataFrame:
    """Vector row to one row per entry: key, i, x."""
    return df.select(key, F.posexplode(vec).alias("i", "x")).withColumn("i", F.col("i").cast("bigint"))


def vectors_wide(rows: DataFrame, key: str = "token_id") -> DataFrame:
    """One row per entry back to one vector per key."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return rows.groupBy(key).agg(F.transform(ordered, lambda z: z["x"]).alias("v"))


def global_standardise(vectors: DataFrame) -> DataFrame:
    """(x - mean) / std with one scalar mean and sample std over all entries."""
    stats = vectors.select(F.explode("v").alias("x")).agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")
    )
    marked = vectors.withColumn("__m", stats.select("mean").scalar()).withColumn("__s", stats.select("std").scalar())
    return marked.select("token_id", F.transform("v", lambda x: (x - F.col("__m")) / F.col("__s")).alias("v"))


def dimension_standardise(vectors: DataFrame, eps: float = 1e-5) -> DataFrame:
    """(x - mean_i) / sqrt(var_i + eps) per dimension, population variance."""
    per_dim = vectors_long(vectors).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m", "s")))
    stats = per_dim.agg(ordered.alias("st"))  # one row, one entry per dimension
    marked = vectors.withColumn("__st", stats.scalar())
    scaled = F.zip_with("v", "__st", lambda x, z: (x - z["m"]) / F.sqrt(z["s"] + F.lit(eps)))
    return marked.select("token_id", scaled.alias("v"))


def per_dimension_squared_gap(df: DataFrame, q: list[float] | DataFrame) -> DataFrame:
    """Per dimension, the sum over rows of the squared gap to one query vector: i, gap."""
    if isinstance(q, DataFrame):
        marked = df.withColumn("__q", q.select("v").scalar())
    else:
        marked = df.withColumn("__q", F.array(*[F.lit(float(x)) for x in q]))
    gaps = marked.select(F.posexplode(F.zip_with("v", "__q", lambda x, y: (x - y) * (x - y))).alias("i", "g"))
    return gaps.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.sum("g").alias("gap"))


def mse(a: DataFrame, b: DataFrame, on: str = "token_id") -> DataFrame:
    """Mean over all elements of the squared difference of paired vectors."""
    pairs = a.select(on, F.col("v").alias("x")).join(b.select(on, F.col("v").alias("y")), on)
    gaps = pairs.select(F.explode(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y))).alias("g"))
    return gaps.agg(F.avg("g").alias("mse"))


def norm_shrink_rate(a: DataFrame, b: DataFrame, on: str = "token_id") -> DataFrame:
    """Share of words whose norm in `a` exceeds the norm in `b`."""
    na = a.select(on, l2_norm("v").alias("na"))
    nb = b.select(on, l2_norm("v").alias("nb"))
    return na.join(nb, on).agg(F.avg((F.col("na") > F.col("nb")).cast("double")).alias("rate"))


def sheet_lookup(tokens: DataFrame, sheet: DataFrame, strict: bool = True, col: str = "word") -> DataFrame:
    """Vector of every token from a sheet. Strict: a missing token fails the query; else it is dropped."""
    side = sheet.select(col, "v")
    if not strict:
        return lookup_join(tokens, side, col)
    found = lookup_join(tokens, side, col, "left")
    message = F.concat(F.lit("no sheet vector for "), F.coalesce(col, F.lit("null")))
    checked = F.when(F.col("v").isNull(), F.raise_error(message).cast("array<double>")).otherwise(F.col("v"))
    return found.withColumn("v", checked)


def patch_band_vectors(
    vectors: DataFrame, sheet: DataFrame, lexicon: DataFrame, lo: float, hi: float
) -> DataFrame:
    """Replace the vectors of band words by the sheet's; all others stay."""
    band = lexicon.where((F.col("norm") > lo) & (F.col("norm") < hi)).select("token_id", "word").distinct()
    new = band.join(sheet.select("word", F.col("v").alias("v_new")), "word").select("token_id", "v_new")
    return vectors.join(new, "token_id", "left").select("token_id", F.coalesce("v_new", "v").alias("v"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("token_id", l2_norm("v").alias("norm"))

