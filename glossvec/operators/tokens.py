"""Pre-tokenising, special tokens, truncation, padding and alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossvec.constants import CLS_ID, CONTINUATION, PAD_ID, SEP_ID, SPACE_MARK, UNK_ID
from glossvec.functions.text import PUNCT_ONE, PUNCT_RUN, WORD_RUN
from glossvec.plans.lookups import list_parts, row_slices, with_token_ids
from glossvec.plans.ordering import global_rank

# Token patterns by mode: word or punctuation runs; every mark alone; runs with their leading space.
TOKEN_PATTERNS = {
    "punct": f"{WORD_RUN}|{PUNCT_RUN}",
    "bert": f"{WORD_RUN}|{PUNCT_ONE}",
    "space": rf" ?{WORD_RUN}| ?{PUNCT_RUN}|\s+",
}


def pretokens(text, mode: str = "punct") -> Column:
    """Array of pre-tokens of a text."""
    col = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(col, F.lit(TOKEN_PATTERNS[mode]), F.lit(0))
    return F.transform(found, lambda t: F.translate(t, " ", SPACE_MARK)) if mode == "space" else found


def pretokenise(documents: DataFrame, mode: str = "punct", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pre-tokens with 0-based position and character span: key, pos, tok, start, end.

    The pattern also matches the whitespace between tokens, so offsets are
    running lengths inside one array: they are summed where the text lies, and
    nothing is shuffled.
    """
    gaps = TOKEN_PATTERNS[mode] if mode == "space" else TOKEN_PATTERNS[mode] + r"|\s+"
    pieces = F.regexp_extract_all(F.col(text), F.lit(gaps), F.lit(0)).alias("pieces")
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, pieces).mapInArrow(_offsets(mode == "space"), f"`{key}` {kind}, pos bigint, tok string, start bigint, end bigint")
    return rows.withColumn("tok", F.translate("tok", " ", SPACE_MARK)) if mode == "space" else rows


# Pieces that are laid out at a time: rows of a batch expand to one per token.
PIECES_AT_A_TIME = 1 << 18


def _offsets(keep_gaps: bool):
    def run(batches):
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0)).astype(np.int64)
            for lo, hi in row_slices(lengths, PIECES_AT_A_TIME):
                part = batch.slice(lo, hi - lo)
                values, n = list_parts(part.column(1))
                size = np.asarray(pc.utf8_length(values)).astype(np.int64)
                real = np.ones(len(values), bool) if keep_gaps else ~np.asarray(pc.match_substring_regex(values, "^[ \t\n\x0b\x0c\r]+$"))
                owner = np.repeat(np.arange(len(n)), n)
                first = np.repeat(np.cumsum(n) - n, n)
                ends, seen = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(real)])
                at = np.flatnonzero(real)
                take = pa.array(at)
                columns = [seen[at] - seen[first[at]], values.take(take), ends[at] - ends[first[at]], ends[at + 1] - ends[first[at]]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[at])), *[c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns]],
                    [batch.schema.names[0], "pos", "tok", "start", "end"])

    return run


def token_offsets(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return pretokenise(documents, "punct", key).select(key, "pos", "start", "end")


def _ids(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value).cast("bigint"), n.cast("int"))


def _model_inputs(key: str, ids: Column, types: Column) -> list[Column]:
    return [F.col(key), ids.alias("input_ids"), types.alias("token_type_ids"), _ids(F.size(ids), 1).alias("attention_mask")]


def _special(value: int) -> Column:
    return F.array(F.lit(value).cast("bigint"))


def add_special_tokens(seq: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`[CLS] A [SEP]`, all of type 0."""
    whole = F.concat(_special(CLS_ID), F.col(ids), _special(SEP_ID))
    return seq.select(*_model_inputs(key, whole, _ids(F.size(whole), 0)))


def encode_pair(pairs: DataFrame, key: str = "key", a: str = "a", b: str = "b", max_len: int | None = None) -> DataFrame:
    """`[CLS] A [SEP] B [SEP]` with types 0 and 1, cut to `max_len`.

    Tokens are cut one by one from the end of the longer side, the second side
    first when both are equal.
    """
    na, nb = F.size(a), F.size(b)
    keep_a, keep_b = na, nb
    if max_len is not None:
        room = F.lit(max_len - 3)
        over = F.greatest(na + nb - room, F.lit(0))
        gap = F.abs(na - nb)
        rest = F.greatest(over - gap, F.lit(0))  # what is still to cut once both sides are equally long
        from_longer = F.least(over, gap)
        more_b, more_a = F.ceil(rest / 2).cast("int"), F.floor(rest / 2).cast("int")
        keep_a = F.greatest(na - F.when(na > nb, from_longer).otherwise(0) - more_a, F.lit(0))
        keep_b = F.greatest(nb - F.when(nb > na, from_longer).otherwise(0) - more_b, F.lit(0))
    first = F.concat(_special(CLS_ID), F.slice(a, F.lit(1), keep_a), _special(SEP_ID))
    second = F.concat(F.slice(b, F.lit(1), keep_b), _special(SEP_ID))
    types = F.concat(_ids(F.size(first), 0), _ids(F.size(second), 1))
    return pairs.select(*_model_inputs(key, F.concat(first, second), types))


def tokens_to_ids(
    documents: DataFrame, tokens: Column, vocab: DataFrame, key: str = "doc_id", unk: int = UNK_ID
) -> DataFrame:
    """Sequence of tokens to ids, with a mask of ones."""
    found = with_token_ids(documents, tokens, vocab, "ids", unk, key)
    return found.select(*_model_inputs(key, F.col("ids"), _ids(F.size("ids"), 0)))


def truncate(seq: DataFrame, max_len: int, key: str = "doc_id") -> DataFrame:
    """Cut to `max_len`; a cut sequence keeps its closing `[SEP]`."""
    n = F.size("input_ids")
    head = F.concat(F.slice("input_ids", 1, max_len - 1), _special(SEP_ID))
    ids = F.when(n > max_len, head).otherwise(F.col("input_ids"))
    return seq.select(
        key,
        ids.alias("input_ids"),
        F.slice("token_type_ids", 1, max_len).alias("token_type_ids"),
        F.slice("attention_mask", 1, max_len).alias("attention_mask"),
    )


def pad_batch(
    seq: DataFrame, batch_size: int = 8, pad: int = PAD_ID, key: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """Batches of consecutive rows, each padded to its longest; mask 0 on padding."""
    ranked = global_rank(seq.select(key), F.col(key), [F.col(key)], "__at")
    places = ranked.select(key, F.floor(F.col("__at") / batch_size).cast("bigint").alias("batch_id"))
    batched = seq.select(key, ids).join(places, key)
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    missing = longest - F.size(ids)
    return batched.select(
        "batch_id",
        key,
        F.concat(ids, _ids(missing, pad)).alias("input_ids"),
        F.concat(_ids(F.size(ids), 1), _ids(missing, 0)).alias("attention_mask"),
    )


def word_pieces(documents: DataFrame, words: Column, pieces_of, key: str = "doc_id") -> DataFrame:
    """Pieces of every word with the 0-based index of their word: key, pieces[], word_ids[]."""
    split = F.transform(words, lambda w, i: F.struct(pieces_of(w).alias("p"), i.cast("bigint").alias("w")))
    marked = documents.select(key, split.alias("s"))
    return marked.select(
        key,
        F.flatten(F.transform("s", lambda z: z["p"])).alias("pieces"),
        F.flatten(F.transform("s", lambda z: F.array_repeat(z["w"], F.size(z["p"])))).alias("word_ids"),
    )


def word_alignment(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Index of the word of every token once special tokens are added; null for those."""
    none = F.array(F.lit(None).cast("bigint"))
    return pieces.select(key, F.concat(none, F.col("word_ids"), none).alias("word_ids"))


def char_word_ids(lexicon: DataFrame, char_vocab: DataFrame, unk: int = UNK_ID, limit: int | None = None) -> DataFrame:
    """One id per character of every word. `char_vocab` holds (ch, char_id)."""
    vocab = char_vocab.select(F.col("ch").alias("word"), F.col("char_id").alias("token_id"))
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    coded = with_token_ids(lexicon.select("word"), chars, vocab, "word_ids", unk, "word", limit)
    return coded.select("word", "word_ids")


def tokens_to_string(seq: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Tokens joined by spaces, continuation pieces glued to their word."""
    joined = F.array_join(tokens, " ")
    return seq.select(key, F.replace(joined, F.lit(" " + CONTINUATION), F.lit("")).alias("text"))


def compare_tokenisations(words: DataFrame, left: DataFrame, right: DataFrame, col: str = "w") -> DataFrame:
    """The same words under two tokenisers: w, t1, t2. Both sides hold (w, tokens)."""
    a = left.select(col, F.col("tokens").alias("t1"))
    b = right.select(col, F.col("tokens").alias("t2"))
    return words.select(col).join(a, col).join(b, col)
