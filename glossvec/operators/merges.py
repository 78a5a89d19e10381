"""Byte-pair and word-piece vocabularies: training on a distinct-word table and encoding.

A word is kept as one text in which every symbol stands between two Unicode
noncharacters, which no valid text holds. Merging a pair is then one linear
left-to-right `replace`, and a word's symbols are one `split`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.functions.text import normalise_text
from glossvec.constants import BPE_SPECIALS, CONTINUATION, SPACE_MARK, WORDPIECE_SPECIALS
from glossvec.operators.merge_training import learn_merges
from glossvec.operators.tokens import TOKEN_PATTERNS, pretokens
from glossvec.plans.lookups import TOKENS_AT_A_TIME, as_list, list_parts, row_slices
from glossvec.session import stored_table

OPEN, CLOSE = "\ufdd0", "\ufdd1"

# Words an encoding task remembers.
ENCODER_MEMORY = 1 << 16


def joined_symbol(a: str, b: str, prefix: str = "") -> str:
    """Name of a merged symbol: the second part loses its continuation prefix."""
    return a + (b[len(prefix):] if prefix and b.startswith(prefix) else b)


def start_symbols(word, prefix: str = "") -> Column:
    """A word as wrapped single characters; later ones carry the continuation prefix."""
    col = F.col(word) if isinstance(word, str) else word
    parts = F.filter(F.split(col, ""), lambda c: c != "")
    if prefix:
        parts = F.transform(parts, lambda c, i: F.when(i > 0, F.concat(F.lit(prefix), c)).otherwise(c))
    return F.concat(F.lit(OPEN), F.array_join(parts, CLOSE + OPEN), F.lit(CLOSE))


def symbols(wrapped) -> Column:
    """Wrapped text to the array of symbols."""
    col = F.col(wrapped) if isinstance(wrapped, str) else wrapped
    inner = F.substring(col, F.lit(2), F.char_length(col) - 2)
    return F.split(inner, CLOSE + OPEN)


def merge_in(wrapped: Column, a: str, b: str, prefix: str = "") -> Column:
    return F.replace(
        wrapped,
        F.lit(OPEN + a + CLOSE + OPEN + b + CLOSE),
        F.lit(OPEN + joined_symbol(a, b, prefix) + CLOSE),
    )


def word_table(documents: DataFrame, mode: str = "punct", text: str = "text") -> DataFrame:
    """Distinct pre-tokens with their counts: w, f."""
    found = F.regexp_extract_all(F.col(text), F.lit(TOKEN_PATTERNS[mode]), F.lit(0))
    counts = documents.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    if mode != "space":
        return counts
    # Spaces are marked once for every distinct pre-token; a text may hold the mark itself.
    return counts.groupBy(F.translate("w", " ", SPACE_MARK).alias("w")).agg(F.sum("f").alias("f"))


def split_words(words: DataFrame, prefix: str = "") -> DataFrame:
    """Words (w, f) with their starting symbols: w, f, sy[]."""
    return words.select("w", "f", symbols(start_symbols("w", prefix)).alias("sy"))


def pair_frequencies(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word count: a, b, n. Words of one symbol have none."""
    n = F.greatest(F.size("sy") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("sy", F.lit(1), n).alias("a"), F.slice("sy", F.lit(2), n).alias("b"))
    rows = words.select("f", F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("f").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; ties go to the lowest (a, b)."""
    return pairs.orderBy(F.desc("n"), "a", "b").limit(1)


def apply_merge(words: DataFrame, a: str, b: str, prefix: str = "") -> DataFrame:
    """Replace adjacent (a, b) by ab in every word, left to right, non-overlapping: w, f, sy[]."""
    wrapped = F.concat(F.lit(OPEN), F.array_join("sy", CLOSE + OPEN), F.lit(CLOSE))
    return words.select("w", "f", symbols(merge_in(wrapped, a, b, prefix)).alias("sy"))


class MergeTraining:
    """Learned merges in order, and the vocabulary they give."""

    def __init__(self, spark, merges: list, letters: list[str], specials: list[str], prefix: str):
        self._spark, self.prefix = spark, prefix
        self.merges = merges  # (a, b, merged, n)
        self.vocabulary = specials + letters
        known = set(self.vocabulary)
        for _, _, m, _ in merges:
            if m not in known:
                known.add(m)
                self.vocabulary.append(m)

    def merge_table(self) -> DataFrame:
        rows = [(i, *m) for i, m in enumerate(self.merges)]
        return self._spark.createDataFrame(rows, "step bigint, a string, b string, merged string, n bigint")

    def vocabulary_table(self) -> DataFrame:
        rows = [(w, i) for i, w in enumerate(self.vocabulary)]
        return self._spark.createDataFrame(rows, "word string, token_id bigint")


def letters_of(words: DataFrame, prefix: str = "") -> list[str]:
    """The symbols that words start from, in order."""

    def run(batches):
        found: set = set()
        for batch in batches:
            for w in batch.column("w").to_pylist():
                found.update(prefix + c if i and prefix else c for i, c in enumerate(w or ""))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["c"])

    return [r["c"] for r in words.select("w").mapInArrow(run, "c string").distinct().orderBy("c").collect()]


def letter_symbols(words: DataFrame, letters: list[str], prefix: str = "") -> DataFrame:
    """Words (w, f) as numbers of their letters: f, sy[]. Later letters carry the continuation prefix."""
    number = {c: i for i, c in enumerate(letters)}

    def run(batches):
        for batch in batches:
            sy = [[number[prefix + c if i and prefix else c] for i, c in enumerate(w or "")] for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(sy, pa.list_(pa.int32()))], names=["f", "sy"])

    return words.select("w", "f").mapInArrow(run, "f bigint, sy array<int>")


def train_merges(
    words: DataFrame,
    vocab_size: int | None = None,
    rounds: int | None = None,
    specials: list[str] | None = None,
    prefix: str = "",
    least: int = 1,
) -> MergeTraining:
    """Merge the best pair until the vocabulary has `vocab_size` entries, for `rounds` merges, or while a pair has `least` occurrences.

    `words` holds (w, f). The driver sees the ranking's head and the alphabet,
    both bounded; the words stay distributed.
    """
    specials = list(BPE_SPECIALS if specials is None else specials)
    words = stored_table(words, "words")
    letters = letters_of(words, prefix)
    known = set(specials) | set(letters)
    if vocab_size is not None and vocab_size < len(known):
        raise ValueError(f"a vocabulary of {vocab_size} has no room for {len(known)} special tokens and letters")
    start = letter_symbols(words, letters, prefix)
    merges = learn_merges(start, letters, lambda a, b: joined_symbol(a, b, prefix), vocab_size, rounds, known, least)
    return MergeTraining(words.sparkSession, merges, letters, specials, prefix)


def train_bpe(
    documents: DataFrame, vocab_size: int | None = None, rounds: int | None = None, mode: str = "punct", least: int = 1, words: DataFrame | None = None
):
    """`words` may be the word table of the documents where it is already there."""
    return train_merges(word_table(documents, mode) if words is None else words, vocab_size, rounds, least=least)


def train_corpus_tokeniser(documents: DataFrame, vocab_size: int = 52_000, text: str = "text", least: int = 1):
    """Retrain on a corpus with space-keeping pre-tokens."""
    return train_merges(word_table(documents, "space", text), vocab_size, least=least)


def train_wordpiece(documents: DataFrame, vocab_size: int = 25_000, mode: str = "bert", normalise: bool = True, least: int = 1):
    """Five special tokens first, continuation symbols marked. Texts are decomposed, lower-cased and rid of accents first."""
    rows = documents.withColumn("text", normalise_text("text")) if normalise else documents
    return train_merges(word_table(rows, mode), vocab_size, specials=WORDPIECE_SPECIALS, prefix=CONTINUATION, least=least)


def merge_one(word: str, rank: dict, prefix: str = "") -> list[str]:
    """Symbols of a word after all merges in learned order.

    The lowest-ranked pair present is merged next, the leftmost of equals first,
    and ranks only rise. Pairs wait in a heap, symbols hang together in a linked
    list, so a long word takes linear-logarithmic time.
    """
    parts: list = [prefix + c if i and prefix else c for i, c in enumerate(word)]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
    heapify(heap)
    while heap:
        step, i = heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or rank.get((parts[i], parts[j])) != step:
            continue  # one of the two has been merged since
        parts[i], parts[j] = joined_symbol(parts[i], parts[j], prefix), None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := rank.get((parts[a], parts[b]))) is not None and r > step:
                heappush(heap, (r, a))
    return [p for p in parts if p is not None]


class PieceTrie:
    """Greedy longest match in one pass over a word.

    A trie of the entries, and one of what follows the continuation prefix. Where a
    place has no way on, its failure link gives the pieces that are certain by then
    and the place in the second trie that stands for the rest read so far.
    """

    def __init__(self, vocabulary, prefix: str = CONTINUATION):
        # Places 0 and 1 are the two roots.
        self.ways: list[dict[str, int]] = [{}, {}]
        entry: list[str | None] = [None, None]
        for word in vocabulary:
            inner = word[len(prefix) :] if word.startswith(prefix) else ""
            for root, letters in ((0, word), (1, inner)):
                at = root
                for c in letters:
                    if c not in self.ways[at]:
                        self.ways[at][c] = len(self.ways)
                        self.ways.append({})
                        entry.append(None)
                    at = self.ways[at][c]
                if letters:
                    entry[at] = word
        self.back: list[int | None] = [None] * len(self.ways)
        self.pieces: list[tuple[str, ...]] = [()] * len(self.ways)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.ways[u].items():
                queue.append(v)
                if entry[v] is not None:
                    self.back[v], self.pieces[v] = 1, (entry[v],)
                    continue
                z, more = self.back[u], self.pieces[u]
                while z is not None and c not in self.ways[z]:
                    z, more = self.back[z], more + self.pieces[z]
                if z is not None:
                    self.back[v], self.pieces[v] = self.ways[z][c], more

    def match(self, word: str) -> list[str]:
        """Pieces of a word; `[UNK]` where a rest has none."""
        at, out = 0, []
        for c in word:
            while c not in self.ways[at]:
                if self.back[at] is None:
                    return ["[UNK]"]
                out += self.pieces[at]
                at = self.back[at]
            at = self.ways[at][c]
        while at > 1:
            if self.back[at] is None:
                return ["[UNK]"]
            out += self.pieces[at]
            at = self.back[at]
        return out


def encoded(tokens: Column, make_encoder) -> Column:
    """Pieces of an array of tokens: struct(tokens[], word_ids[]).

    Every distinct token of an Arrow batch is encoded once and remembered in
    the task, so no row is shuffled and a frequent word costs one lookup.
    """
    kind = T.StructType(
        [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("word_ids", T.ArrayType(T.LongType()))]
    )

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = lru_cache(maxsize=ENCODER_MEMORY)(make_encoder())
        for batch in batches:
            held = np.asarray(pc.fill_null(pc.list_value_length(batch), 0)).astype(np.int64)
            for lo, hi in row_slices(held, TOKENS_AT_A_TIME):
                values, lengths = list_parts(batch.slice(lo, hi - lo))
                coded = values.cast(pa.string()).dictionary_encode()
                pieces = pa.array([encode(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.string()))
                spread = pieces.take(coded.indices)
                sizes = np.asarray(pc.list_value_length(spread)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                rows = ends[edges[1:]] - ends[edges[:-1]]
                place = np.arange(len(sizes)) - np.repeat(edges[:-1], lengths)
                out = [as_list(spread.flatten(), rows), as_list(pa.array(np.repeat(place, sizes)), rows)]
                yield pa.StructArray.from_arrays(out, ["tokens", "word_ids"])

    return run(tokens)


def _pieces(documents: DataFrame, tokens: Column, make_encoder, key: str) -> DataFrame:
    return documents.select(key, encoded(tokens, make_encoder).alias("e")).select(key, "e.tokens", "e.word_ids")


def merge_ranks(merges: list[tuple]) -> dict:
    """Place of every pair in the learned order; of a pair that was learned twice, the first."""
    ranks: dict = {}
    for i, m in enumerate(merges):
        ranks.setdefault((m[0], m[1]), i)
    return ranks


def encode_bpe(
    documents: DataFrame,
    merges: list[tuple],
    mode: str = "punct",
    key: str = "doc_id",
    text: str = "text",
    prefix: str = "",
) -> DataFrame:
    """Pre-tokenise and apply the merges in learned order: key, tokens[], word_ids[]."""
    ranks = merge_ranks(merges)
    shipped = documents.sparkSession.sparkContext.broadcast(ranks)  # one entry per trained merge

    def make():
        table = shipped.value
        return lambda word: merge_one(word, table, prefix)

    return _pieces(documents, pretokens(text, mode), make, key)


def encode_wordpiece(
    documents: DataFrame, vocabulary: list[str], mode: str = "bert", key: str = "doc_id", text: str = "text", normalise: bool = True
) -> DataFrame:
    """Greedy longest match, unknown words as `[UNK]`: key, tokens[], word_ids[]. Texts are normalised as in training."""
    shipped = documents.sparkSession.sparkContext.broadcast(list(vocabulary))  # entries of a trained vocabulary

    def make():
        return PieceTrie(shipped.value).match

    shown = normalise_text(text) if normalise else F.col(text)
    return _pieces(documents, pretokens(shown, mode), make, key)


def encode_words(words: DataFrame, merges: list[tuple], prefix: str = "", col: str = "w") -> DataFrame:
    """Distinct words under one set of merges: w, tokens[]."""
    ranks = merge_ranks(merges)
    shipped = words.sparkSession.sparkContext.broadcast(ranks)

    def make():
        table = shipped.value
        return lambda word: merge_one(word, table, prefix)

    return words.select(col, encoded(F.array(col), make)["tokens"].alias("tokens"))
