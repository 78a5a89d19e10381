"""Relations derived from the given tables, over whole tables and whole texts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossvec.constants import UNK_ID
from glossvec.functions.text import WORD_RUN, word_runs
from glossvec.functions.vectors import l2_norm
from glossvec.operators.merges import word_table
from glossvec.operators.pooling import definition_vectors
from glossvec.operators.recall import NAMES_LIMIT
from glossvec.operators.tokens import pretokenise
from glossvec.operators.vocabulary import build_vocabulary, char_vocabulary, token_rows, word_frequencies
from glossvec.plans.derived import derived_table
from glossvec.plans.joins import lookup_join, spread
from glossvec.plans.lookups import with_token_ids
from glossvec.sources.corpora import vector_sheet

#: Goes up when a derived table changes its form.
FORM = 2


class Inputs:
    """The tables of one folder, and what is derived from them. Lookup tables used by many queries are kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, name: str, sources: list[str], make) -> DataFrame:
        """A table made once of the named tables of the folder."""
        return derived_table(self.spark, name, [f"{self.folder}/{s}.parquet" for s in sources], make, form=FORM)

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def conversations(self) -> DataFrame:
        return spread(self.table("conversations"), "conv_id")

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def vocab(self) -> DataFrame:
        """The most frequent words of all documents, as many as there are vectors: word, token_id, freq."""
        return build_vocabulary(word_frequencies(self.documents), self.embeddings.count()).persist()

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors scaled to distinct norms: token_id, v."""
        i = F.col("vec_id")
        scale = F.lit(0.85) + ((i * 37) % 2003).cast("double") / F.lit(2003.0)
        v = F.transform("embedding", lambda x: x.cast("double") * scale)
        return self.embeddings.select(i.alias("token_id"), v.alias("v")).persist()

    @cached_property
    def width(self) -> int:
        return self.vectors.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1

    @cached_property
    def definitions(self) -> DataFrame:
        """Every document with a word, as a definition: token_id, tokens[]."""
        kept = self.documents.where(F.col("text").rlike(WORD_RUN))
        return kept.select(F.col("doc_id").alias("token_id"), word_runs("text").alias("tokens"))

    @cached_property
    def def_tokens(self) -> DataFrame:
        return token_rows(self.documents).withColumnRenamed("doc_id", "token_id")

    @property
    def lexicon_rows(self) -> DataFrame:
        """Every document whose first word has a vector, as an entry for it: entry, word, token_id, definition, norm."""
        norms = self.vectors.select("token_id", F.round(l2_norm("v"), 6).alias("norm"))
        words = lookup_join(self.vocab.select("token_id", "word"), norms, "token_id")
        found = lookup_join(self.dictionary.withColumnRenamed("doc_id", "entry"), words, "word")
        return found.select("entry", "word", "token_id", "definition", "norm")

    @cached_property
    def lexicon(self) -> DataFrame:
        """`lexicon_rows` without the definitions, whose text stays in `documents`: entry, word, token_id, norm."""
        return self.derived("lexicon", ["documents", "embeddings"], lambda: self.lexicon_rows.drop("definition"))

    @cached_property
    def defined_lexicon(self) -> DataFrame:
        """`lexicon_rows` for operators that go through the definitions more than once."""
        return self.derived("defined_lexicon", ["documents", "embeddings"], lambda: self.lexicon_rows)

    @cached_property
    def head_vectors(self) -> DataFrame:
        """The vector of every entry's word, by entry: token_id, v."""

        def make():
            entries = self.lexicon.select("entry", "token_id")
            return lookup_join(entries, self.vectors, "token_id").select(F.col("entry").alias("token_id"), "v")

        return self.derived("head_vectors", ["documents", "embeddings"], make)

    @cached_property
    def sheet(self) -> DataFrame:
        """The definition vector of every word, of its last entry: word, v."""

        def make():
            return vector_sheet(self.def_vectors, self.lexicon.select(F.col("entry").alias("token_id"), "word"))

        return self.derived("sheet", ["documents", "embeddings"], make)

    @cached_property
    def dictionary(self) -> DataFrame:
        """Every document as the definition of its first word; words repeat: doc_id, word, definition."""
        two_words = rf"{WORD_RUN}[^\p{{L}}\p{{M}}\p{{N}}_]+{WORD_RUN}"
        t = self.documents.where(F.col("text").rlike(two_words)).select("doc_id", F.regexp_extract(F.lower("text"), WORD_RUN, 0).alias("word"), word_runs("text").alias("t"))
        rest = F.slice("t", F.lit(2), F.size("t") - 1)
        return t.select("doc_id", "word", F.array_join(rest, " ").alias("definition"))

    @cached_property
    def def_vectors(self) -> DataFrame:
        """The mean vector of every definition, kept as a stored sheet would be: token_id, v."""
        return self.derived("def_vectors", ["documents", "embeddings"], lambda: definition_vectors(self.definitions, self.vocab, self.vectors))

    @cached_property
    def def_queries(self) -> DataFrame:
        return self.def_vectors.withColumnRenamed("token_id", "query_id")

    @cached_property
    def lexicon_queries(self) -> DataFrame:
        named = lookup_join(self.sheet, self.vocab.select("word", "token_id"), "word", limit=NAMES_LIMIT)
        return named.select(F.col("token_id").alias("query_id"), "v")

    @cached_property
    def char_vocab(self) -> DataFrame:
        return char_vocabulary(self.documents, share=1e-4).persist()

    @cached_property
    def char_ids(self) -> DataFrame:
        """ch, char_id by falling count."""
        ranked = build_vocabulary(self.char_vocab.withColumnRenamed("ch", "w"), 1 << 21)
        return ranked.select(F.col("word").alias("ch"), F.col("token_id").alias("char_id")).persist()

    @cached_property
    def issues(self) -> DataFrame:
        text, turn = F.col("text"), F.col("turn")
        return self.conversations.groupBy("conv_id").agg(
            F.max(F.when(turn == 0, text)).alias("title"),
            F.coalesce(F.max(F.when(turn == 1, text)), F.lit("")).alias("body"),
            (F.max(F.when(F.col("role") == "system", 1).otherwise(0)) == 1).alias("is_pr"),
            F.transform(
                F.array_sort(F.collect_list(F.when(turn >= 2, F.struct("turn", "text")))), lambda z: z["text"]
            ).alias("comments"),
        )

    @cached_property
    def words(self) -> DataFrame:
        """The distinct pre-tokens of all documents with their counts: w, f."""
        return self.derived("words", ["documents"], lambda: word_table(self.documents))

    @cached_property
    def sequences(self) -> DataFrame:
        """The tokenised dataset, unknown words as -1, kept as a stored one would be: doc_id, ids[]."""

        def make():
            return with_token_ids(self.documents.select("doc_id", "text"), word_runs("text"), self.vocab, "ids", UNK_ID).select("doc_id", "ids")

        return self.derived("sequences", ["documents", "embeddings"], make)

    @cached_property
    def token_seq(self) -> DataFrame:
        """`sequences` in long form: doc_id, pos, id."""
        rows = self.sequences.select("doc_id", F.posexplode("ids").alias("pos", "id"))
        return rows.withColumn("pos", F.col("pos").cast("bigint"))

    @cached_property
    def pretokens(self) -> DataFrame:
        return pretokenise(self.documents, "punct").withColumnRenamed("doc_id", "sent_id")

    @cached_property
    def ner_tokens(self) -> DataFrame:
        n = F.char_length("tok")
        label = F.when(n % 5 <= 1, "I-PER").when(n % 5 == 2, "I-LOC").otherwise("O")
        return self.pretokens.select(
            "*", label.alias("label"), ((n + F.col("pos") % 7).cast("double") / 40.0).alias("score")
        )

    @cached_property
    def logits(self) -> DataFrame:
        n, p = F.char_length("tok").cast("bigint"), F.col("pos")
        cell = [((n * a + p * b) % m).cast("double") / 4.0 for a, b, m in ((7, 1, 11), (3, 5, 13), (5, 2, 7), (2, 3, 17))]
        return self.pretokens.withColumn("logits", F.array(*cell))

    @cached_property
    def sentences(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("sent_id"), "text")

    @cached_property
    def labelled(self) -> DataFrame:
        """Documents by split: doc_id, label, split."""
        marks = self.table("labels")
        rows = self.documents.select("doc_id").join(marks, "doc_id", "left")
        split = F.when(F.col("quality").isNull(), "unsupervised").when(F.col("toxic") == 1, "test").otherwise("train")
        return rows.select(
            "doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("label"), split.alias("split")
        )


_known: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _known:
        _known[key] = Inputs(spark, key[1])
    return _known[key]
