"""Compositions over definition vectors: recall from a definition, semantic search, approximate search, projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.functions.text import word_runs
from glossvec.functions.vectors import l2_norm
from glossvec.operators.filters import concat_text, issue_filter, min_words_filter
from glossvec.operators.pooling import definition_vectors
from glossvec.operators.recall import cosine_recall, nearest_examples, l2_recall
from glossvec.operators.shape import keep_columns
from glossvec.operators.summaries import describe_column
from glossvec.operators.vector_index import build_index
from glossvec.session import stored_table


def definition_recall(
    definitions: DataFrame, vocab: DataFrame, vectors: DataFrame, k: int = 10, skip: int = 1
) -> DataFrame:
    """Vocabulary words nearest to the mean vector of a definition: query_id, hit_id, cosine, rank."""
    pooled = definition_vectors(definitions, vocab, vectors).withColumnRenamed("token_id", "query_id")
    return cosine_recall(pooled, vectors, k, skip).withColumnRenamed("distance", "cosine")


def comment_corpus(issues: DataFrame, n: int = 15) -> DataFrame:
    """Comments of real issues with more than `n` words, as searchable text: conv_id, at, comment, text."""
    kept = keep_columns(issue_filter(issues), ["conv_id", "title", "body", "comments"])
    rows = kept.select("conv_id", "title", "body", F.posexplode_outer("comments").alias("at", "comment"))
    return concat_text(min_words_filter(rows, "comment", n), ["title", "body", "comment"]).select(
        "conv_id", F.col("at").cast("bigint").alias("at"), "comment", "text"
    )


def semantic_search(
    issues: DataFrame, question: str, vocab: DataFrame, vectors: DataFrame, k: int = 10
) -> DataFrame:
    """The k comments nearest to a question: conv_id, comment, distance, rank."""
    spark = issues.sparkSession
    corpus = comment_corpus(issues)
    row = F.struct("conv_id", "at", "comment")
    pooled = definition_vectors(
        corpus.select(row.alias("row"), word_runs("text").alias("tokens")), vocab, vectors, key="row"
    )
    asked = spark.range(1).select(F.col("id").alias("query_id"), word_runs(F.lit(question)).alias("tokens"))
    q = definition_vectors(asked, vocab, vectors, key="query_id")
    found = nearest_examples(q, pooled.select("row.conv_id", "row.at", "row.comment", "v"), ["conv_id", "at"], ["comment"], k)
    return found.select("conv_id", "comment", "distance", "rank")


def ann_index(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, probes: int | None = None, **how) -> DataFrame:
    """Approximate nearest vectors by an inverted-file index: query_id, hit_id, distance, rank.

    Distances are exact. Without `queries` every vector is asked for, without `probes` their number is measured on all vectors.
    """
    index = build_index(vectors, **how)
    asked = vectors.select(F.col("token_id").alias("query_id"), "v") if queries is None else queries
    return index.search(asked, k, probes or index.probes_for(vectors, k))


def ann_recall(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, probes: int | None = None, **how) -> DataFrame:
    """How much of the exact k nearest the index finds, and how much it reads for that: found, wanted, recall, probes, cells, scored, pairs, share."""
    asked = vectors.select(F.col("token_id").alias("query_id"), "v") if queries is None else queries
    index = build_index(vectors, **how)
    # Both the probes and the recall are measured against it, over all rows.
    exact = stored_table(l2_recall(asked, vectors, k).select("query_id", "hit_id"), "exact-hits")
    probes = probes or index.probes_for(vectors, k, exact=exact if queries is None else None)
    hits = index.search(asked, k, probes).select("query_id", "hit_id", F.lit(1).alias("hit"))
    scored, pairs = index.pairs_scored(asked, probes), asked.count() * sum(c["n"] for c in index.cells)
    met = exact.join(hits, ["query_id", "hit_id"], "left")
    counts = met.agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
    return counts.select(
        "found", "wanted", (F.col("found") / F.greatest("wanted", F.lit(1))).alias("recall"),
        F.lit(probes).cast("bigint").alias("probes"), F.lit(len(index.cells)).cast("bigint").alias("cells"),
        F.lit(scored).cast("bigint").alias("scored"), F.lit(pairs).cast("bigint").alias("pairs"), F.lit(scored / max(pairs, 1)).alias("share"))


def project_2d(vectors: DataFrame) -> DataFrame:
    """Two principal coordinates of every vector: token_id, x, y."""
    rows = vectors.select("token_id", array_to_vector("v").alias("f"))
    xy = vector_to_array("p")
    projected = PCA(k=2, inputCol="f", outputCol="p").fit(rows).transform(rows)
    return projected.select("token_id", xy.getItem(0).alias("x"), xy.getItem(1).alias("y"))


def embedding_shift(vectors: DataFrame, pooled: DataFrame) -> DataFrame:
    """Description of the norms of table vectors and of pooled context vectors of the same words."""
    both = vectors.select("token_id", l2_norm("v").alias("table")).join(
        pooled.select("token_id", l2_norm("v").alias("context")), "token_id"
    )
    both = both.withColumn("shift", F.col("context") - F.col("table"))
    parts = [describe_column(both, c).withColumn("which", F.lit(c)) for c in ("table", "context", "shift")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
