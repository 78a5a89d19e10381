"""Document quality with the evidence of its site, by hierarchical empirical Bayes.

A linear classifier over the text gives each document a probability. Documents
are grouped by path, paths by host. A host's rate of good documents is shrunk
toward the global rate, a path's toward its host's, by beta priors whose weights
come from how much rates differ between sites beyond chance. A document's
evidence and the rate of its path, without the document itself, then make its
posterior odds. A site of few documents says little, one of many says much.

The classifier learns from a bounded draw of labels. All counts and rates cover
all documents; groups are pre-aggregated, and rates of large sites are broadcast
under a proven bound.

Defined results: a null or empty text is judged by the intercept and its site; a
null host or path is a site of its own; repeated rows count each; without labels
the classifier says 0.5; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm import scan
from glossvec.llm.common import hot_join, written
from glossvec.llm.toxicity import fit_linear, sample_labels

#: Labelled documents that the classifier learns from.
LABELLED = 8_000
DIMENSIONS = 1 << 18
#: Share of the log odds of a site that goes to its documents: a site is no proof.
SITE_SHARE = 0.5
#: Bounds of a prior's weight in documents.
WEIGHTS = (2.0, 1_000.0)
DENSE = 9


def design(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs of the classifier: hashed words that share one length, and counts that tell junk."""
    words = scan.word_hashes(texts, scan.separators(), True, (3,))
    out = []
    for text, (own, _) in zip(texts, words):
        n, size = max(len(own), 1), max(len(text), 1)
        distinct = np.unique(own)
        letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
        capitals, digits = letters[65:91].sum(), letters[48:58].sum()
        signs = letters[[ord(c) for c in "#$%&*|<>~^"]].sum()
        lines = [x for x in text.split(b"\n") if x.strip()]
        dense = np.array([
            min(signs / n, 2), min(letters[33] / n, 2), capitals / size, digits / size, min(letters[46] / n, 1), 1 - len(distinct) / n,
            1 - len(set(lines)) / max(len(lines), 1), min(n / max(len(lines), 1), 500) / 500, np.log1p(n) / 10])
        index = np.unique((distinct & np.uint64(DIMENSIONS - 1)).astype(np.int64))
        value = np.full(len(index), 1 / max(len(index), 1) ** 0.5)
        out.append((np.concatenate([index, DIMENSIONS + np.arange(DENSE)]), np.concatenate([value, 4 * dense])))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = LABELLED) -> tuple[np.ndarray, float]:
    """Weights and intercept from at most `bound` labelled documents; only their inputs come to the driver."""
    drawn = sample_labels(labels, label, bound)

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            made = design(scan.utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))], names=["y", "i", "v"])

    # The drawn labels are bounded.
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "y")
    rows = sorted(((r["y"], np.array(r["i"]), np.array(r["v"])) for r in met.mapInArrow(run, "y int, i array<int>, v array<double>").toLocalIterator()), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    if not rows or len({r[0] for r in rows}) < 2:
        return np.zeros(DIMENSIONS + DENSE, np.float32), 0.0
    return fit_linear([r[1:] for r in rows], np.array([float(r[0]) for r in rows]), DIMENSIONS + DENSE)


def document_evidence(docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text") -> DataFrame:
    """`docs` without `text`, with `evidence`, the log odds of the classifier. The model sent has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c != text]

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            z = [float(np.clip(sent.value[i] @ v + intercept, -12, 12)) for i, v in design(scan.utf8(batch.column(text)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(z, pa.float64())], names=[*names, "evidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, text).mapInArrow(run, f"{schema}, evidence double")


def _prior_weight(rows: DataFrame, mean: Column) -> float:
    """Weight of a beta prior from rows (n, s): how far rates of sites differ beyond chance, by moments.

    mean is the rate that a site is shrunk toward.
    """
    gap, chance = F.col("s") - F.col("n") * mean, F.greatest(mean * (1 - mean), F.lit(1e-6))
    sums = rows.where("n > 1").agg(
        F.sum(gap * gap / chance - F.col("n")).alias("over"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    if not sums["pairs"]:
        return WEIGHTS[1]
    between = max(sums["over"] / sums["pairs"], 1e-9)  # correlation of two documents of a site
    return float(min(max((1 - between) / between, WEIGHTS[0]), WEIGHTS[1]))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def combine_with_sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """Add host_posterior, path_posterior and score to rows with `evidence`."""
    named = scored.withColumn("__h", F.coalesce(F.col(host).cast("string"), F.lit("\0"))).withColumn("__q", F.coalesce(F.col(path).cast("string"), F.lit("\0")))
    named = named.withColumn("__p", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = written(named.groupBy("__h", "__q").agg(F.count("*").alias("n"), F.sum("__p").alias("s")), "paths")
    hosts = paths.groupBy("__h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("m"))
    hosts = written(hosts, "hosts")
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    rate = (whole["s"] + 1) / (whole["n"] + 2)
    k_host = _prior_weight(hosts, F.lit(rate))
    shrunk = hosts.select("__h", "m", ((F.col("s") + k_host * rate) / (F.col("n") + k_host)).alias("host_posterior"))
    # A host of very many paths is one of few.
    met = written(hot_join(paths, shrunk, ["__h"], "m", whole["m"]).drop("m"), "sites")
    k_path = _prior_weight(met, F.col("host_posterior"))
    joined = hot_join(named, met, ["__h", "__q"], "n", whole["n"])
    # The document's own share is taken out of its path, lest it count twice.
    own = (F.col("s") - F.col("__p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    joined = joined.withColumn("path_posterior", F.least(F.greatest(own, F.lit(1e-6)), F.lit(1 - 1e-6)))
    odds = F.col("evidence") + SITE_SHARE * (_logit(F.col("path_posterior")) - F.lit(float(np.log(rate / (1 - rate)))))
    return joined.withColumn("score", 1 / (1 + F.exp(-odds))).select(*scored.columns, "host_posterior", "path_posterior", "score")


def classify_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: Column | None = None, bound: int = LABELLED) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, predicted, kept), one per row.

    The path defaults to the language within the source, where null and empty are one path. Each text is read once.
    """
    weights, intercept = fit_quality(docs, labels, "quality", bound)
    slim = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), (F.coalesce(F.col("lang"), F.lit("")) if path is None else path).alias("path"))
    scored = written(document_evidence(slim, weights, intercept), "evidence")
    out = combine_with_sites(scored, "host", "path")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)


def sites_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify_documents(docs, labels)
