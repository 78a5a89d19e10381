"""Toxicity by weak supervision: many voters, a label model, a linear classifier on its posteriors.

1. Labelled texts are drawn up to a stated bound. One half of them makes lexicons:
   words and word beginnings that toxic texts hold far more often. Each is dealt
   to one of several voters, beside voters that look for patterns.
2. On the other half, without its labels, a generative model estimates how often
   each voter votes what in toxic and in clean texts, and how voters correlate
   within a class; correlated voters share their weight. It gives each text a
   posterior.
3. A linear classifier over hashed words and word beginnings learns the posteriors.
   It scores every text of the table in one pass, where the text lies.

Only the text goes into a score. Defined results: a null or empty text is scored
by the intercept; a label with a null id or value is not used; repeated rows are
scored each; an empty table gives an empty result; no labels give a score of 0;
extra columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.llm import scan

#: Labelled texts that are drawn for lexicons, label model and classifier together.
LABELLED = 16_000
#: Bytes of word beginnings; hashed features; what a lexicon entry needs.
PREFIXES = (4, 5, 6)
DIMENSIONS = 1 << 20
LEXICON_TEXTS, LEXICON_ODDS = 8, 4.0
#: Lexicon voters by kind of feature.
VOTERS_BY_KIND = 6
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Patterns that vote: name, expression over bytes, vote (1 toxic, -1 clean).
PATTERNS = (
    ("shouting", rb"!{2,}", -1),
    ("table_bars", rb" \| ", -1),
    ("symbol_runs", rb"[#$%&*]{3,}", -1),
    ("numbers", rb"\d{4,}", -1),
    ("links", rb"https?://|www\.", -1),
    ("mail", rb"[\w.]+@[\w.]+", -1),
    ("long_text", rb"(?s)\A.{4000,}", -1),
    ("fragment", rb"(?s)\A.{0,24}\Z", -1),
)


def features(texts: list[bytes]) -> list[list[np.ndarray]]:
    """Distinct hashed features of each text by kind: words, then beginnings of each length."""
    mask = np.uint64(DIMENSIONS - 1)
    kinds = scan.word_hashes(texts, scan.separators(PUNCTUATION), True, PREFIXES)
    return [[np.unique((h & mask).astype(np.int32)) for h in text] for text in kinds]


def _pattern_votes(texts: list[bytes]) -> np.ndarray:
    import re

    kinds = [(re.compile(p), v) for _, p, v in PATTERNS]
    return np.array([[v if p.search(t) else 0 for p, v in kinds] for t in texts], dtype=np.int8).reshape(len(texts), len(kinds))


class LabelModel:
    """Votes -1, 0, 1 of correlated voters given a hidden class.

    Each voter has its own vote probabilities in either class. Within a class,
    votes correlate; a voter's evidence is divided by its summed squared
    correlations with all voters, itself included, so copies of one voter count
    as one. Both are estimated in turn.
    """

    def __init__(self, share: float = 0.1, rounds: int = 40):
        self.share, self.rounds = share, rounds

    def fit(self, votes: np.ndarray, accuracy: float = 0.85) -> "LabelModel":
        n, m = votes.shape
        seen = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
        base = seen.mean(0) + 1e-3
        tilt = {1: np.array([1 - accuracy, 1.0, accuracy]), 0: np.array([accuracy, 1.0, 1 - accuracy])}
        self.logs = np.log(np.stack([self._normal(base * tilt[y]) for y in (0, 1)]))
        self.weights = np.ones(m)
        for _ in range(self.rounds):
            p = self.posterior(votes)
            self.share = float((p.sum() + 1) / (n + 2))
            w = np.stack([1 - p, p])
            counted = np.einsum("yn,nmv->ymv", w, seen) + 0.5 * base
            self.logs = np.log(counted / counted.sum(2, keepdims=True))
            self.weights = 1 / self._correlation(votes.astype(float), w)
        return self

    @staticmethod
    def _normal(x):
        return x / x.sum(1, keepdims=True)

    @staticmethod
    def _correlation(votes, w):
        total = np.zeros(votes.shape[1])
        for y in (0, 1):
            k = w[y].sum() + 1e-9
            centred = votes - (w[y][:, None] * votes).sum(0) / k
            cov = (w[y][:, None] * centred).T @ centred / k
            sd = np.sqrt(np.diag(cov)) + 1e-6
            total += (cov / np.outer(sd, sd)).clip(-1, 1).__pow__(2).sum(1) * (k / len(votes))
        return np.maximum(total, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        # A voter is no worse than chance: its vote never speaks for the other class, and silence for neither.
        ratio = self.logs[1] - self.logs[0]
        ratio = np.stack([np.minimum(ratio[:, 0], 0), np.zeros(len(ratio)), np.maximum(ratio[:, 2], 0)], 1)
        evidence = np.take_along_axis(np.broadcast_to(ratio, (len(votes), *ratio.shape)), (votes.astype(int) + 1)[:, :, None], 2)[:, :, 0]
        z = np.log(self.share / (1 - self.share)) + evidence @ self.weights
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


class Lexicons:
    """Entries dealt to voters: for each kind of feature, the voter of each entry counted from 1, and 0 for all others."""

    def __init__(self):
        self.voter = np.zeros((1 + len(PREFIXES), DIMENSIONS), dtype=np.int8)

    def add(self, kind: int, entries: np.ndarray) -> None:
        self.voter[kind, entries] = 1 + kind * VOTERS_BY_KIND + entries % VOTERS_BY_KIND

    def votes(self, kinds: list[np.ndarray]) -> np.ndarray:
        out = np.full(self.voter.shape[0] * VOTERS_BY_KIND, -1, dtype=np.int8)
        for kind, own in enumerate(kinds):
            hit = self.voter[kind, own]
            out[hit[hit > 0] - 1] = 1
        return out

    def design(self, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the classifier: hashed features that share one length, then hits by kind and voters that voted."""
        own = np.unique(np.concatenate(kinds))
        hits = [int((self.voter[kind, x] > 0).sum()) for kind, x in enumerate(kinds)]
        dense = np.log1p(np.array([*hits, (self.votes(kinds) > 0).sum()], dtype=float))
        index = np.concatenate([own, DIMENSIONS + np.arange(len(dense))])
        return index, np.concatenate([np.full(len(own), 1 / max(len(own), 1) ** 0.5), dense])


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int, rounds: int = 200, l2: float = 1e-5, least: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over (indices, values), by accelerated gradient steps."""
    weights = np.zeros(dims, dtype=np.float32)
    lens = [len(index) for index, _ in rows]
    known, index, seen = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True, return_counts=True)
    use = seen >= least
    keep = use[index]
    owner = np.repeat(np.arange(len(rows)), lens)[keep]
    value = np.concatenate([r[1] for r in rows])[keep]
    index = (np.cumsum(use) - 1)[index[keep]]
    mean = target.mean() * 0.998 + 0.001
    w, m, v = (np.zeros(int(use.sum())) for _ in range(3))
    b, mb, vb = float(np.log(mean / (1 - mean))), 0.0, 0.0
    for t in range(1, rounds + 1):
        r = 1 / (1 + np.exp(-(np.bincount(owner, w[index] * value, len(rows)) + b))) - target
        g, gb = np.bincount(index, r[owner] * value, len(w)) / len(rows) + l2 * w, r.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 1 - t / (rounds + 1) + 0.01
        w = w - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b = b - rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights[known[use]] = w
    return weights, b


#: Inputs beside the hashed ones: hits by kind, voters that voted.
DENSE = 2 + len(PREFIXES)


class Classifier:
    """Lexicons, weights, intercept, and a report of the fit."""

    def __init__(self, lexicons: Lexicons, weights: np.ndarray, intercept: float, report: dict):
        self.lexicons, self.weights, self.intercept, self.report = lexicons, weights, intercept, report

    def scores(self, texts: list[list[np.ndarray]]) -> list[float]:
        out = []
        for kinds in texts:
            index, value = self.lexicons.design(kinds)
            z = float(self.weights[index] @ value) + self.intercept
            out.append(1 / (1 + np.exp(-max(min(z, 40.0), -40.0))))
        return out


def sample_labels(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Training labels, at most `bound`, chosen by a hash: those whose crc32 of the id is not 0 modulo 5."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    return usable.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


FEATURES = "y int, part int, kinds array<array<int>>, patterns array<int>"


def _labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            texts = scan.utf8(batch.column("text"))
            kinds = [[k.tolist() for k in text] for text in features(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("part"), pa.array(kinds, pa.list_(pa.list_(pa.int32()))), pa.array(_pattern_votes(texts).astype(int).tolist(), pa.list_(pa.int32()))],
                names=["y", "part", "kinds", "patterns"])

    # The labels that are broadcast are bounded by LABELLED.
    met = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    return met.select("text", "y", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("part")).mapInArrow(run, FEATURES)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = LABELLED) -> Classifier:
    """The classifier from the bounded draw of labelled texts.

    To the driver come the feature numbers of at most `bound` texts.
    """
    drawn = sample_labels(labels, label, bound)
    rows = []
    for r in _labelled_features(docs, drawn).toLocalIterator():
        rows.append((r["y"], r["part"], [np.array(k, np.int32) for k in r["kinds"]], np.array(r["patterns"], np.int8)))
    rows.sort(key=lambda r: (r[1], r[0], [len(k) for k in r[2]], r[2][0].tobytes()))
    makers, learners = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
    if not makers or not learners or not any(r[0] for r in makers):
        return Classifier(Lexicons(), np.zeros(DIMENSIONS + DENSE, np.float32), -40.0, {"texts": len(rows)})
    # Copies of one text would make a lexicon of all its words.
    makers = list({tuple(k.tobytes() for k in r[2]): r for r in makers}.values())
    n = [sum(1 for r in makers if r[0] == y) for y in (0, 1)]
    lexicons = Lexicons()
    for kind in range(1 + len(PREFIXES)):
        df = [np.bincount(np.concatenate([r[2][kind] for r in makers if r[0] == y] or [np.zeros(0, np.int32)]), minlength=DIMENSIONS) for y in (0, 1)]
        odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
        lexicons.add(kind, np.flatnonzero((df[1] >= LEXICON_TEXTS) & (odds >= LEXICON_ODDS)))
    votes = np.array([[*lexicons.votes(r[2]), *r[3]] for r in learners], dtype=np.int8)
    truth = np.array([r[0] for r in learners])
    model = LabelModel().fit(votes)
    posterior = model.posterior(votes)
    weights, intercept = fit_linear([lexicons.design(r[2]) for r in learners], posterior, DIMENSIONS + DENSE)
    report = {
        "texts": len(rows), "entries": (lexicons.voter > 0).sum(1).tolist(), "share": model.share, "weights": model.weights.tolist(),
        "agreement": float(((posterior >= 0.5) == truth).mean()), "found": float((posterior[truth == 1] >= 0.5).mean()) if truth.any() else 0.0,
    }
    return Classifier(lexicons, weights, intercept, report)


def score_texts(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """`docs` with `score`. The model that is sent to the tasks has a fixed size, 8 bytes by DIMENSIONS."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "score"]

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            scores = sent.value.scores(features(scan.utf8(batch.column(text))))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(scores, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", score double"
    return docs.select(*names).mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """`docs` with score and predicted."""
    return score_texts(docs, fit_toxicity(docs, labels, "toxic", bound)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity_scores(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
