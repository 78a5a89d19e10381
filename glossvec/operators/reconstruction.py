"""Linear reconstruction of a word's vector from its definition vector.

The normal equations are summed over the cluster; only matrices of the vector
width (width x width) reach the driver, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossvec.operators.filters import norm_band_filter
from glossvec.operators.pooling import mse, norm_shrink_rate
from glossvec.plans.lookups import as_list

_GRAM_ROWS = "part int, i int, row array<double>"


def training_pairs(
    x: DataFrame, y: DataFrame, lexicon: DataFrame | None = None, lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Definition vector and word vector of every word, within a norm band if one is given: token_id, x, y."""
    pairs = x.select("token_id", F.col("v").alias("x")).join(y.select("token_id", F.col("v").alias("y")), "token_id")
    if lexicon is None:
        return pairs
    return pairs.join(norm_band_filter(lexicon, lo, hi).select("token_id"), "token_id", "left_semi")


def _stack(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _partial_grams(batches):
    """Per task and part, the rows of [x y]'[x y]."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        both = np.hstack([_stack(batch.column(1)), _stack(batch.column(2))])
        parts = batch.column(0).to_numpy(zero_copy_only=False)
        for part in np.unique(parts):
            z = both[parts == part]
            sums[int(part)] = sums.get(int(part), 0) + z.T @ z
    for part, g in sums.items():
        size = len(g)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, part, np.int32)),
                pa.array(np.arange(size, dtype=np.int32)),
                as_list(pa.array(g.ravel()), np.full(size, size)),
            ],
            ["part", "i", "row"],
        )


def gram_rows(pairs: DataFrame, part=None) -> DataFrame:
    """Rows of the summed [x y]'[x y], by part: part, i, row[]."""
    number = F.lit(0) if part is None else part
    partial = pairs.select(number.cast("int").alias("part"), "x", "y").mapInArrow(_partial_grams, _GRAM_ROWS)
    total = Summarizer.sum(array_to_vector("row"))
    return partial.groupBy("part", "i").agg(vector_to_array(total).alias("row"))


def gram_long(pairs: DataFrame) -> DataFrame:
    """Entries of x'x and x'y: kind, i, j, s."""
    rows = gram_rows(pairs).select("i", (F.size("row") / 2).cast("int").alias("d"), F.posexplode("row").alias("j", "s"))
    inner = rows.where(F.col("i") < F.col("d"))
    kind = F.when(F.col("j") < F.col("d"), "xx").otherwise("xy")
    return inner.select(
        kind.alias("kind"),
        F.col("i").cast("bigint").alias("i"),
        F.pmod("j", "d").cast("bigint").alias("j"),
        "s",
    )


def _matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():  # (2 x width) rows per part
        g = out.setdefault(r["part"], np.zeros((len(r["row"]), len(r["row"]))))
        g[r["i"]] = r["row"]
    return out


def _solve(g: np.ndarray, lam: float) -> np.ndarray:
    d = len(g) // 2
    return np.linalg.solve(g[:d, :d] + lam * np.eye(d), g[:d, d:])


def _as_table(spark, w: np.ndarray) -> DataFrame:
    i, j = np.indices(w.shape)
    rows = pa.table({"i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "w": w.ravel()})
    return spark.createDataFrame(rows)


def fit_reconstruction(pairs: DataFrame, lam: float = 1e-3) -> DataFrame:
    """The ridge map W of least squared error with x W = y: i, j, w."""
    g = _matrices(gram_rows(pairs)).get(0)
    if g is None:
        raise ValueError("no training pairs")
    return _as_table(pairs.sparkSession, _solve(g, lam))


def weight_matrix(w: DataFrame) -> np.ndarray:
    """The map as a matrix; width x width entries."""
    t = w.select("i", "j", "w").toArrow()
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    m = np.zeros((i.max() + 1, j.max() + 1))
    m[i, j] = t["w"].to_numpy()
    return m


def predict_reconstruction(x: DataFrame, w: DataFrame, key: str = "token_id") -> DataFrame:
    """x W for every row: key, v. No shuffle; the map is width x width."""
    shipped = x.sparkSession.sparkContext.broadcast(weight_matrix(w))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def apply(v: pa.Array) -> pa.Array:
        m = shipped.value
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), m.shape[0])
        return as_list(pa.array((flat @ m).ravel()), np.full(len(v), m.shape[1]))

    return x.select(key, apply("v").alias("v"))


def evaluate_reconstruction(sheet: DataFrame, vectors: DataFrame, on: str = "token_id") -> DataFrame:
    """Mean squared error, and the share of words whose own norm exceeds the reconstructed one: mse, rate."""
    return mse(sheet, vectors, on).withColumn("rate", norm_shrink_rate(vectors, sheet, on).scalar())


def grid_select(pairs: DataFrame, lams: list[float], holdout) -> DataFrame:
    """Held-out mean squared error of every ridge weight, best first: lam, mse, best.

    One pass sums the normal equations of the training and the held-out rows;
    the error of a map is then a function of the held-out sums alone.
    """
    marked = pairs.withColumn("__h", holdout.cast("int"))
    n = marked.agg(F.sum("__h").alias("n")).first()["n"] or 0
    g = _matrices(gram_rows(marked, F.col("__h")))
    if 0 not in g or not n:
        raise ValueError("both training and held-out rows are needed")
    d = len(g[0]) // 2
    held = g[1]
    rows = []
    for lam in lams:
        w = _solve(g[0], lam)
        total = np.trace(w.T @ held[:d, :d] @ w) - 2 * np.trace(w.T @ held[:d, d:]) + np.trace(held[d:, d:])
        rows.append((float(lam), float(total) / (n * d)))
    least = min(m for _, m in rows)
    rows = sorted(((lam, m, m == least) for lam, m in rows), key=lambda r: r[1])
    return pairs.sparkSession.createDataFrame(rows, "lam double, mse double, best boolean")
