import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain_rows import rows
from glossvec.functions.text import word_runs
from glossvec.operators import ranking as rk
from glossvec.operators import summaries as sm
from glossvec.plans import joins, ordering
from glossvec.plans.lookups import with_token_ids


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_salted_equals_broadcast(spark, how):
    # one key holds most of the rows
    big = spark.range(300).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("k"), "id")
    small = spark.range(3, 9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert rows(joins.lookup_join(big, small, "k", how, limit=0)) == rows(joins.lookup_join(big, small, "k", how))


def test_lookup_join_without_size_does_not_broadcast(spark):
    big, small = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    assert joins.measured_bytes(small) > 0
    assert not joins.fits_broadcast(small, 10) and joins.fits_broadcast(small)


@pytest.mark.parametrize("per_bucket", [None, 7])
def test_running_total_and_rank(spark, per_bucket):
    rng = np.random.default_rng(1)
    data = [(int(i), float(x), int(v)) for i, (x, v) in enumerate(zip(rng.integers(0, 30, 100), rng.integers(0, 9, 100)))]
    df = spark.createDataFrame(data, "i bigint, x double, v bigint").repartition(5)
    got = {r["i"]: (r["t"], r["n"]) for r in ordering.global_rank(
        ordering.running_total(df, F.col("x"), [F.col("i")], F.col("v"), "t", per_bucket), F.col("x"), [F.col("i")], "n", per_bucket
    ).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(data, key=lambda r: (r[1], r[0]))):
        assert got[i] == (total, n)
        total += v


@pytest.mark.parametrize("per_bucket", [None, 10])
def test_rank_within_groups_of_any_size(spark, per_bucket):
    df = spark.range(100).select(F.when(F.col("id") < 80, "hot").otherwise("cold").alias("g"), F.col("id").alias("x"))
    got = ordering.global_rank(df, F.col("x"), [F.col("x")], "n", per_bucket, within=["g"]).collect()
    assert all(r["n"] == (r["x"] if r["g"] == "hot" else r["x"] - 80) for r in got)


@pytest.mark.parametrize("key", ["nulls", "constant", "hot", "text"])
def test_order_loses_no_row_and_no_range_is_large(spark, key):
    keys = {
        "nulls": F.when(F.col("id") % 3 > 0, F.col("id") % 50), "constant": F.lit(1), "hot": F.when(F.col("id") < 950, 7).otherwise(F.col("id")),
        "text": F.when(F.col("id") % 11 > 0, F.concat(F.lit("d"), F.col("id").cast("string"))),
    }
    df = spark.range(1000).select("id", keys[key].alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("g")).repartition(5)
    for within in (None, ["g"]):
        one = rows(ordering.global_rank(df, F.col("k"), [F.col("id")], "n", within=within))
        assert rows(ordering.global_rank(df, F.col("k"), [F.col("id")], "n", 50, within=within)) == one and len(one) == 1000
        best = rows(ordering.running_max(df, F.col("k"), [F.col("id")], F.col("id"), "m"))
        assert rows(ordering.running_max(df, F.col("k"), [F.col("id")], F.col("id"), "m", 50)) == best
    dealt, n = ordering.with_order_bucket(df, [F.col("k"), F.col("id")], 50)
    assert n == 40 and dealt.groupBy("__b").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("per_bucket", [None, 8])
def test_exact_quantiles(spark, per_bucket):
    values = [3.0] * 40 + [float(i) for i in range(37)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = ordering.exact_quantiles(df, "x", probs, per_bucket)
    assert got == pytest.approx(list(np.quantile(values, probs)))
    assert ordering.exact_quantiles(df.where("x < 0"), "x", [0.5]) == [None]


@pytest.mark.parametrize("limit", [None, 0])
def test_token_ids(spark, limit):
    docs = spark.createDataFrame([(1, "b a x"), (2, ""), (3, "a a")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "word string, token_id bigint")
    got = with_token_ids(docs, word_runs("text"), vocab, limit=limit).select("doc_id", "ids")
    assert rows(got) == [(1, (6, 5, -1)), (2, ()), (3, (5, 5))]


def test_a_batch_goes_through_the_vocabulary_once(monkeypatch):
    from glossvec.plans import lookups

    names, numbers, seen = pa.array(["a", "b", None]), pa.array([5, 6, 7], pa.int64()), []
    look_up = lookups.pc.index_in
    monkeypatch.setattr(lookups.pc, "index_in", lambda values, value_set: seen.append(len(values)) or look_up(values, value_set=value_set))
    values = pa.array(["b", "x", None, "a"] * lookups.TOKENS_AT_A_TIME)
    assert lookups.numbers_of(values, names, numbers, -1).tolist() == [6, -1, 7, 5] * lookups.TOKENS_AT_A_TIME
    assert seen == [4]  # not the vocabulary hashed anew for every slice of the batch
    assert lookups.numbers_of(pa.array([], pa.string()), names, numbers, -1).tolist() == []
    assert lookups.numbers_of(values[:2], names[:0], numbers[:0], -1).tolist() == [-1, -1]


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "norm double")
    r = sm.describe_column(df, "norm").first()
    assert r["count"] == 3 and r["mean"] == pytest.approx(7 / 3) and r["p50"] == 2.0 and r["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    h = sm.norm_histogram(df, bins=3).orderBy("bin").collect()
    assert [x["n"] for x in h] == [1, 1, 1] and h[0]["lo"] == 1.0 and h[2]["hi"] == 4.0
    same = spark.createDataFrame([(2.0,), (2.0,)], "norm double")
    assert sum(x["n"] for x in sm.norm_histogram(same).collect()) == 2
    ten = spark.range(50).select(F.col("id").alias("o"), F.col("id").cast("double").alias("x"))
    assert sm.describe_first_n(ten, "o", "x", 10).first()["max"] == 9.0


def test_losses(spark):
    df = spark.createDataFrame([(0, 1.0), (199, 3.0), (200, 5.0)], "step bigint, loss double")
    assert rows(sm.running_mean_loss(df)) == [(0, 2.0), (1, 5.0)]
    assert sm.perplexity(df).first()["ppl"] == pytest.approx(math.exp(3))
    huge = spark.createDataFrame([(1e6,)], "loss double")
    assert sm.perplexity(huge).first()["ppl"] == math.inf
    docs = spark.createDataFrame([("x", "a a b"), ("y", "b")], "src string, text string")
    got = {r["src"]: r["ppl"] for r in sm.corpus_perplexity(docs, "src").collect()}
    assert got["x"] == pytest.approx(2.0) and got["y"] == pytest.approx(2.0)


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    assert rows(sm.column_profile(df)) == [("i", "int", 3), ("s", "string", 2)]
    assert sm.duplicate_rows(df).first()["n_extra"] == 1
    assert sm.duplicate_rows(df.limit(0)).first()["n_extra"] == 0


@pytest.mark.parametrize("per_bucket", [None, 4])
def test_thirds_give_the_remainder_to_the_last(spark, per_bucket):
    df = spark.createDataFrame([(f"w{i}", i, float(20 - i)) for i in range(11)], "word string, token_id bigint, norm double")
    got = rk.norm_rank_thirds(df, per_bucket).groupBy("third").count()
    assert rows(got) == [(0, 3), (1, 3), (2, 5)]


@pytest.mark.parametrize("per_bucket", [None, 5])
def test_samples_come_from_their_group(spark, per_bucket):
    df = spark.range(40).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 2).alias("third"))
    base = rows(rk.sample_per_group(df, k=6))
    got = rows(rk.sample_per_group(df.repartition(7), k=6, rows_per_bucket=per_bucket))
    assert got == base and len(got) == 12
    assert all(int(w[1:]) % 2 == g for g, _, w in got)


def test_sort_token_ids(spark):
    seq = spark.createDataFrame([(1, [9, 1, 5, 3]), (2, [7]), (3, [])], "doc_id bigint, ids array<bigint>")
    assert rows(rk.sort_token_ids(seq, 2, 3)) == [(1, (1, 3), (3, 5, 9)), (2, (7,), (7,)), (3, (), ())]


def test_a_large_lookup_is_copied_for_heavy_keys_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 50)
    big = spark.range(300).select(F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 5 > 0, F.col("id") % 11).alias("k"), "id")
    small = spark.range(3, 90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r["k"] for r in joins._heavy_keys(big, ["k"]).collect()] == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.lookup_join(big, small, "k", how, limit=0)) == rows(joins.lookup_join(big, small, "k", how))
    # Every lookup row that no heavy key needs is shuffled once: as a lookup of itself, its rows are not copied.
    copies = joins.lookup_join(small.withColumnRenamed("v", "w"), small, "k", limit=0)
    assert "sequence" not in copies._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("frequent", [0, 2, 100])
def test_only_rare_words_of_losses_are_rows(spark, frequent):
    docs = spark.createDataFrame([(1, "the cat the dog"), (2, "the"), (3, "owl cat"), (4, None), (5, "..."), (2, "dog")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["loss"] for r in sm.mean_word_losses(docs, frequent=frequent).collect()}
    loss = {w: -math.log(n / 8) for w, n in {"the": 3, "cat": 2, "dog": 2, "owl": 1}.items()}
    words = {1: ["the", "cat", "the", "dog"], 2: ["the", "dog"], 3: ["owl", "cat"]}
    assert got == pytest.approx({k: sum(loss[w] for w in ws) / len(ws) for k, ws in words.items()})
