import re

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_rows import rows
from glossvec.plans.lookups import with_token_ids
from glossvec.operators import pooling as pl
from glossvec.catalog import numbers  # noqa: F401
from glossvec.catalog.inputs import inputs
from glossvec.catalog.registry import QUERIES
from glossvec.operators import recall as rc
from glossvec.operators import reconstruction as rec
from glossvec.operators import search as se
from glossvec.operators import vector_index as vi

RNG = np.random.default_rng(3)
BASE = RNG.normal(size=(60, 6))
BASE[41] = BASE[40]  # a tie


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(BASE)], "token_id bigint, v array<double>")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(f"w{i}", i) for i in range(60)], "word string, token_id bigint")


def brute(q, k, skip, metric):
    out = []
    for i, v in q.items():
        if metric == "l2":
            s = np.round(((BASE - v) ** 2).sum(1), 6)
            order = np.lexsort((np.arange(len(s)), s))
        else:
            s = np.round(BASE @ v / np.maximum(np.linalg.norm(BASE, axis=1) * np.linalg.norm(v), 1e-8), 6)
            order = np.lexsort((np.arange(len(s)), -s))
        out += [(i, int(h), pytest.approx(s[h]), r + 1) for r, h in enumerate(order) if skip <= r < skip + k]
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("how", [{}, {"vocab_block": 13}, {"vocab_block": 13, "limit": 0}])
def test_nearest_equals_brute_force(spark, vectors, metric, how):
    q = vectors.withColumnRenamed("token_id", "query_id").repartition(3)
    got = rc.nearest(q, vectors, 5, 1, metric, **how)
    want = brute(dict(enumerate(BASE)), 5, 1, metric)
    assert sorted(tuple(r) for r in got.select("query_id", "hit_id", "distance", "rank").collect()) == sorted(want, key=lambda r: (r[0], r[1]))


def test_more_hits_than_vectors(spark, vectors):
    few = vectors.where("token_id < 3")
    q = few.withColumnRenamed("token_id", "query_id")
    assert rc.l2_recall(q, few, 10).count() == 9
    assert rc.cosine_recall(q.limit(0), few, 10).count() == 0


def test_zero_vector_has_zero_cosine(spark, vectors):
    q = spark.createDataFrame([(1, [0.0] * 6)], "query_id bigint, v array<double>")
    assert {r["distance"] for r in rc.cosine_recall(q, vectors, 5).collect()} == {0.0}


@pytest.mark.parametrize("limit", [None, 0])
def test_definition_vectors(spark, vectors, vocab, limit):
    defs = spark.createDataFrame(
        [(0, ["w1", "w2", "w2", "zz"]), (1, ["zz"]), (2, ["w3"]), (3, [])], "token_id bigint, tokens array<string>"
    )
    got = {r["token_id"]: r["v"] for r in pl.definition_vectors(defs, vocab, vectors, limit).collect()}
    assert set(got) == {0, 2}
    assert got[0] == pytest.approx(list((BASE[1] + 2 * BASE[2]) / 3)) and got[2] == pytest.approx(list(BASE[3]))


def test_mean_standardise_and_mse(spark, vectors):
    grouped = vectors.withColumn("g", F.col("token_id") % 2)
    got = {r["g"]: r["v"] for r in pl.mean_vector(grouped, "g").collect()}
    assert got[1] == pytest.approx(list(BASE[1::2].mean(0)))
    one = {r["token_id"]: r["v"] for r in pl.global_standardise(vectors).collect()}
    assert one[5] == pytest.approx(list((BASE[5] - BASE.mean()) / BASE.std(ddof=1)))
    dim = {r["token_id"]: r["v"] for r in pl.dimension_standardise(vectors).collect()}
    assert dim[5] == pytest.approx(list((BASE[5] - BASE.mean(0)) / np.sqrt(BASE.var(0) + 1e-5)))
    shifted = vectors.select("token_id", F.transform("v", lambda x: x + 2.0).alias("v"))
    assert pl.mse(vectors, shifted).first()["mse"] == pytest.approx(4.0)
    double = vectors.select("token_id", F.transform("v", lambda x: x * 2.0).alias("v"))
    assert pl.norm_shrink_rate(double, vectors).first()["rate"] == 1.0
    gap = {r["i"]: r["gap"] for r in pl.per_dimension_squared_gap(vectors, [0.0] * 6).collect()}
    assert gap[2] == pytest.approx((BASE[:, 2] ** 2).sum())
    assert rows(pl.vectors_wide(pl.vectors_long(vectors))) == rows(vectors)


def test_sheet_lookup(spark):
    sheet = spark.createDataFrame([("a", [1.0])], "word string, v array<double>")
    tokens = spark.createDataFrame([("a",), ("b",)], "word string")
    assert pl.sheet_lookup(tokens, sheet, strict=False).count() == 1
    with pytest.raises(Exception, match="no sheet vector for b"):
        pl.sheet_lookup(tokens, sheet).collect()


def test_patch_and_positions(spark, vectors, vocab):
    lexicon = spark.createDataFrame([("w1", 1, 1.5), ("w2", 2, 9.0)], "word string, token_id bigint, norm double")
    sheet = spark.createDataFrame([("w1", [0.0] * 6), ("w2", [0.0] * 6)], "word string, v array<double>")
    got = {r["token_id"]: r["v"] for r in pl.patch_band_vectors(vectors, sheet, lexicon, 1.0, 2.0).collect()}
    assert len(got) == 60 and got[1] == [0.0] * 6 and got[2] == pytest.approx(list(BASE[2]))
    seq = spark.createDataFrame([(7, [4, 5, -1])], "doc_id bigint, ids array<bigint>")
    at = spark.createDataFrame([(7, [1, 2, 9])], "doc_id bigint, positions array<bigint>")
    assert [(r["pos"], r["id"]) for r in pl.gather_positions(seq, at, vectors).collect()] == [(1, 5)]
    assert pl.first_token_pool(seq, vectors).first()["v"] == pytest.approx(list(BASE[4]))
    chars = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0])], "ch string, v array<double>")
    lex = spark.createDataFrame([("aab",), ("zz",)], "word string")
    assert rows(pl.char_mean_word_vector(lex, chars)) == [("aab", (pytest.approx(5 / 3), pytest.approx(11 / 3)))]


@pytest.mark.parametrize("limit", [None, 20_000, 1_000, 0])
def test_positions_beyond_the_limit_are_found_once(spark, vectors, limit):
    many = vectors.unionByName(spark.range(100, 400).select(F.col("id").alias("token_id"), F.array(*[F.lit(0.5)] * 6).alias("v")))
    seq = spark.createDataFrame([(7, [4, 5, -1]), (8, [5, 900, 40]), (8, [6])], "doc_id bigint, ids array<bigint>")
    at = spark.createDataFrame([(7, [1, 2, 9]), (8, [0, 1, 2]), (9, [0])], "doc_id bigint, positions array<bigint>")
    got = pl.gather_positions(seq, at, many, limit=limit)
    assert rows(got.select("doc_id", "pos", "id")) == [(7, 1, 5), (8, 0, 5), (8, 0, 6), (8, 2, 40)]
    assert all(r["v"] == pytest.approx(list(BASE[r["id"]])) for r in got.collect())
    assert ("asked-ids" in " ".join(got.inputFiles())) == (limit is not None)
    filled = pl.gather_positions(seq, at, many, unknown=[9.0] * 6, limit=limit).where("id IN (-1, 900)")
    assert rows(filled) == [(7, 2, -1, (9.0,) * 6), (8, 1, 900, (9.0,) * 6)]


def test_reports(spark, vectors, vocab):
    lexicon = spark.createDataFrame([("w1", "first"), ("w2", "two")], "word string, definition string")
    words = vocab.where("token_id IN (1, 2, 3)")
    q = vectors.where("token_id IN (1, 2, 3)").withColumnRenamed("token_id", "query_id")
    report = rc.recall_report(q, words, vocab, vectors, lexicon, 4)
    got = {(r["word"], r["method"]): r for r in report.collect()}
    assert len(got) == 9 and all(len(r["hits"]) == 4 == len(r["distances"]) for r in got.values())
    assert got["w1", "norm"]["hits"][0] == "w1" and got["w1", "cosine"]["hits"] == got["w1", "original"]["hits"]
    assert got["w1", "norm"]["definition"] == "first" and got["w3", "norm"]["definition"] is None
    hits = rc.recall_hits(q, words, vocab, vectors, 4)
    both = rc.stage_compare(hits, hits).collect()
    assert len(both) == 36 and all(r["hit_1"] == r["hit_2"] for r in both)


def test_definitions_of_a_hot_word_stay_rows(spark):
    lexicon = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("word"), F.col("id").alias("doc_id"), F.lit("d").alias("definition"))
    words = spark.createDataFrame([("hot", 1), ("w160", 2), ("none", 3)], "word string, token_id bigint")
    got = rc.attach_definition(words, lexicon).select("word", "token_id", "place", "definition").collect()
    assert sum(r["word"] == "hot" for r in got) == 150 and sum(r["word"] == "w160" and r["place"] == 160 for r in got) == 1
    assert [tuple(r) for r in got if r["word"] == "none"] == [("none", 3, None, None)] and len(got) == 152


@pytest.mark.parametrize("limit", [None, 0])
def test_nearest_examples_of_two_keys(spark, vectors, limit):
    corpus = vectors.select((F.col("token_id") % 3).alias("a"), F.col("token_id").alias("b"), "v")
    q = vectors.where("token_id IN (40, 3, 9)").withColumnRenamed("token_id", "query_id")
    got = rc.nearest_examples(q, corpus, ["a", "b"], [], 3, limit=limit).collect()
    assert {(r["query_id"], r["b"]) for r in got if r["rank"] == 1} == {(40, 40), (3, 3), (9, 9)} and len(got) == 9


@pytest.mark.parametrize("limit", [None, 0])
def test_a_repeated_word_has_its_lowest_id(spark, vectors, limit):
    vocab = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "word string, token_id bigint")
    docs = spark.createDataFrame([(7, ["a", "b", "x", "a"])], "token_id bigint, tokens array<string>")
    ids = with_token_ids(docs, F.col("tokens"), vocab, key="token_id", limit=limit).first()["ids"]
    assert ids == [1, 3, -1, 1]
    mean = pl.definition_vectors(docs, vocab, vectors, limit).first()["v"]
    assert mean == pytest.approx(list((2 * BASE[1] + BASE[3]) / 3))


@pytest.mark.parametrize("limit", [None, 0])
def test_nearest_examples(spark, vectors, limit):
    corpus = vectors.withColumn("note", F.concat(F.lit("n"), "token_id")).repartition(5)
    q = vectors.where("token_id IN (40, 3)").withColumnRenamed("token_id", "query_id")
    got = rc.nearest_examples(q, corpus, ["token_id"], ["note"], 3, limit=limit)
    want = brute({3: BASE[3], 40: BASE[40]}, 3, 0, "l2")
    found = sorted(tuple(r) for r in got.select("query_id", "token_id", "distance", "rank").collect())
    assert found == sorted(want, key=lambda r: (r[0], r[1]))
    assert all(r["note"] == f"n{r['token_id']}" for r in got.collect())


def test_reconstruction(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    w = rng.normal(size=(4, 4))
    y = x @ w + 0.01 * rng.normal(size=(80, 4))

    def table(m):
        return spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(m)], "token_id bigint, v array<double>")

    pairs = rec.training_pairs(table(x), table(y)).repartition(3)
    lam = 0.1
    fitted = rec.weight_matrix(rec.fit_reconstruction(pairs, lam))
    # normal equations hold
    assert np.abs(x.T @ (x @ fitted - y) + lam * fitted).max() < 1e-9
    pred = {r["token_id"]: r["v"] for r in rec.predict_reconstruction(table(x), rec.fit_reconstruction(pairs, lam)).collect()}
    assert pred[9] == pytest.approx(list(x[9] @ fitted))
    gram = {(r["kind"], r["i"], r["j"]): r["s"] for r in rec.gram_long(pairs).collect()}
    assert gram["xx", 1, 2] == pytest.approx(x[:, 1] @ x[:, 2]) and gram["xy", 3, 0] == pytest.approx(x[:, 3] @ y[:, 0])
    grid = rec.grid_select(pairs, [1e-3, 1e3], F.col("token_id") % 4 == 0).collect()
    held = np.arange(80) % 4 == 0
    for r in grid:
        m = np.linalg.solve(x[~held].T @ x[~held] + r["lam"] * np.eye(4), x[~held].T @ y[~held])
        assert r["mse"] == pytest.approx(((x[held] @ m - y[held]) ** 2).mean())
    assert [r["lam"] for r in grid if r["best"]] == [1e-3]
    lexicon = spark.createDataFrame([(f"w{i}", i, i / 10) for i in range(80)], "word string, token_id bigint, norm double")
    assert rec.training_pairs(table(x), table(y), lexicon, 1.0, 2.0).count() == 9


def test_approximate_search_is_a_subset_with_exact_scores(spark, vectors):
    got = se.ann_index(vectors, cells=6, k=5, probes=3).collect()
    for r in got:
        assert r["distance"] == pytest.approx(((BASE[r["query_id"]] - BASE[r["hit_id"]]) ** 2).sum(), abs=1e-6)
    own = {r["query_id"] for r in got if r["rank"] == 1 and r["distance"] == 0.0}
    assert own == set(range(60))
    exact = {(r[0], r[1]) for r in brute(dict(enumerate(BASE)), 5, 0, "l2")}
    assert len({(r["query_id"], r["hit_id"]) for r in got} & exact) / len(exact) > 0.6


def clustered(n=1500, groups=30, width=16):
    rng = np.random.default_rng(5)
    return rng.normal(size=(groups, width))[np.arange(n) % groups] * 4 + rng.normal(size=(n, width)) * 0.3


def vector_rows(spark, v):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "token_id bigint, v array<double>")


def test_index_finds_nine_of_ten_with_a_tenth_of_the_pairs(spark):
    v = clustered()
    r = se.ann_recall(vector_rows(spark, v)).first()
    assert r["wanted"] == 15_000 and r["recall"] >= 0.9 and r["share"] <= 0.1
    assert r["pairs"] == 1500 * 1500 and r["share"] == pytest.approx(r["scored"] / r["pairs"])


def test_index_of_all_cells_is_exact_whatever_the_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(rc, "VOCAB_BLOCK", 7)
    monkeypatch.setattr(rc, "QUERY_BLOCK", 5)
    index = vi.build_index(vectors, cells=3)
    assert index.blocks.count() > 3 and index.blocks.agg(F.sum("n")).first()[0] == 60
    got = index.search(vectors.withColumnRenamed("token_id", "query_id"), 5, 3)
    want = sorted(brute(dict(enumerate(BASE)), 5, 0, "l2"), key=lambda r: (r[0], r[1]))
    assert sorted(tuple(r) for r in got.select("query_id", "hit_id", "distance", "rank").collect()) == want
    assert index.pairs_scored(vectors.withColumnRenamed("token_id", "query_id"), 3) == 3600


def test_search_reads_the_probed_cells_only(spark):
    v = clustered()
    index = vi.build_index(vector_rows(spark, v), cells=30)
    asked = vector_rows(spark, v[:1]).withColumnRenamed("token_id", "query_id")
    found = index.search(asked, 10, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], (?:Push|Read)", plan, re.S)
    assert filters, plan
    filters = filters.group(1)
    assert len(index.cells) > 20 and re.search(r"bucket#\d+ IN \(\d+,\d+\)", filters)
    assert found.first()["hit_id"] == 0 and found.count() == 10


def test_index_of_few_equal_or_no_vectors(spark):
    none = vector_rows(spark, np.zeros((0, 4)))
    assert se.ann_index(none).collect() == []
    assert se.ann_recall(none).first()["wanted"] == 0
    same = vector_rows(spark, np.ones((9, 4))).unionByName(spark.createDataFrame([(9, None)], "token_id bigint, v array<double>"))
    got = se.ann_index(same, k=3).collect()
    assert {(r["query_id"], r["hit_id"]) for r in got} == {(q, h) for q in range(9) for h in range(3)}


def test_hot_bucket_is_split(spark, vectors, monkeypatch):
    monkeypatch.setattr(rc, "VOCAB_BLOCK", 7)
    monkeypatch.setattr(rc, "QUERY_BLOCK", 5)
    routed = vectors.withColumn("bucket", F.lit(1))
    got = rc.nearest_in_buckets(routed.withColumnRenamed("token_id", "query_id"), routed, 5)
    want = brute(dict(enumerate(BASE)), 5, 0, "l2")
    assert sorted(tuple(r) for r in got.select("query_id", "hit_id", "distance", "rank").collect()) == sorted(want, key=lambda r: (r[0], r[1]))


def test_projection(spark, vectors):
    got = np.array([[r["x"], r["y"]] for r in se.project_2d(vectors).orderBy("token_id").collect()])
    centred = BASE - BASE.mean(0)
    _, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.var(got, axis=0) == pytest.approx(s[:2] ** 2 / 60)


def test_semantic_search(spark, vectors, vocab):
    long = " ".join(["w7"] * 16)
    issues = spark.createDataFrame(
        [
            (1, "w1", "w2", False, [long, "short"]),
            (2, "w7", "w7", False, [long]),
            (3, "w7", "w7", True, [long]),
            (4, "w7", None, False, [long]),
        ],
        "conv_id bigint, title string, body string, is_pr boolean, comments array<string>",
    )
    got = se.semantic_search(issues, "w7", vocab, vectors, 5).orderBy("rank").collect()
    assert [r["conv_id"] for r in got] == [2, 1] and got[0]["distance"] == 0.0
    shift = se.embedding_shift(vectors, vectors).where("which = 'shift'").first()
    assert shift["count"] == 60 and shift["mean"] == 0.0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_beyond_the_limit_vectors_meet_words_and_queries_in_blocks_not_in_a_join(spark, vectors, vocab):
    defs = spark.createDataFrame([(i % 40, [f"w{(i * 7 + j * j) % 60}" for j in range(9)]) for i in range(50)] + [(None, ["w3", "w4"])], "token_id bigint, tokens array<string>")
    got = pl.definition_vectors(defs, vocab, vectors, 2000)
    words = {}
    for r in defs.collect():
        words.setdefault(r["token_id"], []).extend(r["tokens"])
    ids = {r["word"]: r["token_id"] for r in vocab.collect()}
    means = {r["token_id"]: r["v"] for r in got.collect()}
    assert set(means) == {k for k, w in words.items() if any(x in ids for x in w)}
    for k, v in means.items():
        assert v == pytest.approx(list(np.mean([BASE[ids[w]] for w in words[k] if w in ids], axis=0)))
    near = rc.nearest(vectors.withColumnRenamed("token_id", "query_id"), vectors, 3, limit=2000)
    assert "Join" not in _plan(near) and near.count() == 3 * vectors.count()
    coded = pl._known_ids(defs, vocab, 1 << 20, "token_id")
    assert "Join" not in _plan(pl._block_sums(coded, vectors, "token_id")) and "Summarizer" not in _plan(got)


def test_a_definition_shuffles_each_dimension_once_however_many_blocks(spark, vectors, vocab, monkeypatch):
    defs = spark.createDataFrame([(i, [f"w{(i * 7 + j * j) % 60}" for j in range(9)]) for i in range(50)], "token_id bigint, tokens array<string>")
    made, sums = [], pl._block_sums
    monkeypatch.setattr(pl, "_block_sums", lambda *a: made.append(sums(*a)) or made[-1])
    got = {r["token_id"]: r["v"] for r in pl.definition_vectors(defs, vocab, vectors, 2000).collect()}
    assert len(made) > 2 and sum(r["s"] for m in made for r in m.select(F.size("v").alias("s")).collect()) == 6 * 50
    for r in defs.collect():
        assert got[r["token_id"]] == pytest.approx(list(np.mean([BASE[int(w[1:])] for w in r["tokens"]], axis=0)))


def test_the_stored_lexicon_holds_no_text(spark):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("test tables are not here")
    x = inputs(spark, small)
    assert x.lexicon.columns == ["entry", "word", "token_id", "norm"]
    assert x.lexicon.exceptAll(x.defined_lexicon.drop("definition")).count() == 0 and x.lexicon.count() == x.defined_lexicon.count()


def test_the_index_is_asked_for_every_twentieth_row(spark):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("test tables are not here")
    n = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 20 = 0").count()
    asked = {r["query_id"] for r in QUERIES["ann_index"](spark, small).select("query_id").collect()}
    assert len(asked) == n and all(q % 20 == 0 for q in asked)
    assert QUERIES["ann_recall"](spark, small).first()["wanted"] == 10 * n
