import math

import numpy as np
import pytest

from glossvec.catalog import numbers  # noqa: F401
from glossvec.catalog.inputs import inputs
from glossvec.catalog.registry import QUERIES
from glossvec.operators import recall as rc
from glossvec.operators import screening as sc
from glossvec.operators import vector_index as vi

RNG = np.random.default_rng(29)


def vector_rows(spark, v, key="token_id"):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], f"{key} bigint, v array<double>")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    v = RNG.normal(size=(330, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_every_row_is_searched_for(spark, tables):
    found = QUERIES["ann_index"](spark, tables)
    assert {r["query_id"] for r in found.select("query_id").distinct().collect()} == set(range(330))


def test_the_recall_is_that_of_every_row(spark, tables):
    r = QUERIES["ann_recall"](spark, tables).first()
    hits = {(h["query_id"], h["hit_id"]) for h in QUERIES["ann_index"](spark, tables).collect()}
    x = inputs(spark, tables)
    exact = {(h["query_id"], h["hit_id"]) for h in rc.l2_recall(x.vectors.withColumnRenamed("token_id", "query_id"), x.vectors).collect()}
    assert r["wanted"] == 3300 == len(exact) and r["found"] == len(exact & hits) and r["pairs"] == 330 * 330


def test_probes_are_measured_on_all_vectors(spark):
    # 400 vectors on their own, whose ten nearest lie in many cells, and 500 close together in one.
    v = np.r_[RNG.normal(size=(400, 4)) * 9, RNG.normal(size=(500, 4)) * 1e-3]
    df = vector_rows(spark, v).repartition(5)
    index = vi.build_index(df, cells=30)
    cell = {i: r["bucket"] for r in index.blocks.select("bucket", "b_ids").collect() for i in r["b_ids"]}
    names, centres = index.centres
    gaps = ((v[:, None, :] - v[None, :, :]) ** 2).sum(2).round(6)
    needed = []
    for i in range(len(v)):
        order = names[vi._cell_order(v[i : i + 1], centres, len(names))[0]].tolist()
        needed += [order.index(cell[h]) for h in np.lexsort((np.arange(len(v)), gaps[i]))[:10]]
    exact = spark.createDataFrame(rc.l2_recall(df.withColumnRenamed("token_id", "query_id"), df).select("query_id", "hit_id").toPandas())
    assert index.probes_for(df, 10) == sorted(needed)[math.ceil(0.92 * len(needed)) - 1] + 1
    for target in (0.8, 0.97, 1.0):
        assert index.probes_for(df, 10, target, exact) == sorted(needed)[math.ceil(target * len(needed)) - 1] + 1


def test_centres_are_those_of_all_vectors_however_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(vi, "FIT_ROWS", 100)
    v = np.r_[np.zeros((300, 3)), np.ones((1, 3)) * 50] + RNG.normal(size=(301, 3)) * 0.01
    indexes = [vi.build_index(vector_rows(spark, v).repartition(n), cells=2) for n in (1, 7)]
    assert [sorted(c["n"] for c in i.cells) for i in indexes] == [[1, 300]] * 2
    assert np.allclose(indexes[0].centres[1], indexes[1].centres[1])


def test_a_search_sends_vectors_to_groups_of_queries_not_queries_to_cells(spark, monkeypatch):
    monkeypatch.setattr(vi, "LEAST_ASKED", 50)
    v = RNG.normal(size=(900, 5))
    index = vi.build_index(vector_rows(spark, v), cells=20)
    asked = vector_rows(spark, v, "query_id")
    found = index.search(asked, 10, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    names, centres = index.centres
    cells = {}
    for b in index.blocks.select("bucket", "b_ids").collect():
        cells.setdefault(b["bucket"], []).extend(b["b_ids"])
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["hit_id"], r["distance"])
    for i in range(0, 900, 37):
        near = np.array(sorted(h for c in names[vi._cell_order(v[i : i + 1], centres, 7)[0]] for h in cells[c]))
        gap = ((v[near] - v[i]) ** 2).sum(1).round(6)
        best = near[np.lexsort((near, gap))[:10]]
        assert [got[i][r + 1][0] for r in range(10)] == best.tolist()
    assert index.pairs_scored(asked, 20) == 900 * 900


def test_best_of_some_rows(spark):
    q, b = RNG.normal(size=(400, 8)), RNG.normal(size=(1000, 8))
    best, some = sc.Best(q, "l2", 6), np.arange(0, 400, 3)
    best.add(np.arange(1000), b, some)
    rows, hits, _, _ = best.ranked(0)
    want = sc.best_of_block(some, q[some], np.arange(1000), b, "l2", 6)
    assert rows.tolist() == want[0].tolist() and hits.tolist() == want[1].tolist()
