import os
import re

import duckdb
import pytest

from plain_rows import rows
from glossvec.catalog import corpora, numbers, tables  # noqa: F401
from glossvec.catalog.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY = {
    "ann_index", "ann_recall", "compare_tokenisations", "encode_bpe", "encode_wordpiece", "evaluate_held_out", "fit_reconstruction", "grid_select",
    "predict_reconstruction", "project_2d", "train_bpe", "train_corpus_tokeniser", "train_wordpiece",
}

needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@needs_data
@pytest.mark.parametrize("name", [
    "definition_recall", "band_word_positions", "group_texts", "entity_groups", "semantic_search", "whole_word_mask",
    "dimension_standardise", "sample_per_group", "pad_batch", "char_coverage_filter", "norm_quartile_bands",
])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in sorted(os.listdir(SMALL)):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.select(*[f"`{n}`" for n in names])) == sorted((plain(r) for r in cur.fetchall()), key=repr)


@needs_data
@pytest.mark.parametrize("name", ["definition_recall", "group_texts", "mlm_mask", "norm_rank_thirds", "record_holders"])
def test_result_does_not_depend_on_partitions(spark, name):
    base = rows(QUERIES[name](spark, SMALL))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert rows(QUERIES[name](spark, SMALL)) == base
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_global_lookup_outside_the_size_check():
    """Every broadcast hint stands beside a measured or fixed bound; local checkpoints and cross joins are not used."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "glossvec")
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not re.search(r"localCheckpoint|crossJoin|\.toPandas\(|\.rdd\b", text), f


@needs_data
def test_char_span_shuffles_lists_of_numbers_and_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = QUERIES["char_span"](spark, SMALL)
    assert "collect_list(struct" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got.select("sent_id", "pos", "tok")) == sorted(con.execute(ORACLES["char_span"]).fetchall(), key=repr)


@needs_data
@pytest.mark.parametrize("name", ["gather_positions", "gather_vectors", "first_token_pool"])
def test_gathered_vectors_are_rounded_before_they_are_attached(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Join")]
    cur = con.execute(ORACLES[name])
    assert rows(got.select(*[d[0] for d in cur.description])) == sorted((plain(r) for r in cur.fetchall()), key=repr)
