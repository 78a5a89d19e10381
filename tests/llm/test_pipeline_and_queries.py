import os
import zlib

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from glossvec.llm import best_fit_packing, quality_rules
from glossvec.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) == {"op2_chat_prefixes", "op3_quality_rules", "op4_line_dedup", "op5_exact_dedup", "op11_filter_audit"}


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, against plain Python."""
    rows = [r for r in dict(data.prose_texts()).items() if r[0] is not None]
    docs = data.documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r[0] for r in quality_rules.judge(docs).where("kept").select("doc_id").collect()}
    rows = [(d, t) for d, t in rows if d in kept]
    assert len(rows) > 100
    groups = {}
    for d, t in rows:
        k = data.BLANK.sub("", t or "")
        groups[k] = min(groups.get(k, (0, 1 << 60)), (-len(t or ""), d))
    stay = {d for _, d in groups.values()}
    rows = [(d, t) for d, t in rows if d in stay]
    stay = {d for d, _, c in data.near_groups(rows, 5) if d == c}
    rows = [(d, t) for d, t in rows if d in stay]
    left = dict(zip([d for d, _ in rows], data.left_texts(rows, corpus_pipeline.PASSAGE)))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in rows}
    assert len(out) == len({(r["doc_id"], r["piece"]) for r in out})
    encode = best_fit_packing._encoder(*best_fit_packing.public_files())
    found = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        found.setdefault(r["doc_id"], []).append((r["length"], r["ids_crc32"]))
    for d, _ in rows:
        ids = [*encode(left[d] or ""), best_fit_packing.END]
        want = [(n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())) for at, n in best_fit_packing.cut_pieces(len(ids), best_fit_packing.CAPACITY)]
        assert found[d] == want


def test_passages_of_over_fifty_words_go(spark):
    rows = data.prose_texts()
    docs = data.documents(spark, rows)
    got = corpus_pipeline.repeats(spark, docs, "")
    assert got.columns == docs.columns
    left = data.left_texts(rows, corpus_pipeline.PASSAGE)
    want = [(d, kept, 0 if kept is None else len(kept)) for (d, _), kept in zip(rows, left)]
    assert sorted(((r["doc_id"], r["text"], r["n_chars"] or 0) for r in got.collect()), key=repr) == sorted(want, key=repr)
    for (d, t), kept in zip(rows, left):
        if d is not None and 300 <= d < 500:
            assert 158 <= len(kept.split()) <= 162
        elif d is not None and 20 <= d < 60:
            assert kept == t


def test_pipeline_takes_odd_rows_and_empty_tables(spark, tmp_path):
    data.documents(spark, data.prose_texts()).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.where("offset = 0").count() == out.select("sequence_id").distinct().count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    data.empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@needs_data
def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.dtypes == spark.read.parquet(f"{SMALL}/documents.parquet").dtypes, name
        assert 0 < docs.count() <= before
        before = docs.count()
