import hashlib
import re
from collections import defaultdict

import data
import pytest
from pyspark.sql import functions as F

from glossvec.llm import exact_dedup, line_dedup, minhash_dedup, quality_rules, suffix_dedup
from glossvec.llm.common import hot_join


def ordered(rows):
    return sorted(rows, key=repr)


def test_rule_counts_equal_plain_python(spark):
    got = quality_rules.judge(data.documents(spark, clashing=True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = [(d, *data.rule_counts(t)) for d, t in data.texts()]
    assert ordered(tuple(r)[:6] for r in got) == ordered(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_label_model_parts_good_from_bad(spark):
    good, bad = "0" + "+" * 9, "--" + "+" * 4 + "-0+-"
    rows = spark.createDataFrame([("+" * 10, 900), (good, 60), (bad, 40), ("-" + "+" * 9, 3)], "votes string, n bigint")
    params = quality_rules.fit_label_model(rows)
    post = {r["votes"]: r["p"] for r in quality_rules._posterior(rows, params, "votes", "p").collect()}
    assert post["+" * 10] > 0.9 and post[good] > 0.5 and post[bad] < 0.1


def test_quality_keeps_columns_and_takes_empty_tables(spark):
    docs = data.documents(spark, clashing=True)
    out = quality_rules.judge(docs)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r[0] for r in out.select("digest").collect()} == {"own digest"}
    assert quality_rules.judge(data.empty(spark)).count() == 0


def _lines(rows):
    holders, strip = defaultdict(set), " \t\n\x0b\f\r"
    keyed = [(d, [(x, x.strip(strip).translate(data.LOWER)) for x in (t or "").split("\n")]) for d, t in rows]
    for d, lines in keyed:
        for _, k in lines:
            if len(k) >= 40:
                holders[k].add(d)
    out = []
    for d, lines in keyed:
        gone = [len(holders[k]) >= 5 and max(x for x in holders[k] if x is not None) != d for _, k in lines]
        out.append((d, len(lines), sum(gone), hashlib.sha256("\n".join(x for (x, _), g in zip(lines, gone) if not g).encode()).hexdigest()))
    return out


def test_shared_lines_equal_plain_python(spark):
    rows = data.texts() + [(None, "A SHARED line that is long enough to be counted by all\nx")]
    got = line_dedup.lines_query(data.documents(spark, rows, clashing=True))
    assert ordered(map(tuple, got.collect())) == ordered(_lines(rows))
    out = line_dedup.drop_shared_lines(data.documents(spark, clashing=True))
    assert {"h", "g", "n", "text", "n_dropped"} <= set(out.columns)
    assert line_dedup.drop_shared_lines(data.empty(spark)).count() == 0


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups_equal_plain_python(spark, fan_in):
    rows = data.texts()
    docs = data.documents(spark, clashing=True).repartition(7)
    got = exact_dedup.exact_groups(docs, fan_in=fan_in)
    assert len(set(got.columns)) == len(got.columns) and set(docs.columns) <= set(got.columns)
    groups = defaultdict(list)
    for d, t in rows:
        groups[data.BLANK.sub("", t or "")].append((-len(t or ""), d is None, d or 0))
    want = []
    for d, t in rows:
        k = data.BLANK.sub("", t or "")
        chars, none, keep = min(groups[k])
        want.append((d, None if none else keep, len(groups[k]), d == (None if none else keep) and -len(t or "") == chars, hashlib.sha256(k.encode()).hexdigest()))
    assert ordered(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == ordered(want)
    assert exact_dedup.exact_groups(data.empty(spark)).count() == 0


def test_exact_deduplicate_keeps_the_same_rows(spark):
    docs = data.documents(spark)
    kept = exact_dedup.exact_groups(docs).where("kept").select("doc_id").collect()
    assert ordered(tuple(r) for r in exact_dedup.deduplicate(docs).select("doc_id").collect()) == ordered(tuple(r) for r in kept)


def test_exact_deduplicate_keeps_one_row_of_shared_and_null_ids(spark):
    """Winner and loser have one id, or none, and differ in blanks or in another column only."""
    rows = [(None, "a b"), (None, "ab"), (7, "c  d"), (7, "c d"), (7, "another text"), (8, "e f"), (8, "e f"), (9, "e f")]
    docs = data.documents(spark, rows)
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("source", F.lit("other")))
    got = [tuple(r) for r in exact_dedup.deduplicate(docs).select("doc_id", "text").collect()]
    # Rows that nothing tells apart stay together.
    assert ordered(got) == ordered([(None, "a b"), (7, "c  d"), (7, "another text"), (8, "e f"), (8, "e f")])
    one = docs.where("doc_id = 9")
    assert exact_dedup.deduplicate(one).count() == exact_dedup.exact_groups(one).where("kept").count() == 1


@pytest.mark.parametrize("width", [2, 5])
def test_near_components_equal_all_pairs(spark, width):
    rows = [r for r in data.texts() if r[0] not in (17, 18)]
    got = minhash_dedup.near_components(data.documents(spark, rows, clashing=True), width).collect()
    assert ordered((r[0], r[1], r[2]) for r in got) == ordered(data.near_groups(rows, width))
    assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert minhash_dedup.near_components(data.empty(spark)).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_components_of_null_and_repeated_ids(spark, width):
    """All rows of the table, repeated and null ids too, and rows of one id that belong to two components."""
    rows = data.texts()
    text = dict(rows)
    # Ids 0 and 600 have two texts each, one near another document; two null ids are near one another only.
    rows += [(0, text[10] + " tail"), (600, text[11] + " tail"), (600, text[12] + " tail"), (601, text[0] + " tail")]
    alone = " ".join(f"lone{i}" for i in range(60))
    rows += [(None, alone), (None, alone + " tail"), (None, alone + " tail")]
    got = minhash_dedup.near_components(data.documents(spark, rows, clashing=True), width).collect()
    want = data.near_groups(rows, width)
    assert ordered((r[0], r[1], r[2]) for r in got) == ordered(want)
    left = ordered(tuple(r) for r in minhash_dedup.deduplicate(data.documents(spark, rows), width).select("doc_id", "text").collect())
    # One of the lone texts stays; every other row stays where it bears the component's id.
    lone = [r for r in left if (r[1] or "").startswith("lone")]
    assert len(set(lone)) == 1
    assert [r for r in left if r not in lone] == ordered(r for r, (d, _, c) in zip(rows, want) if d == c and not (r[1] or "").startswith("lone"))


def test_near_chains_and_hubs_are_complete(spark):
    """Copies that are near their base and not one another: no hub joins all, so later rounds must."""
    import random

    rng = random.Random(1)
    base = data.sentence(rng, 150, 9000).split()
    rows = [(500, " ".join(base))]
    for k in range(90):
        words = list(base)
        for j in rng.sample(range(150), rng.randrange(2, 9)):
            words[j] = f"n{k}v{j}"
        rows.append((k, " ".join(words)))
    got = minhash_dedup.near_components(data.documents(spark, rows), 2).collect()
    assert ordered((r[0], r[1], r[2]) for r in got) == ordered(data.near_groups(rows, 2))
    kept = minhash_dedup.deduplicate(data.documents(spark, rows, clashing=True), 2)
    assert kept.count() == len({g for _, _, g in data.near_groups(rows, 2)})


def test_signatures_estimate_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    sig = minhash_dedup.signatures([np.sort(pool[:1000]), np.sort(pool[200:])], 512)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.08


def test_repeats_equal_counting_all_strings(spark):
    rows = data.texts()
    got = suffix_dedup.repeats_query(data.documents(spark, rows, clashing=True)).collect()
    assert ordered(map(tuple, got)) == ordered(data.cut_repeats(rows, 400))
    assert suffix_dedup.repeats_query(data.empty(spark)).count() == 0


def test_repeats_of_large_triggers_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_PHRASES", 2)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    rows = data.texts()
    got = suffix_dedup.repeats_query(data.documents(spark, rows)).collect()
    assert ordered(map(tuple, got)) == ordered(data.cut_repeats(rows, 400))


def test_dropped_repeats_leave_whole_characters(spark):
    docs = data.documents(spark, [(1, "é" * 300), (2, "x" + "é" * 300), (3, None), (4, "short")], clashing=True)
    out = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(docs).collect()}
    assert out[3]["text"] is None and out[4]["text"] == "short" and out[2]["text"] == "x" and out[1]["spans"] == "own spans"


def test_suffix_ranks_are_the_order_of_strings():
    import numpy as np

    text = b"abracadabra abracadabra bracada" * 3
    rank = suffix_dedup.suffix_ranks(np.frombuffer(text, np.uint8), 13)
    strings = [text[i : i + 13] for i in range(len(text) - 12)]
    places = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert [int(r) for r in rank] == [places[s] for s in strings]


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = spark.range(6000).select((F.col("id") % 3 * (F.col("id") > 4000).cast("int")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_join(rows, groups, ["k"], "n", 6000).count() == 6000


def test_no_driver_or_local_shortcuts():
    import os

    root = os.path.dirname(os.path.abspath(minhash_dedup.__file__))
    for f in os.listdir(root):
        if f.endswith(".py"):
            text = open(os.path.join(root, f), encoding="utf-8").read()
            assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.rdd\b|tempfile", text), f
