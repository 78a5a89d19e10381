import pytest

from plain_rows import rows
from glossvec.operators import entities as en
from glossvec.operators import quality as ql

TEXT = "My name is Ann Lee in Rome Oslo"


def spans():
    out, at = [], 0
    for i, w in enumerate(TEXT.split()):
        out.append((i, w, at, at + len(w)))
        at += len(w) + 1
    return out


def test_entity_groups(spark):
    labels = ["O", "O", "O", "I-PER", "I-PER", "O", "I-LOC", "B-LOC"]
    data = [(1, p, lab, 0.5 + p / 100, s, e) for (p, _, s, e), lab in zip(spans(), labels)]
    data += [(2, 0, "O", 0.9, 0, 2), (2, 1, "O", 0.9, 3, 7)]
    tokens = spark.createDataFrame(data, "sent_id bigint, pos bigint, label string, score double, start bigint, end bigint")
    texts = spark.createDataFrame([(1, TEXT), (2, TEXT)], "sent_id bigint, text string")
    got = rows(en.entity_groups(tokens, texts).select("sent_id", "entity_group", "start", "end", "word"))
    assert got == [(1, "LOC", 22, 26, "Rome"), (1, "LOC", 27, 31, "Oslo"), (1, "PER", 11, 18, "Ann Lee")]
    score = {r["word"]: r["score"] for r in en.entity_groups(tokens, texts).collect()}
    assert score["Ann Lee"] == pytest.approx(0.535)
    touching = spark.createDataFrame(
        [(1, 0, "I-PER", 0.5, 0, 2), (1, 1, "I-LOC", 0.7, 3, 7), (1, 3, "I-LOC", 0.9, 11, 14)],
        "sent_id bigint, pos bigint, label string, score double, start bigint, end bigint",
    )
    assert rows(en.entity_groups(touching, texts).select("entity_group", "word")) == [("LOC", "Ann"), ("LOC", "name"), ("PER", "My")]


def test_decode_entities(spark):
    data = [(1, 0, "My", [5.0, 1.0], 0, 2), (1, 1, "Rome", [1.0, 3.0], 3, 7), (1, 2, "x", [2.0, 2.0], 8, 9)]
    logits = spark.createDataFrame(data, "sent_id bigint, pos bigint, tok string, logits array<double>, start bigint, end bigint")
    got = en.decode_entities(logits, {0: "O", 1: "I-LOC"}).collect()
    assert len(got) == 1 and got[0]["word"] == "Rome" and got[0]["score"] == pytest.approx(0.8807970779778823)


def test_quality(spark):
    df = spark.createDataFrame([("train", 0), ("train", 2), ("test", None), ("odd", 0)], "split string, label int")
    assert ql.label_domain_check(df, {"train": [0, 1], "test": [0, 1]}).first()["n_violations"] == 3
    assert ql.no_duplicate_rows(df).first()["n_violations"] == 0
    seq = spark.createDataFrame([([1],), ([],), (None,)], "input_ids array<int>")
    assert ql.non_empty_sequences(seq).first()["n_violations"] == 2
    both = spark.createDataFrame([(["a"], [1]), (["a"], [1, 2]), (None, [1])], "tokens array<string>, vectors array<int>")
    assert ql.tokens_match_vectors(both).first()["n_violations"] == 2
    assert ql.non_empty_dataset(seq).first()["n_violations"] == 0
    assert ql.non_empty_dataset(seq.limit(0)).first()["n_violations"] == 1
    lines = spark.createDataFrame([("a b c",), ("a b",), ("",)], "value string")
    assert ql.min_fields(lines).first()["n_violations"] == 2
    ql.valid_range_bounds(1, 1)
    with pytest.raises(ValueError):
        ql.valid_range_bounds(2, 1)
