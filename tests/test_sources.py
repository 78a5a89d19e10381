import gzip
import json

import pytest
from pyspark.sql import functions as F

from plain_rows import rows
from glossvec.operators.filters import issue_filter, min_words_filter
from glossvec.sources import corpora as co
from glossvec.sources import lexicons as lx


def test_dictionary_text(spark, tmp_path):
    path = tmp_path / "dictionary.txt"
    path.write_text("n 1 [owl] a first   text\nv 2 [bare]\nn 3 [owl]  a bird\tof prey \na 4 [[odd]] x\n", encoding="utf-8")
    got = lx.read_dictionary_text(spark, str(path))
    assert rows(got) == [("odd", "x"), ("owl", "a bird of prey")]
    path.write_text("n 1 [owl] a bird\nn 2\n", encoding="utf-8")
    with pytest.raises(Exception, match="fewer than three fields"):
        lx.read_dictionary_text(spark, str(path)).collect()
    assert rows(lx.read_dictionary_text(spark, str(path), on_bad="skip")) == [("owl", "a bird")]
    assert rows(lx.bad_dictionary_lines(spark, str(path))) == [("n 2",)]
    with pytest.raises(ValueError):
        lx.read_dictionary_text(spark, str(path), on_bad="guess")


def test_later_file_part_wins(spark, tmp_path):
    path = tmp_path / "dictionary.txt"
    path.write_text("".join(f"n 1 [w{i % 50}] text {i}\n" for i in range(5000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["word"]: r["definition"] for r in lx.read_dictionary_text(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"w{i}": f"text {4950 + i}" for i in range(50)}


def test_lexicon_csv(spark, tmp_path):
    path = tmp_path / "lexicon.csv"
    path.write_text('norms,words,definition,word_ids\n1.25,owl,"a bird, ""of"" prey",3\n1.5,,no word,4\n1.1,nan,not a number,5\n', encoding="utf-8")
    got = lx.read_lexicon_csv(spark, str(path))
    assert got.dtypes == [("word", "string"), ("definition", "string"), ("token_id", "bigint"), ("norm", "double")]
    assert rows(got) == [("nan", "not a number", 5, 1.1), ("owl", 'a bird, "of" prey', 3, 1.25), (None, "no word", 4, 1.5)]
    older = tmp_path / "older.csv"
    older.write_text("norms,words,definition,embeddings_ids\n1.25,owl,bird,3\n", encoding="utf-8")
    assert rows(lx.read_lexicon_csv(spark, str(older))) == [("owl", "bird", 3, 1.25)]
    indexed = tmp_path / "indexed.csv"
    indexed.write_text(",word,definition\n0,owl,bird\n", encoding="utf-8")
    assert lx.read_lexicon_csv(spark, str(indexed)).columns == ["word", "definition"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("owl", 'a "bird", of prey', ["a", "b c"], [0.5, 0.25]), ("x", None, [], [])],
                               "word string, definition string, hits array<string>, distances array<double>")
    target = lx.write_results_csv(df, str(tmp_path / "out"), run_id="20240101-000000")
    back = lx.parse_recall_lists(lx.read_table_csv(spark, target), ["hits", "distances"])
    got = {r["word"]: r for r in back.collect()}
    assert got["owl"]["hits"] == ["a", "b c"] and got["owl"]["distances"] == ["0.5", "0.25"]
    assert got["owl"]["definition"] == 'a "bird", of prey'
    reviewed = tmp_path / "results.csv"
    reviewed.write_text(",word,translate,definition,norm_recall\n10,owl,\"['x', 'y']\",\"a, b\",'p' 'q' '[unused1]'\n11,cat,[],c,'r'\n", encoding="utf-8")
    lists = lx.parse_recall_lists(lx.read_table_csv(spark, str(reviewed)), ["translate", "norm_recall"])
    assert rows(lists) == [("cat", (), "c", ("r",)), ("owl", ("x", "y"), "a, b", ("p", "q", "[unused1]"))]


@pytest.fixture(scope="module")
def code_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    n = 0
    for lang in ("python", "go"):
        for split in ("train", "test", "valid"):
            folder = root / lang / "final" / "jsonl" / split
            folder.mkdir(parents=True)
            for part in range(2):
                with gzip.open(folder / f"{lang}_{split}_{part}.jsonl.gz", "wt", encoding="utf-8") as f:
                    for _ in range(3):
                        f.write(json.dumps({
                            "repo": "r", "path": f"p{n}", "func_name": f"f{n}", "original_string": "a\nb", "language": lang, "code": "a\nb",
                            "code_tokens": ["a", "b"] if n % 2 else [], "docstring": "d", "docstring_tokens": ["d"], "partition": split, "url": "u",
                            "sha": "ignored"}) + "\n")
                        n += 1
    return str(root)


def test_code_records(spark, code_root):
    every = co.read_code_jsonl(spark, code_root)
    assert every.count() == 36 and every.select("row_key").distinct().count() == 36
    assert every.columns[:4] == ["row_key", "repository_name", "func_path_in_repository", "func_name"]
    assert every.where("split <> split_name").count() == 0 and every.where("whole_func_string = 'a\nb'").count() == 36
    go = co.read_code_jsonl(spark, code_root, "go", "test")
    assert go.count() == 6 and {r["language"] for r in go.collect()} == {"go"} and len(go.inputFiles()) == 2
    with pytest.raises(ValueError):
        co.read_code_jsonl(spark, code_root, "cobol")
    with pytest.raises(ValueError):
        co.read_code_jsonl(spark, code_root, "go", "dev")


def test_issues(spark, tmp_path):
    path = tmp_path / "issues.jsonl"
    long = " ".join(["w"] * 16)
    data = [
        {"title": "t", "body": None, "html_url": "u", "comments": [long, "short"], "is_pull_request": False, "id": 1},
        {"title": "t", "body": "b", "html_url": "u", "comments": [long], "is_pull_request": True, "id": 2},
        {"title": "t", "body": "b", "html_url": "u", "comments": [], "is_pull_request": False, "id": 3},
    ]
    path.write_text("\n".join(json.dumps(d) for d in data), encoding="utf-8")
    df = co.read_issues(spark, str(path))
    assert df.columns == ["title", "body", "html_url", "comments", "is_pull_request"]
    kept = issue_filter(df).withColumn("comment", F.explode("comments"))
    assert min_words_filter(kept, "comment").count() == 1


def test_stored_datasets(spark, tmp_path):
    df = spark.createDataFrame([("w", [1, 2], [0], "train"), ("x", [], [1, 2], "test")],
                               "word string, input_ids array<int>, word_ids array<bigint>, split string")
    co.write_split(df, str(tmp_path / "d"))
    train = co.read_split(spark, str(tmp_path / "d"), "train")
    assert rows(train) == [("w", (1, 2), (0,))] and co.read_split(spark, str(tmp_path / "d")).count() == 2
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()
    text = spark.createDataFrame([("one\ntwo",), ("three",), (None,)], "text string")
    co.write_text_corpus(text, str(tmp_path / "t"))
    assert rows(co.read_text_corpus(spark, str(tmp_path / "t"))) == [("one",), ("three",), ("two",)]
    vocab = spark.createDataFrame([("a", 0, 5)], "word string, token_id bigint, freq bigint")
    co.write_vocabulary(vocab, str(tmp_path / "v"))
    assert rows(co.read_vocabulary(spark, str(tmp_path / "v"))) == [("a", 0)]
    predicted = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "token_id bigint, v array<double>")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "token_id bigint, word string")
    co.write_vector_sheet(co.vector_sheet(predicted, names), str(tmp_path / "s"))
    assert rows(co.read_vector_sheet(spark, str(tmp_path / "s"))) == [("a", (3.0,)), ("b", (2.0,))]


def test_lists_with_quotes_round_trip(spark, tmp_path):
    items = ["don't", "x", "o'clock", 'say "hi"', "back\\slash", "it's \\'"]
    df = spark.createDataFrame([("w", items), ("e", [])], "word string, hits array<string>")
    target = lx.write_results_csv(df, str(tmp_path / "out"))
    back = {r["word"]: r["hits"] for r in lx.parse_recall_lists(lx.read_table_csv(spark, target), ["hits"]).collect()}
    assert back["w"] == items and not back["e"]
    mixed = spark.createDataFrame([("""['a', "b's"]""",)], "hits string")
    assert lx.parse_recall_lists(mixed, ["hits"]).first()["hits"] == ["a", "b's"]
