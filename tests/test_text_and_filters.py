import pytest
from pyspark.sql import functions as F

from plain_rows import rows
from glossvec.operators.filters import clean_word_filter
from glossvec.functions import (
    argmax, char_span, chars, cosine, hyphen_to_space, id_to_label, l2_norm, normalise_text, softmax,
    squared_l2, strip_chars, word_count, words,
)
from glossvec.operators import filters as flt
from glossvec.operators import shape as shp
from glossvec.operators import vocabulary as voc


@pytest.fixture(scope="module")
def lexicon(spark):
    data = [
        ("owl", 0, "a bird of prey", 1.0),
        ("bird", 1, "an animal that can fly like an owl", 1.2),
        ("prey", 2, "bird bird owl", 1.4),
        ("rare", 3, "", 1.6),
        (None, 4, "no word here", 1.3),
    ]
    return spark.createDataFrame(data, "word string, token_id bigint, definition string, norm double")


def one(spark, expr):
    return spark.range(1).select(expr.alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, words(F.lit("  a  b\tc\n"))) == ["a", "b", "c"]
    assert one(spark, words(F.lit("   "))) == []
    assert one(spark, word_count(F.lit("a b"))) == 2
    assert one(spark, chars(F.lit("aé你"))) == ["a", "é", "你"]
    assert one(spark, chars(F.lit(""))) == []
    assert one(spark, normalise_text(F.lit("Çà et là, un Élan des ÅLAND"))) == "ca et la, un elan des aland"
    assert one(spark, normalise_text(F.lit(None).cast("string"))) is None
    assert one(spark, strip_chars(F.lit("['owl']"), "[]'\"")) == "owl"
    assert one(spark, char_span(F.lit("hello"), F.lit(1), F.lit(3))) == "el"
    assert one(spark, hyphen_to_space(F.lit("hawk-like"))) == "hawk like"


def test_vector_functions(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, l2_norm(a)) == 5.0
    assert one(spark, squared_l2(a, b)) == 13.0
    assert one(spark, cosine(a, b)) == pytest.approx(0.8)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, zero)) == 0.0


def test_label_functions(spark):
    v = F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))
    assert one(spark, argmax(v)) == 1
    assert sum(one(spark, softmax(v))) == pytest.approx(1.0)
    assert one(spark, softmax(F.array(F.lit(1000.0), F.lit(0.0)))) == pytest.approx([1.0, 0.0])
    assert one(spark, id_to_label(F.lit(1), {0: "O", 1: "I-PER"})) == "I-PER"
    assert one(spark, id_to_label(F.lit(9), {0: "O"})) is None


def test_band_is_open_at_both_ends(lexicon):
    got = flt.norm_band_filter(lexicon, 1.0, 1.4)
    assert [r["token_id"] for r in got.orderBy("token_id").collect()] == [1, 4]
    with pytest.raises(ValueError):
        flt.norm_band_filter(lexicon, 2.0, 1.0)


def test_quartile_bands_leave_cuts_out(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(5)], "word string, norm double")
    got = {r["word"]: r["band"] for r in flt.norm_quartile_bands(df, top=4.0).collect()}
    assert got == {"0": 0, "1": None, "2": None, "3": None, "4": None}


def test_band_words_in_definitions(lexicon):
    got = flt.definition_contains_band_word(lexicon, 0.9, 1.1)
    assert sorted(r["token_id"] for r in got.collect()) == [1, 2]
    at = {r["word"]: r["positions"] for r in flt.band_word_positions(lexicon, 0.9, 1.3).collect()}
    assert at["owl"] == [2] and at["prey"] == [1, 2, 3] and at["rare"] == [] and at["bird"] == [8]
    assert rows(flt.definition_band_words(lexicon, 0.9, 1.5)) == [("bird",), ("owl",), ("prey",)]


@pytest.mark.parametrize("limit", [None, 0])
def test_band_word_positions_of_odd_definitions(spark, limit):
    odd = [(1, "a", " b\tc  a\x0b\n", 1.0), (2, "b", None, 1.0), (3, "c", "", 9.0), (4, "d", " \r\f", 9.0), (5, "e", "b\u00a0b \x1c \u0085 b", 9.0),
           (None, "f", "x a", 9.0), (None, "f", "b x", 9.0), (6, None, "a", 1.0), (7, "g", "a x b", 9.0), (7, "g", "x x a", 9.0), (7, "h", "b", 9.0)]
    df = spark.createDataFrame(odd, "token_id bigint, word string, definition string, norm double")
    got = flt.band_word_positions(df, 0.9, 1.1, limit=limit)
    want = [(1, "a", (1, 3)), (2, "b", ()), (3, "c", ()), (4, "d", ()), (5, "e", (4,)), (6, None, (1,)), (7, "g", (1, 3, 3)), (7, "h", (1,)), (None, "f", (1, 2))]
    assert rows(got) == sorted(want, key=repr)
    assert limit == 0 or "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row of a word
    assert rows(flt.band_word_positions(df, 5.0, 6.0, limit=limit).where("token_id = 7")) == [(7, "g", ()), (7, "h", ())]


def test_character_coverage(spark):
    vocab = spark.createDataFrame([("a",), ("b",), ("好",), ("𝒳",)], "ch string")
    df = spark.createDataFrame(
        [(1, "ab", "a b"), (2, "abc", "a"), (3, "好𝒳", ""), (4, None, "a"), (5, "a", "𝒴")], "id int, word string, definition string"
    )
    kept = flt.char_coverage_filter(df, vocab, ["word", "definition"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    strict = flt.char_coverage_filter(df, vocab, ["word", "definition"], check_space=True)
    assert sorted(r["id"] for r in strict.collect()) == [3]
    assert sorted(r["id"] for r in flt.clean_word_filter(df, vocab).collect()) == [1, 3, 5]


def test_issue_filters(spark):
    df = spark.createDataFrame(
        [(1, "t", "b", False, ["x"]), (2, "t", "b", True, ["x"]), (3, "t", None, False, [])],
        "id int, title string, body string, is_pull_request boolean, comments array<string>",
    )
    assert [r["id"] for r in flt.issue_filter(df).collect()] == [1]
    text = {r["id"]: r["text"] for r in flt.concat_text(df, ["title", "body"]).collect()}
    assert text == {1: "t \n b", 2: "t \n b", 3: None}
    words15 = spark.createDataFrame([(" ".join("w" * 15),), (" ".join("w" * 16),)], "c string")
    assert flt.min_words_filter(words15, "c", 15).count() == 1


def test_row_range_and_head(spark):
    df = spark.range(20).select((F.col("id") * 3).alias("k"))
    assert [r["k"] for r in flt.row_range(df, "k", 2, 5).orderBy("k").collect()] == [6, 9, 12]
    assert [r["k"] for r in flt.head_slice(df, ["k"], 2).collect()] == [0, 3]


@pytest.mark.parametrize("per_bucket", [None, 3])
def test_record_holders(spark, per_bucket):
    sizes = [2, 1, 2, 5, 4, 5, 7, 1, 7, 9]
    df = spark.createDataFrame(
        [(f"w{i}", i, " ".join("x" * n)) for i, n in enumerate(sizes)], "word string, token_id bigint, definition string"
    )
    got = flt.record_holders(df, rows_per_bucket=per_bucket)
    assert rows(got) == [("w0", 2), ("w3", 5), ("w6", 7), ("w9", 9)]


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert rows(flt.last_wins(df, "k", F.col("o")).select("k", "v")) == [("a", "z"), ("b", None)]


def test_shape(spark, lexicon):
    assert shp.column_symmetric_difference(lexicon, ["word", "zz"]) == ["token_id", "definition", "norm", "zz"]
    assert shp.keep_columns(lexicon, ["norm", "word"]).columns == ["norm", "word"]
    with pytest.raises(ValueError):
        shp.keep_columns(lexicon, ["zz"])
    assert shp.rename_columns(lexicon, {"norm": "n"}).columns[-1] == "n"
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, l array<string>")
    assert rows(shp.explode_list(lists, "l")) == [(1, "a"), (1, "b"), (2, None)]
    wide = spark.createDataFrame([(1, 2, "x")], "i int, a int, b string")
    assert rows(shp.melt(wide, "i")) == [(1, "a", "2"), (1, "b", "x")]
    a = spark.createDataFrame([("w", 1), ("w", 2)], "k string, n int")
    b = spark.createDataFrame([("w", 3), ("z", 4)], "k string, n int")
    assert rows(shp.compare_tables(a, b, "k", ("_old", "_new"))) == [("w", 1, 3), ("w", 2, 3)]
    code = spark.createDataFrame([("python", 1), ("go", 2)], "language string, n int")
    assert shp.select_language(code, "all").count() == 2 and shp.select_language(code, "go").count() == 1
    assert rows(shp.dict_to_table(spark.sql("SELECT map('a', 1, 'b', 2) AS m"), "m")) == [("a", 1), ("b", 2)]


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "The cat the dog"), (2, "a cat"), (3, "")], "doc_id bigint, text string")
    vocab = voc.build_vocabulary(voc.word_frequencies(docs), 3)
    assert rows(vocab) == [("a", 2, 1), ("cat", 0, 2), ("the", 1, 2)]
    tokens = voc.token_rows(docs)
    ids = voc.token_to_id(tokens, vocab)
    assert rows(ids.select("doc_id", "pos", "id")) == [(1, 0, 1), (1, 1, 0), (1, 2, 1), (1, 3, -1), (2, 0, 2), (2, 1, 0)]
    assert rows(voc.oov_words(tokens, vocab)) == [("dog",)]
    seq = spark.createDataFrame([(1, [1, 0, 99]), (2, [])], "key int, ids array<bigint>")
    assert rows(voc.id_to_token(seq, vocab)) == [(1, ("the", "cat", "[UNK]")), (2, ())]
    other = spark.createDataFrame([("cat",), ("cat",), ("owl",)], "word string")
    assert rows(voc.overlap_counts(vocab, other)) == [(3, 2, 1)]
    assert rows(voc.word_intersection(vocab, other)) == [("cat",)]
    assert voc.word_union(vocab, other).count() == 4


def test_longer_vocabulary_entries_cover_no_characters(spark):
    vocab = spark.createDataFrame([("##ing",), ("a",), ("b",)], "ch string")
    df = spark.createDataFrame([("gin",), ("ab",)], "word string")
    assert [r["word"] for r in clean_word_filter(df, vocab).collect()] == ["ab"]
