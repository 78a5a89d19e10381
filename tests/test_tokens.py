import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_rows import rows
from glossvec.catalog import corpora  # noqa: F401
from glossvec.catalog.registry import QUERIES
from glossvec.operators import vocabulary as voc
from glossvec.operators import corpus as cp
from glossvec.operators import merge_training as mt
from glossvec.operators import merges as mg
from glossvec.operators import tokens as tk

TEXT = [
    (1, "the then this that, the the hat"),
    (2, "aaaa aaa banana bananas; band"),
    (3, "low lower lowest newer new wide widest"),
    (4, ""),
    (5, "the low hat ... banana?!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXT, "doc_id bigint, text string")


def test_pretokenise_modes(spark):
    df = spark.createDataFrame([(1, "Hello, how are  you?!"), (2, ""), (3, " é_1")], "doc_id bigint, text string")

    def toks(mode, i):
        got = tk.pretokenise(df, mode).where(F.col("doc_id") == i).orderBy("pos").collect()
        return [(r["tok"], r["start"], r["end"]) for r in got]

    assert toks("punct", 1) == [("Hello", 0, 5), (",", 5, 6), ("how", 7, 10), ("are", 11, 14), ("you", 16, 19), ("?!", 19, 21)]
    assert toks("bert", 1)[-2:] == [("?", 19, 20), ("!", 20, 21)]
    assert [t for t, _, _ in toks("space", 1)] == ["Hello", ",", "Ġhow", "Ġare", "Ġ", "Ġyou", "?!"] or [
        t for t, _, _ in toks("space", 1)
    ] == ["Hello", ",", "Ġhow", "Ġare", "ĠĠ", "you", "?!"]
    assert toks("punct", 2) == [] and toks("punct", 3) == [("é_1", 1, 4)]


def plain_training(words, merges, prefix=""):
    """One merge after the other, ties in order of their texts. Every merge makes a symbol of its own."""
    names, out = [], []

    def named(name):
        names.append(name)
        return len(names) - 1

    ids = {c: named(c) for c in sorted({prefix + c if i and prefix else c for w in words for i, c in enumerate(w)})}
    split = {w: [ids[prefix + c if i and prefix else c] for i, c in enumerate(w)] for w in words}
    while len(out) < merges:
        pairs = Counter()
        for w, f in words.items():
            for p in zip(split[w], split[w][1:]):
                pairs[p] += f
        if not pairs:
            break
        n = max(pairs.values())
        taken = [min((p for p, c in pairs.items() if c == n), key=lambda p: (names[p[0]], names[p[1]], p))]
        for a, b in taken:
            made = named(mg.joined_symbol(names[a], names[b], prefix))
            out.append((names[a], names[b], names[made], n))
            for w, s in split.items():
                i, r = 0, []
                while i < len(s):
                    if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                        r.append(made)
                        i += 2
                    else:
                        r.append(s[i])
                        i += 1
                split[w] = r
    return out[:merges], {w: [names[i] for i in s] for w, s in split.items()}


def small_words(seed, letters, n):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): rng.randrange(1, 30) for _ in range(n)}


@pytest.mark.parametrize("words, prefix, hot, runs", [
    (Counter(w for _, t in TEXT for w in re.findall(r"\w+|[^\w\s]+", t)), "", mt.HOT, mt.RUNS), (small_words(1, "aab", 30), "", 3, 5), (small_words(2, "abcé\U0001f600", 15), "##", 8, 1000)])
def test_training_equals_plain_python(spark, monkeypatch, words, prefix, hot, runs):
    monkeypatch.setattr(mt.learn_merges, "__defaults__", (hot, runs))
    df = spark.createDataFrame(list(words.items()), "w string, f bigint").repartition(3)
    want, split = plain_training(words, 10_000, prefix)
    got = mg.train_merges(df, rounds=10_000, prefix=prefix)
    assert got.merges == want
    size = len(set(got.vocabulary)) - 9
    assert mg.train_merges(df, vocab_size=size, prefix=prefix).vocabulary == got.vocabulary[:size]
    encoded = {r["w"]: r["tokens"] for r in mg.encode_words(df.select("w"), got.merges, prefix).collect()}
    if len({m[:2] for m in want}) == len(want) and len({m[2] for m in want}) == len(want):
        assert encoded == split
    assert all("".join(p[len(prefix) :] if i and prefix else p for i, p in enumerate(encoded[w])) == w for w in words)


def test_training_stops_where_nothing_repeats(spark):
    df = spark.createDataFrame([("abc", 1), ("abd", 1), ("xyz", 1)], "w string, f bigint")
    assert mg.train_merges(df, vocab_size=500, least=2).merges == [("a", "b", "ab", 2)]
    assert mg.train_merges(df.limit(0), vocab_size=500).merges == []


def test_merges_apply_from_the_left():
    assert mt.merged_word([0, 0, 0, 1], {(0, 0): (0, 9), (0, 1): (1, 8)}) == [9, 8]
    held = mt.RunMerger([([0, 0, 0], 2), ([0, 0, 0, 0], 1)], ["a"], 0)
    assert held.best() == ((0, 0), 7)
    held.names.append("aa")
    held.merge((0, 0), 1)
    assert held.best() == ((1, 0), 2) and held.best() == ((1, 1), 1) and held.best() is None


def plain_encode(word, ranks, prefix=""):
    """Every merge in learned order over the whole word."""
    parts = [prefix + c if i and prefix else c for i, c in enumerate(word)]
    for (a, b), _ in sorted(ranks.items(), key=lambda x: x[1]):
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(mg.joined_symbol(a, b, prefix))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def plain_match(word, known, prefix):
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (prefix if at else "") + word[at:e] in known), None)
        if end is None:
            return ["[UNK]"]
        out.append((prefix if at else "") + word[at:end])
        at = end
    return out


@pytest.mark.parametrize("prefix", ["", "##"])
def test_heap_and_trie_equal_plain_encoding(prefix):
    rng = random.Random(9)
    for _ in range(60):
        merges, _ = plain_training(small_words(rng.random(), "abc", 12), rng.randrange(1, 40), prefix)
        ranks = mg.merge_ranks(merges)
        for w in list(small_words(rng.random(), "abcd", 25)) + ["", "aaaaaaa", "abababab"]:
            assert mg.merge_one(w, ranks, prefix) == plain_encode(w, ranks, prefix)
        known = {rng.choice(["", "##"]) + "".join(rng.choice("ab#") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 12))}
        trie = mg.PieceTrie(known)
        for w in list(small_words(rng.random(), "ab#", 30)) + ["", "##", "##a"]:
            assert trie.match(w) == plain_match(w, known, "##"), (w, known)


def test_long_tokens_take_little_longer_than_their_length():
    merges, _ = plain_training(small_words(3, "ab", 40), 300)
    ranks, rng = mg.merge_ranks(merges), random.Random(4)
    word = "".join(rng.choice("ab") for _ in range(200_000))
    began = time.perf_counter()
    assert "".join(mg.merge_one(word, ranks)) == word
    trie = mg.PieceTrie(["a" * k for k in range(1, 1500)] + ["##" + "a" * k for k in range(1, 1500)] + ["##b"])
    assert trie.match("a" * 100_000 + "b")[-1] == "##b"
    assert time.perf_counter() - began < 30


def test_vocabulary_size_and_round_trip(docs):
    got = mg.train_bpe(docs, vocab_size=40)
    assert len(got.vocabulary) == 40 == len(set(got.vocabulary)) and got.vocabulary[0] == "<|endoftext|>"
    assert got.vocabulary_table().count() == 40 and got.merge_table().columns == ["step", "a", "b", "merged", "n"]
    coded = {r["doc_id"]: r for r in mg.encode_bpe(docs, got.merges).collect()}
    for i, text in TEXT:
        assert "".join(coded[i]["tokens"]) == re.sub(r"\s", "", text)
        assert len(coded[i]["tokens"]) == len(coded[i]["word_ids"])
    spaced = mg.train_corpus_tokeniser(docs, vocab_size=45)
    back = {r["doc_id"]: "".join(r["tokens"]) for r in mg.encode_bpe(docs, spaced.merges, mode="space").collect()}
    assert back == {i: t.replace(" ", "Ġ") for i, t in TEXT}


def test_wordpiece(docs, spark):
    got = mg.train_wordpiece(docs, vocab_size=50)
    assert got.vocabulary[:5] == ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"] and len(got.vocabulary) == 50
    assert any(w.startswith("##") for w in got.vocabulary)
    coded = {r["doc_id"]: r["tokens"] for r in mg.encode_wordpiece(docs, got.vocabulary).collect()}
    text = tk.tokens_to_string(spark.createDataFrame([(3, coded[3])], "doc_id bigint, tokens array<string>"))
    assert text.first()["text"] == TEXT[2][1]
    vocab = ["un", "##aff", "##able", "##a", "a"]
    words = spark.createDataFrame([(1, "unaffable xyz a")], "doc_id bigint, text string")
    assert mg.encode_wordpiece(words, vocab).first()["tokens"] == ["un", "##aff", "##able", "[UNK]", "a"]


def test_pairs_and_merge(spark):
    w = spark.createDataFrame([("aab", 2), ("a", 9), ("aaab", 1)], "w string, f bigint")
    split = mg.split_words(w)
    assert rows(mg.pair_frequencies(split)) == [("a", "a", 4), ("a", "b", 3)]
    assert rows(mg.best_pair(mg.pair_frequencies(split))) == [("a", "a", 4)]
    assert rows(mg.apply_merge(split, "a", "a").select("w", "sy")) == [("a", ("a",)), ("aaab", ("aa", "a", "b")), ("aab", ("aa", "b"))]
    assert mg.joined_symbol("a", "##b", "##") == "ab" and mg.joined_symbol("##a", "##b", "##") == "##ab"


def test_special_tokens_pair_truncate(spark):
    seq = spark.createDataFrame([(1, [7, 8]), (2, [])], "doc_id bigint, ids array<bigint>")
    whole = tk.add_special_tokens(seq)
    assert rows(whole.select("doc_id", "input_ids", "token_type_ids")) == [(1, (-3, 7, 8, -4), (0, 0, 0, 0)), (2, (-3, -4), (0, 0))]
    assert rows(tk.truncate(whole, 3).select("input_ids", "attention_mask")) == [((-3, -4), (1, 1)), ((-3, 7, -4), (1, 1, 1))]
    pairs = spark.createDataFrame([(1, [1, 2, 3, 4], [5, 6]), (2, [1, 2, 3], [4, 5, 6])], "key bigint, a array<bigint>, b array<bigint>")
    free = {r["key"]: r for r in tk.encode_pair(pairs).collect()}
    assert free[1]["input_ids"] == [-3, 1, 2, 3, 4, -4, 5, 6, -4] and free[1]["token_type_ids"] == [0] * 6 + [1] * 3
    cut = {r["key"]: r["input_ids"] for r in tk.encode_pair(pairs, max_len=7).collect()}
    assert cut[1] == [-3, 1, 2, -4, 5, 6, -4] and cut[2] == [-3, 1, 2, -4, 4, 5, -4]
    odd = {r["key"]: r["input_ids"] for r in tk.encode_pair(pairs, max_len=8).collect()}
    assert odd[2] == [-3, 1, 2, 3, -4, 4, 5, -4]


def test_pad_batch(spark):
    seq = spark.createDataFrame([(3, [1]), (5, [1, 2, 3]), (9, [4]), (11, [])], "doc_id bigint, ids array<bigint>")
    got = set(rows(tk.pad_batch(seq, 2)))
    assert got == {(0, 3, (1, -2, -2), (1, 0, 0)), (0, 5, (1, 2, 3), (1, 1, 1)), (1, 9, (4,), (1,)), (1, 11, (-2,), (0,))}


def test_alignment_and_char_ids(spark):
    docs = spark.createDataFrame([(1, "abcd e")], "doc_id bigint, text string")
    pieces = tk.word_pieces(docs, F.split("text", " "), lambda w: F.regexp_extract_all(w, F.lit(".{1,3}"), F.lit(0)))
    assert rows(pieces) == [(1, ("abc", "d", "e"), (0, 0, 1))]
    assert rows(tk.word_alignment(pieces)) == [(1, (None, 0, 0, 1, None))]
    lex, chars = spark.createDataFrame([("aba",), ("zé",)], "word string"), spark.createDataFrame([("a", 0), ("b", 1)], "ch string, char_id bigint")
    want = [("aba", (0, 1, 0)), ("zé", (-1, -1))]
    assert rows(tk.char_word_ids(lex, chars)) == want == rows(tk.char_word_ids(lex, chars, limit=0))


@pytest.mark.parametrize("per_bucket", [None, 3])
@pytest.mark.parametrize("group", [None, "g"])
def test_group_texts(spark, per_bucket, group):
    sizes = [3, 0, 10, 1, 1, 25, 4, 7, 2, 9]
    data, n = [], 0
    for i, s in enumerate(sizes):
        data.append((i, "x" if i % 3 else "y", list(range(n, n + s))))
        n += s
    df = spark.createDataFrame(data, "doc_id bigint, g string, ids array<bigint>").repartition(4)
    got = cp.group_texts(df, 4, group_key=group, rows_per_bucket=per_bucket)
    want = []
    for key in ["x", "y"] if group else [None]:
        flat = [t for _, g, ids in data for t in ids if key is None or g == key]
        for c in range(len(flat) // 4):
            want.append(((key,) if key else ()) + (c, tuple(flat[4 * c : 4 * c + 4]), tuple(flat[4 * c : 4 * c + 4])))
    assert rows(got) == sorted(want, key=repr)


def test_masks(spark):
    seq = spark.range(4000).select((F.col("id") % 7).alias("doc_id"), "id").withColumn("pos", F.col("id"))
    got = cp.mlm_mask(seq, vocab_size=100).collect()
    chosen = [r for r in got if r["label"] != -100]
    assert 0.12 < len(chosen) / 4000 < 0.18
    assert all(r["input_id"] == r["pos"] for r in got if r["label"] == -100) and all(r["label"] == r["pos"] for r in chosen)
    masked = sum(r["input_id"] == -5 for r in chosen) / len(chosen)
    kept = sum(r["input_id"] == r["label"] for r in chosen) / len(chosen)
    assert 0.74 < masked < 0.86 and 0.05 < kept < 0.16
    assert rows(cp.mlm_mask(seq.repartition(9), vocab_size=100)) == rows(cp.mlm_mask(seq, vocab_size=100))
    assert cp.fixed_eval_mask(seq).columns == ["doc_id", "pos", "masked_input_ids", "masked_labels"]


def test_whole_word_mask(spark):
    ids = [100, 1, 2, 3, 4, 5, 6, 101]
    word_ids = [None, 0, 0, 1, 2, 2, 0, None]
    df = spark.createDataFrame([(d, ids, word_ids) for d in range(200)] + [(999, [], [])], "doc_id bigint, ids array<bigint>, word_ids array<bigint>")
    got = {}
    for r in cp.whole_word_mask(df, p=0.5).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r
    assert len(got) == 200
    hits = 0
    for per in got.values():
        mask = [per[i]["label"] != -100 for i in range(8)]
        assert not mask[0] and not mask[7] and mask[1] == mask[2] and mask[4] == mask[5]
        assert all((per[i]["input_id"] == -5) == mask[i] for i in range(8))
        hits += mask[1] + mask[3] + mask[4] + mask[6]
    assert 0.42 < hits / 800 < 0.58
    assert any(per[1]["label"] != per[6]["label"] and (per[1]["label"] == -100) != (per[6]["label"] == -100) for per in got.values())


@pytest.mark.parametrize("per_bucket", [None, 6])
def test_shuffle_split_sample_batches(spark, per_bucket):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    split = cp.train_test_split(df, "doc_id", 20, 5, rows_per_bucket=per_bucket)
    assert rows(split.groupBy("split").count()) == [("test", 5), ("train", 20)]
    order = [r["doc_id"] for r in cp.shuffle(df, "doc_id").orderBy("ord", "doc_id").collect()]
    assert {r["doc_id"] for r in split.where("split = 'train'").collect()} == set(order[:20]) and order != sorted(order)
    assert {r["doc_id"] for r in cp.sample_rows(df, "doc_id", 7).collect()} == set(order[:7])
    batches = cp.corpus_batches(df.withColumn("text", F.lit("x")), 20).groupBy("batch_id").count()
    assert rows(batches) == [(0, 20), (1, 20), (2, 10)]


def test_tokens_need_no_exchange(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a, b\x0bc"), (2, None), (3, "  "), (4, "é-é")] , "doc_id bigint, text string")
    monkeypatch.setattr(tk, "PIECES_AT_A_TIME", 2)
    out = tk.pretokenise(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == [(1, 0, "a", 0, 1), (1, 1, ",", 1, 2), (1, 2, "b", 3, 4), (1, 3, "c", 5, 6), (4, 0, "é", 0, 1), (4, 1, "-", 1, 2), (4, 2, "é", 2, 3)]
    back = voc.id_to_token(spark.createDataFrame([(1, [5, 9]), (2, [])], "key bigint, ids array<bigint>"), spark.createDataFrame([("x", 5)], "word string, token_id bigint"))
    assert rows(back) == [(1, ("x", "[UNK]")), (2, ())]


def test_corpus_batches_rank_texts_in_ranges_of_bounded_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(None if i == 3 else i * 7 % 101, "x" * (i % 9)) for i in range(90)], "doc_id bigint, text string")
    want = rows(cp.corpus_batches(df, 20))
    monkeypatch.setattr(cp, "RANGE_BYTES", 500)
    found = cp.corpus_batches(df, 20)
    assert rows(found) == want
    assert "order-" in " ".join(found.inputFiles())  # dealt into ranges, not ranked by one task


def test_batches_are_coded_in_slices(spark):
    """A batch of more tokens than are coded at a time gives the rows of many small ones."""
    from glossvec.plans.lookups import TOKENS_AT_A_TIME, row_slices, with_token_ids

    assert [(lo, hi) for lo, hi in row_slices(np.array([3, 0, 9, 1, 1]), 4)] == [(0, 2), (2, 3), (3, 5)]
    n = TOKENS_AT_A_TIME // 1000
    df = spark.range(3 * n, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("a"), (i + F.col("id")) % 7)), " ").alias("text"))
    found = mg.encode_wordpiece(df, ["a", "##1", "##2"]).select("doc_id", F.size("tokens").alias("n"), F.size(F.filter("tokens", lambda t: t == "[UNK]")).alias("u"))
    want = {i: (sum(2 if (j + i) % 7 in (1, 2) else 1 for j in range(1000)), sum((j + i) % 7 not in (1, 2) for j in range(1000))) for i in range(7)}
    assert all((r["n"], r["u"]) == want[r["doc_id"] % 7] for r in found.collect()) and found.count() == 3 * n
    ids = with_token_ids(df, F.split("text", " "), spark.createDataFrame([("a0", 5), ("a3", 6)], "word string, token_id bigint"))
    assert ids.select(F.sum(F.size("ids")).alias("n"), F.sum(F.size(F.filter("ids", lambda i: i > 4))).alias("k")).first()["n"] == 3000 * n
    runs = cp._run_index(F.transform(F.split("text", " "), lambda w, i: F.floor(i / 2).cast("bigint")))
    assert {r["r"] for r in df.select(F.element_at(runs, -1).alias("r")).collect()} == {499}


def test_spaces_are_marked_once_for_a_distinct_word(spark):
    docs = spark.createDataFrame([("a b b\u0120b b", ), (None,), ("\u0120b  b a",)], "text string")
    got = mg.word_table(docs, "space")
    want = {}
    for r in docs.select(tk.pretokens("text", "space").alias("t")).collect():
        for w in r["t"] or []:
            want[w] = want.get(w, 0) + 1
    assert {r["w"]: r["f"] for r in got.collect()} == want and len(got.collect()) == len(want)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_comparing_tokenisations_reads_the_documents_once(spark):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("test tables are not here")
    plan = QUERIES["compare_tokenisations"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
