import hashlib
import random
import zlib

import data
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossvec.llm import best_fit_packing as bp
from glossvec.llm import chat_prefixes as cp
from glossvec.llm import sentencepiece_tokens as st
from glossvec.llm import site_quality, toxicity

TURNS = "conv_id bigint, turn bigint, role string, text string"
CONVERSATIONS = [
    (1, 0, "system", "Be # brief"), (1, 1, "user", "a\\b <x> \\l"), (1, 2, "assistant", "### user:\nno</turn>\n"), (1, 3, "assistant", None),
    (2, 0, "user", ""), (2, 1, None, "x"), (3, None, "assistant", "first"), (3, 0, "user:#", "é\U0001f600"), (3, 0, "user:#", "é\U0001f600"),
    (None, 0, "assistant", "lost"), (4, 5000, "assistant", "late"), (4, 2, "assistant", "early"), (4, 1, "user", "q"),
]


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_prefixes_read_back(spark):
    turns = spark.createDataFrame(CONVERSATIONS, TURNS)
    got = {r["conv_id"]: r for r in cp.chat_query(turns).collect()}
    marks = "\\### Assistant: </turn> ok"
    rows = [*CONVERSATIONS, (-7, 0, "user", marks), (-7, 1, "assistant", marks)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = _ordered(x for x in rows if x[0] == conv)
        loss = [x[3] or "" for x in own if x[2] == "assistant"]
        assert (r["n_turns"], r["n_examples"], r["loss_chars"]) == (len(own), len(loss), len("".join(loss)))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()


def test_reading_back_goes_by_the_marks():
    reader = cp._Reader(1)
    text = "### user:\na\\l\n\n</turn>\n### assistant:\nb\\hc\n</turn>\n"
    start = text.index("b\\hc")
    for i, c in enumerate(text):  # rows may end anywhere
        reader.feed(c, *((start, 4) if i == start else (None, None)))
    row = reader.close()
    assert (row["n_turns"], row["n_examples"], row["loss_chars"], row["expanded_chars"]) == (2, 1, 3, len(text))
    assert row["turns_sha256"] == hashlib.sha256(b"user\na<\n\nassistant\nb#c\n").hexdigest() and row["loss_sha256"] == hashlib.sha256(b"b#c").hexdigest()
    forged = cp._Reader(2)
    forged.feed("### user:\nx\n</turn>\n### user:\ny\n</turn>\n", None, None)
    assert forged.close()["n_turns"] == 2
    for broken in ("x", "### user:\nx\n"):
        with pytest.raises(ValueError):
            bad = cp._Reader(3)
            bad.feed(broken, None, None)
            bad.close()


def test_the_digests_are_read_in_written_out_examples(spark, monkeypatch):
    turns = spark.createDataFrame([(7, t, "assistant" if t % 2 else "user", f"t<{t}>#") for t in range(13)] + [(8, 0, "user", "alone")], TURNS)
    rows = [r.asDict() for r in cp.expand_prefixes(turns).orderBy("conv_id", "position").collect()]
    batches = [pa.RecordBatch.from_pylist(rows[:5]), pa.RecordBatch.from_pylist(rows[5:])]
    written = list(cp.written_examples(batches))
    assert [(c, e) for c, e, *_ in written] == [(7, 0), (7, 1), (7, 2), (7, 3), (7, 4), (7, 5), (7, None), (8, None)]
    whole = "".join(r["formatted"] for r in rows if r["conv_id"] == 7)
    assert all(whole.startswith(t) and t.count(cp.TAIL) == 2 * e + 2 for c, e, t, *_ in written if e is not None) and written[6][2] == whole
    out = pa.Table.from_batches(cp._digests(batches)).to_pylist()
    assert [(r["conv_id"], r["n_turns"], r["n_examples"]) for r in out] == [(7, 13, 6), (8, 1, 0)]
    assert out[0]["expanded_chars"] == sum(len(t) for c, e, t, *_ in written if e is not None)
    # An example that is not the prefix it should be, or ends elsewhere, does not go unseen.
    for change in (lambda t: "x" + t[1:], lambda t: t + "### user:\nx\n</turn>\n", lambda t: t[:-1]):
        forged = [(c, e, change(t) if e == 2 else t, *rest) for c, e, t, *rest in written]
        with monkeypatch.context() as m, pytest.raises(ValueError):
            m.setattr(cp, "written_examples", lambda _: iter(forged))
            list(cp._digests(batches))


def test_written_examples_shuffle_the_turns_once_and_pair_none(spark):
    out = cp.render_examples(cp.expand_prefixes(spark.createDataFrame(CONVERSATIONS, TURNS)))
    own = cp.expand_prefixes(spark.createDataFrame(CONVERSATIONS, TURNS))
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join") for df in (out, own)]
    assert joins[0] == joins[1]
    assert {(r["conv_id"], r["example"]) for r in out.collect()} == {(1, 0), (1, 1), (3, 0), (None, 0), (4, 0), (4, 1)}


def test_chats_with_clashing_columns_and_none_at_all(spark):
    turns = spark.createDataFrame(CONVERSATIONS, TURNS)
    wide = turns.withColumns({c: F.lit("z") for c in ("formatted", "start", "example", "__block", "position")})
    plain_rows = sorted(map(repr, cp.chat_query(turns).collect()))
    assert sorted(map(repr, cp.chat_query(wide).collect())) == plain_rows
    assert [r["conv_id"] for r in cp.chat_query(turns.limit(0)).collect()] == [-7]


@pytest.mark.parametrize("block", [2, 1024])
def test_rendered_examples_are_prefixes_with_one_target(spark, monkeypatch, block):
    monkeypatch.setattr(cp, "BLOCK", block)
    rows = [(7, t, "assistant" if t % 2 else "user", f"t<{t}>#") for t in range(13)]
    out = cp.expand_prefixes(spark.createDataFrame(rows, TURNS))
    examples = sorted(cp.render_examples(out).collect(), key=lambda r: r["example"])
    assert [r["example"] for r in examples] == list(range(6))
    for r in examples:
        reply = r["text"][r["target_start"] : r["target_start"] + r["target_chars"]]
        assert reply == f"t\\l{2 * r['example'] + 1}>\\h" and r["text"].endswith(reply + cp.TAIL) and r["text"].count("</turn>") == 2 * r["example"] + 2
    assert cp.expand_prefixes(spark.createDataFrame([], TURNS)).count() == 0


def _tokens():
    import tokenizers

    full = tokenizers.Tokenizer.from_file(bp.public_files()[0])
    full.encode_special_tokens = True
    return lambda t: [*full.encode(t or "", add_special_tokens=False).ids, bp.END]


def test_packing_places_every_token(spark):
    encode = _tokens()
    rows = data.texts()
    out = bp.packing_query(data.documents(spark, clashing=True)).collect()
    want = []
    for d, t in rows:
        ids = encode(t)
        cuts = bp.cut_pieces(len(ids), 1024)
        assert sum(n for _, n in cuts) == len(ids) and all(n == 1024 for _, n in cuts[1:])
        want += [(d, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted(map(repr, (tuple(r)[:5] for r in out))) == sorted(map(repr, want))
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    counts = [0] * 1025
    for r in out:
        counts[r["length"]] += 1
    assert len(bins) <= bp.lower_bound(counts, 1024) + 1
    assert bp.packing_query(data.empty(spark)).count() == 0


def test_fast_and_defining_encoder_agree():
    encode, full = bp._encoder(*bp.public_files()), _tokens()
    odd = ["", " ", "a  b\n\n c\t", "It's 1234567 we'll", "x" * 3000, "ÀÉ ñandú", "日本", "<|endoftext|>", "\x00​", *[t or "" for _, t in data.texts()]]
    for t in odd:
        assert encode(t) == full(t)[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 30) for _ in range(11)]
    counts = {x: items.count(x) for x in set(items)}
    plan = bp.pack_counts(counts, 30)
    used = {x: 0 for x in counts}
    for pattern, times in plan:
        assert sum(pattern) <= 30 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        best, tried = len(rooms) + len(left), set()
        for k, room in enumerate([*rooms, 30]):
            if left[0] <= room and room not in tried:
                tried.add(room)
                then = [*rooms, 30][: max(len(rooms), k + 1)]
                then[k] -= left[0]
                best = min(best, fewest(left[1:], then))
        return best

    assert sum(n for _, n in plan) == fewest(sorted(items, reverse=True), [])


def test_large_counts_need_no_more_steps():
    plan = bp.pack_counts({700: 10**9, 324: 10**9, 100: 3 * 10**8})
    assert sum(n for _, n in plan) == 10**9 + 3 * 10**7 and len(plan) < 20


def test_sentencepiece_parity_on_all_rows(spark):
    docs = data.documents(spark, [(d, t) for d, t in data.texts()], clashing=True)
    out = st.encode_texts(docs, st.public_model(), verified=1)
    rows = out.collect()
    assert all(r["parity"] and r["round_trip"] for r in rows) and len(rows) == len(data.texts())
    back = st.decode_ids(out.drop("text"), st.public_model()).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in data.texts())
    assert st.encode_texts(data.empty(spark), st.public_model()).count() == 0


def test_marks_that_do_not_come_back_still_have_parity(spark):
    out = st.encode_texts(data.documents(spark, [(1, "a ▁b"), (2, "<s> <0x41>   ｆ")]), st.public_model(), verified=1).collect()
    assert all(r["parity"] for r in out) and [r["round_trip"] for r in sorted(out, key=lambda r: r["doc_id"])] == [False, True]


def test_full_normaliser_equals_marking():
    model = st.read_model(st.public_model())
    own, (encode, _) = st.build_tokenizer(model), st._tokenizer(st.public_model())
    odd = ["", " ", "  two  words ", "é\n\t日本", "▁"]
    assert [own.encode(t, add_special_tokens=False).ids for t in odd] == encode(odd)


def test_decoding_by_pieces_equals_the_library_on_any_ids():
    model = st.read_model(st.public_model())
    own, (_, decode) = st.build_tokenizer(model), st._tokenizer(st.public_model())
    draw, n = random.Random(4), len(model.pieces)
    bytes_of = [i for i, (_, _, kind) in enumerate(model.pieces) if kind == st.BYTE]
    space = next(i for i, (p, _, _) in enumerate(model.pieces) if p == st.MARK)
    lists = [[draw.randrange(n) for _ in range(draw.randrange(12))] for _ in range(500)]
    lists += [[draw.choice([*bytes_of, draw.randrange(n)]) for _ in range(6)] for _ in range(500)]
    lists += [[], [space], [space, space, 300], [n + 5, 300], [0, 1, 2]]
    assert len(bytes_of) == 256 and decode(lists) == [own.decode(ids, skip_special_tokens=False) for ids in lists]


def _labelled(spark, n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for d in range(n):
        toxic, junk = d % 5 == 0, d % 7 == 0
        words = data.sentence(rng, rng.randrange(8, 90)).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vileone", "viletwo", "meanish"]))
        if junk:
            words = [w + "%%%" for w in words]
        rows.append((d, " ".join(words)))
        labels.append((d, int(not junk), int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return data.documents(spark, rows + [(900, None), (901, ""), (None, "x y")], clashing=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_finds_held_out_texts(spark):
    docs, labels = _labelled(spark)
    out = {r["doc_id"]: r for r in toxicity.toxicity_query(docs, labels).collect()}
    assert len(out) == 503 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    held = [d for d in range(500) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d]["held_out"] == (d in held) for d in range(500)) and not out[None]["held_out"]
    right = sum(out[d]["predicted"] == int(d % 5 == 0) for d in held) / len(held)
    assert right > 0.95
    assert "own n" in {r["n"] for r in toxicity.toxicity_scores(docs, labels).select("n").collect()}
    none = toxicity.toxicity_query(docs, labels.where("false")).collect()
    assert len(none) == 503 and max(r["score"] for r in none) < 0.01
    assert toxicity.toxicity_query(data.empty(spark), labels).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    votes = np.stack([np.where(rng.random(3000) < 0.85, np.where(y, 1, -1), np.where(y, -1, 1)) for _ in range(5)], 1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1).astype(np.int8)
    model = toxicity.LabelModel(0.2).fit(votes)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.93
    assert model.weights[0] < 0.5 < model.weights[1]


def test_site_rates_shrink_and_help(spark):
    docs, labels = _labelled(spark)
    out = site_quality.classify_documents(docs, labels).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 503 and all(0 < r["score"] < 1 for r in out)
    right = sum(by[d]["kept"] == (d % 7 != 0) for d in range(500)) / 500
    assert right > 0.95
    assert site_quality.classify_documents(data.empty(spark), labels).count() == 0


def test_a_small_site_stays_at_the_global_rate(spark):
    rows = [(k, "big", "p", 3.0 if k % 2 else -3.0) for k in range(400)] + [(1000, "small", "q", 3.0)] + [(2000 + k, "bad", "r", -3.0) for k in range(300)]
    scored = spark.createDataFrame(rows, "doc_id bigint, host string, path string, evidence double")
    got = {r["doc_id"]: r for r in site_quality.combine_with_sites(scored, "host", "path").collect()}
    rate = sum(1 / (1 + np.exp(-r[3])) for r in rows) / len(rows)
    assert abs(got[2000]["path_posterior"] - 0.05) < 0.05
    assert abs(got[1000]["path_posterior"] - rate) < 0.35
    assert got[1]["score"] > got[2000]["score"]


def test_pieces_query_holds_every_row_against_the_library(spark):
    got = st.pieces_query(data.documents(spark)).select("parity").collect()
    assert len(got) == len(data.texts()) and all(r["parity"] for r in got)


def _sites_by_hand(rows):
    """(host posterior, path posterior, score) of each (host, path, evidence), by plain sums."""

    def weight(groups):  # (n, s, mean)
        over = pairs = 0.0
        for n, s, mean in groups:
            if n > 1:
                over += (s - n * mean) ** 2 / max(mean * (1 - mean), 1e-6) - n
                pairs += n * (n - 1)
        if not pairs:
            return site_quality.WEIGHTS[1]
        between = max(over / pairs, 1e-9)
        return min(max((1 - between) / between, site_quality.WEIGHTS[0]), site_quality.WEIGHTS[1])

    p = [1 / (1 + np.exp(-e)) for _, _, e in rows]
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p):
        for table, key in ((hosts, h), (paths, (h, q))):
            n, total = table.get(key, (0, 0.0))
            table[key] = n + 1, total + x
    rate = (sum(p) + 1) / (len(rows) + 2)
    k_host = weight([(n, t, rate) for n, t in hosts.values()])
    host = {h: (t + k_host * rate) / (n + k_host) for h, (n, t) in hosts.items()}
    k_path = weight([(n, t, host[h]) for (h, _), (n, t) in paths.items()])
    out = []
    for (h, q, e), x in zip(rows, p):
        n, t = paths[h, q]
        own = min(max((t - x + k_path * host[h]) / (n - 1 + k_path), 1e-6), 1 - 1e-6)
        odds = e + site_quality.SITE_SHARE * (np.log(own / (1 - own)) - np.log(rate / (1 - rate)))
        out.append((host[h], own, 1 / (1 + np.exp(-odds))))
    return out


def test_posteriors_of_many_sparse_paths_by_hand(spark):
    draw = random.Random(8)
    rows = []
    for h in range(40):
        lean = draw.gauss(0, 2)
        for q in range(draw.randrange(1, 30)):
            for _ in range(draw.choice([1, 1, 1, 2, 5])):
                rows.append((f"h{h}", f"/{q}", lean + draw.gauss(0, 1.5)))
    rows += [("hot", "/", draw.gauss(1, 1)) for _ in range(600)] + [("hot", "/one", -2.0)]
    rows += [(None, "/0", 1.0), (None, None, 1.0), ("h0", None, -1.0), ("", "", 0.5), ("h1", "", 0.5)]
    rows += rows[:5]  # repeated rows count each
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, host string, path string, evidence double").repartition(7)
    got = {r["doc_id"]: (r["host_posterior"], r["path_posterior"], r["score"]) for r in site_quality.combine_with_sites(scored, "host", "path").collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(_sites_by_hand(rows)):
        assert got[i] == pytest.approx(want, rel=1e-9)
