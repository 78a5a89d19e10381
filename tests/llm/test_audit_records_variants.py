import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossvec.llm import binary_records, filter_audit, spelling_variants
from glossvec.llm.best_fit_packing import END, _encoder, public_files


# ---- filter audit

LABELS = [(0, 1, 0), (0, 1, 0), (1, 0, 1), (101, 1, 1), (407, 1, None), (410, None, 1), (17, 1, 0), (999, 1, 1)]


def _failed(rows):
    """The failed filters of each row, by their definitions."""
    out = []
    for d, t in rows:
        t = t or ""
        w = data.WORD.findall(t)
        hit = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t))]
        hit.append(d is not None and any(e is not None and e < d and (u or "") == t for e, u in rows))
        out.append({x for x, h in zip("ABCDE", hit) if h})
    return out


def _audit(rows, parts):
    good = {d for d, q, _ in LABELS if q == 1}
    toxic = {d for d, _, x in LABELS if x == 1}
    failed, out = _failed(rows), {}
    for part in set(parts):
        docs = [(d, f) for (d, _), f, p in zip(rows, failed, parts) if p == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, x in enumerate(order):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x in f for _, f in docs) - len(gone), sum(f == {x} for _, f in docs),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_applying_every_order(spark):
    rows = data.texts() + [(500, "word " * 300), (501, "Word two three. " * 3 + " ".join(f"v{i}" for i in range(250))), (502, None)]
    docs = data.documents(spark, rows, clashing=True).withColumn("source", F.when(F.col("doc_id") == 500, F.lit(None)).otherwise(F.col("source")))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    parts = ["" if d == 500 else f"src{(d or 0) % 4}" for d, _ in rows]
    got = filter_audit.audit(docs, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*names).collect())) == _audit(rows, parts)
    assert dict(got.dtypes)["shapley"] == "bigint" and dict(got.dtypes)["step"] == "int"


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audit(data.empty(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_potentials_give_shapley_values(spark):
    rng = random.Random(3)
    values = [0] * 32
    for s in range(1, 32):
        values[s] = max(values[s & ~(1 << i)] for i in range(5) if s >> i & 1) + rng.randrange(50)
    row = spark.createDataFrame([(values,)], "v array<bigint>").select(filter_audit.potentials(F.col("v")).alias("p")).first()["p"]
    for i in range(5):
        total = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += values[before | 1 << i] - values[before]
        assert total == 2 * (row[31] - row[31 ^ 1 << i])


# ---- binary records


@pytest.mark.parametrize("file_bytes", [1, 4_000, 1 << 25])
def test_records_come_back_in_order(spark, tmp_path, file_bytes):
    rows, encode = data.texts(), _encoder(*public_files())
    got = binary_records.tokenised_files(data.documents(spark, rows, clashing=True), str(tmp_path / "out"), file_bytes=file_bytes).collect()
    want = []
    for d, t in rows:
        ids = np.array([*encode(t or ""), END], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    shuffled = binary_records.read_shuffled(spark, str(tmp_path / "out"), seed=5).collect()
    assert sorted(((r["doc_id"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in shuffled), key=repr) == sorted(want, key=repr)
    assert [r["doc_id"] for r in shuffled] != [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    again = binary_records.read_shuffled(spark, str(tmp_path / "out"), seed=5).collect()
    assert sorted((r["place"], repr(r["doc_id"])) for r in again) == sorted((r["place"], repr(r["doc_id"])) for r in shuffled)


def test_records_of_an_empty_table(spark, tmp_path):
    assert binary_records.tokenised_files(data.empty(spark), str(tmp_path / "none")).count() == 0
    assert binary_records.read_shuffled(spark, str(tmp_path / "none")).count() == 0


def test_wide_ids_and_raw_bytes_come_back(spark, tmp_path):
    """Ids over 16 bits, and payloads with every byte, line ends and invalid UTF-8 among them."""
    docs = spark.createDataFrame([(k, f"{k * 77777} {10 + 256 * k}") for k in range(600)], "doc_id bigint, text string")
    binary_records.write_records(docs, str(tmp_path / "wide"), lambda: lambda t: [int(x) for x in t.split()], wide=True)
    got = {r["doc_id"]: list(r["ids"]) for r in binary_records.read_records(spark, str(tmp_path / "wide"), with_ids=True).collect()}
    assert got == {k: [k * 77777, 10 + 256 * k, END] for k in range(600)}


def test_damage_is_found():
    record = binary_records.framed(binary_records.serialized(7, np.arange(5), False)) + b"\n"
    assert list(binary_records.spans(record * 2)) == [(0, len(record)), (len(record), len(record))]
    assert binary_records.unserialized(binary_records.payload_of(record))[0] == 7
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(Exception):
            for a, n in binary_records.spans(bytes(broken)):
                binary_records.payload_of(bytes(broken[a : a + n]))


# ---- spelling variants


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _grouped(counts):
    near = defaultdict(list)
    for a, b in itertools.combinations(sorted(counts), 2):
        if abs(len(a) - len(b)) < 2 and _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def test_composition_accepts_exactly_the_pairs_one_edit_apart():
    rng = random.Random(1)
    for _ in range(150):
        letters, longest = "abé"[: rng.randrange(1, 4)], rng.randrange(2, 8)
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(rng.randrange(1, 40))})
        got = [tuple(sorted(p)) for p in spelling_variants.composed(spelling_variants.Acceptor(words))]
        want = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if _one_edit(words[i], words[j])}
        assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    """As many states as there are different sets of endings."""
    words = sorted({a + b + c for a in ("", "x", "xy") for b in ("in", "on") for c in ("g", "gs", "")})
    a = spelling_variants.Acceptor(words)
    reached, stack = set(), [0]
    while stack:
        s = stack.pop()
        if s not in reached:
            reached.add(s)
            stack += a.next[s].values()
    starts = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(reached) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in starts})


@pytest.mark.parametrize("part_words", [20_000, 12])
def test_groups_equal_all_pairs(spark, part_words):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(7, 10))) for _ in range(250)}
    words |= {"a" * k for k in range(7, 13)} | {"b" * 8, "é" + "b" * 8, "x" * 600, "x" * 599, "x" * 600 + "y"}
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = spelling_variants.group_variants(df, part_words=part_words).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == _grouped(counts)


def test_variants_of_documents_equal_brute_force(spark):
    rng = random.Random(4)
    stems = ["wonderful", "Übermäßig", "communication", "Straßenbahn", "interest", "intérêt"]
    rows = [(k, " ".join(rng.choice(stems) for _ in range(60))) for k in range(200)] + data.texts()
    rows += [(700, "x" * 3000), (701, "x" * 3000), (None, "communication!wonderful;wonderful-Wonderful")]
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(data.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling_variants.variants_query(data.documents(spark, rows, clashing=True))
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=repr) == _grouped(counts)
    assert spelling_variants.variants_query(data.empty(spark)).count() == 0
