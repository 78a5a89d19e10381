"""Passages that repeat anywhere in a corpus, by prefix-free parsing and suffix order.

Every byte of a string of `length` bytes that also starts elsewhere goes. The corpus is
never sorted as a whole:

* Triggers. A rolling hash of `gram` bytes runs over each text. In every
  such string the least hash, the leftmost of equals, is its trigger. So
  equal strings have the same trigger at the same offset, and each string
  belongs to one trigger.
* Phrases. All strings of one trigger lie in one phrase, the bytes they cover. A
  text is parsed into its phrases, named by two hashes: of the trigger and of
  the phrase.
* Dictionary and parse. A trigger met once repeats nothing: all its strings are
  unique. A phrase met twice or more repeats all its strings. What is left are
  distinct phrases that share a trigger, as where copies begin and end.
* Suffix order. For those, the suffixes of the phrases of a trigger are sorted to
  a depth of `length` bytes by prefix doubling. A string repeats if its rank is
  shared within the dictionary, or if the parse holds its phrase twice. Counts of
  phrases stand for the suffix array of the parse: such a string lies
  within one phrase, so no order across phrases is needed, and none is made.

Texts cross the network once, towards the phrases they are asked for. Triggers and
phrases move as hashes, and what a trigger of very many phrases holds is counted
string by string in a shuffle instead of in one task.

Defined results: a null text is empty; texts under `length` bytes lose nothing;
repeated rows repeat each other and lose all that is long enough; rows of a null
id take part like others; an empty table gives an empty result; extra columns
stay in `cut_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.llm import scan
from glossvec.llm.common import hot_join, text_of, written

LENGTH, GRAM = 400, 96
#: Bytes parsed at a time.
PART = 1 << 18
#: Phrase bytes sorted at a time, and the phrases of one trigger that may be.
SORTED_BYTES, SORTED_PHRASES = 2 << 20, 4_096


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _buffers(texts: list[bytes], length: int):
    """Texts end to end, long ones in parts that overlap by length - 1: (buffer, owners, offsets in the text, starts, ends)."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PART):
            held.append((i, at, text[at : at + PART + length - 1]))
            size += len(held[-1][2])
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def parse(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Phrases of all texts: (text number, trigger hash, phrase hash, first byte, strings in it)."""
    values, out = scan.byte_values(False), []
    for held in _buffers(texts, length):
        data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        ends = np.cumsum([len(h[2]) for h in held])
        starts = ends - [len(h[2]) for h in held]
        sums = scan.prefix_sums(data, values)
        at = np.arange(len(data) - gram + 1)
        hashes = scan.stretch_hash(sums, at, at + gram)
        keys = (hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
        trigger = (_least(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        counts = ends - starts - length + 1  # strings by part
        before = np.cumsum(counts) - counts
        string = np.arange(int(counts.sum())) + np.repeat(starts - before, counts)
        own = trigger[string]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        many = np.diff(np.concatenate([first, [len(own)]]))
        begin = string[first]
        part = np.searchsorted(starts, begin, "right") - 1
        owner, shift = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        out.append((owner[part], hashes[own[first]], scan.stretch_hash(sums, begin, begin + many - 1 + length), begin - starts[part] + shift[part], many))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys, equal ones alike."""
    order = np.argsort(keys)
    new = np.empty(len(keys), dtype=bool)
    new[0] = False
    ordered = keys[order]
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the `length` bytes at each place that has so many, in their lexicographic order."""
    wide = min(8, length)
    n = len(data) - wide + 1
    key = np.zeros(n, dtype=np.uint64)
    for k in range(wide):
        key = (key << np.uint64(8)) | data[k : k + n]
    rank = _ranks(key)
    while wide < length:
        step = min(wide, length - wide)  # two overlapping halves make the last width
        n = len(rank) - step
        rank = _ranks(rank[:n] * np.uint64(len(data)) + rank[step : step + n])
        wide += step
    return rank


OCCURRENCE = "doc_id bigint, row bigint, g bigint, p bigint, at int, many int"


def _identified(docs: DataFrame, text: str) -> DataFrame:
    """Rows are known by id and a hash of the text, so that rows that share an id don't mix."""
    return docs.withColumn("__row", F.xxhash64("doc_id", text_of(text)))


def occurrences(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            own, g, p, at, many = parse(scan.utf8(batch.column("text")), length, gram)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(g.view(np.int64)), pa.array(p.view(np.int64)),
                pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], names=["doc_id", "row", "g", "p", "at", "many"])

    return docs.mapInArrow(run, OCCURRENCE)


CONTENT = "g bigint, doc_id bigint, row bigint, at int, many int, single boolean, content binary"
SPAN = "doc_id bigint, row bigint, start int, stop int"


def _contents(asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases asked for, one row each."""

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            out = {k: [] for k in ("g", "doc_id", "row", "at", "many", "single", "content")}
            for doc, row, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), scan.utf8(batch.column("text")), batch.column("wanted").to_pylist()):
                for w in wanted:
                    out["doc_id"].append(doc)
                    out["row"].append(row)
                    for k in ("g", "at", "many", "single"):
                        out[k].append(w[k])
                    out["content"].append(text[w["at"] : w["at"] + w["many"] - 1 + length])
            kinds = {"g": pa.int64(), "doc_id": pa.int64(), "row": pa.int64(), "at": pa.int32(), "many": pa.int32(), "single": pa.bool_(), "content": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    return asked.mapInArrow(run, CONTENT)


def _runs(positions: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions as runs [first, last] of strings that touch: at most `length` apart."""
    cut = np.flatnonzero(np.diff(positions) > length)
    return positions[np.concatenate([[0], cut + 1])], positions[np.concatenate([cut, [len(positions) - 1]])]


def _shared(held: list[tuple], length: int = LENGTH) -> list[tuple]:
    """Spans of the phrases held once whose strings the dictionary holds again. held: whole triggers."""
    data = np.frombuffer(b"".join(h[6] for h in held), np.uint8)
    starts = np.cumsum([0] + [len(h[6]) for h in held[:-1]])
    many = np.array([h[4] for h in held])
    before = np.cumsum(many) - many
    string = np.arange(int(many.sum())) + np.repeat(starts - before, many)
    rank = suffix_ranks(data, length)[string].astype(np.int64)
    twice = np.bincount(rank)[rank] > 1
    out = []
    for k, (_, doc, row, at, n, single, _) in enumerate(held):
        if single:
            hit = np.flatnonzero(twice[before[k] : before[k] + n])
            if len(hit):
                lo, hi = _runs(hit, length)
                out += [(doc, row, int(at + a), int(at + b + length)) for a, b in zip(lo, hi)]
    return out


def _spans_in_order(contents: DataFrame, length: int) -> DataFrame:
    """Suffix order over batches of whole triggers."""

    def run(batches):
        import pyarrow as pa

        def table(rows):
            cols = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "row", "start", "stop"])

        held, size = [], 0
        for batch in scan.sliced(batches):
            for row in zip(*[batch.column(c).to_pylist() for c in ("g", "doc_id", "row", "at", "many", "single", "content")]):
                if size >= SORTED_BYTES and row[0] != held[-1][0]:
                    yield table(_shared(held, length))
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield table(_shared(held, length))

    return contents.repartition("g").sortWithinPartitions("g").mapInArrow(run, SPAN)


def _spans_by_count(contents: DataFrame, length: int) -> DataFrame:
    """The same for triggers of very many phrases: strings counted by two hashes, in a shuffle that pre-aggregates."""

    def run(batches):
        import pyarrow as pa

        tables = scan.byte_values(False), scan.byte_values(False, 2)
        for batch in scan.sliced(batches):
            for doc, row, at, many, content, single in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row", "at", "many", "content", "single")]):
                data, s = np.frombuffer(content, np.uint8), np.arange(many)
                h, k = (scan.stretch_hash(scan.prefix_sums(data, t), s, s + length).view(np.int64) for t in tables)
                n = len(s)
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array((at + s).astype(np.int32)), pa.array(h), pa.array(k), pa.array([single] * n)],
                    names=["doc_id", "row", "start", "h", "k", "single"])

    strings = contents.mapInArrow(run, "doc_id bigint, row bigint, start int, h bigint, k bigint, single boolean")
    counts = strings.groupBy("h", "k").agg(F.count("*").alias("n")).where("n > 1")
    return strings.where("single").join(counts, ["h", "k"]).select("doc_id", "row", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(spans that phrases met twice cover, phrases to be looked into) of identified docs (doc_id, row, text)."""
    occ = occurrences(docs, length, gram)
    triggers = written(occ.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "triggers")
    total = triggers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    met = written(hot_join(occ, triggers, ["g"], "n", total).drop("n"), "occurrences")
    phrases = met.groupBy("g", "p").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "at", "many")).alias("one"))
    phrases = written(phrases.select("g", "p", "n", "one.*"), "phrases")
    twice = phrases.where("n > 1").select("g", "p", "n")
    covered = hot_join(met, twice, ["g", "p"], "n", total).select("doc_id", "row", F.col("at").alias("start"), (F.col("at") + F.col("many") - 1 + length).alias("stop"))
    # Phrases that share a trigger: those met once are looked into, the others are what they may equal.
    mixed = phrases.groupBy("g").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("g", "d")
    asked = hot_join(phrases.drop("p"), mixed, ["g"], "d", max(phrases.count(), 1))
    return written(covered, "covered"), written(asked.select("doc_id", "row", "g", "at", "many", (F.col("n") == 1).alias("single"), "d"), "asked")


def _join_rows(docs: DataFrame, per_row: DataFrame, how: str) -> DataFrame:
    """On id and row hash; a null id equals itself."""
    right = per_row.withColumnRenamed("doc_id", "__d").withColumnRenamed("row", "__r")
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r")), how).drop("__d", "__r")


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, spans): what each row loses, of identified docs."""
    covered, asked = repeated_spans(docs, length, gram)
    spans = covered
    for part, find in ((asked.where(f"d <= {SORTED_PHRASES}"), _spans_in_order), (asked.where(f"d > {SORTED_PHRASES}"), _spans_by_count)):
        if part.limit(1).count():
            wanted = part.groupBy("doc_id", "row").agg(F.collect_list(F.struct("g", "at", "many", "single")).alias("wanted"))
            spans = spans.unionByName(find(_contents(_join_rows(docs, wanted, "inner").select("doc_id", "row", "text", "wanted"), length), length))
    return spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut_rows(docs: DataFrame, text: str, passed: list[str], with_text: bool, decode: bool = False, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, the columns `passed` under names with in_, text, n_bytes, n_removed, n_spans, kept_sha256, kept.

    With `decode` the text is what is left of it, and `kept` is empty.
    """
    own = _identified(docs, text).select("doc_id", F.col("__row").alias("row"), text_of(text).alias("text"), F.col(text).isNull().alias("none"), *[F.col(c).alias(f"in_{c}") for c in passed])
    met = _join_rows(own, removed_spans(own.select("doc_id", "row", "text"), length, gram), "left")
    names = ["doc_id", *[f"in_{c}" for c in passed]]
    fields = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in names], "text string", "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"])

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            out = [[], [], [], [], [], []]
            for t, none, spans in zip(scan.utf8(batch.column("text")), batch.column("none").to_pylist(), batch.column("spans").to_pylist()):
                merged = _merge(spans or [])
                kept = _cut(t, merged)
                shown = None if none or not with_text else kept.decode("utf-8", "ignore") if decode else t.decode()
                for o, v in zip(out, (shown, len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text and not decode else b"")):
                    o.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(o, k) for o, k in zip(out, kinds)]], names=[*names, "text", *ADDED])

    return met.mapInArrow(run, schema)


ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def cut_repeats(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = True, length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """`docs` (or its columns `keep`) with n_bytes, n_removed, n_spans, kept_sha256, and `kept`, the bytes that are left.

    Cuts fall between bytes, so `kept` need not be valid UTF-8. Columns of these
    names in `docs` are replaced.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    done = _cut_rows(docs, text, [c for c in cols if c not in ("doc_id", text)], with_text, length=length, gram=gram)
    own = {"doc_id": F.col("doc_id"), text: F.col("text").alias(text)}
    return done.select(*[own.get(c, F.col(f"in_{c}").alias(c)) for c in cols], *ADDED)


def repeats_query(docs: DataFrame) -> DataFrame:
    out = cut_repeats(docs.select("doc_id", "text"), keep=["doc_id"], with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with its texts rid of repeated passages. A character that a cut splits goes with it; a null text stays null."""
    names = docs.columns
    done = _cut_rows(docs, "text", [c for c in names if c not in ("doc_id", "text")], True, decode=True, length=length, gram=gram)
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"in_{c}").alias(c) for c in names])
