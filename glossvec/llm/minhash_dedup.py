"""Near duplicates by circulant MinHash, banding, and exact Jaccard.

A text is its set of distinct word shingles. Two permutations make a whole
signature: the first places the shingles on a circle of 2**32, and coordinate k is
the least value that the second, shifted by k along the circle, gives them. Bands
of coordinates name buckets. Texts with equal sets are one class and travel once.

Pairs are never written out per bucket. In a bucket every member meets one hub;
then one more, the member that most hubs agreed with; and only members that no
confirmed links join by then are compared one by one, by longer signatures in
blocks, of which the near ones are confirmed. Every link is confirmed on full
sets. A pair at the threshold shares a bucket with a probability of
1 - (1 - 0.8**5)**32, all but 3 in a million; signatures err by over five
deviations before they rule it out.

Defined results: A-Z count as lower case; a null or empty text, or one without
words, has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are equal sets, and both are kept where they
share the smallest id; rows of one id with different texts are linked each by its
own text, so both components may bear that id; a component is named by its least
id, and its rows of a null id are kept only where it has no other, then those of
the text with the least hash; an empty table gives an empty result; extra columns
stay in `deduplicate`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm import scan
from glossvec.llm.common import hot_join, text_of, written
from glossvec.llm.graph import components
from glossvec.plans.joins import fits_broadcast

BANDS, ROWS = 32, 5
#: Per cent of the union that two sets share.
THRESHOLD = 80
#: Members that one task confirms against the same hub.
PER_TASK = 2_000
#: Pairs whose signatures agree in less than the threshold by this much are not read in full: over six deviations.
MARGIN = 0.2
#: The same for the longer signatures of what hubs leave open.
FINE, FINE_MARGIN = 2_048, 0.05
#: Members that a task holds while others stream past.
HELD = 2_048
_FLAT = 1 << 16

CLASS = ["fp1", "fp2", "n"]
#: A class by its number, with the row that stands for it: the least id, a null one last, and a hash of the text.
STANDS = ["id", "doc", "th", *CLASS]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    out = []
    for (words,) in scan.word_hashes(texts, scan.separators(), lower=True):
        take = min(width, len(words))
        if take == 0:
            out.append(words)
            continue
        n = len(words) - take + 1
        h = np.full(n, np.uint64(take), dtype=np.uint64)
        for j in range(take):
            h = scan.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
        out.append(np.unique(h))
    return out


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of 32 bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant signatures of non-empty sets, one row each."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= _FLAT):
            held += len(sets[end])
            end += 1
        first = (scan.mix(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.zeros(end - at, dtype=np.int64)
        np.cumsum([len(s) for s in sets[at : end - 1]], out=starts[1:])
        for k in range(size):
            out[at:end, k] = np.minimum.reduceat(_second(first + np.uint32(k)), starts)
        at = end
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        keys = scan.mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64))
    return keys


SKETCH = "doc_id bigint, th bigint, n bigint, fp1 bigint, fp2 bigint, bands array<bigint>, sig binary"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Hash of the text, size and fingerprint of the set, bucket names, and one byte per coordinate of the signature."""

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            sets = shingle_sets(scan.utf8(batch.column("text")), width)
            full = [s for s in sets if len(s)]
            sig = signatures(full)
            keys = band_keys(sig).view(np.int64) if len(full) else np.zeros((0, BANDS), np.int64)
            place = np.cumsum([len(s) > 0 for s in sets]) - 1
            fp = np.array([[scan.mix(s).sum(), scan.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum()] for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            small = (sig & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[:, 0]), pa.array(fp[:, 1]),
                pa.array([keys[p] if len(s) else None for s, p in zip(sets, place)], pa.list_(pa.int64())),
                pa.array([small[p].tobytes() if len(s) else None for s, p in zip(sets, place)], pa.binary()),
            ], names=["doc_id", "th", "n", "fp1", "fp2", "bands", "sig"])

    return docs.select("doc_id", "text", _text_hash().alias("th")).mapInArrow(run, SKETCH)


def _text_hash() -> Column:
    """With the id, it tells rows apart that are not repeated."""
    return F.xxhash64(text_of("text"))


def _similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold. Rows carry 160 bytes a side."""
    shares = pairs.groupBy("a").agg(F.count("*").alias("m"))
    hubs = shares.join(classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    met = hot_join(pairs, hubs, ["a"], "m", max(pairs.count(), 1)).join(classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    met = met.where(100 * F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb"))
    least = THRESHOLD / 100 - MARGIN

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            same = (sa == sb).mean(1)
            keep = pa.array((same - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, set) of the classes `wanted`; a row sends its set only where it stands for its class."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _text_hash().alias("th"))
    ids = wanted.select("id", F.col("doc").alias("c_doc"), F.col("th").alias("c_th"), *CLASS)
    met = own.join(F.broadcast(ids) if fits_broadcast(ids) else ids, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")))

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            sets = shingle_sets(scan.utf8(batch.column("text")), width)
            wanted = list(zip(*[batch.column(c).to_pylist() for c in CLASS]))
            keep = [
                i for i, s in enumerate(sets)
                if (int(scan.mix(s).sum().view(np.int64)), int(scan.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum().view(np.int64)), len(s)) == wanted[i]
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["id", "set"])

    return met.select("id", "text", *CLASS).mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the full sets confirm.

    A hub's members stream past it in sorted partitions: a task holds one hub and
    one member. A hub of many members is copied to as many tasks as they need.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).alias("tasks")).where("tasks > 1")
    met = pairs.join(F.broadcast(salts) if fits_broadcast(salts) else salts, "a", "left")
    met = met.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("tasks", F.lit(1))).cast("int").alias("salt"))
    members = met.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "set")
    hubs = met.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    rows = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches):
        import pyarrow as pa

        hub, of = None, None
        for batch in scan.sliced(batches):
            a, b = [], []
            for x, salt, kind, y, s in zip(*[batch.column(c) for c in ("a", "salt", "kind", "b", "set")]):
                own = np.frombuffer(s.as_py(), np.uint64)
                if kind.as_py() == 0:
                    hub, of = own, x.as_py()
                elif of == x.as_py():
                    at = np.searchsorted(hub, own)
                    at[at == len(hub)] = 0
                    both = int((hub[at] == own).sum())
                    if 100 * both >= THRESHOLD * (len(hub) + len(own) - both):
                        a.append(of)
                        b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _fine_signatures(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, fine): FINE coordinates of a byte each, of the classes `wanted`."""

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
            fine = (signatures(sets, FINE) & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f.tobytes() for f in fine], pa.binary())], names=["id", "fine"])

    return _sets(docs, wanted, width).mapInArrow(run, "id bigint, fine binary")


def _left_pairs(members: DataFrame, fine: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, id, comp) of one bucket but two components whose fine signatures allow the threshold.

    The members of all components of a bucket but its largest are held, in blocks
    of HELD; all members stream past each block, in parts of PER_TASK. No row is
    made of a pair that the signatures rule out, and of buckets that two members
    share, the first one makes it.
    """
    shared = members.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("m"), F.max("m").alias("most"))
    sizes = sizes.select(F.col("key").alias("k"), "largest", F.ceil((F.col("m") - F.col("most")) / HELD).cast("int").alias("blocks"), F.ceil(F.col("m") / PER_TASK).cast("int").alias("tasks"))
    met = members.join(sizes, F.col("key") == F.col("k")).drop("k").join(fine, "id").join(shared, "id")
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    held = met.where("comp <> largest").select(
        "key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(every).alias("task"), F.lit(0).alias("kind"), "id", "comp", "fine", "keys")
    passing = met.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("tasks")).cast("int").alias("task"),
        F.lit(1).alias("kind"), "id", "comp", "fine", "keys")
    rows = held.unionByName(passing).repartition("key", "block", "task").sortWithinPartitions("key", "block", "task", "kind")
    least = THRESHOLD / 100 - FINE_MARGIN

    def run(batches):
        import pyarrow as pa

        of, ids, comps, sigs, buckets, matrix = None, [], [], [], {}, None
        for batch in scan.sliced(batches):
            a, b = [], []
            for key, block, task, kind, i, comp, f, keys in zip(*[batch.column(c).to_pylist() for c in ("key", "block", "task", "kind", "id", "comp", "fine", "keys")]):
                if of != (key, block, task):
                    of, ids, comps, sigs, buckets, matrix = (key, block, task), [], [], [], {}, None
                own = np.frombuffer(f, np.uint8)
                if kind == 0:
                    ids.append(i)
                    comps.append(comp)
                    sigs.append(own)
                    buckets[i] = set(keys)
                elif ids:
                    if matrix is None:
                        matrix = (np.array(ids), np.array(comps), np.stack(sigs))
                    near = ((matrix[2] == own).mean(1) - 1 / 256) / (1 - 1 / 256)
                    for j in matrix[0][(near >= least) & (matrix[1] != comp)].tolist():
                        if next(k for k in keys if k in buckets[j]) == key:
                            a.append(min(i, j))
                            b.append(max(i, j))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(docs: DataFrame, classes: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """Those of the written pairs `near` that full sets confirm."""
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = written(_sets(docs, written(classes.select(*STANDS).join(ids, "id"), "ids"), width), "sets")
    return written(_confirm(near, sets), "links")


def _judged(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept), one per row of `docs`; th is a hash of the text."""
    sketch = written(sketches(docs, width), "sketch")
    # Ids may be null or repeated, so classes get numbers of their own.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = sketch.where("n > 0").groupBy(*CLASS).agg(F.min(row).alias("row"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), F.col("row.doc_id").alias("doc"), F.col("row.th").alias("th"), *CLASS, "size", "bands", "sig")
    classes = written(classes, "classes")
    keyed = classes.select("id", "n", F.explode("bands").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).where("m > 1"), "buckets")
    total = buckets.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    members = written(hot_join(keyed, buckets, ["key"], "m", total).select("key", "id", "hub"), "members")

    tested = written(members.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = _links(docs, classes, written(_similar(tested, classes), "near"), width)
    labels = components(links)

    # A second hub: in each bucket that is not one component, the member with most confirmed links.
    open_members = _open(members, labels, total)
    degrees = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    ranked = open_members.join(degrees, "id", "left").select("key", "id", "comp", F.struct(F.coalesce("links", F.lit(0)).alias("links"), -F.col("id")).alias("rank"))
    hubs = ranked.groupBy("key").agg(F.count("*").alias("m"), F.max_by(F.struct("id", "comp"), "rank").alias("hub"))
    pairs = hot_join(open_members, hubs, ["key"], "m", total).where("hub.comp <> comp").select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b"))
    pairs = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        links = links.unionByName(_links(docs, classes, written(_similar(pairs, classes), "near"), width))
        tested = tested.unionByName(pairs)
        labels = components(links)
        open_members = _open(members, labels, total)

    # The rest one by one, where longer signatures do not rule it out.
    ids = written(open_members.select("id").distinct(), "ids")
    fine = _fine_signatures(docs, classes.select(*STANDS).join(ids, "id"), width)
    pairs = written(_left_pairs(open_members, fine).join(tested, ["a", "b"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        links = links.unionByName(_links(docs, classes, pairs, width))
        labels = components(links)

    # A component is named by its least id, and stands by the row of it.
    stands = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "th")
    linked = classes.select("id", stands.alias("row")).join(labels, "id")
    rows = written(linked.groupBy("comp").agg(F.min("row").alias("row"), F.count("*").alias("m")), "comps")
    linked = hot_join(labels, rows, ["comp"], "m", max(labels.count(), 1)).select("id", "row")
    named = classes.select("id", *CLASS, "size", stands.alias("own")).join(linked, "id", "left").select(*CLASS, "size", F.coalesce("row", "own").alias("row"))
    own = sketch.select("doc_id", "th", *CLASS)
    found = hot_join(own.where("n > 0"), written(named, "named"), CLASS, "size", max(sketch.count(), 1))
    kept = F.when(F.col("row.no_id"), F.col("th") == F.col("row.th")).otherwise(F.coalesce(F.col("doc_id") == F.col("row.doc"), F.lit(False)))
    every = found.select("doc_id", "th", "n", F.col("row.doc").alias("comp"), kept.alias("kept"))
    every = every.unionByName(own.where("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("comp"), F.lit(True).alias("kept")))
    return every.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), "kept")


def near_components(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one per row of `docs`."""
    return _judged(docs, width).drop("th")


def _open(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Members (key, id, comp) of buckets that hold more than one component."""
    placed = members.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    return written(hot_join(placed, split, ["key"], "m", total).select("key", "id", "comp"), "open")


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """`docs` with one document of each component. What goes is told by id and text, since ids may be null or repeated."""
    gone = written(_judged(docs, width).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__gone_th")).distinct(), "gone")
    own = docs.withColumn("__th", _text_hash())
    same = F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.col("__th") == F.col("__gone_th"))
    return own.join(F.broadcast(gone) if fits_broadcast(gone) else gone, same, "left_anti").select(*docs.columns)


def near_query(docs: DataFrame) -> DataFrame:
    return near_components(docs.select("doc_id", "text"), 2)
