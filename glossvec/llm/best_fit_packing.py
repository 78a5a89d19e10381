"""Packing of tokenised documents into sequences by bin completion.

Texts are tokenised once, in the tasks. How many pieces of each length there are
is all that the search needs: at most `capacity` numbers, whatever the corpus.
The search fills the sequence of the largest piece left, tries the undominated
fillings, cuts off those that waste more than the best packing allows, and
starts from the best-fit packing. Its outcome is a list of patterns with counts;
pieces find their places in it by their rank among pieces of their length.

Defined results: a null text is empty and gives the end token alone; repeated
rows and null ids are packed like any other; an empty table gives an empty
result; other columns are not carried over.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossvec.llm.common import written

CAPACITY = 1024
END = 2
#: Pieces of one length that are numbered together.
RANKED = 1_000
#: Nodes that the search visits, and fillings that it tries at one.
NODES, WIDTH = 20_000, 6

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Own(dict):
    """What a process made for itself. Functions that use it are shipped by value, and then it is empty: a tokenizer that is pickled loses its settings."""

    def __reduce__(self):
        return _Own, ()


_encoders = _Own()


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from text to ids, made once in a worker.

    With a rank file, texts of Latin letters go through `tiktoken`, whose ids are
    the same at three times the speed; all others go through `tokenizers`.
    """
    name = (json_path, ranks_path)
    if name not in _encoders:
        import re

        def full():
            """The defining library, loaded by the first text that needs it."""
            if json_path not in _encoders:
                import tokenizers

                _encoders[json_path] = tokenizers.Tokenizer.from_file(json_path)
                _encoders[json_path].encode_special_tokens = True
            return _encoders[json_path]

        fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Where two regular-expression engines could disagree, or a run without a break is long, the defining library answers.
        odd = re.compile(r"[^\t-\r -~¡-ɏ]|\S{2000}|\s{2000}")

        def encode(text: str) -> list[int]:
            if fast is None or odd.search(text):
                return full().encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[name] = encode
    return _encoders[name]


def public_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n - (max(n, 1) - 1) // capacity * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, files: tuple, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, and the ids themselves if asked for."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        encode = _encoder(*files)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    part = ids[start : start + length]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        out["ids"].append(part.astype("int32"))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def _best_below(counts: list[int]) -> list[int]:
    """For each room the largest length there is that fits, 0 for none."""
    best = [0] * len(counts)
    for x in range(1, len(counts)):
        best[x] = x if counts[x] else best[x - 1]
    return best


def _greedy(room: int, counts: list[int]) -> tuple[int, ...]:
    """Largest fitting first."""
    items: list[int] = []
    used: Counter = Counter()
    x = room
    while room and x:
        x = min(x, room)
        while x and counts[x] - used[x] <= 0:
            x -= 1
        if x:
            items.append(x)
            used[x] += 1
            room -= x
    return tuple(items)


def fillings(room: int, counts: list[int], waste: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` that waste at most `waste`, the fullest first, then the one of fewest pieces.

    A filling is dominated by one that holds a piece where it holds pieces of no
    larger sum: a single piece that fills the room dominates all; of pairs, only
    those fuller than the best single piece remain; of triples, only those
    fuller than the best pair. The greedy filling stands for longer ones.
    """
    best = _best_below(counts)
    one = best[room]
    if one == room:
        return [(one,)] if room else [()]
    found: dict[tuple[int, ...], int] = {}
    if one:
        found[(one,)] = one
    top = one
    for x in range(one, 0, -1):
        if not counts[x] or 2 * x < top:
            continue
        y = best[min(x, room - x)]
        if y == x and counts[x] < 2:
            y = best[x - 1]
        if y and x + y > one:
            found[(x, y)] = x + y
            top = max(top, x + y)
            if top == room:
                break
    if top < room:
        pair = top
        for x in range(one, 0, -1):
            if not counts[x] or 3 * x < pair or top == room:
                continue
            for y in range(min(x, room - x), 0, -1):
                if not counts[y] or x + 2 * y < pair or (y == x and counts[x] < 2):
                    continue
                z = best[min(y, room - x - y)]
                while z and counts[z] < (x, y, z).count(z):
                    z = best[z - 1]
                if z and x + y + z > pair:
                    found[(x, y, z)] = x + y + z
                    pair = top = x + y + z
                    if top == room:
                        break
    greedy = _greedy(room, counts)
    found[greedy] = sum(greedy)
    fits = sorted(((s, f) for f, s in found.items() if room - s <= waste), key=lambda sf: (-sf[0], len(sf[1]), [-v for v in sf[1]]))
    return [f for _, f in fits[:width]]


def _apply(largest: int, filling: tuple[int, ...], counts: list[int]) -> int:
    """How many sequences can take this filling at once."""
    return min(counts[x] // m for x, m in Counter((largest, *filling)).items())


def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and by pieces too large to share (Martello and Toth's second bound)."""
    best = -(-sum(x * n for x, n in enumerate(counts)) // capacity)
    for k in range(capacity // 2 + 1):
        big = sum(counts[capacity - k + 1 :])
        half = range(capacity // 2 + 1, capacity - k + 1)
        mid, mid_sum = sum(counts[x] for x in half), sum(x * counts[x] for x in half)
        small = sum(x * counts[x] for x in range(max(k, 1), capacity // 2 + 1))
        best = max(best, big + mid + max(0, -(-(small - (mid * capacity - mid_sum)) // capacity)))
    return best


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with how many sequences follow it, in as few sequences as the search finds.

    Branch and bound over the fillings of the largest length left. A node takes a
    filling as often as the counts allow, so the depth does not grow with the
    corpus. The first descent is best-fit; it stops at the lower bound or when
    its nodes are spent, with the best packing so far.
    """
    start = [0] * (capacity + 1)
    for length, n in counts.items():
        start[length] = n
    total = sum(x * n for x, n in enumerate(start))
    bound = lower_bound(start, capacity)

    def descend(choose) -> list[tuple[tuple[int, ...], int]]:
        left, plan = list(start), []
        for largest in range(capacity, 0, -1):
            while left[largest]:
                left[largest] -= 1
                filling = choose(capacity - largest, left)
                left[largest] += 1
                times = _apply(largest, filling, left)
                for x in (largest, *filling):
                    left[x] -= times
                plan.append(((largest, *filling), times))
        return plan

    incumbent = descend(_greedy)
    size = sum(n for _, n in incumbent)
    if size == bound:
        return incumbent
    # Depth first with an own stack: (counts, sequences so far, waste so far, plan as a linked list).
    stack = [(start, 0, 0, None)]
    while stack and nodes and size > bound:
        nodes -= 1
        left, used, wasted, plan = stack.pop()
        largest = next((x for x in range(capacity, 0, -1) if left[x]), 0)
        if not largest:
            if used < size:
                size, incumbent = used, []
                while plan:
                    plan, step = plan
                    incumbent.append(step)
                incumbent.reverse()
            continue
        spare = (size - 1) * capacity - total - wasted
        if spare < 0:
            continue
        left[largest] -= 1
        tries = fillings(capacity - largest, left, min(spare, capacity), width)
        left[largest] += 1
        for filling in reversed(tries):
            times = _apply(largest, filling, left)
            waste = capacity - largest - sum(filling)
            if waste:
                times = min(times, spare // waste)
            if not times:
                continue
            then = list(left)
            for x in (largest, *filling):
                then[x] -= times
            stack.append((then, used + times, wasted + waste * times, (plan, ((largest, *filling), times))))
    return incumbent


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, ascending by rank: (first rank, first sequence, places a sequence, first offset).

    A pattern of distinct lengths a to z has at most as many entries as lengths,
    so there are at most patterns * 45 of them for a capacity of 1024.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, m in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((taken[length], base, m, offset))
            taken[length] += times * m
            offset += length * m
        base += times
    return out


def ranked_pieces(pieces: DataFrame, counts: dict[int, int], ranked: int = RANKED) -> DataFrame:
    """Add `rank`, the number of a piece among those of its length, without a task that sees a whole length."""
    buckets = F.array(*[F.lit(-(-counts.get(x, 0) // ranked) or 1) for x in range(max(counts, default=0) + 1)])
    order = ["doc_id", "piece", "start", "ids_crc32"]
    with_bucket = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length").cast("int"))))
    sizes = with_bucket.groupBy("length", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy(*order)
    numbered = with_bucket.withColumn("__row", F.row_number().over(inside) - 1)
    return numbered.join(bases, ["length", "__bucket"]).withColumn("rank", F.col("__base") + F.col("__row")).drop("__bucket", "__base", "__row")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to written pieces."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(pack_counts(counts, capacity, nodes))
    starts = {length: [e[0] for e in entries] for length, entries in places.items()}
    names = pieces.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                first, base, m, offset = places[length][bisect_right(starts[length], rank) - 1]
                ids.append(base + (rank - first) // m)
                offsets.append(offset + (rank - first) % m * length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*names, "sequence_id", "offset"])

    ranked = ranked_pieces(pieces, counts).select(*names, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, files: tuple | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Pieces of all `docs` with their places in sequences of at most `capacity` tokens."""
    pieces = written(tokenised_pieces(docs, files or public_files(), capacity, end, with_ids), "pieces")
    return place_pieces(pieces, capacity, nodes)


def packing_query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
