"""Training of merges: many merges a pass, exactly in the order of one after the other.

Words are rows of symbol numbers. A round works on the pairs above some count, the
hot ones. Where neighbours in a word are hot pairs they form a run, and a run ends
where a pair is cold. Whatever merges make of a cold pair is no more frequent than
it was, so until the best pair is as rare as the cold ones, all that happens lies
inside the runs. Distinct runs with their counts are few, as they are made of few
pairs, and the driver goes through the merges on them: an inverted table from pair to
runs, and a heap whose entries are put right when they come up. Then the words are
rewritten by the merges found, in the tasks, and the next round begins. Letters give
hundreds of merges a round; later, when hot pairs seldom touch, thousands.

How many pairs are hot adapts to the number of runs: the driver takes 2 * RUNS at
most, whatever the corpus, unless the pairs of the highest count alone make more. Each round's words replace those of the round
before in the checkpoint folder.

The best pair is the most frequent one, of equals the first by (left, right). A symbol
is known by the merge that made it: two ways to one text stay two symbols in
training and are one entry of the vocabulary.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.plans.joins import task_count
from glossvec.session import drop_table, ensure_checkpoint_dir

#: Hot pairs of the first round, distinct runs that a round aims at, and sums that a task holds before it passes them on.
HOT, RUNS, HELD = 128, 50_000, 200_000


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def _words_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, symbols end to end, and lengths."""
    col = batch.column("sy")
    offsets = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(batch.column("f")), np.asarray(col.values)[offsets[0] : offsets[-1]], np.diff(offsets)


def _pairs_of(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of every symbol and its next one, -1 where a word ends; and the word of each."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    return np.where(word[:-1] == word[1:], pair_keys(values[:-1], values[1:]), -1), word[:-1]


def _among(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted `chosen`."""
    return chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys


def ranked_pairs(words: DataFrame, limit: int) -> list[tuple[int, int]]:
    """The most frequent pairs of all words: (key, count)."""

    def run(batches):
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            f, values, lengths = _words_of(batch)
            if len(values) < 2:
                continue
            key, word = _pairs_of(values, lengths)
            real = key >= 0
            held, back = np.unique(np.concatenate([held, key[real]]), return_inverse=True)
            new = np.zeros(len(held), np.int64)
            np.add.at(new, back, np.concatenate([sums, f[word[real]]]))
            sums = new
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["k", "n"])

    counts = words.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in counts.orderBy(F.desc("n"), "k").limit(limit).collect()]


def hot_runs(words: DataFrame, hot: np.ndarray) -> DataFrame:
    """(run, n): the distinct runs of symbols whose neighbours are all hot pairs, and how often they occur."""

    def run(batches):
        def table():
            return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], names=["run", "n"])

        sums: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            f, values, lengths = _words_of(batch)
            if len(values) < 2:
                continue
            key, word = _pairs_of(values, lengths)
            edge = np.diff(np.concatenate([[0], _among(key, hot).astype(np.int8), [0]]))
            for start, stop in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                sums[values[start : stop + 1].tobytes()] += int(f[word[start]])
            if len(sums) > HELD:
                yield table()
                sums.clear()
        yield table()

    return words.mapInArrow(run, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


class RunMerger:
    """Merges over distinct runs, best pair first, as long as one is above `floor`."""

    def __init__(self, runs: list[tuple[list[int], int]], names: list[str], floor: int):
        self.runs, self.names, self.floor = runs, names, floor
        self.counts: dict[tuple[int, int], int] = defaultdict(int)
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, (symbols, n) in enumerate(runs):
            for p in zip(symbols, symbols[1:]):
                self.counts[p] += n
                self.where[p].add(i)
        self.heap = [self._entry(p) for p, n in self.counts.items() if n > floor]
        heapify(self.heap)

    def _entry(self, p):
        return -self.counts[p], self.names[p[0]], self.names[p[1]], p

    def best(self) -> tuple[tuple[int, int], int] | None:
        while self.heap:
            n, _, _, p = heappop(self.heap)
            if self.counts[p] == -n:
                return p, -n
            if self.counts[p] > self.floor:
                heappush(self.heap, self._entry(p))
        return None

    def merge(self, p: tuple[int, int], made: int) -> None:
        a, b = p
        changed = set()
        for i in self.where.pop(p):
            old, n = self.runs[i]
            new, k = [], 0
            while k < len(old):
                if k + 1 < len(old) and old[k] == a and old[k + 1] == b:
                    new.append(made)
                    k += 2
                else:
                    new.append(old[k])
                    k += 1
            if len(new) == len(old):
                continue  # an earlier merge took it
            for q in zip(old, old[1:]):
                self.counts[q] -= n
            for q in zip(new, new[1:]):
                self.counts[q] += n
                if made in q:
                    self.where[q].add(i)
                    changed.add(q)
            self.runs[i] = (new, n)
        self.counts.pop(p, None)
        for q in changed:
            if self.counts[q] > self.floor:
                heappush(self.heap, self._entry(q))


def merged_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """A word after the merges `ranks` (pair to place and symbol made), lowest place first, from the left."""
    while True:
        step = min((ranks[p] for p in zip(symbols, symbols[1:]) if p in ranks), default=None)
        if step is None:
            return symbols
        out, k = [], 0
        while k < len(symbols):
            if k + 1 < len(symbols) and ranks.get((symbols[k], symbols[k + 1])) == step:
                out.append(step[1])
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out


def rewritten(words: DataFrame, ranks: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Words (f, sy) after the merges. Words without any of their pairs pass as they are."""
    first = np.array(sorted(a << 32 | b for a, b in ranks), np.int64)

    def run(batches):
        for batch in batches:
            f, values, lengths = _words_of(batch)
            touched = np.zeros(len(f), bool)
            if len(values) > 1:
                key, word = _pairs_of(values, lengths)
                touched[word[_among(key, first)]] = True
            ends = np.cumsum(lengths)
            sy = [merged_word(values[e - n : e].tolist(), ranks) if t else values[e - n : e] for t, e, n in zip(touched.tolist(), ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(sy, pa.list_(pa.int32()))], names=["f", "sy"])

    return words.mapInArrow(run, "f bigint, sy array<int>")


def learn_merges(words: DataFrame, letters: list[str], join, vocab_size: int | None, rounds: int | None, known: set[str], least: int, hot: int = HOT, runs: int = RUNS) -> list[tuple[str, str, str, int]]:
    """Merges (left, right, merged, count) in order, of words (f, sy) over the numbers of `letters`.

    Ends with `rounds` merges, or `vocab_size` entries counting those `known`, or where no pair has `least` occurrences.
    """
    spark = words.sparkSession
    names, merges, seen = list(letters), [], set(known)
    folder = f"{ensure_checkpoint_dir(spark)}/merges-{uuid.uuid4().hex}"

    def stored(df: DataFrame, number: int) -> DataFrame:
        df.write.parquet(f"{folder}/{number}")
        return spark.read.schema("f bigint, sy array<int>").parquet(f"{folder}/{number}")

    def done() -> bool:
        return (rounds is not None and len(merges) >= rounds) or (vocab_size is not None and len(seen) >= vocab_size)

    number = 0
    current = stored(words.repartition(task_count(words)), 0)
    while not done():
        ranked = ranked_pairs(current, hot + 1)
        floor = ranked[-1][1] if len(ranked) > hot else 0
        chosen = np.array(sorted(k for k, n in ranked if n > floor), np.int64)
        if not len(chosen):
            if not ranked:
                break
            hot *= 4  # more pairs share the highest count
            continue
        found = hot_runs(current, chosen).limit(2 * runs).collect()
        if len(found) == 2 * runs and len(chosen) > 1 and ranked[0][1] > ranked[len(chosen) // 4][1]:
            hot = max(len(chosen) // 4, 1)
            continue
        if len(found) == 2 * runs:
            found = hot_runs(current, chosen).collect()
        held = RunMerger([(np.frombuffer(r["run"], np.int32).tolist(), r["n"]) for r in found], names, max(floor, least - 1))
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        while not done() and (top := held.best()):
            (a, b), n = top
            ranks[a, b] = (len(ranks), len(names))
            merges.append((names[a], names[b], join(names[a], names[b]), n))
            names.append(merges[-1][2])
            seen.add(names[-1])
            held.merge((a, b), len(names) - 1)
        if done() or (not floor or floor < least):
            break
        number += 1
        current = stored(rewritten(current, ranks), number)
        drop_table(spark, f"{folder}/{number - 1}")
        hot = max(min(hot * 4, int(hot * runs / max(len(found), 1))), 16)
    drop_table(spark, folder)
    return merges
