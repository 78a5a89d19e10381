"""Words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

The vocabulary is an acyclic automaton. Composed with a transducer that copies
symbols and may insert, delete or replace one, and with the vocabulary again, it
accepts the pairs of words that are one edit apart. A state of the composition is
(state of the left word, has edited, state of the right word); before the edit
both words are the same, so both states are.

* Parts. A part holds the words that reach one state from the initial one: those
  with the same first PREFIX code points. Pairs whose edit lies behind are all in
  one part. For the others the words are read backwards: an edit among the first
  PREFIX code points leaves at least that many equal ones at the end, as words have
  2 * PREFIX + 1 code points. A pair belongs to one of the two by how far its words
  agree, so none is met twice.
* Minimised acceptor. A task takes the sorted words of a part, builds the minimal
  automaton as they come, and numbers its words: every transition knows how many
  words come before. The composition is walked from the part's state, leaving out
  what holds a single word; a pair is two word numbers, and no string is built.
* Large parts. A part of over PART_WORDS words is not given to a task: its state
  is expanded. The words go on to the parts of the next code point, and pairs
  whose edit is at the state itself meet by what follows the edit, at most one
  word for each code point there is. This repeats until all parts are small.
* A task returns for each word how many near words it has there and the best of
  them, so what is shuffled grows with the words, not with the pairs.

Defined results: a null or empty text has no words; a null id counts as the empty
text in the hash that picks a deletion; repeated rows count again; a word of a whole
text without other characters is one word, however long; ties of the form go to the
first in code-point order; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.llm import scan
from glossvec.llm.common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of a word at least, and of what the words of a part share.
SHORTEST, PREFIX = 7, 3
MIN_COUNT, RATIO = 2, 10
#: Words of a part that a task takes at most, and words that it counts before it passes them on.
PART_WORDS, COUNTED = 20_000, 200_000
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def variant(doc_id: int | None, run: str, every: int = 31) -> str:
    """The lower-cased run, or the run without one code point where the hash of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of all documents. Counted in the tasks first: per text, then over texts."""

    def run(batches):
        import pyarrow as pa

        def table(counts):
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in Counter(RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                    if len(word) >= shortest:
                        word = variant(doc, word)
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) >= COUNTED:
                    yield table(counts)
                    counts = Counter()
        if counts:
            yield table(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words. State 0 is the initial one.

    `next[s]` maps a symbol to (state, words of s that come before those through it);
    `size[s]` is how many words s accepts, `final[s]` whether the empty one is among them.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict] = [{}]
        self.final: list[bool] = [False]
        known: dict = {}
        path: list[tuple[int, str, int]] = []  # (parent, symbol, child) of the last word, not yet minimised
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            self._settle(path, same, known)
            at = path[-1][2] if path else 0
            for symbol in word[same:]:
                self.next.append({})
                self.final.append(False)
                path.append((at, symbol, len(self.next) - 1))
                self.next[at][symbol] = at = len(self.next) - 1
            self.final[at] = True
            last = word
        self._settle(path, 0, known)
        self._number()

    def _settle(self, path, keep, known) -> None:
        """Replace what will not change any more by states that accept the same."""
        while len(path) > keep:
            parent, symbol, child = path.pop()
            kind = (self.final[child], *self.next[child].items())
            self.next[parent][symbol] = known.setdefault(kind, child)

    def _number(self) -> None:
        self.size: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for t in self.next[s].values() if t not in self.size]
            if todo:
                stack += todo
                continue
            stack.pop()
            if s not in self.size:
                n, numbered = int(self.final[s]), {}
                for symbol, t in self.next[s].items():
                    numbered[symbol] = (t, n)
                    n += self.size[t]
                self.size[s] = n
                self.next[s] = _Numbered(numbered)


class _Numbered(dict):
    """Transitions with the number of words before each; as values only the states, for the walk that numbers them."""

    def values(self):
        return [t for t, _ in super().values()]


def composed(a: Acceptor, below: int | None = None, deep: bool = True):
    """Pairs (i, j), i before or after j, of words whose first difference is one edit; each pair once.

    `below` bounds the symbols behind the edit. Without `deep` only edits at the
    initial state count.
    """
    tables = a.next
    before = [(0, 0)]  # not edited: the same state and number for both words
    while before:
        s, i = before.pop()
        moves = list(dict.items(tables[s]))
        edited = []  # (state, number, state, number, symbols left behind the edit)
        for k, (x, (p, m)) in enumerate(moves):
            if deep and a.size[p] > 1:
                before.append((p, i + m))
            for _, (q, o) in moves[k + 1 :]:  # x replaced
                edited.append((p, i + m, q, i + o, 0))
            # x inserted into the left word: the right one goes on from s, with another symbol than x, or ends.
            if a.final[p] and a.final[s]:
                yield i + m, i
            for y, (q, o) in moves:
                if y != x and y in tables[p] and below != 0:
                    t, n = tables[p][y]
                    edited.append((t, i + m + n, q, i + o, 1))
        while edited:
            p, i1, q, i2, behind = edited.pop()
            if a.final[p] and a.final[q]:
                yield i1, i2
            if below is None or behind < below:
                left, right = tables[p], tables[q]
                if len(right) < len(left):
                    edited += [(left[y][0], i1 + left[y][1], t, i2 + n, behind + 1) for y, (t, n) in dict.items(right) if y in left]
                else:
                    edited += [(t, i1 + n, right[y][0], i2 + right[y][1], behind + 1) for y, (t, n) in dict.items(left) if y in right]


NEAR = "word string, n_near bigint, form_n bigint, form string"


def near_in_part(part: str, words: list[str], counts: list[int]):
    """(word, near words, largest count among them, its first holder) of a part, given its words in order.

    A part's name is its direction, the kind and what its words share: '>' or '<' for
    words forwards or backwards, '=' for all that lies behind, '!' for edits there alone.
    """
    backwards, deep, shared = part[0] == "<", part[1] == "=", int(part[2 : part.index(":")])
    a = Acceptor([w[shared:] for w in words])
    plain = [w[::-1] for w in words] if backwards else words
    near, best = [0] * len(words), [-1] * len(words)

    def offer(i: int, j: int) -> None:
        near[i] += 1
        k = best[i]
        if k < 0 or counts[j] > counts[k] or (counts[j] == counts[k] and plain[j] < plain[k]):
            best[i] = j

    for i, j in composed(a, PREFIX - 1 if backwards else None, deep):
        if not backwards or plain[i][:PREFIX] != plain[j][:PREFIX]:
            offer(i, j)
            offer(j, i)
    for i, n in enumerate(near):
        if n:
            yield plain[i], n, counts[best[i]], plain[best[i]]


def _compose(parts: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())

        def table(part, words, counts):
            rows = list(near_in_part(part, words, counts))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["word", "n_near", "form_n", "form"])

        part, words, counts = None, [], []
        for batch in scan.sliced(batches, 10_000):
            for p, w, n in zip(*[batch.column(c).to_pylist() for c in ("part", "read", "n")]):
                if p != part:
                    if len(words) > 1:
                        yield table(part, words, counts)
                    part, words, counts = p, [], []
                words.append(w)
                counts.append(n)
        if len(words) > 1:
            yield table(part, words, counts)

    return parts.repartition("part").sortWithinPartitions("part", "read").mapInArrow(run, NEAR)


def _name(direction: str, kind: str, depth: int, shared) -> F.Column:
    return F.concat(F.lit(f"{direction}{kind}{depth}:"), shared)


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, form_n, form): how many words are one edit away, and the most frequent of them. words: (word, n), distinct."""
    found = []
    for direction, read in ((">", F.col("word")), ("<", F.reverse("word"))):
        rows, depth = words.select(read.alias("read"), "n"), PREFIX
        while rows is not None:
            keyed = rows.withColumn("part", _name(direction, "=", depth, F.substring("read", 1, depth)))
            sizes = keyed.groupBy("part").agg(F.count("*").alias("held")).where(F.col("held") > part_words)
            large = written(sizes.select("part"), "large-parts")
            if large.limit(1).count() == 0:
                found.append(keyed)
                break
            found.append(keyed.join(large, "part", "left_anti"))
            rows = written(keyed.join(large, "part", "left_semi").select("read", "n"), "large-words")
            # An edit at the state itself: what follows it is the same in both words.
            rest = lambda skipped, at=depth: F.concat_ws(" ", F.substring("read", 1, at), F.substring(F.col("read"), F.lit(at + skipped + 1), F.length("read")))
            edges = [rows.withColumn("part", _name(direction, "!", depth, rest(k))) for k in (0, 1)]
            found.append(edges[0].unionByName(edges[1].where(F.length("read") > depth)))
            rows, depth = rows.where(F.length("read") > depth), depth + 1
    pairs = _compose(_union(found))
    first = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("first")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.m")).alias("form_n"), "first.form")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Ways double each round, and counts grow tenfold a step, so rounds are few."""
    ways = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = written(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ways")
        if ways.where("moved").limit(1).count() == 0:
            return ways.select("word", "root")
        ways = ways.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n)."""
    near = near_words(words, part_words)
    enough = F.col("form_n") >= ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    known = written(known, "forms")
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_query(docs: DataFrame) -> DataFrame:
    words = written(word_counts(docs).where(F.col("n") >= MIN_COUNT), "words")
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
