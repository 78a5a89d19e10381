"""Small tables with every odd case, and brute-force answers in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")
BLANK = re.compile(r"[\x20\x09-\x0d]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns with names that operators use inside.
CLASHING = ["n", "id", "row", "run", "digest", "kept", "score", "n_words", "h", "g", "key", "size", "spans", "ids", "votes", "length", "piece", "best", "hub", "tasks"]


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def texts():
    """(doc_id, text): copies, near copies, shared lines and passages, nulls, empties, a long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(20, 160)) for _ in range(40)]
    out = list(enumerate(base))
    for k in range(12):
        out.append((100 + k, base[k % 5] + " " * (k % 3)))
        words = base[5 + k % 4].split()
        words[k % len(words)] = f"x{k}"
        out.append((200 + k, " ".join(words)))
    passage = sentence(rng, 120, 5000)
    line = "A shared line that is long enough to be counted by all"
    for k in range(7):
        out.append((300 + k, f"{base[20 + k]}\n  {line.upper() if k % 2 else line}\t\n{passage[k:]}\n{sentence(rng, 30)}"))
    many = " ".join(f"rep{i % 9}" for i in range(80))
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "One"), (405, "é" * 500), (406, "ab" * 900), (407, many), (408, many.replace("rep0", "RÉP0"))]
    out += [(409, "## $$ %% " * 30), (410, "LOUD!! " * 40), (411, sentence(rng, 6000, 3000) + "\n\n" + sentence(rng, 10)), (412, "a\x00b   c \U0001f600 <|endoftext|> <s>")]
    out += [(None, base[3]), (None, None), (17, base[17]), (17, base[17]), (18, base[2] + " other")]
    return out


STEMS = "river table window garden perhaps morning letter market summer winter doctor number people mountain evening brother animal bridge corner danger family gentle hunger island".split()


def prose(rng, n):
    """Sentences of 8 words that the quality rules keep."""
    words = [rng.choice(STEMS)[: rng.randrange(3, 9)] + rng.choice(["", "s", "ed", "er"]) for _ in range(n)]
    return " ".join((w.capitalize() if i % 8 == 0 else w) + ("." if i % 8 == 7 else "") for i, w in enumerate(words))


def prose_texts():
    """(doc_id, text) of prose: exact and near copies, passages of over fifty words, beside junk, nulls and repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    out = list(enumerate(base))
    for k in range(10):
        out.append((100 + k, base[k % 4] + " " * (k % 3)))
        words = base[5 + k % 4].split()
        words[k % len(words)] = f"changed{k}"
        out.append((200 + k, " ".join(words)))
    for k in range(12):
        passage = prose(rng, 51 + k)
        out += [(300 + 10 * k + j, f"{prose(rng, 90)} {passage} {prose(rng, 70)}") for j in range(2 + k % 3)]
    out += [(500 + k, "## $$ %% " * 30) for k in range(3)] + [(600, None), (601, ""), (602, " \t\n"), (603, "One."), (604, prose(rng, 3000))]
    return out + [(None, base[3]), (None, prose(rng, 80)), (None, None), (17, base[17]), (17, base[17]), (18, prose(rng, 90))]


def documents(spark, rows=None, clashing=False):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(d, t, "en" if (d or 0) % 3 else None, f"src{(d or 0) % 4}", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else df


def empty(spark):
    return documents(spark, [])


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_groups(rows, width):
    """[(doc_id, size, component)] by comparing all pairs; rows that share an id are one document."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeated_bytes(rows, length):
    """[(bytes, which of them go)] by counting every string."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((b, gone))
    return out


def left_texts(rows, length):
    """Texts without repeated strings and without characters that a cut splits; null stays null."""
    cut = repeated_bytes(rows, length)
    return [None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") for (_, t), (b, gone) in zip(rows, cut)]


def cut_repeats(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] by counting every string."""
    out = []
    for (d, _), (b, gone) in zip(rows, repeated_bytes(rows, length)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {k for i, x in enumerate(windows) if seen[x] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
