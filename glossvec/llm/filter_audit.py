"""Which of several filters removes what: every order of application, and each filter's Shapley value.

A document is reduced to the set of filters that it fails, one bit each. What a
part of the corpus (a source) loses to any coalition of filters then depends on
how many of its documents fail which set: at most 32 numbers for five filters,
so the corpus is read once and everything after is as small as the parts are many.

* Removal game. The value of a coalition is what its filters remove together.
* Potential. P of no filter is 0; P(S) is (value(S) + sum of P(S without i)) / |S|
  (Hart and Mas-Colell). A filter's Shapley value is P(all) - P(all without it).
  Potentials are kept as 60 P, which is whole for up to five filters.
* Steps. In an order, a filter removes value(filters so far with it) - value(those
  before it).

A filter that looks at the whole table (a text met under a smaller id) is found by
one aggregation per text hash. A text with very many copies is dealt over tasks.

Defined results: a null text is empty; a null source is the part ''; a row without
an id is identical to no smaller one and lends its text to no other; rows that
repeat an id with the same text are all first or all not; of several labels of a
document any 1 counts; a part without labels loses 0 labelled documents; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import hot_join, text_of, written

#: The filters, in the order of their bits.
LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Potentials are multiples of 1/60: the least common multiple of 1 to 5.
SCALE = 60
KINDS = ("n", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    # What is between words is trimmed off the ends first, so that a split leaves no empty word.
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    made = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.transform(F.array(made), lambda m: (
        F.when(m["n"] < 200, _bit("A")).otherwise(0)
        + F.when(100 * m["d"] < 50 * m["n"], _bit("B")).otherwise(0)
        + F.when(100 * capitals > 2 * F.length(text), _bit("C")).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), _bit("D")).otherwise(0)))[0]


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of `mask`, and how many of those have which label."""
    text = text_of()
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("sha"), text_failures(text).alias("mask"))
    slim = written(own.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"]), "audit")
    groups = written(slim.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1"), "audit-copies")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    later = hot_join(slim, groups, ["sha"], "copies", total).where("doc_id > first")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    # A later copy moves from its mask to the one with the bit of E.
    whole, moved = counted(slim), counted(later)
    out = whole.unionByName(moved.select("part", "mask", *[(-F.col(k)).alias(k) for k in KINDS]))
    out = out.unionByName(moved.withColumn("mask", F.col("mask").bitwiseOR(_bit("E"))))
    return out.groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in KINDS])


def coalition_values(failed: DataFrame) -> DataFrame:
    """(part, all, value, potential): rows in all, arrays over the coalitions by bits, the values as structs of KINDS."""
    met = failed.select("part", "mask", *KINDS, F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1))).alias("coalition"))
    hit = (F.col("mask").bitwiseAND(F.col("coalition"))) != 0
    sums = met.groupBy("part", "coalition").agg(F.sum("n").alias("all"), *[F.sum(F.when(hit, F.col(k)).otherwise(0)).alias(k) for k in KINDS])
    games = sums.groupBy("part").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct("coalition", *KINDS))).alias("value"))
    return games.withColumn("potential", potentials(F.transform("value", lambda v: v["n"])))


def potentials(values: Column) -> Column:
    """60 times the potential of every coalition, from the values by bits. Coalitions without one filter have smaller numbers, so one pass builds all."""

    def extend(known: Column, s: Column) -> Column:
        inside = [s.bitwiseAND(1 << i) != 0 for i in range(len(LETTERS))]
        rest = sum((F.when(here, F.get(known, s.bitwiseXOR(1 << i))).otherwise(0) for i, here in enumerate(inside)), F.lit(0).cast("bigint"))
        return F.concat(known, F.array(F.expr("CAST(0 AS bigint)") + ((SCALE * F.get(values, s) + rest) / F.bit_count(s)).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SUBSETS - 1)), F.array(F.lit(0).cast("bigint")), extend)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order and step, with what the step's filter does there."""
    games = coalition_values(failures(docs, labels, part))
    steps = games.select("*", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), _bit(x)).otherwise(0) for x in LETTERS), F.lit(0))
    steps = steps.withColumn("bit", bits(letter)).withColumn("before", bits(before))
    value = lambda coalition, kind="n": F.get("value", coalition)[kind]
    after, grand = F.col("before") + F.col("bit"), SUBSETS - 1
    removed = value(after) - value(F.col("before"))
    share = (F.get("potential", F.lit(grand)) - F.get("potential", grand - F.col("bit"))) * (len(ORDERS) // SCALE)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("all") - value(after)).alias("kept"), removed.alias("removed"), (value(F.col("bit")) - removed).alias("redundant"),
        (value(F.lit(grand)) - value(grand - F.col("bit"))).alias("unique_fails"),
        (value(after, "good") - value(F.col("before"), "good")).alias("good_lost"),
        (value(after, "toxic") - value(F.col("before"), "toxic")).alias("toxic_lost"),
        share.alias("shapley"))


def audit_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))


def audit_sql() -> str:
    """The same by applying every order to the counted sets of failed filters; the Shapley value by its definition."""
    words = rf"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    bits = " + ".join(f"CASE WHEN contains({{0}}, '{x}') THEN {_bit(x)} ELSE 0 END" for x in LETTERS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, {words} AS w FROM d),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w.w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w.w)) < 50 * len(w.w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first.first THEN 16 ELSE 0 END) AS mask
  FROM w JOIN first ON w.t = first.t LEFT JOIN marks ON w.doc_id = marks.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, k::INT AS step, {bits.format('o[k]')} AS bit, {bits.format('o[1:k - 1]')} AS before FROM orders, range(1, 6) r(k)),
r AS (SELECT part, o AS filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
