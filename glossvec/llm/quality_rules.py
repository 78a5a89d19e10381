"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything runs as DataFrame and SQL expressions. One pass over the texts makes
counts, the counts make votes, and the fit needs only how often each pattern of
votes occurs: at most 3 ** len(RULES) rows, whatever the corpus.

Defined results: a null or empty text has no words and fails the base rules; a
row whose id or other columns are null is judged by its text alone; repeated
rows are judged each; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import BLANKS, WORD, bound, text_of, without_blanks, written

#: Words in a window that is looked for again in the same text.
WINDOW = 8
ITERATIONS = 25

#: name, when it votes against, when it votes for: SQL over the counts. Neither: it abstains.
RULES = (
    ("symbols", "10 * n_symbols >= n_words", "100 * n_symbols < n_words"),
    ("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars"),
    ("exclamations", "10 * n_exclamations >= 2 * n_words", "50 * n_exclamations < n_words"),
    ("capitals", "10 * n_capitals >= 3 * word_chars", "10 * n_capitals < word_chars"),
    ("full_stops", "50 * n_stops < n_words", "25 * n_stops >= n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines", "20 * n_dup_lines < n_lines"),
    ("distinct_words", "10 * n_distinct < 3 * n_words AND n_words <= 2000", "2 * n_distinct > n_words"),
    ("word_length", "2 * word_chars < 5 * n_words OR word_chars > 7 * n_words", "word_chars > 4 * n_words AND word_chars < 6 * n_words"),
    ("line_length", "n_words > 300 * n_lines", "n_words < 200 * n_lines"),
    ("symbol_share", "25 * n_symbols >= word_chars", "200 * n_symbols < word_chars"),
)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"

#: Dirichlet priors of a rule's vote (against, abstain, for) in bad and in good texts. A rule seldom errs on a good text.
PRIOR = ((0.10, 0.20, 0.70), (0.01, 0.10, 0.89))
#: Weight of the priors as a share of all rows, and the share of good texts to start from.
PRIOR_SHARE = (0.1, 1.0)
GOOD_SHARE = 0.85


def _words(text: Column) -> Column:
    """Maximal runs of other characters than blanks."""
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _length_without(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def _covered(starts: Column, span: int) -> Column:
    """Positions covered by spans of one length at ascending starts."""
    step = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + span - F.greatest(s.cast("bigint"), acc["end"])).alias("n"), (s + F.lit(span).cast("bigint")).alias("end")
        ),
    )
    return step["n"]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more.

    Windows are compared by hash within one text. A text in which all windows
    differ, as nearly all do, stops at the distinct count; only others are sorted.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def repeated(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = bound(placed, lambda p: F.transform(p, lambda x, i: F.when(
            (x["h"] == F.get(p, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(p, F.greatest(i - 1, F.lit(0)))["h"])), x["i"])))
        return _covered(F.sort_array(F.filter(same, lambda x: x.isNotNull())), WINDOW)

    many = bound(bound(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(repeated(w)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(many)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    made = F.struct(
        bound(_words(t), lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), _repeat_words(w).alias("n_repeat_words"))).alias("__w"),
        bound(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("__l"),
        F.length(without_blanks(t)).cast("bigint").alias("__word_chars"),
        _length_without(t, "#*$%&|<>").alias("__n_symbols"),
        _length_without(t, "A-Z").alias("__n_capitals"),
        _length_without(t, r"\p{L}").alias("__n_letters"),
        _length_without(t, "!").alias("__n_exclamations"),
        _length_without(t, ".").alias("__n_stops"),
    )
    # A generator is evaluated once per row; a struct would be taken apart and its fields evaluated at every use.
    # "__" keeps the counts apart from input columns of the same names.
    at = {c: f"__w.{c}" for c in ("n_words", "n_distinct", "n_repeat_words")} | {c: f"__l.{c}" for c in ("n_lines", "n_dup_lines")}
    return docs.select("*", F.inline(F.array(made))).withColumns({f"__{c}": F.col(at.get(c, f"__{c}")) for c in COUNTS}).drop("__w", "__l")


def _prefixed(sql: str) -> str:
    import re

    return re.sub(r"\b(n_[a-z]+(?:_[a-z]+)?|word_chars)\b", r"__\1", sql)


def votes_column() -> Column:
    """One character a rule: - against, + for, 0 abstains."""
    return F.concat(*[F.expr(f"CASE WHEN {_prefixed(bad)} THEN '-' WHEN {_prefixed(good)} THEN '+' ELSE '0' END") for _, bad, good in RULES])


def _posterior_sql(params: list, votes: str = "votes") -> str:
    """SQL of the probability of a good text; params: log prior of good, of bad, then logs by class, rule and vote."""
    def score(y: int) -> str:
        terms = [str(params[y])]
        for j in range(len(RULES)):
            a = 2 + (y * len(RULES) + j) * 3
            terms.append(f"CASE substr({votes}, {j + 1}, 1) WHEN '-' THEN {params[a]} WHEN '0' THEN {params[a + 1]} ELSE {params[a + 2]} END")
        return " + ".join(terms)

    return f"1 / (1 + exp(({score(0)}) - ({score(1)})))"


def _start() -> list[float]:
    return [math.log(1 - GOOD_SHARE), math.log(GOOD_SHARE)] + [math.log(p) for y in (0, 1) for _ in RULES for p in PRIOR[y]]


def _sums_sql(post: str) -> list[str]:
    """Expected counts: rows, good rows, then by class, rule and vote."""
    out = ["sum(n)", f"sum(n * ({post}))"]
    for y in (0, 1):
        w = f"({post})" if y else f"(1 - ({post}))"
        for j in range(len(RULES)):
            out += [f"sum(CASE WHEN substr(votes, {j + 1}, 1) = '{v}' THEN n * {w} ELSE 0 END)" for v in "-0+"]
    return out


def _posterior(rows: DataFrame, params: list[float], votes: str, name: str) -> DataFrame:
    """Add the posterior. The parameters are one array value, so one plan and its compiled code serve every iteration."""
    p, rules = F.array(*[F.lit(x) for x in params]), len(RULES)

    def score(y: int) -> Column:
        terms = F.transform(F.split(F.col(votes), ""), lambda v, j: F.get(p, 2 + (y * rules + j) * 3 + F.instr(F.lit("-0+"), v) - 1))
        return F.aggregate(terms, F.get(p, F.lit(y)), lambda acc, x: acc + x)

    return rows.withColumn(name, 1 / (1 + F.exp(score(0) - score(1))))


def fit_label_model(patterns: DataFrame, iterations: int = ITERATIONS) -> list[float]:
    """Parameters of the label model from (votes, n), by expectation-maximisation.

    Class-conditional votes, abstentions included, with Dirichlet priors. Each
    step is one aggregate over the patterns, at most 3 ** rules rows, and
    returns one row per rule and vote.
    """
    params = _start()
    for _ in range(iterations):
        scored = _posterior(patterns, params, "votes", "p")
        seen = scored.select("n", "p", F.posexplode(F.split("votes", "")).alias("j", "v"))
        sums = {(r["j"], r["v"]): (r["bad"], r["good"]) for r in seen.groupBy("j", "v").agg(
            F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"), F.sum(F.col("n") * F.col("p")).alias("good")).collect()}
        if not sums:
            return params
        bad, good = (sum(sums.get((0, v), (0.0, 0.0))[y] for v in "-0+") for y in (0, 1))
        share = (good + 1) / (good + bad + 2)
        new = [math.log(1 - share), math.log(share)]
        for y in (0, 1):
            weight = PRIOR_SHARE[y] * (good + bad)
            for j in range(len(RULES)):
                seen_by = [sums.get((j, v), (0.0, 0.0))[y] for v in "-0+"]
                new += [math.log((seen_by[v] + weight * PRIOR[y][v]) / (sum(seen_by) + weight)) for v in range(3)]
        params = new
    return params


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """`docs` (or its columns `keep`) with counts, votes, posterior, base_failed and kept.

    The counted rows are written once: the fit reads only their votes, the
    verdict reads them again. `kept` needs the base rules and a posterior of 0.5.
    Columns of `docs` that have the name of an added one are replaced.
    """
    cols = docs.columns if keep is None else keep
    counted = written(with_counts(docs, text).select(*cols, *[f"__{c}" for c in COUNTS]), "quality").withColumn("__votes", votes_column())
    patterns = written(counted.groupBy(F.col("__votes").alias("votes")).agg(F.count("*").alias("n")), "votes")
    params = fit_label_model(patterns, iterations)
    judged = _posterior(counted, params, "__votes", "__posterior")
    judged = judged.withColumn("__base_failed", F.expr(_prefixed(BASE_FAILED)))
    judged = judged.withColumn("__kept", ~F.col("__base_failed") & (F.col("__posterior") >= 0.5))
    added = [*COUNTS, "votes", "posterior", "base_failed", "kept"]
    return judged.select(*[c for c in cols if c not in added], *[F.col(f"__{c}").alias(c) for c in added])


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_capitals", "n_letters", "n_exclamations", "n_stops",
)
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes")


def quality_query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), keep=["doc_id"]).select("doc_id", *RETURNED)


def quality_sql(iterations: int = ITERATIONS) -> str:
    """The same judgement for DuckDB: the fit as a recursive query over the vote patterns."""
    params = [f"p[{i + 1}]" for i in range(2 + 6 * len(RULES))]
    start = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _start()) + "]"
    s = [f"s[{i + 1}]" for i in range(2 + 6 * len(RULES))]
    new = [f"ln(1 - ({s[1]} + 1) / ({s[0]} + 2))", f"ln(({s[1]} + 1) / ({s[0]} + 2))"]
    for y in (0, 1):
        for j in range(len(RULES)):
            a = 2 + (y * len(RULES) + j) * 3
            rows = f"({s[a]} + {s[a + 1]} + {s[a + 2]} + {PRIOR_SHARE[y]}::DOUBLE * {s[0]})"
            new += [f"ln(({s[a + v]} + {PRIOR_SHARE[y]}::DOUBLE * {s[0]} * {PRIOR[y][v]}::DOUBLE) / {rows})" for v in range(3)]
    votes = " || ".join(f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END" for _, bad, good in RULES)
    line = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS MATERIALIZED (
  SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{line}')) AS l FROM t
), g AS (
  SELECT r, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})
), rep AS (
  SELECT r, count(DISTINCT k) AS n FROM (
    SELECT r, unnest(range(i, i + {WINDOW})) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c >= 2) GROUP BY r
), c AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_distinct(w))::BIGINT AS n_distinct, len(l)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclamations, length(regexp_replace(text, '[^.]+', '', 'g')) AS n_stops
  FROM w LEFT JOIN rep USING (r)
), v AS MATERIALIZED (SELECT *, {votes} AS votes FROM c),
patterns AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
em(i, p) AS (
  SELECT 0, {start}
  UNION ALL
  SELECT i + 1, [{', '.join(new)}] FROM (
    SELECT i, [{', '.join(_sums_sql('q'))}] AS s FROM (SELECT i, votes, n, {_posterior_sql(params)} AS q FROM em, patterns WHERE i < {iterations}) GROUP BY i)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND {_posterior_sql(params)} >= 0.5 AS kept, votes
FROM v, (SELECT p FROM em WHERE i = {iterations})
"""
