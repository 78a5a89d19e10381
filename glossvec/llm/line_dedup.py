"""Lines that many documents share, dropped from all but one of them.

Lines are exploded, normalised and hashed; the distinct documents of each hash
are counted; hashes over the threshold go back to their documents, whose texts
are put together again by position.

Defined results: a null or empty text is one empty line; rows with the same id
count as one document and each gives a row; a null id counts as one document
below all others; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import BLANKS, ascii_lower, bound, hot_join, text_of, written

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, by position."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.trim(line, F.lit(BLANKS)))


def _hashes(text: Column, min_chars: int) -> Column:
    """128 bits of every long enough line, by position; others null."""
    return F.transform(line_keys(text), lambda k: F.when(
        F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))


def drop_shared_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """`docs` with `text` rid of shared lines, and the counts n_lines and n_dropped.

    A line keyed by at least `min_chars` characters that at least `min_documents`
    documents hold stays only in the largest `key` holding it. A document sends
    each of its distinct hashes once, so a line's group holds one slim row per
    document, and it is counted before and after the shuffle. What goes back are
    positions, not texts.
    """
    # Rows that share an id are told apart by a hash of the text: positions are theirs, the document is one.
    known = docs.withColumn("__row", F.xxhash64(text_of(text)))
    hashed = known.select(F.col(key).alias("__id"), F.col("__row").alias("__of"), _hashes(text_of(text), min_chars).alias("hs"))
    each = hashed.select("__id", "__of", F.posexplode("hs").alias("pos", "l")).where("l is not null").select("__id", "__of", "pos", "l.h", "l.g")
    lines = written(each.groupBy("h", "g", "__id", "__of").agg(F.collect_set("pos").alias("pos")), "lines")
    holders = lines.groupBy("h", "g", "__id").agg(F.count("*").alias("rows"))
    shared = holders.groupBy("h", "g").agg(F.count("*").alias("documents"), F.sum("rows").alias("n"), F.max("__id").alias("holder"))
    shared = written(shared.where(F.col("documents") >= min_documents).drop("documents"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    dropped = hot_join(lines, shared, ["h", "g"], "n", total).where(~F.col("__id").eqNullSafe(F.col("holder")))
    dropped = dropped.groupBy("__id", "__of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("__drop"))
    met = known.join(dropped, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__of")), "left").drop("__id", "__of", "__row")
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    cut = F.when(F.size(drop) == 0, text_of(text)).otherwise(F.concat_ws("\n", bound(F.split(text_of(text), "\n"), lambda x: bound(drop, lambda d: _without(x, d)))))
    return met.select(
        *[c for c in docs.columns if c not in (text, "n_lines", "n_dropped")],
        F.size(F.split(text_of(text), "\n")).cast("bigint").alias("n_lines"), F.size(drop).cast("bigint").alias("n_dropped"), cut.alias(text),
    )


def _without(items: Column, drop: Column) -> Column:
    """Items but those at the ascending positions `drop`: the stretches between them, in one pass."""
    ends = F.concat(drop, F.array(F.size(items)))
    return bound(ends, lambda e: F.flatten(F.transform(e, lambda end, i: bound(
        F.when(i == 0, F.lit(0)).otherwise(F.get(e, F.greatest(i - 1, F.lit(0))) + 1), lambda start: F.slice(items, start + 1, end - start)))))


def lines_query(docs: DataFrame) -> DataFrame:
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def lines_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (SELECT doc_id, pos, line, translate(trim(line, {blanks}), '{upper}', '{upper.lower()}') AS k FROM l),
s AS (SELECT k, max(doc_id) AS holder FROM k WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
j AS (SELECT k.*, holder IS NOT NULL AND holder <> doc_id AS drop FROM k LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
