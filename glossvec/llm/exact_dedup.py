"""Exact duplicates by merging sorted runs of digests along a tree.

Every input partition makes a run: its digests, each with the row that would
stay. Runs meet in rounds of FAN_IN neighbours; a round merges runs by digest
and keeps the better row of each. The winners then go down the same tree, so
that a run asks only about digests of its own, and a group that holds a third of
all rows never meets in one place.

Defined results: a null text is empty; texts that are equal without their blanks
form one group, empty ones too; the longest text stays, then the smallest id,
null ids last; repeated rows tie and one of them stays by a hash of the row, all
of them if nothing tells them apart; an empty table gives an empty result; extra
columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import text_of, without_blanks, written
from glossvec.plans.joins import fits_broadcast

#: Runs that meet in one merge.
FAN_IN = 16

#: A group is verified by digest, length and a second, independent hash.
GROUP = ["digest", "size", "check"]


def _better() -> Column:
    """Orders rows of a group: the smallest is the one that stays."""
    return F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tie"))


def digest_rows(docs: DataFrame, text: str, key: str, keep: list[str]) -> DataFrame:
    """(keep..., id, run, digest, size, check, chars, tie), one per row."""
    plain = docs.withColumn("__plain", without_blanks(text_of(text)))
    return plain.select(
        *keep,
        F.col(key).alias("id"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(F.col("__plain"), 256)).alias("digest"),
        F.octet_length("__plain").alias("size"),
        F.xxhash64("__plain").alias("check"),
        F.length(text_of(text)).alias("chars"),
        F.xxhash64(*docs.columns).alias("tie"),
    )


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = FAN_IN) -> list[DataFrame]:
    """Levels of the tree: (run, group, best, n), the first per input run and the last one run of all.

    Each level is sorted by digest within a run, and a merge reads `fan_in` runs
    of the level below. What moves is one slim row per digest and run.
    """
    level = runs.groupBy("run", *GROUP).agg(F.min(_better()).alias("best"), F.count("*").alias("n"))
    levels = [written(level.sortWithinPartitions("run", "digest"), "run0")]
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        up = levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
        merged = up.groupBy("run", *GROUP).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(written(merged.sortWithinPartitions("run", "digest"), f"run{len(levels)}"))
    return levels


def winners_by_run(levels: list[DataFrame], fan_in: int = FAN_IN) -> DataFrame:
    """(run, group, best, n) of the whole corpus for each digest of each input run."""
    found = levels[-1]
    for below in reversed(levels[:-1]):
        asked = below.select("run", *GROUP).withColumn("up", F.expr(f"run div {fan_in}").cast("int"))
        found = asked.join(found.withColumnRenamed("run", "up"), ["up", *GROUP]).drop("up")
    return found


def _judged(docs: DataFrame, text: str, key: str, keep: list[Column], fan_in: int = FAN_IN) -> DataFrame:
    """(keep..., id, digest, chars, tie, best, n, stays) for each row of `docs`; the text is read once, then only digests move."""
    rows = written(digest_rows(docs, text, key, keep), "digests")
    last = rows.agg(F.max("run").alias("run")).first()["run"]
    found = winners_by_run(merge_runs(rows, (last or 0) + 1, fan_in), fan_in)
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.chars")) & (F.col("tie") == F.col("best.tie"))
    return rows.join(found, ["run", *GROUP]).withColumn("stays", stays)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` (or its columns `keep`) with keep_id, group_size, kept and text_sha256."""
    cols = docs.columns if keep is None else keep
    met = _judged(docs, text, key, [F.col(c).alias(f"in_{c}") for c in cols], fan_in)
    added = {"keep_id": F.col("best.id"), "group_size": F.col("n"), "kept": F.col("stays"), "text_sha256": F.lower(F.hex("digest"))}
    return met.select(*[F.col(f"in_{c}").alias(c) for c in cols if c not in added], *[v.alias(c) for c, v in added.items()])


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with the row that stays of each group. Ids and hashes are sent, texts are not.

    What goes is told by id, text, length and the hash of the whole row: a
    repeated or null id may have a row that stays and one that goes.
    """
    told = ["id", "digest", "chars", "tie"]
    gone = written(_judged(docs, text, key, []).where("NOT stays").select(*[F.col(c).alias(f"__gone_{c}") for c in told]).distinct(), "gone")
    own = docs.withColumns({
        "__id": F.col(key),
        "__digest": F.unhex(F.sha2(without_blanks(text_of(text)), 256)),
        "__chars": F.length(text_of(text)),
        "__tie": F.xxhash64(*docs.columns),
    })
    side = F.broadcast(gone) if fits_broadcast(gone) else gone
    same = [F.col(f"__{c}").eqNullSafe(F.col(f"__gone_{c}")) for c in told]
    return own.join(side, same, "left_anti").select(*docs.columns)


def exact_query(docs: DataFrame) -> DataFrame:
    return exact_groups(docs.select("doc_id", "text"), keep=["doc_id"])


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (SELECT text_sha256, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN k USING (text_sha256)
"""
