"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import hot_join, written


def _count(df: DataFrame) -> int:
    return df.count()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in `links` (a, b): comp is the smallest id it reaches.

    Components are contracted: each hooks to its smallest neighbour, chains of
    hooks are halved until all point at roots, and links between what is left go
    into the next round. Minima are pre-aggregated, and the relabelling join
    broadcasts the labels that many ids share, so a hub of any degree is no group
    of one task. Every round writes its tables, so nothing is traced back.
    """
    ends = links.select("a", "b").where("a <> b")
    ids = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))).distinct()
    labels = None
    edges = written(ends.distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("parent"))
        hooks = written(hooks, "hooks")
        while True:
            up = hooks.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            moved = hooks.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("new"), "parent")
            moved = written(moved, "hooks")
            hooks = moved.select("child", F.col("new").alias("parent"))
            if moved.where("new <> parent").limit(1).count() == 0:
                break
        if labels is None:
            labels = hooks.select(F.col("child").alias("id"), F.col("parent").alias("comp"))
        else:
            shares = labels.groupBy("comp").agg(F.count("*").alias("n"))
            new = shares.join(hooks, shares.comp == hooks.child).select("comp", "n", "parent")
            total = labels.count()
            moved = hot_join(labels.join(new.select("comp"), "comp", "left_semi"), new, ["comp"], "n", total).select("id", F.col("parent").alias("comp"))
            labels = written(moved.unionByName(labels.join(new.select("comp"), "comp", "left_anti").select("id", "comp")), "labels")
        named = hooks.select(F.col("child").alias("a"), F.col("parent").alias("pa"))
        left = edges.join(named, "a").join(named.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b")
        edges = written(left.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
        if edges.limit(1).count() == 0:
            return labels
