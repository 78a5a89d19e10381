"""An inverted-file index of vectors: cells around k-means centres, stored partitioned by cell.

Centres are fitted on all vectors; every vector is filed, in the cell of its nearest
centre. A cell is stored as blocks of bounded size, so a cell with a third of all
vectors is many blocks, not one group. A search scores each query against its
`probes` nearest cells and reads no cell that no query probes: a task holds some of
the queries, and the vectors read pass through it cell by cell. How many cells a
recall needs depends on how clustered the vectors are, so it is measured on all
vectors against the exact search, not assumed.

What travels to the tasks or to the driver is bounded by MAX_CELLS centres.
"""

from __future__ import annotations

import itertools
import math
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossvec.operators import recall
from glossvec.operators.screening import Best
from glossvec.plans.joins import task_count
from glossvec.plans.lookups import as_list, list_parts
from glossvec.session import ensure_checkpoint_dir

MAX_CELLS = 4096
#: Vectors of a task that fits centres, and the fewest queries for which a task of a search is worth the vectors sent to it.
FIT_ROWS, LEAST_ASKED = 10_000, 256
#: Queries that are routed to their cells at a time.
ROUTED_AT_A_TIME = 2048

_BLOCKS = "part bigint, b_ids array<bigint>, b_flat array<double>, n bigint, centre array<double>, bucket int"


def _cell_order(v: np.ndarray, centres: np.ndarray, nearest: int) -> np.ndarray:
    """Places of the `nearest` centres of every row of v, nearest first, ties by place."""
    gap = (centres * centres).sum(1)[None, :] - 2.0 * v @ centres.T
    return np.argsort(gap, axis=1, kind="stable")[:, :nearest]


def _routed(rows: DataFrame, key: str, names: np.ndarray, centres: np.ndarray, nearest: int) -> DataFrame:
    """(key, v, bucket): every row once for each of its `nearest` cells."""
    shipped = rows.sparkSession.sparkContext.broadcast((names, centres))

    def route(batches):
        names, centres = shipped.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cells = names[_cell_order(v, centres, nearest)]
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.ravel(), pa.int32())], [key, "v", "bucket"])

    whole = F.col("v").isNotNull() & (F.size("v") == centres.shape[1])
    return rows.where(whole).select(key, "v").mapInArrow(route, f"{key} bigint, v array<double>, bucket int")


@dataclass
class VectorIndex:
    """A stored index. `blocks` is (bucket, part, b_ids, b_flat, n, centre), partitioned by bucket."""

    spark: SparkSession
    path: str

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(self.path)

    @cached_property
    def cells(self) -> list:
        """(bucket, centre, subs, n) of every cell that holds a vector, at most MAX_CELLS of them."""
        return self.blocks.groupBy("bucket").agg(
            F.first("centre").alias("centre"), (F.max("part") + 1).alias("subs"), F.sum("n").alias("n")).orderBy("bucket").collect()

    @cached_property
    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([c["bucket"] for c in self.cells], np.int32), np.array([c["centre"] for c in self.cells], float)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """The k nearest of (query_id, v) among the vectors of the `probes` nearest cells: query_id, hit_id, distance, rank."""
        if not self.cells:
            return self.spark.createDataFrame([], recall._RANKED)
        asked = self._asked(queries)
        probed = self._probed(asked, probes)
        if not probed:
            return self.spark.createDataFrame([], recall._RANKED)
        width, cores = self.centres[1].shape[1], task_count(queries)
        n = asked.count()
        groups = max(1, min(-(-n // LEAST_ASKED), cores * max(1, math.ceil(n * width * 8 / recall.HELD_BYTES / cores))))
        names = _group_names(self.spark, groups)
        group = F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("query_id"), F.lit(groups)) + 1).cast("int"))
        held = asked.select(group.alias("g"), F.lit(-1).alias("bucket"), F.col("query_id").alias("id"), "v")
        read = self.blocks.where(F.col("bucket").isin(sorted(probed))).select("bucket", "b_ids", "b_flat")
        filed = read.mapInArrow(_unpacked, "bucket int, id bigint, v array<double>")
        sent = filed.select(F.explode(F.array(*[F.lit(x) for x in names])).alias("g"), "bucket", "id", "v")
        # Within a group the queries come first, then cell after cell.
        together = held.unionByName(sent).repartition(groups, "g").sortWithinPartitions("g", "bucket")
        return together.mapInArrow(self._searched(k, probes), recall._RANKED)

    def _searched(self, k: int, probes: int):
        shipped = self.spark.sparkContext.broadcast(self.centres)

        def run(batches):
            names, centres = shipped.value
            for cells in _by_group(batches):
                bucket, ids, q = next(cells)
                if bucket >= 0:  # vectors alone: no query of this group
                    for _ in cells:
                        pass
                    continue
                best, place = Best(q, "l2", k), {int(c): i for i, c in enumerate(names)}
                probed = np.zeros((len(q), len(names)), bool)
                for s in range(0, len(q), ROUTED_AT_A_TIME):
                    near = _cell_order(q[s : s + ROUTED_AT_A_TIME], centres, _held(probes, names))
                    np.put_along_axis(probed[s : s + ROUTED_AT_A_TIME], near, True, axis=1)
                for bucket, filed, b in cells:
                    best.add(filed.to_numpy(), b, np.flatnonzero(probed[:, place[bucket]]))
                rows, hits, score, rank = best.ranked(0)
                for s in range(0, len(rows), 1 << 16):
                    some = slice(s, s + (1 << 16))
                    columns = [ids.take(pa.array(rows[some])), pa.array(hits[some]), pa.array(score[some]), pa.array(rank[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "hit_id", "distance", "rank"])

        return run

    def _probed(self, asked: DataFrame, probes: int) -> dict[int, int]:
        """How many queries probe a cell, for every cell that is probed."""
        shipped = self.spark.sparkContext.broadcast(self.centres)

        def count(batches):
            names, centres = shipped.value
            n = np.zeros(len(names), np.int64)
            for batch in batches:
                v = _matrix(batch.column(0))
                for s in range(0, len(v), ROUTED_AT_A_TIME):
                    n += np.bincount(_cell_order(v[s : s + ROUTED_AT_A_TIME], centres, _held(probes, names)).ravel(), minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(names[n > 0], pa.int32()), pa.array(n[n > 0])], ["bucket", "n"])

        counts = asked.select("v").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        return {r["bucket"]: r["n"] for r in counts.collect()}

    def pairs_scored(self, queries: DataFrame, probes: int) -> int:
        """Pairs of a query and a vector that `search` scores."""
        if not self.cells:
            return 0
        filed = {c["bucket"]: c["n"] for c in self.cells}
        return sum(n * filed[bucket] for bucket, n in self._probed(self._asked(queries), probes).items())

    def probes_for(self, vectors: DataFrame, k: int = 10, target: float = 0.92, exact: DataFrame | None = None) -> int:
        """The fewest probes with which at least `target` of the exact k nearest of all vectors lie in probed cells.

        `exact` holds these (query_id, hit_id), if they are known.
        """
        if not self.cells:
            return 1
        held = vectors.where("v IS NOT NULL").select("token_id", "v")
        asked = held.withColumnRenamed("token_id", "query_id")
        exact = recall.l2_recall(asked, held, k) if exact is None else exact
        filed = self.blocks.select("bucket", F.explode("b_ids").alias("hit_id"))
        met = exact.select("query_id", "hit_id").join(filed, "hit_id").groupBy("query_id").agg(F.collect_list("bucket").alias("buckets"))
        shipped = self.spark.sparkContext.broadcast(self.centres)

        def places(batches):
            names, centres = shipped.value
            n, at = np.zeros(len(names), np.int64), np.zeros(int(names.max()) + 1, np.int64)
            at[names] = np.arange(len(names))
            for batch in batches:
                v, (values, lengths) = _matrix(batch.column(0)), list_parts(batch.column(1))
                cells, ends = at[values.to_numpy()], np.cumsum(lengths)
                for s in range(0, len(v), ROUTED_AT_A_TIME):
                    some = slice(s, min(s + ROUTED_AT_A_TIME, len(v)))
                    order = _cell_order(v[some], centres, len(names))
                    place = np.empty_like(order)
                    np.put_along_axis(place, order, np.arange(len(names))[None, :], axis=1)
                    rows = np.repeat(np.arange(len(order)), lengths[some])
                    n += np.bincount(place[rows, cells[ends[s] - lengths[s] : ends[some.stop - 1]]], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["place", "n"])

        rows = self._asked(asked).dropDuplicates(["query_id"]).join(met, "query_id").select("v", "buckets")
        counts = rows.mapInArrow(places, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
        wanted, found = math.ceil(target * sum(r["n"] for r in counts)), 0
        for r in counts:
            found += r["n"]
            if found >= max(wanted, 1):
                return r["place"] + 1
        return 1

    def _asked(self, queries: DataFrame) -> DataFrame:
        """The queries that have a vector of the width of the index."""
        whole = F.col("v").isNotNull() & (F.size("v") == self.centres[1].shape[1])
        return queries.where(whole).select("query_id", "v")


def _held(probes: int, names: np.ndarray) -> int:
    return max(1, min(probes, len(names)))


def _matrix(col) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _unpacked(batches):
    """Rows (bucket, id, v) of blocks."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, flat = batch.column(1)[r].values, batch.column(2)[r].values
            lengths = np.full(len(ids), len(flat) // max(1, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column(0)[r].as_py()), pa.int32()), ids, as_list(flat, lengths)], ["bucket", "id", "v"])


def _group_names(spark: SparkSession, groups: int) -> list[int]:
    """Numbers that a shuffle deals to as many tasks, one each."""
    tries = spark.range(0, 40 * groups + 40).select(F.col("id").cast("int").alias("g"))
    first = tries.groupBy(F.pmod(F.hash("g"), F.lit(groups)).alias("task")).agg(F.min("g").alias("g"))
    names = sorted(r["g"] for r in first.collect())
    # A task without a number would be a matter of luck alone; its group then shares a task.
    return names + [40 * groups + 40 + i for i in range(groups - len(names))]


def _by_group(batches):
    """Of rows sorted by group and cell, for each group an iterator of (bucket, ids, matrix): a run of one cell, of a batch at most; the queries, bucket -1, whole."""
    runs = _joined_queries(_runs(batches))
    for _, group in itertools.groupby(runs, key=lambda r: r[0]):
        yield (r[1:] for r in group)


def _runs(batches):
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g, bucket, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(3))
        cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(bucket) != 0)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
            yield int(g[lo]), int(bucket[lo]), batch.column(2).slice(lo, hi - lo), v[lo:hi]


def _joined_queries(runs):
    for (g, bucket), same in itertools.groupby(runs, key=lambda r: r[:2]):
        if bucket >= 0:
            yield from same
        else:
            parts = [r[2:] for r in same]
            yield g, bucket, pa.concat_arrays([i for i, _ in parts]), np.concatenate([v for _, v in parts])


def build_index(vectors: DataFrame, path: str | None = None, cells: int | None = None, seed: int = 42) -> VectorIndex:
    """Index (token_id, v) in `path`, or in a new table of the checkpoint folder.

    `cells` defaults to the square root of the number of vectors, at most MAX_CELLS.
    Rows without a vector are not filed; all vectors have one width.
    """
    spark = vectors.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/vector-index-{uuid.uuid4().hex}"
    held = vectors.where("v IS NOT NULL").select("token_id", F.col("v").cast("array<double>").alias("v"))
    n = held.count()
    if not n:
        spark.createDataFrame([], _BLOCKS).write.parquet(path)
        return VectorIndex(spark, path)
    cells = max(1, min(cells or round(math.sqrt(n)), MAX_CELLS, n))
    if cells == 1:
        centres = np.zeros((1, len(held.first()["v"])))
    else:
        # All vectors, dealt and ordered by their ids: the same centres however they were partitioned.
        dealt = held.repartition(-(-n // FIT_ROWS), "token_id").sortWithinPartitions(F.xxhash64("token_id", F.lit(seed)), "token_id")
        rows = dealt.select(array_to_vector("v").alias("features")).persist()
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters())
        rows.unpersist()
    assigned = _routed(held, "token_id", np.arange(len(centres), dtype=np.int32), centres, 1)
    sizes = assigned.groupBy("bucket").agg(F.count("*").alias("n")).collect()
    sized = spark.createDataFrame([(r["bucket"], -(-r["n"] // recall.VOCAB_BLOCK)) for r in sizes], "bucket int, subs bigint")
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "bucket int, centre array<double>")
    packed = recall._packed_buckets(assigned.join(F.broadcast(sized), "bucket"), "token_id", F.col("subs"), "b")
    blocks = packed.withColumn("n", F.size("b_ids").cast("bigint")).join(F.broadcast(made), "bucket")
    blocks.write.partitionBy("bucket").parquet(path)
    return VectorIndex(spark, path)
