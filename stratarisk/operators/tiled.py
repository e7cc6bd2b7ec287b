"""Grouped k-means on weighted points held in tiles.

Rows alike in both scores are one point with a weight. Points are ranged by
(group, tile of the plane), so a task's block holds tiles whole or in few
parts, and each tile carries its count, its coordinate sums and the smallest
circle about the middle of its box. By the triangle inequality, all points of
a tile have the same nearest centre where that centre is nearer to the middle
than any other by more than twice the radius: the tile's sums are added and
its points are not looked at. Only tiles that a border runs through are.

Nothing is kept per point between passes, so a lost executor's blocks are read
again from the written points and the pass goes on. All groups, initialisations
and numbers of clusters share each pass; sums are of integers and exact, so the
centres are those of the plain passes of :func:`grade.lloyd`.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.operators import grade as GR
from stratarisk.session import scratch_path

#: edge of a tile, in the unit of the scores (micro-units: 0.008 of a probability)
EDGE = 1 << 13
#: points in one block
BLOCK_POINTS = 1 << 20


@dataclass
class Block:
    """Points of one or more groups sorted by (group, tile), and the tiles' bounds and sums."""
    group: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    x: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, group: np.ndarray, x1: np.ndarray, x2: np.ndarray, w: np.ndarray, edge: int) -> Block:
        t1, t2 = np.floor_divide(x1, edge), np.floor_divide(x2, edge)
        order = np.lexsort((t2, t1, group))
        group, t1, t2, w = group[order], t1[order], t2[order], w[order]
        x = np.column_stack([x1[order], x2[order]])
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])])
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
        middle = (low + high) / 2.0
        far = np.sqrt(((x - np.repeat(middle, np.diff(np.append(at, len(x))), axis=0)) ** 2).sum(axis=1))
        total = np.column_stack([np.add.reduceat(w, at), np.add.reduceat(w * x[:, 0], at), np.add.reduceat(w * x[:, 1], at)])
        return cls(group[at], np.append(at, len(x)), middle, np.maximum.reduceat(far, at), total, x, w)

    def step(self, group: int, centres: np.ndarray, tiles: bool = True) -> tuple[np.ndarray, float, int]:
        """(count and coordinate sums per cluster, inertia of the points looked at, their number) for one group's centres."""
        k = len(centres)
        sums = np.zeros((k, 3), np.int64)
        lo, hi = np.searchsorted(self.group, [group, group + 1])
        open_ = np.ones(hi - lo, bool)
        if tiles and k > 1 and hi > lo:
            d = np.sqrt(((self.middle[lo:hi, None, :] - centres[None]) ** 2).sum(axis=2))
            two = np.partition(d, 1, axis=1)
            # the slack covers the rounding of the roots
            open_ = two[:, 0] + 2 * self.radius[lo:hi] >= two[:, 1] * (1 - 1e-9) - 1e-6
            np.add.at(sums, d.argmin(axis=1)[~open_], self.total[lo:hi][~open_])
        first, last = self.start[lo:hi][open_], self.start[lo + 1: hi + 1][open_]
        n = last - first
        if not n.sum():
            return sums, 0.0, 0
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        x, w = self.x[at], self.w[at]
        d2 = (x[:, 0, None] - centres[:, 0]) ** 2 + (x[:, 1, None] - centres[:, 1]) ** 2
        own = d2.argmin(axis=1)
        np.add.at(sums, own, np.column_stack([w, w * x[:, 0], w * x[:, 1]]))
        return sums, float((d2[np.arange(len(own)), own] * w).sum()), len(own)


def blocks(points: DataFrame, codes: dict, group_col: str, edge: int):
    """(RDD of blocks, weighted points) of ``points`` (group, x1, x2), held on the executors and, where memory ends, their disks."""
    spark = points.sparkSession
    code = F.lit(None).cast("int")
    for g, i in codes.items():
        code = F.when(F.col(group_col).eqNullSafe(F.lit(g)), F.lit(i)).otherwise(code)
    x1, x2 = F.col("x1").cast("long"), F.col("x2").cast("long")
    weighted = points.select(code.alias("g"), x1.alias("x1"), x2.alias("x2")).groupBy("g", "x1", "x2").agg(F.count(F.lit(1)).alias("w"))
    tile = [F.floor(F.col(c) / F.lit(edge)).alias(f"t{c}") for c in ("x1", "x2")]
    path = scratch_path(spark, "weighted-points")
    weighted.select("*", *tile).repartitionByRange("g", "tx1", "tx2", "x1", "x2").drop("tx1", "tx2").write.parquet(path)
    table = spark.read.schema("g int, x1 long, x2 long, w long").parquet(path)

    def pack(batches):
        held, n = [], 0
        for x in batches:
            if x.num_rows:
                held.append([np.asarray(c) for c in x.columns])
                n += x.num_rows
            if n >= BLOCK_POINTS:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(*map(np.concatenate, zip(*held)), edge))], pa.binary())], names=["block"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block.of(*map(np.concatenate, zip(*held)), edge))], pa.binary())], names=["block"])

    return table.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK), table


def one_pass(held, codes: dict, runs: dict, tiles: bool = True) -> dict:
    """{run: (sums, inertia)} and, under None, the number of (point, run) pairs looked at. Runs: (group, ...) -> centres."""
    sent = [(i, codes[run[0]], c) for i, (run, c) in enumerate(runs.items())]

    def sums(own):
        got: dict = {}
        for b in own:
            for i, g, c in sent:
                s, inertia, n = b.step(g, c, tiles)
                old = got.get(i)
                got[i] = (s, inertia, n) if old is None else (old[0] + s, old[1] + inertia, old[2] + n)
        return iter(got.items())

    added = held.mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), min(8, held.getNumPartitions())).collect()
    names = list(runs)
    return {**{names[i]: (s, inertia) for i, (s, inertia, _) in added}, None: sum(n for _, (_, _, n) in added)}


def lloyd(points: DataFrame, ks=(3,), n_init: int = 10, max_iter: int = 300, tol: float = 1e-4, seed: int = C.SEED,
          group_col: str = "stratum", edge: int = EDGE) -> tuple[DataFrame, dict]:
    """(centres, figures) of the best initialisation for every group and number of clusters.

    points: (group, row_id, x1, x2) with integer scores, read again by each
    seeding step, so a written table. Centres: (group, init, cluster, c1, c2,
    k, inertia6); a group of fewer distinct points than k has fewer. Figures:
    passes, points of the weighted table, (point, run) pairs looked at and those
    that passes without tiles would have looked at. Rows with a null score are
    left out; an empty table gives no centres.
    """
    spark = points.sparkSession
    pts = points.select(group_col, "row_id", "x1", "x2").where("x1 is not null and x2 is not null")
    spread = {r[0]: (r[1], tol * (r[2] + r[3]) / 2.0) for r in pts.groupBy(group_col).agg(
        F.count(F.lit(1)), F.var_pop(F.col("x1").cast("double")), F.var_pop(F.col("x2").cast("double"))).collect()}
    schema = f"{group_col} string, init int, cluster int, c1 double, c2 double, k int, inertia6 double"
    codes = {g: i for i, g in enumerate(spread)}
    # the first centres of a run do not depend on how many follow, so one seeding serves every k
    seeds: dict = {}
    for g, i, c, c1, c2 in GR.init_kmeanspp(pts, max(ks), n_init, seed, group_col) if spread else []:
        seeds.setdefault((g, i), []).append((c1, c2))
    state = {(g, k, i): np.array(cs[:k]) for (g, i), cs in seeds.items() for k in ks}
    figures = {"passes": 0, "points": 0, "looked_at": 0, "plain": 0}
    if not state:
        return spark.createDataFrame([], schema), figures
    held, table = blocks(pts, codes, group_col, edge)
    size = {r["g"]: r["n"] for r in table.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    figures["points"] = sum(size.values())
    active = dict(state)
    while active and figures["passes"] < max_iter:
        got = one_pass(held, codes, active)
        figures["passes"] += 1
        figures["looked_at"] += got[None]
        figures["plain"] += sum(size[codes[run[0]]] for run in active)
        for run, old in list(active.items()):
            sums = got[run][0]
            new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), old)   # an empty cluster keeps its centre
            state[run] = active[run] = new
            if ((new - old) ** 2).sum() <= spread[run[0]][1]:
                del active[run]
    last = one_pass(held, codes, state, tiles=False)
    held.unpersist()
    best: dict = {}
    for (g, k, i) in state:
        # initialisations that end in the same centres differ in the last digits of their sums only
        figure = (float(f"{last[(g, k, i)][1]:.12g}"), i)
        best[(g, k)] = min(best.get((g, k), figure), figure)
    rows = [(g, i, c, float(c1), float(c2), k, inertia) for (g, k), (inertia, i) in best.items() for c, (c1, c2) in enumerate(state[(g, k, i)])]
    return spark.createDataFrame(rows, schema), figures


def elbow(points: DataFrame, ks=range(2, 8), n_init: int = 10, max_iter: int = 300, seed: int = C.SEED, group_col: str = "stratum") -> DataFrame:
    """Best-init inertia (in probability units squared) for each k, all k in the same passes."""
    got, _ = lloyd(points, tuple(ks), n_init, max_iter, seed=seed, group_col=group_col)
    return got.select(group_col, "k", (F.col("inertia6") / 1e12).alias("inertia")).distinct()
