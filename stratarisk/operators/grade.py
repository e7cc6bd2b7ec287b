"""Risk grading: grouped two-score k-means and grade summaries.

Points are ``(group, row_id, x1, x2)`` with integer micro-unit scores. All
groups and all initialisations share every Lloyd iteration:

* assignment: the centre table (groups x inits x k rows, sized by
  configuration) is broadcast as one array per (group, init); each point
  picks its nearest centre with ``array_min(transform(...))`` inside the row,
  so points are never shuffled;
* update: one ``groupBy(group, init, cluster)`` with map-side partial sums.

Only centres (a few hundred numbers) reach the driver between iterations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.hashing import hash32, hash_uniform
from stratarisk.functions.scalar import round_half_up
from stratarisk.operators.keys import hash_top_k
from stratarisk.session import scratch_path

R4 = round_half_up


def _centre_arrays(centres: DataFrame, group_col: str) -> DataFrame:
    return centres.groupBy(group_col, "init").agg(
        F.collect_list(F.struct(F.col("cluster").alias("k"), F.col("c1"), F.col("c2"))).alias("_cs"))


def assign(points: DataFrame, centres: DataFrame, group_col: str = "stratum") -> DataFrame:
    """Nearest centre per point and init; ties go to the lower cluster id.

    Adds init, cluster and d2 (squared distance in micro-units).
    """
    cs = _centre_arrays(centres, group_col)
    j = points.join(F.broadcast(cs), group_col)
    best = F.expr("array_min(transform(_cs, c -> named_struct("
                  "'d', (x1 - c.c1) * (x1 - c.c1) + (x2 - c.c2) * (x2 - c.c2), 'k', c.k)))")
    return (j.withColumn("_b", best)
             .select(*[c for c in points.columns], "init",
                     F.col("_b.k").alias("cluster"), F.col("_b.d").alias("d2")))


def _nearest_unrolled(k: int):
    """Nearest of k centres as plain (code-generated) expressions: the least
    (d2, cluster) struct, so ties go to the lower cluster id."""
    cands = []
    for i in range(k):
        c = F.get(F.col("_cs"), i)
        d = ((F.col("x1") - c["c1"]) * (F.col("x1") - c["c1"]) +
             (F.col("x2") - c["c2"]) * (F.col("x2") - c["c2"]))
        # a group of fewer distinct points than k has fewer centres
        cands.append(F.when(c.isNotNull(), F.struct(d.alias("d"), c["k"].alias("k"))))
    return cands[0] if k == 1 else F.least(*cands)


def assign_arrays(points: DataFrame, centre_arrays: DataFrame, group_col: str = "stratum",
                  k: int | None = None) -> DataFrame:
    """``assign`` with centres already packed as one array per (group, init).

    With ``k`` known (every array has k centres sorted by cluster id) the
    distances are unrolled into code-generated expressions instead of an
    interpreted lambda.
    """
    j = points.join(F.broadcast(centre_arrays), group_col)
    best = (_nearest_unrolled(k) if k else
            F.expr("array_min(transform(_cs, c -> named_struct("
                   "'d', (x1 - c.c1) * (x1 - c.c1) + (x2 - c.c2) * (x2 - c.c2), 'k', c.k)))"))
    return (j.withColumn("_b", best)
             .select(*[c for c in points.columns], "init",
                     F.col("_b.k").alias("cluster"), F.col("_b.d").alias("d2")))


def update(assigned: DataFrame, group_col: str = "stratum") -> DataFrame:
    """New centres = member means; also inertia contribution per cluster."""
    return assigned.groupBy(group_col, "init", "cluster").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col("x1").cast("double")) / F.count(F.lit(1))).alias("c1"),
        (F.sum(F.col("x2").cast("double")) / F.count(F.lit(1))).alias("c2"),
        F.sum("d2").alias("inertia6"))


def init_centres(points: DataFrame, k: int, n_init: int, seed: int = C.SEED,
                 group_col: str = "stratum") -> DataFrame:
    """Random-points init: per (group, init) the k rows with the smallest hash."""
    inits = points.select(group_col, "row_id", "x1", "x2",
                          F.explode(F.sequence(F.lit(1), F.lit(n_init))).alias("init"))
    top = hash_top_k(inits, [group_col, "init"], "row_id", k, tag="kinit", seed=seed,
                     salt_col="init")
    return top.select(group_col, "init", (F.col("_rank") - 1).cast("int").alias("cluster"),
                      F.col("x1").cast("double").alias("c1"), F.col("x2").cast("double").alias("c2"))


def materialize_points(points: DataFrame) -> DataFrame:
    """The points written once under the shared folder; the passes read that table.

    The input's partitions stay as they are, and nothing is held in executor
    memory or on their disks.
    """
    path = scratch_path(points.sparkSession, "points")
    points.write.parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def _lower(n_runs: int):
    """Of batches with columns run and key first, the rows that are the least of their run so far (all of equal ones)."""
    def lower(batches):
        least = np.full(n_runs, np.inf)
        for x in batches:
            run, key = np.asarray(x.column(0)), np.asarray(x.column(1))
            np.fmin.at(least, run, key)
            yield x.filter(pa.array(~(key > least[run])))
    return lower


def _least_rows(rows: DataFrame, n_runs: int) -> dict:
    """{run: its least row by (_key, row_id, x1, x2)} of ``rows`` (run, _key, row_id, x1, x2), runs numbered from 0.

    Each task hands on only the rows that are the least of their run so far, so
    next to nothing is left for the grouped minimum.
    """
    few = rows.select("run", "_key", "row_id", "x1", "x2")
    few = few.mapInArrow(_lower(n_runs), few.schema)
    won = few.groupBy("run").agg(F.min(F.struct("_key", "row_id", "x1", "x2")).alias("_w")).collect()
    return {r["run"]: r["_w"] for r in won}


def init_kmeanspp(pts: DataFrame, k: int, n_init: int, seed: int = C.SEED,
                  group_col: str = "stratum") -> list[tuple]:
    """k-means++ seeding for every (group, init) at once; returns centre rows.

    Centre 1 is the smallest-hash row; centre j + 1 is drawn with probability
    proportional to the squared distance to the nearest chosen centre, by an
    exponential race: the row with the least -ln(u) / d2 wins (u a hash
    uniform of row, init and step). One grouped minimum per centre; only the
    chosen centres reach the driver.
    """
    spark = pts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if pts.rdd.getNumPartitions() < cores:
        pts = pts.repartition(cores)
    groups = sorted(r[0] for r in pts.select(group_col).distinct().collect() if r[0] is not None)
    runs = [(g, i) for g in groups for i in range(1, n_init + 1)]
    if not runs:
        return []
    chosen: dict = {run: [] for run in runs}
    for j in range(k):
        own = [(n, *run, *[v for c in chosen[run] + [(None, None, None)] * (j - len(chosen[run])) for v in c[1:]]) for n, run in enumerate(runs)]
        centre_cols = "".join(f", c1_{m} double, c2_{m} double" for m in range(j))
        d = pts.join(F.broadcast(spark.createDataFrame(own, f"run int, {group_col} string, init int{centre_cols}")), group_col)
        if j == 0:
            key = hash32(F.col("row_id"), "kinit", seed, F.col("init")).cast("double")
        else:
            # a group of fewer distinct points than k has fewer centres
            far = [(F.col("x1") - F.col(f"c1_{m}")) * (F.col("x1") - F.col(f"c1_{m}"))
                   + (F.col("x2") - F.col(f"c2_{m}")) * (F.col("x2") - F.col(f"c2_{m}")) for m in range(j)]
            d2 = far[0] if j == 1 else F.least(*far)
            d = d.where(d2 > 0)
            key = -F.log(hash_uniform(F.col("row_id"), F.col("init"), F.lit(j), "kpp", seed)) / d2
        for n, w in _least_rows(d.withColumn("_key", key), len(runs)).items():
            chosen[runs[n]].append((j, float(w["x1"]), float(w["x2"])))
    return [(g, i, c, c1, c2) for (g, i), cs in sorted(chosen.items()) for c, c1, c2 in cs]


def lloyd(points: DataFrame, k: int = 3, n_init: int = 10, max_iter: int = 300,
          tol: float = 1e-4, seed: int = C.SEED, group_col: str = "stratum",
          centres: DataFrame | None = None, init: str = "k-means++", checkpointed: bool = False):
    """Grouped Lloyd iterations for every (group, init) at once.

    A (group, init) run stops when the summed squared shift of its centres
    is at most ``tol`` x the mean per-coordinate variance of the group's
    points (the usual relative criterion); converged runs are frozen and
    dropped from later passes, so each pass only touches active runs.
    Returns (final centres of the best init per group with its inertia,
    number of passes). Points are checkpointed once so each pass re-reads
    them from reliable storage instead of recomputing their lineage.
    """
    spark = points.sparkSession
    pts = points.select(group_col, "row_id", "x1", "x2")
    if not checkpointed:
        pts = materialize_points(pts)
    tol_abs = {r[0]: tol * (float(r[1] or 0.0) + float(r[2] or 0.0)) / 2.0 for r in
               pts.groupBy(group_col).agg(F.var_pop(F.col("x1").cast("double")),
                                          F.var_pop(F.col("x2").cast("double"))).collect()}
    if centres is not None:
        start = [tuple(r) for r in centres.select(group_col, "init", "cluster", "c1", "c2").collect()]
    elif init == "k-means++":
        start = init_kmeanspp(pts, k, n_init, seed, group_col)
    else:
        start = [tuple(r) for r in init_centres(pts, k, n_init, seed, group_col).collect()]
    state = {}
    for g, i, c, c1, c2 in start:
        state.setdefault((g, i), {})[c] = (float(c1), float(c2))
    active = set(state)
    schema = "%s string, init int, cluster int, c1 double, c2 double" % group_col

    def rows_of(keys):
        return [(g, i, c, c1, c2) for (g, i) in keys for c, (c1, c2) in state[(g, i)].items()]

    arr_schema = "%s string, init int, _cs array<struct<k:int,c1:double,c2:double>>" % group_col

    def arrays_of(keys):
        # centres are on the driver already: pack one array per (group, init) here
        return spark.createDataFrame(
            [(g, i, [(c, c1, c2) for c, (c1, c2) in sorted(state[(g, i)].items())]) for (g, i) in keys],
            arr_schema)

    it = 0
    for it in range(1, max_iter + 1):
        if not active:
            break
        upd = update(assign_arrays(pts, arrays_of(sorted(active)), group_col, k), group_col)
        new = {}
        for r in upd.select(group_col, "init", "cluster", "c1", "c2").collect():
            new.setdefault((r[0], r[1]), {})[r[2]] = (r[3], r[4])
        for run in list(active):
            shift = 0.0
            for c, (c1, c2) in state[run].items():
                n1, n2 = new.get(run, {}).get(c, (c1, c2))   # an empty cluster keeps its centre
                shift += (n1 - c1) ** 2 + (n2 - c2) ** 2
                state[run][c] = (float(n1), float(n2))
            if shift <= tol_abs.get(run[0], 0.0):
                active.discard(run)
    cdf = spark.createDataFrame(rows_of(sorted(state)), schema)
    fin = update(assign_arrays(pts, arrays_of(sorted(state)), group_col, k), group_col)
    inertia = fin.groupBy(group_col, "init").agg(F.sum("inertia6").alias("inertia6"))
    w = Window.partitionBy(group_col).orderBy("inertia6", "init")
    best = inertia.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(group_col, "init", "inertia6")
    return cdf.join(best, [group_col, "init"]), it


def grade_rank(centres: DataFrame, group_col: str = "stratum") -> DataFrame:
    """Grade 1..k by ascending centre sum (ties by cluster id)."""
    w = Window.partitionBy(group_col).orderBy(F.col("c1") + F.col("c2"), "cluster")
    return centres.withColumn("grade", F.row_number().over(w).cast("int"))


def apply_grades(points: DataFrame, ranked_centres: DataFrame, group_col: str = "stratum") -> DataFrame:
    """Assign every point to its nearest final centre and map cluster -> grade."""
    c = ranked_centres.select(group_col, "init", "cluster", "c1", "c2")
    a = assign(points, c, group_col)
    g = ranked_centres.select(group_col, "init", "cluster", "grade")
    return a.join(F.broadcast(g), [group_col, "init", "cluster"]).drop("init", "d2")


def grade_summary(graded: DataFrame, grades: DataFrame, group_col: str = "stratum",
                  y1: str = "y1", y2: str = "y2") -> DataFrame:
    """Per (group, grade): n, share of group, prevalence and mean score of both outcomes."""
    s = graded.groupBy(group_col, "grade").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(F.col(y1).cast("bigint")) / F.count(F.lit(1))).alias("_p1"),
        (F.sum(F.col(y2).cast("bigint")) / F.count(F.lit(1))).alias("_p2"),
        (F.sum(F.col("x1").cast("bigint")) / (F.lit(1e6) * F.count(F.lit(1)))).alias("_m1"),
        (F.sum(F.col("x2").cast("bigint")) / (F.lit(1e6) * F.count(F.lit(1)))).alias("_m2"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group_col))
    s = s.join(F.broadcast(grades), "grade", "left")
    return s.select(group_col, "grade", "grade_label", "n", R4(share).alias("share"),
                    R4("_p1").alias("prevalence_1"), R4("_p2").alias("prevalence_2"),
                    R4("_m1").alias("mean_p_1"), R4("_m2").alias("mean_p_2"), "policy")


def grade_monotone(summary: DataFrame, group_col: str = "stratum",
                   outcomes: dict[str, str] | None = None) -> DataFrame:
    """Does prevalence rise (non-strictly) with grade, per group and outcome?"""
    outcomes = outcomes or {"outcome_1": "prevalence_1", "outcome_2": "prevalence_2"}
    arr = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(c).alias("prev")) for o, c in outcomes.items()])
    long = summary.select(group_col, "grade", F.explode(arr).alias("_o")).select(group_col, "grade", "_o.*")
    w = Window.partitionBy(group_col, "outcome").orderBy("grade")
    long = long.withColumn("_prev", F.lag("prev").over(w))
    return long.groupBy(group_col, "outcome").agg(
        F.bool_and(F.col("_prev").isNull() | (F.col("prev") >= F.col("_prev"))).alias("monotone"),
        F.count(F.lit(1)).alias("n_grades"))


def elbow(points: DataFrame, ks=range(2, 8), n_init: int = 10, max_iter: int = 300,
          seed: int = C.SEED, group_col: str = "stratum") -> DataFrame:
    """Best-init inertia (in probability units squared) for each k."""
    spark = points.sparkSession
    pts = materialize_points(points.select(group_col, "row_id", "x1", "x2"))
    rows = []
    for k in ks:
        cent, _ = lloyd(pts, k, n_init, max_iter, seed=seed, group_col=group_col, checkpointed=True)
        for r in cent.select(group_col, "inertia6").distinct().collect():
            rows.append((r[0], int(k), float(r[1]) / 1e12))
    return spark.createDataFrame(rows, f"{group_col} string, k int, inertia double")
