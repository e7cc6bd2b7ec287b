"""Summaries of per-row feature attributions.

Input is the long attribution table ``(row_id, <cell keys>, feature, phi, x)``
(from ``shapley`` below or any explainer). Every summary is a grouped
aggregate; windows only run over per-cell feature lists (features-sized).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.hashing import hash_uniform
from stratarisk.functions.scalar import judge_metric, round_half_up
from stratarisk.operators import resample

R4 = round_half_up


def feature_importance(phi: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute attribution per (keys, feature)."""
    return phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"),
                                             F.count(F.lit(1)).alias("n"))


def hhi_from_importance(imp: DataFrame, keys: list[str], col: str = "mean_abs") -> DataFrame:
    """Sum of squared shares of importance; groups with zero total are skipped."""
    total = F.sum(col).over(Window.partitionBy(*keys))
    s = imp.withColumn("_tot", total).where(F.col("_tot") > 0)
    s = s.withColumn("_share", F.col(col) / F.col("_tot"))
    return s.groupBy(*keys).agg(F.sum(F.col("_share") * F.col("_share")).alias("hhi"),
                                F.count(F.lit(1)).alias("n_features"))


def hhi(phi: DataFrame, keys: list[str]) -> DataFrame:
    return hhi_from_importance(feature_importance(phi, keys), keys)


def bootstrap_hhi_multinomial(phi: DataFrame, keys: list[str], index_col: str,
                              n_boot: int = C.N_BOOTSTRAP, seed: int = C.SEED,
                              with_point: bool = False) -> DataFrame:
    """Per replicate: n draws with replacement of the group's n rows (exact resampling).

    ``index_col`` numbers a group's rows 1..n. Draw j of replicate b picks
    row floor(u(b, j) * n) + 1 with a hash uniform, so results do not depend
    on partitioning. Draws are counted per (group, replicate, row) before
    they meet the attribution rows, so each row is joined once per replicate
    it was drawn in. Work is n_boot x n rows per group: meant for the
    attribution samples (a few hundred rows per cell); see
    ``bootstrap_hhi_poisson`` for large groups.
    """
    sizes = phi.groupBy(*keys).agg(F.countDistinct(index_col).alias("_n"))
    reps = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b"))
    draws = reps.select(*keys, "_n", "b", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_j"))
    u = hash_uniform(*[F.col(k) for k in keys], F.col("b"), F.col("_j"), "boot", seed)
    draws = draws.select(*keys, "_n", "b", (F.floor(u * F.col("_n")) + 1).cast("bigint").alias(index_col))
    mult = draws.groupBy(*keys, "_n", "b", index_col).agg(F.count(F.lit(1)).alias("_m"))
    if with_point:
        # replicate 0 = every row once: the point estimate rides in the same pass
        ident = (sizes.select(*keys, "_n", F.lit(0).alias("b"),
                              F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n").cast("bigint")))
                              .alias(index_col))
                 .withColumn("_m", F.lit(1).cast("bigint")))
        mult = mult.unionByName(ident)
    j = mult.join(phi.select(*keys, index_col, "feature", "phi"), keys + [index_col])
    imp = j.groupBy(*keys, "b", "feature").agg(
        (F.sum(F.col("_m") * F.abs("phi")) / F.first("_n")).alias("mean_abs"))
    return hhi_from_importance(imp, keys + ["b"])


def bootstrap_hhi_poisson(phi: DataFrame, keys: list[str], row_col: str = "row_id",
                          n_boot: int = C.N_BOOTSTRAP, seed: int = C.SEED) -> DataFrame:
    """Poisson(1) bootstrap for large groups: no join, one partial aggregate.

    Each row gets an independent Poisson(1) weight per replicate (inverse CDF
    of a hash uniform); weighted means replace resampled means. Rows never
    move: the n_boot x rows expansion is folded by map-side aggregation into
    groups x n_boot x features partial sums.
    """
    cdf, p, acc = [], 1.0, 0.0
    import math
    for k in range(0, 12):
        p = math.exp(-1.0) / math.factorial(k)
        acc += p
        cdf.append(acc)
    b = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b")
    r = phi.select(*keys, row_col, "feature", "phi", b)
    u = hash_uniform(F.col(row_col), F.col("b"), "poisson", seed)
    w = sum((u > F.lit(c)).cast("int") for c in cdf)
    r = r.withColumn("_w", w)
    imp = r.groupBy(*keys, "b", "feature").agg(
        # a small group can draw no row at all in a replicate: that replicate is left out
        F.try_divide(F.sum(F.col("_w") * F.abs("phi")), F.sum("_w")).alias("mean_abs"))
    return hhi_from_importance(imp.where(F.col("mean_abs").isNotNull()), keys + ["b"])


def hhi_interval(phi: DataFrame, keys: list[str], index_col: str, n_boot: int = C.N_BOOTSTRAP,
                 seed: int = C.SEED, method: str = "multinomial") -> DataFrame:
    """Transparency table: HHI, bootstrap 2.5 / 97.5 percentiles, verdict.

    method: ``multinomial`` lists the draws (samples), ``splits`` deals them out by binomial splits
    (exact as well, groups of any size), ``poisson`` gives each row independent weights.
    """
    if method == "multinomial":
        # point estimate = replicate 0 of the same aggregate: attributions are read once
        boots = bootstrap_hhi_multinomial(phi, keys, index_col, n_boot, seed, with_point=True)
        j = boots.groupBy(*keys).agg(
            F.max(F.when(F.col("b") == 0, F.col("hhi"))).alias("hhi"),
            F.percentile(F.when(F.col("b") > 0, F.col("hhi")), [0.025, 0.975]).alias("_q"))
    else:
        point = hhi(phi, keys)
        boots = (resample.bootstrap_hhi(phi, keys, index_col, n_boot, seed) if method == "splits" else
                 bootstrap_hhi_poisson(phi, keys, "row_id", n_boot, seed))
        ci = boots.groupBy(*keys).agg(F.percentile("hhi", [0.025, 0.975]).alias("_q"))
        j = point.join(ci, keys, "left")
    j = j.where(F.col("hhi").isNotNull())
    return j.select(*keys, R4("hhi").alias("hhi"), R4(F.col("_q")[0]).alias("hhi_ci_lo"),
                    R4(F.col("_q")[1]).alias("hhi_ci_hi"),
                    judge_metric(R4("hhi"), "G3_hhi").alias("verdict"))


def top_features_overall(imp: DataFrame, group_col: str, stratum_col: str, n: int = 10) -> DataFrame:
    """Top-n features by mean importance over strata (a missing stratum counts 0)."""
    n_strata = imp.groupBy(group_col).agg(F.countDistinct(stratum_col).alias("_ns"))
    s = (imp.groupBy(group_col, "feature").agg(F.sum("mean_abs").alias("_sum"))
         .join(n_strata, group_col)
         .withColumn("importance", F.col("_sum") / F.col("_ns")))
    w = Window.partitionBy(group_col).orderBy(F.col("importance").desc(), "feature")
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
             .select(group_col, "rank", "feature", "importance"))


def top_features_per_cell(imp: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc(), "feature")
    return (imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
               .select(*keys, "rank", "feature", "mean_abs"))


def waterfall_rows(phi_one: DataFrame, keys: list[str], max_display: int = 12) -> DataFrame:
    """Contributions of one row per group ranked by |phi|. With more than
    max_display features, those beyond max_display - 1 are summed into one 'other' row."""
    whole = Window.partitionBy(*keys, "row_id")
    w = whole.orderBy(F.abs("phi").desc(), "feature")
    r = phi_one.withColumn("_rk", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(whole))
    keep = F.when(F.col("_n") <= max_display, max_display).otherwise(max_display - 1)
    top = r.where(F.col("_rk") <= keep).select(*keys, "row_id", F.col("_rk").alias("rank"),
                                               "feature", "phi", "x")
    rest = (r.where(F.col("_rk") > keep).groupBy(*keys, "row_id")
            .agg(F.count(F.lit(1)).alias("_k"), F.sum("phi").alias("phi"))
            .select(*keys, "row_id", F.lit(max_display).alias("rank"),
                    F.format_string("other (%d features)", F.col("_k")).alias("feature"),
                    "phi", F.lit(None).cast("double").alias("x")))
    return top.unionByName(rest)


def beeswarm_rows(phi: DataFrame, keys: list[str], top: DataFrame) -> DataFrame:
    """phi and the feature value scaled to [0, 1] per (cell, feature) for top features."""
    t = top.select(*keys, "feature", "rank")
    j = phi.join(F.broadcast(t), keys + ["feature"])
    # Range per (cell, feature) by partial aggregation (cells x features rows,
    # broadcast back) rather than a window that would put one cell-feature's
    # rows on one task.
    rng = j.groupBy(*keys, "feature").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    j = j.join(F.broadcast(rng), keys + ["feature"])
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi > lo, (F.col("x") - lo) / (hi - lo)).otherwise(F.lit(0.5))
    return j.select(*keys, "row_id", "rank", "feature", "phi", scaled.alias("x_scaled"))


def importance_matrix(imp: DataFrame, group_col: str, stratum_col: str, strata: list[str]) -> DataFrame:
    """feature x stratum importance pivot per outcome, missing = 0."""
    p = imp.groupBy(group_col, "feature").pivot(stratum_col, strata).agg(F.first("mean_abs"))
    return p.na.fill(0.0, subset=strata)


def borderline_case(rows: DataFrame, keys: list[str], order_col: str, p6: str = "p6",
                    lo: float = C.BORDERLINE_LO, hi: float = C.BORDERLINE_HI) -> DataFrame:
    """First row (in sample order) with lo <= p <= hi, else the first row."""
    in_band = (F.col(p6) >= F.lit(int(round(lo * 1e6)))) & (F.col(p6) <= F.lit(int(round(hi * 1e6))))
    r = rows.withColumn("in_band", in_band)
    best = r.groupBy(*keys).agg(F.min(F.struct((~F.col("in_band")).alias("_o"), F.col(order_col),
                                                F.col("row_id"), F.col(p6), F.col("in_band"))).alias("_s"))
    return best.select(*keys, "_s.row_id", F.col(f"_s.{p6}").alias(p6), "_s.in_band")


def linear_shapley(rows: DataFrame, keys: list[str], coefs: dict[str, list[tuple[str, float]]],
                   outcome_col: str = "outcome", carry: list[str] | None = None) -> DataFrame:
    """Exact Shapley values of a linear logit: phi_j = c_j * (x_j - mean_j).

    Means are over each group's rows (the background). The coefficient table
    is configuration-sized and inlined as literals.
    """
    feats = sorted({f for v in coefs.values() for f, _ in v})
    coef_of = {f: None for f in feats}
    for f in feats:
        e = None
        for o, lst in coefs.items():
            c = dict(lst).get(f, 0.0)
            cond = F.col(outcome_col) == F.lit(o)
            e = F.when(cond, F.lit(c)) if e is None else e.when(cond, F.lit(c))
        coef_of[f] = e
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"),
                             coef_of[f].alias("c")) for f in feats])
    carry = carry or []
    long = rows.select("row_id", *keys, *carry, F.explode(arr).alias("_f")).select(
        "row_id", *keys, *carry, "_f.feature", "_f.x", "_f.c")
    means = long.groupBy(*keys, "feature").agg(F.avg("x").alias("_mu"))
    j = long.join(F.broadcast(means), keys + ["feature"])
    return j.select("row_id", *keys, *carry, "feature",
                    (F.col("c") * (F.col("x") - F.col("_mu"))).alias("phi"), "x")
