"""Per-cell metrics on unrounded double scores.

Input: group key columns, an int label ``y`` (0/1) and a double score ``p``.
Rows without a label or score (null or NaN) are left out. Equal doubles tie,
and nothing else does.

* ``score_table`` folds the rows to distinct (keys, p) before the shuffle.
* ``auc`` orders the distinct scores by ranges, not by groups: they are range-
  partitioned by (keys, p), every range sums its negatives, the running sum of
  those range totals (a row per range and group) gives each range its offset,
  and scores are ordered only within their range. A group of any size spreads
  over as many tasks as it has ranges.
* Scores are summed as integers of 2^-53, the grid of all doubles from 1/2 to
  1; below 1/2 less than 2^-53 a row is cut off. The sums do not depend on
  their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.operators import metrics as M

#: units of the summed scores
UNIT = 1 << 53


def bin_edges(n_bins: int = C.ECE_BINS) -> list[float]:
    """Inner edges of ``n_bins`` equal bins, as multiples of the bin width."""
    return [i * (1.0 / n_bins) for i in range(1, n_bins)]


def bin_of(p: str = "p", n_bins: int = C.ECE_BINS) -> Column:
    """Bin 1 .. n_bins of (lo, hi]; 0 for a score outside (0, 1]."""
    inside = F.lit(1)
    for edge in bin_edges(n_bins):
        inside = inside + (F.col(p) > F.lit(edge)).cast("int")
    return F.when((F.col(p) > 0) & (F.col(p) <= 1), inside).otherwise(F.lit(0))


def units(p: str = "p") -> Column:
    return F.floor(F.col(p) * F.lit(float(UNIT))).cast("bigint")


def score_table(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(keys, p, pos, neg) per distinct score; partial sums before the shuffle."""
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    return known.groupBy(*keys, F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum((F.lit(1) - F.col(y)).cast("bigint")).alias("neg"))


def ranged(scores: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """``scores`` with the number of its range of (keys, p); numbers ascend with (keys, p)."""
    n = ranges or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scores.repartitionByRange(n, *keys, "p").withColumn("_range", F.spark_partition_id())


def range_totals(scores: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, _range, pos, neg, u2): u2 is sum of pos * (2 * negatives below, within the range, + neg)."""
    within = Window.partitionBy(*keys, "_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(within), F.lit(0))
    term = F.col("pos").cast("decimal(38,0)") * (F.lit(2) * below + F.col("neg")).cast("decimal(38,0)")
    return (ranged(scores, keys, ranges).withColumn("_term", term.cast("decimal(38,0)"))
            .groupBy(*keys, "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_term").alias("u2")))


def auc_of(scores: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """(keys, n, n_pos, n_neg, auc) from a score table; auc is null where a class is absent."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    t = range_totals(scores, keys, ranges).withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0)))
    whole = F.col("u2") + F.lit(2) * F.col("_before").cast("decimal(38,0)") * F.col("pos").cast("decimal(38,0)")
    g = t.groupBy(*keys).agg(F.sum(whole.cast("decimal(38,0)")).alias("u2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return g.select(*keys, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2").cast("double") / pairs).alias("auc"))


def auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", ranges: int | None = None) -> DataFrame:
    return auc_of(score_table(df, keys, y, p), keys, ranges)


def confusion_of(scores: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """tp, fp, fn, tn at ``p >= threshold``, TPR and FPR (0 when undefined)."""
    flagged = scores.select(*keys, "pos", "neg", F.when(F.col("p") >= F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0)).alias("p6"))
    return M.confusion_from_histogram(flagged, keys, threshold=1.0 / M.P6_SCALE)


def confusion(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD, y: str = "y", p: str = "p") -> DataFrame:
    return confusion_of(score_table(df, keys, y, p), keys, threshold)


def weighted_prf(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD, y: str = "y", p: str = "p") -> DataFrame:
    """Support-weighted precision, recall and F1."""
    return M.weighted_prf_from_confusion(confusion(df, keys, threshold, y, p), keys)


def bins_of(scores: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS) -> DataFrame:
    """(keys, bin, n, sum_y, sum_u) with the scores outside (0, 1] in bin 0; sum_u in units of 2^-53."""
    n = F.col("pos") + F.col("neg")
    inside = F.when(F.col("bin") > 0, units("p")).otherwise(F.lit(0))
    return scores.withColumn("bin", bin_of("p", n_bins)).groupBy(*keys, "bin").agg(
        F.sum(n).alias("n"), F.sum("pos").alias("sum_y"),
        F.sum((inside.cast("decimal(38,0)") * n.cast("decimal(38,0)")).cast("decimal(38,0)")).alias("sum_u"))


def reliability_bins(df: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS, y: str = "y", p: str = "p") -> DataFrame:
    """Per bin: count, label sum, mean label, mean score."""
    b = bins_of(score_table(df, keys, y, p), keys, n_bins).where("bin > 0")
    return b.select(*keys, "bin", "n", "sum_y", (F.col("sum_y").cast("double") / F.col("n")).alias("mean_y"),
                    (F.col("sum_u").cast("double") / (F.lit(float(UNIT)) * F.col("n"))).alias("mean_p"))


def ece_of(scores: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS) -> DataFrame:
    """sum over bins of |sum_y - sum_p|, by n; scores of no bin count in n only."""
    labels = F.col("sum_y").cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(17,0)")
    gap = F.when(F.col("bin") > 0, F.abs(labels - F.col("sum_u"))).otherwise(F.lit(0)).cast("decimal(38,0)")
    g = bins_of(scores, keys, n_bins).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(gap).alias("gap"))
    return g.select(*keys, "n", (F.col("gap").cast("double") / (F.lit(float(UNIT)) * F.col("n"))).alias("ece"))


def ece(df: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS, y: str = "y", p: str = "p") -> DataFrame:
    return ece_of(score_table(df, keys, y, p), keys, n_bins)


def cell_metrics(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD, n_bins: int = C.ECE_BINS,
                 y: str = "y", p: str = "p") -> DataFrame:
    """AUC, weighted P / R / F1, TPR, FPR and ECE per group, all from one score table."""
    scores = score_table(df, keys, y, p)
    c = confusion_of(scores, keys, threshold)
    return (auc_of(scores, keys).select(*keys, "n", "n_pos", "auc").join(c.select(*keys, "tpr", "fpr"), keys)
            .join(M.weighted_prf_from_confusion(c, keys).drop("n"), keys).join(ece_of(scores, keys, n_bins).drop("n"), keys))


def cv_table(holdout: DataFrame, folds: DataFrame, best: DataFrame, cell_cols: list[str], baseline: str,
             metrics=("auc", "f1", "precision", "recall")) -> DataFrame:
    """The cross-validation table: a row per cell with a best algorithm.

    holdout: metrics per (cell, algo); folds: summary per (cell, algo) with
    ``cv_<metric>_mean`` and ``cv_<metric>_std``; best: (cell, best_algo). Its
    hold-out and fold figures stand beside the baseline's AUCs, with the
    difference of the two hold-out AUCs (4 digits). What is not there is null.
    """
    from stratarisk.functions.scalar import round_half_up as r4
    own = holdout.select(*cell_cols, F.col("algo").alias("best_algo"), *[r4(m).alias(f"ho_{m}") for m in metrics])
    cv = folds.select(*cell_cols, F.col("algo").alias("best_algo"), *[f"cv_{m}_{s}" for m in metrics for s in ("mean", "std")])
    base = holdout.where(F.col("algo") == baseline).select(*cell_cols, r4("auc").alias("base_ho_auc"))
    base_cv = folds.where(F.col("algo") == baseline).select(*cell_cols, F.col("cv_auc_mean").alias("base_cv_auc"))
    j = (best.select(*cell_cols, "best_algo").join(own, cell_cols + ["best_algo"], "left").join(cv, cell_cols + ["best_algo"], "left")
         .join(base, cell_cols, "left").join(base_cv, cell_cols, "left"))
    return j.withColumn("auc_vs_baseline", r4(F.col("ho_auc") - F.col("base_ho_auc")))
