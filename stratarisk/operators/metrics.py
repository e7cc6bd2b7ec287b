"""Per-cell classification metrics over a long scored table.

Input: any DataFrame with group key columns, an int label ``y`` (0/1) and an
int score ``p6 = round(1e6 * p)``. Integer scores make ties identical on
every engine and keep every sum exact; doubles appear only in the final
division.

All metrics are grouped aggregates (map-side combine, tiny shuffle). AUC
needs an ordering of scores, which is done on the per-cell score histogram
(at most 1,000,001 rows per cell, whatever the data size), never on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.scalar import guarded_ratio

P6_SCALE = 1_000_000


def threshold6(t: float = C.DECISION_THRESHOLD) -> int:
    return int(round(t * P6_SCALE))


def score_histogram(df: DataFrame, keys: list[str], y: str = "y", p6: str = "p6") -> DataFrame:
    """(keys, p6) -> positives, negatives. Partial aggregation before the shuffle."""
    return df.groupBy(*keys, p6).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"),
        F.sum((F.lit(1) - F.col(y)).cast("bigint")).alias("neg"))


def auc_from_histogram(hist: DataFrame, keys: list[str], p6: str = "p6") -> DataFrame:
    """Exact ROC AUC (ties count one half) from a score histogram.

    AUC = sum_p pos(p) * (2 * neg_below(p) + neg(p)) / (2 * P * N), computed
    with a decimal numerator (no overflow at any scale). Null when a class is
    absent.
    """
    w = Window.partitionBy(*keys).orderBy(p6).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    term = (F.col("pos").cast("decimal(38,0)") *
            (F.lit(2) * F.col("neg_below") + F.col("neg")).cast("decimal(38,0)"))
    agg = h.groupBy(*keys).agg(F.sum(term).alias("u2"),
                               F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2").cast("double") / den)
    return agg.select(*keys, (F.col("n_pos") + F.col("n_neg")).alias("n"),
                      "n_pos", "n_neg", auc.alias("auc"))


def auc(df: DataFrame, keys: list[str], y: str = "y", p6: str = "p6") -> DataFrame:
    """Two-phase exact AUC per group: (keys, n, n_pos, n_neg, auc)."""
    return auc_from_histogram(score_histogram(df, keys, y, p6), keys, p6)


def _confusion_aggs(y: str, p6: str, t6: int) -> list[Column]:
    pred = F.col(p6) >= F.lit(t6)
    pos = F.col(y) == 1
    return [
        F.count_if(pos & pred).alias("tp"),
        F.count_if(~pos & pred).alias("fp"),
        F.count_if(pos & ~pred).alias("fn"),
        F.count_if(~pos & ~pred).alias("tn"),
    ]


def confusion(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD,
              y: str = "y", p6: str = "p6") -> DataFrame:
    """tp, fp, fn, tn at ``p >= threshold`` plus TPR / FPR (0 when undefined)."""
    c = df.groupBy(*keys).agg(*_confusion_aggs(y, p6, threshold6(threshold)))
    return c.select(*keys, "tp", "fp", "fn", "tn",
                    guarded_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
                    guarded_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def ece_bin(p6: str = "p6", n_bins: int = C.ECE_BINS) -> Column:
    """Bin of (lo, hi] intervals: ceil(p * n_bins); p = 0 lies in no bin (bin 0)."""
    return F.floor((F.col(p6).cast("bigint") * n_bins + (P6_SCALE - 1)) / F.lit(float(P6_SCALE))).cast("int")


def reliability_bins(df: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS,
                     y: str = "y", p6: str = "p6") -> DataFrame:
    """Per (keys, bin): count, label sum, score sum, mean label, mean score."""
    b = df.withColumn("bin", ece_bin(p6, n_bins))
    g = b.where(F.col("bin") > 0).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("bigint")).alias("sum_y"),
        F.sum(F.col(p6).cast("bigint")).alias("sum_p6"))
    return g.select(*keys, "bin", "n", "sum_y", "sum_p6",
                    (F.col("sum_y").cast("double") / F.col("n")).alias("mean_y"),
                    (F.col("sum_p6").cast("double") / (F.lit(1e6) * F.col("n"))).alias("mean_p"))


def ece(df: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS,
        y: str = "y", p6: str = "p6") -> DataFrame:
    """Expected calibration error: sum_b |sum_y - sum_p| / n, n counting every row.

    In micro-units the numerator is an exact integer.
    """
    b = df.withColumn("bin", ece_bin(p6, n_bins))
    per_bin = b.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("sum_y"), F.sum(F.col(p6).cast("bigint")).alias("sum_p6"))
    return _ece_of_bins(per_bin, keys)


def _ece_of_bins(per_bin: DataFrame, keys: list[str]) -> DataFrame:
    """Bin 0 holds the scores of no bin: they count in n only."""
    gap = F.when(F.col("bin") > 0, F.abs(F.col("sum_y") * F.lit(P6_SCALE) - F.col("sum_p6"))).otherwise(0)
    g = per_bin.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(gap).alias("abs_gap6"))
    return g.select(*keys, "n", (F.col("abs_gap6").cast("double") / (F.lit(1e6) * F.col("n"))).alias("ece"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def weighted_prf_from_confusion(c: DataFrame, keys: list[str]) -> DataFrame:
    """Support-weighted precision / recall / F1 of both classes (zero division -> 0)."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = guarded_ratio(tp, tp + fp), guarded_ratio(tp, tp + fn)
    p0, r0 = guarded_ratio(tn, tn + fn), guarded_ratio(tn, tn + fp)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s0 + s1

    def wavg(m0, m1):
        return (s0 * m0 + s1 * m1) / n

    return c.select(*keys, (tp + fp + fn + tn).alias("n"),
                    wavg(p0, p1).alias("precision"),
                    wavg(r0, r1).alias("recall"),
                    wavg(_f1(p0, r0), _f1(p1, r1)).alias("f1"))


def weighted_prf(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD,
                 y: str = "y", p6: str = "p6") -> DataFrame:
    return weighted_prf_from_confusion(confusion(df, keys, threshold, y, p6), keys)


def confusion_from_histogram(hist: DataFrame, keys: list[str],
                             threshold: float = C.DECISION_THRESHOLD, p6: str = "p6") -> DataFrame:
    pred = F.col(p6) >= F.lit(threshold6(threshold))
    c = hist.groupBy(*keys).agg(
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pred, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~pred, F.col("neg")).otherwise(0)).alias("tn"))
    return c.select(*keys, "tp", "fp", "fn", "tn",
                    guarded_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
                    guarded_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def ece_from_histogram(hist: DataFrame, keys: list[str], n_bins: int = C.ECE_BINS,
                       p6: str = "p6") -> DataFrame:
    b = hist.withColumn("bin", ece_bin(p6, n_bins)).withColumn("_n", F.col("pos") + F.col("neg"))
    per_bin = b.groupBy(*keys, "bin").agg(
        F.sum("_n").alias("n"), F.sum("pos").alias("sum_y"),
        F.sum(F.col(p6).cast("bigint") * F.col("_n")).alias("sum_p6"))
    return _ece_of_bins(per_bin, keys)


def cell_metrics(df: DataFrame, keys: list[str], threshold: float = C.DECISION_THRESHOLD,
                 n_bins: int = C.ECE_BINS, y: str = "y", p6: str = "p6") -> DataFrame:
    """AUC, weighted P/R/F1, TPR, FPR and ECE per group from ONE pass over the rows.

    The per-group score histogram (bounded by 1,000,001 rows per group) holds
    everything: AUC walks it, confusion counts threshold it, calibration bins
    regroup it. The rows are read and aggregated once.
    """
    hist = score_histogram(df, keys, y, p6)
    a = auc_from_histogram(hist, keys, p6).select(*keys, "n", "n_pos", "auc")
    c = confusion_from_histogram(hist, keys, threshold, p6)
    prf = weighted_prf_from_confusion(c, keys).drop("n")
    e = ece_from_histogram(hist, keys, n_bins, p6).drop("n")
    return (a.join(c.select(*keys, "tpr", "fpr"), keys)
             .join(prf, keys).join(e, keys))
