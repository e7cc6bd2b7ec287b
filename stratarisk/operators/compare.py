"""Algorithm comparison per cell: best model, roles, baseline deltas, CV summaries.

Inputs are per-cell metric tables (cells x algorithms x folds rows at most),
so windows over a cell are tiny; the heavy lifting happened in the metric
aggregates that produced them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarisk.functions.scalar import format_mean_std, judge_metric, round_half_up

R4 = round_half_up


def best_algo(metrics: DataFrame, cell_cols: list[str], algos: DataFrame,
              metric: str = "auc") -> DataFrame:
    """Strictly greatest 4-dp metric per cell, baseline excluded; ties keep list order."""
    m = (metrics.join(F.broadcast(algos), "algo")
         .where(~F.col("is_baseline") & F.col(metric).isNotNull())
         .withColumn("_m4", R4(metric)))
    w = Window.partitionBy(*cell_cols).orderBy(F.col("_m4").desc(), F.col("algo_order"))
    return (m.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
             .select(*cell_cols, F.col("algo").alias("best_algo"), F.col("_m4").alias("best_auc")))


def algo_comparison(metrics: DataFrame, best: DataFrame, cell_cols: list[str],
                    algos: DataFrame) -> DataFrame:
    """Role (baseline / best / compare) and AUC delta against the cell's baseline."""
    m = metrics.join(F.broadcast(algos), "algo").join(best, cell_cols, "left")
    base_auc = F.max(F.when(F.col("is_baseline"), R4("auc"))).over(Window.partitionBy(*cell_cols))
    role = (F.when(F.col("is_baseline"), F.lit("baseline"))
            .when(F.col("algo") == F.col("best_algo"), F.lit("best"))
            .otherwise(F.lit("compare")))
    m = m.withColumn("_base", base_auc)
    delta = F.when(~F.col("is_baseline") & F.col("_base").isNotNull(), R4(R4("auc") - F.col("_base")))
    return m.select(*cell_cols, "algo", "algo_order", role.alias("role"),
                    R4("auc").alias("auc"), R4("f1").alias("f1"),
                    R4("precision").alias("precision"), R4("recall").alias("recall"),
                    delta.alias("delta_vs_baseline"))


def auc_matrix(metrics: DataFrame, best: DataFrame, cell_cols: list[str],
               algo_list: list[str]) -> DataFrame:
    """Cell x algorithm AUC matrix (4 dp, missing = null) with the best marked."""
    p = (metrics.select(*cell_cols, "algo", R4("auc").alias("auc"))
         .groupBy(*cell_cols).pivot("algo", algo_list).agg(F.first("auc")))
    p = p.select(*cell_cols, *[F.col(a).alias(f"auc_{a}") for a in algo_list])
    return p.join(best.select(*cell_cols, "best_algo"), cell_cols, "left")


def cv_summary(fold_metrics: DataFrame, keys: list[str],
               metrics=("auc", "f1", "precision", "recall")) -> DataFrame:
    """Mean and population std over folds, plus the 'mean +- std' text."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.stddev_pop(m).alias(f"cv_{m}_std")]
    s = fold_metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)
    out = [*keys, "n_folds"]
    for m in metrics:
        out += [R4(f"cv_{m}_mean").alias(f"cv_{m}_mean"), R4(f"cv_{m}_std").alias(f"cv_{m}_std")]
    s = s.select(*out)
    return s.withColumn("cv_auc_text", format_mean_std("cv_auc_mean", "cv_auc_std"))


def cv_vs_holdout(cv: DataFrame, holdout: DataFrame, keys: list[str]) -> DataFrame:
    """Hold-out AUC looked up by (cell, algo); null when absent."""
    h = holdout.select(*keys, R4("auc").alias("ho_auc"))
    return cv.select(*keys, "cv_auc_mean", "cv_auc_std").join(h, keys, "left")


def cv_gap(cv: DataFrame, holdout: DataFrame, best: DataFrame, cell_cols: list[str]) -> DataFrame:
    """|CV mean - hold-out| AUC of each cell's best algorithm, with verdict."""
    b = best.select(*cell_cols, F.col("best_algo").alias("algo"))
    j = cv_vs_holdout(cv.join(b, cell_cols + ["algo"]), holdout, cell_cols + ["algo"])
    gap = R4(F.abs(F.col("cv_auc_mean") - F.col("ho_auc")))
    return j.select(*cell_cols, "algo", "ho_auc", "cv_auc_mean", gap.alias("gap"),
                    judge_metric(gap, "G2_cv_gap").alias("verdict"))
