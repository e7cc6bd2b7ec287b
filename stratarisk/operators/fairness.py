"""Fairness and temporal robustness across strata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.scalar import judge_metric, round_half_up
from stratarisk.operators import metrics as M

R4 = round_half_up


def best_rows(scored: DataFrame, best: DataFrame, cell_cols: list[str]) -> DataFrame:
    """Scored rows of each cell's best algorithm (best table: one row per cell, broadcast)."""
    b = best.select(*cell_cols, F.col("best_algo").alias("algo"))
    return scored.join(F.broadcast(b), cell_cols + ["algo"])


def fairness_cells(holdout_best: DataFrame, cell_cols: list[str],
                   threshold: float = C.DECISION_THRESHOLD) -> DataFrame:
    """Per cell on the hold-out: AUC, TPR, FPR, ECE (4 dp) and n."""
    keys = cell_cols + ["algo"]
    j = M.cell_metrics(holdout_best, keys, threshold)
    return j.select(*keys, R4("auc").alias("auc"), R4("tpr").alias("tpr"),
                    R4("fpr").alias("fpr"), R4("ece").alias("ece"), "n")


def fairness_gaps(cells: DataFrame, group_col: str = "outcome", min_strata: int = 2) -> DataFrame:
    """max - min over strata of rounded metrics; EqOdds = TPR gap + FPR gap; verdicts."""
    g = cells.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_strata"),
        (F.max("auc") - F.min("auc")).alias("d_auc"),
        (F.max("tpr") - F.min("tpr")).alias("d_tpr"),
        (F.max("fpr") - F.min("fpr")).alias("d_fpr"),
        (F.max("ece") - F.min("ece")).alias("d_ece"))
    g = g.where(F.col("n_strata") >= min_strata)
    g = g.select(group_col, "n_strata", R4("d_auc").alias("delta_auc"), R4("d_tpr").alias("delta_tpr"),
                 R4("d_fpr").alias("delta_fpr"), R4("d_ece").alias("delta_ece"))
    g = g.withColumn("eq_odds", R4(F.col("delta_tpr") + F.col("delta_fpr")))
    return g.select(group_col, "n_strata", "delta_auc", judge_metric("delta_auc", "G1_delta_auc").alias("auc_verdict"),
                    "eq_odds", judge_metric("eq_odds", "G1_eq_odds").alias("eq_odds_verdict"),
                    "delta_ece", judge_metric("delta_ece", "G1_calib_ece").alias("ece_verdict"))


def cell_grid(strata: DataFrame, outcomes: list[str]) -> DataFrame:
    """Every configured stratum x outcome (kept even when a cell has no rows).

    Built by exploding the configured outcome list on the strata dimension:
    its size is strata x outcomes, fixed by configuration.
    """
    return strata.select("stratum", "stratum_order",
                         F.explode(F.array(*[F.lit(o) for o in outcomes])).alias("outcome"))


def fairness_chart(cells: DataFrame, strata: DataFrame, outcomes: list[str]) -> DataFrame:
    """Every stratum x outcome in configured order, with the range of the positive AUCs, its width and verdict.

    An outcome with fewer than two such AUCs has no range.
    """
    grid = cell_grid(strata, outcomes)
    j = grid.join(cells.select("stratum", "outcome", "auc", "tpr", "fpr"), ["stratum", "outcome"], "left")
    rng = (cells.where(F.col("auc") > 0).groupBy("outcome")
           .agg(F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"), F.count(F.lit(1)).alias("_valid"))
           .where("_valid >= 2").withColumn("delta_auc", R4(F.col("auc_max") - F.col("auc_min"))))
    return j.join(rng, "outcome", "left").select(
        "outcome", "stratum", "stratum_order", "auc", "tpr", "fpr", "auc_min", "auc_max", "delta_auc",
        judge_metric("delta_auc", "G1_delta_auc").alias("status"))


def temporal_gap(best_scored: DataFrame, cell_cols: list[str], cut_year: int,
                 min_rows: int = C.TEMPORAL_MIN_ROWS, min_pos: int = C.TEMPORAL_MIN_POSITIVES,
                 year_col: str = "year") -> DataFrame:
    """Hold-out AUC vs AUC on years >= cut, in one pass over the scored rows.

    A row can belong to both parts, so parts are an exploded tag and both
    AUCs come out of one histogram aggregate. Guards: >= min_rows rows,
    >= min_pos positives and both classes in the later years.
    """
    parts = F.array(F.when(F.col("is_test"), F.lit("holdout")),
                    F.when(F.col(year_col) >= F.lit(cut_year), F.lit("temporal")))
    tagged = (best_scored.select(*cell_cols, "algo", "y", "p6", F.explode(parts).alias("part"))
              .where(F.col("part").isNotNull()))
    return gap_of_parts(M.auc(tagged, cell_cols + ["algo", "part"]), cell_cols, min_rows, min_pos)


def gap_of_parts(a: DataFrame, cell_cols: list[str], min_rows: int = C.TEMPORAL_MIN_ROWS, min_pos: int = C.TEMPORAL_MIN_POSITIVES) -> DataFrame:
    """The gap and its verdict from AUCs by (cell, algo, part)."""
    ho = a.where("part = 'holdout'").select(*cell_cols, "algo", F.col("auc").alias("_ho"))
    te = a.where("part = 'temporal'").select(*cell_cols, "algo", F.col("auc").alias("_te"),
                                             F.col("n").alias("n_temporal"),
                                             F.col("n_pos").alias("pos_temporal"),
                                             F.col("n_neg").alias("neg_temporal"))
    j = ho.join(te, cell_cols + ["algo"])
    j = j.where((F.col("n_temporal") >= min_rows) & (F.col("pos_temporal") >= min_pos) &
                (F.col("neg_temporal") > 0))
    gap = R4(F.abs(F.col("_ho") - F.col("_te")))
    return j.select(*cell_cols, "algo", R4("_ho").alias("ho_auc"), R4("_te").alias("temporal_auc"),
                    "n_temporal", gap.alias("gap"), judge_metric(gap, "G2_temporal_gap").alias("verdict"))
