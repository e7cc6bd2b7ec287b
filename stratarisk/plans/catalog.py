"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame that reads
the whole test tables; the matching SQL reproduces the same result by brute
force. ``__spark_entry__`` exposes both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.operators import cohort as CO
from stratarisk.operators import keys as K
from stratarisk.plans import fixtures as FX
from stratarisk.plans.oracle import with_, hash_sql
from stratarisk.session import scratch_path
from stratarisk.sources import phases as PH
from stratarisk.sources import tables as ST
from stratarisk.sources import sinks as SK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


RAW_COLS = [n for n, _ in FX.RAW_SQL_COLUMNS]

# ---------------------------------------------------------------------------
# 1. Cohort
# ---------------------------------------------------------------------------


@query("union_years", with_("raw") + f"""
select id, year, sex, age, dm_code, hp_code, num_a, num_b,
       case when year = {FX.FIXTURE_YEARS_DROP_COL[1]} then null else cat_a end as cat_a
from raw""")
def q_union_years(spark, sf_dir):
    """Yearly extracts (one lacks a column) unioned by name with column pruning."""
    years = sorted(r[0] for r in ST.read_table(spark, sf_dir, "orders")
                   .select(F.year("o_orderdate").alias("y")).distinct().collect())
    extracts = FX.yearly_extracts(spark, sf_dir, years)
    return ST.union_extracts(extracts, RAW_COLS)


@query("parquet_roundtrip", with_("cohort") + "select * from cohort")
def q_parquet_roundtrip(spark, sf_dir):
    """Write the cohort as Parquet under the shared checkpoint folder and read it back."""
    return SK.parquet_roundtrip(FX.cohort(spark, sf_dir), scratch_path(spark, "cohort"))


@query("recode_outcomes", with_("raw") + """
select id, dm_code, hp_code,
  cast(case dm_code when 1 then 0 when 3 then 1 end as int) as "Diabetes",
  cast(case hp_code when 1 then 0 when 4 then 1 end as int) as "Hypertension"
from raw where dm_code in (1, 3) and hp_code in (1, 4)""")
def q_recode_outcomes(spark, sf_dir):
    r = CO.recode_outcomes(FX.raw_extract(spark, sf_dir), FX.OUTCOME_CODES)
    return r.select("id", "dm_code", "hp_code", "Diabetes", "Hypertension")


@query("safe_cast", with_("raw_bad") + """
select id, age as age_text, try_cast(age as double) as age from raw_bad""")
def q_safe_cast(spark, sf_dir):
    r = FX.raw_extract(spark, sf_dir, bad_age=True)
    return r.select("id", F.col("age").alias("age_text"), CO.safe_double("age").alias("age"))


STUDY_NAMES = {"year": "SurveyYear", "sex": "Sex", "age": "Age"}
REQUIRED = ["num_a", "num_b", "cat_a", "num_missing", "Diabetes", "Hypertension", "Sex", "SurveyYear", "Age"]


@query("cohort_filter", with_("raw") + """
select num_a, num_b, cat_a,
  cast(case dm_code when 1 then 0 when 3 then 1 end as int) as "Diabetes",
  cast(case hp_code when 1 then 0 when 4 then 1 end as int) as "Hypertension",
  sex as "Sex", year as "SurveyYear", try_cast(age as double) as "Age"
from raw where dm_code in (1, 3) and hp_code in (1, 4) and try_cast(age as double) >= 19""")
def q_cohort_filter(spark, sf_dir):
    """Recode, cast, age filter, rename by dictionary, project required-and-present."""
    df = CO.recode_outcomes(FX.raw_extract(spark, sf_dir), FX.OUTCOME_CODES)
    df = CO.filter_min_age(CO.cast_age(df))
    df = CO.rename(df, STUDY_NAMES)
    return ST.prune_present(df, REQUIRED)


@query("age_band", with_("raw") + """
select id, try_cast(age as double) as age,
  case when try_cast(age as double) <= 39 then 0 when try_cast(age as double) <= 59 then 1 else 2 end
    as age_group
from raw where try_cast(age as double) is not null""")
def q_age_band(spark, sf_dir):
    df = CO.cast_age(FX.raw_extract(spark, sf_dir)).where(F.col("age").isNotNull())
    return CO.add_age_band(df).select("id", "age", "age_group")


@query("impute_zero", with_("raw") + """
select id, coalesce(cast(num_a as double), 0.0) as num_a, coalesce(cast(num_b as double), 0.0) as num_b,
  coalesce(cast(cat_a as double), 0.0) as cat_a
from raw""")
def q_impute_zero(spark, sf_dir):
    return CO.impute_zero(FX.raw_extract(spark, sf_dir), FX.PREDICTORS).select("id", *FX.PREDICTORS)


@query("assign_stratum", with_("scohort") + "select id, stratum from scohort")
def q_assign_stratum(spark, sf_dir):
    return FX.stratified_cohort(spark, sf_dir).select("id", "stratum")


_COUNTS_SQL = """
counts as (
  select s.stratum, s.stratum_order, o.outcome,
    cast(count(c.id) as bigint) as n,
    cast(coalesce(sum(case o.outcome when 'Diabetes' then c."Diabetes" else c."Hypertension" end), 0) as bigint)
      as positives
  from strata s
  cross join (select * from (values ('Diabetes'), ('Hypertension')) as t(outcome)) o
  left join cohort c on c.sex = s.sex and c.age_group = s.age_group
  group by s.stratum, s.stratum_order, o.outcome)
"""


@query("prevalence", with_("cohort", "strata") + "," + _COUNTS_SQL + f"""
select stratum, stratum_order, outcome, n, positives,
  floor(1000.0 * positives / nullif(n, 0) + 0.5) / 10.0 as prevalence_pct,
  positives < {C.SMALL_SAMPLE_POSITIVES} as small_sample
from counts""")
def q_prevalence(spark, sf_dir):
    """Stratum table: n, positives, prevalence %, small-sample flag (empty strata kept)."""
    return CO.prevalence(FX.cohort(spark, sf_dir), C.strata_dim(spark), list(FX.OUTCOME_CODES))


@query("trainable_cells", with_("cohort", "strata") + "," + _COUNTS_SQL + f"""
select stratum, outcome, n, positives, positives >= {C.MIN_POSITIVES_TRAIN} as trainable
from counts""")
def q_trainable_cells(spark, sf_dir):
    return CO.trainable_cells(FX.cohort(spark, sf_dir), C.strata_dim(spark), list(FX.OUTCOME_CODES))


@query("band_counts", with_("cohort") + """
select age_group, cast(count(*) as bigint) as n from cohort group by age_group order by age_group""")
def q_band_counts(spark, sf_dir):
    return CO.band_counts(FX.cohort(spark, sf_dir))


@query("class_weights", with_("split") + """
, pc as (select stratum, outcome, y, count(*) as n_class from split where not is_test
         group by stratum, outcome, y)
select stratum, outcome, y, cast(n_class as bigint) as n_class,
  cast(sum(n_class) over (partition by stratum, outcome) as double) / (2.0 * n_class) as weight
from pc""")
def q_class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_class) on the training part of each cell."""
    train = FX.split_cells(spark, sf_dir).where(~F.col("is_test"))
    return CO.class_weights(train, ["stratum", "outcome"], "y")


@query("stratified_split", with_("cells") + f"""
, r as (select id, stratum, outcome, y,
          row_number() over (partition by stratum, outcome, y order by {hash_sql('id', 'split')}, id) as rk,
          count(*) over (partition by stratum, outcome, y) as gn
        from cells)
select id as row_id, stratum, outcome, y, rk <= floor({C.TEST_FRACTION} * gn + 0.5) as is_test from r""")
def q_stratified_split(spark, sf_dir):
    """Label-stratified 30 % hold-out per cell (exact two-phase hash rank)."""
    s = K.stratified_split(FX.cell_rows(spark, sf_dir), ["stratum", "outcome"], "y", "id",
                           max_groups=2 * FX.n_cells(spark))
    return s.select(F.col("id").alias("row_id"), "stratum", "outcome", "y", "is_test")


@query("stratified_folds", with_("cells") + f"""
select id as row_id, stratum, outcome, y,
  cast((row_number() over (partition by stratum, outcome, y order by {hash_sql('id', 'fold')}, id) - 1)
       % {C.N_FOLDS} as int) as fold
from cells""")
def q_stratified_folds(spark, sf_dir):
    """Label-stratified k folds per cell."""
    s = K.stratified_folds(FX.cell_rows(spark, sf_dir), ["stratum", "outcome"], "y", "id",
                           max_groups=2 * FX.n_cells(spark))
    return s.select(F.col("id").alias("row_id"), "stratum", "outcome", "y", "fold")


@query("sample_n_per_cell", with_("split") + f"""
, r as (select id, stratum, outcome,
          row_number() over (partition by stratum, outcome order by {hash_sql('id', 'sample')}, id) as sample_rank
        from split where is_test)
select id as row_id, stratum, outcome, sample_rank from r where sample_rank <= {C.SHAP_SAMPLE}""")
def q_sample_n_per_cell(spark, sf_dir):
    """Seeded sample of at most 500 hold-out rows per cell (the attribution sample)."""
    test = FX.split_cells(spark, sf_dir).where(F.col("is_test"))
    s = K.sample_n_per_group(test, ["stratum", "outcome"], "id", C.SHAP_SAMPLE,
                             max_groups=FX.n_cells(spark))
    return s.select(F.col("id").alias("row_id"), "stratum", "outcome", "sample_rank")


# ---------------------------------------------------------------------------
# 2. Metrics over the scored table (hold-out rows)
# ---------------------------------------------------------------------------

from stratarisk.operators import compare as CMP  # noqa: E402
from stratarisk.operators import fairness as FAIR  # noqa: E402
from stratarisk.operators import exact as X  # noqa: E402
from stratarisk.operators import metrics as M  # noqa: E402
from stratarisk.plans import oracle as O  # noqa: E402

CELL = ["stratum", "outcome"]
CELL_ALGO = CELL + ["algo"]
BASE = FX.STANDIN_BASELINE


def _algos(spark):
    return C.algos_dim(spark, FX.STANDIN_ALGOS, BASE)


def _holdout(spark, sf_dir):
    return FX.scored(spark, sf_dir).where(F.col("is_test"))


def _holdout_metrics(spark, sf_dir):
    return M.cell_metrics(_holdout(spark, sf_dir), CELL_ALGO)


def _best(spark, sf_dir):
    return CMP.best_algo(M.auc(_holdout(spark, sf_dir), CELL_ALGO), CELL, _algos(spark))


def _best_scored(spark, sf_dir):
    return FAIR.best_rows(FX.scored(spark, sf_dir), _best(spark, sf_dir), CELL)


SQL_EXTRA = {
    "test": (["scored"], "select * from scored where is_test"),
    "ho_auc": (["test"], f"select * from {O.auc_sql('test', CELL_ALGO)} z"),
    "ho_conf": (["test"], f"select * from {O.conf_sql('test', CELL_ALGO)} z"),
    "ho_prf": (["ho_conf"], f"select * from {O.prf_sql('ho_conf', CELL_ALGO)} z"),
    "best": (["ho_auc", "algos"], f"""
        select stratum, outcome, algo as best_algo, a4 as best_auc from (
          select h.*, {O.r4('h.auc')} as a4,
            row_number() over (partition by stratum, outcome order by {O.r4('h.auc')} desc, a.algo_order) as rn
          from ho_auc h join algos a using (algo)
          where h.algo <> '{BASE}' and h.auc is not null) z where rn = 1"""),
    "best_scored": (["scored", "best"], """
        select s.* from scored s join best b
          on s.stratum = b.stratum and s.outcome = b.outcome and s.algo = b.best_algo"""),
    "best_test": (["best_scored"], "select * from best_scored where is_test"),
    "fair_cells": (["best_test"], f"""
        select a.stratum, a.outcome, a.algo, {O.r4('a.auc')} as auc, {O.r4('c.tpr')} as tpr,
          {O.r4('c.fpr')} as fpr, {O.r4('e.ece')} as ece, a.n
        from {O.auc_sql('best_test', CELL_ALGO)} a
        join {O.conf_sql('best_test', CELL_ALGO)} c using (stratum, outcome, algo)
        join {O.ece_sql('best_test', CELL_ALGO)} e using (stratum, outcome, algo)"""),
    "fold_metrics": (["scored"], f"""
        select a.stratum, a.outcome, a.algo, a.fold, a.auc, p.f1, p.precision, p.recall
        from {O.auc_sql('scored', CELL_ALGO + ['fold'])} a
        join {O.prf_sql(O.conf_sql('scored', CELL_ALGO + ['fold']), CELL_ALGO + ['fold'])} p
          using (stratum, outcome, algo, fold)"""),
    "cv": (["fold_metrics"], f"""
        select stratum, outcome, algo, cast(count(*) as bigint) as n_folds,
          {O.r4('avg(auc)')} as cv_auc_mean, {O.r4('stddev_pop(auc)')} as cv_auc_std,
          {O.r4('avg(f1)')} as cv_f1_mean, {O.r4('stddev_pop(f1)')} as cv_f1_std,
          {O.r4('avg(precision)')} as cv_precision_mean, {O.r4('stddev_pop(precision)')} as cv_precision_std,
          {O.r4('avg(recall)')} as cv_recall_mean, {O.r4('stddev_pop(recall)')} as cv_recall_std
        from fold_metrics group by stratum, outcome, algo"""),
}


def W(*names):
    return O.with_(*names, extra=SQL_EXTRA)


@query("auc_by_cell", W("ho_auc") + "select * from ho_auc")
def q_auc_by_cell(spark, sf_dir):
    """Exact ROC AUC per (stratum, outcome, algo) on the hold-out, two-phase."""
    return M.auc(_holdout(spark, sf_dir), CELL_ALGO)


@query("confusion", W("ho_conf") + "select * from ho_conf")
def q_confusion(spark, sf_dir):
    """Confusion counts at p >= 0.5 with TPR / FPR (0 when undefined)."""
    return M.confusion(_holdout(spark, sf_dir), CELL_ALGO)


@query("ece", W("test") + f"select * from {O.ece_sql('test', CELL_ALGO)} z")
def q_ece(spark, sf_dir):
    """Expected calibration error, 10 bins of (lo, hi]."""
    return M.ece(_holdout(spark, sf_dir), CELL_ALGO)


@query("reliability_bins", W("test") + f"select * from {O.bins_sql('test', CELL_ALGO)} z")
def q_reliability_bins(spark, sf_dir):
    return M.reliability_bins(_holdout(spark, sf_dir), CELL_ALGO)


@query("weighted_prf", W("ho_prf") + "select * from ho_prf")
def q_weighted_prf(spark, sf_dir):
    """Support-weighted precision, recall and F1."""
    return M.weighted_prf(_holdout(spark, sf_dir), CELL_ALGO)


@query("best_algo", W("best") + "select * from best")
def q_best_algo(spark, sf_dir):
    """Best non-baseline algorithm per cell by 4-dp AUC; ties keep list order."""
    return _best(spark, sf_dir)


@query("algo_comparison", W("ho_auc", "ho_prf", "best", "algos") + f"""
, m as (select h.stratum, h.outcome, h.algo, a.algo_order, h.auc, p.f1, p.precision, p.recall
        from ho_auc h join ho_prf p using (stratum, outcome, algo) join algos a using (algo))
, b as (select stratum, outcome, {O.r4('auc')} as base from m where algo = '{BASE}')
select m.stratum, m.outcome, m.algo, m.algo_order,
  case when m.algo = '{BASE}' then 'baseline' when m.algo = best.best_algo then 'best' else 'compare' end as role,
  {O.r4('m.auc')} as auc, {O.r4('m.f1')} as f1, {O.r4('m.precision')} as precision, {O.r4('m.recall')} as recall,
  case when m.algo <> '{BASE}' and b.base is not null then {O.r4(O.r4('m.auc') + ' - b.base')} end as delta_vs_baseline
from m left join best using (stratum, outcome) left join b using (stratum, outcome)""")
def q_algo_comparison(spark, sf_dir):
    """Flat comparison table: role, metrics and AUC delta against the baseline."""
    met = _holdout_metrics(spark, sf_dir)
    best = CMP.best_algo(met, CELL, _algos(spark))
    return CMP.algo_comparison(met, best, CELL, _algos(spark))


@query("auc_matrix", W("ho_auc", "best") + """
select stratum, outcome, """ + ", ".join(
    f"max(case when algo = '{a}' then {O.r4('auc')} end) as auc_{a}" for a in FX.STANDIN_ALGOS) + """,
  max(best_algo) as best_algo
from ho_auc left join best using (stratum, outcome) group by stratum, outcome""")
def q_auc_matrix(spark, sf_dir):
    """Cell x algorithm AUC pivot with the best algorithm marked."""
    a = M.auc(_holdout(spark, sf_dir), CELL_ALGO)
    return CMP.auc_matrix(a, CMP.best_algo(a, CELL, _algos(spark)), CELL, FX.STANDIN_ALGOS)


# ---- the same metrics on unrounded double scores, and the cross-validation table

def _dholdout(spark, sf_dir):
    return FX.scored_doubles(spark, sf_dir).where("is_test")


SQL_EXTRA.update({
    "dtest": (["dscored"], "select * from dscored where is_test"),
    "d_auc": (["dtest"], f"select * from {O.exact_auc_sql('dtest', CELL_ALGO)} z"),
    "d_conf": (["dtest"], f"select * from {O.exact_conf_sql('dtest', CELL_ALGO)} z"),
    "d_prf": (["d_conf"], f"select * from {O.prf_sql('d_conf', CELL_ALGO)} z"),
    "d_best": (["d_auc", "algos"], SQL_EXTRA["best"][1].replace("ho_auc", "d_auc")),
    "d_folds": (["dscored"], f"""
        select a.stratum, a.outcome, a.algo, a.fold, a.auc, p.f1, p.precision, p.recall
        from {O.exact_auc_sql('dscored', CELL_ALGO + ['fold'])} a
        join {O.prf_sql(O.exact_conf_sql('dscored', CELL_ALGO + ['fold']), CELL_ALGO + ['fold'])} p
          using (stratum, outcome, algo, fold)"""),
    "d_cv": (["d_folds"], SQL_EXTRA["cv"][1].replace("fold_metrics", "d_folds")),
})


@query("exact_auc", W("d_auc") + "select * from d_auc")
def q_exact_auc(spark, sf_dir):
    """ROC AUC per (stratum, outcome, algo) on double scores, by range totals."""
    return X.auc(_dholdout(spark, sf_dir), CELL_ALGO)


@query("exact_confusion", W("d_conf") + "select * from d_conf")
def q_exact_confusion(spark, sf_dir):
    return X.confusion(_dholdout(spark, sf_dir), CELL_ALGO)


@query("exact_weighted_prf", W("d_prf") + "select * from d_prf")
def q_exact_weighted_prf(spark, sf_dir):
    return X.weighted_prf(_dholdout(spark, sf_dir), CELL_ALGO)


@query("exact_reliability_bins", W("dtest") + f"""
select stratum, outcome, algo, bin, n, sum_y, cast(sum_y as double) / n as mean_y,
  cast(cast(sum_u as varchar) as double) / (9007199254740992.0::double * n) as mean_p
from {O.exact_bins_sql('dtest', CELL_ALGO)} z where bin > 0""")
def q_exact_reliability_bins(spark, sf_dir):
    return X.reliability_bins(_dholdout(spark, sf_dir), CELL_ALGO)


@query("exact_ece", W("dtest") + f"select * from {O.exact_ece_sql('dtest', CELL_ALGO)} z")
def q_exact_ece(spark, sf_dir):
    return X.ece(_dholdout(spark, sf_dir), CELL_ALGO)


@query("resumed_phases", W("d_auc") + "select * from d_auc")
def q_resumed_phases(spark, sf_dir):
    """Hold-out AUC through two marked phase tables; a second run reads both by their marks and builds nothing."""
    root = scratch_path(spark, "phases")

    def no_build():
        raise RuntimeError("a committed phase was built again")

    def run(scored, metrics):
        p = PH.Phases(spark, root)
        rows = p.table("scored", scored, inputs=[f"{sf_dir}/{t}.parquet" for t in ("orders", "customer")], params={"seed": C.SEED})
        return p.table("auc", lambda: metrics(rows), after=["scored"])

    run(lambda: FX.scored_doubles(spark, sf_dir), lambda rows: X.auc(rows.where("is_test"), CELL_ALGO))
    return run(no_build, lambda rows: no_build())


@query("cv_table", W("d_auc", "d_prf", "d_best", "d_cv") + f"""
select b.stratum, b.outcome, b.best_algo, {O.r4('h.auc')} as ho_auc, {O.r4('p.f1')} as ho_f1,
  {O.r4('p.precision')} as ho_precision, {O.r4('p.recall')} as ho_recall,
  c.cv_auc_mean, c.cv_auc_std, c.cv_f1_mean, c.cv_f1_std, c.cv_precision_mean, c.cv_precision_std, c.cv_recall_mean, c.cv_recall_std,
  {O.r4('l.auc')} as base_ho_auc, lc.cv_auc_mean as base_cv_auc,
  {O.r4(O.r4('h.auc') + ' - ' + O.r4('l.auc'))} as auc_vs_baseline
from d_best b
left join d_auc h on h.stratum = b.stratum and h.outcome = b.outcome and h.algo = b.best_algo
left join d_prf p on p.stratum = b.stratum and p.outcome = b.outcome and p.algo = b.best_algo
left join d_cv c on c.stratum = b.stratum and c.outcome = b.outcome and c.algo = b.best_algo
left join d_auc l on l.stratum = b.stratum and l.outcome = b.outcome and l.algo = '{BASE}'
left join d_cv lc on lc.stratum = b.stratum and lc.outcome = b.outcome and lc.algo = '{BASE}'""")
def q_cv_table(spark, sf_dir):
    """Per cell: the best algorithm's hold-out and fold AUC, F1, P, R, the baseline's AUCs and the difference."""
    rows = SK.parquet_roundtrip(FX.scored_doubles(spark, sf_dir), scratch_path(spark, "cv-scored"))
    holdout = X.cell_metrics(rows.where("is_test"), CELL_ALGO)
    keys = CELL_ALGO + ["fold"]
    folds = X.cell_metrics(rows, keys).select(*keys, "auc", "f1", "precision", "recall")
    return X.cv_table(holdout, CMP.cv_summary(folds, CELL_ALGO), CMP.best_algo(holdout, CELL, _algos(spark)), CELL, BASE)


def _fold_metrics(spark, sf_dir):
    s = FX.scored(spark, sf_dir)
    keys = CELL_ALGO + ["fold"]
    a = M.auc(s, keys).select(*keys, "auc")
    p = M.weighted_prf(s, keys).drop("n")
    return a.join(p, keys)


def _cv(spark, sf_dir):
    return CMP.cv_summary(_fold_metrics(spark, sf_dir), CELL_ALGO)


@query("cv_summary", W("cv") + """
select *, printf('%.4f +- %.4f', cv_auc_mean, cv_auc_std) as cv_auc_text from cv""")
def q_cv_summary(spark, sf_dir):
    """5-fold CV per (cell, algo): mean and population std of AUC, F1, P, R."""
    return _cv(spark, sf_dir)


@query("cv_vs_holdout", W("cv", "ho_auc") + f"""
select c.stratum, c.outcome, c.algo, c.cv_auc_mean, c.cv_auc_std, {O.r4('h.auc')} as ho_auc
from cv c left join ho_auc h using (stratum, outcome, algo)""")
def q_cv_vs_holdout(spark, sf_dir):
    """CV summary with the hold-out AUC looked up by (cell, algo)."""
    return CMP.cv_vs_holdout(_cv(spark, sf_dir), M.auc(_holdout(spark, sf_dir), CELL_ALGO), CELL_ALGO)


CV_GAP_SQL = f"""
, cvg as (select c.stratum, c.outcome, c.algo, {O.r4('h.auc')} as ho_auc, c.cv_auc_mean,
            {O.r4('abs(c.cv_auc_mean - ' + O.r4('h.auc') + ')')} as gap
          from cv c join best b on c.stratum = b.stratum and c.outcome = b.outcome and c.algo = b.best_algo
          left join ho_auc h on h.stratum = c.stratum and h.outcome = c.outcome and h.algo = c.algo)
"""


@query("cv_gap", W("cv", "ho_auc", "best") + CV_GAP_SQL + f"""
select *, {O.judge_sql('gap', 'G2_cv_gap')} as verdict from cvg""")
def q_cv_gap(spark, sf_dir):
    """Robustness: |CV mean - hold-out| AUC of the best algorithm, with verdict."""
    a = M.auc(_holdout(spark, sf_dir), CELL_ALGO)
    return CMP.cv_gap(_cv(spark, sf_dir), a, CMP.best_algo(a, CELL, _algos(spark)), CELL)


def _fair_cells(spark, sf_dir):
    return FAIR.fairness_cells(_best_scored(spark, sf_dir).where(F.col("is_test")), CELL)


@query("fairness_cells", W("fair_cells") + "select * from fair_cells")
def q_fairness_cells(spark, sf_dir):
    """Per-cell hold-out AUC, TPR, FPR, ECE and n of the best algorithm."""
    return _fair_cells(spark, sf_dir)


FAIR_GAPS_SQL = f"""
, fg0 as (select outcome, cast(count(*) as bigint) as n_strata,
            {O.r4('max(auc) - min(auc)')} as delta_auc, {O.r4('max(tpr) - min(tpr)')} as delta_tpr,
            {O.r4('max(fpr) - min(fpr)')} as delta_fpr, {O.r4('max(ece) - min(ece)')} as delta_ece
          from fair_cells group by outcome having count(*) >= 2)
, fg as (select outcome, n_strata, delta_auc, {O.r4('delta_tpr + delta_fpr')} as eq_odds, delta_ece from fg0)
"""


@query("fairness_gaps", W("fair_cells") + FAIR_GAPS_SQL + f"""
select outcome, n_strata, delta_auc, {O.judge_sql('delta_auc', 'G1_delta_auc')} as auc_verdict,
  eq_odds, {O.judge_sql('eq_odds', 'G1_eq_odds')} as eq_odds_verdict,
  delta_ece, {O.judge_sql('delta_ece', 'G1_calib_ece')} as ece_verdict
from fg""")
def q_fairness_gaps(spark, sf_dir):
    """AUC, equalized-odds and ECE gaps across strata with verdicts."""
    return FAIR.fairness_gaps(_fair_cells(spark, sf_dir))


@query("fairness_chart", W("fair_cells", "strata") + """
, grid as (select s.stratum, s.stratum_order, o.outcome from strata s
           cross join (values ('Diabetes'), ('Hypertension')) as o(outcome))
, rng as (select outcome, min(auc) as auc_min, max(auc) as auc_max, """ + O.r4("max(auc) - min(auc)") + """ as delta_auc
          from fair_cells where auc > 0 group by outcome having count(*) >= 2)
select g.outcome, g.stratum, g.stratum_order, f.auc, f.tpr, f.fpr, r.auc_min, r.auc_max, r.delta_auc,
  """ + O.judge_sql("r.delta_auc", "G1_delta_auc") + """ as status
from grid g left join fair_cells f on f.stratum = g.stratum and f.outcome = g.outcome
left join rng r on r.outcome = g.outcome""")
def q_fairness_chart(spark, sf_dir):
    """Chart table: every stratum in order, AUC / TPR / FPR, range of non-missing AUC."""
    return FAIR.fairness_chart(_fair_cells(spark, sf_dir), C.strata_dim(spark), list(FX.OUTCOME_CODES))


TEMPORAL_SQL = f"""
, tp as (select stratum, outcome, algo, y, p6, 'holdout' as part from best_scored where is_test
         union all
         select stratum, outcome, algo, y, p6, 'temporal' as part from best_scored where year >= {FX.TEMPORAL_CUT})
, ta as (select * from {O.auc_sql('tp', CELL_ALGO + ['part'])} z)
, tg as (select h.stratum, h.outcome, h.algo, {O.r4('h.auc')} as ho_auc, {O.r4('t.auc')} as temporal_auc,
           t.n as n_temporal, {O.r4('abs(h.auc - t.auc)')} as gap
         from ta h join ta t on h.stratum = t.stratum and h.outcome = t.outcome and h.algo = t.algo
         where h.part = 'holdout' and t.part = 'temporal' and t.n >= {C.TEMPORAL_MIN_ROWS}
           and t.n_pos >= {C.TEMPORAL_MIN_POSITIVES} and t.n_neg > 0)
"""


@query("temporal_gap", W("best_scored") + TEMPORAL_SQL + f"""
select *, {O.judge_sql('gap', 'G2_temporal_gap')} as verdict from tg""")
def q_temporal_gap(spark, sf_dir):
    """Hold-out vs latest-year AUC of the best algorithm, guarded, with verdict."""
    return FAIR.temporal_gap(_best_scored(spark, sf_dir), CELL, FX.TEMPORAL_CUT)


# ---------------------------------------------------------------------------
# 3. Attribution summaries (stand-in: exact linear Shapley values on the sample)
# ---------------------------------------------------------------------------

from stratarisk.operators import attribution as AT  # noqa: E402
from stratarisk.operators import grade as GR  # noqa: E402
from stratarisk.operators import tiled as TL  # noqa: E402
from stratarisk.operators import perturb as PT  # noqa: E402
from stratarisk.operators import governance as GOV  # noqa: E402
from stratarisk.functions.scalar import round_half_up  # noqa: E402

STRATA_NAMES = [s[0] for s in C.STRATA]
OUTCOMES = list(FX.OUTCOME_CODES)


def _sample(spark, sf_dir):
    test = FX.split_cells(spark, sf_dir).where(F.col("is_test"))
    s = K.sample_n_per_group(test, CELL, "id", C.SHAP_SAMPLE, max_groups=FX.n_cells(spark))
    return s.withColumnRenamed("id", "row_id")


def _phi(spark, sf_dir):
    return AT.linear_shapley(_sample(spark, sf_dir), CELL, FX.STANDIN_ATTRIBUTION,
                             carry=["sample_rank"])


def _imp(spark, sf_dir):
    return AT.feature_importance(_phi(spark, sf_dir), CELL)


def _r6(c):
    return round_half_up(c, 6)


def _coef_case(feature: str) -> str:
    return "case outcome " + " ".join(
        f"when '{o}' then {dict(v).get(feature, 0.0)}" for o, v in FX.STANDIN_ATTRIBUTION.items()) + " end"


_FEATS = sorted({f for v in FX.STANDIN_ATTRIBUTION.values() for f, _ in v})

SQL_EXTRA.update({
    "samp": (["split"], f"""
        select * from (select id as row_id, stratum, outcome, num_a, num_b, cat_a, age,
          row_number() over (partition by stratum, outcome order by {hash_sql('id', 'sample')}, id) as sample_rank
          from split where is_test) z where sample_rank <= {C.SHAP_SAMPLE}"""),
    "phil": (["samp"], " union all ".join(
        f"select row_id, stratum, outcome, sample_rank, '{f}' as feature, cast({f} as double) as x, "
        f"{_coef_case(f)} as c from samp" for f in _FEATS)),
    "phi": (["phil"], """
        select p.row_id, p.stratum, p.outcome, p.sample_rank, p.feature, p.c * (p.x - m.mu) as phi, p.x
        from phil p join (select stratum, outcome, feature, avg(x) as mu from phil group by all) m
          using (stratum, outcome, feature)"""),
    "imp": (["phi"], """
        select stratum, outcome, feature, avg(abs(phi)) as mean_abs, cast(count(*) as bigint) as n
        from phi group by stratum, outcome, feature"""),
    "hhi": (["imp"], """
        select stratum, outcome, sum((mean_abs / tot) * (mean_abs / tot)) as hhi, cast(count(*) as bigint) as n_features
        from (select *, sum(mean_abs) over (partition by stratum, outcome) as tot from imp) z
        where tot > 0 group by stratum, outcome"""),
    "boot": (["phi"], f"""
        select stratum, outcome, b, sum((mean_abs / tot) * (mean_abs / tot)) as hhi from (
          select *, sum(mean_abs) over (partition by stratum, outcome, b) as tot from (
            select d.stratum, d.outcome, d.b, p.feature, sum(d.m * abs(p.phi)) / max(d.n) as mean_abs
            from (select stratum, outcome, n, b, idx, count(*) as m from (
                    select stratum, outcome, n, b,
                      cast(floor({O.uniform_sql('stratum', 'outcome', 'cast(b as varchar)', 'cast(j as varchar)', "'boot'", "'42'")} * n) + 1 as bigint) as idx
                    from (select stratum, outcome, n, b, unnest(generate_series(1, n)) as j from (
                            select stratum, outcome, n, unnest(generate_series(1, {C.N_BOOTSTRAP})) as b
                            from (select stratum, outcome, count(distinct sample_rank) as n from phi group by all) s0) s1) s2) s3
                  group by all) d
            join phi p on p.stratum = d.stratum and p.outcome = d.outcome and p.sample_rank = d.idx
            group by d.stratum, d.outcome, d.b, p.feature) z) y
        where tot > 0 group by stratum, outcome, b"""),
    "transparency": (["hhi", "boot"], f"""
        select h.stratum, h.outcome, {O.r4('h.hhi')} as hhi, {O.r4('q.lo')} as hhi_ci_lo, {O.r4('q.hi')} as hhi_ci_hi,
          {O.judge_sql(O.r4('h.hhi'), 'G3_hhi')} as verdict
        from hhi h left join (select stratum, outcome, quantile_cont(hhi, 0.025) as lo, quantile_cont(hhi, 0.975) as hi
                              from boot group by all) q using (stratum, outcome)"""),
})


@query("feature_importance", W("imp") + "select stratum, outcome, feature, "
       + O.r4("mean_abs", 6) + " as mean_abs, n from imp")
def q_feature_importance(spark, sf_dir):
    """Mean |attribution| per cell and feature."""
    i = _imp(spark, sf_dir)
    return i.select(*CELL, "feature", _r6("mean_abs").alias("mean_abs"), "n")


@query("hhi", W("hhi") + f"select stratum, outcome, {O.r4('hhi')} as hhi, n_features from hhi")
def q_hhi(spark, sf_dir):
    """Concentration (HHI) of attribution importance per cell."""
    h = AT.hhi(_phi(spark, sf_dir), CELL)
    return h.select(*CELL, round_half_up("hhi").alias("hhi"), "n_features")


@query("hhi_bootstrap", W("transparency") + "select * from transparency")
def q_hhi_bootstrap(spark, sf_dir):
    """Transparency: HHI with a 200-replicate multinomial bootstrap 95 % interval."""
    return AT.hhi_interval(_phi(spark, sf_dir), CELL, "sample_rank")


@query("hhi_bootstrap_splits")
def q_hhi_bootstrap_splits(spark, sf_dir):
    """HHI with its interval over all hold-out rows of a cell, resampled exactly by binomial splits."""
    test = FX.split_cells(spark, sf_dir).where("is_test")
    ranked = K.hash_rank(test, CELL, "id", "resample", out="sample_rank", size_out=None, max_groups=FX.n_cells(spark)).withColumnRenamed("id", "row_id")
    phi = AT.linear_shapley(ranked, CELL, FX.STANDIN_ATTRIBUTION, carry=["sample_rank"])
    return AT.hhi_interval(phi, CELL, "sample_rank", method="splits")


@query("top_features", W("imp") + f"""
select outcome, rank, feature, {O.r4('importance', 6)} as importance from (
  select *, row_number() over (partition by outcome order by importance desc, feature) as rank from (
    select i.outcome, i.feature, sum(i.mean_abs) / max(n.ns) as importance
    from imp i join (select outcome, count(distinct stratum) as ns from imp group by outcome) n using (outcome)
    group by i.outcome, i.feature) z) y where rank <= 10""")
def q_top_features(spark, sf_dir):
    """Top-10 features per outcome by mean importance over strata (missing = 0)."""
    t = AT.top_features_overall(_imp(spark, sf_dir), "outcome", "stratum", 10)
    return t.select("outcome", "rank", "feature", _r6("importance").alias("importance"))


@query("top_features_per_cell", W("imp") + f"""
select stratum, outcome, rank, feature, {O.r4('mean_abs', 6)} as mean_abs from (
  select *, row_number() over (partition by stratum, outcome order by mean_abs desc, feature) as rank from imp) z
where rank <= 12""")
def q_top_features_per_cell(spark, sf_dir):
    t = AT.top_features_per_cell(_imp(spark, sf_dir), CELL, 12)
    return t.select(*CELL, "rank", "feature", _r6("mean_abs").alias("mean_abs"))


SQL_EXTRA.update({
    "border": (["samp", "best_scored"], """
        select stratum, outcome, row_id, p6, in_band from (
          select s.stratum, s.outcome, s.row_id, b.p6, b.p6 between 350000 and 650000 as in_band,
            row_number() over (partition by s.stratum, s.outcome
                               order by case when b.p6 between 350000 and 650000 then 0 else 1 end, s.sample_rank) as rn
          from samp s join best_scored b on b.row_id = s.row_id and b.stratum = s.stratum and b.outcome = s.outcome) z
        where rn = 1"""),
})


def _border(spark, sf_dir):
    s = _sample(spark, sf_dir).select("row_id", *CELL, "sample_rank")
    b = _best_scored(spark, sf_dir).select("row_id", *CELL, "p6")
    return AT.borderline_case(s.join(b, ["row_id"] + CELL), CELL, "sample_rank")


@query("borderline_case", W("border") + "select * from border")
def q_borderline_case(spark, sf_dir):
    """Per cell the first sampled row with 0.35 <= p <= 0.65 (else the first row)."""
    return _border(spark, sf_dir)


@query("waterfall_rows", W("border", "phi") + f"""
select stratum, outcome, row_id, rank, feature, {O.r4('phi', 6)} as phi, x from (
  select p.stratum, p.outcome, p.row_id, p.feature, p.phi, p.x,
    row_number() over (partition by p.stratum, p.outcome, p.row_id order by abs(p.phi) desc, p.feature) as rank,
    count(*) over (partition by p.stratum, p.outcome, p.row_id) as n
  from phi p join border b on b.stratum = p.stratum and b.outcome = p.outcome and b.row_id = p.row_id) z
where rank <= 11 or n <= 12
union all
select p.stratum, p.outcome, p.row_id, 12, 'other (' || count(*) || ' features)', {O.r4('sum(p.phi)', 6)}, null from (
  select p.*, row_number() over (partition by p.stratum, p.outcome, p.row_id order by abs(p.phi) desc, p.feature) as rank,
    count(*) over (partition by p.stratum, p.outcome, p.row_id) as n
  from phi p join border b on b.stratum = p.stratum and b.outcome = p.outcome and b.row_id = p.row_id) p
where rank > 11 and n > 12 group by p.stratum, p.outcome, p.row_id""")
def q_waterfall_rows(spark, sf_dir):
    """Waterfall data of each cell's borderline case (top contributions + remainder)."""
    b = _border(spark, sf_dir).select(*CELL, "row_id")
    one = _phi(spark, sf_dir).join(F.broadcast(b), CELL + ["row_id"])
    w = AT.waterfall_rows(one, CELL, 12)
    return w.select(*CELL, "row_id", "rank", "feature", _r6("phi").alias("phi"), "x")


@query("beeswarm_rows", W("imp", "phi") + f"""
, t as (select * from (select *, row_number() over (partition by stratum, outcome order by mean_abs desc, feature) as rank
        from imp) z where rank <= 12)
select p.stratum, p.outcome, p.row_id, t.rank, p.feature, {O.r4('p.phi', 6)} as phi,
  {O.r4("case when max(p.x) over w > min(p.x) over w then (p.x - min(p.x) over w) / (max(p.x) over w - min(p.x) over w) else 0.5 end", 6)} as x_scaled
from phi p join t on t.stratum = p.stratum and t.outcome = p.outcome and t.feature = p.feature
window w as (partition by p.stratum, p.outcome, p.feature)""")
def q_beeswarm_rows(spark, sf_dir):
    """Beeswarm data: phi and min-max scaled feature value for each cell's top features."""
    phi = _phi(spark, sf_dir)
    top = AT.top_features_per_cell(AT.feature_importance(phi, CELL), CELL, 12)
    b = AT.beeswarm_rows(phi, CELL, top)
    return b.select(*CELL, "row_id", "rank", "feature", _r6("phi").alias("phi"), _r6("x_scaled").alias("x_scaled"))


@query("importance_matrix", W("imp") + "select outcome, feature, " + ", ".join(
    f"coalesce(max(case when stratum = '{s}' then {O.r4('mean_abs', 6)} end), 0.0) as {s}" for s in STRATA_NAMES)
    + " from imp group by outcome, feature")
def q_importance_matrix(spark, sf_dir):
    """feature x stratum importance pivot per outcome, missing = 0."""
    i = _imp(spark, sf_dir).withColumn("mean_abs", _r6("mean_abs"))
    return AT.importance_matrix(i, "outcome", "stratum", STRATA_NAMES)


# ---------------------------------------------------------------------------
# 4. Risk grades: two scores per row (each outcome's best model), k-means
# ---------------------------------------------------------------------------

def _points(spark, sf_dir):
    """Whole-stratum rows with the best model's score for each outcome (x1, x2)."""
    best = _best(spark, sf_dir)
    wide = (best.groupBy("stratum").pivot("outcome", OUTCOMES).agg(F.first("best_algo"))
            .where(F.col(OUTCOMES[0]).isNotNull() & F.col(OUTCOMES[1]).isNotNull())
            .select("stratum", F.col(OUTCOMES[0]).alias("_a1"), F.col(OUTCOMES[1]).alias("_a2")))
    sc = FX.stratified_cohort(spark, sf_dir).join(F.broadcast(wide), "stratum")
    return sc.select("stratum", F.col("id").alias("row_id"),
                     FX.standin_score_case("_a1").alias("x1"), FX.standin_score_case("_a2").alias("x2"),
                     F.col(OUTCOMES[0]).alias("y1"), F.col(OUTCOMES[1]).alias("y2"))


def _one_step(spark, sf_dir):
    pts = _points(spark, sf_dir)
    a0 = GR.assign(pts, FX.fixed_centres(spark))
    upd = GR.update(a0)
    return pts, a0, upd


def _case_p6(col):
    return "case " + col + " " + " ".join(
        f"when '{a}' then {FX.p6_sql(lg)}" for a, _, lg in FX.STANDIN_SCORERS) + " end"


SQL_EXTRA.update({
    "bw": (["best"], f"""
        select stratum, max(case when outcome = '{OUTCOMES[0]}' then best_algo end) as a1,
                        max(case when outcome = '{OUTCOMES[1]}' then best_algo end) as a2
        from best group by stratum having a1 is not null and a2 is not null"""),
    "pts": (["scohort", "bw"], f"""
        select c.stratum, c.id as row_id, {_case_p6('bw.a1')} as x1, {_case_p6('bw.a2')} as x2,
          c."{OUTCOMES[0]}" as y1, c."{OUTCOMES[1]}" as y2
        from scohort c join bw using (stratum)"""),
    "ctr0": (["strata"], "select s.stratum, 1 as init, c.cluster, cast(c.c1 as double) as c1, cast(c.c2 as double) as c2 "
             "from strata s cross join (values " + ", ".join(f"({k}, {int(a)}, {int(b)})" for k, a, b in FX.FIXED_CENTRES)
             + ") as c(cluster, c1, c2)"),
    "asg0": (["pts", "ctr0"], """
        select * from (select p.*, c.init, c.cluster, (p.x1 - c.c1) * (p.x1 - c.c1) + (p.x2 - c.c2) * (p.x2 - c.c2) as d2,
          row_number() over (partition by p.stratum, p.row_id order by
            (p.x1 - c.c1) * (p.x1 - c.c1) + (p.x2 - c.c2) * (p.x2 - c.c2), c.cluster) as rn
          from pts p join ctr0 c using (stratum)) z where rn = 1"""),
    "upd": (["asg0"], """
        select stratum, init, cluster, cast(count(*) as bigint) as n, sum(cast(x1 as double)) / count(*) as c1,
          sum(cast(x2 as double)) / count(*) as c2, sum(d2) as inertia6
        from asg0 group by stratum, init, cluster"""),
    "rank1": (["upd"], """
        select *, cast(row_number() over (partition by stratum order by c1 + c2, cluster) as int) as grade from upd"""),
    "graded": (["pts", "rank1"], """
        select * from (select p.*, c.cluster, c.grade,
          row_number() over (partition by p.stratum, p.row_id order by
            (p.x1 - c.c1) * (p.x1 - c.c1) + (p.x2 - c.c2) * (p.x2 - c.c2), c.cluster) as rn
          from pts p join rank1 c using (stratum)) z where rn = 1"""),
    "gsum": (["graded"], f"""
        select g.stratum, g.grade, l.grade_label, g.n, {O.r4('g.n / sum(g.n) over (partition by g.stratum)')} as share,
          {O.r4('g.p1')} as prevalence_1, {O.r4('g.p2')} as prevalence_2,
          {O.r4('g.m1')} as mean_p_1, {O.r4('g.m2')} as mean_p_2, l.policy
        from (select stratum, grade, cast(count(*) as bigint) as n, cast(sum(y1) as double) / count(*) as p1,
                cast(sum(y2) as double) / count(*) as p2, cast(sum(x1) as double) / (1e6 * count(*)) as m1,
                cast(sum(x2) as double) / (1e6 * count(*)) as m2 from graded group by stratum, grade) g
        left join (values {", ".join(f"({g}, '{lab}', '{pol}')" for g, lab, pol in C.GRADES)}) as l(grade, grade_label, policy)
          using (grade)"""),
})


@query("kmeans_assign", W("asg0") + "select stratum, row_id, init, cluster, d2 from asg0")
def q_kmeans_assign(spark, sf_dir):
    """Nearest-centre assignment of each row's two scores (fixed starting centres)."""
    a = GR.assign(_points(spark, sf_dir), FX.fixed_centres(spark))
    return a.select("stratum", "row_id", "init", "cluster", "d2")


@query("kmeans_update", W("upd") + "select * from upd")
def q_kmeans_update(spark, sf_dir):
    """One Lloyd update: member means and inertia per (stratum, init, cluster)."""
    return _one_step(spark, sf_dir)[2]


@query("grade_rank", W("rank1") + "select stratum, init, cluster, c1, c2, grade from rank1")
def q_grade_rank(spark, sf_dir):
    """Grade 1..k by ascending centre sum."""
    return GR.grade_rank(_one_step(spark, sf_dir)[2]).select("stratum", "init", "cluster", "c1", "c2", "grade")


def _graded(spark, sf_dir):
    pts, _, upd = _one_step(spark, sf_dir)
    return GR.apply_grades(pts, GR.grade_rank(upd))


def _grade_summary(spark, sf_dir):
    return GR.grade_summary(_graded(spark, sf_dir), C.grades_dim(spark))


@query("grade_summary", W("gsum") + "select * from gsum")
def q_grade_summary(spark, sf_dir):
    """Per stratum and grade: n, share, prevalence and mean score of both outcomes, policy text."""
    return _grade_summary(spark, sf_dir)


@query("grade_monotone", W("gsum") + f"""
, lg as (select stratum, grade, '{OUTCOMES[0]}' as outcome, prevalence_1 as prev from gsum
         union all select stratum, grade, '{OUTCOMES[1]}', prevalence_2 from gsum)
select stratum, outcome, bool_and(pv is null or prev >= pv) as monotone, cast(count(*) as bigint) as n_grades
from (select *, lag(prev) over (partition by stratum, outcome order by grade) as pv from lg) z
group by stratum, outcome""")
def q_grade_monotone(spark, sf_dir):
    """Does prevalence rise with grade in every stratum (the published claim)?"""
    return GR.grade_monotone(_grade_summary(spark, sf_dir), "stratum",
                             {OUTCOMES[0]: "prevalence_1", OUTCOMES[1]: "prevalence_2"})


@query("partitioned_grades", W("graded") + "select row_id, stratum, grade from graded")
def q_partitioned_grades(spark, sf_dir):
    """Graded rows written as one folder per stratum and read back."""
    g = _graded(spark, sf_dir).select("row_id", "stratum", "grade")
    path = scratch_path(spark, "grades")
    SK.write_per_stratum(g, path)
    return SK.read_per_stratum(spark, path).select("row_id", "stratum", "grade")


@query("kmeans_grade")
def q_kmeans_grade(spark, sf_dir):
    """Full grouped k-means (k = 3, 10 inits, best by inertia), graded rows."""
    pts = GR.materialize_points(_points(spark, sf_dir))
    cent, _ = TL.lloyd(pts, ks=(3,), n_init=10, max_iter=300)
    return GR.apply_grades(pts, GR.grade_rank(cent)).select("stratum", "row_id", "grade", "x1", "x2")


@query("elbow")
def q_elbow(spark, sf_dir):
    """Best-of-10-inits inertia for k = 2..7 per stratum."""
    return TL.elbow(GR.materialize_points(_points(spark, sf_dir)), range(2, 8), n_init=10, max_iter=300)


# ---------------------------------------------------------------------------
# 5. Perturbation robustness (hash-Gaussian noise, rescoring, AUC drop)
# ---------------------------------------------------------------------------

def _z_sql(row: str, feat: str, rep: str) -> str:
    base = [f"cast({row} as varchar)", f"'{feat}'", f"cast({rep} as varchar)", "'noise'", "'42'"]
    u1 = O.uniform_sql(*base, "'u1'")
    u2 = O.uniform_sql(*base, "'u2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2}))"


def _noisy_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    sds = ", ".join(f"stddev_samp(cast({f} as double)) as sd_{f}" for f in FX.FEATURES)
    cols = ", ".join(
        f"case when s.sd_{f} > 0 then cast(t.{f} as double) + 0.1 * s.sd_{f} * {_z_sql('t.row_id', f, 'r.repeat')} "
        f"else cast(t.{f} as double) end as {f}" for f in FX.FEATURES)
    tk = ", ".join(f"t.{c}" for c in keys)
    on = " and ".join(f"s.{c} = t.{c}" for c in keys)
    return f"""(select t.row_id, {tk}, t.y, cast(r.repeat as int) as repeat, {cols}
      from {src} t join (select {k}, {sds} from {src} group by {k}) s on {on}
      cross join range(1, {C.PERTURB_REPEATS + 1}) as r(repeat))"""


SQL_EXTRA.update({
    "test_rows": (["split"], "select id as row_id, * exclude (id) from split where is_test"),
    "noisy_best": (["best_test"], f"select * from {_noisy_sql('best_test', CELL_ALGO)} z"),
    "noisy_scored": (["noisy_best"], f"select *, {_case_p6('algo')} as p6 from noisy_best"),
    "pdrop": (["best_test", "noisy_scored"], f"""
        select b.stratum, b.outcome, b.algo, {O.r4('max(b.auc)')} as auc_base,
          {O.r4('avg(abs(b.auc - n.auc))')} as drop_mean, {O.r4('stddev_pop(abs(b.auc - n.auc))')} as drop_std,
          cast(count(*) as bigint) as n_repeats,
          {O.judge_sql(O.r4('avg(abs(b.auc - n.auc))'), 'G2_perturb_drop')} as verdict
        from {O.auc_sql('best_test', CELL_ALGO)} b
        join {O.auc_sql('noisy_scored', CELL_ALGO + ['repeat'])} n using (stratum, outcome, algo)
        group by b.stratum, b.outcome, b.algo"""),
})


def _test_rows(spark, sf_dir):
    return FX.split_cells(spark, sf_dir).where(F.col("is_test")).withColumnRenamed("id", "row_id")


@query("feature_std", W("test_rows") + " union all ".join(
    f"select stratum, outcome, '{f}' as feature, {O.r4(f'stddev_samp(cast({f} as double))', 6)} as std "
    f"from test_rows group by stratum, outcome" for f in FX.FEATURES))
def q_feature_std(spark, sf_dir):
    """Per-feature sample std on each cell's hold-out rows (one aggregate)."""
    s = PT.feature_std(_test_rows(spark, sf_dir), CELL, FX.FEATURES)
    return s.select(*CELL, "feature", _r6("std").alias("std"))


@query("perturb_features", W("test_rows") + "select row_id, stratum, outcome, repeat, " + ", ".join(
    f"{O.r4(f, 6)} as {f}" for f in FX.FEATURES) + f" from {_noisy_sql('test_rows', CELL)} z")
def q_perturb_features(spark, sf_dir):
    """Five noisy copies of every hold-out row: x + 0.10 * std * N(0, 1) per feature."""
    n = PT.perturb_features(_test_rows(spark, sf_dir), CELL, FX.FEATURES)
    return n.select("row_id", *CELL, "repeat", *[_r6(f).alias(f) for f in FX.FEATURES])


def _pdrop(spark, sf_dir):
    rows = _best_scored(spark, sf_dir).where(F.col("is_test"))
    return PT.perturb_run(rows.drop("p6"), CELL_ALGO, FX.FEATURES, lambda d: FX.standin_score_case("algo"))


@query("perturb_drop", W("pdrop") + "select * from pdrop")
def q_perturb_drop(spark, sf_dir):
    """Noise -> rescore with the cell's best model -> AUC drop mean / std over 5 repeats."""
    return _pdrop(spark, sf_dir)


@query("perturb_matrix", W("pdrop", "strata") + "select s.stratum, s.stratum_order, " + ", ".join(
    f"max(case when p.outcome = '{o}' then p.drop_mean end) as drop_{o}, "
    f"case when max(case when p.outcome = '{o}' then p.drop_mean end) is null then null "
    f"when max(case when p.outcome = '{o}' then p.drop_mean end) < 0.03 then 'good' "
    f"when max(case when p.outcome = '{o}' then p.drop_mean end) < 0.05 then 'caution' else 'risk' end as status_{o}"
    for o in OUTCOMES) + " from strata s left join pdrop p using (stratum) group by s.stratum, s.stratum_order")
def q_perturb_matrix(spark, sf_dir):
    """stratum x outcome drop heat-map table with strict-limit status."""
    return PT.perturb_matrix(_pdrop(spark, sf_dir), C.strata_dim(spark), OUTCOMES)


# ---------------------------------------------------------------------------
# 6. Governance: verdict tables, composite score, retraining triggers
# ---------------------------------------------------------------------------

from stratarisk.plans.study import Study, TableStudy  # noqa: E402
from stratarisk.functions.scalar import judge_metric, norm_score, parse_mean  # noqa: E402


def _d(x) -> str:
    return f"cast({x!r} as double)"


def _norm_sql(v: str, good, bad, floor) -> str:
    g, b, fl = _d(good), _d(bad), _d(floor)
    return (f"(case when {v} <= {g} then {_d(1.0)} when {v} >= {b} then {fl} "
            f"else {fl} + ({_d(1.0)} - {fl}) * ({_d(1.0)} - ({v} - {g}) / ({b} - {g})) end)")


_CARD_VALUES = ", ".join(f"('{i}', {str(m).lower()})" for i, m in C.MODEL_CARD_CHECKLIST)
_GOV_LONG_ROWS = GOV.GOVERNANCE_ROWS


def _long_sql() -> str:
    parts = []
    col = {"G1_delta_auc": "delta_auc", "G1_eq_odds": "eq_odds", "G1_calib_ece": "delta_ece",
           "G2_cv_gap": "cv_gap", "G2_temporal_gap": "temporal_gap", "G2_perturb_drop": "perturb_drop",
           "G3_hhi": "hhi", "G4_model_card": "card_score"}
    for principle, label, key, limit, basis, note in _GOV_LONG_ROWS:
        c = col[key]
        v = O.r4(c)
        if key == "G3_hhi":
            text = f"case when hhi is not null then printf('%.4f [%.4f-%.4f]', {O.r4('hhi')}, {O.r4('hhi_lo')}, {O.r4('hhi_hi')}) end"
        elif key == "G4_model_card":
            text = "printf('%.2f', card_score)"
        elif key == "G2_temporal_gap":
            text = f"case when temporal_gap is null then 'insufficient data' else printf('%.4f', {v}) end"
        else:
            text = f"case when {v} is not null then printf('%.4f', {v}) end"
        miss = "n/a" if key == "G2_temporal_gap" else "-"
        parts.append(f"""select outcome, '{principle}' as principle, '{label}' as metric, '{key}' as threshold,
          {v} as value, coalesce({text}, '-') as value_text, '{limit}' as "limit",
          coalesce({O.judge_sql(c, key)}, '{miss}') as verdict, '{basis}' as basis, '{note}' as note from ind""")
    return " union all ".join(parts)


SQL_EXTRA.update({
    "fg_all": (["fair_cells"], "select * from fair_cells"),
    "card": ([], f"""
        select {O.r4('count_if(met) / count(*)', 2)} as card_score, cast(count_if(met) as bigint) as n_met,
          cast(count(*) as bigint) as n_total, printf('%d/%d', count_if(met), count(*)) as met_text,
          coalesce(string_agg(item, '; ' order by item) filter (where not met), '') as unmet_items
        from (values {_CARD_VALUES}) as t(item, met)"""),
})

def m4(c: str) -> str:
    """Exact mean of 4-dp values (integer units), as in mean_of_rounded."""
    return f"((cast(sum(cast(round({c} * 10000.0) as bigint)) as double) / count({c})) / 10000.0)"


_IND_SQL = (f"""
, fgx as (select * from fg)
, indx as (select o.outcome, fg.delta_auc, fg.eq_odds, fg.delta_ece, cg.cv_gap, tt.temporal_gap,
            pd.perturb_drop, tr.hhi, tr.hhi_lo, tr.hhi_hi, card.card_score, card.met_text, card.unmet_items
          from (values {", ".join(f"('{o}')" for o in OUTCOMES)}) as o(outcome)
          left join fg using (outcome)
          left join (select outcome, {m4('gap')} as cv_gap from cvg group by outcome) cg using (outcome)
          left join (select outcome, {m4('gap')} as temporal_gap from tg group by outcome) tt using (outcome)
          left join (select outcome, {m4('drop_mean')} as perturb_drop from pdrop group by outcome) pd using (outcome)
          left join (select outcome, {m4('hhi')} as hhi, {m4('hhi_ci_lo')} as hhi_lo, {m4('hhi_ci_hi')} as hhi_hi
                     from transparency group by outcome) tr using (outcome)
          cross join card)
""")


def GW(*extra_names):
    """WITH clause holding every governance input, then fg / cvg / tg / indx."""
    base = W("fair_cells", "cv", "ho_auc", "best", "best_scored", "pdrop", "transparency", "card", "strata",
             *extra_names)
    return base + FAIR_GAPS_SQL + CV_GAP_SQL + TEMPORAL_SQL + _IND_SQL.replace("indx", "ind")


def _composite_sql() -> str:
    cols, terms = [], []
    for name, weight, good, bad, default in C.COMPOSITE:
        if name == "model_card":
            s = f"least({_d(1.0)}, card_score)"
        else:
            s = _norm_sql(f"coalesce({name}, {_d(default)})", good, bad, C.COMPOSITE_FLOOR)
        cols.append((name, s))
        terms.append(f"{s} * {_d(weight)}")
    raw = terms[0]
    for t in terms[1:]:
        raw = f"({raw} + {t})"
    sel = ", ".join(f"{O.r4(s, 6)} as score_{n}" for n, s in cols)
    return f"""
, comp as (select outcome, {sel}, {O.r4(raw, 6)} as composite_raw, {O.r4(raw, 2)} as composite from ind)
"""


@query("governance_long", GW() + f"select * from ({_long_sql()}) z")
def q_governance_long(spark, sf_dir):
    """Long verdict table: 8 indicators x outcome with value, text, limit and verdict."""
    return GOV.governance_long(Study(spark, sf_dir, materialize=True).indicators)


@query("composite_score", GW() + _composite_sql() + f"""
select *, case when composite >= {C.COMPOSITE_GOOD} then 'good' when composite >= {C.COMPOSITE_CAUTION}
  then 'caution' else 'risk' end as band from comp""")
def q_composite_score(spark, sf_dir):
    """Weighted composite of normalised indicators per outcome, with band."""
    c = GOV.composite_score(Study(spark, sf_dir, materialize=True).indicators)
    return c.select("outcome", *[_r6(f"score_{n}").alias(f"score_{n}") for n, *_ in C.COMPOSITE],
                    _r6("composite_raw").alias("composite_raw"), "composite", "band")


@query("retrain_triggers", GW("cohort") + _composite_sql() + "," + _COUNTS_SQL + """
, mp as (select outcome, min(positives) as min_positives from counts group by outcome)
, tj as (select i.*, c.composite, m.min_positives from ind i left join comp c using (outcome)
         left join mp m using (outcome))
""" + " union all ".join(
    f"select outcome, '{t}' as trigger, '{m}' as metric, {O.r4(f'cast({m} as double)', 6)} as value, "
    f"'{op} {lim}' as condition, coalesce(cast({m} as double) {op} {lim}, false) as fired from tj"
    for t, m, op, lim in C.RETRAIN_TRIGGERS))
def q_retrain_triggers(spark, sf_dir):
    """Every retraining trigger evaluated per outcome (fired = active)."""
    st = Study(spark, sf_dir, materialize=True)
    t = GOV.retrain_triggers(st.indicators, GOV.composite_score(st.indicators), st.min_positives)
    return t.withColumn("value", _r6("value"))


@query("governance_wide", GW("phi") + """
select f.stratum, f.outcome, f.algo, f.auc, f.tpr, f.fpr, f.ece, f.n, c.gap as cv_gap, c.verdict as cv_verdict,
  t.hhi, t.hhi_ci_lo, t.hhi_ci_hi, t.verdict as hhi_verdict,
  e.stratum is not null as explanation_available, """ + str(C.CODE_PUBLIC).lower() + """ as code_public, card.card_score, p.drop_mean, p.verdict as perturb_verdict,
  g.temporal_auc, g.gap as temporal_gap, g.verdict as temporal_verdict
from fair_cells f cross join card
left join (select distinct stratum, outcome from phi) e using (stratum, outcome)
left join (select *, """ + O.judge_sql("gap", "G2_cv_gap") + """ as verdict from cvg) c using (stratum, outcome)
left join transparency t using (stratum, outcome)
left join pdrop p using (stratum, outcome)
left join (select *, """ + O.judge_sql("gap", "G2_temporal_gap") + """ as verdict from tg) g using (stratum, outcome)""")
def q_governance_wide(spark, sf_dir):
    """Cell-level table of every indicator with per-principle verdict columns."""
    st = Study(spark, sf_dir, materialize=True)
    accountable = GOV.accountability(st.fair_cells, st.phi, st.card, CELL)
    return GOV.governance_wide(st.fair_cells, st.cv_gap, st.transparency, accountable, st.perturb, st.temporal, CELL)


@query("accountability", W("fair_cells", "phi", "card") + f"""
select f.stratum, f.outcome, e.stratum is not null as explanation_available, {str(C.CODE_PUBLIC).lower()} as code_public,
  card.card_score, card.met_text, card.unmet_items,
  {O.judge_sql('card.card_score', 'G4_model_card')} as verdict
from fair_cells f left join (select distinct stratum, outcome from phi) e using (stratum, outcome) cross join card""")
def q_accountability(spark, sf_dir):
    """Per cell: explanation available, code public, model-card score and verdict."""
    st = Study(spark, sf_dir)
    return GOV.accountability(st.fair_cells, st.phi, st.card, CELL)


@query("model_card", W("fair_cells", "card") + f"""
select f.outcome, cast(count(*) as bigint) as n_cells, max(card.card_score) as card_score,
  max(card.n_met) as n_met, max(card.n_total) as n_total, max(card.met_text) as met_text,
  max(card.unmet_items) as unmet_items, {O.judge_sql('max(card.card_score)', 'G4_model_card')} as verdict
from fair_cells f cross join card group by f.outcome""")
def q_model_card(spark, sf_dir):
    """Model-card checklist score (met / total, unmet items) for each evaluated outcome."""
    st = Study(spark, sf_dir)
    card = st.card.first()
    g = st.fair_cells.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_cells"))
    return g.select("outcome", "n_cells", F.lit(float(card["card_score"])).alias("card_score"),
                    F.lit(int(card["n_met"])).cast("bigint").alias("n_met"),
                    F.lit(int(card["n_total"])).cast("bigint").alias("n_total"),
                    F.lit(card["met_text"]).alias("met_text"), F.lit(card["unmet_items"]).alias("unmet_items"),
                    F.lit(card["verdict"]).alias("verdict"))


_THR_VALUES = ", ".join(f"('{m}', {g}, {w}, {str(lb).lower()}, '{c}')" for m, g, w, lb, c in C.THRESHOLDS)


@query("threshold_dim", GW() + f"""
, gl as ({_long_sql()})
select t.metric, t.good, t.warn, t.low_best, t.cite,
  cast(count_if(gl.verdict = 'good') as bigint) as n_good,
  cast(count_if(gl.verdict = 'caution') as bigint) as n_caution,
  cast(count_if(gl.verdict = 'risk') as bigint) as n_risk
from (values {_THR_VALUES}) as t(metric, good, warn, low_best, cite)
left join gl on gl.threshold = t.metric
group by t.metric, t.good, t.warn, t.low_best, t.cite""")
def q_threshold_dim(spark, sf_dir):
    """Threshold definitions with how many outcome verdicts fell in each band."""
    gl = GOV.governance_long(Study(spark, sf_dir, materialize=True).indicators)
    cnt = gl.groupBy("threshold").agg(
        F.count_if(F.col("verdict") == "good").alias("n_good"),
        F.count_if(F.col("verdict") == "caution").alias("n_caution"),
        F.count_if(F.col("verdict") == "risk").alias("n_risk"))
    t = C.thresholds_dim(spark)
    j = t.join(cnt, t["metric"] == cnt["threshold"], "left")
    return j.select("metric", "good", "warn", "low_best", "cite",
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_good", "n_caution", "n_risk")])


@query("judge", W("test") + f"""
select stratum, outcome, algo, {O.r4('ece')} as ece, {O.judge_sql(O.r4('ece'), 'G1_calib_ece')} as verdict
from {O.ece_sql('test', CELL_ALGO)} z""")
def q_judge(spark, sf_dir):
    """Verdict (good / caution / risk, inclusive limits) of every cell-algorithm ECE."""
    e = M.ece(_holdout(spark, sf_dir), CELL_ALGO)
    return e.select(*CELL_ALGO, round_half_up("ece").alias("ece"),
                    judge_metric(round_half_up("ece"), "G1_calib_ece").alias("verdict"))


@query("norm_score", W("cv", "ho_auc", "best") + CV_GAP_SQL + f"""
select stratum, outcome, gap, {O.r4(_norm_sql('gap', 0.03, 0.06, 0.10), 6)} as score from cvg""")
def q_norm_score(spark, sf_dir):
    """Piecewise-linear normalised score of every cell's CV gap (good .03, bad .06, floor .10)."""
    st = Study(spark, sf_dir)
    g = st.cv_gap
    return g.select(*CELL, "gap", _r6(norm_score("gap", F.lit(0.03), F.lit(0.06), 0.10)).alias("score"))


@query("report_strings", W("cv", "best", "transparency", "strata") + """
select c.stratum, c.outcome, printf('%.4f +- %.4f', c.cv_auc_mean, c.cv_auc_std) as cv_auc_text,
  try_cast(trim(split_part(printf('%.4f +- %.4f', c.cv_auc_mean, c.cv_auc_std), '+-', 1)) as double) as cv_auc_parsed,
  printf('%.4f [%.4f-%.4f]', t.hhi, t.hhi_ci_lo, t.hhi_ci_hi) as hhi_text,
  printf('%d-%d years', s.age_min, s.age_max) as age_range
from cv c join best b on c.stratum = b.stratum and c.outcome = b.outcome and c.algo = b.best_algo
join transparency t on t.stratum = c.stratum and t.outcome = c.outcome
join strata s on s.stratum = c.stratum""")
def q_report_strings(spark, sf_dir):
    """Formatted report fields ('mean +- std', 'h [lo-hi]', 'a-b years') and the parse back."""
    st = Study(spark, sf_dir)
    b = st.best.select(*CELL, F.col("best_algo").alias("algo"))
    cv = st.cv.join(b, CELL_ALGO)
    j = cv.join(st.transparency, CELL).join(F.broadcast(C.strata_dim(spark)), "stratum")
    return j.select("stratum", "outcome", "cv_auc_text", parse_mean("cv_auc_text").alias("cv_auc_parsed"),
                    F.format_string("%.4f [%.4f-%.4f]", "hhi", "hhi_ci_lo", "hhi_ci_hi").alias("hhi_text"),
                    F.format_string("%d-%d years", "age_min", "age_max").alias("age_range"))


@query("cell_grid", W("ho_auc", "strata", "algos") + f"""
select s.stratum, o.outcome, a.algo, {O.r4('h.auc')} as auc, h.n
from strata s cross join (values {", ".join(f"('{o}')" for o in OUTCOMES)}) as o(outcome) cross join algos a
left join ho_auc h on h.stratum = s.stratum and h.outcome = o.outcome and h.algo = a.algo""")
def q_cell_grid(spark, sf_dir):
    """Every stratum x outcome x algorithm, empty combinations kept (null metrics)."""
    grid = FAIR.cell_grid(C.strata_dim(spark), OUTCOMES).select(
        "stratum", "outcome", F.explode(F.array(*[F.lit(a) for a in FX.STANDIN_ALGOS])).alias("algo"))
    a = M.auc(_holdout(spark, sf_dir), CELL_ALGO)
    return grid.join(a, CELL_ALGO, "left").select(*CELL_ALGO, round_half_up("auc").alias("auc"), "n")


# ---------------------------------------------------------------------------
# 7. Training with Spark ML (rows-only checks: trained models have no SQL oracle)
# ---------------------------------------------------------------------------

from stratarisk.operators import grid as GD  # noqa: E402
from stratarisk.operators import training as TR  # noqa: E402

# The study tunes with 20 trials per (cell, algorithm): ``hpo_trials``,
# ``hpo_boosted`` and ``hpo_nets`` run that search. The fit queries use the
# families' default parameters.
SEARCH_TRIALS = 20
TRAIN_FEATURES = FX.FEATURES


def _train_rows(spark, sf_dir):
    """The split rows as one cell-partitioned table; all fits, scores and folds of a query read it."""
    return TR.training_table(FX.split_cells(spark, sf_dir).withColumnRenamed("id", "row_id"), CELL)


def _cells():
    return [(s[0], o) for s in C.STRATA for o in OUTCOMES]


def _fit_and_evaluate(spark, sf_dir, algos, n_trials=0):
    rows = _train_rows(spark, sf_dir)
    res = TR.train_grid(rows, CELL, _cells(), algos, TRAIN_FEATURES, n_trials=n_trials)
    return rows, res, _grid_metrics(spark, rows, res)


def _no_metrics(grid):
    return grid.select(*CELL_ALGO, *[F.lit(None).cast(t).alias(c) for c, t in
                                     (("n", "bigint"), ("auc", "double"), ("f1", "double"), ("precision", "double"), ("recall", "double"))], "error")


def _grid_metrics(spark, rows, res):
    """Hold-out metrics of the whole grid; a cell without a model keeps its row, with the error."""
    grid = TR.grid_frame(spark, CELL, res)
    sc = TR.scored_holdout(rows, CELL, res)
    if sc is None:
        return _no_metrics(grid)
    met = M.cell_metrics(sc, CELL_ALGO).select(*CELL_ALGO, "n", *[round_half_up(c).alias(c) for c in ("auc", "f1", "precision", "recall")])
    return grid.join(met, CELL_ALGO, "left").select(*met.columns, "error")


def _holdout_set():
    return {"holdout": ~F.col("is_test")}


def _fold_sets():
    return {f"fold {f}": F.col("fold") != f for f in range(C.N_FOLDS)}


def _grouped_metrics(spark, rows, algos, trainings=None):
    """Hold-out metrics of the grid by grouped fits, a cell without a model keeping its row; and all scores, written once."""
    scores, errors = GD.grouped_scores(rows, CELL, _cells(), algos, TRAIN_FEATURES, trainings or _holdout_set())
    grid = spark.createDataFrame([(*c, a, errors.get((c, a))) for c in _cells() for a in algos], ", ".join(f"{c} string" for c in CELL_ALGO) + ", error string")
    if scores is None:
        return _no_metrics(grid), None
    scores = SK.parquet_roundtrip(scores, scratch_path(spark, "scores"))
    met = GD.exact_metrics(scores.where("training = 'holdout'"), CELL_ALGO).select(*CELL_ALGO, "n", *[round_half_up(c).alias(c) for c in ("auc", "f1", "precision", "recall")])
    return grid.join(met, CELL_ALGO, "left").select(*met.columns, "error"), scores


@query("train_lr")
def q_train_lr(spark, sf_dir):
    """Balanced logistic regression of all cells in one run of Newton steps, hold-out metrics."""
    return _grouped_metrics(spark, _train_rows(spark, sf_dir), ["LR"])[0]


@query("train_rf")
def q_train_rf(spark, sf_dir):
    """Random forest per cell with default parameters, hold-out metrics."""
    return _fit_and_evaluate(spark, sf_dir, ["RF"])[2]


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    """Both boosted families in every cell, grown side by side with default parameters, hold-out metrics."""
    return _grouped_metrics(spark, _train_rows(spark, sf_dir), ["LGBM", "XGB"])[0]


@query("train_mlp")
def q_train_mlp(spark, sf_dir):
    """Net (unweighted, L2 term, learning rate) in every cell, trained side by side, hold-out metrics."""
    return _grouped_metrics(spark, _train_rows(spark, sf_dir), ["MLP"])[0]


def _trials(spark, sf_dir, algos):
    found = GD.search(_train_rows(spark, sf_dir), CELL, _cells(), algos, TRAIN_FEATURES, n_trials=SEARCH_TRIALS)
    return spark.createDataFrame([(*t["cell"], t["algo"], t["trial"], t["params"], t["rung"], t["length"], t["auc"], t["best"]) for t in found],
                                 "stratum string, outcome string, algo string, trial int, params string, rung int, length int, auc double, best boolean")


@query("hpo_trials")
def q_hpo_trials(spark, sf_dir):
    """The forest's search in every cell: 20 trials, each grown to its drawn number of trees (``length``), and its inner AUC there."""
    return _trials(spark, sf_dir, ["RF"])


@query("hpo_boosted")
def q_hpo_boosted(spark, sf_dir):
    """The search of both boosted families in every cell, 20 trials each, grown to their drawn numbers of trees."""
    return _trials(spark, sf_dir, ["LGBM", "XGB"])


@query("hpo_nets")
def q_hpo_nets(spark, sf_dir):
    """The net's search in every cell: 20 trials of layers, units, L2 strength and learning rate."""
    return _trials(spark, sf_dir, ["MLP"])


@query("train_grid")
def q_train_grid(spark, sf_dir):
    """All cells x five algorithms, failures kept with their error, role and baseline delta (best by AUC, baseline excluded)."""
    met, _ = _grouped_metrics(spark, _train_rows(spark, sf_dir), C.ALGOS)
    met = SK.parquet_roundtrip(met, scratch_path(spark, "grid"))
    good = met.where("auc is not null").drop("error")
    best = CMP.best_algo(good, CELL, C.algos_dim(spark))
    table = CMP.algo_comparison(good, best, CELL, C.algos_dim(spark))
    return met.select(*CELL_ALGO, "error").join(table, CELL_ALGO, "left")


def _models(rows, algo):
    """A model per trainable cell; a fit that fails raises, as the results made of these models have no row for its error."""
    res = TR.train_grid(rows, CELL, _cells(), [algo], TRAIN_FEATURES, n_trials=0)
    TR.none_failed({k: r["error"] for k, r in res.items()})
    return {c: r["model"] for (c, _), r in res.items() if r["model"] is not None}


def _rf_models(spark, sf_dir):
    rows = _train_rows(spark, sf_dir)
    return rows, _models(rows, "RF")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _trainable_sql(extra: str = "") -> str:
    return (f", ok as (select stratum, outcome from split group by stratum, outcome "
            f"having sum(y) >= {C.MIN_POSITIVES_TRAIN}){extra}")


def _scored_cells(spark, sf_dir):
    rows, models = _rf_models(spark, sf_dir)
    out = _union([TR.score(m, rows.where(TR._cell_filter(CELL, c))) for c, m in models.items()])
    return out.select("row_id", *CELL, "y", "is_test", "p6")


@query("score_cells")
def q_score_cells(spark, sf_dir):
    """Score of every row of every trainable cell by its cell's forest."""
    return _scored_cells(spark, sf_dir)


@query("scored_rows", with_("split") + _trainable_sql() + """
select id as row_id, stratum, outcome, y, is_test from split join ok using (stratum, outcome)""")
def q_scored_rows(spark, sf_dir):
    """The set of the rows that score_cells gives a probability."""
    return _scored_cells(spark, sf_dir).where(TR.has_probability()).drop("p6")


@query("model_roundtrip", with_("split") + _trainable_sql() + """
select stratum, outcome, cast(count(*) as bigint) as n, cast(count(*) as bigint) as n_equal
from split join ok using (stratum, outcome) where is_test group by stratum, outcome""")
def q_model_roundtrip(spark, sf_dir):
    """Each cell's baseline model saved, loaded and applied again: rows with the same score before and after."""
    rows = _train_rows(spark, sf_dir)
    parts = []
    for c, m in _models(rows, "LR").items():
        path = SK.save_model(m, scratch_path(spark, "model"))
        test = rows.where(TR._cell_filter(CELL, c) & F.col("is_test"))
        parts.append(TR.score(SK.load_pipeline_model(path), TR.score(m, test, "before"), "after"))
    both = _union(parts)
    return both.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("before") == F.col("after")).cast("bigint")).alias("n_equal"))


@query("cv_folds")
def q_cv_folds(spark, sf_dir):
    """5-fold refits of the baseline and of each cell's best family (by hold-out AUC, among all): per-fold AUC, F1, P, R."""
    def pick(scores):
        best = CMP.best_algo(GD.exact_metrics(scores, CELL_ALGO).select(*CELL_ALGO, round_half_up("auc").alias("auc")).where("auc is not null"), CELL, C.algos_dim(spark))
        return {(r["stratum"], r["outcome"]): r["best_algo"] for r in best.collect()}

    def keep(scores):
        return SK.parquet_roundtrip(scores, scratch_path(spark, "scores"))

    folds = GD.best_fold_scores(_train_rows(spark, sf_dir), CELL, _cells(), C.ALGOS, TRAIN_FEATURES, _holdout_set(), _fold_sets(), keep, pick)
    return GD.exact_metrics(keep(folds), CELL_ALGO + ["fold"]).drop("n")


@query("out_of_fold_rows", with_("split") + _trainable_sql() + """
select id as row_id, stratum, outcome, y, fold from split join ok using (stratum, outcome)""")
def q_out_of_fold_rows(spark, sf_dir):
    """Every row of a trainable cell scored once by a baseline that has not seen its fold: the set of those rows."""
    scores = GD.whole_scores(_train_rows(spark, sf_dir), CELL, _cells(), ["LR"], TRAIN_FEATURES, _fold_sets())
    return scores.where("p between 0 and 1").select("row_id", *CELL, "y", "fold")


@query("trained_verdicts")
def q_trained_verdicts(spark, sf_dir):
    """From fits to verdicts: baseline and a boosted family fitted on hold-out split and folds, their unseen scores judged by a study on tables."""
    algos = ["LR", "LGBM"]
    scores = GD.whole_scores(_train_rows(spark, sf_dir), CELL, _cells(), algos, TRAIN_FEATURES, {**_holdout_set(), **_fold_sets()},
                             carry=("row_id", "is_test", "fold", "year"))
    scores = SK.parquet_roundtrip(scores, scratch_path(spark, "scores"))
    held = scores.where("training = 'holdout'").drop("training")
    st = TableStudy(spark, held, algos, "LR", out_of_fold=scores.where("training <> 'holdout'").drop("training"), outcomes=OUTCOMES,
                    cohort=FX.cohort(spark, sf_dir), temporal_cut=FX.TEMPORAL_CUT)
    return GOV.governance_long(st.indicators)


def _explained(spark, sf_dir):
    """phi of each cell's forest for 500 hold-out rows (100 background rows), and the explained rows' scores."""
    rows, models = _rf_models(spark, sf_dir)
    test = rows.where(F.col("is_test"))
    explain = SK.parquet_roundtrip(TR.index_rows(test, CELL, "row_id", C.SHAP_SAMPLE, "explain", out="_ei"), scratch_path(spark, "explain"))
    bg = SK.parquet_roundtrip(TR.index_rows(test, CELL, "row_id", 100, "background"), scratch_path(spark, "background"))
    own = [(m, TR._cell_filter(CELL, c)) for c, m in models.items()]
    phi = _union([TR.permutation_shapley(m, explain.where(f), bg.where(f), CELL, TRAIN_FEATURES, n_perm=8) for m, f in own])
    return phi, _union([TR.score(m, explain.where(f)).select("row_id", *CELL, "p6") for m, f in own])


@query("shapley_rows")
def q_shapley_rows(spark, sf_dir):
    """Permutation Shapley values with their standard errors: phi, x, base and se of every explained row and feature."""
    return _explained(spark, sf_dir)[0]


@query("explained_rows", with_("split") + _trainable_sql(f"""
, r as (select id, stratum, outcome, row_number() over (partition by stratum, outcome order by {hash_sql('id', 'explain')}, id) as k
        from split where is_test)""") + f"""
select id as row_id, stratum, outcome, cast({len(FX.FEATURES)} as bigint) as n_features from r join ok using (stratum, outcome) where k <= {C.SHAP_SAMPLE}""")
def q_explained_rows(spark, sf_dir):
    """The set of the explained rows whose contributions and base add up to the score."""
    phi, scores = _explained(spark, sf_dir)
    total = phi.groupBy("row_id", *CELL).agg(F.count(F.lit(1)).alias("n_features"), F.sum("phi").alias("s"), F.first("base").alias("base"))
    return (total.join(scores, ["row_id", *CELL]).where(F.abs(F.col("s") + F.col("base") - F.col("p6") / 1e6) < 2e-6)
            .select("row_id", *CELL, "n_features"))


@query("perturb_run")
def q_perturb_run(spark, sf_dir):
    """Noise -> rescore with each cell's trained forest -> AUC drop over 5 repeats."""
    rows, models = _rf_models(spark, sf_dir)
    parts = []
    for c, m in models.items():
        test = rows.where(TR._cell_filter(CELL, c) & F.col("is_test"))
        base = TR.score(m, test)
        noisy = TR.score(m, PT.perturb_features(test, CELL, TRAIN_FEATURES))
        parts.append(PT.perturb_drop(base, noisy, CELL))
    return _union(parts)


@query("csv_report", with_("cohort", "strata") + "," + _COUNTS_SQL + """
select stratum, outcome, cast(n as bigint) as n, cast(positives as bigint) as positives from counts""")
def q_csv_report(spark, sf_dir):
    """The stratum table written as a CSV report with header and read back."""
    table = CO.prevalence(FX.cohort(spark, sf_dir), C.strata_dim(spark), list(FX.OUTCOME_CODES)).select("stratum", "outcome", "n", "positives")
    path = SK.write_csv_report(table, scratch_path(spark, "report"))
    return spark.read.option("header", True).schema("stratum string, outcome string, n long, positives long").csv(path)


# ---------------------------------------------------------------------------
# 8. The same operators on a second data set: strata = document language,
#    outcomes = the two label columns (nothing is tied to the survey strata)
# ---------------------------------------------------------------------------

LABEL_OUTCOMES = ["quality", "toxic"]
# stand-in score: document length on a logistic scale (fixed closed form)
LABEL_SCORE_SQL = "cast(round(1000000.0 / (1 + exp(-(n_chars / 2000.0 - 1.0)))) as int)"


def _labelled(spark, sf_dir):
    d = ST.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = ST.read_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


@query("label_prevalence", """
select lang, o.outcome, cast(count(*) as bigint) as n,
  cast(sum(case o.outcome when 'quality' then quality else toxic end) as bigint) as positives,
  floor(1000.0 * sum(case o.outcome when 'quality' then quality else toxic end) / count(*) + 0.5) / 10.0
    as prevalence_pct,
  sum(case o.outcome when 'quality' then quality else toxic end) < 50 as small_sample
from documents join labels using (doc_id) cross join (values ('quality'), ('toxic')) as o(outcome)
group by lang, o.outcome""")
def q_label_prevalence(spark, sf_dir):
    """Prevalence of both label outcomes per document language."""
    return CO.prevalence_by(_labelled(spark, sf_dir), "lang", LABEL_OUTCOMES)


@query("label_auc", f"""
with t as (select lang, o.outcome, case o.outcome when 'quality' then quality else toxic end as y,
             {LABEL_SCORE_SQL} as p6
           from documents join labels using (doc_id) cross join (values ('quality'), ('toxic')) as o(outcome))
select * from {O.auc_sql('t', ['lang', 'outcome'])} z""")
def q_label_auc(spark, sf_dir):
    """Exact AUC of a length score for each (language, label) cell."""
    df = _labelled(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in LABEL_OUTCOMES])
    long = df.select("lang", F.expr(LABEL_SCORE_SQL).alias("p6"), F.explode(arr).alias("_o")).select(
        "lang", "_o.outcome", "_o.y", "p6")
    return M.auc(long, ["lang", "outcome"])
