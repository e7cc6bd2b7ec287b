"""Stand-in inputs built from the driver's test tables.

The evaluated study reads yearly survey extracts and trained models; neither
ships with it. These builders only produce rows in the schemas the library
expects:

* ``raw_extract``: one row per order with survey-like raw columns (codes,
  text age, measures) derived from ``orders`` joined to ``customer``;
* ``STANDIN_SCORERS``: fixed closed-form logistic scores standing in for
  trained models (so every metric has an exact SQL oracle);
* ``STANDIN_ATTRIBUTION``: coefficients of a linear logit whose exact
  Shapley values stand in for explainer output.

All the work named by a query (recoding, filtering, splitting, metrics,
grading, verdicts ...) runs afterwards in the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.operators import cohort as CO
from stratarisk.operators.keys import split_and_folds
from stratarisk.sources.tables import read_table

# ---- stand-in raw extract --------------------------------------------------

RAW_SQL_COLUMNS = [
    ("id", "cast(o_orderkey as bigint)"),
    ("year", "cast(year(o_orderdate) as int)"),
    ("sex", "cast(c_nationkey % 2 + 1 as int)"),
    ("age", "cast(18 + c_custkey % 70 as varchar)"),
    ("dm_code", "cast(case o_orderstatus when 'O' then 1 when 'P' then 2 else 3 end as int)"),
    ("hp_code", "cast(case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 "
                "when '3-MEDIUM' then 2 else 1 end as int)"),
    ("num_a", "o_totalprice / 1000.0"),
    ("num_b", "c_acctbal"),
    ("cat_a", "cast(nullif(o_orderkey % 7, 0) as double)"),
]
BAD_AGE_SQL = "case when o_orderkey % 50 = 0 then 'n/a' else cast(18 + c_custkey % 70 as varchar) end"

OUTCOME_CODES = {
    "Diabetes": ("dm_code", C.OUTCOME_RECODE["Diabetes"]),
    "Hypertension": ("hp_code", C.OUTCOME_RECODE["Hypertension"]),
}
PREDICTORS = ["num_a", "num_b", "cat_a"]
FEATURES = ["num_a", "num_b", "cat_a", "age"]
TEMPORAL_CUT = 2001          # the test tables cover 1995-2001
FIXTURE_YEARS_DROP_COL = ("cat_a", 1995)   # this year's extract lacks cat_a

# ---- stand-in models: closed-form logits over cohort columns ---------------
# (algo, algo_order, logit SQL). The first is the baseline.
STANDIN_SCORERS = [
    ("score_base", 1, "num_a / 200.0 - 1.2 + num_b / 20000.0"),
    ("score_b", 2, "cat_a / 3.0 - 1.0 + num_b / 10000.0"),
    ("score_c", 3, "num_a / 300.0 - 0.8 - cat_a / 6.0"),
]
STANDIN_BASELINE = "score_base"
STANDIN_ALGOS = [a for a, _, _ in STANDIN_SCORERS]


def p6_sql(logit_sql: str) -> str:
    return f"cast(round(1000000.0 / (1 + exp(-({logit_sql})))) as int)"


def soft_sql(logit_sql: str) -> str:
    """A double score in (0, 1) by additions, products and a quotient only, so that every engine gets the same bits."""
    return f"0.5 + 0.5 * ({logit_sql}) / (1 + abs({logit_sql}))"


# ---- stand-in attribution: linear logit coefficients per outcome -----------
STANDIN_ATTRIBUTION = {
    "Diabetes": [("num_a", 0.005), ("num_b", 0.00005), ("cat_a", 0.3), ("age", 0.02)],
    "Hypertension": [("num_a", 0.004), ("num_b", 0.0001), ("cat_a", -0.2), ("age", 0.03)],
}


def _sql_to_spark(expr: str) -> str:
    return expr.replace("varchar", "string")


def raw_extract(spark: SparkSession, sf_dir: str, bad_age: bool = False,
                year: int | None = None) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    if year is not None:
        # Range predicate on the raw column: pushed to the Parquet scan.
        o = o.where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) &
                    (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    cols = []
    for name, expr in RAW_SQL_COLUMNS:
        if name == "age" and bad_age:
            expr = BAD_AGE_SQL
        cols.append(F.expr(_sql_to_spark(expr)).alias(name))
    return j.select(*cols)


def yearly_extracts(spark: SparkSession, sf_dir: str, years: list[int]) -> list[DataFrame]:
    """One frame per survey year; the year filter is a pushed scan predicate."""
    out = []
    for y in years:
        d = raw_extract(spark, sf_dir, year=y)
        if y == FIXTURE_YEARS_DROP_COL[1]:
            d = d.drop(FIXTURE_YEARS_DROP_COL[0])
        out.append(d)
    return out


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_extract(spark, sf_dir)
    return CO.prepare_cohort(raw, OUTCOME_CODES, PREDICTORS, keep=["id", "year", "sex"])


def stratified_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CO.assign_stratum(cohort(spark, sf_dir), C.strata_dim(spark))


def cell_rows(spark: SparkSession, sf_dir: str, outcomes=None) -> DataFrame:
    """Long (row, outcome) table: id, stratum, outcome, y, year, features."""
    outcomes = outcomes or list(OUTCOME_CODES)
    sc = stratified_cohort(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in outcomes])
    return sc.select("id", "stratum", "stratum_order", "year", *FEATURES,
                     F.explode(arr).alias("_o")).select(
        "id", "stratum", "stratum_order", "_o.outcome", "_o.y", "year", *FEATURES)


def n_cells(spark: SparkSession) -> int:
    return len(C.STRATA) * len(OUTCOME_CODES)


def split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell rows with hold-out flag and fold id (label-stratified, per cell)."""
    return split_and_folds(cell_rows(spark, sf_dir), ["stratum", "outcome"], "y", "id",
                           max_groups=2 * n_cells(spark))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored table: one row per (row, outcome, algo) with integer score p6."""
    s = split_cells(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(a).alias("algo"), F.lit(k).alias("algo_order"),
                             F.expr(p6_sql(lg)).alias("p6"))
                    for a, k, lg in STANDIN_SCORERS])
    return s.select("id", "stratum", "stratum_order", "outcome", "y", "is_test", "fold",
                    "year", *FEATURES, F.explode(arr).alias("_a")).select(
        F.col("id").alias("row_id"), "stratum", "stratum_order", "outcome",
        "_a.algo", "_a.algo_order", "y", "_a.p6", "is_test", "fold", "year", *FEATURES)


def scored_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long scored table with an unrounded double score p (:func:`soft_sql`) per (row, outcome, algo)."""
    arr = F.array(*[F.struct(F.lit(a).alias("algo"), F.expr(soft_sql(lg)).alias("p")) for a, _, lg in STANDIN_SCORERS])
    return split_cells(spark, sf_dir).select("id", "stratum", "outcome", "y", "is_test", "fold", F.explode(arr).alias("_a")).select(
        F.col("id").alias("row_id"), "stratum", "outcome", "_a.algo", "y", "_a.p", "is_test", "fold")


def standin_p6(algo: str, cols: dict[str, str] | None = None):
    """Score column of one stand-in model, optionally over renamed feature columns."""
    lg = {a: l for a, _, l in STANDIN_SCORERS}[algo]
    if cols:
        for k, v in cols.items():
            lg = lg.replace(k, v)
    return F.expr(p6_sql(lg))


# ---- stand-ins for attribution and grading inputs --------------------------

# Fixed starting centres (micro-units) for the deterministic one-step grade queries.
FIXED_CENTRES = [(0, 200000.0, 200000.0), (1, 500000.0, 500000.0), (2, 800000.0, 800000.0)]


def standin_score_case(algo_col: str = "algo"):
    """Score of whichever stand-in model a row names, over the row's own columns."""
    e = None
    for a, _, lg in STANDIN_SCORERS:
        cond = F.col(algo_col) == F.lit(a)
        e = F.when(cond, F.expr(p6_sql(lg))) if e is None else e.when(cond, F.expr(p6_sql(lg)))
    return e


def fixed_centres(spark: SparkSession) -> DataFrame:
    rows = [(n, 1, k, c1, c2) for n, *_ in C.STRATA for k, c1, c2 in FIXED_CENTRES]
    return spark.createDataFrame(rows, "stratum string, init int, cluster int, c1 double, c2 double")
