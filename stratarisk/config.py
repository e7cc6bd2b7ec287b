"""Configuration as small dimension tables.

Everything here is a parameter of the library; the defaults below are the
fixed values of the evaluated study (strata bounds, verdict thresholds,
composite weights, model-card checklist). They are turned into DataFrames
with ``spark.createDataFrame`` and joined with ``F.broadcast``: each table
has a size fixed by configuration, never by data volume.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluated study for identical results).
# ---------------------------------------------------------------------------

# Strata: (name, sex_code, age_group, age_min, age_max). age_max is reported,
# never enforced as a filter.
STRATA = [
    ("young_male", 1, 0, 19, 39),
    ("young_female", 2, 0, 19, 39),
    ("middle_male", 1, 1, 40, 59),
    ("middle_female", 2, 1, 40, 59),
    ("older_male", 1, 2, 60, 99),
    ("older_female", 2, 2, 60, 99),
]

# Age bands: upper bounds (inclusive) of bands 0, 1; anything above is band 2.
AGE_BAND_UPPER = [39, 59]
MIN_AGE = 19

# Outcome recodes: raw code -> label; unlisted codes become null and drop.
OUTCOME_RECODE = {
    "Diabetes": {1: 0, 3: 1},
    "Hypertension": {1: 0, 4: 1},
}
OUTCOMES = ["Diabetes", "Hypertension"]

# Algorithm list; list order breaks AUC ties. The first one is the baseline.
ALGOS = ["LR", "RF", "LGBM", "XGB", "MLP"]
BASELINE_ALGO = "LR"

SEED = 42
TEST_FRACTION = 0.3
N_FOLDS = 5
MIN_POSITIVES_TRAIN = 20      # below: cell kept, model value null
SMALL_SAMPLE_POSITIVES = 50   # below: small-sample flag
DECISION_THRESHOLD = 0.5
ECE_BINS = 10
TEMPORAL_CUT_YEAR = 2024
TEMPORAL_MIN_ROWS = 30
TEMPORAL_MIN_POSITIVES = 5
PERTURB_SIGMA = 0.10
PERTURB_REPEATS = 5
N_BOOTSTRAP = 200
SHAP_SAMPLE = 500
BORDERLINE_LO = 0.35
BORDERLINE_HI = 0.65

# Verdict thresholds: metric -> (good, warn, low_best, citation).
THRESHOLDS = [
    ("G1_delta_auc", 0.10, 0.20, True, "Chouldechova (2017); relaxed for six-stratum design"),
    ("G1_eq_odds", 0.15, 0.30, True, "Hardt et al. (2016); adjusted for prevalence heterogeneity"),
    ("G1_calib_ece", 0.05, 0.10, True, "Naeini et al. (2015) ECE criterion"),
    ("G2_cv_gap", 0.03, 0.05, True, "Varma & Simon (2006) nested CV stability"),
    ("G2_temporal_gap", 0.05, 0.10, True, "Nestor et al. (2019) temporal shift tolerance"),
    ("G2_perturb_drop", 0.03, 0.05, True, "Ghorbani & Zou (2019) data robustness"),
    ("G3_hhi", 0.15, 0.25, True, "DOJ/FTC HHI bands; Lundberg et al. (2020)"),
    ("G4_model_card", 0.80, 0.60, False, "Mitchell et al. (2019) Model Cards for Model Reporting"),
]

VERDICT_GOOD = "good"
VERDICT_CAUTION = "caution"
VERDICT_RISK = "risk"

# Model-card checklist: (item, met). 8 of 10 met.
MODEL_CARD_CHECKLIST = [
    ("Intended purpose and use stated", True),
    ("Training data source and period stated", True),
    ("Evaluation metrics and results reported", True),
    ("Performance limits and failure cases stated", True),
    ("Per-group performance disaggregation", True),
    ("Individual explanation (waterfall) available", True),
    ("Code public", True),
    ("Human-in-the-loop oversight procedure", False),
    ("Model versioning and update plan", True),
    ("Privacy impact assessment performed", False),
]
CODE_PUBLIC = True

# Composite score: (component, weight, good, bad, default when missing).
# The model-card component has no normalisation: min(1, score).
COMPOSITE = [
    ("delta_auc", 0.20, 0.10, 0.20, 0.15),
    ("eq_odds", 0.15, 0.15, 0.30, 0.20),
    ("cv_gap", 0.15, 0.03, 0.06, 0.04),
    ("perturb_drop", 0.10, 0.03, 0.05, 0.04),
    ("hhi", 0.20, 0.15, 0.25, 0.18),
    ("model_card", 0.20, None, None, None),
]
COMPOSITE_FLOOR = 0.10
COMPOSITE_GOOD = 0.75
COMPOSITE_CAUTION = 0.60

# Retraining triggers: (trigger, metric, comparison, limit).
RETRAIN_TRIGGERS = [
    ("fairness_auc_gap", "delta_auc", ">", 0.10),
    ("fairness_eq_odds", "eq_odds", ">", 0.15),
    ("robustness_cv_gap", "cv_gap", ">", 0.03),
    ("robustness_perturb_drop", "perturb_drop", ">", 0.03),
    ("transparency_hhi", "hhi", ">", 0.15),
    ("accountability_model_card", "card_score", "<", 0.80),
    ("composite_score", "composite", "<", 0.60),
    ("small_sample", "min_positives", "<", 50.0),
]

# Grade labels and policy text by grade (1 = lowest risk).
GRADES = [
    (1, "grade1_low", "Preventive care service referral"),
    (2, "grade2_mid", "Periodic monitoring and lifestyle intervention"),
    (3, "grade3_high", "Clinical referral and intensive management"),
]


# ---------------------------------------------------------------------------
# Dimension tables
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class StudyConfig:
    strata: list = field(default_factory=lambda: list(STRATA))
    outcomes: list = field(default_factory=lambda: list(OUTCOMES))
    algos: list = field(default_factory=lambda: list(ALGOS))
    baseline: str = BASELINE_ALGO
    seed: int = SEED


STRATA_SCHEMA = T.StructType([
    T.StructField("stratum", T.StringType(), False),
    T.StructField("sex", T.IntegerType(), False),
    T.StructField("age_group", T.IntegerType(), False),
    T.StructField("age_min", T.IntegerType(), False),
    T.StructField("age_max", T.IntegerType(), False),
    T.StructField("stratum_order", T.IntegerType(), False),
])


def strata_dim(spark: SparkSession, strata=None) -> DataFrame:
    rows = [(n, s, g, lo, hi, i + 1) for i, (n, s, g, lo, hi) in enumerate(strata or STRATA)]
    return spark.createDataFrame(rows, STRATA_SCHEMA)


def outcomes_dim(spark: SparkSession, outcomes=None) -> DataFrame:
    rows = [(o, i + 1) for i, o in enumerate(outcomes or OUTCOMES)]
    return spark.createDataFrame(rows, "outcome string, outcome_order int")


def algos_dim(spark: SparkSession, algos=None, baseline: str = BASELINE_ALGO) -> DataFrame:
    rows = [(a, i + 1, a == baseline) for i, a in enumerate(algos or ALGOS)]
    return spark.createDataFrame(rows, "algo string, algo_order int, is_baseline boolean")


def thresholds_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        THRESHOLDS, "metric string, good double, warn double, low_best boolean, cite string")


def checklist_dim(spark: SparkSession, items=None) -> DataFrame:
    return spark.createDataFrame(items or MODEL_CARD_CHECKLIST, "item string, met boolean")


def grades_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRADES, "grade int, grade_label string, policy string")
