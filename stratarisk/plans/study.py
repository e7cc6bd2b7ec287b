"""One evaluation run, sharing intermediate tables.

A ``Study`` builds the long scored table once per query and folds it to one
score cube (:mod:`stratarisk.operators.cube`), from which hold-out, fold,
fairness and temporal indicators are read; only perturbation and the
attribution sample go back to rows. With ``materialize=True`` the scored table,
the cube and the sample's attributions are written as Parquet under
``spark.checkpoint.dir``: readers take the columns they need, and a lost
executor recomputes from those files rather than from the raw tables.

``Study`` runs on the stand-in inputs, ``TableStudy`` on a user's own tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.operators import attribution as AT
from stratarisk.operators import compare as CMP
from stratarisk.operators import cube as CUBE
from stratarisk.operators import fairness as FAIR
from stratarisk.operators import governance as GOV
from stratarisk.operators import keys as K
from stratarisk.operators import perturb as PT
from stratarisk.operators import cohort as CO
from stratarisk.plans import fixtures as FX
from stratarisk.session import scratch_path
from stratarisk.sources.sinks import parquet_roundtrip

CELL = ["stratum", "outcome"]
CELL_ALGO = CELL + ["algo"]


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = False):
        self.spark, self.sf_dir, self.materialize = spark, sf_dir, materialize

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return parquet_roundtrip(df, scratch_path(self.spark, name)) if self.materialize else df

    # ---- shared inputs ----------------------------------------------------
    @cached_property
    def split_cells(self) -> DataFrame:
        return FX.split_cells(self.spark, self.sf_dir)

    @cached_property
    def scored(self) -> DataFrame:
        return self.kept(FX.scored(self.spark, self.sf_dir), "study-scored")

    @cached_property
    def cube(self) -> DataFrame:
        return self.kept(CUBE.score_cube(self.scored, CELL_ALGO, FX.TEMPORAL_CUT), "study-cube")

    @cached_property
    def holdout(self) -> DataFrame:
        return self.scored.where(F.col("is_test"))

    @cached_property
    def algos(self) -> DataFrame:
        return C.algos_dim(self.spark, FX.STANDIN_ALGOS, FX.STANDIN_BASELINE)

    @cached_property
    def ho_auc(self) -> DataFrame:
        return self.kept(CUBE.auc(CUBE.histogram(self.cube, CELL_ALGO, F.col(CUBE.HOLDOUT)), CELL_ALGO), "study-auc")

    @cached_property
    def best(self) -> DataFrame:
        return self.kept(CMP.best_algo(self.ho_auc, CELL, self.algos), "study-best")

    @cached_property
    def best_scored(self) -> DataFrame:
        return FAIR.best_rows(self.scored, self.best, CELL)

    @cached_property
    def best_cube(self) -> DataFrame:
        return FAIR.best_rows(self.cube, self.best, CELL)

    # ---- indicators -------------------------------------------------------
    @cached_property
    def fair_cells(self) -> DataFrame:
        return CUBE.fairness_cells(self.best_cube, CELL)

    @cached_property
    def fair_gaps(self) -> DataFrame:
        return FAIR.fairness_gaps(self.fair_cells)

    @cached_property
    def cv(self) -> DataFrame:
        return CMP.cv_summary(CUBE.fold_metrics(self.cube, CELL_ALGO), CELL_ALGO)

    @cached_property
    def cv_gap(self) -> DataFrame:
        return CMP.cv_gap(self.cv, self.ho_auc, self.best, CELL)

    @cached_property
    def temporal(self) -> DataFrame:
        return FAIR.gap_of_parts(CUBE.part_auc(self.best_cube, CELL_ALGO), CELL)

    @cached_property
    def perturb(self) -> DataFrame:
        rows = self.best_scored.where(F.col("is_test")).drop("p6")
        return PT.perturb_run(rows, CELL_ALGO, FX.FEATURES, lambda d: FX.standin_score_case("algo"))

    @cached_property
    def sample(self) -> DataFrame:
        if self.materialize:
            # hold-out rows straight from the checkpointed scored table (one row
            # per (row, cell): any single algorithm's copy)
            test = (self.scored.where(F.col("is_test") & (F.col("algo") == F.lit(FX.STANDIN_BASELINE)))
                    .select(F.col("row_id").alias("id"), *CELL, *FX.FEATURES))
        else:
            test = self.split_cells.where(F.col("is_test"))
        s = K.sample_n_per_group(test, CELL, "id", C.SHAP_SAMPLE, max_groups=FX.n_cells(self.spark))
        return s.withColumnRenamed("id", "row_id")

    @cached_property
    def phi(self) -> DataFrame:
        p = AT.linear_shapley(self.sample, CELL, FX.STANDIN_ATTRIBUTION, carry=["sample_rank"])
        # a sample-sized table read by several indicators: materialise it once
        return self.kept(p, "study-phi")

    @cached_property
    def transparency(self) -> DataFrame:
        return AT.hhi_interval(self.phi, CELL, "sample_rank")

    @cached_property
    def card(self) -> DataFrame:
        return GOV.model_card(C.checklist_dim(self.spark))

    @cached_property
    def indicators(self) -> DataFrame:
        return GOV.outcome_indicators(self.fair_gaps, self.cv_gap, self.temporal, self.perturb,
                                      self.transparency, self.card, C.outcomes_dim(self.spark))

    @cached_property
    def composite(self) -> DataFrame:
        return GOV.composite_score(self.indicators)

    @cached_property
    def min_positives(self) -> DataFrame:
        c = CO.stratum_outcome_counts(FX.cohort(self.spark, self.sf_dir), C.strata_dim(self.spark),
                                      list(FX.OUTCOME_CODES))
        return c.groupBy("outcome").agg(F.min("positives").alias("min_positives"))


class TableStudy(Study):
    """An evaluation of a user's own stored results.

    scored: (row_id, stratum, outcome, algo, y, is_test, fold) with the score
    ``p`` (double) or ``p6`` (micro-units), and ``year`` if a later period is to
    be judged (``temporal_cut``). out_of_fold: the same columns, each row scored
    by fits that have not seen its fold; the fold metrics are taken from it, and
    from ``scored`` where it is not given. attributions: (stratum, outcome, row_id,
    sample_rank, feature, phi). perturbed: (stratum, outcome, drop_mean), as
    :func:`operators.perturb.perturb_run` gives it. cohort: one row per subject
    with stratum columns and an int column per outcome. What is not given leaves
    its indicators null. Further columns are ignored.
    """

    SCHEMA = {
        "scored": {"row_id": None, "stratum": "string", "outcome": "string", "algo": "string", "y": "int", "is_test": "boolean", "fold": "int"},
        "out_of_fold": {"stratum": "string", "outcome": "string", "algo": "string", "y": "int", "is_test": "boolean", "fold": "int"},
        "attributions": {"stratum": "string", "outcome": "string", "row_id": None, "sample_rank": None, "feature": "string", "phi": "double"},
        "perturbed": {"stratum": "string", "outcome": "string", "drop_mean": "double"},
    }

    def __init__(self, spark: SparkSession, scored: DataFrame, algos: list[str], baseline: str, attributions: DataFrame | None = None,
                 perturbed: DataFrame | None = None, cohort: DataFrame | None = None, outcomes: list[str] | None = None, strata=None,
                 temporal_cut: int | None = None, out_of_fold: DataFrame | None = None, materialize: bool = True):
        super().__init__(spark, "", materialize)
        given = {"scored": scored, "out_of_fold": out_of_fold, "attributions": attributions, "perturbed": perturbed}
        for name, table in given.items():
            if table is not None:
                self.check(name, table)
        for name in ("scored", "out_of_fold"):
            if given[name] is not None and not {"p", "p6"} & set(given[name].columns):
                raise ValueError(f"{name}: no score column p or p6")
        self.given, self.algo_names, self.baseline = given, algos, baseline
        self.cohort, self.outcomes, self.strata, self.temporal_cut = cohort, outcomes, strata, temporal_cut

    @classmethod
    def check(cls, name: str, table: DataFrame) -> None:
        """Raise with all that is wrong: columns that are missing or of another type (int columns may be any integer type)."""
        types = {f.name: f.dataType.simpleString() for f in table.schema.fields}
        whole = {"tinyint", "smallint", "int", "bigint"}
        wrong = [f"{c} is missing" for c in cls.SCHEMA[name] if c not in types]
        wrong += [f"{c} is {types[c]}, not {t}" for c, t in cls.SCHEMA[name].items()
                  if t and c in types and types[c] != t and not (t == "int" and types[c] in whole)]
        if wrong:
            raise ValueError(f"{name}: " + "; ".join(wrong))

    @cached_property
    def scored(self) -> DataFrame:
        return self.given["scored"]

    @cached_property
    def cube(self) -> DataFrame:
        return self.kept(CUBE.score_cube(self.scored, CELL_ALGO, self.temporal_cut), "study-cube")

    @cached_property
    def cv(self) -> DataFrame:
        own = self.given["out_of_fold"]
        return Study.cv.func(self) if own is None else CMP.cv_summary(CUBE.fold_metrics(CUBE.score_cube(own, CELL_ALGO), CELL_ALGO), CELL_ALGO)

    @cached_property
    def algos(self) -> DataFrame:
        return C.algos_dim(self.spark, self.algo_names, self.baseline)

    @cached_property
    def perturb(self) -> DataFrame:
        got = self.given["perturbed"]
        return got if got is not None else self.spark.createDataFrame([], "stratum string, outcome string, drop_mean double")

    @cached_property
    def phi(self) -> DataFrame:
        got = self.given["attributions"]
        return got if got is not None else self.spark.createDataFrame([], "stratum string, outcome string, row_id long, sample_rank int, feature string, phi double")

    @cached_property
    def indicators(self) -> DataFrame:
        return GOV.outcome_indicators(self.fair_gaps, self.cv_gap, self.temporal, self.perturb, self.transparency, self.card,
                                      C.outcomes_dim(self.spark, self.outcomes))

    @cached_property
    def min_positives(self) -> DataFrame:
        if self.cohort is None:
            return self.spark.createDataFrame([], "outcome string, min_positives long")
        c = CO.stratum_outcome_counts(self.cohort, C.strata_dim(self.spark, self.strata), self.outcomes or C.OUTCOMES)
        return c.groupBy("outcome").agg(F.min("positives").alias("min_positives"))
