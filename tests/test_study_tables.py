"""An evaluation of given tables: score cube against the row-wise metrics, schema checks, missing parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratarisk.operators import compare as CMP
from stratarisk.operators import cube as CUBE
from stratarisk.operators import exact as X
from stratarisk.operators import fairness as FAIR
from stratarisk.operators import governance as GOV
from stratarisk.operators import metrics as M
from stratarisk.plans.study import CELL, CELL_ALGO, TableStudy

COLS = "row_id long, stratum string, outcome string, algo string, y int, is_test boolean, fold int, year int, p double"


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(8)
    rows = []
    for s in ("s1", "s2", "s3"):
        for i in range(400):
            y, test, fold, year = int(r.random() < 0.3), bool(r.random() < 0.3), int(r.integers(5)), 2015 + int(r.integers(6))
            for a, skill in (("base", 0.5), ("good", 1.5)):
                z = skill * (y - 0.3) + r.normal()
                rows.append((i, s, "Diabetes", a, y, test, fold, year, float(1 / (1 + np.exp(-z)))))
    return spark.createDataFrame(rows, COLS)


def study(spark, scored, **more):
    return TableStudy(spark, scored, ["base", "good"], "base", outcomes=["Diabetes"], **more)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("score", ["p", "p6"])
def test_cube_gives_the_metrics_of_the_rows(spark, scored, score):
    rows = scored if score == "p" else scored.withColumn("p6", F.round(F.col("p") * 1e6).cast("int")).drop("p")
    st, own = study(spark, rows, temporal_cut=2019), X if score == "p" else M
    test = rows.where("is_test")
    assert rows_of(st.ho_auc) == rows_of(own.auc(test, CELL_ALGO))
    best = FAIR.best_rows(rows, st.best, CELL)
    cells = own.cell_metrics(best.where("is_test"), CELL_ALGO).collect()
    got = {r.stratum: r for r in st.fair_cells.collect()}
    for r in cells:
        for c in ("auc", "tpr", "fpr", "ece"):
            assert got[r.stratum][c] == pytest.approx(r[c], abs=6e-5)
    keys = CELL_ALGO + ["fold"]
    folds = own.auc(rows, keys).select(*keys, "auc").join(own.weighted_prf(rows, keys).drop("n"), keys)
    assert rows_of(st.cv) == rows_of(CMP.cv_summary(folds, CELL_ALGO))
    later = own.auc(best.where("year >= 2019"), CELL_ALGO).collect()
    assert {r.stratum: r.n_temporal for r in st.temporal.collect()}.items() <= {r.stratum: r.n for r in later}.items()


def test_verdicts_from_given_tables(spark, scored):
    phi = spark.createDataFrame([(s, "Diabetes", i, i, f, v * (1 + i % 3)) for s in ("s1", "s2", "s3") for i in range(30) for f, v in (("a", 0.5), ("b", -0.2), ("c", 0.1))],
                                "stratum string, outcome string, row_id long, sample_rank int, feature string, phi double")
    drop = spark.createDataFrame([("s1", "Diabetes", 0.01), ("s2", "Diabetes", 0.03)], "stratum string, outcome string, drop_mean double")
    st = study(spark, scored, attributions=phi, perturbed=drop, temporal_cut=2019)
    r = st.indicators.first()
    assert r.delta_auc is not None and r.cv_gap is not None and r.hhi is not None and r.perturb_drop == pytest.approx(0.02)
    assert GOV.governance_long(st.indicators).count() == 8
    assert GOV.composite_score(st.indicators).count() == 1


def test_what_is_not_given_is_null(spark, scored):
    r = study(spark, scored.drop("year")).indicators.first()
    assert (r.temporal_gap, r.perturb_drop, r.hhi) == (None, None, None) and r.delta_auc is not None


def test_fold_metrics_from_scores_out_of_fold(spark, scored):
    other = scored.withColumn("p", F.lit(1.0) - F.col("p"))
    a, b = (study(spark, scored, out_of_fold=o).cv.where("algo = 'good' and stratum = 's1'").first() for o in (None, other))
    assert a.cv_auc_mean == pytest.approx(1 - b.cv_auc_mean, abs=2e-4)


def test_schema_is_checked(spark, scored):
    with pytest.raises(ValueError, match="fold is missing; y is string, not int|y is string, not int; fold is missing"):
        study(spark, scored.drop("fold").withColumn("y", F.col("y").cast("string")))
    with pytest.raises(ValueError, match="no score column"):
        study(spark, scored.drop("p"))
    assert study(spark, scored.withColumn("y", F.col("y").cast("long")), materialize=False).ho_auc.count() == 6


def test_empty_tables(spark, scored):
    assert study(spark, scored.limit(0)).indicators.first().delta_auc is None
