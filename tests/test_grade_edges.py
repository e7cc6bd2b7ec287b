"""Grading and bootstrap on groups smaller than the method expects."""

import pytest
from pyspark.sql import functions as F

from stratarisk.operators import attribution as A
from stratarisk.operators import grade as GR
from stratarisk.operators import metrics as M


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_kmeans_small_and_repeated_points(spark, init):
    rows = [("two", 1, 100, 100), ("two", 2, 900000, 900000)]
    rows += [("same", 10 + i, 500000, 500000) for i in range(6)]
    rows += [("many", 100 + i, (i % 3) * 300000 + i, (i % 3) * 300000) for i in range(30)]
    pts = spark.createDataFrame(rows, "stratum string, row_id long, x1 int, x2 int")
    centres, _ = GR.lloyd(pts, k=3, n_init=3, init=init)
    graded = GR.apply_grades(pts, GR.grade_rank(centres)).collect()
    assert len(graded) == len(rows)
    by = {}
    for r in graded:
        by.setdefault(r.stratum, {}).setdefault(r.grade, []).append(r.row_id)
    assert len(by["two"]) == 2 and len(by["same"]) == 1
    if init == "k-means++":
        assert sorted(sorted(v)[0] % 3 for v in by["many"].values()) == [0, 1, 2]


def test_poisson_bootstrap_of_one_row(spark):
    phi = spark.createDataFrame([("a", 1, "f", 0.5), ("a", 1, "g", 0.25)], "stratum string, row_id long, feature string, phi double")
    got = A.bootstrap_hhi_poisson(phi, ["stratum"], n_boot=40).collect()
    assert 0 < len(got) < 40 and all(r.hhi == pytest.approx(5 / 9) for r in got)


def test_ece_counts_scores_without_a_bin(spark):
    df = spark.createDataFrame([("c", 0, 0), ("c", 1, 950000), ("c", 0, 50000), ("c", 1, 55000)], "cell string, y int, p6 int")
    e = M.ece(df, ["cell"]).first()
    h = M.ece_from_histogram(M.score_histogram(df, ["cell"]), ["cell"]).first()
    assert (e.n, e.ece) == (h.n, h.ece) and e.n == 4
    assert e.ece == pytest.approx((abs(1 - .95) + abs(1 - .105)) / 4)


@pytest.mark.parametrize("n", [11, 12, 13, 20])
def test_waterfall_folds_only_beyond_the_limit(spark, n):
    phi = spark.createDataFrame([("a", 1, f"f{i:02d}", float(i + 1), 0.0) for i in range(n)], "stratum string, row_id long, feature string, phi double, x double")
    got = {r["rank"]: r for r in A.waterfall_rows(phi, ["stratum"], 12).collect()}
    assert len(got) == min(n, 12) and sum(r.phi for r in got.values()) == n * (n + 1) / 2
    assert (got[12].feature == f"other ({n - 11} features)") if n > 12 else all("other" not in r.feature for r in got.values())
