"""Verdicts, normalisation, composite and checklist micro fixtures."""

import pytest
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.scalar import judge_metric, norm_score, parse_mean, band, recode
from stratarisk.operators import attribution as AT
from stratarisk.operators import cohort as CO
from stratarisk.operators import governance as GOV


def test_norm_score(spark):
    r = spark.range(1).select(norm_score(F.lit(0.15), F.lit(0.10), F.lit(0.20), 0.10).alias("s")).first()
    assert r.s == pytest.approx(0.55)


def test_judge_inclusive_and_null(spark):
    df = spark.createDataFrame([(0.10,), (0.15,), (0.25,), (None,)], "v double")
    got = [r.j for r in df.select(judge_metric("v", "G1_delta_auc").alias("j")).collect()]
    assert got == ["good", "caution", "risk", None]


def test_hhi_micro(spark):
    imp = spark.createDataFrame([("c", "a", 0.5), ("c", "b", 0.3), ("c", "d", 0.2)],
                                "cell string, feature string, mean_abs double")
    r = AT.hhi_from_importance(imp, ["cell"]).first()
    assert r.hhi == pytest.approx(0.38)
    v = spark.range(1).select(judge_metric(F.lit(0.38), "G3_hhi").alias("v")).first().v
    assert v == "risk"


def test_class_weights_micro(spark):
    df = spark.createDataFrame([("c", y) for y in (0, 0, 0, 1, 1)], "cell string, y int")
    w = {r.y: r.weight for r in CO.class_weights(df, ["cell"], "y").collect()}
    assert w[0] == pytest.approx(0.8333, abs=1e-4) and w[1] == pytest.approx(1.25)


def test_model_card(spark):
    r = GOV.model_card(C.checklist_dim(spark)).first()
    assert (r.card_score, r.verdict, r.met_text) == (0.8, "good", "8/10")


@pytest.mark.parametrize("vals,expected", [
    ((0.252, 0.921, 0.028, 0.011, 0.126, 0.80), 0.645),
    ((0.150, 1.251, 0.039, 0.019, 0.092, 0.80), 0.6945),
])
def test_composite_published(spark, vals, expected):
    ind = spark.createDataFrame([("o",) + vals],
                                "outcome string, delta_auc double, eq_odds double, cv_gap double, "
                                "perturb_drop double, hhi double, card_score double")
    r = GOV.composite_score(ind).first()
    assert r.composite_raw == pytest.approx(expected, abs=1e-9)


def test_composite_defaults_for_missing(spark):
    ind = spark.createDataFrame([("o", None, None, None, None, None, 0.8)],
                                "outcome string, delta_auc double, eq_odds double, cv_gap double, "
                                "perturb_drop double, hhi double, card_score double")
    r = GOV.composite_score(ind).first()
    # defaults .15 .20 .04 .04 .18 -> normalised .55, .7, .7, .55, .73
    assert r.composite_raw == pytest.approx(0.2 * .55 + 0.15 * (0.1 + 0.9 * (1 - 0.05 / 0.15))
                                            + 0.15 * (0.1 + 0.9 * (1 - 0.01 / 0.03)) + 0.1 * 0.55
                                            + 0.2 * (0.1 + 0.9 * 0.7) + 0.2 * 0.8)


def test_parse_mean(spark):
    df = spark.createDataFrame([("0.8123 +- 0.0100",), ("-",), ("junk",)], "t string")
    assert [r.m for r in df.select(parse_mean("t").alias("m")).collect()] == [0.8123, None, None]


def test_band_and_recode(spark):
    df = spark.createDataFrame([(19.0, 1), (39.0, 3), (40.0, 2), (60.0, None)], "age double, code int")
    got = df.select(band("age").alias("b"), recode("code", {1: 0, 3: 1}).alias("r")).collect()
    assert [r.b for r in got] == [0, 0, 1, 2]
    assert [r.r for r in got] == [0, 1, None, None]
