"""Hand-worked micro fixtures and metric properties."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratarisk.operators import metrics as M


def one(df, col):
    return df.first()[col]


def test_auc_micro(micro):
    assert one(M.auc(micro, ["cell"]), "auc") == pytest.approx(0.75)


def test_auc_ties(spark):
    df = spark.createDataFrame([("c", 1, 500000), ("c", 1, 500000), ("c", 0, 500000), ("c", 0, 200000)],
                               "cell string, y int, p6 int")
    assert one(M.auc(df, ["cell"]), "auc") == pytest.approx(0.75)


def test_confusion_micro(micro):
    r = M.confusion(micro, ["cell"]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2)
    assert (r.tpr, r.fpr) == (0.5, 0.0)


def test_weighted_prf_micro(micro):
    r = M.weighted_prf(micro, ["cell"]).first()
    assert r.precision == pytest.approx(0.8333, abs=1e-4)
    assert r.recall == pytest.approx(0.75)
    assert r.f1 == pytest.approx(0.7333, abs=1e-4)


def test_ece_micro(micro):
    assert one(M.ece(micro, ["cell"]), "ece") == pytest.approx(0.1375)


def test_ece_zero_score_counts_in_denominator(spark):
    df = spark.createDataFrame([("c", 0, 0), ("c", 1, 1000000)], "cell string, y int, p6 int")
    # p = 0 joins no bin but counts in n: only the p = 1 row contributes |1 - 1| = 0
    assert one(M.ece(df, ["cell"]), "ece") == 0.0
    df2 = spark.createDataFrame([("c", 1, 0), ("c", 1, 1000000)], "cell string, y int, p6 int")
    assert one(M.ece(df2, ["cell"]), "ece") == 0.0


def test_one_class_cell_auc_is_null(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 1, 20)], "cell string, y int, p6 int")
    assert one(M.auc(df, ["cell"]), "auc") is None


def _brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=40))
def test_auc_matches_pairwise_and_complement(spark, data):
    ys = [y for y, _ in data]
    if len(set(ys)) < 2:
        return
    ps = [p * 50000 for _, p in data]
    df = spark.createDataFrame([("c", y, p) for y, p in zip(ys, ps)], "cell string, y int, p6 int")
    a = one(M.auc(df, ["cell"]), "auc")
    assert a == pytest.approx(_brute_auc(ys, ps))
    flipped = df.withColumn("p6", F.lit(1000000) - F.col("p6"))
    assert one(M.auc(flipped, ["cell"]), "auc") == pytest.approx(1 - a)
    monotone = df.withColumn("p6", (F.col("p6") / 2 + 7).cast("int"))
    assert one(M.auc(monotone, ["cell"]), "auc") == pytest.approx(a)


def test_reliability_bins_are_left_open(spark):
    df = spark.createDataFrame([("c", 1, 100000), ("c", 0, 100001)], "cell string, y int, p6 int")
    bins = {r.bin: r.n for r in M.reliability_bins(df, ["cell"]).collect()}
    assert bins == {1: 1, 2: 1}


def test_auc_partition_invariant(spark):
    rnd = random.Random(1)
    rows = [("c%d" % (i % 3), rnd.randint(0, 1), rnd.randint(0, 1000000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "cell string, y int, p6 int")
    base = sorted(M.auc(df, ["cell"]).collect())
    for n in (1, 16):
        assert sorted(M.auc(df.repartition(n), ["cell"]).collect()) == base
