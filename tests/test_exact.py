"""Metrics on double scores against plain numpy."""

import numpy as np
import pytest

from stratarisk.operators import exact as X

COLS = "cell string, y int, p double"


def brute_auc(y, p):
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    return ((pos > neg).sum() + 0.5 * (pos == neg).sum()) / (pos.size * neg.size)


def brute_ece(y, p, bins=10):
    edges, out = np.linspace(0, 1, bins + 1), 0.0
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (p > lo) & (p <= hi)
        if m.any():
            out += m.sum() * abs(y[m].mean() - p[m].mean())
    return out / len(y)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    rows = []
    for cell, n in (("a", 900), ("b", 60), ("c", 7)):
        p = r.random(n)
        p[: n // 3] = np.round(p[: n // 3], 1)          # ties, and scores on bin edges
        p[n // 3: n // 2] = 0.5 + r.integers(-3, 4, n // 2 - n // 3) * 2.0 ** -53   # apart by one unit
        p[-2:] = 0.0, 1.0
        y = (r.random(n) < p).astype(int)
        y[:2] = 0, 1
        rows += [(cell, int(a), float(b)) for a, b in zip(y, p)]
    return rows, spark.createDataFrame(rows, COLS)


def by_cell(rows):
    return {c: (np.array([y for k, y, _ in rows if k == c]), np.array([p for k, _, p in rows if k == c])) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_auc_equals_all_pairs_however_many_ranges(data, ranges):
    rows, df = data
    got = {r.cell: r.auc for r in X.auc(df, ["cell"], ranges=ranges).collect()}
    assert got == {c: pytest.approx(brute_auc(y, p), abs=1e-14) for c, (y, p) in by_cell(rows).items()}


def test_one_cell_spreads_over_the_ranges(data):
    t = X.range_totals(X.score_table(data[1], ["cell"]), ["cell"], 16)
    assert t.where("cell = 'a'").count() >= 8


def test_calibration_and_decisions(data):
    rows, df = data
    ece = {r.cell: r.ece for r in X.ece(df, ["cell"]).collect()}
    conf = {r.cell: (r.tp, r.fp, r.fn, r.tn) for r in X.confusion(df, ["cell"]).collect()}
    for c, (y, p) in by_cell(rows).items():
        assert ece[c] == pytest.approx(brute_ece(y, p), abs=1e-13)
        d = p >= 0.5
        assert conf[c] == ((y[d] == 1).sum(), (y[d] == 0).sum(), (y[~d] == 1).sum(), (y[~d] == 0).sum())
    bins = {(r.cell, r.bin): (r.n, r.mean_p) for r in X.reliability_bins(df, ["cell"]).collect()}
    y, p = by_cell(rows)["a"]
    m = (p > np.linspace(0, 1, 11)[2]) & (p <= np.linspace(0, 1, 11)[3])
    assert bins[("a", 3)] == (m.sum(), pytest.approx(p[m].mean(), abs=1e-14))


def test_scores_that_rounding_would_merge(spark):
    df = spark.createDataFrame([("c", 1, 0.4999996), ("c", 0, 0.4999995), ("c", 1, 3e-7), ("c", 0, 2e-7)], COLS)
    assert X.auc(df, ["cell"]).first()["auc"] == 0.75
    assert X.confusion(df, ["cell"]).first()["tp"] == 0
    assert X.reliability_bins(df, ["cell"]).where("bin = 1").first()["n"] == 2


def test_unknown_scores_empty_table_and_one_class(spark):
    df = spark.createDataFrame([("c", 1, None), ("c", None, 0.2), ("c", 1, float("nan")), ("c", 1, 0.3), (None, 0, 0.1), (None, 1, 0.2)], COLS)
    got = {r.cell: (r.n, r.auc) for r in X.auc(df, ["cell"]).collect()}
    assert got == {"c": (1, None), None: (2, 1.0)}
    assert X.auc(df.limit(0), ["cell"]).count() == 0
    assert X.ece(df.limit(0), ["cell"]).count() == 0
