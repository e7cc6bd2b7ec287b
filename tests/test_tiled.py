"""K-means on tiles: the centres of the plain passes, with most points not looked at."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from stratarisk.operators import grade as GR
from stratarisk.operators import tiled as TL


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    rows, row_id = [], 0
    for g, n in (("a", 6000), ("b", 800), ("c", 2)):
        mid = r.integers(100_000, 900_000, (4, 2))
        x = np.clip(mid[r.integers(0, 4, n)] + r.normal(0, 60_000, (n, 2)), 0, 1_000_000).astype(int)
        x[: n // 5] = x[0]                                   # many rows of one point
        for a, b in x.tolist():
            rows.append((g, row_id, a, b))
            row_id += 1
    return GR.materialize_points(spark.createDataFrame(rows, "stratum string, row_id long, x1 int, x2 int").repartition(4))


def centres(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.stratum, []).append((r.c1, r.c2))
    return {g: sorted(c) for g, c in out.items()}


def test_centres_equal_the_plain_passes(points):
    plain, passes = GR.lloyd(points, k=3, n_init=3, checkpointed=True)
    got, figures = TL.lloyd(points, (3,), n_init=3)
    want = centres(plain)
    for g, c in centres(got).items():
        assert np.allclose(c, want[g], rtol=1e-12)
    assert figures["passes"] <= passes
    assert figures["looked_at"] < 0.5 * figures["plain"]
    inertia = {r.stratum: r.inertia6 for r in plain.collect()}
    assert {r.stratum: r.inertia6 for r in got.collect()} == {g: pytest.approx(v, rel=1e-9, abs=1e-6) for g, v in inertia.items()}


def test_every_k_at_once(points):
    one = {(r.stratum, r.k): r.inertia for r in TL.elbow(points, range(2, 5), n_init=2).collect()}
    for r in GR.elbow(points, range(2, 5), n_init=2).collect():
        assert one[(r.stratum, r.k)] == pytest.approx(r.inertia, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("edge", [1, 1000, 1 << 20])
def test_steps_on_tiles_equal_steps_on_points(edge):
    r = np.random.default_rng(edge)
    x = r.integers(0, 50_000, (3000, 2))
    b = TL.Block.of(r.integers(0, 3, 3000), x[:, 0], x[:, 1], r.integers(1, 5, 3000), edge)
    for g in range(4):
        for k in (1, 2, 5):
            c = x[r.integers(0, 3000, k)].astype(float)
            c[-1] = c[0]                                     # two centres in one place: the lower number takes the points
            assert (b.step(g, c)[0] == b.step(g, c, tiles=False)[0]).all()


def test_null_scores_and_empty_table(spark, points):
    more = points.union(spark.createDataFrame([("a", 10**9, None, 5)], "stratum string, row_id long, x1 int, x2 int"))
    assert centres(TL.lloyd(more, (2,), n_init=1)[0]) == centres(TL.lloyd(points, (2,), n_init=1)[0])
    assert TL.lloyd(points.limit(0), (3,), n_init=2)[0].count() == 0


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_seeding_is_the_race_of_single_draws(spark):
    r = np.random.default_rng(9)
    rows = [(g, i, int(a), int(b)) for i, (g, a, b) in enumerate((g, *r.integers(0, 1000, 2)) for g in "aab" * 40)]
    rows += rows[:5] + [("c", 900, 5, 5), ("c", 901, 5, 5), (None, 902, 7, 7)]          # rows twice, one point only, no group
    pts = spark.createDataFrame(rows, "stratum string, row_id long, x1 int, x2 int").coalesce(1)
    want = []
    for g in "abc":
        own = [x[1:] for x in rows if x[0] == g]
        for init in (1, 2, 3):
            first = min(own, key=lambda x: (draw(x[0], "kinit", 42, init), x))
            cs = [first[1:]]
            for j in (1, 2):
                d2 = [min((x[1] - a) ** 2 + (x[2] - b) ** 2 for a, b in cs) for x in own]
                race = [(-math.log((draw(x[0], init, j, "kpp", 42) + 1) / 4294967297.0) / d, x) for x, d in zip(own, d2) if d > 0]
                cs += [min(race)[1][1:]] if race else []
            want += [(g, init, c, float(a), float(b)) for c, (a, b) in enumerate(cs)]
    assert GR.init_kmeanspp(pts, 3, 3) == want
    assert GR.init_kmeanspp(pts.where("false"), 3, 3) == []


def test_few_rows_reach_the_grouped_minimum(spark):
    rows = spark.range(0, 20_000, 1, 2).selectExpr("cast(id % 5 as int) as run", "cast(20000 - id as double) as _key", "id as row_id", "1 as x1", "2 as x2")
    tied = rows.union(rows.where("row_id >= 19995").selectExpr("run", "_key", "row_id - 100000", "x1", "x2"))
    got = GR._least_rows(tied, 5)
    assert {r: (w["_key"], w["row_id"]) for r, w in got.items()} == {r: (5.0 - r, 19_995 - 100_000 + r) for r in range(5)}
    few = GR._lower(5)
    handed = list(few([pa.RecordBatch.from_pydict({"run": [0, 0, 1], "_key": [2.0, 1.0, 3.0]}), pa.RecordBatch.from_pydict({"run": [0, 1, 1], "_key": [1.5, 3.0, 4.0]})]))
    assert [b.to_pydict() for b in handed] == [{"run": [0, 1], "_key": [1.0, 3.0]}, {"run": [1], "_key": [3.0]}]
