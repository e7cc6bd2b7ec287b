"""Known-signal cohort (FIXTURES section 3): trained models beat chance; Shapley adds up."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stratarisk.functions.hashing import hash_uniform
from stratarisk.operators import metrics as M
from stratarisk.operators import training as TR
from stratarisk.operators.keys import split_and_folds


@pytest.fixture(scope="module")
def signal_rows(spark):
    n = 3000
    base = spark.range(n).withColumnRenamed("id", "row_id")
    feats = {f"f{i}": hash_uniform(F.col("row_id"), f"f{i}") * 2 - 1 for i in range(1, 9)}
    df = base.withColumns(feats).withColumn("stratum", F.when(F.col("row_id") % 2 == 0, "a").otherwise("b"))
    logit = (F.when(F.col("stratum") == "a", -0.3).otherwise(0.3) + 2.4 * F.col("f1") - 1.6 * F.col("f2")
             + 1.0 * F.col("f3") * F.col("f4"))
    p = 1 / (1 + F.exp(-logit))
    df = df.withColumn("y", (hash_uniform(F.col("row_id"), "label") < p).cast("int")).withColumn("outcome", F.lit("o"))
    return split_and_folds(df, ["stratum", "outcome"], "y", "row_id")


FEATS = [f"f{i}" for i in range(1, 9)]


@pytest.fixture(scope="module")
def table(signal_rows):
    return TR.training_table(signal_rows, ["stratum", "outcome"])


@pytest.mark.parametrize("algo", ["LR", "RF", "LGBM", "XGB", "MLP"])
def test_known_signal_auc(spark, table, algo, monkeypatch):
    for a, few in (("RF", {"numTrees": 20}), ("LGBM", {"maxIter": 8}), ("XGB", {"maxIter": 8}), ("MLP", {"n_layers": 1, "n_units": 8})):
        monkeypatch.setitem(TR.DEFAULT_PARAMS, a, {**TR.DEFAULT_PARAMS[a], **few})
    res = TR.train_grid(table, ["stratum", "outcome"], [("a", "o"), ("b", "o")], [algo], FEATS, n_trials=0)
    assert all(r["error"] is None for r in res.values())
    sc = TR.scored_holdout(table, ["stratum", "outcome"], res)
    for r in M.auc(sc, ["stratum", "outcome", "algo"]).collect():
        assert r.auc > 0.65


def test_forest_keeps_the_node_of_each_row(spark, table):
    est = TR.make_estimator("RF", {"numTrees": 8, "maxDepth": 5}, len(FEATS), 100)
    assert est.getCacheNodeIds()
    rows = TR.prepare_training(table.where("stratum = 'a' and not is_test"), ["stratum", "outcome"])
    x = VectorAssembler(inputCols=FEATS, outputCol="features").transform(rows)
    kept, walked = (est.copy({est.cacheNodeIds: c}).fit(x).toDebugString.split("\n", 1)[1] for c in (True, False))
    assert kept == walked


def test_filter_on_scores_scores_once(spark):
    p6 = spark.createDataFrame([(-1,), (0,), (7,), (1_000_000,), (1_000_001,), (None,)], "p6 int")
    assert sorted(r.p6 for r in p6.where(TR.has_probability()).collect()) == [0, 7, 1_000_000]
    scored = spark.range(5).select("id", vector_to_array(array_to_vector(F.array(F.col("id").cast("double"))))[0].cast("int").alias("p6"))
    plan = scored.where(TR.has_probability()).drop("p6")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("UDF(UDF(") == 1


def test_shapley_additivity_and_ranking(spark, signal_rows):
    cell = signal_rows.where("stratum = 'a'")
    tr = TR.prepare_training(cell.where(~F.col("is_test")), ["stratum", "outcome"])
    model = TR.fit(tr, "LR", FEATS)
    test = cell.where("is_test")
    explain = TR.index_rows(test, ["stratum", "outcome"], "row_id", 10, "e", out="_e")
    bg = TR.index_rows(test, ["stratum", "outcome"], "row_id", 20, "bg")
    phi = TR.permutation_shapley(model, explain, bg, ["stratum", "outcome"], FEATS, n_perm=4)
    s = phi.groupBy("row_id").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    p = TR.score(model, explain).select("row_id", (F.col("p6") / 1e6).alias("p"))
    for r in s.join(p, "row_id").collect():
        assert r.s + r.b == pytest.approx(r.p, abs=2e-6)
    top = (phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("m")).orderBy(F.desc("m")).first().feature)
    assert top in ("f1", "f2")


def test_search_failed_fits_and_empty_cells(spark, table, monkeypatch):
    monkeypatch.setitem(TR.SEARCH_SPACE, "RF", {"numTrees": (5, 10, "int"), "maxDepth": (2, 4, "int"), "minSplit": (2, 10, "int")})
    real = TR.fit

    def fit(train, algo, *a, **k):
        if algo == "LR":
            raise ValueError("no such solver")
        return real(train, algo, *a, **k)

    monkeypatch.setattr(TR, "fit", fit)
    res = TR.train_grid(table, ["stratum", "outcome"], [("a", "o"), ("nobody", "o")], ["LR", "RF"], FEATS, n_trials=2)
    assert len(res[(("a", "o"), "RF")]["trials"]) == 2 and res[(("a", "o"), "RF")]["model"] is not None
    grid = {(r.stratum, r.algo): r.error for r in TR.grid_frame(spark, ["stratum", "outcome"], res).collect()}
    assert grid == {("a", "RF"): None, ("a", "LR"): "ValueError: no such solver", ("nobody", "RF"): "too few positives", ("nobody", "LR"): "too few positives"}


def test_fold_refits_and_scan_pruning(spark, table):
    oof = TR.cv_fold_scores(table, ["stratum", "outcome"], [], [], FEATS, pairs=[(("a", "o"), "LR")], k=2)
    assert oof.where("fold < 2").count() == table.where("stratum = 'a' and fold < 2").count()
    plan = table.where("stratum = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stratum" in plan


def test_shapley_within_its_error_of_full_enumeration(spark, signal_rows):
    import itertools
    import numpy as np
    few = FEATS[:4]
    cell = signal_rows.where("stratum = 'a'")
    model = TR.fit(TR.prepare_training(cell.where(~F.col("is_test")), ["stratum", "outcome"]), "LR", few)
    test = cell.where("is_test")
    explain = TR.index_rows(test, ["stratum", "outcome"], "row_id", 6, "e", out="_e")
    bg = TR.index_rows(test, ["stratum", "outcome"], "row_id", 10, "bg")
    coef, b0 = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = lambda x: 1 / (1 + np.exp(-(x @ coef + b0)))
    back = bg.select(*few).toPandas().to_numpy()
    exact = {}
    for r in explain.select("row_id", *few).collect():
        x, total = np.array([r[f] for f in few]), np.zeros(4)
        for order in itertools.permutations(range(4)):
            walk = back.copy()
            before = p(walk).mean()
            for j in order:
                walk[:, j] = x[j]
                total[j] += p(walk).mean() - before
                before = p(walk).mean()
        exact.update({(r["row_id"], f): t / 24 for f, t in zip(few, total)})
    got = TR.permutation_shapley(model, explain, bg, ["stratum", "outcome"], few, n_perm=64).collect()
    assert len(got) == 24
    for r in got:
        assert abs(r.phi - exact[(r.row_id, r.feature)]) <= 5 * r.se + 1e-9
    assert all(r.se is None for r in TR.permutation_shapley(model, explain, bg, ["stratum", "outcome"], few, n_perm=2).collect())
