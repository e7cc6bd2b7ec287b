"""A fit that fails is no result: queries without a row for its error raise, cells without enough rows are left out as before."""

import pytest
from pyspark.sql import functions as F

from stratarisk.functions.hashing import hash_uniform
from stratarisk.operators import boosting as B
from stratarisk.operators import grid as GR
from stratarisk.operators import training as TR
from stratarisk.plans import catalog

CELL, CELLS, FEATS = ["stratum", "outcome"], [("a", "o"), ("b", "o")], ["f1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).withColumnRenamed("id", "row_id").withColumns({f: hash_uniform(F.col("row_id"), f) for f in FEATS})
    y = (hash_uniform(F.col("row_id"), "label") < F.col("f1")).cast("int")
    # stratum "b" has too few positives
    df = df.select("*", F.when(F.col("row_id") % 4 > 0, "a").otherwise("b").alias("stratum"), F.lit("o").alias("outcome"), (F.col("row_id") % 3 == 0).alias("is_test"),
                   (F.col("row_id") % 2).cast("int").alias("fold"), F.when(F.col("row_id") % 4 > 0, y).otherwise((F.col("row_id") < 40).cast("int")).alias("y"))
    return spark.createDataFrame(df.collect(), df.schema)


def folds_of_best(rows):
    return GR.best_fold_scores(rows, CELL, CELLS, ["LR", "RF", "XGB"], FEATS, {"holdout": ~F.col("is_test")}, {f"fold {f}": F.col("fold") != f for f in range(2)},
                               lambda s: s, lambda s: {("a", "o"): "LR"})


def test_fold_scores_do_not_leave_out_a_family_that_failed(rows, monkeypatch):
    real = B.Boosting.grow
    monkeypatch.setattr(B.Boosting, "grow", lambda self, n: 1 / 0 if any(f.family == "RF" for f in self.fits) else real(self, 1))
    with pytest.raises(RuntimeError, match="a:o RF: ZeroDivisionError"):
        folds_of_best(rows)


def test_cells_without_enough_rows_are_no_failures(rows, monkeypatch):
    real = B.Boosting.grow
    monkeypatch.setattr(B.Boosting, "grow", lambda self, n: real(self, 1))
    assert {r["stratum"] for r in folds_of_best(rows).select("stratum").distinct().collect()} == {"a"}


@pytest.fixture
def queries_on(rows, monkeypatch):
    """The registered queries on the rows above."""
    table = rows.withColumn("year", F.lit(2000))
    monkeypatch.setattr(catalog, "_train_rows", lambda spark, sf_dir: table)
    monkeypatch.setattr(catalog, "_cells", lambda: CELLS)
    monkeypatch.setattr(catalog, "TRAIN_FEATURES", FEATS)
    return catalog.QUERIES


def test_verdicts_are_not_given_without_a_family_that_failed(spark, queries_on, monkeypatch):
    monkeypatch.setattr(B.Boosting, "grow", lambda self, n: 1 / 0)
    with pytest.raises(RuntimeError, match="a:o LGBM: ZeroDivisionError"):
        queries_on["trained_verdicts"](spark, "")


@pytest.mark.parametrize("name", ["scored_rows", "score_cells", "perturb_run", "model_roundtrip"])
def test_models_that_failed_are_not_left_out(spark, queries_on, monkeypatch, name):
    real = TR.fit

    def fit(train, algo, *a, **k):
        if train.select("stratum").first()[0] == "b":
            raise ValueError("lost")
        return real(train, algo, *a, **k)

    monkeypatch.setattr(TR, "fit", fit)
    monkeypatch.setitem(TR.DEFAULT_PARAMS, "RF", {"numTrees": 2, "maxDepth": 2, "minSplit": 2})
    queries_on[name](spark, "")
    grid = TR.train_grid
    monkeypatch.setattr(TR, "train_grid", lambda *a, **k: grid(*a, **{**k, "min_positives": 1}))
    with pytest.raises(RuntimeError, match="b:o .*ValueError: lost"):
        queries_on[name](spark, "")
