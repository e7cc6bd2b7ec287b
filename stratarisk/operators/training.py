"""Per-cell model training, tuning, cross-validation and explanation with Spark ML.

Each (cell, algorithm) fit is a distributed Spark ML job over that cell's
rows; independent fits are submitted concurrently from a small driver thread
pool (the driver only holds fitted-model handles and parameter dicts). A
failing fit becomes a null result row carrying its error text, as in the
study, instead of aborting the grid.

Model families (Spark ML counterparts of the study's libraries):

* ``LR``   LogisticRegression, balanced weights; C = 1 maps to regParam = 1/n
  because balanced weights sum to n; no standardisation, maxIter 1000.
* ``RF``   RandomForestClassifier(numTrees, maxDepth, minInstancesPerNode = half
  the smallest node that is split).
* ``LGBM`` GBTClassifier(maxIter, maxDepth, stepSize, subsamplingRate,
  featureSubsetStrategy); Spark grows trees level-wise, not leaf-wise.
* ``XGB``  GBTClassifier with a second configuration (more histogram bins).
* ``MLP``  MultilayerPerceptronClassifier (sigmoid hidden layers, L-BFGS, no
  L2 term and no class weights).

Where many small fits share a table, ``operators/grid.py`` trains them side by
side instead (Newton steps, histogram trees, gradient nets).
"""

from __future__ import annotations

import hashlib
import math
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarisk import config as C
from stratarisk.functions.hashing import hash_uniform
from stratarisk.operators import cohort as CO
from stratarisk.operators import metrics as M
from stratarisk.session import scratch_path

# Search spaces: name -> (low, high, kind) with kind int | float | log.
SEARCH_SPACE = {
    "LR": {},
    "RF": {"numTrees": (100, 500, "int"), "maxDepth": (3, 15, "int"),
           "minSplit": (2, 10, "int")},
    "LGBM": {"maxIter": (100, 500, "int"), "maxDepth": (3, 7, "int"), "stepSize": (0.01, 0.1, "log"),
             "subsamplingRate": (0.7, 1.0, "float"), "featureSubset": (0.7, 1.0, "float")},
    "XGB": {"maxIter": (100, 500, "int"), "maxDepth": (3, 7, "int"), "stepSize": (0.01, 0.1, "log"),
            "subsamplingRate": (0.7, 1.0, "float"), "featureSubset": (0.7, 1.0, "float")},
    # L2 strength and learning rate are those of the gradient net (operators/nets.py); the L-BFGS net has neither
    "MLP": {"n_layers": (1, 3, "int"), "n_units": (32, 256, "int"), "alpha": (1e-5, 1e-2, "log"), "learning_rate": (1e-4, 1e-2, "log")},
}
# Parameters used when a model is refitted without tuning (k-fold CV falls
# back to 128 units x 2 layers for the net, as in the study).
DEFAULT_PARAMS = {
    "LR": {}, "RF": {"numTrees": 100, "maxDepth": 8, "minSplit": 2},
    "LGBM": {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubset": 0.8},
    "XGB": {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubset": 0.8},
    "MLP": {"n_layers": 2, "n_units": 128},
}


def draw_params(algo: str, trial: int, key: str, seed: int = C.SEED) -> dict:
    """Seeded random draw from the algorithm's search space (same draw on every run)."""
    h = int(hashlib.md5(f"{key}:{algo}:{trial}:{seed}".encode()).hexdigest()[:16], 16)
    rng = random.Random(h)
    out = {}
    for name, (lo, hi, kind) in SEARCH_SPACE[algo].items():
        if kind == "int":
            out[name] = rng.randint(int(lo), int(hi))
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        else:
            out[name] = rng.uniform(lo, hi)
    return out


def make_estimator(algo: str, params: dict, n_features: int, n_train: int, seed: int = C.SEED,
                   weighted: bool = True):
    p = dict(DEFAULT_PARAMS[algo], **(params or {}))
    common = dict(featuresCol="features", labelCol="label")
    w = {"weightCol": "weight"} if weighted else {}
    if algo == "LR":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, **w, **common)
    if algo == "RF":
        return RandomForestClassifier(numTrees=int(p["numTrees"]), maxDepth=int(p["maxDepth"]),
                                      # a node of s rows splits into leaves of s // 2 at least
                                      minInstancesPerNode=max(1, int(p["minSplit"]) // 2),
                                      # each row keeps its node in every tree, so a level does not walk down from the roots again
                                      cacheNodeIds=True, seed=seed, **w, **common)
    if algo in ("LGBM", "XGB"):
        return GBTClassifier(maxIter=int(p["maxIter"]), maxDepth=int(p["maxDepth"]),
                             stepSize=float(p["stepSize"]), subsamplingRate=float(p["subsamplingRate"]),
                             featureSubsetStrategy=str(round(float(p["featureSubset"]), 3)),
                             maxBins=32 if algo == "LGBM" else 256, seed=seed, **w, **common)
    if algo == "MLP":
        layers = [n_features] + [int(p["n_units"])] * int(p["n_layers"]) + [2]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=300, seed=seed, **common)
    raise ValueError(f"unknown algorithm {algo}")


def prepare_training(rows: DataFrame, cell_cols: list[str], label_col: str = "y") -> DataFrame:
    """Attach balanced class weights (computed on the rows given) and a double label."""
    w = CO.class_weights(rows, cell_cols, label_col)
    r = CO.weight_rows(rows, w, cell_cols, label_col)
    return r.withColumn("label", F.col(label_col).cast("double"))


def fit(train: DataFrame, algo: str, features: list[str], params: dict | None = None,
        seed: int = C.SEED, n_train: int | None = None) -> PipelineModel:
    n = n_train if n_train is not None else train.count()
    est = make_estimator(algo, params or {}, len(features), n, seed, weighted=(algo != "MLP"))
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, est]).fit(train)


def score(model: PipelineModel, df: DataFrame, out: str = "p6") -> DataFrame:
    """Positive-class probability as integer micro-units."""
    s = model.transform(df)
    p = vector_to_array(F.col("probability")).getItem(1)
    keep = [c for c in df.columns]
    return s.select(*keep, F.round(p * F.lit(1e6)).cast("int").alias(out))


def has_probability(p6: str = "p6"):
    """0 <= p6 <= 1,000,000 in one comparison: a filter sinks below the score, and each mention of it walks the model again."""
    return F.abs(F.col(p6) - 500_000) <= 500_000


def training_table(rows: DataFrame, cell_cols: list[str]) -> DataFrame:
    """``rows`` written once as Parquet, a folder per cell, under the shared folder, and read back.

    Fits, scoring, folds, attribution and perturbation all read this table: a
    filter on the cell columns prunes to one folder, and nothing upstream is
    computed again. Rows of a cell are spread over several files by a hash of
    the row, so a large cell is not one writer's work.
    """
    path = scratch_path(rows.sparkSession, "training")
    rows.write.partitionBy(*cell_cols).parquet(path)
    # partition folders would make numbers of digit-only names: the schema is given
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def _cell_filter(cell_cols: list[str], cell: tuple) -> F.Column:
    cond = None
    for c, v in zip(cell_cols, cell):
        e = F.col(c) == F.lit(v)
        cond = e if cond is None else cond & e
    return cond


def train_grid(rows: DataFrame, cell_cols: list[str], cells: list[tuple], algos: list[str],
               features: list[str], n_trials: int = 20, seed: int = C.SEED, parallelism: int = 4,
               tune_on: str = "inner", min_positives: int = C.MIN_POSITIVES_TRAIN, deadline: float | None = None) -> dict:
    """Fit every (cell, algo) with random search; returns {(cell, algo): result dict}.

    ``rows`` is a :func:`training_table`: one row per (row, cell) with features,
    label ``y`` and ``is_test``. Tuning maximises AUC on an inner split of the
    training part, or on the reported hold-out when ``tune_on='holdout'``.
    A cell below ``min_positives`` and a fit that fails keep an entry with the
    error's text. ``parallelism`` fits are submitted at a time, each family in
    a scheduler pool of its own (taken up where ``spark.scheduler.mode`` is
    FAIR). A fit that takes more than ``deadline`` seconds is cancelled and
    keeps an entry that says so.
    """
    counts: dict = {}
    for r in rows.groupBy(*cell_cols, "is_test", "y").agg(F.count(F.lit(1)).alias("_n")).collect():
        counts[(tuple(r[c] for c in cell_cols), r["is_test"], r["y"])] = r["_n"]

    def weighted(df, n_cls):
        n = sum(n_cls.values())
        w = F.lit(None).cast("double")
        for y, m in n_cls.items():
            if m:
                w = F.when(F.col("y") == y, F.lit(n / (2.0 * m))).otherwise(w)
        return df.withColumn("weight", w).withColumn("label", F.col("y").cast("double"))

    def run(cell, algo):
        key = ":".join(str(c) for c in cell)
        if sum(counts.get((cell, t, 1), 0) for t in (False, True)) < min_positives:
            return (cell, algo), {"model": None, "error": "too few positives", "trials": []}
        trials: list = []
        try:
            own = rows.where(_cell_filter(cell_cols, cell))
            n_cls = {y: counts.get((cell, False, y), 0) for y in (0, 1)}
            tr = weighted(own.where(~F.col("is_test")), n_cls)
            n_tr = sum(n_cls.values())
            n = n_trials if SEARCH_SPACE[algo] else 0
            if n and tune_on == "inner":
                inner = tr.withColumn("_iv", hash_uniform(F.col("row_id"), "inner", seed) < 0.2)
                tr_fit, ev_tune = inner.where(~F.col("_iv")), inner.where(F.col("_iv"))
                n_fit = tr_fit.count()
            else:
                tr_fit, ev_tune, n_fit = tr, own.where(F.col("is_test")), n_tr
            best_p, best_auc = DEFAULT_PARAMS[algo], None
            for t in range(n):
                p = draw_params(algo, t, key, seed)
                m = fit(tr_fit, algo, features, p, seed, n_fit)
                a = M.auc(score(m, ev_tune), []).first()["auc"]
                trials.append((t, p, a))
                if a is not None and (best_auc is None or a > best_auc):
                    best_p, best_auc = p, a
            model = fit(tr, algo, features, best_p, seed, n_tr)
            return (cell, algo), {"model": model, "params": best_p, "trials": trials, "error": None}
        except Exception as e:  # noqa: BLE001 - a failed fit is a null result row
            return (cell, algo), {"model": None, "error": f"{type(e).__name__}: {e}", "trials": trials}

    def timed(cell, algo):
        late = f"DeadlineExceeded: cancelled after {deadline} s"
        done, got = within(rows.sparkSession, lambda: run(cell, algo), deadline, pool=algo)
        return got if done else ((cell, algo), {"model": None, "error": late, "trials": []})

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        futs = [ex.submit(timed, tuple(c), a) for c in cells for a in algos]
        return dict(f.result() for f in futs)


def within(spark, work, deadline: float | None, pool: str | None = None, every: float = 0.5):
    """(True, work()) or, where ``deadline`` seconds do not suffice, (False, None) with all Spark jobs of ``work`` cancelled.

    The work runs in a thread whose jobs carry a tag of its own. After the
    deadline jobs with that tag are cancelled again and again until the thread
    ends, as it may start further ones; a thread that hangs outside Spark is
    left behind after a few tries.
    """
    sc, tag, box = spark.sparkContext, f"fit-{uuid.uuid4().hex}", []

    def body():
        sc.addJobTag(tag)
        if pool:
            sc.setLocalProperty("spark.scheduler.pool", pool)
        try:
            box.append((True, work()))
        except Exception as e:  # noqa: BLE001 - handed to the caller's thread
            box.append((False, e))

    t = InheritableThread(target=body, daemon=True)
    t.start()
    t.join(deadline)
    if not t.is_alive():
        ok, got = box[0]
        if not ok:
            raise got
        return True, got
    for _ in range(20):
        sc.cancelJobsWithTag(tag)
        t.join(every)
        if not t.is_alive():
            break
    return False, None


#: errors that lie in a cell's rows: there is nothing to fit. Any other error is a fit that failed
NO_FIT = ("too few positives", "one class only")


def none_failed(errors: dict) -> None:
    """Raise where a fit of ``errors`` ((cell, algo) -> text or None) has failed: for results without a row for its error."""
    failed = [f"{':'.join(map(str, c))} {a}: {e}" for (c, a), e in errors.items() if e and e not in NO_FIT]
    if failed:
        raise RuntimeError(f"{len(failed)} fits failed: " + "; ".join(failed)[:2000])


def grid_frame(spark, cell_cols: list[str], results: dict) -> DataFrame:
    """One row per attempted (cell, algo) with the error of those without a model; sized by the grid."""
    schema = ", ".join(f"{c} string" for c in cell_cols) + ", algo string, error string"
    return spark.createDataFrame([(*map(str, cell), algo, r.get("error")) for (cell, algo), r in results.items()], schema)


def scored_holdout(rows: DataFrame, cell_cols: list[str], results: dict) -> DataFrame | None:
    """Hold-out rows of every fitted (cell, algo) scored, as one long table."""
    parts = []
    for (cell, algo), r in results.items():
        if r.get("model") is None:
            continue
        ev = rows.where(_cell_filter(cell_cols, cell) & F.col("is_test"))
        parts.append(score(r["model"], ev).withColumn("algo", F.lit(algo)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_fold_scores(rows: DataFrame, cell_cols: list[str], cells: list[tuple], algos: list[str],
                   features: list[str], params: dict | None = None, k: int = C.N_FOLDS,
                   seed: int = C.SEED, parallelism: int = 4, pairs: list[tuple] | None = None) -> DataFrame:
    """Out-of-fold scores: for each fold, refit on the other folds and score it.

    ``rows`` is a :func:`training_table` with a ``fold`` column (label-stratified,
    see keys.stratified_folds). ``pairs`` names the (cell, algo) to refit, by
    default all of ``cells`` x ``algos``; ``params`` has the tuned parameters of
    each; the net always refits with its default layers.
    """
    pairs = pairs if pairs is not None else [(tuple(c), a) for c in cells for a in algos]
    # Balanced weights of every (cell, held-out fold) training set at once:
    # class counts per (cell, fold, label) are tiny, and the training set of
    # fold f is "all folds minus f".
    per = rows.groupBy(*cell_cols, "fold", "y").agg(F.count(F.lit(1)).alias("_c")).collect()
    tot, by_fold = {}, {}
    for r in per:
        key = tuple(r[c] for c in cell_cols)
        tot[(key, r["y"])] = tot.get((key, r["y"]), 0) + r["_c"]
        by_fold[(key, r["fold"], r["y"])] = r["_c"]

    def run(cell, algo, f):
        c = _cell_filter(cell_cols, cell)
        n_cls = {y: tot.get((cell, y), 0) - by_fold.get((cell, f, y), 0) for y in (0, 1)}
        n_tr = n_cls[0] + n_cls[1]
        w = F.lit(None).cast("double")
        for y, n in n_cls.items():
            if n > 0:
                w = F.when(F.col("y") == y, F.lit(n_tr / (2.0 * n))).otherwise(w)
        tr = (rows.where(c & (F.col("fold") != f)).withColumn("weight", w)
              .withColumn("label", F.col("y").cast("double")))
        own = DEFAULT_PARAMS[algo] if algo == "MLP" else (params or {}).get((cell, algo), DEFAULT_PARAMS[algo])
        m = fit(tr, algo, features, own, seed, n_tr)
        return score(m, rows.where(c & (F.col("fold") == f))).withColumn("algo", F.lit(algo))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        futs = [ex.submit(run, tuple(c), a, f) for c, a in pairs for f in range(k)]
        parts = [x.result() for x in futs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: background rows that are broadcast at most (all groups together)
MAX_BACKGROUND = 100_000


def permutation_shapley(model: PipelineModel, explain: DataFrame, background: DataFrame,
                        keys: list[str], features: list[str], n_perm: int = 8,
                        seed: int = C.SEED) -> DataFrame:
    """Sampling Shapley values (Strumbelj & Kononenko 2014) as one DataFrame job.

    For every explained row and permutation m: pick a background row by
    hash, order the features by hash, and walk from the background row to
    the explained row one feature at a time (d + 1 steps). All steps are
    scored by one ``model.transform``; the difference between consecutive
    steps (``lag`` over (row, m)) is the contribution of the feature added
    at that step. Averaging over m gives phi. The walk telescopes, so
    ``sum(phi) + base = p(x)`` with ``base`` the mean background score.
    Permutations come in antithetic pairs: an order and its reverse from the
    same background row. ``se`` is the standard error of phi over the pairs
    (null for a single pair). Returns (row_id, keys, feature, phi, x, base, se).
    """
    d = len(features)
    if background.limit(MAX_BACKGROUND + 1).count() > MAX_BACKGROUND:
        raise ValueError(f"the background table is broadcast; sample it to {MAX_BACKGROUND} rows (see index_rows)")
    bg = background.select(*keys, F.col("bg_idx"), *[F.col(f).alias(f"bg_{f}") for f in features])
    nbg = background.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nbg"))
    e = explain.join(F.broadcast(nbg), keys)
    e = e.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    e = e.withColumn("pair", F.floor((F.col("m") + 1) / 2).cast("int"))
    e = e.withColumn("bg_idx", (F.floor(hash_uniform(F.col("row_id"), F.col("pair"), "bg", seed)
                                        * F.col("_nbg")) + 1).cast("bigint"))
    e = e.join(F.broadcast(bg), keys + ["bg_idx"])
    feats = F.array(*[F.lit(f) for f in features])
    order = F.transform(
        F.array_sort(F.transform(feats, lambda f: F.struct(
            F.conv(F.substring(F.md5(F.concat_ws(":", F.col("row_id").cast("string"),
                                                  F.col("pair").cast("string"), f, F.lit(str(seed)))), 1, 8), 16, 10)
            .cast("bigint").alias("h"), f.alias("f")))),
        lambda s: s["f"])
    e = e.withColumn("_order", F.when(F.col("m") % 2 == 0, F.reverse(order)).otherwise(order)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(d))))
    walk = {f: F.when(F.array_position("_order", f) <= F.col("s"), F.col(f)).otherwise(F.col(f"bg_{f}"))
            for f in features}
    steps = e.select("row_id", *keys, "m", "pair", "s", "_order", *[walk[f].alias(f) for f in features],
                     *[F.col(f).alias(f"x_{f}") for f in features])
    scored = model.transform(steps).withColumn("_p", vector_to_array("probability").getItem(1))
    w = Window.partitionBy("row_id", *keys, "m").orderBy("s")
    diffs = (scored.withColumn("_dp", F.col("_p") - F.lag("_p").over(w))
             .withColumn("_base", F.first("_p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
             .where(F.col("s") > 0)
             .withColumn("feature", F.element_at("_order", F.col("s").cast("int"))))
    xval = F.coalesce(*[F.when(F.col("feature") == F.lit(f), F.col(f"x_{f}")) for f in features])
    pairs = diffs.groupBy("row_id", *keys, "feature", "pair").agg(
        F.avg("_dp").alias("_one"), F.sum("_dp").alias("_dp"), F.sum("_base").alias("_base"), F.count(F.lit(1)).alias("_n"), F.first(xval).alias("_x"))
    return pairs.groupBy("row_id", *keys, "feature").agg(
        (F.sum("_dp") / F.sum("_n")).alias("phi"), F.first("_x").alias("x"), (F.sum("_base") / F.sum("_n")).alias("base"),
        F.nanvl(F.stddev_samp("_one") / F.sqrt(F.count(F.lit(1))), F.lit(None).cast("double")).alias("se"))


def index_rows(df: DataFrame, keys: list[str], id_col: str, n: int, tag: str, seed: int = C.SEED,
               out: str = "bg_idx") -> DataFrame:
    """At most n rows per group numbered 1..n by hash order (exact top-k)."""
    from stratarisk.operators.keys import hash_top_k
    return hash_top_k(df, keys, id_col, n, tag, seed, out=out)
