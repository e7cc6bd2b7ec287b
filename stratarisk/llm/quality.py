"""Quality classifier by co-training on two views of a document.

The content view sees the text (letter case, symbols, repetition, word
lengths); the metadata view sees language, source, length and line layout.
Both are logistic regressions fitted on labelled documents. In every round,
each scores unlabelled documents, and those it is sure of are given, with its
label, to the other's training set. At the end each view is calibrated on
labelled documents that no round trained on, and the calibrated log-odds are
added (less the prior, counted twice otherwise) to score all documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: at most about so many labelled rows are fitted on, and so many unlabelled ones get pseudo-labels in a round (chosen by hash)
FIT_ROWS, POOL_ROWS = 20_000, 20_000
#: bytes of text handled at once
SLICE_BYTES = 1 << 18
ROUNDS, SURE, PSEUDO_WEIGHT = 2, 0.98, 0.5
LANG_BINS, SOURCE_BINS = 8, 32
N_CONTENT, N_META = 18, 6 + LANG_BINS + SOURCE_BINS

KIND = np.zeros(256, np.int8)  # 1 upper, 2 lower, 3 digit, 4 symbol, 5 sentence mark, 6 not ASCII
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 6
for _c in b"#$%&*+/<=>@\\^_`{|}~[]":
    KIND[_c] = 4
for _c in b"!?":
    KIND[_c] = 5


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def content_view(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Features of the texts of a slice, a row each."""
    n_bytes = np.diff(off).astype(float)
    kinds = [C.sums((KIND[raw] == k).astype(np.int64), off) for k in range(1, 7)]
    s, e, row = C.words(off, raw)
    n = len(off) - 1
    at = C.by_row(row, n)
    count = np.diff(at).astype(float)
    h = C.span_hashes(raw, s, e)
    same = (lambda x, r: ((x[1:] == x[:-1]) & (r[1:] == r[:-1])).astype(np.int64))
    follow = np.bincount(row[1:], same(h, row), n) if len(h) > 1 else np.zeros(n)
    pairs = C.run_hashes(h, np.arange(max(0, len(h) - 1)), 2)
    pair_row = row[:-1][row[1:] == row[:-1]] if len(row) > 1 else row[:0]
    pairs = pairs[row[1:] == row[:-1]] if len(row) > 1 else pairs
    distinct, twice = [], []
    for key, r in ((h, row), (pairs, pair_row)):
        order = C.grouped_order(r, key)
        key, r = key[order], r[order]
        distinct.append(n and np.bincount(r, np.concatenate([[1], ((key[1:] != key[:-1]) | (r[1:] != r[:-1])).astype(float)])[: len(r)], n))
        twice.append(np.bincount(r, minlength=n).astype(float))
    width = (e - s).astype(float)
    mean = _share(np.bincount(row, width, n), count)
    spread = np.sqrt(np.maximum(0, _share(np.bincount(row, width ** 2, n), count) - mean ** 2))
    last = raw[e - 1] if len(e) else raw[:0]
    loud = np.bincount(row, last == 33, n) if len(e) else np.zeros(n)
    lone = np.bincount(row, (width == 1) & (KIND[raw[s]] == 4), n) if len(s) else np.zeros(n)
    tail = np.bincount(row, KIND[last] == 4, n) if len(e) else np.zeros(n)
    letters = kinds[0] + kinds[1] + kinds[5]
    return np.stack([
        _share(kinds[0], letters), _share(kinds[2], n_bytes), _share(kinds[3], n_bytes), _share(kinds[4], n_bytes), _share(kinds[5], n_bytes), _share(letters, n_bytes),
        np.log1p(count), (count < 20).astype(float), _share(distinct[0], count), _share(distinct[1], twice[1]), _share(follow, count), np.minimum(mean, 40.0), np.minimum(spread, 40.0),
        _share(loud, count), _share(lone, count), _share(tail, count), (_share(kinds[0], letters) > 0.5).astype(float), (_share(distinct[0], count) < 0.3).astype(float)], 1)


def metadata_view(off: np.ndarray, raw: np.ndarray, lang: list, source: list) -> np.ndarray:
    n = len(off) - 1
    chars = C.sums(((raw & 0xC0) != 0x80).astype(np.int64), off).astype(float)
    lines = C.sums((raw == 10).astype(np.int64), off) + 1.0
    size = np.diff(off).astype(float)
    out = np.zeros((n, N_META))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(chars), np.log1p(lines), np.log1p(chars / lines)
    out[:, 3], out[:, 4], out[:, 5] = _share(size, chars), chars < 200, lines < 2
    for first, bins, names in ((6, LANG_BINS, lang), (6 + LANG_BINS, SOURCE_BINS, source)):
        for i, v in enumerate(names):
            if v is not None:
                out[i, first + sum((k + 1) * b for k, b in enumerate(str(v).encode())) % bins] = 1.0
    return out


def _views(batch: pa.RecordBatch, names: list[str]):
    """(first row, content, metadata) for the slices of a batch whose columns are named ``names``."""
    col = batch.column(names.index("text"))
    extra = [batch.column(names.index(c)) if c in names else None for c in ("lang", "source")]
    for lo, off, raw in C.slices(col, SLICE_BYTES):
        n = len(off) - 1
        lang, source = (c.slice(lo, n).to_pylist() if c is not None else [None] * n for c in extra)
        yield lo, content_view(off, raw), metadata_view(off, raw, lang, source)


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, content, meta): both views of every row."""
    names = [c for c in ("text", "lang", "source") if c in docs.columns]
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.list_(pa.float64())), ("meta", pa.list_(pa.float64()))])

    def run(batches):
        for x in batches:
            for lo, a, b in _views(x.select(range(1, x.num_columns)), names):
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1))) for v in (a, b)]
                yield pa.RecordBatch.from_arrays([x.column(0).slice(lo, len(a)), *lists], schema=schema)
        C.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *names).mapInArrow(run, "doc_id long, content array<double>, meta array<double>")


def _fit(rows: DataFrame, view: str) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on (view, label, weight); a constant where only one class is there."""
    seen = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    width = N_CONTENT if view == "content" else N_META if view == "meta" else 1
    if len(seen) < 2:
        good = seen.get(1.0, 0.0)
        return np.zeros(width), math.log((good + 1) / (sum(seen.values()) - good + 1))
    made = rows.select(array_to_vector(F.col(view)).alias("features"), "label", "weight")
    model = LogisticRegression(maxIter=40, regParam=1e-3, weightCol="weight", aggregationDepth=2).fit(made)
    return model.coefficients.toArray(), float(model.intercept)


def _logit(view: str, weights: tuple[np.ndarray, float]):
    terms = [F.lit(float(w)) * F.col(view)[i] for i, w in enumerate(weights[0]) if w]
    return sum(terms, F.lit(weights[1]))


def _part(column, n: int):
    return F.pmod(F.xxhash64(column, F.lit("part")), F.lit(n))


def cotrain(seen: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> dict:
    """Fits both views. seen: :func:`features`; labels: doc_id, label (1.0 good, 0.0 bad, null: unlabelled)."""
    known = C.materialize(seen.join(labels.where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")
                          .withColumn("weight", F.lit(1.0)), "quality-labelled")
    n_known, n_seen = known.count(), seen.count()
    share = lambda most, n: int(min(1.0, most / max(1, n)) * (1 << 20))
    draw = _part("doc_id", 1 << 20)
    chosen = C.materialize(known.where(draw < share(fit_rows, n_known)), "quality-chosen")
    held, base = chosen.where(_part(F.hash("doc_id"), 4) == 0), chosen.where(_part(F.hash("doc_id"), 4) != 0)
    pool = C.materialize(seen.join(known.select("doc_id"), "doc_id", "left_anti").where(draw < share(pool_rows, n_seen)), "quality-pool")
    models = {v: _fit(base, v) for v in ("content", "meta")}
    for _ in range(rounds):
        taught = {}
        for teacher, pupil in (("content", "meta"), ("meta", "content")):
            sure = 1 / (1 + F.exp(-_logit(teacher, models[teacher])))
            taught[pupil] = pool.withColumn("p", sure).where((F.col("p") >= SURE) | (F.col("p") <= 1 - SURE)).select(
                pupil, (F.col("p") > 0.5).cast("double").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"))
        models = {v: _fit(base.select(v, "label", "weight").union(taught[v]), v) for v in models}
    scales = {v: _fit(held.select(F.array(_logit(v, models[v])).alias("logit"), "label", "weight"), "logit") for v in models}
    good, n = held.agg(F.sum("label"), F.count(F.lit(1))).first()
    C.discard(known, chosen, pool)
    prior = math.log(((good or 0) + 1) / (n - (good or 0) + 1))
    scales = {v: ((np.maximum(w, 0.0), b) if w[0] > 0 else (np.zeros(1), prior)) for v, (w, b) in scales.items()}
    return {"models": models, "scales": scales, "prior": prior, "fitted": n_known > 0}


def combined(model: dict, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Probability that a document is good, from both calibrated views; 1 where nothing was labelled."""
    if not model["fitted"]:
        return np.ones(len(content))
    total = -model["prior"]
    for name, x in (("content", content), ("meta", meta)):
        (w, b), (scale, shift) = model["models"][name], model["scales"][name]
        total = total + (x @ w + b) * scale[0] + shift
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    seen = C.materialize(features(docs, id_col), "quality-features")
    model = cotrain(seen, labels)
    C.discard(seen)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``.

    docs needs text and may have lang and source (null or missing: unknown).
    labels: id and label (1 good, 0 bad); of several labels of an id the
    largest counts, null ones do not. Null or empty texts are scored like any
    other. Without labels all documents are kept with score 1. Rows may
    repeat; other columns are ignored.
    """
    seen = C.materialize(features(docs, id_col), "quality-features")
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    model = seen.sparkSession.sparkContext.broadcast(cotrain(seen, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        for x in batches:
            a, b = (np.asarray(x.column(i).flatten()).reshape(x.num_rows, -1) if x.num_rows else np.zeros((0, w)) for i, w in ((1, N_CONTENT), (2, N_META)))
            p = combined(model.value, a, b) if x.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(p), pa.array(p >= threshold)], schema=schema)

    return seen.mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are. Same rules as :func:`score_documents`."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, id_col, label_col))
    names = docs.columns

    def run(batches):
        for x in batches:
            keep = [combined(model.value, a, b) >= threshold for _, a, b in _views(x, names)]
            yield x.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        C.release()

    return docs.mapInArrow(run, docs.schema)
