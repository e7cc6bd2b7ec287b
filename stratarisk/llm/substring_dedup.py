"""Substring dedup: winnowed anchors as seeds, extension both ways, maximal repeats removed.

A window of ``window`` consecutive words is repeated if its word sequence also
starts at another place, in any document. Every word that a repeated window
covers is removed; windows are judged on the input.

* Seeds: of the k-grams in a window, the one with the smallest hash (rightmost
  on ties) is its anchor. Equal windows have equal anchors at equal offsets, so
  only anchors whose k-gram occurs twice can belong to a repeat.
* Extension: an anchor's reach is everything covered by the windows that chose
  it, to its left and to its right. Places with the same anchor and the same
  reach are one class; all windows of a class with two places are repeated,
  without comparing the places pairwise. Between classes of one anchor (copies
  that part somewhere within the reach), single windows are counted instead.
* Runs of repeated windows join to the maximal repeats, of ``window`` words or
  more, and are cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
WINDOW, ANCHOR = 35, 10


def anchors(off: np.ndarray, raw: np.ndarray, window: int, k: int):
    """Word hashes of a slice and its anchors: (hashes, row, word in the slice, first window, number of windows, k-gram hash)."""
    s, e, row = C.words(off, raw)
    h = C.span_hashes(raw, s, e)
    at = C.by_row(row, len(off) - 1)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return h, at, none, none, none, none, np.zeros(0, U64)
    grams = C.run_hashes(h, np.arange(len(h) - k + 1), k)
    best = ((grams >> U64(32)) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(grams), dtype=U64))
    width, have = window - k + 1, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    start = np.flatnonzero(at[1:][row] - np.arange(len(h)) >= window)
    place = (U64(0xFFFFFFFF) - (best[start] & U64(0xFFFFFFFF))).astype(np.int64)
    if not len(start):
        return h, at, none, none, none, none, np.zeros(0, U64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(new, len(place)))
    return h, at, row[start[new]], place[new], start[new], n, grams[place[new]]


def _seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    schema = pa.schema([("k", pa.int64())])

    def run(batches):
        for x in batches:
            for _, off, raw in C.slices(x.column(0)):
                yield pa.RecordBatch.from_arrays([C.longs(anchors(off, raw, window, k)[-1])], schema=schema)

    return docs.select("text").mapInArrow(run, "k long")


def _places(docs: DataFrame, window: int, k: int, shared) -> DataFrame:
    """Anchors that may be repeated: key, class of its reach, document, first window, windows, and their hashes."""
    schema = pa.schema([("k", pa.int64()), ("reach", pa.int64()), ("doc_id", pa.int64()), ("tid", pa.int64()), ("first", pa.int64()),
                        ("n", pa.int32()), ("wins", pa.binary())])

    def run(batches):
        bits = shared.value
        out = C.Buffered(schema, 20_000)
        for x in batches:
            for lo, off, raw in C.slices(x.column(2)):
                h, at, row, place, first, n, key = anchors(off, raw, window, k)
                keep = C.marked(bits, key)
                row, place, first, n, key = row[keep], place[keep], first[keep], n[keep], key[keep]
                reach = C.run_hashes(h, first, n + window - 1) + C.mix64(((place - first) * 64 + n).astype(U64))
                bounds = np.concatenate([[0], np.cumsum(n)])
                start = np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])
                rows = pa.array(row + lo)
                yield from out.add([C.longs(key), C.longs(reach), x.column(0).take(rows), x.column(1).take(rows), C.longs(first - at[row]),
                                    n, C.packed(C.run_hashes(h, start, window), bounds)])
        yield from out.flush()

    return docs.mapInArrow(run, "k long, reach long, doc_id long, tid long, first long, n int, wins binary")


def _windows(classes: DataFrame) -> DataFrame:
    schema = pa.schema([("k", pa.int64()), ("reach", pa.int64()), ("places", pa.int64()), ("i", pa.int32()), ("win", pa.int64())])

    def run(batches):
        for x in batches:
            at, win = C.unpacked(x.column(3))
            row = np.repeat(np.arange(x.num_rows), np.diff(at))
            yield pa.RecordBatch.from_arrays([x.column(i).take(pa.array(row)) for i in range(3)]
                                             + [pa.array((np.arange(len(row)) - at[:-1][row]).astype(np.int32)), C.longs(win)], schema=schema)

    return classes.select("k", "reach", "places", "wins").mapInArrow(run, "k long, reach long, places long, i int, win long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, tid, marks): for each document with repeats, longs of first window * 2^26 and a mask of the repeated windows from there on."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(C.bitmap(C.repeated(_seeds(docs, window, k))))
    places = C.materialize(_places(docs, window, k, shared), "substring-places")
    classes = C.materialize(places.groupBy("k", "reach").agg(F.count(F.lit(1)).alias("places"), F.first("n").alias("n"), F.first("wins").alias("wins")),
                            "substring-classes")
    parted = classes.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    fine = _windows(classes.join(parted, "k", "left_semi"))
    often = fine.groupBy("k", "win").agg(F.sum("places").alias("c")).where("c > 1").select("k", "win")
    partly = (fine.where("places = 1").join(often, ["k", "win"], "left_semi").groupBy("k", "reach")
              .agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask")))
    wholly = classes.where("places > 1").select("k", "reach", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    marks = (places.select("k", "reach", "doc_id", "tid", "first").join(wholly.union(partly), ["k", "reach"])
             .groupBy("doc_id", "tid").agg(F.collect_set(F.expr("shiftleft(first, 26) + mask")).alias("marks")))
    marks = C.materialize(marks, "substring-marks")
    C.discard(places, classes)
    return marks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) for every row of ``docs``.

    kept_text: the words that stay, joined by one space; spans: start and end
    word of each removed maximal repeat, in turn. A null or blank text has no
    words (kept_text empty); a text of fewer than ``window`` words stays whole.
    Rows may repeat (a row's twin repeats all its windows); ids may be null or
    shared. Other columns are ignored.
    """
    if not 1 <= window - k + 1 <= 26:
        raise ValueError("the window may have at most 26 anchors to choose from")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).alias("text"))
    marks = repeated_windows(docs, window, k).withColumnsRenamed({"doc_id": "_d", "tid": "_t"})
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        for x in batches:
            ids, col, marks = x.column(0), x.column(1), x.column(2)
            mark_at = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(marks.value_lengths().fill_null(0))))]).astype(np.int64)
            mark = np.asarray(marks.flatten(), np.int64)
            for lo, off, raw in C.slices(col):
                n = len(off) - 1
                s, e, row = C.words(off, raw)
                at = C.by_row(row, n)
                own = mark[mark_at[lo]: mark_at[lo + n]]
                base = np.repeat(at[:-1], np.diff(mark_at[lo: lo + n + 1])) + (own >> 26)
                cover = np.zeros(len(s) + window + 27, np.int64)
                for i in range(window - k + 1):
                    hit = base[(own >> i) & 1 == 1] + i
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + window, -1)
                gone = np.cumsum(cover)[: len(s)] > 0
                stay = np.flatnonzero(~gone)
                edge = np.zeros(len(raw) + 1, np.int8)
                np.add.at(edge, s[stay], 1)
                np.add.at(edge, e[stay], -1)
                keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
                text = raw.copy()
                gaps = stay[:-1][row[stay[1:]] == row[stay[:-1]]]
                text[e[gaps]] = 32
                keep[e[gaps]] = True
                text, bounds = text[keep].tobytes(), C.pick(off, keep)
                kept = [text[bounds[i]: bounds[i + 1]].decode("utf-8", "replace") for i in range(n)]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                turn = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])) if len(s) else s
                stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (row[1:] != row[:-1]), [True]])) + 1 if len(s) else s
                flat = np.stack([turn, stop], 1) - at[row[turn]][:, None] if len(turn) else np.zeros((0, 2), np.int64)
                span_at = 2 * np.searchsorted(row[turn], np.arange(n + 1)) if len(turn) else np.zeros(n + 1, np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array(np.diff(at)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string()),
                                                  pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), pa.array(flat.reshape(-1)))], schema=schema)

    return (docs.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tid") == F.col("_t")), "left")
            .select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<long>"))
