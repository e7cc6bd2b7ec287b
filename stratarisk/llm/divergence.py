"""Divergence of sources within a language, on collapsed texts.

Texts that are identical within a language become one row that knows how often
each source has it. Each such text is cut into terms once, and its counts and
document frequencies are added with those weights. Sources are compared by
integer shares of the terms that enough documents of the language hold; pairs
are evaluated sparsely: per term only the sources that hold it meet, inside a
task, and what absent terms contribute follows from how often a source has
each count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

#: documents of the language that hold a kept term at least; terms listed per group
LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: bytes that are part of a term: ASCII letters, and all of a code point beyond ASCII
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: pairs of sources evaluated at once, and sums held inside a task before they go out
PAIRS, HELD = 2_000_000, 1_000_000
#: bytes of text cut into terms at once
TEXT_BYTES = 4 << 20


def collapsed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, text, holders): identical texts of a language once, holders: array of (source, copies). Nulls count as ''.

    Copies are counted per source and combined before the shuffle; one text of
    each group moves from every task that has it.
    """
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = given.withColumn("key", F.sha2("text", 256))
    held = keyed.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("copies"))
    holders = held.groupBy("lang", "key").agg(F.collect_list(F.struct("source", "copies")).alias("holders"))
    texts = keyed.groupBy("lang", "key").agg(F.first("text").alias("text"))
    return texts.join(holders, ["lang", "key"]).select("lang", "text", "holders")


def _runs(off: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``solid`` bytes that row bounds ``off`` do not cross."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _codes(col) -> tuple[np.ndarray, list]:
    """Codes and the values they stand for."""
    d = col.cast(pa.large_string()).dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary.to_pylist()


class _Held:
    """Counts of a task by (group, term), added up whenever enough rows are held; sent on when too many differ."""

    def __init__(self):
        self.tables, self.rows, self.groups = [], 0, {}

    def codes(self, pairs: list) -> np.ndarray:
        return np.array([self.groups.setdefault(p, len(self.groups)) for p in pairs], np.int32)

    def add(self, group, term, n, docs):
        self.tables.append(pa.table({"group": group, "term": term, "n": n, "docs": docs}))
        self.rows += len(n)
        if self.rows > HELD:
            self._sum()
            if self.rows > HELD // 2:
                yield from self.flush()

    def _sum(self):
        summed = pa.concat_tables(self.tables).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        self.tables, self.rows = [summed.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])], summed.num_rows

    def flush(self):
        if not self.rows:
            return
        self._sum()
        names = list(self.groups)
        lang, source = (pa.array([p[k] for p in names], pa.string()) for k in range(2))
        for x in self.tables[0].combine_chunks().to_batches(max_chunksize=100_000):
            yield pa.RecordBatch.from_arrays([lang.take(x.column(0)), source.take(x.column(0)), *x.columns[1:]], names=["lang", "source", "term", "n", "docs"])
        self.tables, self.rows, self.groups = [], 0, {}


def _term_counts(batches):
    """Batches of (lang, text, holders) to rows (lang, source, term, n, docs), added up within the task as far as memory allows."""
    sums = _Held()
    for x in batches:
        lang, langs = _codes(x.column(0))
        holders = x.column(2)
        entries = holders.flatten()
        source, sources = _codes(entries.field(0))
        copies = np.asarray(entries.field(1)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(np.asarray(holders.value_lengths()).astype(np.int64))))
        for lo, off, b in C.slices(x.column(1), TEXT_BYTES):
            b = C.LOWER[b]
            solid = TERM[b]
            s, e = _runs(off, solid)
            if not len(s):
                continue
            row = np.searchsorted(off, s, "right") - 1 + lo
            ends = np.concatenate(([0], np.cumsum(e - s))).astype(np.int64)
            tokens = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(b[solid])]).dictionary_encode()
            terms, size = tokens.dictionary, len(tokens.dictionary)
            held, n = np.unique(row * size + np.asarray(tokens.indices).astype(np.int64), return_counts=True)
            row, term = np.divmod(held, size)
            many = first[row + 1] - first[row]
            each = np.repeat(np.arange(len(row)), many)
            entry = first[row][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            key = (lang[row[each]] * len(sources) + source[entry]) * size + term[each]
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            weight = copies[entry]
            own, back = np.unique(key[at] // size, return_inverse=True)
            group = sums.codes([(langs[g // len(sources)], sources[g % len(sources)]) for g in own.tolist()])[back]
            yield from sums.add(pa.array(group), terms.take(pa.array(key[at] % size)), pa.array(np.add.reduceat((weight * n[each])[order], at)), pa.array(np.add.reduceat(weight[order], at)))
    yield from sums.flush()


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, cells): terms that ``least_docs`` documents of the language hold, cells: array of (source, n).

    The tasks send sums, so the commonest term arrives as few rows from each of
    them; dealing those out by term serves both groupings.
    """
    counts = texts.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
            .where(F.col("docs") >= least_docs).select("lang", "term", "total", "cells"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    return F.expr(f"1 + cast({n} + 2 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0)) div nullif(cast({total} + 2 * {terms} as decimal(20, 0)), 0)")


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pair_sums(batches):
    """Batches of (cells: array of (group, p, base)) to rows (a, b, inter): for the terms that both groups hold, what the pair adds beyond the two groups by themselves."""
    keys, sums = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    out = lambda k, v: pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(v)], names=["a", "b", "inter"])
    for x in batches:
        cells = x.column(0)
        flat = cells.flatten()
        group, p, base = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
        ends = np.cumsum(np.asarray(cells.value_lengths()).astype(np.int64))
        rest = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(len(group)) - 1
        upto, lo = np.cumsum(rest), 0
        while lo < len(group):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
            left = np.repeat(np.arange(lo, hi), rest[lo:hi])
            right = left + 1 + np.arange(len(left)) - np.repeat(upto[lo:hi] - rest[lo:hi] - done, rest[lo:hi])
            both = _f(p[left], p[right]) - _f(p[left], base[right]) - _f(base[left], p[right]) + _f(base[left], base[right])
            a, b = np.minimum(group[left], group[right]), np.maximum(group[left], group[right])
            joined = np.concatenate((keys, np.stack((a, b), 1)))
            order = np.lexsort((joined[:, 1], joined[:, 0]))
            joined, values = joined[order], np.concatenate((sums, both))[order]
            at = np.flatnonzero(np.concatenate(([True], (joined[1:] != joined[:-1]).any(1)))) if len(joined) else np.zeros(0, np.int64)
            keys, sums = joined[at], np.add.reduceat(values, at) if len(at) else values
            lo = hi
            if len(keys) > HELD:
                yield out(keys, sums)
                keys, sums = keys[:0], sums[:0]
    yield out(keys, sums)


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, id, total, support, terms, all_total, base) for every (lang, source) that occurs."""
    found = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    own = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"), F.count(F.lit(1)).alias("support"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all_total"))
    g = found.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "terms", "all_total"])
    return g.select("lang", "source", F.row_number().over(W.orderBy("lang", "source")).cast("long").alias("id"), "total", "support", "terms", "all_total",
                    F.expr(f"coalesce(1 + cast(2 * {SCALE}L as decimal(20, 0)) div nullif(cast(total + 2 * terms as decimal(20, 0)), 0), 1)").alias("base"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: every other source of the language, by how far the shares of
    all kept terms lie apart. Part ``term``: the ``top`` terms that the source
    holds more often than its language as a whole. Terms are runs of ASCII
    letters, lower-cased, and code points beyond ASCII; kept are those of at
    least ``least_docs`` documents of the language. Null text, language or
    source count as ''. Without kept terms pairs have value 0 and there are no
    term rows. Values tie by item. Repeated rows count as documents each; other
    columns are ignored; an empty table gives an empty result.
    """
    kept = C.materialize(kept_terms(collapsed(docs, text_col, lang_col, source_col), least_docs), "divergence-terms")
    groups = C.materialize(_groups(docs, kept, lang_col, source_col), "divergence-groups")
    cells = kept.select("lang", "term", F.col("total").alias("term_total"), F.explode("cells").alias("c")).select("lang", "term", "term_total", "c.source", "c.n")
    shares = C.materialize(cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "id", "term", "base", _share("n", "total", "terms").alias("p"), _share("term_total", "all_total", "terms").alias("q")), "divergence-shares")
    value, item = F.desc("value"), F.asc("item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    named = W.partitionBy("lang", "source").orderBy(value, item)
    terms = above.withColumn("rank", F.row_number().over(named)).where(F.col("rank") <= top)
    met = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "base")).alias("cells"))
    inter = met.select("cells").mapInArrow(_pair_sums, "a long, b long, inter long").groupBy("a", "b").agg(F.sum("inter").alias("inter"))
    by_share = shares.groupBy("id", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("id").agg(F.collect_list(F.struct("p", "k")).alias("shares"))
    none = F.array().cast("array<struct<p:bigint,k:bigint>>")
    side = groups.join(by_share, "id", "left").select("lang", "source", "id", "support", "terms", "base", F.coalesce("shares", none).alias("shares"))
    a = side.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "id", "support", "base", "shares")], "terms")
    b = side.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "id", "support", "base", "shares")])

    def alone(shares_: str, base: str) -> Column:
        return F.aggregate(shares_, F.lit(0).cast("long"), lambda s, x: s + x["k"] * _apart(x["p"], F.col(base)))

    absent = (F.col("terms") - F.col("support_a") - F.col("support_b")) * _apart(F.col("base_a"), F.col("base_b"))
    total = alone("shares_a", "base_b") + alone("shares_b", "base_a") + F.coalesce("inter", F.lit(0)) + absent
    both = (a.join(b, "lang").where("id_a < id_b").join(inter, (F.col("id_a") == F.col("a")) & (F.col("id_b") == F.col("b")), "left")
            .withColumn("value", F.when(F.col("terms") == 0, F.lit(0)).otherwise(total).cast("long")))
    sides = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    pairs = both.select("lang", "value", F.explode(sides).alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    return terms.unionByName(pairs.withColumn("rank", F.row_number().over(named)))
