"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` for their sets of
5-word shingles. The join is exact on 64-bit shingle hashes:

* equal sets are one class, so copies cost one row in everything that follows;
* shingles are ordered by rarity (a count sketch over all documents, then the
  hash); a linked pair shares a shingle within the first ``n - ceil(.8 n) + 1``
  of either, so only those are indexed, and only where they are shared at all;
* a tile is (shared shingle, size band). A class is native in its own band and
  a guest in the next larger one; sizes of linked classes differ by at most
  one band. Within a tile, a pair is a candidate only if the bit counts of the
  two signatures do not already bound the overlap below the threshold;
* a pair whose number of shared tiles cannot make up the overlap is dropped;
* round 1 compares every class with one pivot (the first class of the tiles
  that it shares most often); round 2 compares what is left: pairs of a tile whose
  classes lie in different components. Pairs within a component need no
  comparison, so a large group of near copies costs a multiple of its size.

Every cross-component pair that shares a tile is verified, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: bits of the rarity sketch; shingles are ranked by sixteenths of octaves of its counts around the mean, so that one
#: shared by a few dozen documents already stands behind the many that are alone in their buckets
SKETCH_BITS = 18
#: bytes of text handled at once
SLICE_BYTES = 1 << 18


def needed(n):
    """Smallest overlap with any partner: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(64 - SKETCH_BITS)).astype(np.int64)


def sets_of(off: np.ndarray, raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, sorted distinct shingle hashes) of each row of a slice; fewer than k words make one shingle."""
    b = C.LOWER[raw]
    s, e, row = C.words(off, b)
    h = C.span_hashes(b, s, e)
    n = len(off) - 1
    at = C.by_row(row, n)
    count = np.diff(at)
    left = at[1:][row] - np.arange(len(row)) if len(row) else row
    start = np.flatnonzero(left >= k)
    short = np.flatnonzero((count > 0) & (count < k))
    keys = np.concatenate([C.run_hashes(h, start, k), C.run_hashes(h, at[short], count[short])])
    rows = np.concatenate([row[start], short])
    if len(short):
        order = np.argsort(rows, kind="stable")
        keys, rows = keys[order], rows[order]
    order = C.grouped_order(rows, keys)
    keys, rows = keys[order], rows[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
    return C.by_row(rows, n), keys


def class_keys(at: np.ndarray, keys: np.ndarray) -> pa.Array:
    """128 bits that name each set; null for an empty set."""
    a = C.sums(C.mix64(keys ^ U64(0x5851F42D4C957F2D)), at)
    b = C.sums(C.mix64(keys + U64(0x14057B7EF767814F)), at)
    got = C.pair_keys(C.mix64(a + np.diff(at).astype(U64)), C.mix64(b))
    return pa.array(got.to_pylist(), pa.binary(), mask=np.diff(at) == 0)


def signatures(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds in 64-bit words, words): a signature of each set, of a power of two of at least 4 n bits."""
    n = np.diff(at)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    flat = np.zeros(start[-1], bool)
    flat[start[:-1][row] + ((keys >> U64(20)).astype(np.int64) & (bits[row] - 1))] = True
    return start // 64, np.packbits(flat, bitorder="little").view(U64)


def overlap_bound(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> int:
    """Upper bound of the overlap: every bit that only one side has stands for an element that only it has. The wider signature is folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2:]
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def linked(shared, na, nb):
    return 100 * shared >= 80 * (na + nb - shared)


def _index(docs: DataFrame, k: int, weights) -> DataFrame:
    """(doc_id, sid, n, sig, toks, key): class key, size, signature and indexed shingles of every document. docs: (doc_id, text, key)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("toks", pa.binary()), ("key", pa.string())])

    def run(batches):
        out = C.Buffered(schema, 20_000)
        rank = weights.value
        for x in batches:
            for lo, off, raw in C.slices(x.column(1), SLICE_BYTES):
                at, keys = sets_of(off, raw, k)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                order = C.grouped_order(row, keys, rank[_bucket(keys)])
                place = np.arange(len(keys)) - at[:-1][row]
                first = place < (n - needed(n) + 1)[row]
                sig_at, sig = signatures(at, keys)
                yield from out.add([x.column(0).slice(lo, len(n)), class_keys(at, keys), C.longs(n),
                                    C.packed(sig, sig_at),
                                    C.packed(keys[order][first], C.pick(at, first)), x.column(2).slice(lo, len(n))])
        yield from out.flush()
        C.release()

    return docs.mapInArrow(run, "doc_id long, sid binary, n long, sig binary, toks binary, key string")


def _keys(index: DataFrame) -> DataFrame:
    schema = pa.schema([("k", pa.int64())])

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([C.longs(C.unpacked(x.column(0))[1])], schema=schema)

    return index.select("toks").mapInArrow(run, "k long")


def _marked_only(index: DataFrame, shared) -> DataFrame:
    """``index`` (of documents with a set) with the shingles that the bitmap has."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("toks", pa.binary())])

    def run(batches):
        for x in batches:
            at, keys = C.unpacked(x.column(4))
            keep = C.marked(shared.value, keys)
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(4)), C.packed(keys[keep], C.pick(at, keep))], schema=schema)

    return index.where("n > 0").mapInArrow(run, "doc_id long, sid binary, n long, sig binary, toks binary")


def _tiles(classes: DataFrame, mixed=None) -> DataFrame:
    """(tok, band, cid, n, root) for the indexed shingles of the classes; mixed: only those that this bitmap has."""
    schema = pa.schema([("tok", pa.int64()), ("band", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("root", pa.int64())])

    def run(batches):
        for x in batches:
            at, keys = C.unpacked(x.column(3))
            row = np.repeat(np.arange(x.num_rows), np.diff(at))
            if mixed is not None:
                keep = C.marked(mixed.value, keys)
                keys, row = keys[keep], row[keep]
            n = x.column(1).to_numpy(zero_copy_only=False)
            band = np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int32)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([C.longs(keys), pa.array(band[row]), x.column(0).take(take), pa.array(n[row].astype(np.int32)), x.column(2).take(take)], schema=schema)

    return classes.select("cid", "n", "root", "toks").mapInArrow(run, "tok long, band int, cid long, n int, root long")


def _survivors(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave room for the overlap."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            (at_a, a), (at_b, b) = C.unpacked(x.column(4)), C.unpacked(x.column(5))
            na, nb = (x.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            most = np.array([overlap_bound(a[at_a[i]: at_a[i + 1]], b[at_b[i]: at_b[i + 1]], na[i], nb[i]) for i in range(x.num_rows)], np.int64)
            keep = linked(most, na, nb)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(keep)), x.column(1).filter(pa.array(keep))], schema=schema)

    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}"))
    return (pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "siga", "sigb")
            .mapInArrow(run, "a long, b long"))


def _arrays(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(cid, arr): the sorted shingle hashes of the classes in ``wanted`` (sid, cid), computed again from the text."""
    spark = docs.sparkSession
    low = F.conv(F.hex(F.substring("sid", 1, 3)), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(C.bitmap(wanted.select(low.alias("k")), 24))
    schema = pa.schema([("sid", pa.binary()), ("arr", pa.binary())])

    def run(batches):
        out = C.Buffered(schema, 5_000)
        for x in batches:
            for _, off, raw in C.slices(x.column(0), SLICE_BYTES):
                at, keys = sets_of(off, raw, k)
                sid = class_keys(at, keys)
                head = np.array([int.from_bytes(v[:3], "big") if v else -1 for v in sid.to_pylist()], np.int64)
                keep = (head >= 0) & C.marked(bits.value, np.maximum(head, 0).astype(U64))
                inside = np.repeat(keep, np.diff(at))
                yield from out.add([sid.filter(pa.array(keep)), C.packed(keys[inside], np.concatenate([[0], np.cumsum(np.diff(at)[keep])]))])
        yield from out.flush()
        C.release()

    got = docs.select("text").mapInArrow(run, "sid binary, arr binary")
    return got.join(wanted, "sid").groupBy("cid").agg(F.first("arr").alias("arr"))


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs whose exact intersection reaches the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            (at_a, a), (at_b, b) = C.unpacked(x.column(2)), C.unpacked(x.column(3))
            keep = np.zeros(x.num_rows, bool)
            for i in range(x.num_rows):
                p, q = a[at_a[i]: at_a[i + 1]], b[at_b[i]: at_b[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                keep[i] = linked(int((both[1:] == both[:-1]).sum()), len(p), len(q))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(keep)), x.column(1).filter(pa.array(keep))], schema=schema)

    side = lambda c: arrays.select(F.col("cid").alias(c), F.col("arr").alias(f"arr{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "arra", "arrb").mapInArrow(run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, with A-Z lower-cased. A null or
    blank text has an empty set: n_shingles 0, linked with nothing, its own
    component. Rows with equal sets share a component whatever their ids.
    component_id is the smallest non-null id reachable (null if there is none).
    Rows may repeat; other columns are ignored. An empty table gives an empty result.
    """
    return _linked_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("key")), k).drop("key", "root")


def _linked_rows(keyed: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, root) of (doc_id, text, key); root names the component whatever the ids, null for a set that no other row shares a rare shingle with."""
    spark = keyed.sparkSession
    docs = keyed.select("doc_id", "text")

    def count(x):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, off, raw in C.slices(x.column(0), SLICE_BYTES):
            total += np.bincount(_bucket(sets_of(off, raw, k)[1]), minlength=1 << SKETCH_BITS)
        return total

    seen = C.sketch_counts(docs.select("text"), count, 1 << SKETCH_BITS)
    rank = np.clip(np.floor(32 + 16 * np.log2(np.maximum(seen, 1) / max(1.0, seen.mean()))), 0, 63).astype(np.int8)
    written = C.materialize(_index(keyed, k, spark.sparkContext.broadcast(rank)), "ngram-index")
    index, full = C.materialize(written.select("doc_id", "n", "sid", "key"), "ngram-members"), written.drop("key")
    shared = spark.sparkContext.broadcast(C.bitmap(C.repeated(_keys(full.where("n > 0")))))
    classes = (_marked_only(full, shared).groupBy("sid")
               .agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("toks").alias("toks"), F.min("doc_id").alias("least")))
    # written at once, so that the numbers stay
    classes = C.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    C.discard(written)

    tiles = _tiles(classes.withColumn("root", F.col("cid")))
    natives = tiles.groupBy("tok", "band").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("m"))
    pivots = (natives.select("tok", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "pivot", "m")
              .groupBy("tok", "band").agg(F.min("pivot").alias("pivot"), F.sum("m").alias("m")).where("m > 1").drop("m"))
    first = (tiles.select("tok", "band", "cid").join(pivots, ["tok", "band"]).where("cid <> pivot").groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("m"))
             .groupBy("cid").agg(F.max_by("pivot", F.struct("m", "pivot")).alias("pivot")))
    pairs = C.materialize(first.select(F.greatest("cid", "pivot").alias("a"), F.least("cid", "pivot").alias("b")).distinct(), "ngram-pairs")
    links = _check(docs, k, pairs, classes, "ngram-round1")
    parts = C.components(links, "ngram-cc")

    rooted = C.materialize(classes.select("cid", "n", "toks").join(parts.select(F.col("node").alias("cid"), "root"), "cid", "left")
                           .withColumn("root", F.coalesce("root", "cid")), "ngram-rooted")
    mixed = _tiles(rooted).groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    bits = spark.sparkContext.broadcast(C.bitmap(mixed.select(F.col("tok").alias("k"))))
    a = _tiles(rooted, bits).select("tok", "band", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    b = a.select("tok", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("own"), F.col("a").alias("b"),
                 F.col("na").alias("nb"), F.col("ra").alias("rb"))
    more = (a.join(b, ["tok", "band"]).where("ra <> rb and 5 * na >= 4 * nb and 5 * nb >= 4 * na and (own < band or a < b)")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.greatest("na", "nb").alias("n1"), F.least("na", "nb").alias("n2"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
            # up to the end of the prefix that ends first only the m tiles are shared; behind it lie ceil(.8 n) - 1 shingles at most
            .where("9 * (m + (4 * n1 + 4) div 5 - 1) >= 4 * (n1 + n2)").select("a", "b")
            .join(pairs, ["a", "b"], "left_anti"))
    found = _check(docs, k, more, classes, "ngram-round2")
    C.discard(rooted, pairs)
    parts = C.components(links.union(found), "ngram-cc2")

    labels = classes.select("sid", "cid", "least").join(parts.select(F.col("node").alias("cid"), "root"), "cid", "left").select(
        "sid", F.coalesce("root", "cid").alias("root"), "least")
    roots = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = labels.join(roots, "root").select("sid", "component_id", "root")
    result = (index.select("doc_id", F.col("n").alias("n_shingles"), "sid", "key").join(by_class, "sid", "left")
              .select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "root"))
    result = C.materialize(result, "ngram-result")
    C.discard(index, classes, links, found)
    return result


def _check(docs: DataFrame, k: int, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """The links among candidate pairs: bit-count bound first, then exact intersection."""
    left = C.materialize(_survivors(pairs, classes), name)
    wanted = left.select(F.col("a").alias("cid")).union(left.select(F.col("b").alias("cid"))).distinct().join(classes.select("cid", "sid"), "cid")
    wanted = C.materialize(wanted, f"{name}-wanted")
    links = C.materialize(_verified(left, _arrays(docs, k, wanted)), f"{name}-links")
    C.discard(left, wanted)
    return links


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """``docs`` with one row of each group that is linked, directly or through others.

    The row with the smallest id stays, a null id counting as the largest; of
    equal ids the one whose text has the smaller digest; of rows alike in both
    the one with the smaller hash of all its columns. Rows are told apart by id
    and text, so a row stays that only shares its id with a linked one. Rows
    without words stay, all of them.
    """
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    found = _linked_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key")), k)
    found = found.where("n_shingles > 0 and root is not null").groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("alike"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("least_id"), F.col("key").alias("least_key"))
    firsts = found.groupBy(F.col("root").alias("own")).agg(F.min(order).alias("first")).select("own", "first.*")
    stays = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("key") == F.col("least_key"))
    judged = found.join(firsts, F.col("root") == F.col("own")).select(F.col("doc_id").alias("_gone"), F.col("key").alias("_text"), stays.alias("_stays"), "alike")
    judged = C.materialize(judged.where("alike > 1 or not _stays"), "ngram-judged")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_text"))
    named = docs.withColumn("_key", key)
    left = named.join(judged.select("_gone", "_text"), same, "left_anti").select(*docs.columns)
    if not judged.where("_stays").limit(1).count():
        return left
    # rows alike in id and text whose group they stand for: one of them
    row = F.struct(*[F.col(c) for c in docs.columns])
    copies = named.join(judged.where("_stays").select("_gone", "_text"), same, "left_semi")
    one = copies.groupBy(F.col(id_col).alias("_id"), "_key").agg(F.min_by(row, F.xxhash64(*[F.col(c) for c in docs.columns])).alias("r")).select("r.*")
    return left.unionByName(one)
