"""Helpers shared by the operators: shared-folder tables, word hashing, repeated-key bitmaps, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarisk.session import scratch_path

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
#: white space of ``[^\x20\x09-\x0D]+``
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of text handled at once inside a task (a longer document is handled alone)
SLICE_BYTES = 1 << 20
#: bits of the bitmap that marks repeated keys: 8 MB however large the input is
BITMAP_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no pending plan reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back to the system. A task ends with it: Spark keeps Python workers for later tasks, and with them what they hold."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for later calls."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1024), base, U64)
        got[0] = 1
        np.cumprod(got, out=got)
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = got
    return got[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


BYTE_INV, WORD_INV = _inverse(BYTE_BASE), _inverse(WORD_BASE)


def strings(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(col, limit: int = SLICE_BYTES):
    """(first row, offsets from 0, bytes) for runs of rows of about ``limit`` bytes."""
    off, data = strings(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, off[lo: hi + 1] - off[lo], data[off[lo]: off[hi]]
        lo = hi


def words(off: np.ndarray, b: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and the row of each. cut: bytes that end a word besides white space."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[off] = True
    fresh = first[:-1].copy()
    fresh[1:] |= ~solid[:-1]
    last = first[1:].copy()
    last[:-1] |= ~solid[1:]
    last[-1] = True
    s, e = np.flatnonzero(solid & fresh), np.flatnonzero(solid & last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial by prefix sums, then mixed with the length."""
    if not len(s):
        return np.zeros(0, U64)
    p = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * powers(BYTE_BASE, len(b)), out=p[1:])
    h = (p[e] - p[s]) * powers(BYTE_INV, len(b) + 1)[s]
    return mix64(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(h: np.ndarray, s: np.ndarray, n) -> np.ndarray:
    """A hash of each run of n consecutive word hashes that starts at s."""
    if not len(s):
        return np.zeros(0, U64)
    p = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(WORD_BASE, len(h)), out=p[1:])
    x = (p[s + n] - p[s]) * powers(WORD_INV, len(h) + 1)[s]
    return mix64(x + np.atleast_1d(np.asarray(n)).astype(U64) * U64(0xA0761D6478BD642F))


def by_row(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column: row i has the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    off = (np.asarray(bounds, np.int64) * values.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(values)])


def unpacked(col, dtype=U64) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column made by :func:`packed`."""
    col = col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col
    _, off, data = col.buffers()
    size = np.dtype(dtype).itemsize
    off = np.frombuffer(off, np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return (off - off[0]) // size, np.frombuffer(raw.tobytes(), dtype)


def pair_keys(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """16-byte binary keys of two hash columns."""
    both = np.empty((len(a), 2), U64)
    both[:, 0], both[:, 1] = a, b
    return packed(both.reshape(-1), np.arange(len(a) + 1) * 2)


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum (wrapping) of each run x[bounds[i]:bounds[i+1]]."""
    p = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=p[1:])
    return p[bounds[1:]] - p[bounds[:-1]]


def pick(bounds: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """New bounds of the runs after the values have been cut to ``keep`` (a mask)."""
    p = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=p[1:])
    return p[bounds]


class Buffered:
    """Gathers column chunks into record batches of a bounded number of rows."""

    def __init__(self, schema: pa.Schema, rows: int = 100_000):
        self.schema, self.rows, self.held, self.n = schema, rows, [], 0

    def add(self, arrays: list) -> list[pa.RecordBatch]:
        arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, self.schema)]
        self.held.append(pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, self.schema)], schema=self.schema))
        self.n += self.held[-1].num_rows
        return self.flush() if self.n >= self.rows else []

    def flush(self) -> list[pa.RecordBatch]:
        out, self.held, self.n = self.held, [], 0
        return pa.Table.from_batches(out).combine_chunks().to_batches() if out else []


def grouped_order(group: np.ndarray, keys: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Order by (group, rank, key); group ascends already. One integer sort where the leading bits tell all keys apart."""
    if not len(keys):
        return np.zeros(0, np.int64)
    width = int(group[-1]).bit_length() + (6 if rank is not None else 0)
    if width < 40:
        lead = group.astype(U64) if rank is None else (group.astype(U64) << U64(6)) | rank.astype(U64)
        whole = (lead << U64(64 - width)) | (keys >> U64(width)) if width else keys
        order = np.argsort(whole)
        whole = whole[order]
        same = whole[1:] == whole[:-1]
        if not (same & (keys[order[1:]] != keys[order[:-1]])).any():
            return order
    return np.lexsort((keys, group) if rank is None else (keys, rank, group))


def sketch_counts(df: DataFrame, count, buckets: int) -> np.ndarray:
    """Counts per bucket over the whole input. count(batch) gives an array of length ``buckets``; what reaches the driver is that one array."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
    span = 12

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for x in batches:
            total += count(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    def dense(batches):
        for x in batches:
            held = []
            for part in x.column(1):
                n = np.zeros(1 << span, np.int64)
                n[np.asarray(part.values.field(0))] = np.asarray(part.values.field(1))
                held.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(held, pa.binary())], names=["chunk", "counts"])

    low = F.col("bucket").bitwiseAND(F.lit((1 << span) - 1))
    got = (df.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
           .groupBy(F.shiftright("bucket", span).alias("chunk")).agg(F.collect_list(F.struct(low.alias("i"), F.col("n"))).alias("part"))
           .mapInArrow(dense, "chunk int, counts binary").collect())
    out = np.zeros(buckets, np.int64)
    for r in got:
        n = np.frombuffer(r["counts"], np.int64)[: buckets - (r["chunk"] << span)]
        out[r["chunk"] << span: (r["chunk"] << span) + len(n)] = n
    return out


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of 2^bits bits in which the lowest bits of every key of column ``k`` are set.

    It is a lossless pre-filter: a key outside is never in ``keys``; one inside
    may be (a later exact step decides). Its size does not depend on the input.
    """
    span = 15
    schema = pa.schema([("chunk", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for x in batches:
            held = []
            for slots in x.column(1):
                bit = np.zeros(1 << span, bool)
                bit[np.asarray(slots.values.to_numpy(zero_copy_only=False), np.int64)] = True
                held.append(np.packbits(bit, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(held, pa.binary())], schema=schema)

    slot = F.col("k").bitwiseAND(F.lit((1 << bits) - 1))
    got = (keys.select(F.shiftright(slot, span).alias("chunk"), slot.bitwiseAND(F.lit((1 << span) - 1)).cast("int").alias("slot"))
           .groupBy("chunk").agg(F.collect_set("slot").alias("slots")).mapInArrow(run, "chunk long, bits binary").collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (span - 3)
    for r in got:
        out[r["chunk"] * size: (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that the bitmap has."""
    slot = keys & U64(len(bits) * 8 - 1)
    return (bits[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & np.uint8(1) == 1


def repeated(keys: DataFrame) -> DataFrame:
    """Keys (column ``k``) that occur at least twice; counted before and after the shuffle."""
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for the nodes of undirected ``edges`` (a, b); root: the smallest node of the component.

    Alternating large-star and small-star steps on written tables, until the
    edge set stands still. Minima are grouped sums, so that a node with very
    many links is combined before the shuffle; nothing reaches the driver but
    two numbers a round.
    """
    def least(e):
        return e.groupBy("a").agg(F.min("b").alias("m"))

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        last = e
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        big = (both.join(least(both), "a").where("b > a")
               .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        mins = least(big)
        small = (big.join(mins, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(mins.select("a", F.col("m").alias("b")))).distinct()
        e = materialize(small, name)
        discard(last)
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
        e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("root")))
