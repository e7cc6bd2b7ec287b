"""What a task holds, and how many rows it hands on, does not follow the size of its batches."""

import tracemalloc

import numpy as np
import pyarrow as pa

from stratarisk.llm import common as C
from stratarisk.llm import line_dedup, ngram_join, quality


def _peak(make) -> float:
    tracemalloc.start()
    try:
        for _ in make():
            pass
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
        C.release()


def test_views_and_sets_of_a_large_batch_are_made_bit_by_bit():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 5000, 400)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 2 << 20
    assert _peak(lambda: quality._views(batch, ["text"])) < 30
    assert _peak(lambda: (ngram_join.sets_of(off, raw, 5) for _, off, raw in C.slices(batch.column(0), ngram_join.SLICE_BYTES))) < 30


def test_release_empties_the_power_tables():
    C.powers(C.BYTE_BASE, 5000)
    assert C._POWERS
    C.release()
    assert not C._POWERS
    assert C.powers(C.BYTE_BASE, 3).tolist() == [1, C.BYTE_BASE, C.BYTE_BASE**2 % 2**64]


def test_frequent_keys_are_handed_on_once_a_batch(spark):
    listed = spark.createDataFrame([(7, 10 << 32)] * 300 + [(8, 20 << 32)], "key long, size long").coalesce(1)
    got = [r["k"] for r in line_dedup._keys_around(listed).collect()]
    key = np.array([7, 7, 7, 8, 8, 8])
    n = np.array([10, 10, 10, 20, 20, 20])
    want = [int(line_dedup._banded(key[i: i + 1], n[i: i + 1], step).view(np.int64)[0]) for i, step in enumerate((-1, 0, 1) * 2)]
    assert sorted(got) == sorted(want)
