"""Phase tables: resumed after a kill, rebuilt when what they depend on changes."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stratarisk.sources.phases import Phases

KILLED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from stratarisk.sources.phases import Phases
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
p = Phases(s, sys.argv[2])
first = p.table("first", lambda: s.read.parquet(sys.argv[3]).withColumn("b", F.col("a") * 2), inputs=[sys.argv[3]])

def second():
    first.write.parquet(sys.argv[2] + "/second/data-half")
    os.kill(os.getpid(), 9)

p.table("second", second, after=["first"])
"""


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.range(100).withColumnRenamed("id", "a").write.parquet(path)
    return path


def run(spark, root, source, calls, params=None, fail=False):
    p = Phases(spark, root)

    def first():
        calls.append("first")
        return spark.read.parquet(source).withColumn("b", F.col("a") * 2)

    def second():
        calls.append("second")
        if fail:
            raise RuntimeError("ended on the way")
        return one.groupBy((F.col("a") % 3).alias("r")).agg(F.sum("b").alias("b"))

    one = p.table("first", first, inputs=[source])
    two = p.table("second", second, after=["first"], params=params)
    return p, sorted(map(tuple, two.collect()))


def test_killed_driver_resumes_after_the_last_committed_phase(spark, tmp_path, source):
    root = str(tmp_path / "phases")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", KILLED, repo, root, source], capture_output=True, timeout=120)
    assert done.returncode == -9
    calls = []
    p, got = run(spark, root, source, calls)
    assert calls == ["second"] and sum(b for _, b in got) == 9900
    assert [s.rsplit("/", 1)[1] for s in p.stale()] == ["data-half"]


def test_failed_phase_is_not_marked(spark, tmp_path, source):
    root, calls = str(tmp_path / "phases"), []
    with pytest.raises(RuntimeError):
        run(spark, root, source, calls, fail=True)
    _, got = run(spark, root, source, calls)
    assert calls == ["first", "second", "second"] and run(spark, root, source, calls)[1] == got
    assert len(calls) == 3


def test_changes_of_input_and_parameters_rebuild(spark, tmp_path, source):
    root, calls = str(tmp_path / "phases"), []
    run(spark, root, source, calls)
    p, _ = run(spark, root, source, calls, params={"v": 2})
    assert calls == ["first", "second", "second"]
    assert len(p.stale()) == 2                      # mark and folder of the earlier parameters
    spark.range(100, 101).withColumnRenamed("id", "a").write.mode("append").parquet(source)
    _, got = run(spark, root, source, calls, params={"v": 2})
    assert calls[3:] == ["first", "second"] and sum(b for _, b in got) == 10100


def test_empty_table(spark, tmp_path):
    p = Phases(spark, str(tmp_path / "phases"))
    assert p.stale() == []
    for _ in range(2):
        got = p.table("none", lambda: spark.createDataFrame([], "a long, s array<string>"))
        assert got.count() == 0 and got.columns == ["a", "s"]
