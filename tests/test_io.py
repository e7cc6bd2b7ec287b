"""Sinks, model persistence and the streaming histogram."""

import os
import tempfile

from pyspark.sql import functions as F

from stratarisk.operators import metrics as M
from stratarisk.operators import training as TR
from stratarisk.session import scratch_path
from stratarisk.sources import sinks as SK
from stratarisk.streaming import auc_from_stream, start_histogram_stream


def test_csv_report_has_header(spark):
    df = spark.createDataFrame([("a", 1.5)], "stratum string, v double")
    path = SK.write_csv_report(df, scratch_path(spark, "report"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["stratum", "v"] and back.count() == 1


def test_per_stratum_output_prunes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "stratum string, v int")
    path = SK.write_per_stratum(df, scratch_path(spark, "per"))
    assert sorted(d for d in os.listdir(path) if d.startswith("stratum=")) == ["stratum=a", "stratum=b"]
    assert SK.read_per_stratum(spark, path, ["b"]).count() == 2


def test_model_save_load(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"),
                                   (F.col("id") % 2 * 1.0 + F.col("id") / 1000.0).alias("f1"),
                                   F.lit("s").alias("stratum"))
    tr = TR.prepare_training(rows, ["stratum"])
    m = TR.fit(tr, "LR", ["f1"])
    path = SK.save_model(m, scratch_path(spark, "model"))
    m2 = SK.load_pipeline_model(path)
    a = TR.score(m, rows).select("row_id", "p6").collect()
    b = TR.score(m2, rows).select("row_id", "p6").collect()
    assert sorted(a) == sorted(b)


def test_streaming_histogram_auc_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="stream-src-", dir=spark.conf.get("spark.checkpoint.dir"))
    rows = [("s", "o", "a", i % 2, (i * 37) % 1000 * 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "stratum string, outcome string, algo string, y int, p6 int")
    df.limit(200).write.mode("append").parquet(src)
    out = scratch_path(spark, "stream-hist")
    q = start_histogram_stream(spark, src, scratch_path(spark, "stream-ckpt"), out)
    q.processAllAvailable()
    df.subtract(df.limit(200)).write.mode("append").parquet(src)
    q.processAllAvailable()
    got = auc_from_stream(spark, out).first()["auc"]
    q.stop()
    want = M.auc(spark.read.parquet(src), ["stratum", "outcome", "algo"]).first()["auc"]
    assert got == want
