"""Incremental metrics over arriving extracts (Structured Streaming).

The evaluated study is batch-only. The one streaming form kept here is the
AUC score histogram: new scored extracts (one folder of Parquet files per
arrival) update a running ``(cell, p6) -> pos, neg`` aggregate, and the exact
AUC is read off that histogram at any time with the batch operator
``metrics.auc_from_histogram``. The state is bounded by cells x 1,000,001
score values whatever the number of rows that arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarisk.operators import metrics as M

SCORED_SCHEMA = T.StructType([
    T.StructField("stratum", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("algo", T.StringType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("p6", T.IntegerType()),
])


def start_histogram_stream(spark: SparkSession, source_dir: str, checkpoint: str,
                           out_dir: str, keys=("stratum", "outcome", "algo")):
    """Start a streaming histogram aggregate; every trigger writes the running histogram as Parquet below ``out_dir``.

    ``checkpoint`` and ``out_dir`` must be shared folders (e.g. under
    spark.checkpoint.dir): the query restarts from its state after a failure
    and a repeated trigger overwrites its own folder. Nothing is gathered on
    the driver.
    """
    keys = list(keys)
    src = spark.readStream.schema(SCORED_SCHEMA).parquet(source_dir)
    hist = M.score_histogram(src, keys)

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    return hist.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).start()


def auc_from_stream(spark: SparkSession, out_dir: str, keys=("stratum", "outcome", "algo")) -> DataFrame:
    """Exact AUC per cell from the latest histogram that the stream has written."""
    every = spark.read.parquet(out_dir)
    latest = every.agg(F.max("epoch").alias("epoch"))
    return M.auc_from_histogram(every.join(latest, "epoch").drop("epoch"), list(keys))
