"""Sinks: Parquet between phases, CSV reports, per-stratum outputs, models.

Phases hand results to each other as Parquet tables under the shared
checkpoint folder (never pickles, never driver memory).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def parquet_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """Persist a table and read it back (the phase boundary).

    The read-back plan starts at the files, so lineage is cut and a lost
    executor only recomputes from Parquet.
    """
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv_report(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> str:
    """CSV report with header. Row-level tables are written by as many tasks as they have partitions;
    ``single_file`` is for cell tables, whose size the configuration bounds."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)
    return path


def write_per_stratum(df: DataFrame, path: str, stratum_col: str = "stratum",
                      rows_per_writer: int = 1_000_000) -> str:
    """One output folder per stratum (stratum stays a column, no union needed).

    Rows are spread over (stratum, row-hash salt); a stratum has as many salts
    as its measured row count asks for, so none is one task's work whatever
    its share. The salt is a hash of the row: a retried task writes the same
    rows. The table of salts has one row per stratum.
    """
    salts = df.groupBy(stratum_col).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_writer)).cast("int").alias("_salts"))
    salted = (df.join(salts.withColumnRenamed(stratum_col, "_stratum"), F.col(stratum_col).eqNullSafe(F.col("_stratum")))
              .withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_salts"))))
    spread = salted.repartition(F.col(stratum_col), F.col("_salt")).select(*df.columns)
    return write_parquet(spread, path, partition_by=[stratum_col])


def read_per_stratum(spark: SparkSession, path: str, strata: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if strata:
        df = df.where(df["stratum"].isin(strata))   # partition pruning
    return df


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
