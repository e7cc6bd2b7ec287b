"""Scans with explicit schemas (no inference) and extract unions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schemas of the driver tables this library reads (explicit: inference on a
# 100 TB folder would list and open footers of every file).
SCHEMAS = {
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType()),
    ]),
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with a fixed schema; Catalyst prunes columns and pushes filters."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def prune_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Project the wanted columns that exist; absent ones are tolerated."""
    present = set(df.columns)
    return df.select(*[c for c in wanted if c in present])


def union_extracts(extracts: list[DataFrame], wanted: list[str]) -> DataFrame:
    """Union yearly extracts by name; a column absent in a year becomes null.

    Pure narrow union: no shuffle, each extract keeps its own partitions.
    """
    pruned = [prune_present(d, wanted) for d in extracts]
    out = pruned[0]
    for d in pruned[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    # unionByName appends columns first seen in later inputs; restore order.
    return out.select(*[c for c in wanted if c in out.columns])


def read_extracts(spark: SparkSession, paths: list[str], wanted: list[str],
                  fmt: str = "parquet", schema: T.StructType | None = None,
                  **options) -> DataFrame:
    """Read one file (or folder) per year and union them by name."""
    frames = []
    for p in paths:
        r = spark.read.options(**options)
        if schema is not None:
            r = r.schema(schema)
        frames.append(r.format(fmt).load(p))
    return union_extracts(frames, wanted)
