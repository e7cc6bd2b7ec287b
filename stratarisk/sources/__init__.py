"""Scans and sinks."""

from stratarisk.sources.tables import (
    SCHEMAS, read_table, prune_present, union_extracts, read_extracts, table_path,
)
from stratarisk.sources.sinks import (
    write_parquet, parquet_roundtrip, write_csv_report, write_per_stratum,
    read_per_stratum, save_model, load_pipeline_model,
)

__all__ = [
    "SCHEMAS", "read_table", "prune_present", "union_extracts", "read_extracts",
    "table_path", "write_parquet", "parquet_roundtrip", "write_csv_report",
    "write_per_stratum", "read_per_stratum", "save_model", "load_pipeline_model",
]
