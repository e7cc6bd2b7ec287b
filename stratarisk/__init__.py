"""stratarisk: stratified risk-model evaluation on Spark.

Cohort preparation, per-cell (stratum x outcome) model metrics, risk
grading, attribution summaries and governance verdicts, all expressed as
DataFrame -> DataFrame operators keyed by arbitrary stratum and outcome
columns.
"""

from stratarisk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
