"""Column-level building blocks (all built-in Catalyst expressions, no UDFs)."""

from stratarisk.functions.hashing import hash32, hash_uniform, hash_gaussian
from stratarisk.functions.scalar import (
    round_half_up, recode, safe_double, band, judge, norm_score, guarded_ratio,
    format_mean_std, parse_mean, score_to_p6,
)

__all__ = [
    "hash32", "hash_uniform", "hash_gaussian", "round_half_up", "recode",
    "safe_double", "band", "judge", "norm_score", "guarded_ratio",
    "format_mean_std", "parse_mean", "score_to_p6",
]
