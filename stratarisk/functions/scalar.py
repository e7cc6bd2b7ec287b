"""Scalar expressions: recoding, casting, banding, verdicts, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratarisk import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d.

    Written as plain IEEE arithmetic so that any engine evaluating the same
    expression returns the same bits (the decimal-string rounding of
    ``round`` differs between engines at representation boundaries).
    """
    s = float(10 ** digits)
    return F.floor(_c(x) * F.lit(s) + F.lit(0.5)) / F.lit(s)


def recode(x, mapping: dict) -> Column:
    """Keep listed codes only; every other value (and null) becomes null."""
    e = None
    for k, v in mapping.items():
        e = (F.when(_c(x) == F.lit(k), F.lit(v)) if e is None
             else e.when(_c(x) == F.lit(k), F.lit(v)))
    return e


def safe_double(x) -> Column:
    """Numeric cast that turns unparsable text into null (ANSI-safe)."""
    return _c(x).try_cast("double")


def band(x, uppers=None) -> Column:
    """Ordered buckets: band i holds x <= uppers[i]; above the last -> len(uppers).

    Null input gives null.
    """
    uppers = uppers or C.AGE_BAND_UPPER
    e = None
    for i, u in enumerate(uppers):
        cond = _c(x) <= F.lit(u)
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return e.when(_c(x).isNotNull(), F.lit(len(uppers)))


def judge(val, good, warn, low_best) -> Column:
    """good / caution / risk with inclusive limits; null value -> null."""
    v, g, w, lb = _c(val), _c(good), _c(warn), _c(low_best)
    low = (F.when(v <= g, F.lit(C.VERDICT_GOOD))
           .when(v <= w, F.lit(C.VERDICT_CAUTION))
           .otherwise(F.lit(C.VERDICT_RISK)))
    high = (F.when(v >= g, F.lit(C.VERDICT_GOOD))
            .when(v >= w, F.lit(C.VERDICT_CAUTION))
            .otherwise(F.lit(C.VERDICT_RISK)))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(lb, low).otherwise(high)


def judge_metric(val, metric: str) -> Column:
    """``judge`` with the configured limits of one threshold row inlined."""
    row = {m: (g, w, lb) for m, g, w, lb, _ in C.THRESHOLDS}[metric]
    return judge(val, F.lit(row[0]), F.lit(row[1]), F.lit(row[2]))


def norm_score(val, good, bad, floor=C.COMPOSITE_FLOOR) -> Column:
    """1 at or below good, floor at or above bad, linear in between."""
    v, g, b, fl = _c(val), _c(good), _c(bad), (F.lit(floor) if not isinstance(floor, Column) else floor)
    return (F.when(v <= g, F.lit(1.0))
            .when(v >= b, fl)
            .otherwise(fl + (F.lit(1.0) - fl) * (F.lit(1.0) - (v - g) / (b - g))))


def guarded_ratio(num, den) -> Column:
    """num / den, 0 when den is 0 (undefined rates count as zero)."""
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den)).otherwise(F.lit(0.0))


def format_mean_std(mean, std, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f +- %.{digits}f", _c(mean), _c(std))


def parse_mean(text) -> Column:
    """Mean out of 'mean +- std'; the '-' sentinel (or junk) gives null."""
    t = F.nullif(F.trim(_c(text)), F.lit("-"))
    return F.trim(F.split(t, r"\+-").getItem(0)).try_cast("double")


def score_to_p6(p) -> Column:
    """Probability -> integer micro-units, so ties and sums are exact."""
    return F.round(_c(p) * F.lit(1000000.0)).cast("int")


def mean_of_rounded(x, digits: int = 4) -> Column:
    """Aggregate mean of values already rounded to ``digits`` decimals, exactly.

    The values are summed as integers (units of 10^-digits), so the result
    does not depend on summation order, then divided once: any engine
    evaluating the same expression gets the same bits.
    """
    s = float(10 ** digits)
    units = F.round(_c(x) * F.lit(s)).cast("bigint")
    return (F.sum(units).cast("double") / F.count(_c(x))) / F.lit(s)
