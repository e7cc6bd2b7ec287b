"""Deterministic, partition-independent pseudo-randomness.

``rand()``/``randn()`` depend on partition layout, so a re-run after an
executor loss (or with a different number of partitions) draws different
values. Every random choice in the library is instead a pure function of
(row key, tag, seed) via md5, which is identical on every engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32_PLUS1 = 4294967297.0  # 2**32 + 1


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash (first 8 hex digits of md5 of 'a:b:...') as bigint."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform in the open interval (0, 1): (h + 1) / (2^32 + 1)."""
    return (hash32(*parts) + F.lit(1)).cast("double") / F.lit(_TWO32_PLUS1)


def hash_gaussian(*parts) -> Column:
    """Standard normal draw by Box-Muller over two independent hash uniforms."""
    u1 = hash_uniform(*parts, "u1")
    u2 = hash_uniform(*parts, "u2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
