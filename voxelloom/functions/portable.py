"""Stateless uniform draws that any engine with md5 can reproduce.

A draw depends only on its seed, its purpose and the ids it is made for, so it
does not change with partitioning, retries or the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _part(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value))


def uniform(seed: int, purpose: str, *ids) -> Column:
    """A double in [0, 1) for these ids."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[_part(v) for v in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def open_uniform(seed: int, purpose: str, *ids) -> Column:
    """A double strictly inside (0, 1), safe for logarithms."""
    return uniform(seed, purpose, *ids) + F.lit(0.5 / TWO32)


def triangular(u: Column, low, mode, high) -> Column:
    """Inverse CDF of the triangular distribution at ``u``."""
    low, mode, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, mode, high))
    span = high - low
    left = low + F.sqrt(u * span * (mode - low))
    right = high - F.sqrt((1 - u) * span * (high - mode))
    return F.when(span <= 0, low).when(u * span < mode - low, left).otherwise(right)


def between(u: Column, low, high) -> Column:
    """Map a unit draw to a whole number in [low, high]."""
    low = low if isinstance(low, Column) else F.lit(int(low))
    high = high if isinstance(high, Column) else F.lit(int(high))
    return (low + F.floor(u * (high - low + 1))).cast("int")


def uniform_sql(seed: int, purpose: str, *ids: str) -> str:
    """The same draw as SQL text, for use inside lambdas."""
    parts = ", ".join(f"string({v})" for v in ids)
    return (
        f"(double(conv(substr(md5(concat_ws('|', '{seed}', '{purpose}', {parts})), 1, 8), 16, 10)) / {TWO32!r}D)"
    )
