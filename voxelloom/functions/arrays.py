"""Expressions over dense arrays; all stay inside the JVM.

The ``*_sql`` functions compose SQL text, since long lambda expressions are
much cheaper to hand over as text than node by node.  Arguments are column
names, lambda variables or any SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let_sql(value: str, name: str, body: str) -> str:
    """Bind a value once for use inside lambdas.

    The optimizer merges projections and would otherwise copy the expression
    behind a column into a lambda body, to be computed again per element.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def total_sql(a: str) -> str:
    return f"aggregate({a}, 0D, (s, e) -> s + double(e))"


def std_sql(a: str) -> str:
    """Population standard deviation, around the mean for stability."""
    around = let_sql(
        f"{total_sql('sd_a')} / size(sd_a)", "sd_m",
        "aggregate(sd_a, 0D, (s, e) -> s + (double(e) - sd_m) * (double(e) - sd_m))",
    )
    return let_sql(a, "sd_a", f"sqrt({around} / size(sd_a))")


def dot_sql(a: str, b: str) -> str:
    return total_sql(f"zip_with({a}, {b}, (p, q) -> double(p) * double(q))")


def cosine_sql(a: str, b: str, eps: float = 1e-8) -> str:
    """Cosine similarity, 0 when the product of norms is below ``eps``."""
    norms = f"sqrt({dot_sql('cs.p', 'cs.p')}) * sqrt({dot_sql('cs.q', 'cs.q')})"
    ratio = let_sql(norms, "cs_n", f"if(cs_n < {eps!r}D, 0D, {dot_sql('cs.p', 'cs.q')} / cs_n)")
    return let_sql(f"struct({a} as p, {b} as q)", "cs", ratio)


def extrema_sql(a: str, depth: int | None = None) -> str:
    """Keep strict local peaks and troughs, zero everything else; NaN and its neighbours are neither.

    With ``depth`` the array is a C-order cube of traces of that many samples;
    the first and last sample of every trace is zeroed.
    """
    z, n = (f"i % {depth}", str(depth)) if depth else ("i", "size(ex)")
    before, after = "get(ex, i - 1)", "get(ex, i + 1)"
    numbers = f"not isnan(v) and not isnan({before}) and not isnan({after})"
    strict = f"{numbers} and ((v > {before} and v > {after}) or (v < {before} and v < {after}))"
    # Borders and flat spots are zero of the element's own type, also where the element less itself is NaN.
    zero = "if(isnan(v - v), float(0), v - v)"
    return let_sql(a, "ex", f"transform(ex, (v, i) -> if({z} > 0 and {z} < {n} - 1 and {strict}, v, {zero}))")


def interpolate_sql(a: str, position: str) -> str:
    """Linear interpolation at a fractional 0-based position; bind ``a`` first."""
    lo, hi = "int(floor(ip))", f"least(int(floor(ip)) + 1, size({a}) - 1)"
    value = f"double(get({a}, {lo})) * (1 - ip + floor(ip)) + double(get({a}, {hi})) * (ip - floor(ip))"
    return let_sql(position, "ip", value)


def percentile_sql(a: str, percent: float) -> str:
    """Linear percentile of one array (NumPy's default rule)."""
    return let_sql(f"array_sort({a})", "pa", interpolate_sql("pa", f"(size(pa) - 1) * {percent / 100.0!r}D"))


def from_map_sql(at: str, size: int | str, missing: str) -> str:
    """Dense array of ``size`` entries from a map keyed by position."""
    return let_sql(at, "mp", f"transform(sequence(0, {size} - 1), i -> coalesce(mp[i], {missing}))")


def zeros_sql(n: int | str) -> str:
    return f"array_repeat(float(0), {n})"


# ---- the same as columns -----------------------------------------------------


def array_total(a: str) -> Column:
    return F.expr(total_sql(a))


def array_std(a: str) -> Column:
    return F.expr(std_sql(a))


def dot(a: str, b: str) -> Column:
    return F.expr(dot_sql(a, b))


def cosine(a: str, b: str, eps: float = 1e-8) -> Column:
    return F.expr(cosine_sql(a, b, eps))


def similarity(a: str, b: str, mode: str = "cosine", eps: float = 1e-8) -> Column:
    kind = str(mode).strip().lower()
    if kind == "cosine":
        return cosine(a, b, eps)
    if kind == "dot":
        return dot(a, b)
    raise ValueError(f"unknown similarity mode: {mode!r}")


def extrema(a: str, depth: int | None = None) -> Column:
    return F.expr(extrema_sql(a, depth))


def percentile_of(a: str, percent: float) -> Column:
    return F.expr(percentile_sql(a, percent))


def hann(n: Column, size: int | Column) -> Column:
    """Periodic Hann taper at offset ``n`` of an axis with ``size`` samples."""
    size = size if isinstance(size, Column) else F.lit(int(size))
    return F.when(size == 1, 1.0).otherwise(0.5 - 0.5 * F.cos(F.lit(2.0 * math.pi) * n / size))


def clipped(v: Column, low, high) -> Column:
    low, high = (e if isinstance(e, Column) else F.lit(e) for e in (low, high))
    return F.greatest(low, F.least(high, v))


def scaled(v: Column, mode: str, mean=0.0, std=1.0, eps: float = 1e-8) -> Column:
    """Amplitude scaling by dataset statistics."""
    mean, std = (e if isinstance(e, Column) else F.lit(e) for e in (mean, std))
    if mode == "none":
        return v
    floor = F.greatest(F.abs(std), F.lit(eps))
    if mode == "divide_by_std":
        return v / floor
    if mode == "zscore":
        return (v - mean) / floor
    raise ValueError(f"unknown scaling mode: {mode!r}")
