"""Exact percentiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one
task.  Here a mergeable sketch of bounded size brackets every wanted rank, one
counting pass checks the brackets, and only the rows inside them are kept.
From there on each pass counts rows per value bin (at most a fixed number of
bins per bracket, combined map-side) and narrows the ranks to one bin; passes
repeat until a bin is one value or small enough to sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import LOOKUP_ROWS, lookup_join

BINS = 65_535
SMALL_BIN = 100_000
# Size of a sketch, and how far a bracket reaches to either side of a rank, as a
# share of the group: more than twice the sketch's usual error.
SKETCH = 2_000
REACH = 0.004


def _narrow(bins: DataFrame, by: list[str]) -> DataFrame:
    """Pick, for every rank, the bin that holds it.

    ``bins``: by..., _ranks, _before, _bin, _n, _lo, _hi.  ``_before`` counts
    rows below the current range.
    """
    below = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(below), F.lit(0)))
    inside = F.expr("filter(_ranks, r -> r >= _before and r < _before + _n) as _ranks")
    rest = [c for c in placed.columns if c not in ("_ranks", "_bin")]
    return placed.select(*rest, inside).filter(F.size("_ranks") > 0)


def _united(ranges: DataFrame) -> DataFrame:
    """One row per range of a group, with all ranks that are looked for in it."""
    rest = [c for c in ranges.columns if c != "_ranks"]
    return ranges.groupBy(*rest).agg(F.expr("array_sort(array_distinct(flatten(collect_list(_ranks)))) as _ranks"))


def _spot(steps: int) -> Column:
    """Bin of a value within its range: even in value at one pass, in its logarithm at the next, so that either kind of range narrows."""

    def log(v: Column) -> Column:
        size = F.abs(v)
        return F.signum(v) * F.when(size > 1, F.log1p(F.lit(1e6)) + F.log(size)).otherwise(F.log1p(size * 1e6))

    v, lo, hi = (log(F.col(c)) if steps % 2 else F.col(c) for c in ("_v", "_lo", "_hi"))
    return F.coalesce(F.nanvl(F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * BINS).cast("double"), F.lit(0.0)), F.lit(0.0))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]
) -> DataFrame:
    """Linear-interpolated percentiles per group: keys..., percent, value.

    NULL and NaN values are ignored; groups without values are absent.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    wanted = f"array({', '.join(f'{float(p)!r}D' for p in percents)})"
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("_total"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_sketch"),
    )

    def at(share: float, end: str) -> str:
        return f"kll_sketch_get_quantile_double(_sketch, {share!r}D)" if 0 < share < 1 else end

    # A value that is surely beyond either rank of a percentile, but for few sketches and for small groups.
    each = ", ".join(
        f"struct(array_distinct(array(bigint(floor((_total - 1) * {p!r}D / 100)), bigint(ceil((_total - 1) * {p!r}D / 100)))) as _ranks, "
        f"{at(p / 100 - REACH, '_least')} as _lo, {at(p / 100 + REACH, '_most')} as _hi)"
        for p in map(float, percents)
    )
    brackets = materialize(groups.selectExpr(*keys, "_total", "_least", "_most", f"inline(array({each}))"))
    brackets = _united(brackets)
    # One pass counts what lies below and inside each bracket.
    packed = brackets.groupBy(*keys).agg(F.expr("collect_list(struct(_total, _least, _most, _ranks, _lo, _hi)) as _t"))
    counted = (
        lookup_join(rows, packed, keys, ["_v"], most=LOOKUP_ROWS // (2 * len(percents)))
        .select(*keys, "_v", F.expr("explode(filter(_t, t -> _v <= t._hi)) as _t")).select(*keys, "_v", "_t.*")
        .groupBy(*keys, "_total", "_least", "_most", "_ranks", "_lo", "_hi")
        .agg(F.expr("count_if(_v < _lo) as _before"), F.expr("count_if(_v >= _lo) as _n"))
    )
    # A bracket that misses a rank, which a sketch may do, becomes the whole group.
    right = "array_min(_ranks) >= _before and array_max(_ranks) < _before + _n"
    names = [*keys, "_total", "_ranks", "_before", "_n", "_lo", "_hi"]
    checked = counted.withColumn("_right", F.expr(right)).selectExpr(
        *keys, "_total", "_ranks", "if(_right, _before, 0L) as _before", "if(_right, _n, _total) as _n",
        "if(_right, _lo, _least) as _lo", "if(_right, _hi, _most) as _hi",
    )
    state = materialize(_united(checked).select(*names))
    settled = state.filter("_lo = _hi")
    # The rows inside open brackets are all that later passes read.
    still = state.filter("_lo < _hi").groupBy(*keys).agg(F.expr("collect_list(struct(_lo, _hi)) as _t"))
    rows = materialize(
        lookup_join(rows, still, keys, ["_v"], most=LOOKUP_ROWS // (2 * len(percents)))
        .filter("exists(_t, t -> _v >= t._lo and _v <= t._hi)").select(*keys, "_v")
    )

    def rows_in(targets: DataFrame) -> DataFrame:
        fields = "_total, _ranks, _before, _lo, _hi"
        packed = targets.groupBy(*keys).agg(F.expr(f"collect_list(struct({fields})) as _t"))
        near = lookup_join(rows, packed, keys, ["_v"], most=LOOKUP_ROWS // (2 * len(percents)))
        hits = F.expr("explode(filter(_t, t -> _v >= t._lo and _v <= t._hi)) as _t")
        return near.select(*keys, "_v", hits).select(*keys, "_v", "_t.*")

    def widest() -> int | None:
        """Rows of the fullest bin that is not a single value yet."""
        return state.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n")))).first()[0]

    width, steps = widest(), 0
    while width is not None and width > SMALL_BIN:
        spot, steps = _spot(steps), steps + 1
        by = [*keys, "_total", "_ranks", "_before", "_lo", "_hi"]
        binned = rows_in(state.filter("_lo < _hi")).groupBy(*by, spot.alias("_bin")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2")
        )
        picked = _narrow(binned, [*keys, "_lo", "_hi"]).drop("_lo", "_hi")
        state = materialize(_united(picked.withColumnsRenamed({"_lo2": "_lo", "_hi2": "_hi"})).select(*names))
        settled = settled.unionByName(state.filter("_lo = _hi"))
        width = widest()

    found = settled.select(*keys, "_total", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    if width is not None:
        # Every open bin now has at most SMALL_BIN rows.
        inside = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")
        ordered = rows_in(state.filter("_lo < _hi")).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
        found = found.unionByName(
            ordered.filter(F.array_contains("_ranks", F.col("_rank"))).select(*keys, "_total", "_rank", "_v")
        )

    # At most two ranks per percent and group from here on.
    table = found.groupBy(*keys, "_total").agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"))
    s = "((_total - 1) * percent / 100)"
    low, high = f"_at[bigint(floor({s}))]", f"_at[bigint(ceil({s}))]"
    out = table.selectExpr(*keys, "_at", "_total", f"explode({wanted}) as percent").selectExpr(
        *keys, "percent", f"{low} + ({high} - {low}) * ({s} - floor({s})) as {value}"
    )
    return out.drop("_all")
