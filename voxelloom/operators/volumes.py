"""Conversions between the trace, sample and patch forms, and per-trace transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import extrema, extrema_sql, from_map_sql, let_sql, scaled, std_sql
from ..schema import PatchShape
from ..session import materialize
from .joins import lookup_join, with_dims


def samples_of(traces: DataFrame) -> DataFrame:
    """One row per sample."""
    return traces.select("volume_id", "x", "y", F.posexplode("amps").alias("z", "amp"))


def traces_of(samples: DataFrame) -> DataFrame:
    """One row per vertical trace; samples missing below the deepest one read 0."""
    deepest = F.max("z")
    values = F.map_from_entries(F.collect_list(F.struct("z", "amp")))
    packed = samples.groupBy("volume_id", "x", "y").agg(values.alias("at"), deepest.alias("top"))
    full = F.expr(from_map_sql("at", "top + 1", "0"))
    return packed.select("volume_id", "x", "y", full.cast("array<float>").alias("amps"))


def patch_samples(patches: DataFrame, size, value: str = "cube") -> DataFrame:
    """One row per patch sample: example_id, x, y, z, amp.

    Samples that a patch lacks are NULL in its cube and have no row.
    """
    p = PatchShape.of(size)
    at = F.col("i")
    return patches.select("example_id", F.posexplode(value).alias("i", "amp")).where("amp is not null").select(
        "example_id",
        F.expr(f"cast(i div {p.y * p.z} as int)").alias("x"),
        F.expr(f"cast((i div {p.z}) % {p.y} as int)").alias("y"),
        (at % p.z).cast("int").alias("z"),
        "amp",
    )


def patches_of(samples: DataFrame, size) -> DataFrame:
    """C-order cubes from patch samples; absent samples read 0."""
    p = PatchShape.of(size)
    place = ((F.col("x") * p.y + F.col("y")) * p.z + F.col("z")).cast("int")
    packed = samples.groupBy("example_id").agg(
        F.map_from_entries(F.collect_list(F.struct(place, "amp"))).alias("at")
    )
    full = F.expr(from_map_sql("at", p.samples, "0"))
    return packed.select("example_id", full.cast("array<float>").alias("cube"))


# ---- amplitude transforms -------------------------------------------------


def scale_amplitude(df: DataFrame, mode: str, mean=0.0, std=1.0, column: str = "amp") -> DataFrame:
    """Scale a sample column by dataset mean and standard deviation.

    ``mean`` and ``std`` are numbers or one-row scalar columns, so dataset
    statistics join in without a shuffle.
    """
    return df.withColumn(column, scaled(F.col(column).cast("double"), mode, mean, std))


def scale_cubes(df: DataFrame, mode: str, mean=0.0, std=1.0, column: str = "cube") -> DataFrame:
    if mode == "none":
        return df
    return df.withColumn(column, F.transform(column, lambda v: scaled(v.cast("double"), mode, mean, std)))


def normalize_by_std(df: DataFrame, keys: Sequence[str], floor: float = 1e-6, column: str = "amp") -> DataFrame:
    """Divide the samples of each window by their population deviation.

    The keys name one window, whose size is fixed by the patch shape.
    """
    dev = F.stddev_pop(F.col(column).cast("double")).over(Window.partitionBy(*keys))
    return df.withColumn(column, F.col(column).cast("double") / F.greatest(dev, F.lit(floor)))


def whole(column: str = "cube") -> Column:
    """Whether a cube has all its samples."""
    return ~F.exists(column, F.isnull)


def filled(column: str = "cube") -> Column:
    """A cube as models read it: samples that it lacks are 0."""
    return F.expr(f"if(exists({column}, v -> v is null), transform({column}, v -> coalesce(v, float(0))), {column})")


def normalize_cubes(df: DataFrame, floor: float = 1e-6, column: str = "cube") -> DataFrame:
    """The same for one cube per row, without a shuffle."""
    return df.withColumn(column, _by_std(column, floor))


def trace_extrema(traces: DataFrame, column: str = "amps") -> DataFrame:
    """Keep strict peaks and troughs along each trace."""
    return traces.withColumn(column, extrema(column))


def _by_std(cube: str, floor: float, kept: str = "cb", value: str = "double(v) / dv") -> Column:
    """Divide (an expression of) a cube ``cb`` by the deviation of the samples it has."""
    dev = f"greatest({std_sql('filter(cb, v -> v is not null)')}, {floor!r}D)"
    return F.expr(let_sql(cube, "cb", let_sql(dev, "dv", f"transform({kept}, v -> {value})")))


def cube_extrema(cube: str, nz: int) -> Column:
    """Extrema along z inside a C-order cube with ``nz`` samples per trace."""
    return extrema(cube, nz)


def preprocess(patches: DataFrame, size, floor: float = 1e-6) -> DataFrame:
    """Normalize each cube by its deviation, keep extrema only.

    Extrema are found on the raw amplitudes: dividing by a positive number
    does not move them.  A cube with a NaN sample has no deviation and no
    extrema.
    """
    nz = PatchShape.of(size).z
    return patches.withColumn("cube", _by_std("cube", floor, extrema_sql("cb", nz), "if(isnan(dv), 0D, double(v) / dv)"))


# ---- slices and display ---------------------------------------------------


def ortho_slices(traces: DataFrame, dims: DataFrame, inline: int, crossline: int, depth: int) -> DataFrame:
    """The planes x=inline, y=crossline and z=depth, indices clamped into range.

    One pass over the traces: each trace gives one sample to the z plane and,
    where it lies on an x or y plane, all of its samples.
    """
    near = with_dims(traces, dims, ["x", "y"])
    at = {a: f"greatest(0, least(n{a} - 1, {int(k)}))" for a, k in zip("xyz", (inline, crossline, depth))}

    def whole(axis: str) -> str:
        rows = f"transform(amps, (v, z) -> struct('{axis}' as plane, z as z, v as amp))"
        return f"if({axis} = {at[axis]}, {rows}, slice({rows}, 1, 0))"

    one = f"array(struct('z' as plane, {at['z']} as z, get(amps, {at['z']}) as amp))"
    rows = F.expr(f"concat({whole('x')}, {whole('y')}, {one})")
    return near.select("volume_id", "x", "y", F.inline(rows))


def composite_slices(cubes: DataFrame, size, parts: Sequence[str] = ("input", "pred", "target")) -> DataFrame:
    """Middle inline and crossline of several cubes side by side.

    Result rows (example_id, section, depth, across, value) put the parts
    next to each other along ``across``; samples that a part lacks have none.
    """
    p = PatchShape.of(size)

    def section(name: str, part: str, first: int, width: int, trace: str) -> str:
        """Samples of one plane; ``trace`` gives the trace number at lateral place i div nz."""
        cell = (
            f"struct('{name}' as section, int(i % {p.z}) as depth, int(i div {p.z} + {first}) as across, "
            f"double(get(a, int(({trace}) * {p.z} + i % {p.z}))) as value)"
        )
        return let_sql(part, "a", f"transform(sequence(0, {width * p.z - 1}), i -> {cell})")

    planes = []
    for n, part in enumerate(parts):
        planes.append(section("inline", part, n * p.x, p.x, f"(i div {p.z}) * {p.y} + {p.y // 2}"))
        planes.append(section("crossline", part, n * p.y, p.y, f"i div {p.z} + {(p.x // 2) * p.y}"))
    return cubes.select("example_id", F.inline(F.expr(f"concat({', '.join(planes)})"))).where("value is not null")


def mask_below(df: DataFrame, threshold: float, low, high, column: str = "amp") -> DataFrame:
    """Blank (NULL) values smaller than a fraction of the symmetric color span."""
    part = min(max(float(threshold), 0.0), 1.0)
    span = F.greatest(F.abs(low), F.abs(high), F.lit(1e-6))
    v = F.col(column).cast("double")
    return df.withColumn(column, F.when(F.abs(v) >= span * part, v))


def clip_scaled(
    df: DataFrame, fraction: float, keys: Sequence[str], spread: Sequence[str], column: str = "amp",
    peaks: DataFrame | None = None,
) -> DataFrame:
    """Clip each group to a fraction of its largest magnitude and divide by that limit.

    ``peaks`` has the keys and ``peak`` where magnitudes are stored already.
    """
    v = F.col(column).cast("double")
    if peaks is None:
        peaks = materialize(df.groupBy(*keys).agg(F.max(F.abs(v)).alias("_peak")))
    else:
        peaks = peaks.select(*keys, F.col("peak").alias("_peak"))
    lim = F.greatest(F.col("_peak") * max(1e-6, float(fraction)), F.lit(1e-6))
    near = lookup_join(df, peaks, keys, spread)
    return near.withColumn(column, F.greatest(-lim, F.least(lim, v)) / lim).drop("_peak")
