"""Volume statistics and display limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let_sql, percentile_of, total_sql
from .joins import lookup_join
from .quantiles import exact_percentiles
from .volumes import clip_scaled, ortho_slices


def volume_stats(samples: DataFrame) -> DataFrame:
    """Count, mean, population deviation, min and max per volume.

    Built-in aggregates: partial moments are merged, so one huge volume is
    reduced in every task before anything is shuffled.
    """
    v = F.col("amp").cast("double")
    return samples.groupBy("volume_id").agg(
        F.count("amp").alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def dataset_stats(samples: DataFrame) -> DataFrame:
    """One row: mean and population deviation over all volumes; fails on no data."""
    v = F.col("amp").cast("double")
    none = F.raise_error(F.lit("no samples to compute dataset statistics"))
    return samples.agg(F.count("amp").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).select(
        F.when(F.col("count") > 0, F.col("count")).otherwise(none).alias("count"), "mean", "std"
    )


def with_moments(rows: DataFrame, column: str) -> DataFrame:
    """Moments of each row's array beside it: n, mean, square, least and most.

    ``square`` is the sum of squared deviations from the mean.  Nulls do not
    count; a row without values has n 0 and no other moments.
    """
    known = f"filter({column}, v -> v is not null)"
    mean = f"if(size(mo) > 0, {total_sql('mo')} / size(mo), null)"
    around = let_sql(mean, "mo_m", "struct(mo_m as mean, aggregate(mo, 0D, (s, e) -> s + (double(e) - mo_m) * (double(e) - mo_m)) as square)")
    rest = "bigint(size(mo)) as n, double(array_min(mo)) as least, double(array_max(mo)) as most"
    found = rows.withColumn("_mo", F.expr(let_sql(known, "mo", f"struct({rest}, {around} as around)")))
    return found.select(
        *rows.columns, F.coalesce("_mo.n", F.lit(0)).alias("n"), "_mo.around.mean",
        F.when(F.col("_mo.n") > 0, F.col("_mo.around.square")).alias("square"), "_mo.least", "_mo.most",
    )


def merge_moments(rows: DataFrame, keys: Sequence[str], spread: Sequence[str] | None = None) -> DataFrame:
    """Moments of whole groups from moments of their parts (n, mean, square, least, most).

    Squares are moved to the mean of the group, which is found first, so a
    mean far above the deviation costs no digits.  ``spread`` names columns that
    split a group with many parts over tasks.
    """
    keys = list(keys)
    n = F.col("n")
    ends = rows.groupBy(*keys).agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("_mean"))
    if not keys:
        near = rows.withColumn("_mean", ends.scalar())
    elif spread:
        near = lookup_join(rows, ends, keys, spread)
    else:
        near = rows.join(ends, keys)
    off = F.col("mean") - F.col("_mean")
    return near.groupBy(*keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("square") + n * off * off).alias("square"), F.min("least").alias("least"), F.max("most").alias("most"),
    )


def whole_stats(moments: DataFrame) -> DataFrame:
    """The columns of ``volume_stats`` from moments."""
    other = [c for c in moments.columns if c not in ("n", "mean", "square", "least", "most")]
    return moments.select(
        *other, F.col("n").alias("count"), "mean", F.sqrt(F.try_divide("square", "n")).alias("std"),
        F.col("least").alias("min"), F.col("most").alias("max"),
    )


def merge_stats(stats: DataFrame) -> DataFrame:
    """The same from rows of ``volume_stats``, without another pass over samples."""
    n, m = F.col("count"), F.col("mean")
    total = F.sum(n)
    mean = F.sum(n * m) / total
    square = F.sum(n * (F.col("std") * F.col("std") + m * m)) / total
    return stats.agg(
        total.alias("count"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std")
    )


def color_limits(
    samples: DataFrame, volumes: DataFrame, low: float = 2.0, high: float = 88.0, approximate: bool = False
) -> DataFrame:
    """Symmetric color limits per volume from two percentiles of finite values.

    ``volumes`` lists the volumes, so one without finite values still gets the
    limits (0, 1).  ``approximate`` trades exactness for a single pass.
    """
    finite = samples.filter(
        F.col("amp").isNotNull() & ~F.isnan("amp") & (F.abs("amp") < F.lit(float("inf")))
    )
    if approximate:
        pair = F.percentile_approx("amp", F.array(F.lit(low / 100), F.lit(high / 100)), F.lit(10_000))
        ends = finite.groupBy("volume_id").agg(pair.alias("p")).select(
            "volume_id", F.get("p", F.lit(0)).alias("p_low"), F.get("p", F.lit(1)).alias("p_high")
        )
    else:
        ends = exact_percentiles(finite, ["volume_id"], "amp", [low, high]).groupBy("volume_id").agg(
            F.max(F.when(F.col("percent") == low, F.col("amp"))).alias("p_low"),
            F.max(F.when(F.col("percent") == high, F.col("amp"))).alias("p_high"),
        )
    span = F.greatest(F.abs("p_low"), F.abs("p_high"), F.lit(1e-6))
    known = F.col("p_low").isNotNull()
    return volumes.select("volume_id").join(ends, "volume_id", "left").select(
        "volume_id", "p_low", "p_high",
        F.when(known, -span).otherwise(0.0).alias("clim_low"),
        F.when(known, span).otherwise(1.0).alias("clim_high"),
    )


def overlay_preview(
    base: DataFrame, overlay: DataFrame, dims: DataFrame, inline: int, crossline: int, depth: int,
    alpha: float = 0.5, input_clip: float = 1.0, output_clip: float = 1.0, threshold: float = 0.0,
) -> DataFrame:
    """Mean and deviation of three blended slices of two volumes with equal extents.

    Both inputs are trace tables keyed by the same volume_id.
    """
    a = min(max(float(alpha), 0.0), 1.0)
    cut = min(max(float(threshold), 0.0), 1.0)
    keys, spread = ["volume_id", "plane"], ["x", "y", "z"]
    under = clip_scaled(ortho_slices(base, dims, inline, crossline, depth), input_clip, keys, spread)
    over = clip_scaled(ortho_slices(overlay, dims, inline, crossline, depth), output_clip, keys, spread)
    over = over.withColumn("over", F.when(F.abs("amp") >= cut, F.col("amp")).otherwise(0.0)).drop("amp")
    both = under.join(over, [*keys, *spread])
    blend = (1.0 - a) * F.col("amp") + a * F.col("over")
    return both.groupBy("volume_id").agg(F.avg(blend).alias("preview_mean"), F.stddev_pop(blend).alias("preview_std"))


def latent_percentiles(latents: DataFrame, column: str, percents: Sequence[float] = (5, 20, 50, 80, 95)) -> DataFrame:
    """Percentiles of each row's vector; a vector is short, so no shuffle."""
    return latents.select(
        *[c for c in latents.columns if c != column],
        *[percentile_of(column, p).alias(f"p{p:g}") for p in percents],
    )


def nonzero_count(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count_if(F.col("amp") != 0).alias("non_zero"))


def volume_summary(similarity_map: DataFrame) -> DataFrame:
    """Min, max, mean and population deviation of a similarity map per volume."""
    return similarity_map.groupBy("volume_id").agg(
        F.min("sim").alias("min"), F.max("sim").alias("max"),
        F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"),
    )

