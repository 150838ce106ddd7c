"""Weighted draws of positions and examples, reproducible for a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import array_total
from ..functions.portable import between, open_uniform, uniform
from ..schema import PatchShape
from .grid import AXES, in_boxes
from .joins import last_before, running_sum
from ..session import materialize


def candidate_positions(dims: DataFrame, size, n: int = 1000, seed: int = 0) -> DataFrame:
    """``n`` uniform box starts per volume, with repeats; none where the patch does not fit."""
    p = PatchShape.of(size)
    fits = dims
    for a, step in zip(AXES, p.axes):
        fits = fits.filter(F.col(f"n{a}") >= step)
    drawn = fits.withColumn("cand", F.explode(F.sequence(F.lit(1), F.lit(n))))
    starts = [
        between(uniform(seed, f"cand_{a}", F.col("volume_id"), F.col("cand")), 0, F.col(f"n{a}") - step).alias(f"b{a}")
        for a, step in zip(AXES, p.axes)
    ]
    return drawn.select("volume_id", "cand", *starts)


def box_scores(scores: DataFrame, boxes: DataFrame, size, broadcast_z: bool = False) -> DataFrame:
    """Sum of score samples inside each box; parts outside the score map add 0.

    ``scores`` is a trace table; NaN reads 0 and negative weights are clipped.
    A flat map has one z sample, so boxes starting deeper score 0 unless
    ``broadcast_z`` repeats it over depth.
    """
    p = PatchShape.of(size)
    clean = scores.withColumn(
        "amps", F.expr("transform(amps, v -> greatest(nanvl(cast(v as double), 0D), 0D))")
    )
    value = array_total(f"slice(amps, greatest(bz, 0) + 1, {p.z})")
    if broadcast_z:
        value = F.when(F.size("amps") == 1, F.get("amps", F.lit(0)) * p.z).otherwise(value)
    # Each score trace adds to the boxes that contain it where it is read; sums move, traces do not.
    hits = in_boxes(clean.select("volume_id", "x", "y", "amps"), boxes.select("volume_id", "cand", "bx", "by", "bz"), p)
    sums = hits.groupBy("volume_id", "cand").agg(F.sum(value).alias("score"))
    return boxes.join(sums, ["volume_id", "cand"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _with_fallback(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uniform weights for groups whose scores add up to nothing."""
    w = Window.partitionBy(*keys)
    total = F.sum("score").over(w)
    return df.withColumn("weight", F.when(total <= 0, F.lit(1.0)).otherwise(F.col("score")))


def weighted_pick(
    df: DataFrame, n: int, replace: bool = True, keys: Sequence[str] = ("volume_id",),
    order: str = "cand", seed: int = 0,
) -> DataFrame:
    """Pick rows of each group with probability score / total score.

    With replacement: ``n`` uniform positions on the running total, looked up
    in one sorted pass.  Without: the ``n`` smallest of -ln(u)/weight among
    rows with weight, one row per distinct candidate.  Groups are candidate
    lists, whose length is a parameter of ``candidate_positions``.
    """
    keys = list(keys)
    weighted = _with_fallback(df, keys)
    if not replace:
        ids = [F.col(k) for k in keys]
        race = -F.log(open_uniform(seed, "race", *ids, F.col(order))) / F.col("weight")
        place = Window.partitionBy(*keys).orderBy("_race", order)
        return (
            weighted.filter("weight > 0").withColumn("_race", race)
            .withColumn("draw", F.row_number().over(place)).filter(F.col("draw") <= n)
            .drop("_race", "weight")
        )
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = weighted.withColumn("_end", F.sum("weight").over(upto)).withColumn("_at", F.col("_end") - F.col("weight"))
    body = [c for c in df.columns if c not in keys]
    marks = ends.filter("weight > 0").select(*keys, "_at", F.lit(0).alias("draw"), F.struct(*body).alias("_row"))
    totals = ends.groupBy(*keys).agg(F.max("_end").alias("_total"))
    draws = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = uniform(seed, "pick", *[F.col(k) for k in keys], F.col("draw"))
    probes = draws.select(*keys, (u * F.col("_total")).alias("_at"), "draw")
    along = Window.partitionBy(*keys).orderBy("_at", "draw").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(probes, allowMissingColumns=True)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(along)).filter("draw > 0")
    return found.select(*keys, "draw", "_row.*")


def distinct_positions(df: DataFrame) -> DataFrame:
    """One candidate (the first) per position, for draws that must not repeat a place."""
    first = Window.partitionBy("volume_id", "bx", "by", "bz").orderBy("cand")
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def resample_examples(weights: DataFrame, seed: int = 0, examples: DataFrame | None = None) -> DataFrame:
    """As many draws with replacement as there are examples: rows (draw, example_id).

    ``weights``: example_id (0..N-1), weight; with ``examples`` given, one
    weight for each of them is checked.  Works for any N and any weight
    distribution: the running total and the lookup are both cut into sorted,
    evenly filled slabs.
    """
    if examples is not None:
        check_weights(weights, examples)
    w = F.col("weight")
    bad = F.count_if(w.isNull() | F.isnan(w) | (w == float("inf")))
    check = weights.agg(
        F.count("*").alias("n"), bad.alias("bad"), F.count_if(w < 0).alias("negative"), F.sum(w).alias("total")
    ).first()
    if check["bad"]:
        raise ValueError("sample weights must be finite")
    if check["negative"]:
        raise ValueError("sample weights must not be negative")
    n, flat = int(check["n"]), not (check["total"] or 0) > 0
    used = weights.select("example_id", (F.lit(1.0) if flat else w.cast("double")).alias("weight"))
    summed = materialize(running_sum(used, [], ["example_id"], "weight", "_end"))
    total = summed.agg(F.max("_end")).scalar()
    marks = summed.filter("weight > 0").select((F.col("_end") - F.col("weight")).alias("_at"), "example_id")
    draws = weights.sparkSession.range(n).select(
        F.col("id").alias("draw"), (uniform(seed, "resample", F.col("id")) * total).alias("_at")
    )
    return last_before(marks, draws, "_at", "example_id").select("draw", "example_id")


def check_weights(weights: DataFrame, examples: DataFrame) -> None:
    """Every example needs exactly one weight."""
    if weights.count() != examples.count():
        raise ValueError("weights and examples differ in length")


def mixup_partner(examples: DataFrame, seed: int = 0, corpus: DataFrame | None = None) -> DataFrame:
    """A uniform other example for each example (ids 0..N-1, checked); a single one gets itself.

    ``corpus`` is where the partners come from, by default the examples.
    """
    dense = (F.count("*") == 0) | ((F.min("example_id") == 0) & (F.max("example_id") == F.count("*") - 1))
    gaps = F.raise_error(F.lit("partners need example ids 0..N-1 without gaps")).cast("bigint")
    n = (examples if corpus is None else corpus).agg(F.when(dense, F.count("*")).otherwise(gaps)).scalar()
    i = F.col("example_id")
    drawn = F.floor(uniform(seed, "partner", i) * (F.col("_n") - 1))
    other = drawn + F.when(drawn >= i, 1).otherwise(0)
    return (
        examples.withColumn("_n", n)
        .withColumn("partner_id", F.when(F.col("_n") <= 1, i).otherwise(other).cast("bigint"))
        .drop("_n")
    )

