"""Per-example reconstruction scores, losses and example selection.

``target`` and predictions are arrays on one row per example, so per-example
scores need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PatchShape
from ..session import materialize
from .joins import LOOKUP_ROWS, lookup_join
from .latents import encode_batches
from .quantiles import exact_percentiles
from .volumes import filled

# Percentiles at which representative examples are chosen.
PERCENTILES = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95)
EPS = 1e-8


def _square_error(target: str, pred: str) -> Column:
    return F.expr(
        f"aggregate(zip_with({pred}, {target}, (p, t) -> (double(p) - double(t)) * (double(p) - double(t))), "
        "0D, (s, e) -> s + e)"
    )


def _energy(target: str) -> Column:
    return F.expr(f"aggregate({target}, 0D, (s, t) -> s + double(t) * double(t))")


def example_mse(target: str = "target", pred: str = "pred") -> Column:
    return _square_error(target, pred) / F.size(target)


def example_pmse(target: str = "target", pred: str = "pred", eps: float = EPS) -> Column:
    """Mean squared error relative to the mean energy of the target."""
    return example_mse(target, pred) / F.greatest(_energy(target) / F.size(target), F.lit(eps))


def _checked(weight: float) -> float:
    if not 0.0 <= weight <= 1.0:
        raise ValueError("the mse weight must be in [0, 1]")
    return float(weight)


def example_combined(weight: float = 0.6, target: str = "target", pred: str = "pred") -> Column:
    w = _checked(weight)
    return w * example_mse(target, pred) + (1 - w) * example_pmse(target, pred)


def batch_combined(df: DataFrame, weight: float = 0.6, keys: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Combined loss over whole batches: a ratio of means, not a mean of ratios."""
    w = _checked(weight)
    n = F.sum(F.size("target"))
    mse = F.sum(_square_error("target", "pred")) / n
    energy = F.sum(_energy("target")) / n
    return df.groupBy(*keys).agg(
        mse.alias("mse"), (w * mse + (1 - w) * mse / F.greatest(energy, F.lit(eps))).alias("combined")
    )


def multi_scale_score(preds: Sequence[str], weights: Sequence[float], mse_weight: float = 0.6, targets=None) -> Column:
    """Weighted sum of combined scores over output scales.

    ``targets`` names the target column per scale (see ``resize_cube`` for
    scales smaller than the target); by default all use ``target``.
    """
    if not preds or len(preds) != len(weights):
        raise ValueError("need one weight per output scale")
    if any(w < 0 for w in weights):
        raise ValueError("scale weights must not be negative")
    targets = targets or ["target"] * len(preds)
    total = F.lit(0.0)
    for pred, target, w in zip(preds, targets, weights):
        total = total + float(w) * example_combined(mse_weight, target, pred)
    return total


def resize_cube(cube: str, size, to) -> Column:
    """Trilinear resize of a C-order cube; sample centers keep their relative place."""
    p, q = PatchShape.of(size), PatchShape.of(to)

    def axis(i: str, n: int, m: int) -> str:
        return f"least(greatest(({i} + 0.5D) * {n}D / {m}D - 0.5D, 0D), {n - 1}D)"

    lo = lambda a: f"int(floor(s.{a}))"
    hi = lambda a, n: f"least({lo(a)} + 1, {n - 1})"
    terms = []
    for kx in (0, 1):
        for ky in (0, 1):
            for kz in (0, 1):
                at, part = [], []
                for k, a, n in ((kx, "x", p.x), (ky, "y", p.y), (kz, "z", p.z)):
                    at.append(hi(a, n) if k else lo(a))
                    part.append(f"(s.{a} - {lo(a)})" if k else f"(1 - s.{a} + {lo(a)})")
                v, w = f"get(c, ({at[0]} * {p.y} + {at[1]}) * {p.z} + {at[2]})", " * ".join(part)
                # A sample that the cube lacks counts only where it has a part in the result.
                terms.append(f"if({v} is null and {w} = 0, 0D, double({v}) * {w})")
    spot = (
        f"named_struct('x', {axis(f'(i div {q.y * q.z})', p.x, q.x)}, "
        f"'y', {axis(f'((i div {q.z}) % {q.y})', p.y, q.y)}, 'z', {axis(f'(i % {q.z})', p.z, q.z)})"
    )
    return F.expr(
        f"get(transform(array({cube}), c -> transform(transform(sequence(0, {q.samples - 1}), i -> {spot}), "
        f"s -> {' + '.join(terms)})), 0)"
    )


def kl_divergence(latents: DataFrame, target_samples: int | Column, mu: str = "mu", logvar: str = "logvar") -> DataFrame:
    """KL term of a batch: summed over latents, divided by its number of target samples.

    ``target_samples`` is the sample count of one example's target.
    """
    term = F.expr(
        f"aggregate(zip_with({mu}, {logvar}, (m, v) -> 1 + double(v) - double(m) * double(m) - exp(double(v))), "
        "0D, (s, e) -> s + e)"
    )
    return latents.agg((F.lit(-0.5) * F.sum(term) / (F.count("*") * target_samples)).alias("kl"))


def logit_metrics(real: DataFrame, fake: DataFrame, column: str = "logit") -> DataFrame:
    """Discriminator loss and accuracy over real=1 and fake=0, and the generator's term."""
    both = real.select(F.col(column).alias("l"), F.lit(1.0).alias("y")).unionByName(
        fake.select(F.col(column).alias("l"), F.lit(0.0).alias("y"))
    )

    def bce(y):
        l = F.col("l")  # noqa: E741
        return F.greatest(l, F.lit(0.0)) - l * y + F.log1p(F.exp(-F.abs(l)))

    right = F.when((F.col("l") >= 0).cast("double") == F.col("y"), 1.0).otherwise(0.0)
    return both.agg(
        F.avg(bce(F.col("y"))).alias("d_loss"),
        F.avg(right).alias("d_accuracy"),
        F.avg(F.when(F.col("y") == 0, bce(F.lit(1.0)))).alias("g_loss"),
    )


def snapshot_scores(
    examples: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size,
    mse_weight: float = 0.6, batch_size: int = 32,
) -> DataFrame:
    """Score every example (example_id, cube, target) with a batch model in one pass.

    The model reads samples that a cube lacks as 0; scores are over the samples that the target has.
    """
    p = PatchShape.of(size)

    def run(frames):
        model = make_model()
        for frame in frames:
            if frame.empty:
                continue
            cubes = np.stack(frame["cube"].to_numpy()).reshape(-1, *p.axes)
            flat = lambda b: np.asarray(model(b)).reshape(len(b), -1)
            out = encode_batches(cubes, flat, batch_size).astype(np.float64)
            pred = [row if held is None else row[np.asarray(held, np.int64)] for row, held in zip(out, frame["held"])]
            yield pd.DataFrame({"example_id": frame["example_id"], "target": frame["target"], "pred": pred})

    # Places of the samples at hand; NULL stands for all.
    held = "if(exists(target, v -> v is null), filter(sequence(0, size(target) - 1), i -> get(target, i) is not null), null)"
    predicted = examples.select(
        "example_id", filled().alias("cube"), F.filter("target", F.isnotnull).alias("target"), F.expr(held).alias("held")
    ).mapInPandas(run, "example_id bigint, target array<double>, pred array<double>")
    return predicted.select("example_id", example_combined(mse_weight).alias("recon_loss"))


def adaptive_probabilities(snapshots: DataFrame, window: int = 3, weight: float = 1.0) -> DataFrame:
    """Sampling probability per example from its latest losses.

    score = latest loss + weight * mean improvement over the last ``window``
    snapshots; bad scores read 0; a run without any score falls back to its
    losses and then to equal weights.  Run totals are plain aggregates joined
    back, so a run may have any number of examples.
    """
    if window < 2:
        raise ValueError("the improvement window needs at least 2 snapshots")
    loss = F.col("recon_loss").cast("double")
    newest = Window.partitionBy("run_id", "example_id").orderBy(F.desc("epoch"))
    recent = snapshots.select("run_id", "example_id", "epoch", loss.alias("loss")).withColumn(
        "age", F.row_number().over(newest)
    ).filter(F.col("age") <= window)
    gain = F.lead("loss").over(newest) - F.col("loss")
    scored = (
        recent.withColumn("gain", gain)
        .groupBy("run_id", "example_id")
        .agg(
            F.max(F.when(F.col("age") == 1, F.col("loss"))).alias("recon_loss"),
            F.coalesce(F.avg("gain"), F.lit(0.0)).alias("average_improvement"),
        )
    )

    def usable(v):
        fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        return F.when(fine, F.greatest(v, F.lit(0.0))).otherwise(0.0)

    first = usable(F.col("recon_loss") + weight * F.col("average_improvement"))
    scored = materialize(scored.withColumn("_first", first).withColumn("_second", usable(F.col("recon_loss"))))
    totals = materialize(scored.groupBy("run_id").agg(
        F.sum("_first").alias("_t1"), F.sum("_second").alias("_t2"), F.count("*").cast("double").alias("_t3")
    ))
    both = lookup_join(scored, totals, ["run_id"], ["example_id"])
    one, two = F.col("_t1") > 0, F.col("_t2") > 0
    score = F.when(one, F.col("_first")).when(two, F.col("_second")).otherwise(1.0)
    total = F.when(one, F.col("_t1")).when(two, F.col("_t2")).otherwise(F.col("_t3"))
    return both.select(
        "run_id", "example_id", "recon_loss", "average_improvement", score.alias("score"),
        (score / total).alias("probability"),
    )


def sampling_summary(probabilities: DataFrame) -> DataFrame:
    p = F.col("probability")
    return probabilities.groupBy("run_id").agg(
        F.avg("recon_loss").alias("recon_mean"),
        F.avg("average_improvement").alias("improvement_mean"),
        F.avg("score").alias("score_mean"),
        F.max(p).alias("probability_max"),
        F.min(p).alias("probability_min"),
        (-F.sum(p * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))).alias("entropy"),
    )


def representatives(scores: DataFrame, percents: Sequence[int] = PERCENTILES) -> DataFrame:
    """Per split, the example nearest each score percentile that is not used yet.

    ``scores``: split, example_id, score.  Only as many nearest examples per
    percentile as there are percentiles can ever be needed (ties go to the
    smaller id); that top-k is taken before the shuffle, and the assignment runs over at most
    len(percents)**2 rows per split.
    """
    k = len(percents)
    # Scores may come from a model: they are computed once.
    scores = materialize(scores.select("split", "example_id", "score"))
    marks = exact_percentiles(scores, ["split"], "score", list(percents))
    marks = materialize(
        marks.groupBy("split").agg(F.collect_list(F.struct("percent", F.col("score").alias("mark"))).alias("marks"))
    )
    near = lookup_join(scores, marks, ["split"], ["example_id"], most=LOOKUP_ROWS // k).select(
        "split", "example_id", "score", F.inline("marks")
    )
    # Distances equal to within 1e-9 of the mark are a tie: rounding of sums must not decide.
    gap = F.round(F.abs(F.col("score") - F.col("mark")) / F.greatest(F.abs("mark"), F.lit(1e-12)), 9)
    nearest = Window.partitionBy("split", "percent").orderBy("gap", "example_id")
    short = near.withColumn("gap", gap).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for percent in percents:
            options = frame[frame["percent"] == percent].sort_values("rank")
            free = options[~options["example_id"].isin(used)]
            best = (free if len(free) else options).iloc[0]
            used.add(best["example_id"])
            rows.append((best["split"], int(percent), int(best["example_id"]), float(best["score"])))
        return pd.DataFrame(rows, columns=["split", "percentile", "example_id", "score"])

    return short.groupBy("split").applyInPandas(
        assign, "split string, percentile int, example_id bigint, score double"
    )
