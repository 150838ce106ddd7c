"""Scoring latents against a token and blending window scores into a volume."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import hann, similarity
from ..schema import PatchShape
from .grid import AXES
from .joins import with_dims

# Windows over one block that are summed in columns of their own.
COLUMNS = 64


def score_latents(latents: DataFrame, token: DataFrame, mode: str = "cosine", eps: float = 1e-8) -> DataFrame:
    """Score every latent against the one-row token.

    The token is a scalar subquery: one small value per query, no join.
    """
    target = latents.withColumn("_target", token.select("latent").scalar())
    return target.withColumn("sim", similarity("latent", "_target", mode, eps)).drop("latent", "_target")


def hann_taper(spark, size) -> DataFrame:
    """The 3-D taper as rows (x, y, z, weight)."""
    p = PatchShape.of(size)
    out = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(p.x - 1))).alias("x"))
    out = out.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(p.y - 1))))
    out = out.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(p.z - 1))))
    return out.withColumn("weight", hann(F.col("x"), p.x) * hann(F.col("y"), p.y) * hann(F.col("z"), p.z))


def _taper_sql(n: int) -> str:
    """The taper of one axis as a constant array."""
    values = [1.0] if n == 1 else [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def _units(p: PatchShape, stride: int) -> dict[str, int]:
    """Block extents shared by all windows."""
    return {a: math.gcd(stride, n) for a, n in zip(AXES, p.axes)}


def _steps(p: PatchShape, stride: int) -> list[tuple[str, ...]]:
    """Axes that are summed out together: as many as leave few windows over a block."""
    unit = _units(p, stride)
    pieces = {a: n // unit[a] for a, n in zip(AXES, p.axes)}
    steps: list[tuple[str, ...]] = []
    for a in reversed(AXES):
        if steps and pieces[a] * math.prod(pieces[b] for b in steps[-1]) <= COLUMNS:
            steps[-1] = (a, *steps[-1])
        else:
            steps.append((a,))
    return steps


def _offsets(p: PatchShape, stride: int, axes: Sequence[str]) -> list[tuple[int, ...]]:
    unit, size = _units(p, stride), dict(zip(AXES, p.axes))
    return list(product(*[range(size[a] // unit[a]) for a in axes]))


def _pieces(rows: DataFrame, p: PatchShape, stride: int, axes: Sequence[str]) -> DataFrame:
    """Rows (num, den) of windows, once per grid block on ``axes`` that the window covers, with the block's offset ``k``."""
    unit = _units(p, stride)
    keys = [c for c in rows.columns if c not in ("num", "den", *(f"w{a}" for a in axes))]
    spots = ", ".join(
        f"struct({k} as k, " + ", ".join(f"{o} as o{a}" for o, a in zip(off, axes)) + ")"
        for k, off in enumerate(_offsets(p, stride, axes))
    )
    return rows.selectExpr(*rows.columns, f"inline(array({spots}))").selectExpr(
        *keys, *[f"int(w{a} div {unit[a]} + o{a}) as b{a}" for a in axes], "k", "num", "den"
    )


def _regroup(rows: DataFrame, p: PatchShape, stride: int, axes: Sequence[str], seeds: DataFrame | None = None) -> DataFrame:
    """Rows (num, den) of windows as sums per grid block on ``axes``: ``s_k`` and ``n_k`` per offset k.

    Columns that are neither ``num`` nor ``den`` nor starts on ``axes`` are keys.
    ``seeds`` are keys that get a row in any case.
    """
    placed = _pieces(rows, p, stride, axes)
    keys = [c for c in placed.columns if c not in ("k", "num", "den")]
    if seeds is not None:
        placed = placed.unionByName(seeds, allowMissingColumns=True)
    every = range(len(_offsets(p, stride, axes)))
    return placed.groupBy(*keys).agg(
        *[F.expr(f"sum(if(k = {k}, num, null)) as s_{k}") for k in every],
        *[F.expr(f"sum(if(k = {k}, den, null)) as n_{k}") for k in every],
    )


def _expand(
    blocks: DataFrame, p: PatchShape, stride: int, axes: Sequence[str], base: int, keys: Sequence[str]
) -> DataFrame:
    """Block sums as rows (num, den) per coordinate on ``axes``, in the volume's own coordinates.

    ``blocks`` have the extents ``e{a}`` and the columns ``keys``; samples
    outside the extent are never generated.  The taper is a product over axes,
    so each axis is summed out as soon as its coordinate is generated; few
    terms are left per sample.
    """
    unit, size = _units(p, stride), dict(zip(AXES, p.axes))
    left = {off: (f"coalesce(s_{k}, 0D)", f"coalesce(n_{k}, 0D)") for k, off in enumerate(_offsets(p, stride, axes))}
    made, out = list(keys), blocks
    for i, a in enumerate(axes):
        u, n = unit[a], size[a]
        low, high = f"greatest(b{a} * {u}, {base})", f"least(b{a} * {u} + {u - 1}, e{a} + {base - 1})"
        out = out.selectExpr("*", f"explode(if({low} <= {high}, sequence({low}, {high}), null)) as g{a}")
        inside, pieces = f"g{a} - b{a} * {u}", range(n // u)
        h = [f"get({_taper_sql(n)}, {inside} + {o * u})" for o in pieces]
        rest = sorted({off[1:] for off in left})
        sums = {r: [" + ".join(f"{left[(o, *r)][t]} * {h[o]}" for o in pieces) for t in (0, 1)] for r in rest}
        keep = [f"{c}{b}" for b in axes[i + 1:] for c in "be"]
        names = {r: (f"s{i}_{k}", f"n{i}_{k}") for k, r in enumerate(rest)}
        terms = [f"{sums[r][t]} as {names[r][t]}" for r in rest for t in (0, 1)]
        out = out.selectExpr(*made, f"int(g{a} - {base}) as {a}", *keep, *terms)
        made, left = [*made, a], names
    (top, weight), = left.values()
    return out.selectExpr(*made, f"{top} as num", f"{weight} as den")


def _scored(scores: DataFrame) -> DataFrame:
    return scores.selectExpr("volume_id", "wx", "wy", "wz", "double(sim) as num", "1D as den")


def block_pieces(scores: DataFrame, size, stride: int) -> tuple[dict[str, int], int, DataFrame]:
    """Block extents, offsets of a window's blocks, and the scores once per block (bx, by, bz, k, num, den)."""
    p = PatchShape.of(size)
    return _units(p, stride), len(_offsets(p, stride, AXES)), _pieces(_scored(scores), p, stride, AXES)


def block_sums(scores: DataFrame, size, stride: int) -> DataFrame:
    """Window scores regrouped by grid block: ``s_k`` and ``n_k`` per offset k.

    All samples of a block are covered by the same windows, so the running
    sums need one row per block, not per sample.
    """
    return _regroup(_scored(scores), PatchShape.of(size), stride, AXES)


def _bounds(dims: DataFrame, extent: Sequence[str]) -> DataFrame:
    return dims.select("volume_id", *[F.col(n).alias(f"e{a}") for n, a in zip(extent, AXES)])


def _block_grid(dims: DataFrame, p: PatchShape, stride: int, axes: Sequence[str], base: int, extent: Sequence[str]) -> DataFrame:
    """All blocks of each volume on ``axes``, and all its coordinates on the axes summed out before."""
    unit, out = _units(p, stride), _bounds(dims, extent)
    for a in AXES:
        if a in axes:
            every = f"sequence(int({base} div {unit[a]}), int((e{a} + {base - 1}) div {unit[a]})) "
            out = out.selectExpr("*", f"explode({every}) as b{a}")
        else:
            out = out.selectExpr("*", f"explode(sequence(0, int(e{a} - 1))) as {a}")
    return out.drop(*[f"e{a}" for a in AXES])


def expand_blocks(
    blocks: DataFrame, dims: DataFrame, size, stride: int, base: int = 0,
    extent: Sequence[str] = ("nx", "ny", "nz"), eps: float = 1e-8,
) -> DataFrame:
    """Turn block sums into samples: sum(sim*taper) / max(sum(taper), eps), 0 where there are no windows.

    ``base`` shifts padded coordinates back; every sample of the extent has a row.
    """
    p = PatchShape.of(size)
    at = ["volume_id", "bx", "by", "bz"]
    whole = blocks.unionByName(_block_grid(dims, p, stride, AXES, base, extent), allowMissingColumns=True)
    sums = [c for c in blocks.columns if c not in at]
    held = whole.groupBy(*at).agg(*[F.sum(c).cast("double").alias(c) for c in sums])
    rows = _expand(with_dims(held, _bounds(dims, extent), at[1:]), p, stride, AXES, base, ["volume_id"])
    return rows.selectExpr("volume_id", *AXES, f"num / greatest(den, {eps!r}D) as sim")


def overlap_add(
    scores: DataFrame, dims: DataFrame, size, stride: int, base: int = 0,
    extent: Sequence[str] = ("nx", "ny", "nz"), eps: float = 1e-8,
) -> DataFrame:
    """Taper-weighted blend of window scores over the full extent; 0 where no window is.

    The taper is a product over axes, so axes are blended one after the other,
    or several at once where only few windows lie over a block.  A sample thus
    meets the windows over it on one axis at a time, not all of them.
    """
    p = PatchShape.of(size)
    rows = _scored(scores)
    bounds, steps = _bounds(dims, extent), _steps(p, stride)
    for i, axes in enumerate(steps):
        seeds = _block_grid(dims, p, stride, axes, base, extent) if i == len(steps) - 1 else None
        blocks = _regroup(rows, p, stride, axes, seeds)
        keys = [c for c in rows.columns if c not in ("num", "den", *(f"w{a}" for a in axes))]
        spread = [*keys[1:], *[f"b{a}" for a in axes]]
        near = with_dims(blocks, bounds.select("volume_id", *[f"e{a}" for a in axes]), spread)
        rows = _expand(near, p, stride, axes, base, keys)
    return rows.selectExpr("volume_id", *AXES, f"num / greatest(den, {eps!r}D) as sim")


def shape_guard(similarity_map: DataFrame, dims: DataFrame) -> DataFrame:
    """Per volume: row count and extents of a map, failing when they differ from the catalog."""
    seen = similarity_map.groupBy("volume_id").agg(
        F.count("*").alias("samples"),
        *[F.min(a).alias(f"min_{a}") for a in AXES],
        *[(F.max(a) + 1).alias(f"size_{a}") for a in AXES],
    )
    both = dims.join(seen, "volume_id", "left")
    same = F.col("samples") == F.col("nx").cast("bigint") * F.col("ny") * F.col("nz")
    for a in AXES:
        same = same & (F.col(f"min_{a}") == 0) & (F.col(f"size_{a}") == F.col(f"n{a}"))
    wrong = F.raise_error(F.concat(F.lit("shape mismatch in volume "), F.col("volume_id")))
    return both.select(
        "volume_id", "nx", "ny", "nz", F.when(F.coalesce(same, F.lit(False)), F.col("samples")).otherwise(wrong).alias("samples")
    )
