"""The pattern search: token, window latents, scores, blended similarity volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import AXES, padded_dims, window_count
from ..operators.latents import POOL_CUBE, build_token, windows_encoded, windows_pooled
from ..operators.similarity import overlap_add, score_latents
from ..schema import PatchShape
from ..session import materialize


def middle(dims: DataFrame, volume_id: str) -> tuple[int, int, int]:
    """Center of one volume, from its single catalog row."""
    row = dims.filter(dims.volume_id == volume_id).first()
    if row is None:
        raise ValueError(f"volume {volume_id!r} is not in the catalog")
    return tuple(int(row[f"n{a}"]) // 2 for a in AXES)


def window_latents(
    traces: DataFrame, dims: DataFrame, size=POOL_CUBE, stride: int = 16, base: int = 16,
    make_encoder=None, batch_size: int = 32,
) -> DataFrame:
    p = PatchShape.of(size)
    p.check_stride(stride)
    if make_encoder is not None:
        return windows_encoded(traces, dims, p, stride, make_encoder, base, batch_size)
    if p.axes != (POOL_CUBE,) * 3:
        raise ValueError("pooled latents need patch size 32")
    return windows_pooled(traces, dims, stride, base)


def search_volume(
    source: DataFrame, source_dims: DataFrame, search: DataFrame, search_dims: DataFrame,
    source_id: str, center=None, size=POOL_CUBE, stride: int = 16, mode: str = "cosine",
    base: int = 16, make_encoder=None, batch_size: int = 32,
) -> DataFrame:
    """Similarity of every sample of ``search`` to the pattern around ``center``.

    All volumes in ``search`` are scored at once.  Each volume's windows are
    counted against its grid, and every sample of its extent gets a row, so the
    result has exactly the searched extents (``guard_windows``, ``shape_guard``).
    """
    p = PatchShape.of(size)
    at = middle(source_dims, source_id) if center is None else center
    token = build_token(source, source_id, at, p, make_encoder)
    latents = window_latents(search, search_dims, p, stride, base, make_encoder, batch_size)
    # One row per window, read by the guard and by the blend.
    scores = materialize(score_latents(latents, token, mode))
    guard_windows(scores, search_dims, p, stride, base)
    return overlap_add(scores, search_dims, p, stride, base)


def guard_windows(scores: DataFrame, dims: DataFrame, size, stride: int, base: int = 16) -> None:
    """Fail where a volume's scored windows are not those of its padded grid, each once.

    The blend makes its samples from the catalog, so with these windows a map's
    shape is the volume's; ``shape_guard`` states the same of a finished map.
    """
    seen = scores.groupBy("volume_id").agg(F.count("*").alias("seen"), F.count_distinct("wx", "wy", "wz").alias("kinds"))
    both = window_count(dims, size, stride, base).join(seen, "volume_id", "full")
    wrong = both.where("not (windows <=> seen and windows <=> kinds)").select("volume_id").first()
    if wrong is not None:
        raise ValueError(f"shape mismatch in volume {wrong[0]}: its windows are not those of its grid")


__all__ = ["guard_windows", "middle", "padded_dims", "search_volume", "window_latents"]
