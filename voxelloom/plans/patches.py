"""Patch sampling: from a catalog of scored volumes to a training patch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import extract_boxes
from ..operators.joins import dense_ids, first_rows, lookup_join
from ..operators.sampling import box_scores, candidate_positions, distinct_positions, weighted_pick
from ..operators.stats import dataset_stats
from ..operators.volumes import samples_of, scale_cubes
from ..schema import PatchShape
from ..session import materialize
from ..sources.volumes import discover_volumes, eligible_pairs


def pick_boxes(
    dims: DataFrame, scores: DataFrame, size, n_per_volume: int = 100, n_candidates: int = 1000,
    allow_overlap: bool = True, broadcast_z: bool = False, seed: int = 0,
) -> DataFrame:
    """Score-weighted box starts per volume: volume_id, draw, cand, bx, by, bz, score."""
    p = PatchShape.of(size)
    found = candidate_positions(dims, p, n_candidates, seed)
    if not allow_overlap:
        found = distinct_positions(found)
    scored = box_scores(scores, found, p, broadcast_z)
    return weighted_pick(scored, n_per_volume, replace=allow_overlap, seed=seed)


def sample_patches(
    traces: DataFrame, scores: DataFrame, dims: DataFrame, size, n_patches: int = 5000,
    n_per_volume: int = 100, n_candidates: int = 1000, scaling: str = "divide_by_std",
    mean: float | None = None, std: float | None = None, allow_overlap: bool = True,
    broadcast_z: bool = False, seed: int = 0, stats: DataFrame | None = None,
) -> DataFrame:
    """Patches (example_id, volume_id, draw, bx, by, bz, cube), at most ``n_patches`` in draw order.

    Example ids run from 0 without gaps over all volumes.  ``dims`` lists the volumes to sample (see ``discover_volumes`` and
    ``eligible_pairs``).  Scaling statistics come from all samples unless
    ``std`` or ``stats`` is given, one row of ``mean`` and ``std`` such as
    ``stored_dataset_stats``, which reads no samples.
    """
    p = PatchShape.of(size)
    # Narrow rows that several steps below read.
    picks = materialize(pick_boxes(dims, scores, p, n_per_volume, n_candidates, allow_overlap, broadcast_z, seed))
    capped = materialize(first_rows(picks, ["volume_id", "draw"], n_patches))
    named = dense_ids(capped.drop("score", "cand"), ["volume_id", "draw"])
    cubes = extract_boxes(traces, named, dims, p, ["volume_id", "draw"])
    if scaling == "none":
        return cubes
    if std is None:
        stats = dataset_stats(samples_of(traces)) if stats is None else stats
        found = cubes.withColumn("_s", stats.select(F.struct("mean", "std")).scalar())
        cubes = scale_cubes(found, scaling, F.col("_s.mean"), F.col("_s.std")).drop("_s")
    else:
        cubes = scale_cubes(cubes, scaling, 0.0 if mean is None else mean, std)
    return cubes


def sample_stores(
    catalog: DataFrame, traces: DataFrame, size, seismic_key: str = "seismic", score_key: str = "geologic_score", **settings
) -> DataFrame:
    """``sample_patches`` over all stores of a catalog that have a volume and a score map.

    ``catalog`` has a row per array (store_id, parent_dir, dir_name, array_key,
    ndim, nx, ny, nz, volume_id), and ``traces`` holds all arrays.  Stores that
    a sibling shadows are left out.  A flat score map holds over all depths, and
    one of another rank weighs all positions alike.
    """
    stores = catalog.select("store_id", "parent_dir", "dir_name").distinct()
    known = catalog.join(discover_volumes(stores).select("store_id"), "store_id", "left_semi")
    names = known.groupBy("store_id").agg(
        F.max(F.when(F.col("array_key") == seismic_key, F.col("volume_id"))).alias("volume_id"),
        F.max(F.when(F.col("array_key") == score_key, F.col("volume_id"))).alias("score_id"),
    )
    # A row per store, read by several steps.
    pairs = materialize(eligible_pairs(known, seismic_key, score_key).join(names, "store_id"))
    dims = pairs.select("volume_id", "nx", "ny", "nz")
    seismic = lookup_join(traces, dims.select("volume_id"), ["volume_id"], ["x", "y"])
    scored = pairs.filter("score_kind <> 'zero'").select(F.col("score_id").alias("volume_id"), F.col("volume_id").alias("_for"))
    scores = lookup_join(traces, scored, ["volume_id"], ["x", "y"]).drop("volume_id").withColumnRenamed("_for", "volume_id")
    return sample_patches(seismic, scores, dims, size, broadcast_z=True, **settings)
