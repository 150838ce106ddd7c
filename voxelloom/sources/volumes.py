"""Catalog lookups and Parquet tables for patches, logs and snapshots; see ``chunks`` for volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import first_rows
from ..schema import RUN_METRICS, PatchShape

# Array keys tried in this order when none is given.
DEFAULT_KEYS = ("seismic", "volume", "data")
SHADOWED, SHADOW = "seismic__", "temp_folder__"


# ---- catalog ---------------------------------------------------------------


def resolve_arrays(catalog: DataFrame, key: str | None = None) -> DataFrame:
    """One array per store: the given key, else a default key, else the first by name."""
    if key is not None:
        return catalog.filter(F.col("array_key") == key)
    rank = F.lit(len(DEFAULT_KEYS))
    for i, name in reversed(list(enumerate(DEFAULT_KEYS))):
        rank = F.when(F.col("array_key") == name, i).otherwise(rank)
    best = F.min_by(F.struct(*catalog.columns), F.struct(rank, "array_key"))
    return catalog.groupBy("store_id").agg(best.alias("best")).select("best.*")


def read_volume(catalog: DataFrame, traces: DataFrame, store_id, key: str | None = None) -> DataFrame:
    """Traces of one store's resolved array; fails when the store has none.

    ``catalog`` has a volume_id per array.  The store is one catalog entry, so
    its volume id is a scalar and the trace scan is filtered by it.
    """
    entry = resolve_arrays(catalog.filter(F.col("store_id") == store_id), key).select("volume_id").head(2)
    if not entry:
        raise ValueError(f"store {store_id!r} has no array {key or ''}".rstrip())
    if len(entry) > 1:
        raise ValueError(f"store {store_id!r} has several arrays {key or ''}".rstrip())
    return traces.filter(F.col("volume_id") == entry[0]["volume_id"])


def discover_volumes(stores: DataFrame) -> DataFrame:
    """Stores (parent_dir, dir_name, ...) without those shadowed by a temp sibling."""
    name = F.col("dir_name")
    sibling = F.when(
        name.startswith(SHADOWED), F.concat(F.lit(SHADOW), F.substring(name, len(SHADOWED) + 1, 1 << 20))
    )
    temps = stores.filter(name.startswith(SHADOW)).select("parent_dir", name.alias("_sibling")).distinct()
    return stores.withColumn("_sibling", sibling).join(temps, ["parent_dir", "_sibling"], "left_anti").drop("_sibling")


def eligible_pairs(catalog: DataFrame, seismic_key: str, score_key: str) -> DataFrame:
    """Stores with a rank-3 seismic array and a score array, and how to read the score."""
    names = ("ndim", "nx", "ny", "nz")
    at = lambda k, c: F.max(F.when(F.col("array_key") == k, F.col(c)))
    wide = catalog.filter(F.col("array_key").isin(seismic_key, score_key)).groupBy("store_id").agg(
        *[at(seismic_key, c).alias(c) for c in names], *[at(score_key, c).alias(f"s_{c}") for c in names]
    )
    flat, full = F.col("s_ndim") == 2, F.col("s_ndim") == 3
    return wide.filter((F.col("ndim") == 3) & F.col("s_ndim").isNotNull()).select(
        "store_id", "nx", "ny", "nz",
        F.when(flat | full, F.col("s_nx")).otherwise(F.col("nx")).alias("score_nx"),
        F.when(flat | full, F.col("s_ny")).otherwise(F.col("ny")).alias("score_ny"),
        F.when(flat, 1).when(full, F.col("s_nz")).otherwise(F.col("nz")).alias("score_nz"),
        F.when(flat, "flat").when(full, "volume").otherwise("zero").alias("score_kind"),
    )


# ---- patches ---------------------------------------------------------------


def check_patches(patches: DataFrame, size) -> DataFrame:
    """Pass patches through, failing on a cube of another size."""
    p = PatchShape.of(size)
    wrong = F.raise_error(F.lit("patch has a different size")).cast("array<float>")
    return patches.withColumn("cube", F.when(F.size("cube") == p.samples, F.col("cube")).otherwise(wrong))


def write_patches(patches: DataFrame, path: str, meta: dict, most: int | None = None, order: Sequence[str] = ("volume_id", "draw")) -> None:
    """Write patches up to the cap in draw order, with their shape and scaling next to them.

    ``order`` is unique per patch.  ``meta``: size, scaling_mode, scaling_mean, scaling_std.
    """
    spark = patches.sparkSession
    kept = first_rows(patches, order, most) if most is not None else patches
    kept.withColumn("cube", F.col("cube").cast("array<float>")).write.mode("overwrite").parquet(f"{path}/patches")
    p = PatchShape.of(meta["size"])
    row = (p.x, p.y, p.z, meta["scaling_mode"], float(meta["scaling_mean"]), float(meta["scaling_std"]))
    schema = "nx int, ny int, nz int, scaling_mode string, scaling_mean double, scaling_std double"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, PatchShape]:
    """Patches and their shape; a cube that does not fit the shape fails on use."""
    row = spark.read.parquet(f"{path}/meta").first()
    p = PatchShape(row["nx"], row["ny"], row["nz"])
    return check_patches(spark.read.parquet(f"{path}/patches"), p), p


# ---- logs and snapshots ----------------------------------------------------


def append_run_metrics(rows: DataFrame, path: str) -> None:
    """Append epoch rows in the fixed column order; the header is part of every file."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in RUN_METRICS]).write.mode("append").csv(path, header=True)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RUN_METRICS, header=True, enforceSchema=False)


def append_snapshots(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Scores per epoch; old files named the loss ``mse``."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    names = [c for c in ("recon_loss", "mse") if c in df.columns]
    return df.withColumn("recon_loss", F.coalesce(*names)).drop("mse")


def save_representatives(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def load_representatives(spark: SparkSession, path: str) -> DataFrame:
    """Chosen examples of the two splits that are used."""
    return spark.read.parquet(path).filter(F.col("split").isin("training", "validation"))


def search_report(
    similarity_map: DataFrame, windows: DataFrame, source_dims: DataFrame, search_dims: DataFrame,
    padded: DataFrame, elapsed_s: float, size, stride: int, mode: str, latent: str, batch_size: int = 32,
    *, source_id: str,
) -> DataFrame:
    """One record per searched volume: settings, shapes, rate and value summary.

    Each summary is a one-row-per-volume aggregate.
    """
    p = PatchShape.of(size)
    shape = lambda *c: F.array(*[F.col(x) for x in c])
    summary = similarity_map.groupBy("volume_id").agg(
        F.min("sim").alias("output_min"), F.max("sim").alias("output_max"),
        F.avg("sim").alias("output_mean"), F.stddev_pop("sim").alias("output_std"),
        F.array(F.max("x") + 1, F.max("y") + 1, F.max("z") + 1).alias("output_shape"),
    )
    src = source_dims.where(F.col("volume_id") == source_id).select(shape("nx", "ny", "nz")).scalar()
    return (
        summary.join(windows.withColumnRenamed("windows", "total_windows"), "volume_id")
        .join(search_dims.select("volume_id", shape("nx", "ny", "nz").alias("search_shape")), "volume_id")
        .join(padded.select("volume_id", shape("px", "py", "pz").alias("padded_shape")), "volume_id")
        .withColumn("source_shape", src)
        .withColumn("patch_size", F.array(*[F.lit(v) for v in p.axes]))
        .withColumn("stride", F.lit(stride))
        .withColumn("batch_size", F.lit(batch_size))
        .withColumn("similarity_mode", F.lit(mode))
        .withColumn("latent_mode", F.lit(latent))
        .withColumn("status", F.lit("completed"))
        .withColumn("elapsed_s", F.lit(float(elapsed_s)))
        .withColumn("windows_per_sec", F.col("total_windows") / F.greatest(F.lit(float(elapsed_s)), F.lit(1e-6)))
    )


def write_report(report: DataFrame, path: str) -> None:
    """Store search reports as JSON records."""
    report.write.mode("overwrite").json(path)
