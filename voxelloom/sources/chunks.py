"""Volumes stored by chunk, with a map of their files: box reads that skip files, statistics without samples.

A table of trace parts lies in ``path``, clustered by chunk.  Its map, in a
folder of the same table that scans of it skip, has one row per file and chunk:
where its samples lie, and their count, mean, squared deviations, least and
largest value.  Rows of the map can be merged in any order, so an append adds
rows and changes none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import chunk_extent
from ..operators.joins import with_dims
from ..operators.stats import merge_moments, whole_stats, with_moments
from ..schema import CHUNK_MAP

AXES = ("x", "y", "z")
KEYS = ("volume_id", "cx", "cy", "cz")


def _map_path(path: str) -> str:
    return f"{path.rstrip('/')}/_chunks"


# ---- writing ---------------------------------------------------------------


def write_volume_chunked(traces: DataFrame, dims: DataFrame, path: str, chunk=(16, 16, -1), append: bool = False) -> None:
    """Write traces clustered by chunk, so neighbouring traces share files and row groups, and their map.

    Depth chunks split each trace into parts (columns ``cz`` and ``z0``).  With
    ``append`` the table keeps what it has; a volume's traces are given once.
    Pages hold no more rows than a chunk has traces, so the page index of a file
    tells chunks apart.  Moments are made while a part is written, so the map
    reads narrow columns only.  A job that is lost before the map is written
    leaves files that readers find by listing; ``update_chunk_map`` adds them.
    """
    sx, sy, sz = chunk_extent(chunk)
    tagged = with_dims(traces, dims.select("volume_id", "nx", "ny"), ["x", "y"])
    tagged = tagged.withColumn("cx", F.floor(F.col("x") / (sx or F.col("nx"))).cast("int")).withColumn(
        "cy", F.floor(F.col("y") / (sy or F.col("ny"))).cast("int")
    )
    if sz is None:
        parts = F.array(F.struct(F.lit(0).alias("cz"), F.lit(0).alias("z0"), F.col("amps").alias("part")))
    else:
        parts = F.expr(
            f"transform(sequence(0, (size(amps) - 1) div {sz}), k -> "
            f"struct(int(k) as cz, int(k * {sz}) as z0, slice(amps, int(k * {sz} + 1), {sz}) as part))"
        )
    length = F.size("amps").alias("length")
    rows = tagged.select("volume_id", "cx", "cy", "x", "y", length, F.inline(parts)).withColumnRenamed("part", "amps")
    rows = rows.withColumn("z1", F.col("z0") + F.size("amps"))
    n = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *KEYS, "x", "y").sortWithinPartitions(*KEYS, "x", "y")
    out = with_moments(rows, "amps").write.mode("append" if append else "overwrite")
    if sx and sy:
        out = out.option("parquet.page.row.count.limit", sx * sy)
    out.parquet(path)
    update_chunk_map(traces.sparkSession, path)


def update_chunk_map(spark: SparkSession, path: str) -> None:
    """Add the files of a chunked volume that its map lacks; safe to repeat."""
    files = _unmapped(spark, path)
    if not files:
        return
    rows = spark.read.parquet(*files).withColumn("file", F.col("_metadata.file_name"))
    keys = ["file", *KEYS]
    spans = rows.groupBy(*keys).agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"),
        F.min("z0").alias("z0"), F.max("z1").alias("z1"), F.count("*").alias("parts"),
    )
    found = spans.join(merge_moments(rows, keys), keys)
    found.select(*[F.col(f.name).cast(f.dataType) for f in CHUNK_MAP]).write.mode("append").parquet(_map_path(path))


def chunk_map(spark: SparkSession, path: str) -> DataFrame:
    """One row per file and chunk; empty before the first write of a map.

    A file that was mapped by two updates at once has equal rows twice, of which one counts.
    """
    try:
        return spark.read.schema(CHUNK_MAP).parquet(_map_path(path)).dropDuplicates(["file", *KEYS])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNK_MAP)


def _unmapped(spark: SparkSession, path: str) -> list[str]:
    """Files that the map lacks: those of writes that are new or were cut off.

    Only names are listed, no file is opened.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    names = listed.select(F.col("_metadata.file_name").alias("file"))
    return _paths(path, names.join(chunk_map(spark, path).select("file"), "file", "left_anti"))


def _paths(path: str, files: DataFrame) -> list[str]:
    return sorted(f"{path.rstrip('/')}/{r['file']}" for r in files.select("file").distinct().toLocalIterator())


# ---- reading ---------------------------------------------------------------


def whole_traces(parts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Depth parts of each trace put together in order (volume_id, x, y, amps).

    Fails on a trace whose parts leave a gap or overlap between ``start`` and
    ``end``, columns that are the same in all parts of a trace.
    """
    bounds = [F.min(start).alias("_start"), F.min(end).alias("_end")]
    ordered = F.array_sort(F.collect_list(F.struct("z0", "amps"))).alias("_parts")
    packed = parts.groupBy("volume_id", "x", "y").agg(ordered, *bounds)
    reached = "aggregate(_parts, int(_start), (at, p) -> if(p.z0 = at, at + size(p.amps), -1))"
    whole = f"if({reached} = _end, flatten(transform(_parts, p -> p.amps)), raise_error('parts of a trace leave a gap or overlap'))"
    return packed.select("volume_id", "x", "y", F.expr(whole).alias("amps"))


def read_volume_chunked(spark: SparkSession, path: str) -> DataFrame:
    """The traces of a chunked volume (volume_id, x, y, amps), depth parts put together in order."""
    rows = spark.read.parquet(path)
    # Without depth chunks every trace is one part, and stays where it was written.
    if rows.where("cz > 0").isEmpty():
        return rows.select("volume_id", "x", "y", "amps")
    return whole_traces(rows, F.lit(0), F.col("length"))


def read_parts(spark: SparkSession, path: str, volume_id=None, low=None, high=None) -> DataFrame:
    """Trace parts (volume_id, x, y, z0, z1, length, amps) as they were written, without a shuffle.

    With a volume, and the corners of a box (the high one excluded), only files
    with a chunk that reaches into the box are opened, and in them only row
    groups and pages that can hold such parts.  File names of hits come to the
    driver, as they do in any scan.
    """
    want = F.lit(True)
    if volume_id is not None:
        want = F.col("volume_id") == F.lit(volume_id)
    hits, keep = want, want
    if low is not None and high is not None:
        if not len(low) == len(high) == 3:
            raise ValueError("a box has 3 low and 3 high ends")
        for a, lo, hi in zip(AXES, low, high):
            hits = hits & (F.col(f"{a}1") > int(lo)) & (F.col(f"{a}0") < int(hi))
        for a, lo, hi in zip(AXES[:2], low, high):
            keep = keep & (F.col(a) >= int(lo)) & (F.col(a) < int(hi))
        keep = keep & (F.col("z1") > int(low[2])) & (F.col("z0") < int(high[2]))
    columns = ["volume_id", "x", "y", "z0", "z1", "length", "amps"]
    # New files first: one that is mapped meanwhile is then found below.
    files = sorted({*_unmapped(spark, path), *_paths(path, chunk_map(spark, path).where(hits))})
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.where(keep).select(*columns)


def read_box(spark: SparkSession, path: str, volume_id, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Traces of one volume inside a box, cut to its depths (volume_id, x, y, z0, amps).

    ``low`` and ``high`` are corners along x, y and z, the high one excluded.
    What lies outside the volume has no samples: a box beyond its edge gives
    the part inside, and a trace without samples at these depths has no row.
    Only traces of the box are put together from depth parts.
    """
    first, last = max(int(low[2]), 0), int(high[2])
    parts = read_parts(spark, path, volume_id, low, high)
    begin = F.greatest(F.col("z0"), F.lit(first))
    span = F.least(F.col("z1"), F.lit(last)) - begin
    cut = parts.withColumn("amps", F.slice("amps", begin - F.col("z0") + 1, span)).withColumn("z0", begin)
    whole = whole_traces(cut, F.lit(first), F.least(F.col("length"), F.lit(last)))
    return whole.select("volume_id", "x", "y", F.lit(first).alias("z0"), "amps")


# ---- statistics ------------------------------------------------------------


def chunk_stats(spark: SparkSession, path: str) -> DataFrame:
    """Count, mean, population deviation, min and max of each chunk, from the map alone."""
    return whole_stats(merge_moments(_mapped(spark, path), list(KEYS)))


def stored_volume_stats(spark: SparkSession, path: str) -> DataFrame:
    """``volume_stats`` of a chunked table, from its map alone."""
    return whole_stats(merge_moments(_mapped(spark, path), ["volume_id"], ["cx", "cy", "cz"]))


def stored_dataset_stats(spark: SparkSession, path: str) -> DataFrame:
    """``dataset_stats`` of a chunked table, from its map alone; fails on no data."""
    none = F.raise_error(F.lit("no samples to compute dataset statistics"))
    merged = whole_stats(merge_moments(_mapped(spark, path), []))
    return merged.select(F.when(F.col("count") > 0, F.col("count")).otherwise(none).alias("count"), "mean", "std")


def stored_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Largest magnitude of each volume (volume_id, peak), as ``clip_scaled`` takes it."""
    ends = stored_volume_stats(spark, path)
    return ends.select("volume_id", F.greatest(F.abs("min"), F.abs("max")).alias("peak"))


def _mapped(spark: SparkSession, path: str) -> DataFrame:
    """The map, brought up to date first if files were left out."""
    update_chunk_map(spark, path)
    return chunk_map(spark, path)
