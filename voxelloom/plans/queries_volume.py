"""Sources, slices, grids and statistics over the volume tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, stats, volumes
from ..session import scratch_path
from ..sources import chunks
from ..sources import fixtures as fx
from ..sources import volumes as src
from .registry import q6, query, r6, sql

S = "volume_samples"
D = "volume_samples volume_dims"
OUT = "volume_id, x, y, z"


def _samples(spark, d):
    return volumes.samples_of(fx.volume_traces(spark, d))


def _both(spark, d):
    return fx.volume_traces(spark, d).unionByName(fx.mirror_traces(spark, d))


# ---- sources ----------------------------------------------------------------

RANK = "case array_key when 'seismic' then 0 when 'volume' then 1 when 'data' then 2 else 3 end"


@query("resolve_arrays", sql(
    "select cast(store_id as int) store_id, array_key, ndim, nx, ny, nz from ranked where rn = 1", "catalog",
    ranked=f"select *, row_number() over (partition by store_id order by {RANK}, array_key) rn from catalog"))
def _(spark, d):
    return src.resolve_arrays(fx.catalog(spark, d)).select("store_id", "array_key", "ndim", "nx", "ny", "nz")


@query("read_volume", sql(
    f"select volume_id, x, y, z, {q6('amp')} amp from v join picked on volume_id = want",
    "catalog volume_samples_mirror",
    picked=f"select case array_key when 'seismic' then 'v0' when 'volume' then 'v1' else 'v2' end want from catalog where store_id = 3 order by {RANK}, array_key limit 1",
    v="select * from volume_samples union all select * from volume_samples_mirror"))
def _(spark, d):
    key = F.col("array_key")
    cat = fx.catalog(spark, d).withColumn(
        "volume_id", F.when(key == "seismic", "v0").when(key == "volume", "v1").otherwise("v2"))
    got = src.read_volume(cat, _both(spark, d), 3)
    return volumes.samples_of(got).select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


@query("discover_volumes", sql(
    "select distinct store_id, dir_name from catalog c where not (dir_name like 'seismic\\_\\_%' escape '\\' and exists "
    "(select 1 from catalog t where t.parent_dir = c.parent_dir and t.dir_name = 'temp_folder__' || substr(c.dir_name, 10)))",
    "catalog"))
def _(spark, d):
    stores = fx.catalog(spark, d).select("store_id", "parent_dir", "dir_name").distinct()
    return src.discover_volumes(stores).select("store_id", "dir_name")


@query("eligible_pairs", sql(
    "select a.store_id, a.nx, a.ny, a.nz, case when b.ndim in (2,3) then b.nx else a.nx end score_nx, "
    "case when b.ndim in (2,3) then b.ny else a.ny end score_ny, "
    "cast(case b.ndim when 2 then 1 when 3 then b.nz else a.nz end as int) score_nz, "
    "case b.ndim when 2 then 'flat' when 3 then 'volume' else 'zero' end score_kind "
    "from catalog a join catalog b on a.store_id = b.store_id and b.array_key = 'geologic_score' "
    "where a.array_key = 'seismic' and a.ndim = 3", "catalog"))
def _(spark, d):
    return src.eligible_pairs(fx.catalog(spark, d), "seismic", "geologic_score")


@query("read_patches", sql(
    f"select example_id, count(*) samples, {q6('sum(amp::double)')} total from patch_samples group by 1", "patch_samples"))
def _(spark, d):
    path = scratch_path(spark, "patches")
    src.write_patches(fx.patches(spark, d), path, dict(size=fx.PATCH, scaling_mode="none", scaling_mean=0, scaling_std=1))
    got, p = src.read_patches(spark, path)
    held = F.filter("cube", F.isnotnull)
    return got.select("example_id", F.size(held).cast("bigint").alias("samples"), r6(
        F.aggregate(held, F.lit(0.0), lambda s, v: s + v.cast("double"))).alias("total"))


@query("write_patches", sql(
    f"select example_id, x, y, z, {q6('amp::double / 2')} amp, 'divide_by_std' scaling_mode, 2.0::double scaling_std "
    "from patch_samples where example_id < 50", "patch_samples"))
def _(spark, d):
    path = scratch_path(spark, "patches")
    meta = dict(size=fx.PATCH, scaling_mode="divide_by_std", scaling_mean=0, scaling_std=2.0)
    scaled = volumes.scale_cubes(fx.patches(spark, d), "divide_by_std", 0.0, 2.0)
    src.write_patches(scaled, path, meta, most=50, order=["example_id"])
    got, p = src.read_patches(spark, path)
    info = spark.read.parquet(f"{path}/meta")
    return volumes.patch_samples(got, p).select(
        "example_id", "x", "y", "z", r6("amp").alias("amp"),
        info.select("scaling_mode").scalar().alias("scaling_mode"),
        info.select("scaling_std").scalar().alias("scaling_std"))


@query("write_volume_chunked", sql(
    f"select volume_id, cast(x//16 as int) cx, cast(y//16 as int) cy, count(*) samples, {q6('sum(amp::double)')} total "
    "from volume_samples group by 1,2,3", S))
def _(spark, d):
    path = scratch_path(spark, "volume")
    chunks.write_volume_chunked(fx.volume_traces(spark, d), fx.volume_dims(spark, d), path)
    rows = spark.read.parquet(path).select("volume_id", "cx", "cy", F.explode("amps").alias("v"))
    return rows.groupBy("volume_id", "cx", "cy").agg(
        F.count("*").alias("samples"), r6(F.sum(F.col("v").cast("double"))).alias("total"))


@query("read_volume_chunked", sql(f"select volume_id, x, y, z, {q6('amp')} amp from volume_samples", S))
def _(spark, d):
    """Traces cut into depth chunks and put together again."""
    path = scratch_path(spark, "volume")
    chunks.write_volume_chunked(fx.volume_traces(spark, d), fx.volume_dims(spark, d), path, (16, 16, 24))
    return volumes.samples_of(chunks.read_volume_chunked(spark, path)).withColumn("amp", r6("amp"))


def _survey_table(spark, d):
    """Three volumes of unequal extent, written in two steps."""
    path = scratch_path(spark, "survey")
    traces = fx.survey_traces(spark, d)
    dims = fx.traces_dims(traces)
    chunks.write_volume_chunked(traces.filter("volume_id <> 'b'"), dims, path, (4, 4, 24))
    chunks.write_volume_chunked(traces.filter("volume_id = 'b'"), dims, path, (4, 4, 24), append=True)
    return path


@query("read_box", sql(
    f"select volume_id, x, y, z, {q6('amp')} amp from survey_samples where volume_id = 'b' and x < 5 and y >= 3 and y < 11 and z >= 10 and z < 90",
    "volume_samples survey_samples"))
def _(spark, d):
    """A box over chunks and depth parts that reaches over two edges of its volume."""
    found = chunks.read_box(spark, _survey_table(spark, d), "b", (-2, 3, 10), (5, 11, 90))
    parts = found.select("volume_id", "x", "y", "z0", F.posexplode("amps").alias("i", "amp"))
    return parts.select("volume_id", "x", "y", (F.col("z0") + F.col("i")).alias("z"), r6("amp").alias("amp"))


MOMENTS = (f"count(*) count, {q6('avg(amp::double)')} mean, {q6('stddev_pop(amp::double)')} std, "
           f"{q6('min(amp)')} min, {q6('max(amp)')} max")


@query("chunk_stats", sql(
    f"select volume_id, cast(x//4 as int) cx, cast(y//4 as int) cy, cast(z//24 as int) cz, {MOMENTS} from survey_samples group by all",
    "volume_samples survey_samples"))
def _(spark, d):
    out = chunks.chunk_stats(spark, _survey_table(spark, d))
    return out.select(*chunks.KEYS, "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("stored_volume_stats", sql(f"select volume_id, {MOMENTS} from survey_samples group by 1", "volume_samples survey_samples"))
def _(spark, d):
    out = chunks.stored_volume_stats(spark, _survey_table(spark, d))
    return out.select("volume_id", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("clip_scaled_stored", sql(
    f"select {OUT}, {q6('greatest(-lim, least(lim, amp::double)) / lim')} amp from survey_samples join p using (volume_id)",
    "volume_samples survey_samples",
    p="select volume_id, greatest(max(abs(amp::double)) * 0.3, 1e-6) lim from survey_samples group by 1"))
def _(spark, d):
    """Limits from the stored moments, samples read once."""
    path = _survey_table(spark, d)
    rows = volumes.samples_of(chunks.read_volume_chunked(spark, path))
    out = volumes.clip_scaled(rows, 0.3, ["volume_id"], ["x", "y", "z"], peaks=chunks.stored_peaks(spark, path))
    return out.select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


# ---- projections and slices ---------------------------------------------------


@query("scale_amplitude", sql(
    f"select {OUT}, {q6('amp')} raw, {q6('amp::double / greatest(abs(sd), 1e-8)')} by_std, "
    f"{q6('(amp::double - m) / greatest(abs(sd), 1e-8)')} zscore from volume_samples, s", S,
    s="select avg(amp::double) m, stddev_pop(amp::double) sd from volume_samples"))
def _(spark, d):
    rows = _samples(spark, d)
    found = stats.dataset_stats(rows).select(F.struct("mean", "std")).scalar()
    wide = rows.withColumn("s", found).withColumns({c: F.col("amp") for c in ("raw", "by_std", "zscore")})
    for column, mode in (("raw", "none"), ("by_std", "divide_by_std"), ("zscore", "zscore")):
        wide = volumes.scale_amplitude(wide, mode, F.col("s.mean"), F.col("s.std"), column)
    return wide.select("volume_id", "x", "y", "z", *[r6(c).alias(c) for c in ("raw", "by_std", "zscore")])


@query("normalize_by_std", sql(
    f"select example_id, x, y, z, {q6('amp::double / greatest(stddev_pop(amp::double) over (partition by example_id), 1e-6)')} amp "
    "from patch_samples", "patch_samples"))
def _(spark, d):
    rows = volumes.patch_samples(fx.patches(spark, d), fx.PATCH)
    return volumes.normalize_by_std(rows, ["example_id"]).select("example_id", "x", "y", "z", r6("amp").alias("amp"))


EXT = ("case when (amp > up and amp > down) or (amp < up and amp < down) then amp::double else 0 end")
EXT_STEP = ("select *, lag(amp) over (partition by volume_id, x, y order by z) up, "
            "lead(amp) over (partition by volume_id, x, y order by z) down from volume_samples")
PREP = ("select *, lag(amp) over (partition by example_id, x, y order by z) up, "
        "lead(amp) over (partition by example_id, x, y order by z) down, "
        "greatest(stddev_pop(amp::double) over (partition by example_id), 1e-6) sd from patch_samples")


@query("trace_extrema", sql(f"select {OUT}, {q6(EXT)} amp from e", S, e=EXT_STEP))
def _(spark, d):
    kept = volumes.trace_extrema(fx.volume_traces(spark, d))
    return volumes.samples_of(kept).select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


@query("preprocess", sql(f"select example_id, x, y, z, {q6('(' + EXT + ') / sd')} amp from e", "patch_samples", e=PREP))
def _(spark, d):
    ready = volumes.preprocess(fx.patches(spark, d), fx.PATCH)
    return volumes.patch_samples(ready, fx.PATCH).select("example_id", "x", "y", "z", r6("amp").alias("amp"))


# One index is out of range on purpose: it is clamped to the last plane.
SLICES = " union all ".join(
    f"select volume_id, x, y, z, '{a}' plane, amp::double amp from volume_samples join volume_dims using (volume_id) "
    f"where {a} = greatest(0, least(n{a} - 1, {k}))" for a, k in (("x", 7), ("y", 99), ("z", 30)))


@query("ortho_slices", sql(f"select {OUT}, plane, {q6('amp')} amp from s", D, s=SLICES))
def _(spark, d):
    rows = volumes.ortho_slices(fx.volume_traces(spark, d), fx.volume_dims(spark, d), 7, 99, 30)
    return rows.select("volume_id", "x", "y", "z", "plane", r6("amp").alias("amp"))


@query("composite_slices", sql(
    f"select example_id, 'inline' section, z depth, cast(n*5+x as int) across, {q6('amp::double*(n+1)')} as value from p where y = 2 "
    f"union all select example_id, 'crossline', z, cast(n*5+y as int), {q6('amp::double*(n+1)')} from p where x = 2",
    "patch_samples", p="select *, unnest([0, 1, 2]) n from patch_samples"))
def _(spark, d):
    cubes = fx.patches(spark, d).select(
        "example_id", F.col("cube").alias("input"),
        F.expr("transform(cube, v -> double(v) * 2)").alias("pred"),
        F.expr("transform(cube, v -> double(v) * 3)").alias("target"))
    return volumes.composite_slices(cubes, fx.PATCH).withColumn("value", r6("value"))


@query("mask_below", sql(
    f"select {OUT}, case when abs(amp::double) >= 0.5::double * greatest(abs(lo), abs(hi), 1e-6) then {q6('amp')} end amp from volume_samples, s", S,
    s="select quantile_cont(amp::double, 0.02) lo, quantile_cont(amp::double, 0.88) hi from volume_samples"))
def _(spark, d):
    rows, dims = _samples(spark, d), fx.volume_dims(spark, d)
    limits = stats.color_limits(rows, dims).select(F.struct("clim_low", "clim_high")).scalar()
    masked = volumes.mask_below(rows.withColumn("c", limits), 0.5, F.col("c.clim_low"), F.col("c.clim_high"))
    return masked.select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


@query("clip_scaled", sql(
    f"select {OUT}, {q6('greatest(-lim, least(lim, amp::double)) / lim')} amp from "
    "(select *, greatest(max(abs(amp::double)) over (partition by volume_id) * 0.4::double, 1e-6) lim from volume_samples)", S))
def _(spark, d):
    rows = volumes.clip_scaled(_samples(spark, d), 0.4, ["volume_id"], ["x", "y", "z"])
    return rows.select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


# ---- grids ----------------------------------------------------------------------

PAD = ", ".join(
    f"16 lo_{a}, cast(16 + (32 - (n{a} + 32) % 32) % 32 as int) hi_{a}, cast(n{a} + 32 + (32 - (n{a} + 32) % 32) % 32 as int) p{a}"
    for a in "xyz")
PADDED = f"select volume_id, nx, ny, nz, {PAD} from volume_dims union all select 'c' || store_id || array_key, nx, ny, nz, {PAD} from catalog"


@query("axis_padding", sql("select * from p", "volume_dims catalog", p=PADDED))
def _(spark, d):
    more = fx.catalog(spark, d).select(
        F.concat(F.lit("c"), "store_id", "array_key").alias("volume_id"), "nx", "ny", "nz")
    return grid.axis_padding(fx.volume_dims(spark, d).unionByName(more), 32)


@query("pad", sql(f"select volume_id, x + 16 x, y + 16 y, z + 16 z, {q6('amp')} amp from volume_samples", S))
def _(spark, d):
    return grid.pad(_samples(spark, d)).withColumn("amp", r6("amp"))


@query("pad_dense", sql(
    f"select g.volume_id, g.x, g.y, g.z, {q6('coalesce(amp, 0)')} amp from g left join volume_samples s "
    "on s.volume_id = g.volume_id and s.x + 2 = g.x and s.y + 2 = g.y and s.z + 2 = g.z", D,
    p="select volume_id, nx+4+(5-(nx+4)%5)%5 px, ny+4+(5-(ny+4)%5)%5 py, nz+4+(16-(nz+4)%16)%16 pz from volume_dims",
    a="select *, unnest(range(px)) x from p", b="select *, unnest(range(py)) y from a",
    g="select volume_id, cast(x as int) x, cast(y as int) y, cast(unnest(range(pz)) as int) z from b"))
def _(spark, d):
    padded = grid.pad_dense(fx.volume_traces(spark, d), fx.volume_dims(spark, d), fx.PATCH, 2)
    return volumes.samples_of(padded).withColumn("amp", r6("amp"))


@query("unpad", sql(f"select {OUT}, {q6('amp')} amp from volume_samples", S))
def _(spark, d):
    dims = fx.volume_dims(spark, d)
    traces = fx.volume_traces(spark, d)
    padded = volumes.samples_of(grid.pad_dense(traces, dims, fx.PATCH, 2))
    kept = grid.without_holes(grid.unpad(padded, dims, 2), traces, dims)
    return kept.select("volume_id", "x", "y", "z", r6("amp").alias("amp"))


GRID = dict(
    p="select volume_id, nx+32+(32-(nx+32)%32)%32 px, ny+32+(32-(ny+32)%32)%32 py, nz+32+(32-(nz+32)%32)%32 pz from volume_dims",
    ga="select *, unnest(range(0, px-31, 16)) wx from p", gb="select *, unnest(range(0, py-31, 16)) wy from ga",
    g="select volume_id, cast(wx as int) wx, cast(wy as int) wy, cast(unnest(range(0, pz-31, 16)) as int) wz from gb")


@query("window_grid", sql("select * from g", D, **GRID))
def _(spark, d):
    padded = grid.padded_dims(fx.volume_dims(spark, d), 32)
    return grid.window_grid(padded, 32, 16, ("px", "py", "pz"))


@query("window_count", sql(
    "select volume_id, count(*) windows from g group by 1 union all "
    "select 'unpadded', (nx//5) * (ny//5) * ((nz-14)//5+1) from volume_dims", D, **GRID))
def _(spark, d):
    dims = fx.volume_dims(spark, d)
    # The definition counts the windows that fit; the guard wants an axis that ends with one.
    fit = {f"n{a}": F.expr(f"n{a} - (n{a} - {n}) % 5") for a, n in (("x", 5), ("y", 5), ("z", 14))}
    plain = dims.withColumns({"volume_id": F.lit("unpadded"), **fit})
    return grid.window_count(dims, 32, 16, 16).unionByName(grid.window_count(plain, (5, 5, 14), 5))


@query("assign_windows", sql(
    f"select s.volume_id, wx, wy, wz, x, y, z, {q6('amp')} amp from volume_samples s join w on s.volume_id = w.volume_id "
    "and x >= wx and x < wx + 10 and y >= wy and y < wy + 10 and z >= wz and z < wz + 14", D,
    wa="select *, unnest(range(0, nx-9, 5)) wx from volume_dims", wb="select *, unnest(range(0, ny-9, 5)) wy from wa",
    w="select volume_id, cast(wx as int) wx, cast(wy as int) wy, cast(unnest(range(0, nz-13, 5)) as int) wz from wb"))
def _(spark, d):
    return grid.assign_windows(_samples(spark, d), fx.volume_dims(spark, d), (10, 10, 14), 5).withColumn("amp", r6("amp"))


CENTERS = "select volume_id, cast(x as int) cx, cast(y as int) cy, cast((x*7 + y*3) % nz as int) cz, cast(x*1000 + y as int) center_id from volume_samples join volume_dims using (volume_id) where z = 0"


@query("extract_centered", sql(
    f"select c.center_id, count(s.amp) inside, {q6('coalesce(sum(amp::double), 0)')} total, "
    f"{q6('coalesce(sum(amp::double * ((x-cx+2)*100 + (y-cy+2)*10 + (z-cz+4))), 0)')} checksum "
    "from c left join volume_samples s on s.volume_id = c.volume_id and x >= cx-2 and x < cx+2 and y >= cy-2 and y < cy+2 "
    "and z >= cz-4 and z < cz+4 group by 1", D, c=CENTERS))
def _(spark, d):
    dims = fx.volume_dims(spark, d)
    traces = fx.volume_traces(spark, d)
    centers = traces.withColumn("nz", dims.select("nz").scalar()).select(
        "volume_id", F.col("x").alias("cx"), F.col("y").alias("cy"),
        ((F.col("x") * 7 + F.col("y") * 3) % F.col("nz")).cast("int").alias("cz"),
        (F.col("x") * 1000 + F.col("y")).cast("int").alias("center_id"))
    cubes = grid.extract_centered(traces, centers, (4, 4, 8), fill=None)
    return cubes.select(
        "center_id", F.expr("cast(size(filter(cube, v -> v is not null)) as bigint)").alias("inside"),
        r6(F.expr("aggregate(cube, 0D, (s, v) -> s + coalesce(double(v), 0D))")).alias("total"),
        r6(F.expr("aggregate(transform(cube, (v, i) -> coalesce(double(v), 0D) * ((i div 32) * 100 + ((i div 8) % 4) * 10 + i % 8)), 0D, (s, v) -> s + v)")).alias("checksum"))


@query("extract_boxes", sql(
    f"select b.center_id, cast(x-bx as int) x, cast(y-by_ as int) y, cast(z-bz as int) z, {q6('amp')} amp from b join volume_samples s "
    "on s.volume_id = b.volume_id and x >= bx and x < bx+5 and y >= by_ and y < by_+5 and z >= bz and z < bz+16", D,
    b="select volume_id, x bx, y by_, (x+y)%60 bz, cast(x*1000+y as int) center_id from volume_samples join volume_dims using (volume_id) "
      "where z = 0 and x+5 <= nx and y+5 <= ny and (x+y)%60+16 <= nz"))
def _(spark, d):
    traces = fx.volume_traces(spark, d)
    boxes = traces.select(
        "volume_id", F.col("x").alias("bx"), F.col("y").alias("by"), ((F.col("x") + F.col("y")) % 60).alias("bz"),
        (F.col("x") * 1000 + F.col("y")).cast("int").alias("center_id"))
    cubes = grid.extract_boxes(traces, boxes, fx.volume_dims(spark, d), fx.PATCH, ["center_id"])
    flat = volumes.patch_samples(cubes.withColumnRenamed("center_id", "example_id"), fx.PATCH)
    return flat.select(F.col("example_id").alias("center_id"), "x", "y", "z", r6("amp").alias("amp"))


@query("chunk_of", sql(
    f"select volume_id, cast(x//16 as int) cx, cast(y//16 as int) cy, cast(z//24 as int) cz, count(*) samples, "
    f"max(x)-min(x)+1 size_x, max(y)-min(y)+1 size_y, max(z)-min(z)+1 size_z, {q6('sum(amp::double)')} total "
    "from volume_samples group by 1,2,3,4", S))
def _(spark, d):
    tagged = grid.chunk_of(_samples(spark, d), fx.volume_dims(spark, d), (16, 16, 24))
    size = [(F.max(a) - F.min(a) + 1).alias(f"size_{a}") for a in "xyz"]
    return tagged.groupBy("volume_id", "cx", "cy", "cz").agg(
        F.count("*").alias("samples"), *size, r6(F.sum(F.col("amp").cast("double"))).alias("total"))


# ---- statistics -----------------------------------------------------------------


@query("volume_stats", sql(
    f"select volume_id, count(*) count, {q6('avg(amp::double)')} mean, {q6('stddev_pop(amp::double)')} std, "
    f"{q6('min(amp)')} min, {q6('max(amp)')} max from label_samples group by 1", "label_samples"))
def _(spark, d):
    out = stats.volume_stats(fx.label_samples(spark, d))
    return out.select("volume_id", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


DATASET = f"select count(*)::bigint count, {q6('avg(amp::double)')} mean, {q6('stddev_pop(amp::double)')} std from label_samples"


@query("dataset_stats", sql(DATASET, "label_samples"))
def _(spark, d):
    return stats.dataset_stats(fx.label_samples(spark, d)).select("count", r6("mean").alias("mean"), r6("std").alias("std"))


@query("merge_stats", sql(DATASET, "label_samples"))
def _(spark, d):
    merged = stats.merge_stats(stats.volume_stats(fx.label_samples(spark, d)))
    return merged.select("count", r6("mean").alias("mean"), r6("std").alias("std"))


@query("color_limits", sql(
    f"select volume_id, {q6('lo')} p_low, {q6('hi')} p_high, {q6('-greatest(abs(lo), abs(hi), 1e-6)')} clim_low, "
    f"{q6('greatest(abs(lo), abs(hi), 1e-6)')} clim_high from "
    "(select volume_id, quantile_cont(amp::double, 0.02) lo, quantile_cont(amp::double, 0.88) hi from label_samples group by 1)", "label_samples"))
def _(spark, d):
    rows = fx.label_samples(spark, d)
    out = stats.color_limits(rows, rows.select("volume_id").distinct())
    return out.select("volume_id", *[r6(c).alias(c) for c in ("p_low", "p_high", "clim_low", "clim_high")])


MIRROR = SLICES.replace("volume_samples join", "(select 'v0' volume_id, x, y, z, amp from volume_samples_mirror) join")


@query("overlay_preview", sql(
    f"select volume_id, {q6('avg(v)')} preview_mean, {q6('stddev_pop(v)')} preview_std from (select a.volume_id, "
    "0.7::double * a.c + 0.3::double * case when abs(b.c) >= 0.2::double then b.c else 0 end v from ca a join cb b using (volume_id, plane, x, y, z)) group by 1",
    "volume_samples volume_dims volume_samples_mirror", a=SLICES, b=MIRROR,
    ca="select *, greatest(-l, least(l, amp)) / l c from (select *, greatest(max(abs(amp)) over (partition by plane) * 0.5::double, 1e-6) l from a)",
    cb="select *, greatest(-l, least(l, amp)) / l c from (select *, greatest(max(abs(amp)) over (partition by plane) * 0.8::double, 1e-6) l from b)"))
def _(spark, d):
    over = fx.mirror_traces(spark, d).withColumn("volume_id", F.when(F.col("x") >= 0, "v0"))
    out = stats.overlay_preview(fx.volume_traces(spark, d), over, fx.volume_dims(spark, d), 7, 99, 30, 0.3, 0.5, 0.8, 0.2)
    return out.select("volume_id", r6("preview_mean").alias("preview_mean"), r6("preview_std").alias("preview_std"))


@query("latent_percentiles", sql(
    "select example_id, " + ", ".join(q6(f"quantile_cont(v, {p / 100})") + f" p{p}" for p in (5, 20, 50, 80, 95)) +
    " from (select example_id, unnest(mu)::double v from latent_params) group by 1", "latent_params"))
def _(spark, d):
    out = stats.latent_percentiles(fx.latent_params(spark, d).select("example_id", "mu"), "mu")
    return out.select("example_id", *[r6(f"p{p}").alias(f"p{p}") for p in (5, 20, 50, 80, 95)])


@query("nonzero_count", sql(
    f"select example_id, count(*) filter (where ({EXT}) <> 0) non_zero from e group by 1", "patch_samples", e=PREP))
def _(spark, d):
    ready = volumes.preprocess(fx.patches(spark, d), fx.PATCH)
    return stats.nonzero_count(volumes.patch_samples(ready, fx.PATCH), ["example_id"])
