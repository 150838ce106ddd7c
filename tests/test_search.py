"""Search, grids and blending on small volumes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions.arrays import cosine, dot
from voxelloom.operators import grid, latents, similarity, volumes
from voxelloom.plans.search import search_volume
from voxelloom.schema import PatchShape
from voxelloom.sources.chunks import read_volume_chunked, write_volume_chunked
from voxelloom.sources.volumes import read_volume, search_report


def trace_table(spark, arr, name="v"):
    rows = [(name, x, y, arr[x, y].astype(float).tolist()) for x in range(arr.shape[0]) for y in range(arr.shape[1])]
    return spark.createDataFrame(rows, "volume_id string, x int, y int, amps array<float>")


def dims_table(spark, shape, name="v"):
    return spark.createDataFrame([(name, *shape)], "volume_id string, nx int, ny int, nz int")


def dense(df, shape, column="sim"):
    out = np.full(shape, np.nan)
    p = df.toPandas()
    out[p.x, p.y, p.z] = p[column]
    return out


def prepared(c):
    out = np.zeros(c.shape)
    m, a, b = c[:, :, 1:-1], c[:, :, :-2], c[:, :, 2:]
    peak = ((m > a) & (m > b)) | ((m < a) & (m < b))
    out[:, :, 1:-1][peak] = m[peak]
    return out / max(float(c.astype(np.float64).std()), 1e-6)


def pooled(c):
    return prepared(c).reshape(8, 4, 8, 4, 2, 16).mean(axis=(1, 3, 5)).ravel()


def brute_search(source, target, center, mode, size, stride, encode, base=16):
    """The search by its definition, on dense arrays."""
    p = PatchShape.of(size).axes
    wide = np.pad(source, [(n, n) for n in p])
    token = encode(wide[tuple(slice(c - n // 2 + n, c - n // 2 + 2 * n) for c, n in zip(center, p))])
    pads = [(base, base + (-(n + 2 * base)) % s) for n, s in zip(target.shape, p)]
    vol = np.pad(target, pads)
    axes = [np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) for n in p]
    taper = axes[0][:, None, None] * axes[1][None, :, None] * axes[2]
    top, weight = np.zeros(vol.shape), np.zeros(vol.shape)
    for i in range(0, vol.shape[0] - p[0] + 1, stride):
        for j in range(0, vol.shape[1] - p[1] + 1, stride):
            for k in range(0, vol.shape[2] - p[2] + 1, stride):
                at = np.s_[i:i + p[0], j:j + p[1], k:k + p[2]]
                v = encode(vol[at])
                norm = np.linalg.norm(v) * np.linalg.norm(token)
                sim = v @ token if mode == "dot" else (0 if norm < 1e-8 else v @ token / norm)
                top[at] += sim * taper
                weight[at] += taper
    return (top / np.clip(weight, 1e-8, None))[tuple(slice(lo, lo + n) for (lo, _), n in zip(pads, target.shape))]


@pytest.mark.parametrize("a, b, want", [((1, 0, 0), (1, 0, 0), 1), ((1, 0, 0), (-1, 0, 0), -1), ((1, 0, 0), (0, 0, 0), 0)])
def test_cosine_of_known_vectors(spark, a, b, want):
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<float>, b array<float>")
    assert df.select(cosine("a", "b")).first()[0] == pytest.approx(want)
    assert df.select(dot("a", "b")).first()[0] == pytest.approx(float(np.dot(a, b)))


def test_unknown_similarity_mode(spark):
    from voxelloom.functions.arrays import similarity as sim

    with pytest.raises(ValueError):
        sim("a", "b", "euclid")


def test_pooled_search_equals_definition(spark):
    rng = np.random.default_rng(3)
    source, target = rng.normal(size=(20, 18, 40)).astype("f4"), rng.normal(size=(21, 35, 50)).astype("f4")
    got = search_volume(
        trace_table(spark, source, "s"), dims_table(spark, source.shape, "s"),
        trace_table(spark, target), dims_table(spark, target.shape), "s")
    want = brute_search(source, target, [n // 2 for n in source.shape], "cosine", 32, 16, pooled)
    np.testing.assert_allclose(dense(got, target.shape), want, atol=1e-9)


def test_regression_pair_is_repeatable(spark):
    base = np.arange(7 * 9 * 13, dtype="f4").reshape(7, 9, 13)
    args = (trace_table(spark, base, "s"), dims_table(spark, base.shape, "s"), trace_table(spark, base[::-1]),
            dims_table(spark, base.shape), "s")
    one, two = (dense(search_volume(*args, center=(3, 4, 6)), base.shape) for _ in range(2))
    np.testing.assert_array_equal(one, two)
    np.testing.assert_allclose(one, brute_search(base, base[::-1], (3, 4, 6), "cosine", 32, 16, pooled), atol=1e-9)


def test_constant_volume_scores_zero(spark):
    ones = np.ones((7, 9, 13), dtype="f4")
    got = search_volume(
        trace_table(spark, ones, "s"), dims_table(spark, ones.shape, "s"), trace_table(spark, ones),
        dims_table(spark, ones.shape), "s", mode="dot")
    assert dense(got, ones.shape).shape == (7, 9, 13)
    assert np.isfinite(dense(got, ones.shape)).all()


def test_missing_traces_still_give_the_whole_map(spark):
    rng = np.random.default_rng(4)
    target = rng.normal(size=(70, 8, 20)).astype("f4")
    target[16:56] = 0
    traces = trace_table(spark, target).filter("x < 16 or x >= 56")
    source = rng.normal(size=(32, 32, 32)).astype("f4")
    got = search_volume(trace_table(spark, source, "s"), dims_table(spark, source.shape, "s"), traces, dims_table(spark, target.shape), "s")
    want = brute_search(source, target, (16, 16, 16), "cosine", 32, 16, pooled)
    np.testing.assert_allclose(dense(got, target.shape), want, atol=1e-9)


def test_encoder_search_equals_definition(spark):
    rng = np.random.default_rng(5)
    source, target = rng.normal(size=(9, 9, 12)).astype("f4"), rng.normal(size=(13, 7, 20)).astype("f4")
    weights = rng.normal(size=(4 * 4 * 8, 3))

    def make():
        return lambda cubes: cubes.reshape(len(cubes), -1) @ weights

    got = search_volume(
        trace_table(spark, source, "s"), dims_table(spark, source.shape, "s"), trace_table(spark, target),
        dims_table(spark, target.shape), "s", size=(4, 4, 8), stride=2, base=4, make_encoder=make, batch_size=7)
    want = brute_search(source, target, [n // 2 for n in source.shape], "cosine", (4, 4, 8), 2, lambda c: prepared(c).ravel() @ weights, 4)
    np.testing.assert_allclose(dense(got, target.shape), want, atol=1e-6)


@pytest.mark.parametrize("mode, want", [("cosine", 1.0), ("dot", 2.0)])
def test_single_sample_windows(spark, mode, want):
    lat = spark.createDataFrame([("v", i, j, k, [1.0]) for i in range(2) for j in range(2) for k in range(2)],
                                "volume_id string, wx int, wy int, wz int, latent array<double>")
    token = spark.createDataFrame([([2.0],)], "latent array<double>")
    got = similarity.overlap_add(similarity.score_latents(lat, token, mode), dims_table(spark, (2, 2, 2)), 1, 1)
    np.testing.assert_allclose(dense(got, (2, 2, 2)), want)


@pytest.mark.parametrize("size, stride", [((4, 4, 8), 2), ((5, 5, 5), 2), ((6, 6, 6), 4)])
def test_overlap_add_equals_definition(spark, size, stride):
    shape, rng = (13, 9, 17), np.random.default_rng(1)
    shape = tuple(n - (n - s) % stride for n, s in zip(shape, size))
    dims = dims_table(spark, shape)
    starts = [tuple(r) [1:] for r in grid.window_grid(dims, size, stride).collect()]
    sims = rng.normal(size=len(starts))
    scores = spark.createDataFrame([("v", *map(int, s), float(v)) for s, v in zip(starts, sims)], "volume_id string, wx int, wy int, wz int, sim double")
    axes = [0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) for n in size]
    taper = axes[0][:, None, None] * axes[1][None, :, None] * axes[2]
    top, weight = np.zeros(shape), np.zeros(shape)
    for s, v in zip(starts, sims):
        at = tuple(slice(a, a + n) for a, n in zip(s, size))
        top[at] += v * taper
        weight[at] += taper
    got = similarity.overlap_add(scores, dims, size, stride)
    np.testing.assert_allclose(dense(got, shape), top / np.clip(weight, 1e-8, None), atol=1e-12)


def test_hann_sum_is_constant_in_the_core(spark):
    dims = dims_table(spark, (64, 64, 64))
    scores = grid.window_grid(dims, 32, 16).withColumn("sim", F.lit(1.0))
    sums = similarity.block_sums(scores, 32, 16)
    got = similarity.expand_blocks(sums, dims, 32, 16, eps=1.0).filter(
        "x between 16 and 47 and y between 16 and 47 and z between 16 and 47")
    lo, hi = got.agg(F.min("sim"), F.max("sim")).first()
    assert lo == pytest.approx(1.0) and hi == pytest.approx(1.0)


def test_padding_and_window_counts(spark):
    dims = spark.createDataFrame([("a", 95, 64, 101), ("b", 96, 96, 96), ("c", 64, 64, 64)], "volume_id string, nx int, ny int, nz int")
    for r in grid.axis_padding(dims, 32).collect():
        assert (r.lo_x, r.lo_y, r.lo_z) == (16, 16, 16)
        assert r.px % 32 == r.py % 32 == r.pz % 32 == 0 and r.px == r.nx + r.lo_x + r.hi_x
    assert grid.window_count(dims.filter("volume_id = 'b'"), 32, 16).first().windows == 125
    assert grid.window_count(dims.filter("volume_id = 'c'"), 32, 16, 16).first().windows == 125


@pytest.mark.parametrize("shape", [(8, 32, 32), (33, 32, 32)])
def test_grid_rejects_bad_axes(spark, shape):
    with pytest.raises(Exception, match="axis"):
        grid.window_grid(dims_table(spark, shape), 32, 16).collect()


def test_corner_cube_is_zero_filled(spark):
    ones = trace_table(spark, np.ones((3, 3, 3)))
    centers = spark.createDataFrame([(1, "v", 0, 0, 0), (2, "v", 50, 0, 0)], "center_id int, volume_id string, cx int, cy int, cz int")
    cubes = {r.center_id: np.array(r.cube) for r in grid.extract_centered(ones, centers, 4).collect()}
    assert cubes[1].sum() == 8 and (cubes[1] != 0).sum() == 8 and cubes[1].size == 64
    assert cubes[2].sum() == 0 and cubes[2].size == 64


def test_boxes_outside_are_dropped(spark):
    ones = trace_table(spark, np.ones((6, 6, 6)))
    boxes = spark.createDataFrame([(1, "v", 0, 0, 0), (2, "v", 3, 0, 0), (3, "v", 2, 2, 2)], "box int, volume_id string, bx int, by int, bz int")
    got = grid.extract_boxes(ones, boxes, dims_table(spark, (6, 6, 6)), 4, ["box"])
    assert sorted(r.box for r in got.collect()) == [1, 3]


def test_chunks(spark, tmp_path):
    assert grid.chunk_extent((16, 16, -1)) == [16, 16, None]
    for bad in ((0, 16, 16), (16, -2, 16)):
        with pytest.raises(ValueError):
            grid.chunk_extent(bad)
    vol = np.arange(20 * 5 * 10, dtype="f4").reshape(20, 5, 10)
    write_volume_chunked(trace_table(spark, vol), dims_table(spark, vol.shape), str(tmp_path / "v"), (16, 16, 4))
    back = read_volume_chunked(spark, str(tmp_path / "v"))
    assert back.columns == ["volume_id", "x", "y", "amps"]
    flat = back.select("x", "y", F.posexplode("amps").alias("z", "sim"))
    np.testing.assert_array_equal(dense(flat, vol.shape), vol)
    other = spark.createDataFrame([("other", 1, 1, 1)], "volume_id string, nx int, ny int, nz int")
    with pytest.raises(Exception, match="no catalog row"):
        write_volume_chunked(trace_table(spark, vol), other, str(tmp_path / "lost"), (-1, 16, 16))
    # Fixed chunks need no catalog, so nothing is lost.
    write_volume_chunked(trace_table(spark, vol), other, str(tmp_path / "kept"))
    assert read_volume_chunked(spark, str(tmp_path / "kept")).count() == 100


def test_nan_is_no_extremum_and_its_windows_score_zero(spark):
    rows = [("v", 0, 0, [1.0, float("nan"), 1.0]), ("v", 0, 1, [3.0, 1.0, float("nan"), 5.0]), ("v", 0, 2, [0.0, 2.0, 1.0, 3.0, 0.0])]
    df = spark.createDataFrame(rows, "volume_id string, x int, y int, amps array<float>")
    got = {r.y: r.amps for r in volumes.trace_extrema(df).collect()}
    assert got == {0: [0.0] * 3, 1: [0.0] * 4, 2: [0.0, 2.0, 1.0, 3.0, 0.0]}
    cube = spark.createDataFrame([(0, [1.0, float("nan"), 1.0, 2.0])], "example_id long, cube array<float>")
    assert volumes.preprocess(cube, (1, 1, 4)).first().cube == [0.0] * 4
    vol = np.random.default_rng(1).normal(size=(32, 32, 32)).astype("f4")
    vol[3, 3, 3] = np.nan
    got = {tuple(r[1:4]): r.latent for r in latents.windows_pooled(trace_table(spark, vol), dims_table(spark, vol.shape)).collect()}
    assert not any(np.isnan(v).any() for v in got.values())
    assert set(got[16, 16, 16]) == {0.0} and set(got[32, 32, 32]) != {0.0}
    assert not np.isnan(latents.prepared(vol, 1e-6)).any()


def test_encoders_see_single_precision():
    seen = []
    latents.encode_batches(np.ones((3, 2)), lambda b: seen.append(b.dtype) or b, 2)
    assert set(seen) == {np.dtype("float32")}


def test_report_has_the_shape_of_its_source(spark):
    dims = spark.createDataFrame([("other", 9, 9, 9), ("wanted", 2, 3, 4)], "volume_id string, nx int, ny int, nz int")
    found = spark.createDataFrame([("wanted", 1, 2, 3, 0.5)], "volume_id string, x int, y int, z int, sim double")
    count = spark.createDataFrame([("wanted", 8)], "volume_id string, windows long")
    padded = dims.selectExpr("volume_id", "nx px", "ny py", "nz pz")
    report = search_report(found, count, dims, dims, padded, 1.0, 2, 2, "cosine", "pooled", source_id="wanted").first()
    assert report.source_shape == [2, 3, 4]


def test_two_arrays_of_a_store_are_an_error(spark):
    catalog = spark.createDataFrame([(1, "data", "a"), (1, "data", "b")], "store_id int, array_key string, volume_id string")
    traces = spark.createDataFrame([], "volume_id string, x int, y int, amps array<float>")
    with pytest.raises(ValueError, match="several"):
        read_volume(catalog, traces, 1, "data")


def test_shape_guard(spark):
    good = spark.createDataFrame([("v", x, 0, 0, 1.0) for x in range(3)], "volume_id string, x int, y int, z int, sim double")
    assert similarity.shape_guard(good, dims_table(spark, (3, 1, 1))).first().samples == 3
    with pytest.raises(Exception, match="shape mismatch"):
        similarity.shape_guard(good, dims_table(spark, (4, 1, 1))).collect()


def test_patch_shape():
    assert PatchShape.of(4).axes == (4, 4, 4)
    assert PatchShape.of([3]).axes == (3, 3, 3)
    assert PatchShape.of((1, 2, 3)).axes == (1, 2, 3)
    for bad in ((1, 2), 0, (1, -1, 1)):
        with pytest.raises(ValueError):
            PatchShape.of(bad)
    with pytest.raises(ValueError):
        PatchShape.of(32).check_stride(5)
    with pytest.raises(ValueError):
        PatchShape.of(12).require_multiple_of(8)


def test_batch_is_halved_on_memory_errors():
    sizes = []

    def encode(b):
        sizes.append(len(b))
        if len(b) > 2:
            raise RuntimeError("CUDA error: out of memory")
        return b.sum(axis=1, keepdims=True)

    items = np.arange(12.0).reshape(6, 2)
    np.testing.assert_array_equal(latents.encode_batches(items, encode, 6), items.sum(axis=1, keepdims=True))
    assert max(sizes[1:]) <= 3 and sizes[-1] <= 2

    def broken(b):
        raise RuntimeError("something else")

    with pytest.raises(RuntimeError, match="else"):
        latents.encode_batches(items, broken, 6)


def test_traces_and_samples_round_trip(spark):
    vol = np.random.default_rng(0).normal(size=(3, 4, 5)).astype("f4")
    back = volumes.traces_of(volumes.samples_of(trace_table(spark, vol)))
    for r in back.collect():
        np.testing.assert_array_equal(np.array(r.amps, dtype="f4"), vol[r.x, r.y])


def test_encoder_is_built_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "builds")

    def make():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda b: b.reshape(len(b), -1)[:, :2]

    vol = np.random.default_rng(2).normal(size=(24, 24, 24)).astype("f4")
    out = latents.windows_encoded(trace_table(spark, vol), dims_table(spark, vol.shape), 4, 4, make, tile=2)
    assert out.count() > 500
    built = open(log).read().split()
    assert len(built) == len(set(built))
