"""Augmentations: exact counts, invariants, determinism, and numpy definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import augment as ag
from voxelloom.operators import scoring, volumes
from voxelloom.sources.volumes import append_run_metrics, read_patches, write_patches


def cubes(spark, arrays, label=False):
    rows = [(i, np.asarray(a, dtype=float).ravel().tolist()) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, "example_id bigint, cube array<float>")
    return df.withColumn("label", F.col("cube").cast("array<double>")) if label else df


def ramp(*shape):
    return np.arange(1, 1 + np.prod(shape), dtype="f4").reshape(shape)


def arrays(df, shape, column="cube"):
    return {r.example_id: np.array(r[column], dtype=float).reshape(shape) for r in df.collect()}


@pytest.mark.parametrize("fraction", [0.25, 1.0, 0.01])
def test_poisson_keeps_the_exact_count(spark, fraction):
    df = cubes(spark, [ramp(8, 8, 8)] * 3)
    out = arrays(ag.sparse_keep(df, 8, "poisson", F.lit(fraction), seed=1), (8, 8, 8))
    for a in out.values():
        assert np.count_nonzero(a) == np.clip(np.rint(fraction * 512), 1, 512)
        assert set(a[a != 0]) <= set(ramp(8, 8, 8).ravel())


def test_spread_points_keep_their_distance_before_the_fill():
    for seed in range(5):
        mask = ag.spread_points((12, 12, 12), 20, 0.85, np.random.default_rng(seed).random(12**3)).reshape(12, 12, 12)
        pts = np.argwhere(mask)
        gaps = ((pts[:, None] - pts[None]) ** 2).sum(-1)[np.triu_indices(len(pts), 1)]
        assert len(pts) == 20
        # Few points fit easily, so none came from the random fill.
        assert gaps.min() >= (0.85 * np.cbrt(12**3 / 20)) ** 2


@pytest.mark.parametrize("shape,fraction", [((6, 5, 7), 0.3), ((32, 32, 8), 0.05), ((3, 1, 9), 0.5)])
def test_spread_points_equal_one_by_one_visits(shape, fraction):
    visit = np.random.default_rng(8).random(int(np.prod(shape)))
    target = max(1, int(fraction * len(visit)))
    radius = 0.85 * np.cbrt(len(visit) / target)
    at = np.stack(np.unravel_index(np.arange(len(visit)), shape), -1)
    order = np.argsort(visit)
    kept = []
    for i in order:
        if not kept or ((at[kept] - at[i]) ** 2).sum(axis=1).min() >= radius * radius:
            kept.append(i)
    kept = (kept + [i for i in order if i not in set(kept)])[:target]
    assert np.flatnonzero(ag.spread_points(shape, target, 0.85, visit)).tolist() == sorted(kept)


def test_uniform_keeps_all_at_fraction_one(spark):
    out = arrays(ag.sparse_keep(cubes(spark, [ramp(6, 6, 6)]), 6, "uniform", F.lit(1.0)), (6, 6, 6))
    np.testing.assert_array_equal(out[0], ramp(6, 6, 6))


def test_unknown_sparse_method(spark):
    with pytest.raises(ValueError):
        ag.sparse_keep(cubes(spark, [ramp(2, 2, 2)]), 2, "grid")


def numpy_decimate(x, p):
    for axis in (2, 1, 0):
        n = x.shape[axis]
        idx = np.arange(p, n, 2) if p < n else np.array([0])
        kept = np.take(x, idx, axis)
        x = np.apply_along_axis(lambda v, i=idx, m=n: np.interp(np.arange(m), i, v), axis, kept)
    return x


@pytest.mark.parametrize("shape", [(8, 8, 8), (7, 7, 7), (1, 2, 3)])
@pytest.mark.parametrize("parity", [0, 1])
def test_decimate_equals_interpolation(spark, shape, parity):
    x = np.random.default_rng(0).normal(size=shape).astype("f4")
    out = arrays(ag.decimate_trilinear(cubes(spark, [x]), shape, parity), shape)[0]
    np.testing.assert_allclose(out, numpy_decimate(x.astype(float), parity), atol=1e-12)


def test_swap_flip_equals_numpy(spark):
    x = ramp(4, 4, 3)
    df = cubes(spark, [x] * 40, label=True)
    out = ag.swap_flip(df, (4, 4, 3), seed=3)
    got, lab = arrays(out, x.shape), arrays(out, x.shape, "label")
    seen = set()
    for i, a in got.items():
        np.testing.assert_array_equal(a, lab[i])
        fits = []
        for s in (0, 1):
            for fx in (0, 1):
                for fy in (0, 1):
                    y = np.swapaxes(x, 0, 1) if s else x
                    y = y[::-1] if fx else y
                    y = y[:, ::-1] if fy else y
                    if np.array_equal(a, y):
                        fits.append((s, fx, fy))
        assert len(fits) == 1
        seen.add(fits[0])
    assert len(seen) == 8
    with pytest.raises(ValueError):
        ag.swap_flip(df, (2, 6, 4))


@pytest.mark.parametrize("nz", [2, 3, 8, 31, 32, 64])
def test_warp_indices_keep_their_bounds(spark, nz):
    df = spark.range(64).withColumnRenamed("id", "example_id")
    rows = ag.warp_indices(df, nz, 5).toPandas()
    for _, g in rows.groupby("example_id"):
        at = g.sort_values("z").position.values
        steps = np.diff(at)
        assert at[0] == pytest.approx(0) and at[-1] == pytest.approx(nz - 1)
        assert steps.min() >= 0.5 - 1e-9 and steps.max() <= 2 + 1e-9 and steps.mean() == pytest.approx(1)


def test_warp_resamples_at_those_indices(spark):
    x = np.random.default_rng(1).normal(size=(3, 2, 32)).astype("f4")
    df = cubes(spark, [x] * 6, label=True)
    out = arrays(ag.warp_depth(df, (3, 2, 32), 1.0, 5), x.shape)
    at = ag.warp_indices(df, 32, 5).toPandas()
    for i, a in out.items():
        pos = at[at.example_id == i].sort_values("z").position.values
        want = np.apply_along_axis(lambda v, p=pos: np.interp(p, np.arange(32), v), 2, x.astype(float))
        np.testing.assert_allclose(a, want, atol=1e-9)
    same = arrays(ag.warp_depth(df, (3, 2, 32), 0.0, 5), x.shape)
    np.testing.assert_array_equal(same[0], x)


def test_dropout_zeroes_whole_clusters(spark):
    df = cubes(spark, [ramp(8, 9, 4)] * 10)
    for a in arrays(ag.trace_dropout(df, (8, 9, 4), 2, 3, 7), (8, 9, 4)).values():
        gone = (a == 0).all(axis=2)
        assert ((a == 0).any(axis=2) == gone).all() and 9 <= gone.sum() <= 27
    assert arrays(ag.trace_dropout(df, (8, 9, 4), 0, 0), (8, 9, 4))[0].min() == 1
    tiny = cubes(spark, [ramp(2, 9, 4)])
    np.testing.assert_array_equal(arrays(ag.trace_dropout(tiny, (2, 9, 4), 1, 1), (2, 9, 4))[0], ramp(2, 9, 4))


def test_extrema_of_plateaus_and_short_traces(spark):
    df = cubes(spark, [[[[1, 3, 3, 1, 5, 2, 2, 0, 1]]]])
    out = arrays(df.withColumn("cube", volumes.cube_extrema("cube", 9)), (9,))[0]
    np.testing.assert_array_equal(out, [0, 0, 0, 1, 5, 0, 0, 0, 0])
    short = cubes(spark, [[[[1, 2]]]])
    assert arrays(short.withColumn("cube", volumes.cube_extrema("cube", 2)), (2,))[0].sum() == 0


def test_exactly_one_transform_per_example(spark):
    x = np.random.default_rng(2).normal(size=(4, 4, 6)).astype("f4")
    df = cubes(spark, [x] * 60)
    rows = ag.one_of_three(df, (4, 4, 6), 0.4, 0.3, 0.3, F.lit(0.25), seed=2).collect()
    ext = arrays(df.withColumn("cube", volumes.cube_extrema("cube", 6)), x.shape)[0]
    options = {0: [ext], 2: [numpy_decimate(x.astype(float), p) for p in (0, 1)]}
    assert {r.choice for r in rows} == {0, 1, 2}
    for r in rows:
        a = np.array(r.cube).reshape(x.shape)
        if r.choice == 1:
            assert ((a == 0) | (a == x.astype(float))).all() and 0 < np.count_nonzero(a) < a.size
        else:
            assert any(np.allclose(a, o) for o in options[r.choice])
    with pytest.raises(ValueError):
        ag.one_of_three(df, (4, 4, 6), 0.0, 0.0, 0.0)


def test_augment_does_not_depend_on_partitioning(spark):
    df = cubes(spark, np.random.default_rng(3).normal(size=(12, 4, 4, 6)))
    kw = dict(cluster_min=1, cluster_max=2, p_extrema=0.4, p_sparse=0.3, p_decimate=0.3, p_mixup=0.5, seed=11)
    a = ag.augment(df.repartition(7), (4, 4, 6), **kw)
    b = ag.augment(df.coalesce(1), (4, 4, 6), **kw)
    for c in ("cube", "label"):
        x, y = arrays(a, (4, 4, 6), c), arrays(b, (4, 4, 6), c)
        assert x.keys() == y.keys() and len(x) == 12
        for i in x:
            np.testing.assert_array_equal(x[i], y[i])


def test_augment_checks_its_parameters(spark):
    df = cubes(spark, [ramp(4, 4, 4)])
    for bad in (dict(p_warp=1.5), dict(p_mixup=-1), dict(scaling="zscore", std=0.0), dict(scaling="log"),
                dict(cluster_min=3, cluster_max=2), dict(fraction_min=0.0), dict(p_extrema=0.0)):
        with pytest.raises(ValueError):
            ag.augment(df, 4, **bad)


def test_patch_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    write_patches(cubes(spark, [ramp(2, 3, 4)] * 5), path, dict(size=(2, 3, 4), scaling_mode="none", scaling_mean=0, scaling_std=1), most=3, order=["example_id"])
    got, p = read_patches(spark, path)
    assert p.axes == (2, 3, 4) and got.count() == 3
    write_patches(cubes(spark, [ramp(2, 2, 2)]), path, dict(size=(2, 3, 4), scaling_mode="none", scaling_mean=0, scaling_std=1))
    with pytest.raises(Exception, match="different size"):
        read_patches(spark, path)[0].collect()


# ---- scores ------------------------------------------------------------------


def test_multi_scale_score_with_smaller_outputs(spark):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(4, 4, 8))
    small = rng.normal(size=(2, 2, 4))
    df = spark.createDataFrame([(0, t.ravel().tolist(), (t + 0.5).ravel().tolist(), small.ravel().tolist())],
                               "example_id bigint, target array<double>, fine array<double>, coarse array<double>")
    df = df.withColumn("target_half", scoring.resize_cube("target", (4, 4, 8), (2, 2, 4)))
    got = df.select(scoring.multi_scale_score(["fine", "coarse"], [1.0, 0.5], 0.6, ["target", "target_half"])).first()[0]
    # Halving with centers kept averages each 2x2x2 block.
    half = t.reshape(2, 2, 2, 2, 4, 2).mean(axis=(1, 3, 5))
    np.testing.assert_allclose(np.array(df.first().target_half).reshape(half.shape), half, atol=1e-12)
    score = lambda p, q: 0.6 * ((p - q) ** 2).mean() + 0.4 * ((p - q) ** 2).mean() / (q**2).mean()
    assert got == pytest.approx(score(t + 0.5, t) + 0.5 * score(small, half))
    for bad in (([], []), (["fine"], [1.0, 2.0]), (["fine"], [-1.0])):
        with pytest.raises(ValueError):
            scoring.multi_scale_score(*bad)


def brute_representatives(ids, scores, percents):
    used, out = set(), []
    for p in percents:
        rank = sorted(range(len(ids)), key=lambda i: (abs(scores[i] - np.percentile(scores, p)), ids[i]))
        pick = next((i for i in rank if ids[i] not in used), rank[0])
        used.add(ids[pick])
        out.append((p, ids[pick]))
    return out


# Sizes at which no percentile lies exactly midway between two scores (a tie in all but rounding).
@pytest.mark.parametrize("n", [201, 13, 5])
def test_representatives_equal_the_greedy_definition(spark, n):
    scores = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("training", i, float(s)) for i, s in enumerate(scores)], "split string, example_id bigint, score double")
    got = sorted((r.percentile, r.example_id) for r in scoring.representatives(df).collect())
    assert got == sorted(brute_representatives(list(range(n)), scores, scoring.PERCENTILES))


def test_adaptive_probabilities_fall_back(spark):
    rows = [("nan", 1, 0, float("nan")), ("nan", 1, 1, 2.0), ("zero", 1, 0, 0.0), ("zero", 1, 1, 0.0),
            ("gain", 1, 0, 1.0), ("gain", 2, 0, 5.0), ("gain", 1, 1, 4.0), ("gain", 2, 1, 1.0),
            ("worse", 1, 0, 1.0), ("worse", 2, 0, 9.0), ("worse", 1, 1, 0.5), ("worse", 2, 1, 2.0)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, example_id bigint, recon_loss double")
    got = {(r.run_id, r.example_id): r.probability for r in scoring.adaptive_probabilities(df).collect()}
    assert got["nan", 0] == 0 and got["nan", 1] == 1
    assert got["zero", 0] == got["zero", 1] == 0.5
    # 5 + (1 - 5) = 1 and 1 + (4 - 1) = 4
    assert got["gain", 0] == pytest.approx(0.2) and got["gain", 1] == pytest.approx(0.8)
    # 9 - 8 = 1 and 2 - 1.5 = 0.5
    assert got["worse", 0] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        scoring.adaptive_probabilities(df, window=1)


def test_run_metrics_columns(spark, tmp_path):
    from voxelloom.schema import RUN_METRICS
    from voxelloom.sources.volumes import read_run_metrics

    path = str(tmp_path / "log")
    row = spark.createDataFrame([(1, 10, 10, *[0.5] * 9, "best")], RUN_METRICS)
    append_run_metrics(row, path)
    append_run_metrics(row.withColumn("epoch", F.lit(2)).withColumn("best_model", F.lit(None).cast("string")), path)
    got = {r.epoch: r for r in read_run_metrics(spark, path).collect()}
    assert got[1].best_model == "best" and got[2].best_model is None and got[2].val_loss == 0.5


def test_scaling_modes(spark):
    df = spark.createDataFrame([(4.0,)], "amp double")
    one = lambda *a: volumes.scale_amplitude(df, *a).first().amp
    assert one("none", 1, 2) == 4 and one("divide_by_std", 1, -2) == 2 and one("zscore", 1, 2) == 1.5
    assert one("divide_by_std", 0, 0) == pytest.approx(4e8)
    with pytest.raises(ValueError):
        one("log", 0, 1)
