"""Volumes stored by chunk: boxes that skip files, moments without samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import stats, volumes
from voxelloom.plans.patches import sample_patches
from voxelloom.sources import chunks

SHAPE = (40, 40, 12)


def trace_rows(vol, name="v"):
    return [(name, x, y, vol[x, y].tolist()) for x in range(vol.shape[0]) for y in range(vol.shape[1])]


def tables(spark, *vols):
    rows = [r for name, vol in vols for r in trace_rows(vol, name)]
    dims = [(name, *vol.shape) for name, vol in vols]
    return (
        spark.createDataFrame(rows, "volume_id string, x int, y int, amps array<float>"),
        spark.createDataFrame(dims, "volume_id string, nx int, ny int, nz int"),
    )


@pytest.fixture(scope="module")
def vol():
    return np.random.default_rng(5).normal(size=SHAPE).astype("f4")


@pytest.fixture(scope="module")
def stored(spark, vol, tmp_path_factory):
    """100 chunks of 4x4, in parts of 5 samples, one chunk a range and file as far as shuffle partitions go."""
    path = str(tmp_path_factory.mktemp("chunks") / "v")
    chunks.write_volume_chunked(*tables(spark, ("v", vol)), path, (4, 4, 5))
    return path


def as_dict(df):
    return {(r.x, r.y): (r.z0, r.amps) for r in df.collect()}


@pytest.mark.parametrize("low, high", [
    ((4, 8, 5), (8, 12, 10)), ((3, 3, 3), (9, 10, 11)), ((-5, 38, -2), (2, 99, 99)), ((0, 0, 0), SHAPE), ((7, 7, 7), (8, 8, 8)),
])
def test_a_box_is_the_slice_of_its_volume(spark, vol, stored, low, high):
    got = as_dict(chunks.read_box(spark, stored, "v", low, high))
    lo = [max(v, 0) for v in low]
    want = vol[lo[0]:high[0], lo[1]:high[1], lo[2]:high[2]]
    assert len(got) == want.shape[0] * want.shape[1]
    for (x, y), (z0, amps) in got.items():
        assert z0 == lo[2]
        np.testing.assert_array_equal(np.array(amps, "f4"), want[x - lo[0], y - lo[1]])


@pytest.mark.parametrize("low, high", [((40, 0, 0), (50, 4, 4)), ((4, 4, 12), (8, 8, 20)), ((5, 5, 5), (5, 9, 9))])
def test_a_box_without_samples_is_empty(spark, stored, low, high):
    assert chunks.read_box(spark, stored, "v", low, high).count() == 0
    assert chunks.read_box(spark, stored, "other", (0, 0, 0), (4, 4, 4)).count() == 0
    with pytest.raises(ValueError):
        chunks.read_parts(spark, stored, "v", (0, 0), (1, 1))


def test_a_box_opens_the_files_of_its_chunks_only(spark, stored):
    parts = chunks.read_parts(spark, stored, "v", (4, 8, 5), (8, 12, 10))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = parts._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    opened = {f.rsplit("/", 1)[1] for f in parts.inputFiles()}
    held = chunks.chunk_map(spark, stored).where("cx = 1 and cy = 2 and cz = 1").select("file").distinct()
    assert opened == {r.file for r in held.collect()}
    assert len(opened) < len(spark.read.parquet(stored).inputFiles())
    assert parts.count() == 16
    assert "Exchange" not in plan
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "volume_id" in pushed and "GreaterThan(z1,5)" in pushed


def test_moments_are_those_of_the_samples(spark, vol, stored):
    got = {(r.cx, r.cy, r.cz): r for r in chunks.chunk_stats(spark, stored).collect()}
    assert len(got) == 300
    for (cx, cy, cz), r in got.items():
        block = vol[4 * cx:4 * cx + 4, 4 * cy:4 * cy + 4, 5 * cz:5 * cz + 5].astype("f8")
        assert (r["count"], r["min"], r["max"]) == (block.size, block.min(), block.max())
        np.testing.assert_allclose([r["mean"], r["std"]], [block.mean(), block.std()], rtol=1e-12)
    one = chunks.stored_volume_stats(spark, stored).first()
    assert one["count"] == vol.size
    np.testing.assert_allclose([one["mean"], one["std"]], [vol.astype("f8").mean(), vol.astype("f8").std()], rtol=1e-12)


def test_statistics_read_the_map_and_no_samples(spark, stored):
    chunks.update_chunk_map(spark, stored)
    for df in (chunks.chunk_stats(spark, stored), chunks.stored_volume_stats(spark, stored), chunks.stored_dataset_stats(spark, stored)):
        assert all("/_chunks/" in f for f in df.inputFiles())


def test_a_mean_far_above_the_deviation_keeps_its_digits(spark):
    values = 1e9 + np.random.default_rng(2).normal(size=(50, 40))
    rows = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(values)], "g int, a array<double>")
    got = stats.whole_stats(stats.merge_moments(stats.with_moments(rows, "a"), ["g"], ["n"])).collect()
    for r in got:
        np.testing.assert_allclose(r["std"], values[r.g::3].std(), rtol=1e-6)


def test_moments_of_nulls_empties_and_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, None, 3.0]), (1, []), (2, [None]), (3, None)], "g int, a array<double>")
    each = stats.with_moments(rows, "a")
    got = {r.g: r for r in stats.whole_stats(stats.merge_moments(each, ["g"])).collect()}
    assert (got[1]["count"], got[1]["mean"], got[1]["std"], got[1]["max"]) == (2, 2.0, 1.0, 3.0)
    assert [got[g]["count"] for g in (2, 3)] == [0, 0]
    assert got[2]["mean"] is None and got[3]["std"] is None
    nothing = stats.whole_stats(stats.merge_moments(each.limit(0), [])).first()
    assert nothing["count"] == 0 and nothing["mean"] is None


def test_appends_add_to_the_map(spark, vol, tmp_path):
    path = str(tmp_path / "t")
    other = (vol[:9, :5] * 3 + 100).astype("f4")
    chunks.write_volume_chunked(*tables(spark, ("v", vol)), path, (8, 8, -1))
    chunks.write_volume_chunked(*tables(spark, ("w", other)), path, (8, 8, -1), append=True)
    both = np.concatenate([vol.ravel(), other.ravel()]).astype("f8")
    row = chunks.stored_dataset_stats(spark, path).first()
    assert row["count"] == both.size
    np.testing.assert_allclose([row["mean"], row["std"]], [both.mean(), both.std()], rtol=1e-12)
    peaks = {r.volume_id: r.peak for r in chunks.stored_peaks(spark, path).collect()}
    assert peaks == {"v": float(np.abs(vol).max()), "w": float(np.abs(other).max())}
    # Without depth parts a box is not cut out of more than its own traces.
    assert as_dict(chunks.read_box(spark, path, "w", (8, 0, 0), (9, 5, 3))).keys() == {(8, y) for y in range(5)}


def test_files_without_map_rows_are_found(spark, vol, tmp_path):
    path = str(tmp_path / "t")
    chunks.write_volume_chunked(*tables(spark, ("v", vol)), path, (8, 8, 5))
    lost = tables(spark, ("w", vol[:8, :8]))
    # A write that was cut off before its map: data files only.
    chunks.write_volume_chunked(*lost, str(tmp_path / "u"), (8, 8, 5))
    spark.read.parquet(str(tmp_path / "u")).write.mode("append").parquet(path)
    assert chunks.read_box(spark, path, "w", (0, 0, 0), (8, 8, 12)).count() == 64
    assert {r.volume_id for r in chunks.stored_volume_stats(spark, path).collect()} == {"v", "w"}
    before = chunks.chunk_map(spark, path).count()
    chunks.update_chunk_map(spark, path)
    assert chunks.chunk_map(spark, path).count() == before
    # Overwriting starts the map anew.
    chunks.write_volume_chunked(*lost, path, (8, 8, 5))
    assert [r.volume_id for r in chunks.stored_volume_stats(spark, path).collect()] == ["w"]


def test_missing_and_repeated_parts_are_errors(spark, vol, stored, tmp_path):
    rows = spark.read.parquet(stored)
    for name, bad in (("gap", rows.where("not (x = 3 and y = 3 and cz = 1)")), ("end", rows.where("not (x = 3 and cz = 2)")), ("twice", rows.unionByName(rows))):
        path = str(tmp_path / name)
        bad.write.parquet(path)
        with pytest.raises(Exception, match="leave a gap or overlap"):
            chunks.read_volume_chunked(spark, path).collect()
        with pytest.raises(Exception, match="leave a gap or overlap"):
            chunks.read_box(spark, path, "v", (0, 0, 0), SHAPE).collect()


def test_patches_scaled_by_stored_statistics(spark, vol, stored):
    traces, dims = tables(spark, ("v", vol))
    scores = traces.select("volume_id", "x", "y", F.transform("amps", lambda a: F.abs(a)).alias("amps"))
    args = (scores, dims, (4, 4, 4), 20, 20, 50)
    plain = sample_patches(traces, *args).orderBy("example_id").collect()
    got = sample_patches(traces, *args, stats=chunks.stored_dataset_stats(spark, stored)).orderBy("example_id").collect()
    assert len(got) == len(plain) == 20
    for a, b in zip(got, plain):
        assert (a.example_id, a.bx, a.by, a.bz) == (b.example_id, b.bx, b.by, b.bz)
        np.testing.assert_allclose(a.cube, b.cube, rtol=1e-12)


def test_clip_by_stored_peaks(spark, vol, stored):
    rows = volumes.samples_of(tables(spark, ("v", vol))[0])
    args = (0.5, ["volume_id"], ["x", "y", "z"])
    got = volumes.clip_scaled(rows, *args, peaks=chunks.stored_peaks(spark, stored))
    assert got.exceptAll(volumes.clip_scaled(rows, *args)).isEmpty()
