"""Queries over a volume whose last traces are missing, so that patches, boxes and maps have holes; the table is a folder."""

import os

import duckdb
import numpy as np
import pytest
from test_oracles import ordered

import __spark_entry__ as entry

# 21 rows of 20 traces and one of 16: the extent is no multiple of the patch.
TRACES = 436

PATCHES = (
    "read_patches encode_patches snapshot_scores stream_latent_scores sparse_keep sparse_keep_poisson sparse_keep_uniform "
    "decimate_trilinear one_of_three augment extrema_mixup swap_flip warp_depth trace_dropout composite_slices resize_cube "
    "normalize_by_std preprocess nonzero_count write_patches"
).split()
VOLUMES = (
    "window_count extract_boxes extract_centered pad_dense unpad overlap_add search_volume search_volume_encoder "
    "search_volume_stride8 stream_overlap_add volume_summary search_report shape_guard stream_stats sample_stores"
).split()


@pytest.fixture(scope="module")
def short(sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("short")
    for name in os.listdir(sf):
        if name != "embeddings.parquet":
            os.symlink(f"{sf}/{name}", root / name)
    (root / "embeddings.parquet").mkdir()
    for part in (0, 1):
        duckdb.sql(f"select * from '{sf}/embeddings.parquet' where vec_id < {TRACES} and vec_id % 2 = {part}").write_parquet(
            str(root / "embeddings.parquet" / f"part-{part}.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def duck(short):
    con = duckdb.connect()
    for name in os.listdir(short):
        at = f"{short}/{name}/*.parquet" if os.path.isdir(f"{short}/{name}") else f"{short}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{at}'")
    return con


@pytest.mark.parametrize("name", PATCHES + VOLUMES)
def test_query_with_holes(spark, short, duck, name):
    got = ordered(entry.queries()[name](spark, short).toPandas())
    want = ordered(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_array_equal(got[c].astype(float).values, want[c].astype(float).values, err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_sparse_keep_takes_short_patches(spark, short, duck):
    """Every sample of the volume has a row, those of patches at the edge too."""
    assert entry.queries()["sparse_keep"](spark, short).count() == TRACES * 64


def test_report_shapes_of_long_volumes(spark, short):
    """An extent above 2147 makes a shape number of ten digits."""
    kinds = dict(entry.queries()["search_report"](spark, short).dtypes)
    assert {kinds[c] for c in ("output_shape", "search_shape", "padded_shape")} == {"bigint"}
