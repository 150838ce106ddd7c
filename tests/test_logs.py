"""Run logs and streams against step-by-step definitions and batch twins."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import runlog, similarity
from voxelloom.schema import JOB_EVENTS
from voxelloom.session import materialize, scratch_root
from voxelloom.sources import volumes as src
from voxelloom.streaming import jobs, search, sinks


def metrics(spark, losses, acc=None, run="r"):
    rows = [(run, i + 1, float(v), float((acc or losses)[i]), 10) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "run_id string, epoch int, val_loss double, d_gan_acc double, examples bigint")


@pytest.mark.parametrize("delta", [0.0, 0.3])
def test_mark_best_follows_the_rule(spark, delta):
    losses = [5.0, 4.9, 4.5, 4.6, float("nan"), 4.3, 4.1, 4.1, 3.0, 3.5, 3.4, 2.9]
    best, stale = float("inf"), 0
    got = {r.epoch: r for r in runlog.mark_best(metrics(spark, losses), delta).collect()}
    for i, v in enumerate(losses):
        improved = v < best - delta
        best, stale = (v, 0) if improved else (best, stale + 1)
        r = got[i + 1]
        assert (r.best_val_loss, r.improved, r.epochs_since) == (best, improved, stale)


def test_early_stop(spark):
    df = metrics(spark, [3, 2, 2, 2, 2, 1]).unionByName(metrics(spark, [3, 2, 1], run="never"))
    got = {r.run_id: r.stop_epoch for r in runlog.early_stop_epoch(df, 3).collect()}
    assert got == {"r": 5, "never": None}


def test_forecast_equals_polyfit(spark):
    acc = [0.5, 0.6, 0.55, 0.7, 0.8, 0.9, 0.99, 0.2]
    got = {r.epoch: r.forecast for r in runlog.accuracy_forecast(metrics(spark, acc, acc), 5, 2).collect()}
    for i in range(len(acc)):
        if i < 4:
            assert got[i + 1] is None
        else:
            slope, level = np.polyfit(np.arange(5), acc[i - 4:i + 1], 1)
            assert got[i + 1] == pytest.approx(min(1, max(0, level + slope * 6)))


def test_balance_status(spark):
    rows = [(0.81, None), (0.59, None), (0.7, None), (0.7, 0.795), (0.7, 0.605), (0.7, 0.7), (0.9, 0.7)]
    df = spark.createDataFrame(rows, "d_gan_acc double, forecast double")
    got = [r.status for r in runlog.balance_status(df).collect()]
    assert got == ["d_strong", "d_weak", "hold", "d_strong_pred", "d_weak_pred", "hold", "hold"]


def test_eta(spark):
    df = spark.createDataFrame([(25, 100, 10.0), (0, 100, 0.0)], "completed_windows int, total_windows int, elapsed_s double")
    a, b = runlog.progress_eta(df).collect()
    assert a.rate == 2.5 and a.eta_seconds == 30 and b.eta_seconds == pytest.approx(1e8)


def event(kind, t, done=None, total=None, message="", job=1, path=None):
    ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)
    return (job, ts, kind, message, total, done, None, path)


@pytest.mark.parametrize("row, ok", [
    (event("progress", 0, 25, 100), True), (event("progress", 0), False), (event("progress", 0, 11, 10), False),
    (event("progress", 0, -1, 10), False), (event("status", 0), True), (event("done", 0), True), (event("odd", 0), False),
    (event(None, 0), False),
])
def test_event_rules(spark, row, ok):
    df = spark.createDataFrame([row], JOB_EVENTS)
    assert jobs.valid_events(df).count() == int(ok)
    assert jobs.quarantined_events(df).count() == int(not ok)


def follow(spark, tmp_path, rows, watermark, files=1, forget_ms=86_400_000):
    """Progress rows after events arrive in the given order, and the ended query."""
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    step = -(-len(rows) // files)
    query = None
    for at in range(0, len(rows), step):
        spark.createDataFrame(rows[at : at + step], JOB_EVENTS).coalesce(1).write.mode("append").parquet(events)
        stream = jobs.valid_events(spark.readStream.schema(JOB_EVENTS).parquet(events))
        writer = sinks.keep_latest(jobs.stream_job_progress(stream, watermark, forget_ms), out, str(tmp_path / "ckpt"))
        query = sinks.run_available(writer)
    got = {r.job_id: r for r in sinks.read_latest(spark, out, ["job_id"]).collect()}
    batch = {r.job_id: r for r in jobs.job_progress(jobs.valid_events(spark.read.schema(JOB_EVENTS).parquet(events))).collect()}
    return got, batch, query


def test_progress_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [event("progress", t, t, 20, job=j) for j in (1, 2) for t in range(1, 16)]
    rows += [event("status", 3, message="old"), event("status", 9, message="new"), event("artifact", 10, path="a"),
             event("done", 12, job=2), event("progress", 17, 30, 20), event("error", 14, job=2), event("status", 1)]
    order = np.random.default_rng(0).permutation(len(rows))
    got, want, _ = follow(spark, tmp_path, [rows[i] for i in order], "1 hour", 4)
    assert got == want
    assert got[1].percent == 75 and got[1].last_status == "new" and got[1].artifact_path == "a" and got[1].terminal is None
    assert got[2].terminal == "error" and got[2].completed_windows == 15


def test_ended_jobs_leave_no_state(spark, tmp_path):
    day = 86_400
    rows = [event("progress", 1, 5, 10), event("done", 2), event("progress", 3, 7, 10),
            event("progress", day, 1, 4, job=2), event("progress", day + 60, 9, 10),
            event("progress", 4 * day, 2, 4, job=2), event("done", 4 * day + 1, job=2), event("status", 9 * day, message="x", job=3),
            event("done", 9 * day + 1, job=3), event("status", 20 * day, job=4), event("done", 20 * day, job=4)]
    got, _, query = follow(spark, tmp_path, rows, "1 minute", len(rows))
    # What came before the watermark passed the end still counts, what came a day later does not.
    assert got[1].completed_windows == 7 and got[1].terminal == "done" and got[1].total_windows == 10
    assert got[2].completed_windows == 2 and got[2].terminal == "done" and got[3].terminal == "done"
    # Only the last job, whose end the watermark has not passed, is still held.
    assert sinks.state_rows(query) == 1


def test_events_are_routed_once(spark, tmp_path):
    events, path = str(tmp_path / "events"), str(tmp_path / "routed")
    spark.createDataFrame([event("progress", 0, 1, 2), event("progress", 1), event("status", 2)], JOB_EVENTS).write.parquet(events)
    for _ in range(2):
        stream = spark.readStream.schema(JOB_EVENTS).parquet(events)
        sinks.run_available(jobs.route_events(stream, path, str(tmp_path / "ckpt")))
    good, bad = (jobs.routed(spark, path, JOB_EVENTS, v) for v in (True, False))
    assert good.count() == 2 and bad.count() == 1 and good.columns == JOB_EVENTS.names


def test_partial_map_uses_only_the_windows_seen(spark, tmp_path):
    dims = spark.createDataFrame([("v", 8, 8, 8)], "volume_id string, nx int, ny int, nz int")
    rows = [("v", x, y, z, float(x + 2 * y - z)) for x in (0, 2, 4) for y in (0, 2, 4) for z in (0, 2, 4)]
    schema = "volume_id string, wx int, wy int, wz int, sim double"
    path, out = str(tmp_path / "scores"), str(tmp_path / "state")
    for seen in (rows[:10], rows):
        part = seen if len(seen) == 10 else rows[10:]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        query = sinks.run_available(
            sinks.keep_latest(search.stream_overlap_add(stream, dims, 4, 2), out, str(tmp_path / "ckpt")))
        state = sinks.read_latest(spark, out, ["volume_id", "bx", "by", "bz"])
        got = search.partial_map(state, dims, 4, 2).toPandas().sort_values(["x", "y", "z"]).sim.values
        want = similarity.overlap_add(spark.createDataFrame(seen, schema), dims, 4, 2).toPandas()
        np.testing.assert_allclose(got, want.sort_values(["x", "y", "z"]).sim.values, atol=1e-12)
        # Blocks that have had all their windows leave the state.
        blocks = {tuple(np.array(r[1:4]) // 2 + o) for r in seen for o in np.ndindex(2, 2, 2)}
        full = state.filter("complete").count()
        assert sinks.state_rows(query) == len(blocks) - full
    assert full == 64


def test_catalog_rules(spark):
    rows = [("s1", "root", "seismic__1"), ("s2", "root", "temp_folder__1"), ("s3", "other", "seismic__1"),
            ("s4", "root", "seismic__seismic__2"), ("s5", "root", "temp_folder__seismic__2"), ("s6", "root", "plain")]
    df = spark.createDataFrame(rows, "store_id string, parent_dir string, dir_name string")
    assert {r.store_id for r in src.discover_volumes(df).collect()} == {"s2", "s3", "s5", "s6"}
    cat = spark.createDataFrame([("a", "zeta", "1"), ("a", "alpha", "2"), ("b", "data", "3"), ("b", "volume", "4")],
                                "store_id string, array_key string, volume_id string")
    got = {r.store_id: r.array_key for r in src.resolve_arrays(cat).collect()}
    assert got == {"a": "alpha", "b": "volume"}
    traces = spark.createDataFrame([("4", 0, 0, [1.0])], "volume_id string, x int, y int, amps array<float>")
    assert src.read_volume(cat, traces, "b").count() == 1
    for store, key in (("none", None), ("a", "seismic")):
        with pytest.raises(ValueError, match="no array"):
            src.read_volume(cat, traces, store, key)


def test_scratch_folder_and_materialize(spark):
    assert scratch_root(spark)
    df = materialize(spark.range(5).withColumn("u", F.rand()))
    assert df.collect() == df.collect()
