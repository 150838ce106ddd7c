"""Quantiles, ordered sums, weighted draws and statistics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import joins, quantiles, sampling, scoring, stats
from voxelloom.operators.quantiles import exact_percentiles


def values(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


def check(spark, groups, percents=(0, 2, 50, 88, 100)):
    got = {(r.g, r.percent): r.v for r in exact_percentiles(values(spark, groups), ["g"], "v", percents).collect()}
    assert len(got) == len(groups) * len(percents)
    for g, vs in groups.items():
        for p in percents:
            assert got[g, float(p)] == pytest.approx(np.percentile(vs, p), rel=1e-12, abs=1e-300)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    check(spark, {
        "normal": rng.normal(size=501),
        "mostly zero": np.r_[np.zeros(400), rng.normal(size=100)],
        "wide": np.r_[rng.normal(size=50) * 1e-30, rng.normal(size=50) * 1e200],
        "one": [3.5],
        "two": [1.0, 2.0],
    })


def test_percentiles_narrow_full_bins(spark, monkeypatch):
    """With tiny limits every pass has to narrow, also for close and repeated values."""
    monkeypatch.setattr(quantiles, "SMALL_BIN", 2)
    rng = np.random.default_rng(1)
    check(spark, {
        "close": 1 + rng.normal(size=300) * 1e-9,
        "ties": rng.integers(0, 4, size=200).astype(float),
        "neighbours": np.nextafter(1.0, 2) * np.ones(20).cumsum() / 20,
    })


def test_percentiles_when_sketches_miss(spark, monkeypatch):
    """Brackets that miss their ranks are found out by the count, and the whole group is searched."""
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "REACH", 0.0)
    monkeypatch.setattr(quantiles, "SMALL_BIN", 50)
    rng = np.random.default_rng(3)
    check(spark, {"a": rng.normal(size=4000), "b": np.exp(30 * rng.normal(size=3000)), "c": rng.normal(size=900) * 1e300},
          (1, 2, 3, 40, 88, 88.5, 99))


def test_percentiles_keep_few_rows(spark, monkeypatch):
    kept = []
    plain = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df: kept.append(plain(df)) or kept[-1])
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.rand(1).alias("v"))
    df = plain(df)
    exact_percentiles(df, ["g"], "v", [2, 88]).collect()
    assert max(k.count() for k in kept) < 0.05 * n


def test_dense_ids_have_no_gaps(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(2500)]
    got = joins.dense_ids(spark.createDataFrame(rows, "k string, i int"), ["k", "i"], "id").collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.id)] == sorted(rows)
    assert sorted(r.id for r in got) == list(range(2500))


def test_percentiles_ignore_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert [r.v for r in exact_percentiles(df, [], "v", [50]).collect()] == [2.0]


def test_running_sum_with_a_hot_key(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, int(rng.integers(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, n bigint")
    got = {r.i: r.total for r in joins.running_sum(df, ["k"], ["i"], "n", "total").collect()}
    sums = {}
    for k, i, n in rows:
        sums[k] = sums.get(k, 0) + n
        assert got[i] == sums[k]


@pytest.mark.parametrize("most", [100, 1])
def test_lookup_join_both_ways(spark, most):
    big = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, name string")
    got = joins.lookup_join(big, small, ["k"], ["id"], "left", most=most)
    assert got.count() == 500
    assert got.filter("name is null").count() == big.filter("k > 2").count()


def test_resample_follows_the_running_total(spark):
    rng = np.random.default_rng(3)
    w = np.r_[500.0, np.zeros(20), rng.uniform(0, 1, 300)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "example_id bigint, weight double")
    got = sampling.resample_examples(df, seed=4).toPandas().set_index("draw").sort_index()
    from voxelloom.functions.portable import uniform

    u = spark.range(len(w)).select("id", uniform(4, "resample", F.col("id")).alias("u")).toPandas().sort_values("id").u
    want = np.searchsorted(np.cumsum(w), u.values * w.sum(), side="right")
    np.testing.assert_array_equal(got.example_id.values, want)
    assert len(got) == len(w)


@pytest.mark.parametrize("bad, word", [(-1.0, "negative"), (float("nan"), "finite"), (float("inf"), "finite")])
def test_resample_rejects_bad_weights(spark, bad, word):
    df = spark.createDataFrame([(0, 1.0), (1, bad)], "example_id bigint, weight double")
    with pytest.raises(ValueError, match=word):
        sampling.resample_examples(df)


def test_resample_without_weight_is_uniform(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(200)], "example_id bigint, weight double")
    got = sampling.resample_examples(df, 1).toPandas()
    assert len(got) == 200 and got.example_id.between(0, 199).all() and got.example_id.nunique() > 80


def test_pick_without_replacement_is_distinct_and_bounded(spark):
    rows = [("v", i, i, 0, 0, float(i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "volume_id string, cand int, bx int, by int, bz int, score double")
    got = sampling.weighted_pick(df, 100, replace=False).collect()
    assert len({r.cand for r in got}) == len(got) == 30
    assert all(r.score > 0 for r in got)


def test_pick_with_replacement_never_takes_zero_weight(spark):
    rows = [("v", i, i, 0, 0, float(i % 2)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "volume_id string, cand int, bx int, by int, bz int, score double")
    got = sampling.weighted_pick(df, 200, replace=True).collect()
    assert len(got) == 200 and all(r.score > 0 for r in got)


def test_no_candidates_where_the_patch_does_not_fit(spark):
    dims = spark.createDataFrame([("a", 4, 40, 40), ("b", 8, 40, 40)], "volume_id string, nx int, ny int, nz int")
    got = sampling.candidate_positions(dims, 8, 50, 1).collect()
    assert {r.volume_id for r in got} == {"b"} and len(got) == 50
    assert all(r.bx == 0 and 0 <= r.by <= 32 and 0 <= r.bz <= 32 for r in got)


def test_single_example_is_its_own_partner(spark):
    assert sampling.mixup_partner(spark.createDataFrame([(0,)], "example_id bigint")).first().partner_id == 0


def test_flat_scores_count_only_at_the_top(spark):
    scores = spark.createDataFrame([("v", x, y, [1.0]) for x in range(4) for y in range(4)], "volume_id string, x int, y int, amps array<double>")
    boxes = spark.createDataFrame([("v", 1, 0, 0, 0), ("v", 2, 0, 0, 1), ("v", 3, 3, 3, 0), ("v", 4, 9, 9, 0)], "volume_id string, cand int, bx int, by int, bz int")
    plain = {r.cand: r.score for r in sampling.box_scores(scores, boxes, 2).collect()}
    assert plain == {1: 4.0, 2: 0.0, 3: 1.0, 4: 0.0}
    deep = {r.cand: r.score for r in sampling.box_scores(scores, boxes, 2, broadcast_z=True).collect()}
    assert deep[2] == 8.0


def test_bad_scores_read_zero(spark):
    scores = spark.createDataFrame([("v", 0, 0, [float("nan"), -3.0, 2.0])], "volume_id string, x int, y int, amps array<double>")
    boxes = spark.createDataFrame([("v", 1, 0, 0, 0)], "volume_id string, cand int, bx int, by int, bz int")
    assert sampling.box_scores(scores, boxes, (1, 1, 3)).first().score == 2.0


def test_stats_merge_equals_direct(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i % 3), float(v)) for i, v in enumerate(rng.normal(5, 2, 1000))]
    df = spark.createDataFrame(rows, "volume_id string, amp double")
    a, b = stats.dataset_stats(df).first(), stats.merge_stats(stats.volume_stats(df)).first()
    assert a["count"] == b["count"] == 1000
    assert a["mean"] == pytest.approx(b["mean"]) and a["std"] == pytest.approx(b["std"])
    assert a["std"] == pytest.approx(np.std([v for _, v in rows]))
    with pytest.raises(Exception, match="no samples"):
        stats.dataset_stats(df.limit(0)).collect()


def test_color_limits_of_a_known_volume(spark):
    v = np.linspace(-2, 10, 200)
    df = spark.createDataFrame([("v", float(x)) for x in v] + [("v", float("inf")), ("v", float("nan"))], "volume_id string, amp double")
    vols = spark.createDataFrame([("v",), ("empty",)], "volume_id string")
    got = {r.volume_id: (r.clim_low, r.clim_high) for r in stats.color_limits(df, vols).collect()}
    span = max(abs(np.percentile(v, 2)), abs(np.percentile(v, 88)))
    assert got["v"] == pytest.approx((-span, span)) and got["empty"] == (0.0, 1.0)


def test_gaps_and_missing_weights_are_errors(spark):
    gaps = spark.createDataFrame([(i * 10,) for i in range(6)], "example_id long")
    with pytest.raises(Exception, match="without gaps"):
        sampling.mixup_partner(gaps).collect()
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0)], "example_id long, weight double")
    with pytest.raises(ValueError, match="length"):
        sampling.resample_examples(weights, examples=spark.range(3).withColumnRenamed("id", "example_id"))


def test_scores_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(ids):
        seen.add(len(ids))
        return ids * 0.5

    rows = spark.range(2000).select(F.lit("training").alias("split"), F.col("id").alias("example_id"), score("id").alias("score"))
    assert scoring.representatives(rows).count() == 11
    assert seen.value == 2000
