"""Scores, losses, adaptive sampling and representative examples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators.volumes import patch_samples
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import volumes as src
from .registry import q6, query, r6, sql

R = "recon_pairs"
MSE = "avg((pred-target)*(pred-target))"
PMSE = f"{MSE} / greatest(avg(target*target), 1e-8)"


def _score(spark, d, column):
    return fx.recon(spark, d).select("example_id", r6(column).alias("score"))


@query("example_mse", sql(f"select example_id, {q6(MSE)} score from recon_pairs group by 1", R))
def _(spark, d):
    return _score(spark, d, sc.example_mse())


@query("example_pmse", sql(f"select example_id, {q6(PMSE)} score from recon_pairs group by 1", R))
def _(spark, d):
    return _score(spark, d, sc.example_pmse())


@query("example_combined", sql(f"select example_id, {q6(f'0.6 * {MSE} + 0.4 * {PMSE}')} score from recon_pairs group by 1", R))
def _(spark, d):
    return _score(spark, d, sc.example_combined(0.6))


@query("batch_combined", sql(
    f"select label, {q6(MSE)} mse, {q6(f'0.6 * {MSE} + 0.4 * {PMSE}')} combined from recon_pairs group by 1", R))
def _(spark, d):
    out = sc.batch_combined(fx.recon(spark, d), 0.6, ["label"])
    return out.select("label", r6("mse").alias("mse"), r6("combined").alias("combined"))


def _m(f: str) -> str:
    mse = f"avg(({f}-target)*({f}-target))"
    return f"(0.6 * {mse} + 0.4 * {mse} / greatest(avg(target*target), 1e-8))"


@query("multi_scale_score", sql(
    f"select example_id, {q6(_m('pred') + ' + 0.5 * ' + _m('(pred*0.5)') + ' + 0.25 * ' + _m('(pred*0.25)'))} score from recon_pairs group by 1", R))
def _(spark, d):
    scaled = fx.recon(spark, d).withColumns({
        "mid": F.expr("transform(pred, v -> v * 0.5D)"), "coarse": F.expr("transform(pred, v -> v * 0.25D)")})
    return scaled.select(
        "example_id", r6(sc.multi_scale_score(["pred", "mid", "coarse"], (1.0, 0.5, 0.25), 0.6)).alias("score"))


# Halving x, y in a 5-sample axis is not even, so the check averages depth: 16 samples to 1.
@query("resize_cube", sql(
    f"select example_id, x, y, cast(0 as int) z, {q6('avg(amp::double)')} amp from patch_samples where z in (7, 8) group by 1, 2, 3", "patch_samples"))
def _(spark, d):
    small = fx.patches(spark, d).select("example_id", sc.resize_cube("cube", fx.PATCH, (5, 5, 1)).alias("cube"))
    return patch_samples(small, (5, 5, 1)).withColumn("amp", r6("amp"))


@query("kl_divergence", sql(
    f"select {q6('-0.5 * sum(1 + v - m*m - exp(v)) / (count(distinct example_id) * 64)')} kl from "
    "(select example_id, unnest(mu)::double m, unnest(logvar)::double v from latent_params)", "latent_params"))
def _(spark, d):
    return sc.kl_divergence(fx.latent_params(spark, d), 64).select(r6("kl").alias("kl"))


BCE = "greatest(logit, 0) - logit*y + ln(1 + exp(-abs(logit)))"


@query("logit_metrics", sql(
    f"select {q6(f'avg({BCE})')} d_loss, {q6('avg(case when (logit >= 0) = (y = 1) then 1.0::double else 0 end)')} d_accuracy, "
    f"{q6('avg(greatest(logit, 0) - logit + ln(1 + exp(-abs(logit)))) filter (where y = 0)')} g_loss from (select *, quality y from logits)", "logits"))
def _(spark, d):
    rows = fx.logits(spark, d)
    out = sc.logit_metrics(rows.filter("quality = 1"), rows.filter("quality = 0"))
    return out.select(*[r6(c).alias(c) for c in ("d_loss", "d_accuracy", "g_loss")])


def damping_model():
    """Fixed model: the input damped by half."""
    return lambda cubes: np.asarray(cubes, dtype=np.float64) * 0.5


@query("snapshot_scores", sql(
    f"select example_id, {q6('0.6 * avg(0.25*t*t) + 0.4 * avg(0.25*t*t) / greatest(avg(t*t), 1e-8)')} recon_loss "
    "from (select example_id, amp::double t from patch_samples) group by 1", "patch_samples"))
def _(spark, d):
    cubes = fx.patches(spark, d).withColumn("target", F.col("cube").cast("array<double>"))
    return sc.snapshot_scores(cubes, damping_model, fx.PATCH, 0.6).withColumn("recon_loss", r6("recon_loss"))


ADAPT = dict(
    r="select *, row_number() over w rn, recon_loss l, lead(recon_loss) over w - recon_loss gain from snapshots window w as (partition by run_id, example_id order by epoch desc)",
    g="select run_id, example_id, max(case when rn = 1 then l end) l, coalesce(avg(gain) filter (where rn < 3), 0) imp from r where rn <= 3 group by 1, 2",
    s="select *, greatest(l + imp, 0) score from g",
    p="select *, score / sum(score) over (partition by run_id) p from s",
)


@query("adaptive_probabilities", sql(
    f"select run_id, example_id, {q6('l')} recon_loss, {q6('imp')} average_improvement, {q6('score')} score, {q6('p * 1000')} probability_k from p", "snapshots", **ADAPT))
def _(spark, d):
    out = sc.adaptive_probabilities(fx.snapshots(spark, d))
    return out.select(
        "run_id", "example_id", *[r6(c).alias(c) for c in ("recon_loss", "average_improvement", "score")],
        r6(F.col("probability") * 1000).alias("probability_k"))


@query("sampling_summary", sql(
    f"select run_id, {q6('avg(l)')} recon_mean, {q6('avg(imp)')} improvement_mean, {q6('avg(score)')} score_mean, {q6('max(p)')} probability_max, "
    f"{q6('min(p)')} probability_min, {q6('-sum(p * ln(greatest(p, 1e-12)))')} entropy from p group by 1", "snapshots", **ADAPT))
def _(spark, d):
    out = sc.sampling_summary(sc.adaptive_probabilities(fx.snapshots(spark, d)))
    return out.select("run_id", *[r6(c).alias(c) for c in out.columns if c != "run_id"])


def split_scores(spark, d):
    scored = fx.recon(spark, d).select("example_id", sc.example_combined().alias("score"))
    split = F.when(F.col("example_id") % 4 == 0, "validation").when(F.col("example_id") % 4 == 1, "test").otherwise("training")
    return scored.withColumn("split", split)


# The greedy rule step by step: at each percentile the nearest example not used yet.
LEVELS = ", ".join(str(p / 100) for p in sc.PERCENTILES)
GREEDY = dict(
    s=f"select case example_id % 4 when 0 then 'validation' when 1 then 'test' else 'training' end split, example_id, "
      f"0.6 * {MSE} + 0.4 * {PMSE} score from recon_pairs group by 2",
    ends=f"select split, quantile_cont(score, [{LEVELS}]) v from s group by 1",
    marks=f"select split, unnest(range(1, {len(sc.PERCENTILES) + 1})) k, unnest({list(sc.PERCENTILES)}) percentile, unnest(v) mark from ends",
    chosen="select split, 0 k, 0 percentile, null::bigint example_id, []::bigint[] used from (select distinct split from s) union all "
           "select c.split, m.k, m.percentile, p.example_id, list_append(c.used, p.example_id) from chosen c join marks m on m.split = c.split and m.k = c.k + 1, "
           "lateral (select arg_min(s.example_id, (round(abs(s.score - m.mark) / greatest(abs(m.mark), 1e-12), 9), s.example_id)) example_id from s where s.split = c.split and not list_contains(c.used, s.example_id)) p",
)
CHOSEN = f"select split, cast(c.percentile as int) percentile, c.example_id, {q6('s.score')} score from chosen c join s using (split, example_id) where k > 0"


@query("representatives", sql(CHOSEN, R, **GREEDY))
def _(spark, d):
    return sc.representatives(split_scores(spark, d)).withColumn("score", r6("score"))


@query("save_representatives", sql(CHOSEN + " and split <> 'test'", R, **GREEDY))
def _(spark, d):
    path = scratch_path(spark, "representatives")
    src.save_representatives(sc.representatives(split_scores(spark, d)), path)
    return src.load_representatives(spark, path).withColumn("score", r6("score"))


@query("append_snapshots", sql(f"select run_id, epoch, example_id, {q6('recon_loss')} recon_loss from snapshots", "snapshots"))
def _(spark, d):
    path = scratch_path(spark, "snapshots")
    rows = fx.snapshots(spark, d)
    src.append_snapshots(rows.filter("epoch = 1").withColumnRenamed("recon_loss", "mse"), path)
    src.append_snapshots(rows.filter("epoch > 1"), path)
    got = src.read_snapshots(spark, path)
    return got.select("run_id", "epoch", "example_id", r6("recon_loss").alias("recon_loss"))
