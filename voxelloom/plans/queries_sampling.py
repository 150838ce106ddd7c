"""Positions, weighted picks and patch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, volumes
from ..sources import fixtures as fx
from .patches import sample_patches, sample_stores
from .registry import q6, query, r6, sql, u

SEED, N, PICKS = 5, 400, 150
D = "volume_samples volume_dims score_samples"


def _pos(axis: str, step: int) -> str:
    uu = u(SEED, f"cand_{axis}", "volume_id", "cand")
    return f"cast(floor({uu} * (n{axis} - {step} + 1)) as int) b{axis}_"


CAND = dict(
    c0=f"select *, cast(unnest(range(1, {N + 1})) as int) cand from volume_dims",
    cand=f"select volume_id, cand, {_pos('x', 5)}, {_pos('y', 5)}, {_pos('z', 16)} from c0",
)
# A flat map only meets boxes that start at the top; the second form repeats it over depth.
BOX = dict(
    CAND,
    box="select c.volume_id, cand, bx_, by_, bz_, coalesce(sum(amp) filter (where bz_ = 0), 0)::double score, coalesce(sum(amp)*16, 0)::double deep "
        "from cand c left join score_samples s on s.volume_id = c.volume_id and x >= bx_ and x < bx_+5 and y >= by_ and y < by_+5 group by 1,2,3,4,5",
)
COLS = 'volume_id, cand, bx_ bx, by_ "by", bz_ bz'
CUM = dict(
    BOX,
    cum="select *, sum(w) over (partition by volume_id order by cand) hi, sum(w) over (partition by volume_id) total from "
        "(select *, case when sum(deep) over (partition by volume_id) <= 0 then 1.0 else deep end w from box)",
    dr=f"select distinct volume_id, total from cum",
    dr2=f"select *, cast(unnest(range(1, {PICKS + 1})) as int) draw from dr",
    pick=f"select cum.*, draw from dr2 join cum using (volume_id) where {u(SEED, 'pick', 'volume_id', 'draw')} * dr2.total >= hi - w "
         f"and {u(SEED, 'pick', 'volume_id', 'draw')} * dr2.total < hi",
)


def _boxes(spark, d, deep=True):
    dims = fx.volume_dims(spark, d)
    found = sampling.candidate_positions(dims, fx.PATCH, N, SEED)
    return sampling.box_scores(fx.score_traces(spark, d, dims), found, fx.PATCH, deep)


@query("candidate_positions", sql(f"select {COLS} from cand", D, **CAND))
def _(spark, d):
    return sampling.candidate_positions(fx.volume_dims(spark, d), fx.PATCH, N, SEED)


@query("box_scores", sql(f"select {COLS}, {q6('score')} score, {q6('deep')} deep from box", D, **BOX))
def _(spark, d):
    deep = _boxes(spark, d).select("volume_id", "cand", r6("score").alias("deep"))
    return _boxes(spark, d, False).withColumn("score", r6("score")).join(deep, ["volume_id", "cand"])


@query("weighted_pick", sql(f"select {COLS}, draw, {q6('deep')} score from pick", D, **CUM))
def _(spark, d):
    picked = sampling.weighted_pick(_boxes(spark, d), PICKS, True, seed=SEED)
    return picked.withColumn("score", r6("score"))


RACE = f"-ln({u(SEED, 'race', 'volume_id', 'cand')} + 0.5/4294967296.0)"


@query("weighted_pick_distinct", sql(
    f"select {COLS}, {q6('deep')} score, cast(rn as int) draw from (select *, row_number() over (partition by volume_id order by {RACE}/deep, cand) rn "
    f"from (select * from box where deep > 0 qualify row_number() over (partition by volume_id, bx_, by_, bz_ order by cand) = 1)) where rn <= {PICKS}", D, **BOX))
def _(spark, d):
    picked = sampling.weighted_pick(sampling.distinct_positions(_boxes(spark, d)), PICKS, False, seed=SEED)
    return picked.withColumn("score", r6("score"))


@query("uniform_fallback", sql(
    f"select {COLS}, cast(rn as int) draw from (select *, row_number() over (partition by volume_id order by {RACE}, cand) rn from cand) where rn <= {PICKS}",
    D, **CAND))
def _(spark, d):
    nothing = fx.score_traces(spark, d).withColumn("amps", F.array(F.lit(0.0)))
    found = sampling.candidate_positions(fx.volume_dims(spark, d), fx.PATCH, N, SEED)
    scored = sampling.box_scores(nothing, found, fx.PATCH)
    return sampling.weighted_pick(scored, PICKS, False, seed=SEED).drop("score")


@query("sample_patches", sql(
    f"select volume_id, draw, cast(x-bx_ as int) x, cast(y-by_ as int) y, cast(z-bz_ as int) z, {q6('amp::double / sd')} amp from "
    "(select * from pick order by volume_id, draw limit 120) join volume_samples using (volume_id), sdv where x >= bx_ and x < bx_+5 and y >= by_ and y < by_+5 and z >= bz_ and z < bz_+16",
    D, **CUM, sdv="select greatest(abs(stddev_pop(amp::double)), 1e-8) sd from volume_samples"))
def _(spark, d):
    dims = fx.volume_dims(spark, d)
    got = sample_patches(
        fx.volume_traces(spark, d), fx.score_traces(spark, d, dims), dims, fx.PATCH,
        n_patches=120, n_per_volume=PICKS, n_candidates=N, broadcast_z=True, seed=SEED)
    key = got.select((F.col("draw")).cast("bigint").alias("example_id"), "cube")
    flat = volumes.patch_samples(key, fx.PATCH)
    return flat.select(
        F.lit("v0").alias("volume_id"), F.col("example_id").cast("int").alias("draw"), "x", "y", "z", r6("amp").alias("amp"))


def _survey(steps: dict[str, str]) -> dict[str, str]:
    return {k: v.replace("volume_dims", "survey_dims") for k, v in steps.items()}


# Boxes of the first volume meet a flat map at any depth, those of the second a deep one, those of the third none.
BOX3 = " and ".join(f"{a} >= b{a}_ and {a} < b{a}_+{n}" for a, n in (("x", 5), ("y", 5), ("z", 16)))
SURVEY = dict(
    _survey(CAND),
    box="select c.*, coalesce(f.s, d.s, 0) deep from cand c "
        f"left join (select c.volume_id, cand, sum(amp) * 16 s from cand c join survey_flat s on s.volume_id = c.volume_id and {BOX3.rsplit(' and z', 1)[0].rsplit(' and z', 1)[0]} group by all) f using (volume_id, cand) "
        f"left join (select c.volume_id, cand, sum(abs(amp)::double) s from cand c join survey_samples s on s.volume_id = c.volume_id and c.volume_id = 'b' and {BOX3} group by all) d using (volume_id, cand)",
    **{k: v for k, v in CUM.items() if k not in BOX},
    capped="select *, row_number() over (order by volume_id, draw) - 1 example_id from pick",
)


@query("sample_stores", sql(
    f"select example_id, volume_id, cast(draw as int) draw, cast(x-bx_ as int) x, cast(y-by_ as int) y, cast(z-bz_ as int) z, {q6('amp::double / sd')} amp from "
    f"(select * from capped where example_id < 400) join survey_samples using (volume_id), sdv where {BOX3}",
    "volume_samples survey_samples survey_dims survey_flat", **SURVEY,
    sdv="select greatest(abs(stddev_pop(amp::double)), 1e-8) sd from survey_samples"))
def _(spark, d):
    """Three volumes of unequal extent, each with its own kind of score map, in one call."""
    traces = fx.survey_traces(spark, d).unionByName(fx.survey_scores(spark, d))
    got = sample_stores(
        fx.survey_catalog(spark, d), traces, fx.PATCH, n_patches=400, n_per_volume=PICKS, n_candidates=N, seed=SEED)
    flat = volumes.patch_samples(got.select("example_id", "cube"), fx.PATCH)
    near = flat.join(got.select("example_id", "volume_id", "draw"), "example_id")
    return near.select("example_id", "volume_id", "draw", "x", "y", "z", r6("amp").alias("amp"))


RES = dict(
    w="select vec_id example_id, avg(v) weight from (select vec_id, abs(unnest(embedding)::double) v from embeddings) group by 1",
    c="select *, sum(weight) over (order by example_id) hi, sum(weight) over () total, count(*) over () n from w",
    dd="select cast(unnest(range(max(n))) as bigint) draw, max(total) tot from c",
)


@query("resample_examples", sql(
    f"select draw, example_id from dd join c on {u(SEED, 'resample', 'draw')} * tot >= hi - weight and {u(SEED, 'resample', 'draw')} * tot < hi", **RES))
def _(spark, d):
    weights = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("example_id"),
        F.expr("aggregate(embedding, 0D, (s, v) -> s + abs(double(v))) / size(embedding)").alias("weight"))
    return sampling.resample_examples(weights, SEED)


PARTNER = f"floor({u(SEED, 'partner', 'example_id')} * (n - 1))"


@query("mixup_partner", sql(
    f"select example_id, cast({PARTNER} + case when {PARTNER} >= example_id then 1 else 0 end as bigint) partner_id from "
    "(select vec_id example_id, count(*) over () n from embeddings)"))
def _(spark, d):
    return sampling.mixup_partner(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("example_id")), SEED)
