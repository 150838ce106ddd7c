"""Patch augmentations; every draw is a portable uniform, so SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as ag
from ..operators import volumes
from ..sources import fixtures as fx
from .registry import q6, query, r6, sql, tri, u

SEED = 9
P = "patch_samples"
Z = 16
LOW, MODE, HIGH = (repr(r * 7.5) + "::double" for r in (ag.WARP_LOW, ag.WARP_MODE, ag.WARP_HIGH))
MIX = [repr(v) + "::double" for v in (ag.MIXUP_LOW, ag.MIXUP_MODE, ag.MIXUP_HIGH)]


def uu(purpose: str, *ids: str) -> str:
    return u(SEED, purpose, "example_id", *ids)


def _pairs(spark, d):
    cubes = fx.patches(spark, d)
    return cubes.withColumn("label", F.expr("transform(cube, v -> double(v) + 1)"))


def _rows(df, column="cube", name="amp"):
    flat = volumes.patch_samples(df, fx.PATCH, column)
    return flat.select("example_id", "x", "y", "z", r6("amp").alias(name))


def _both(df):
    """Input and label side by side, exploded in step."""
    flat = df.withColumn("cube", F.arrays_zip(F.col("cube").alias("c"), F.col("label").alias("l")))
    return volumes.patch_samples(flat, fx.PATCH).where("amp.c is not null").select(
        "example_id", "x", "y", "z", r6(F.col("amp.c")).alias("amp"), r6(F.col("amp.l")).alias("label"))


# Coordinates a source sample moves to: swap, then flips.
MOVED = (
    f"select example_id, case when {uu('flip_x')} < 0.5 then 4 - sx else sx end x, "
    f"case when {uu('flip_y')} < 0.5 then 4 - sy else sy end y, z, amp::double amp from "
    f"(select *, case when {uu('swap')} < 0.5 then y else x end sx, case when {uu('swap')} < 0.5 then x else y end sy from patch_samples)"
)


@query("swap_flip", sql(
    f"select example_id, cast(x as int) x, cast(y as int) y, z, {q6('amp')} amp, {q6('amp + 1')} as label from m", P, m=MOVED))
def _(spark, d):
    return _both(ag.swap_flip(_pairs(spark, d), fx.PATCH, seed=SEED))


WARP_AT = f"case when z <= 7.5 then z * m / 7.5 else m + (z - 7.5) * (15 - m) / 7.5 end"
WARP = dict(
    mids=f"select example_id, {tri(uu('warp_mid'), LOW, MODE, HIGH)} m from (select distinct example_id from patch_samples)",
    moved=f"select example_id, z, {WARP_AT} s from mids, (select cast(unnest(range({Z})) as int) z)",
)


@query("warp_indices", sql(f"select example_id, z, {q6('s')} as position from moved", P, **WARP))
def _(spark, d):
    return ag.warp_indices(fx.patches(spark, d).select("example_id"), Z, SEED).withColumn("position", r6("position"))


@query("warp_depth", sql(
    f"select a.example_id, a.x, a.y, w.z, case when {u(SEED, 'warp', 'a.example_id')} < 0.6 then {q6('a.amp + (b.amp - a.amp) * (s - a.z) + 1')} else {q6('o.amp')} end amp, "
    f"case when {u(SEED, 'warp', 'a.example_id')} < 0.6 then {q6('a.amp + (b.amp - a.amp) * (s - a.z) + 1')} else {q6('o.amp + 1')} end as label "
    "from moved w join pd a on a.example_id = w.example_id and a.z = floor(s) join pd b on b.example_id = a.example_id and b.x = a.x and b.y = a.y and b.z = least(a.z + 1, 15) "
    "join pd o on o.example_id = a.example_id and o.x = a.x and o.y = a.y and o.z = w.z", P,
    **WARP, pd="select example_id, x, y, z, amp::double amp from patch_samples"))
def _(spark, d):
    return _both(ag.warp_depth(_pairs(spark, d), fx.PATCH, 0.6, SEED))


DROP = dict(
    n=f"select example_id, 2 + floor({uu('clusters')} * 3) n from (select distinct example_id from patch_samples)",
    c=f"select *, unnest(range(9)) k from n",
    r=f"select *, row_number() over (partition by example_id order by {uu('cluster', 'k')}, k) rn from c",
    gone="select distinct r.example_id, x, y from r join patch_samples s using (example_id) where rn <= n and abs(x - (k//3 + 1)) <= 1 and abs(y - (k%3 + 1)) <= 1",
)


@query("trace_dropout", sql(
    f"select p.example_id, p.x, p.y, z, case when g.x is null then {q6('amp')} else 0 end amp from patch_samples p left join gone g "
    "on g.example_id = p.example_id and g.x = p.x and g.y = p.y", P, **DROP))
def _(spark, d):
    return _rows(ag.trace_dropout(_pairs(spark, d), fx.PATCH, 2, 4, SEED))


FRAC = f"(0.1::double + (0.3::double - 0.1::double) * {uu('fraction')})::float::double"


@query("sparse_fraction", sql(
    f"select example_id, {q6(FRAC)} fraction, cast(greatest(1, least(400, round_even({FRAC} * 400, 0))) as int) target "
    "from (select distinct example_id from patch_samples)", P))
def _(spark, d):
    f = ag.sparse_fraction(seed=SEED)
    return fx.patches(spark, d).select("example_id", r6(f).alias("fraction"), ag.sparse_target(f, 400).alias("target"))


FLAT = "(x * 80 + y * 16 + z)"


def uq(purpose: str, i: str, example: str = "example_id") -> str:
    """The draw of sample ``i``: an md5 makes four."""
    key = f"'{SEED}|{purpose}|' || {example} || '|' || ({i} // 4)"
    return f"(('0x' || substr(md5({key}), cast(1 + 8 * ({i} % 4) as int), 8))::bigint / 4294967296.0::double)"


@query("sparse_keep_uniform", sql(
    f"select example_id, x, y, z, case when {uq('keep', FLAT)} <= {FRAC} then {q6('amp')} else 0 end amp from patch_samples", P))
def _(spark, d):
    return _rows(ag.sparse_keep_uniform(fx.patches(spark, d), ag.sparse_fraction(seed=SEED), SEED))


# The distance rule one sample at a time, in the order of the draws.
TARGET = f"cast(greatest(1, least(400, round_even({FRAC} * 400, 0))) as int)"
SPREAD = dict(
    rk=f"select example_id, x, y, z, amp, {FLAT} i, {TARGET} target, {FRAC} f, row_number() over (partition by example_id order by {uq('visit', FLAT)}, {FLAT}) r from patch_samples",
    greedy="select distinct example_id, 0::bigint r, []::int[] kept from rk union all select g.example_id, g.r + 1, "
           "case when len(list_filter(g.kept, lambda j: (j//80 - k.x)*(j//80 - k.x) + (j%80//16 - k.y)*(j%80//16 - k.y) + (j%16 - k.z)*(j%16 - k.z) "
           "< pow(0.85::double * cbrt(400.0::double / k.target), 2))) = 0 then list_append(g.kept, cast(k.i as int)) else g.kept end "
           "from greedy g join rk k on k.example_id = g.example_id and k.r = g.r + 1",
    chosen="select rk.*, row_number() over (partition by example_id order by case when list_contains(kept, cast(i as int)) then 0 else 1 end, rk.r) <= target far "
           "from rk join (select example_id, kept from greedy where r = 400) using (example_id)",
)


@query("sparse_keep_poisson", sql(
    f"select example_id, x, y, z, case when far then {q6('amp')} else 0 end amp from chosen", P, **SPREAD))
def _(spark, d):
    f = ag.sparse_fraction(seed=SEED)
    # Patches with all their samples, as in the definition.
    return _rows(ag.sparse_keep_poisson(fx.patches(spark, d).where(volumes.whole()), fx.PATCH, f, seed=SEED))


# The same over every patch, with those that the volume's edge cuts short, and an md5 for each sample.
SPREAD_ALL = dict(
    rk=f"select example_id, x, y, z, amp, {FLAT} i, n, cast(greatest(1, least(n, round_even({FRAC} * n, 0))) as int) target, {FRAC} f, "
       f"row_number() over (partition by example_id order by {uu('visit', FLAT)}, {FLAT}) r from (select *, count(*) over (partition by example_id) n from patch_samples)",
    greedy=SPREAD["greedy"].replace("400.0::double", "k.n::double"),
    chosen=SPREAD["chosen"].replace("select example_id, kept from greedy where r = 400", "select example_id, arg_max(kept, r) kept from greedy group by 1"),
)


@query("sparse_keep", sql(
    f"select example_id, x, y, z, case when case when {uu('sparse_method')} < 0.5 then far else {uu('keep', FLAT)} <= f end then {q6('amp')} else 0 end amp from chosen",
    P, **SPREAD_ALL))
def _(spark, d):
    return _rows(ag.sparse_keep(fx.patches(spark, d), fx.PATCH, "random", seed=SEED, per_digest=1))


def _near(a: str, n: int, r: str) -> str:
    """Anchor rows and weights that refill coordinate ``a`` from a parity lattice."""
    return f"((b.{a} - {r}) % 2 = 0 and b.{a} >= {r} and b.{a} in (least(greatest(p.{a} - abs(p.{a} - {r}) % 2, {r}), {r} + 2 * (({n} - 1 - {r}) // 2)), least(greatest(p.{a} + abs(p.{a} - {r}) % 2, {r}), {r} + 2 * (({n} - 1 - {r}) // 2))))"


def _weight(a: str, n: int, r: str) -> str:
    top = f"({r} + 2 * (({n} - 1 - {r}) // 2))"
    return f"(case when (p.{a} - {r}) % 2 = 0 or p.{a} < {r} or p.{a} > {top} then 1.0::double else 0.5::double end)"


R = "(case when p.u < 0.5 then 0 else 1 end)"
DEC = dict(
    ps=f"select example_id, x, y, z, amp::double amp, {uu('parity')} u from patch_samples",
    dec="select p.example_id, p.x, p.y, p.z, sum(b.amp * " + " * ".join(_weight(a, n, R) for a, n in (("x", 5), ("y", 5), ("z", 16))) +
        ") amp from ps p join ps b on b.example_id = p.example_id and " +
        " and ".join(_near(a, n, R) for a, n in (("x", 5), ("y", 5), ("z", 16))) + " group by 1,2,3,4",
)


@query("decimate_trilinear", sql(f"select example_id, x, y, z, {q6('amp')} amp from dec", P, **DEC))
def _(spark, d):
    return _rows(ag.decimate_trilinear(fx.patches(spark, d), fx.PATCH, None, SEED))


EXT = dict(
    nb="select *, lag(amp) over w up, lead(amp) over w dn from patch_samples window w as (partition by example_id, x, y order by z)",
    ext="select example_id, x, y, z, case when (amp > up and amp > dn) or (amp < up and amp < dn) then amp::double else 0 end amp from nb",
)
PART = f"floor({uu('partner')} * (n - 1))"
MIXED = dict(
    EXT,
    part=f"select example_id, cast({PART} + case when {PART} >= example_id then 1 else 0 end as bigint) pid, "
         f"({tri(uu('mixup_scale'), *MIX)})::float::double w from (select distinct example_id, count(distinct example_id) over () n from patch_samples)",
)


@query("extrema_mixup", sql(
    f"select p.example_id, p.x, p.y, p.z, case when {u(SEED, 'mixup', 'p.example_id')} < 0.5 then {q6('p.amp::double + w * e.amp')} else {q6('p.amp')} end amp "
    "from patch_samples p join part using (example_id) join ext e on e.example_id = pid and e.x = p.x and e.y = p.y and e.z = p.z", P, **MIXED))
def _(spark, d):
    cubes = fx.patches(spark, d)
    return _rows(ag.extrema_mixup(cubes, cubes, fx.PATCH, 0.5, SEED))


CHOICE = f"cast(case when {uu('transform')} < 0.4::double / (0.4::double + 0.3::double + 0.3::double) then 0 when {uu('transform')} < (0.4::double + 0.3::double) / (0.4::double + 0.3::double + 0.3::double) then 1 else 2 end as int)"


@query("transform_choice", sql(f"select example_id, {CHOICE} as choice from (select distinct example_id from patch_samples)", P))
def _(spark, d):
    return fx.patches(spark, d).select("example_id", ag.transform_choice(0.4, 0.3, 0.3, SEED).alias("choice"))


def _thinned(amp: str) -> str:
    return f"case when case when {u(SEED, 'sparse_method', 'c.example_id')} < 0.5 then far else {uq('keep', 'c.i', 'c.example_id')} <= f end then {amp} else 0 end"


@query("one_of_three", sql(
    f"select c.example_id, c.x, c.y, c.z, case {CHOICE.replace('example_id', 'c.example_id')} when 0 then {q6('e.amp')} when 1 then {_thinned(q6('c.amp'))} else {q6('dec.amp')} end amp "
    "from chosen c join ext e on e.example_id = c.example_id and e.x = c.x and e.y = c.y and e.z = c.z "
    "join dec on dec.example_id = c.example_id and dec.x = c.x and dec.y = c.y and dec.z = c.z", P, **SPREAD, **EXT, **DEC))
def _(spark, d):
    # Patches with all their samples, as in the definition.
    return _rows(ag.one_of_three(fx.patches(spark, d).where(volumes.whole()), fx.PATCH, 0.4, 0.3, 0.3, seed=SEED))


def _moved_axis(flip: str, axis: str) -> str:
    return f"case when {uu(flip)} < 0.5 then 4 - {axis} else {axis} end"


# The whole composition by definition, step by step on the sample table.
AUGMENTED = dict(
    WARP,
    sc="select example_id, x, y, z, (amp::double - 0.01::double) / 0.125::double amp from patch_samples",
    mv=f"select example_id, cast({_moved_axis('flip_x', 'sx')} as int) x, cast({_moved_axis('flip_y', 'sy')} as int) y, z, amp from "
       f"(select *, case when {uu('swap')} < 0.5 then y else x end sx, case when {uu('swap')} < 0.5 then x else y end sy from sc)",
    wp=f"select o.example_id, o.x, o.y, o.z, case when {u(SEED, 'warp', 'o.example_id')} < 0.5 then a.amp * (1 - s + a.z) + b.amp * (s - a.z) else o.amp end amp "
       "from mv o join moved w on w.example_id = o.example_id and w.z = o.z "
       "join mv a on a.example_id = o.example_id and a.x = o.x and a.y = o.y and a.z = least(floor(s), 15) "
       "join mv b on b.example_id = o.example_id and b.x = o.x and b.y = o.y and b.z = least(floor(s) + 1, 15)",
    **{k: v.replace("2 + floor", "1 + floor") for k, v in DROP.items()},
    dr="select wp.example_id, wp.x, wp.y, wp.z, case when g.x is null then wp.amp else 0 end amp, wp.amp as label from wp left join gone g "
       "on g.example_id = wp.example_id and g.x = wp.x and g.y = wp.y",
    **{k: v.replace("from patch_samples window", "from dr window") for k, v in EXT.items()},
    **{k: v.replace("amp::double amp, ", "amp, ").replace("from patch_samples", "from dr") for k, v in DEC.items()},
    **SPREAD,
    picked=f"select d.example_id, d.x, d.y, d.z, label, case {CHOICE.replace('example_id', 'd.example_id')} when 0 then e.amp "
           f"when 1 then {_thinned('d.amp')} else dec.amp end amp from dr d join chosen c on c.example_id = d.example_id and c.x = d.x and c.y = d.y and c.z = d.z "
           "join ext e on e.example_id = d.example_id and e.x = d.x and e.y = d.y and e.z = d.z "
           "join dec on dec.example_id = d.example_id and dec.x = d.x and dec.y = d.y and dec.z = d.z",
    nb0="select *, lag(amp) over w up, lead(amp) over w dn from sc window w as (partition by example_id, x, y order by z)",
    ext0="select example_id, x, y, z, case when (amp > up and amp > dn) or (amp < up and amp < dn) then amp else 0 end amp from nb0",
    part=MIXED["part"],
)


@query("augment", sql(
    f"select p.example_id, p.x, p.y, p.z, case when {u(SEED, 'mixup', 'p.example_id')} < 0.5 then {q6('p.amp + w * e.amp')} else {q6('p.amp')} end amp, {q6('p.label')} as label "
    "from picked p join part using (example_id) join ext0 e on e.example_id = pid and e.x = p.x and e.y = p.y and e.z = p.z", P, **AUGMENTED))
def _(spark, d):
    """The whole training pipeline, with all three input transforms."""
    out = ag.augment(
        fx.patches(spark, d), fx.PATCH, scaling="zscore", mean=0.01, std=0.125, cluster_min=1, cluster_max=3,
        p_extrema=0.4, p_sparse=0.3, p_decimate=0.3, p_mixup=0.5, seed=SEED)
    # Patches with all their samples, as in the definition; partners come from all.
    return _both(out.where(volumes.whole("label")))
