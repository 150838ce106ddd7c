"""Named queries over the given tables, each with its SQL definition.

The SQL is written from the definition of an operator, not from the plan that
computes it, so it serves as an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Input tables of the checks, in SQL.
TABLES = {
    "volume_samples": "select 'v0' volume_id, cast(vec_id//20 as int) x, cast(vec_id%20 as int) y, cast(z as int) z, amp from (select vec_id, unnest(range(64)) z, unnest(embedding) amp from embeddings)",
    "volume_dims": "select volume_id, max(x)+1 nx, max(y)+1 ny, max(z)+1 nz from volume_samples group by 1",
    "volume_samples_mirror": "select 'v1' volume_id, nx-1-x x, y, z, amp from volume_samples join volume_dims using (volume_id)",
    "label_samples": "select cast(label as varchar) volume_id, unnest(embedding) amp from embeddings",
    "score_samples": "select 'v0' volume_id, cast(l_suppkey%nx as int) x, cast(l_partkey%ny as int) y, 0 z, sum(l_quantity) amp from lineitem, volume_dims group by 1,2,3",
    "catalog": "select n_nationkey store_id, 'root' parent_dir, case when n_nationkey%3=0 then 'seismic__'||n_nationkey when n_nationkey%3=1 and n_nationkey%2=0 then 'temp_folder__'||(n_nationkey-1) else 'other__'||n_nationkey end dir_name, array_key, cast(case when array_key='geologic_score' and n_nationkey%2=0 then 2 when n_nationkey%7=6 then 4 else 3 end as int) ndim, cast(20+n_nationkey as int) nx, cast(18 as int) ny, cast(case when array_key='geologic_score' and n_nationkey%2=0 then 1 else 64 end as int) nz from nation, (values (0,'seismic'),(1,'volume'),(2,'data'),(3,'geologic_score')) k(p,array_key) where (n_nationkey+p)%4<>3",
    "patch_samples": "select cast(((x//5)*4+y//5)*4+z//16 as bigint) example_id, x%5 x, y%5 y, z%16 z, amp from volume_samples",
    "recon_pairs": "select vec_id example_id, label, cast(z as int) z, amp::double target, avg(amp::double) over (partition by label,z) pred from (select vec_id,label,unnest(range(64)) z,unnest(embedding) amp from embeddings)",
    "logits": "select doc_id, quality, ('0x'||substr(md5('11|logit|'||doc_id),1,8))::bigint/4294967296.0::double*4-2+0.5*quality logit from labels",
    "run_metrics": "select event_type run_id, cast(day(ts) as int) epoch, avg(case when user_id%2=0 then value end) train_loss, avg(value) val_loss, avg(case when value<50 then 1.0::double else 0.0::double end) d_gan_acc, count(*) examples from events group by 1,2",
    "snapshots": "select 'r0' run_id, cast((day(ts)-1)//10+1 as int) epoch, user_id example_id, avg(value) recon_loss from events group by 1,2,3",
    "job_events": "select user_id job_id, ts, case event_type when 'view' then 'progress' when 'click' then 'progress' when 'purchase' then 'artifact' when 'signup' then 'status' else case when event_id%20<>0 then 'status' when event_id%40=0 then 'error' else 'done' end end kind, props message, case when event_type in ('view','click') and event_id%3=0 then value end eta_seconds, case when event_type='purchase' then 'out/'||event_id end artifact_path, count(*) over (partition by user_id) total_windows, case when event_id%89=0 then null else row_number() over (partition by user_id order by ts, event_id)+case when event_id%97=0 then count(*) over (partition by user_id) else 0 end end completed_windows from events",
    "survey_samples": "select case when x < 9 then 'a' when x < 17 then 'b' else 'c' end volume_id, cast(case when x < 9 then x when x < 17 then x - 9 else y end as int) x, cast(case when x < 17 then y else x - 17 end as int) y, z, amp from volume_samples where not (x >= 9 and x < 17 and z >= 48)",
    "survey_dims": "select volume_id, max(x)+1 nx, max(y)+1 ny, max(z)+1 nz from survey_samples group by 1",
    "survey_flat": "select 'a' volume_id, cast(l_suppkey%9 as int) x, cast(l_partkey%20 as int) y, sum(l_quantity)::float::double amp from lineitem group by 1,2,3",
    "latent_params": "select vec_id example_id, embedding mu, list_transform(embedding, lambda v: -v) logvar from embeddings",
}
NEEDS = {
    "volume_dims": ["volume_samples"],
    "volume_samples_mirror": ["volume_samples", "volume_dims"],
    "score_samples": ["volume_samples", "volume_dims"],
    "patch_samples": ["volume_samples"],
    "survey_samples": ["volume_samples"],
    "survey_dims": ["volume_samples", "survey_samples"],
}


def sql(final: str, uses: str = "", **steps: str) -> str:
    """A statement from input tables, further steps in order, and the last select."""
    names: list[str] = []
    for name in uses.split():
        for each in [*NEEDS.get(name, []), name]:
            if each not in names:
                names.append(each)
    parts = [f"{n} as ({TABLES[n]})" for n in names] + [f"{n} as ({s})" for n, s in steps.items()]
    return (f"with recursive {', '.join(parts)} " if parts else "") + final


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r6(value) -> Column:
    """Round to the digits both engines agree on."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), 6)


def q6(expr: str) -> str:
    return f"(round(({expr})::double, 6) + 0.0::double)"


def u(seed: int, purpose: str, *ids: str) -> str:
    """The portable uniform in SQL."""
    key = " || '|' || ".join([f"'{seed}|{purpose}'", *ids])
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint / 4294967296.0::double)"


def tri(uu: str, a: str, m: str, b: str) -> str:
    """Inverse CDF of the triangular distribution in SQL."""
    return (
        f"case when {uu} * ({b} - {a}) < {m} - {a} then {a} + sqrt({uu} * ({b} - {a}) * ({m} - {a})) "
        f"else {b} - sqrt((1 - {uu}) * ({b} - {a}) * ({b} - {m})) end"
    )
