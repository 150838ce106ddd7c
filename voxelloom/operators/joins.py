"""Joins and ordered sums that keep their shape when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LOOKUP_ROWS = 200_000
# What is broadcast has fewer bytes than this, counted as text.
LOOKUP_BYTES = 32 << 20
SALTS = 64


def few_rows(df: DataFrame, most: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and ``most_bytes``; reads no more rows than that plus one.

    Rows are counted where they are, none comes to the driver.
    """
    size = F.octet_length(F.to_json(F.struct("*")))
    n, held = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= most and held <= most_bytes


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    most: int = LOOKUP_ROWS,
) -> DataFrame:
    """Attach per-key rows of ``small`` to ``big``.

    The small side is broadcast only after its row count has been checked.
    Beyond the bound it is repeated once per salt and joined on the key plus a
    salt taken from the ``spread`` columns, so a key holding a large part of
    ``big`` is still split over many tasks.
    """
    keys = list(keys)
    if few_rows(small, most):
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_dims(rows: DataFrame, dims: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Attach the volume catalog's columns; a volume that the catalog lacks is an error, not a loss."""
    kept = [c for c in dims.columns if c != "volume_id"]
    near = lookup_join(rows, dims, ["volume_id"], spread, "left")
    lost = F.raise_error(F.concat(F.lit("no catalog row for volume "), F.col("volume_id").cast("string")))
    types = dict(dims.dtypes)
    return near.withColumns({c: F.coalesce(F.col(c), lost.cast(types[c])) for c in kept})


def slabs(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cut ``df`` into evenly filled, globally ordered slabs (column ``slab``).

    Range partitioning samples the rows, so slabs stay even whatever the
    distribution.  The result is materialized: slab numbers must be the same
    for every reader.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("slab", F.spark_partition_id()))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Running total of ``value`` per key, without one task per key.

    Inside a slab a window adds up; the totals of earlier slabs (at most one
    row per key and slab) are carried in by an equi-join.
    """
    keys, cut = list(keys), slabs(df, [*keys, *order])
    inside = Window.partitionBy("slab", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut.groupBy("slab", *keys)
        .agg(F.sum(value).alias("_slab_sum"))
        .select("slab", *keys, F.coalesce(F.sum("_slab_sum").over(earlier), F.lit(0)).alias("_carry"))
    )
    body = cut.withColumn("_inside", F.sum(value).over(inside))
    return (
        body.join(carry, ["slab", *keys])
        .withColumn(out, F.col("_carry") + F.col("_inside"))
        .drop("_carry", "_inside", "slab")
    )


def dense_ids(df: DataFrame, order: Sequence[str], out: str = "example_id") -> DataFrame:
    """Number the rows from 0 without gaps, in an order that is unique.

    Numbers come from counts per slab and offsets, so no task sees all rows.
    """
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", out)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order that is unique.

    Only the order columns are sorted; wide rows are then kept by comparing
    with the last kept key, so they never meet in one task.
    """
    order = list(order)
    keys = df.select(*order)
    if n <= LOOKUP_ROWS:
        kept = keys.orderBy(*order).limit(n)
    else:
        counted = running_sum(keys.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", "_nth")
        kept = counted.filter(F.col("_nth") <= n)
    last = kept.agg(F.max(F.struct(*order))).scalar()
    return df.withColumn("_last", last).filter(F.struct(*order) <= F.col("_last")).drop("_last")


def last_before(marks: DataFrame, probes: DataFrame, at: str, carry: str) -> DataFrame:
    """For each probe, ``carry`` of the last mark with position ``at`` not above it.

    Marks and probes are sorted together into slabs, so neither a heavy mark
    nor a dense run of probes lands in one task and no pairs are formed.
    """
    both = marks.select(at, F.lit(0).alias("_kind"), carry).unionByName(
        probes.withColumn("_kind", F.lit(1)), allowMissingColumns=True
    )
    cut = slabs(both, [at, "_kind"])
    upto = Window.partitionBy("slab").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        cut.groupBy("slab")
        .agg(F.max_by(F.when(F.col("_kind") == 0, F.col(carry)), F.when(F.col("_kind") == 0, F.col(at))).alias("_end"))
        .select("slab", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    )
    found = cut.withColumn("_found", F.last(carry, ignorenulls=True).over(upto))
    return (
        found.filter("_kind = 1")
        .join(ends, "slab")
        .withColumn(carry, F.coalesce("_found", "_carried"))
        .drop("_found", "_carried", "_kind", "slab")
    )
