"""Mixing sources to target weights by proportionate-fair scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Documents of one block, and slots that the schedule hands on at once.
BLOCK_DOCS = 16
# None: blocks have the size asked for, whatever the table's size.  A number makes blocks grow so that a mix has
# about that many, which bounds the time of its schedule and changes its order.
MOST_BLOCKS: int | None = None
PERIOD = 1024
# Most sources a mix can have; more raise an error.
MAX_SOURCES = 100_000
# Documents of one running-number bucket of a source.
BUCKET_DOCS = 5_000
# Natural shares are flattened by this power when no weights are given.
FLATTEN = 0.9


def shares(weights: Mapping, period: int = PERIOD) -> dict:
    """Whole slots of one period for each source, by largest remainders, one at least.

    They only come near to the weights: a mix is scheduled by the weights themselves.
    """
    wanted = {s: Fraction(w) for s, w in weights.items() if w > 0}
    period = max(period, 4 * len(wanted))
    total = sum(wanted.values())
    exact = {s: w * period / total for s, w in wanted.items()}
    slots = {s: max(1, int(e)) for s, e in exact.items()}
    order = sorted(exact, key=lambda s: (slots[s] - exact[s], s is None, str(s)))
    spare = period - sum(slots.values())
    for s in order[: max(0, spare)]:
        slots[s] += 1
    return slots


class Unmet(ValueError):
    """A schedule of the given length cannot hold all that it must."""


def schedule(
    weights: Mapping, blocks: Mapping | None = None, length: int | None = None
) -> Iterator[tuple[int, object, int, int, int]]:
    """Each slot as (slot, source, use, release, deadline), by earliest deadline first.

    Use j of a source with share x of the weights may run from slot
    floor(j/x) and must run before slot ceil((j+1)/x).  Shares are exact and
    hold over all of ``length`` (the sum of whole weights if not given), so at
    every slot each source is within one block of its share, however long the
    mix is.  The first ``blocks`` uses of a source must run before ``length``
    too; ``Unmet`` is raised if they cannot.
    """
    whole = _whole(weights)
    total = sum(whole.values())
    length = total if length is None else length
    sources = sorted(whole, key=lambda s: (s is None, str(s)))
    size = [whole[s] for s in sources]
    must = [(blocks or {}).get(s, 0) for s in sources]
    waiting = [(0, r, 0) for r in range(len(sources))]
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            release, r, j = heapq.heappop(waiting)
            deadline = -(-(j + 1) * total // size[r])
            heapq.heappush(ready, (min(deadline, length) if j < must[r] else deadline, r, j, release))
        due, r, j, release = heapq.heappop(ready)
        if due <= slot:
            raise Unmet(length)
        yield slot, sources[r], j, release, -(-(j + 1) * total // size[r])
        heapq.heappush(waiting, ((j + 1) * total // size[r], r, j + 1))
    if any(j < must[r] for _, r, j, *_ in ready) or any(j < must[r] for _, r, j in waiting):
        raise Unmet(length)


def _whole(weights: Mapping) -> dict:
    """The positive weights as whole numbers of the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    unit = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def fit(weights: Mapping, blocks: Mapping) -> tuple[int, dict]:
    """How many slots the mix has, and how often it uses each source's blocks.

    No source may be a block above its share, so the mix cannot end before
    the last block of any is released.  From there on lengths are tried at
    growing steps, up to where each source has its blocks by weight alone.
    """
    whole = _whole(weights)
    total = sum(whole.values())
    least = max(((blocks[s] - 1) * total // w + 1 for s, w in whole.items()), default=0)
    most = max((-(-blocks[s] * total // w) for s, w in whole.items()), default=0)
    step = 0
    while True:
        length = min(least + step, most)
        step = 2 * step + 1
        if sum(max(w * length // total, blocks[s]) for s, w in whole.items()) > length:
            continue
        uses = dict.fromkeys(whole, 0)
        try:
            for _, s, *_ in schedule(whole, blocks, length):
                uses[s] += 1
        except Unmet:
            continue
        return length, uses


def numbered(docs: DataFrame, key: str, total: int) -> DataFrame:
    """Number each source's documents from 0 in a shuffled but fixed order.

    Numbers come from counts per hashed bucket, so no task holds a source.
    """
    buckets = max(1, -(-total // BUCKET_DOCS))
    placed = docs.withColumn("mix_hash", F.xxhash64("mix_id", "mix_text")).withColumn(
        "mix_bucket", F.pmod(F.shiftright("mix_hash", 16), F.lit(buckets))
    )
    counts = placed.groupBy(key, "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n"))
    before = Window.partitionBy(key).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(key).alias("mix_of"), F.col("mix_bucket").alias("mix_at"),
        F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before"),
    )
    inside = Window.partitionBy(key, "mix_bucket").orderBy("mix_hash", "mix_id", "mix_text")
    return (
        placed.withColumn("mix_rank", F.row_number().over(inside) - 1)
        .join(counts, F.col(key).eqNullSafe(F.col("mix_of")) & (F.col("mix_bucket") == F.col("mix_at")))
        .withColumn("mix_number", F.col("mix_before") + F.col("mix_rank"))
    )


def row_key(docs: DataFrame, text_col: str) -> Column:
    """A key that rows share only if they are equal: the text's md5 and a hash of all columns."""
    plain = [F.col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    text_md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.concat(text_md5, F.hex(F.xxhash64(*plain)))


def plan_mix(
    docs: DataFrame,
    weights: Mapping | None = None,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Where each document comes in the mix: (doc_id, source, epoch, block, slot, place, release, deadline).

    The mix is as long as it must be for every source to be used whole once;
    meanwhile a source with less than its share starts again, so its documents
    have several rows (``epoch`` 0, 1, ...).  Within any run of slots from the
    start each source differs by less than one block from its exact weight,
    over the whole mix.  Without ``weights`` a source weighs its number of
    documents to the power 0.9, so no source is started again often.  The last
    block of an epoch may have fewer documents; ``place`` is a document's
    position in its block.  Blocks have ``block_docs`` documents
    at any size of the table.  ``period`` only sets how many slots of the schedule
    are handed on at once.

    Documents of sources that ``weights`` leaves out or sets to 0 are not in
    the mix.  Null is a source like any other.  Repeated rows are separate
    documents.  An empty table gives an empty result, other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = materialize(
        docs.select(
            F.col(id_col).alias("mix_id"), F.col(source_col).cast("string").alias("mix_source"),
            row_key(docs, text_col).alias("mix_text"),
        )
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("mix_source").count().limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to fewer before mixing")
    if weights is None:
        weights = {s: Fraction(round(n**FLATTEN * 1000), 1000) for s, n in sizes.items()}
    weights = _whole({s: w for s, w in weights.items() if s in sizes})
    if MOST_BLOCKS is not None:
        block_docs = max(block_docs, -(-sum(sizes[s] for s in weights) // MOST_BLOCKS))
    blocks = {s: -(-sizes[s] // block_docs) for s in weights}
    length, n_uses = fit(weights, blocks)

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            plan = schedule(weights, blocks, length)
            while part := list(islice(plan, period)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), pa.string(), *[pa.int64()] * 3))],
                    ["at", "of", "nth", "release", "deadline"],
                )

    # The schedule runs through one task, with a row per block and only the sources in memory.
    plan = spark.range(0, 1, 1, 1).mapInArrow(slots, "at long, of string, nth long, release long, deadline long")
    # From Arrow the table is made in the JVM; a list of rows would go through Python workers of another kind, which stay.
    facts = spark.createDataFrame(
        pa.table({
            "of_source": pa.array(list(weights), pa.string()), "n_blocks": pa.array([blocks[s] for s in weights], pa.int64()),
            "n_uses": pa.array([n_uses[s] for s in weights], pa.int64()),
        })
    )
    placed = (
        numbered(rows, "mix_source", max(1, sum(sizes.values())))
        .join(F.broadcast(facts), F.col("mix_source").eqNullSafe(F.col("of_source")))
        .withColumn("block", F.expr(f"mix_number div {block_docs}"))
        .withColumn("epoch", F.explode(F.expr("sequence(0L, (n_uses - 1 - block) div n_blocks)")))
        .withColumn("use", F.col("epoch") * F.col("n_blocks") + F.col("block"))
    )
    return placed.join(
        plan.hint("merge"), F.col("mix_source").eqNullSafe(F.col("of")) & (F.col("use") == F.col("nth"))
    ).select(
        F.col("mix_id").alias("doc_id"), F.col("mix_source").alias("source"), "epoch", "block",
        F.col("at").alias("slot"), F.expr(f"mix_number % {block_docs}").alias("place"), "release", "deadline",
        F.col("mix_text").alias("row_key"),
    )


def mix(docs: DataFrame, weights: Mapping | None = None, **settings) -> DataFrame:
    """The mixed documents with their columns, as often as the plan uses them, in its order.

    Rows are range-partitioned by slot, so files written from the result follow
    the schedule.
    """
    text_col = settings.get("text_col", "text")
    plan = plan_mix(docs, weights, **settings)
    # Of equal rows one stands for all: each of them is planned, and the plan's rows meet the one.
    # A row stays in one column, so its names meet no others.
    kinds = docs.select(F.struct("*").alias("row"), row_key(docs, text_col).alias("kind")).dropDuplicates(["kind"])
    uses = plan.select("row_key", "slot", "place")
    return (
        kinds.join(uses, F.col("kind") == F.col("row_key"))
        .repartitionByRange("slot", "place")
        .sortWithinPartitions("slot", "place")
        .select("row.*")
    )
