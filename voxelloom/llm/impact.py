"""Exact top-k inner products over an impact-ordered index, processed score-at-a-time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

SCALE = 1024
QUERY_EVERY = 100
TOP = 10
# Vectors of one block: a task holds one block's index at a time.
BLOCK_VECTORS = 8192
# Posting segments of one dimension, of equal width in impact.
LEVELS = 64
# Shares of all segments after which a query looks whether it can stop.
STOPS = (0.65, 0.75, 0.85, 1.0)
# It stops once no more than this share of the block can still be members.
FEW = 0.2
# Scores and their bounds are exact in doubles below this.
MOST = 1 << 52

FOUND = "query_id long, vec_id long, score long"


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null or not finite."""
    value = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )


def whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All components as whole numbers, and the first one of each vector."""
    column = batch["vector"]
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**31:
        raise ValueError("components times the scale must be below 2^31")
    ends = np.r_[0, np.cumsum(np.diff(column.offsets.to_numpy()))]
    return flat.astype(np.int32), ends


def dealt_vectors(rows: DataFrame, blocks: int, scale: int) -> DataFrame:
    """(block, kind, vec_id, vector): whole vectors as bytes, dealt evenly whatever their ids are."""

    @lean
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            flat, ends = whole(batch, scale)
            vectors = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            block = (at + np.arange(batch.num_rows)) % blocks
            at += batch.num_rows
            columns = [pa.array(block), pa.array(np.zeros(len(block), np.int32)), batch["vec_id"], pa.array(vectors, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "vec_id", "vector"])

    return rows.mapInArrow(made, "block long, kind int, vec_id long, vector binary")


class Block:
    """The vectors of one block with their posting segments by dimension and quantised impact."""

    def __init__(self, ids: list, vectors: list[bytes], levels: int) -> None:
        self.named = np.array([i is not None for i in ids], bool)
        self.ids = np.array([i or 0 for i in ids], np.int64)
        n, width = len(vectors), max((len(v) // 4 for v in vectors), default=0)
        self.rows = np.zeros((n, width), np.int64)
        for k, v in enumerate(vectors):
            self.rows[k, : len(v) // 4] = np.frombuffer(v, np.int32)
        self.reach = np.abs(self.rows).max(axis=0, initial=0)
        # By dimension: the vectors by value, where each segment of them begins, and its least and greatest value.
        self.postings = np.argsort(self.rows, axis=0, kind="stable")
        self.edges, self.low, self.high, self.of = [], [], [], []
        # A vector's segment in each dimension.
        self.segment = np.zeros((n, width), np.int16)
        for d in range(width):
            values = self.rows[self.postings[:, d], d]
            level = (values - values[0]) * levels // (values[-1] - values[0] + 1)
            begins = np.r_[True, level[1:] != level[:-1]]
            edges = np.r_[np.flatnonzero(begins), n]
            self.segment[self.postings[:, d], d] = np.cumsum(begins) - 1
            self.edges.append(edges)
            self.low.append(values[edges[:-1]])
            self.high.append(values[edges[1:] - 1])
            self.of.append(np.full(len(edges) - 1, d))
        self.postings = np.ascontiguousarray(self.postings.T)

    def best(self, query_id: int, query: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(places, scores) of the ``top`` best vectors but those of the query's own id, and the share of segments processed.

        A vector starts at the sum of the least contributions of all
        dimensions; a posting adds what its segment contributes more at least.
        A vector's score is thus at least its sum.  It is at most that plus the
        width of the segments met, plus what the next segment of each dimension
        not yet met could add.  Vectors are left out only where that is less
        than the ``top``-th sum.
        """
        n, width = self.rows.shape
        q = np.zeros(width, np.int64)
        q[: min(width, len(query))] = query[:width]
        if float(np.abs(q).astype(np.float64) @ self.reach.astype(np.float64)) >= MOST:
            raise ValueError("inner products must be below 2^52")
        own = self.named & (self.ids == query_id)
        left = n - int(own.sum())
        possible, share = np.flatnonzero(~own), 0.0
        used = np.flatnonzero(q)
        if left > top and len(used):
            possible, share = self._possible(q, used, own, top)
        scores = self.rows[possible] @ q
        if len(scores) > top:
            kth = np.partition(scores, len(scores) - top)[len(scores) - top]
            near = scores >= kth
            possible, scores = possible[near], scores[near]
        ranked = np.lexsort((self.ids[possible], ~self.named[possible], -scores))[:top]
        return possible[ranked], scores[ranked], share

    def _possible(self, q: np.ndarray, used: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, float]:
        n, width = self.rows.shape
        # Segments in descending impact within each dimension: from the greatest value on, or from the least.
        gain, could, size = {}, {}, {}
        blur = np.zeros(width)
        for d in used.tolist():
            turn = slice(None, None, -1 if q[d] > 0 else 1)
            ends = self.low[d][turn] * q[d], self.high[d][turn] * q[d]
            least, most = ends if q[d] > 0 else ends[::-1]
            gain[d], could[d] = least - least[-1], most - least[-1]
            size[d] = np.diff(self.edges[d])[turn]
            blur[d] = (most - least).max()
        impact = np.sort(np.concatenate(list(could.values())))[::-1]
        sums = np.zeros(n, np.int64)
        lowest = np.iinfo(np.int64).min
        done = np.zeros(width, np.int64)
        # A vector is met in a dimension if its segment is beyond this one, or before it where the order is turned.
        cut = np.zeros(width, np.int16)
        turned = q <= 0
        for share in STOPS:
            level = impact[int(share * len(impact))] if share < 1 else -1
            rest = np.zeros(width)
            for d in used.tolist():
                was, now = int(done[d]), int(np.count_nonzero(could[d] > level))
                if now > was:
                    ends = (was, now) if q[d] < 0 else (-1 - now, -1 - was)
                    a, b = self.edges[d][list(ends)].tolist()
                    added = np.repeat(gain[d][was:now], size[d][was:now])
                    sums[self.postings[d, a:b]] += added if q[d] < 0 else added[::-1]
                    done[d] = now
                cut[d] = now if q[d] < 0 else len(could[d]) - now
                rest[d] = could[d][now] if now < len(could[d]) else 0
            unmet = (self.segment < cut) ^ turned
            room = blur.sum() + unmet.astype(np.float64) @ (rest - blur)
            sums[own] = lowest
            kth = np.partition(sums, n - top)[n - top]
            possible = np.flatnonzero((sums + room >= kth) & ~own)
            if len(possible) <= max(top, FEW * n):
                break
        return possible, int(done.sum()) / len(impact)


def searched(dealt: DataFrame, top: int, levels: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best vectors of each block; a block's vectors come before its queries."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, ([], []), None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for at, kind, vec_id, vector in zip(*(batch[c].to_pylist() for c in ("block", "kind", "vec_id", "vector"))):
                if at != number:
                    number, held, block = at, ([], []), None
                if kind == 0:
                    held[0].append(vec_id)
                    held[1].append(vector)
                    continue
                if block is None:
                    block = Block(*held, levels)
                    held = ([], [])
                places, scores, _ = block.best(vec_id, np.frombuffer(vector, np.int32).astype(np.int64), top)
                out[0].extend([vec_id] * len(places))
                out[1].extend(i if known else None for i, known in zip(block.ids[places].tolist(), block.named[places].tolist()))
                out[2].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def top_inner_products(
    vectors: DataFrame, top: int = TOP, every: int = QUERY_EVERY, scale: int = SCALE,
    block_vectors: int = BLOCK_VECTORS, levels: int = LEVELS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Each query's ``top`` rows of highest inner product: (query_id, rank, vec_id, score).

    Vectors are taken as whole numbers, floor(scale * x).  Queries are the rows
    whose id is divisible by ``every``; all rows of other ids are candidates.
    Rows are dealt evenly into blocks of bounded size.  In each block every
    dimension's postings are cut into segments by quantised value, and each
    query processes segments by descending impact until it is proved which few
    vectors can still be among its best; only these are scored exactly.  All
    blocks' best are merged, so the result is exact.

    Equal scores go to the smaller id, rows without id last.  Null vectors, and
    those with null or not finite components, take no part; components that a
    shorter vector lacks count as 0.  Each repeated row is a candidate of its
    own; a query id of several vectors asks with the least of them.  Components
    times ``scale`` of 2^31 or more, and products of 2^52 or more, raise an
    error.  Other columns are ignored, an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(finite(F.col("vector")))
    blocks = max(1, -(-rows.count() // block_vectors))
    dealt = stored(dealt_vectors(rows, blocks, scale), "impact-vectors")
    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = asked.select(everywhere.alias("block"), F.lit(1).alias("kind"), "vec_id", "vector")
    placed = dealt.unionByName(queries).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = searched(placed, top, levels).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
