"""Exact Jaccard components of word shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bitfilter import build_filter, key_hashes, may_hold
from .common import lean, slices, stored
from .graph import components
from .wordhash import shingle_sets

SHINGLE_WORDS = 4
PERCENT = 85
# Shingles of so many texts come last in every text's order, the commonest of them at most.
COMMON_TEXTS = 16
COMMON_SHINGLES = 131_072
# Members of a component that one tile holds.
TILE_NODES = 2048
# Pairs that a task hands on at once.
TILE_PAIRS = 1 << 16
# Bytes of text that a worker turns into sets at once.
SLICE_BYTES = 4 << 20


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in batch["body"].to_pylist()]


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, SLICE_BYTES)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def first_part(n: int, percent: int) -> int:
    """Shingles of a set of which a linked set has one among as many of its own."""
    return n - -(-percent * n // 100) + 1


def common_shingles(docs: DataFrame, size: int, percent: int, lower: bool) -> np.ndarray:
    """Shingles of many texts, the rarest first; only the order of work depends on them.

    Counted are the shingles that come first by hash, with half as many more
    as are needed, since only those can come first once common ones come last.
    """

    @lean
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            firsts = [s[: first_part(len(s), percent) * 3 // 2] for s in shingle_sets(_texts(batch), size, lower)]
            found, n = np.unique(np.concatenate([*firsts, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    rows = (
        docs.select("body").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= COMMON_TEXTS).orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    )
    return rows["h"].to_numpy()[::-1].copy().view(np.uint64)


def prefix(found: np.ndarray, by_hash: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare ones first.

    Sets that link share all but 15 percent of either, so they share one of
    the first 15 percent, plus one, of both in any common order.
    """
    n = len(found)
    k = first_part(n, percent)
    if not len(by_hash):
        return found[:k]
    at = np.minimum(np.searchsorted(by_hash, found), len(by_hash) - 1)
    is_common = by_hash[at] == found
    rare = found[~is_common]
    if len(rare) >= k:
        return rare[:k]
    common = found[is_common]
    return np.r_[rare, common[np.argsort(rank[at[is_common]])]][:k]


def indexed(docs: DataFrame, common: np.ndarray, size: int, percent: int, lower: bool) -> DataFrame:
    """(doc_id, n, set_key, prefix, bits) of every text; equal sets have equal keys of 128 bits."""
    order = np.argsort(common)
    by_hash, rank = common[order], np.arange(len(common))[order]

    @lean
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = list(shingle_sets(_texts(batch), size, lower))
            keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            firsts = [prefix(s, by_hash, rank, percent) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists(firsts),
                    pa.array(map(bitmap, sets), pa.binary()),
                ],
                ["doc_id", "n", "set_key", "prefix", "bits"],
            )

    return docs.mapInArrow(made, "doc_id long, n long, set_key binary, prefix array<long>, bits binary")


def bitmap(found: np.ndarray) -> bytes:
    """One bit per shingle, in at least twice as many places, by the low bits of its hash."""
    places = 1 << max(6, int(2 * len(found) - 1).bit_length())
    bits = np.zeros(places, np.uint8)
    bits[(found & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """The same bitmaps in half as many places; bitmaps are rows."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def overlap_bounds(x: np.ndarray, n_x: int, rows: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
    """Most shingles that each row's set can share with another: a place only one of them uses is a shingle the other lacks."""
    while x.shape[-1] > rows.shape[-1]:
        x = fold(x)
    while rows.shape[-1] > x.shape[-1]:
        rows = fold(rows)
    only_x = np.bitwise_count(x & ~rows).sum(axis=-1, dtype=np.int64)
    only_rows = np.bitwise_count(rows & ~x).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_x - only_x, n_rows - only_rows)


class Tile:
    """Nodes with their components, by the size band that their bitmaps' width sets."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.held: dict[int, tuple[list, list, list, list]] = {}
        self.bands: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None

    def add(self, node: int, root: int, n: int, bits: bytes) -> None:
        for x, y in zip(self.held.setdefault(len(bits) // 8, ([], [], [], [])), (node, root, n, bits)):
            x.append(y)

    def near(self, root: int, n: int, bits: bytes) -> np.ndarray:
        """Members of other components that sizes and bitmaps do not rule out."""
        if self.bands is None:
            self.bands = {
                w: (np.array(nodes), np.array(roots), np.array(sizes), np.frombuffer(b"".join(maps), np.uint64).reshape(-1, w))
                for w, (nodes, roots, sizes, maps) in self.held.items()
            }
        out = []
        x = np.frombuffer(bits, np.uint64)
        # Sets that can link differ in size by less than two, so their bands are the same or neighbours.
        for w in (len(x) // 2, len(x), len(x) * 2):
            if w not in self.bands:
                continue
            nodes, roots, sizes, maps = self.bands[w]
            fit = (roots != root) & (100 * sizes >= self.percent * n) & (100 * n >= self.percent * sizes)
            nodes, sizes = nodes[fit], sizes[fit]
            bound = overlap_bounds(x, n, maps[fit], sizes)
            out.append(nodes[100 * bound >= self.percent * (n + sizes - bound)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def chosen_sets(docs: DataFrame, nodes: DataFrame, size: int, lower: bool) -> DataFrame:
    """(node, found): shingle arrays of the texts whose id may be in ``nodes``."""
    table = docs.sparkSession.sparkContext.broadcast(build_filter(nodes, "node", nodes.count()))

    @lean
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = may_hold(table.value, batch["h"].to_numpy(), batch["bits"].to_numpy())
            for piece in slices(batch.filter(pa.array(held)), SLICE_BYTES):
                sets = list(shingle_sets(_texts(piece), size, lower))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], _lists(sets)], ["node", "found"])

    # The filter is asked in the same worker that makes the sets.
    h, bits = key_hashes(F.col("doc_id"))
    rows = docs.where("doc_id is not null").select("doc_id", "body", h.alias("h"), bits.alias("bits"))
    return rows.mapInArrow(made, "node long, found array<long>")


def fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """The smaller set has enough of the larger one's size to link."""
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def possible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""

    @lean
    def bounded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            bound = [
                overlap_bounds(np.frombuffer(x, np.uint64), n_x, np.frombuffer(y, np.uint64), n_y)
                for x, n_x, y, n_y in zip(p["bits_a"], p["n_a"], p["bits_b"], p["n_b"])
            ]
            bound = np.array(bound, np.int64)
            yield p.loc[100 * bound >= percent * (p["n_a"] + p["n_b"] - bound), ["a", "b"]]

    def side(name: str) -> DataFrame:
        known = texts.where("n > 0")
        return known.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(fits(F.col("n_a"), F.col("n_b"), percent))
    return sized.select("bits_a", "n_a", "bits_b", "n_b", "a", "b").mapInPandas(bounded, "a long, b long")


def _pairs(found: list[np.ndarray]) -> pd.DataFrame:
    a, b = np.concatenate(found, axis=1)
    return pd.DataFrame({"a": a, "b": b}).astype("int64").drop_duplicates()


def possible_in_tiles(strays: DataFrame, inside: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that sizes and bitmaps do not rule out.

    ``strays`` (node, root, cluster) are held against the members of their
    clusters, ``inside`` (node, root, cluster), and against its other strays.
    Both are spread over tiles of bounded size, and each stray visits all tiles
    of its clusters; pairs exist only within a tile's loop.
    """
    members = inside.unionByName(strays)
    sizes = members.groupBy("cluster").count().select(F.col("cluster").alias("of"), F.ceil(F.col("count") / TILE_NODES).alias("tiles"))
    known = texts.where("n > 0").select(F.col("doc_id").alias("id"), "n", "bits")

    def placed(rows: DataFrame, kind: int, tile: Column) -> DataFrame:
        dealt = rows.join(sizes, F.col("cluster") == F.col("of")).withColumn("tile", tile)
        return dealt.join(known, F.col("node") == F.col("id")).select(
            "cluster", "tile", F.lit(kind).alias("kind"), "node", "root", "n", "bits"
        )

    both = placed(members, 0, F.pmod(F.xxhash64("node"), F.col("tiles"))).unionByName(
        placed(strays, 1, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    )

    @lean
    def held(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tile = None, Tile(percent)
        for p in batches:
            found, n_found = [], 0
            for cluster, number, kind, node, root, n, bits in p.itertuples(index=False):
                if (cluster, number) != key:
                    key, tile = (cluster, number), Tile(percent)
                if kind == 0:
                    tile.add(node, root, n, bits)
                    continue
                near = tile.near(root, n, bits)
                found.append(np.stack([np.minimum(near, node), np.maximum(near, node)]))
                n_found += len(near)
                # In a hot cluster nearly all members may be possible, so pairs are handed on as they come.
                if n_found >= TILE_PAIRS:
                    yield _pairs(found)
                    found, n_found = [], 0
            if found:
                yield _pairs(found)

    return (
        both.repartition("cluster", "tile").sortWithinPartitions("cluster", "tile", "kind", "node")
        .mapInPandas(held, "a long, b long")
    )


def linked(left: DataFrame, docs: DataFrame, percent: int, size: int, lower: bool) -> DataFrame:
    """The pairs (a, b) whose sets link, by intersection of sorted arrays."""

    @lean
    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The arrays are read where they lie in the batch.
            flat = [batch[c].flatten().to_numpy() for c in ("found_a", "found_b")]
            size = np.stack([pc.list_value_length(batch[c]).to_numpy() for c in ("found_a", "found_b")]).astype(np.int64)
            end = np.cumsum(size, axis=1)
            both = np.array([
                len(np.intersect1d(flat[0][i:j], flat[1][k:m], assume_unique=True))
                for i, j, k, m in zip(*(x.tolist() for x in (end[0] - size[0], end[0], end[1] - size[1], end[1])))
            ], np.int64)
            held = pa.array(100 * both >= percent * (size.sum(axis=0) - both))
            yield batch.select(["a", "b"]).filter(held)

    left = materialize(left.distinct())
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(chosen_sets(docs, nodes, size, lower))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("found").alias(f"found_{name}"))

    return left.join(side("a"), "a").join(side("b"), "b").select("a", "b", "found_a", "found_b").mapInArrow(
        exact, "a long, b long"
    ).distinct()


def jaccard_components(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = SHINGLE_WORDS,
    lower: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    Two texts link when their distinct shingles overlap by ``percent`` of
    their union; a component is what links reach.  All links between texts of
    different components are examined, however large a group is:

    1. Equal sets become one node, named by its least id.
    2. Nodes that share a shingle among their first ones are candidates.  Each
       node is first held against one leader only, the least node of most of
       its candidate groups, which joins groups of near copies with as many
       comparisons as they have members.
    3. Within every candidate group, nodes outside its largest component so
       far go to that component's tiles, where they meet its members and each
       other.  All are checked alike: sizes, then bitmaps, then arrays.

    Texts without words have no shingles and link with nothing.  A text of
    fewer words than a shingle is one shingle.  Rows of equal id are one
    document that links by any of its texts.  A row without id is counted but
    links with nothing, its component is null.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    common = common_shingles(rows, size, percent, lower)
    texts = stored(indexed(rows, common, size, percent, lower), "shingle-sets")
    named = texts.where("n > 0 and doc_id is not null")
    nodes = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("node")))

    own = nodes.select(F.col("set_key").alias("key"), "node")
    firsts = named.join(own, (F.col("set_key") == F.col("key")) & (F.col("doc_id") == F.col("node"))).select(
        "node", F.explode("prefix").alias("shingle")
    )
    groups = firsts.groupBy("shingle").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    groups = groups.where("lead <> last").select("shingle", "lead")
    shared = stored(firsts.join(groups, "shingle"), "shared-shingles")

    stars = (
        shared.where("node <> lead").groupBy("node", "lead").count()
        .groupBy("node").agg(F.max(F.struct("count", -F.col("lead"))).alias("best"))
        .select(F.col("node").alias("a"), (-F.col("best.col2")).alias("b"))
    )
    # Texts of one id belong together.
    mine = named.select("doc_id", "set_key").join(own, F.col("set_key") == F.col("key")).select("doc_id", "node")
    several = mine.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").drop("last")
    same_id = several.join(mine, "doc_id").select("a", F.col("node").alias("b"))
    links = linked(possible(stars, texts, percent), rows, percent, size, lower)
    joined = materialize(components(links.unionByName(same_id)))

    # Members of each group with their component; the largest component of a group is not paired with itself.
    held = joined.select(F.col("node").alias("at"), "root")
    placed = shared.join(held, F.col("node") == F.col("at"), "left").select(
        "shingle", "node", F.coalesce("root", "node").alias("root")
    )
    sizes = placed.groupBy("shingle", "root").count().groupBy("shingle").agg(
        F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("parts")
    )
    open_groups = sizes.where("parts > 1").select("shingle", F.col("most.root").alias("main"))
    members = stored(placed.join(open_groups, "shingle"), "open-groups")
    strays = members.where("root <> main").select("node", "root", F.col("main").alias("cluster")).distinct()
    touched = strays.select(F.col("cluster").alias("of")).distinct()
    inside = held.join(touched, F.col("root") == F.col("of"), "left_semi").select(
        F.col("at").alias("node"), "root", F.col("root").alias("cluster")
    )
    single = touched.join(held, F.col("of") == F.col("root"), "left_anti").select(
        F.col("of").alias("node"), F.col("of").alias("root"), F.col("of").alias("cluster")
    )
    crossing = possible_in_tiles(strays, inside.unionByName(single), texts, percent)
    more = materialize(linked(crossing, rows, percent, size, lower))

    def renamed(links: DataFrame, column: str) -> DataFrame:
        to = joined.select(F.col("node").alias("at"), "root")
        return links.join(to, F.col(column) == F.col("at"), "left").withColumn(column, F.coalesce("root", column)).select("a", "b")

    over = components(renamed(renamed(more, "a"), "b")).select(F.col("node").alias("of"), F.col("root").alias("top"))
    ends = nodes.join(held, F.col("node") == F.col("at"), "left").withColumn("root", F.coalesce("root", "node"))
    ends = ends.join(over, F.col("root") == F.col("of"), "left").select(
        F.col("set_key").alias("key"), F.coalesce("top", "root").alias("component_id")
    )
    return texts.select("doc_id", "n", "set_key").join(ends, F.col("set_key") == F.col("key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
