"""Ranked lexical search: each term's postings in blocks of similar documents with maximum summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import BITS_PER_KEY, MAX_FILTER_BYTES, WORDS, may_hold
from .common import lean, slices, stored
from .wordhash import mixed, word_hashes

TOP = 50
# Documents of one shard: a task holds one shard's index at a time.
SHARD_DOCS = 4096
# Documents of one block of a posting list, about.
BLOCK_DOCS = 32
# Coordinates of a summary; terms beyond share them.
COORDINATES = 2048
# Dimensions in which documents are compared when they are put into blocks.
SKETCH = 32
SLICE_BYTES = 6 << 20
CACHE_WORDS = 500_000
# Postings whose summaries are made at once.
GATHER = 1 << 12

_TERM = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_SECOND = np.uint64(0xD1B54A32D192ED03)


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits, in lower case, and all characters beyond ASCII."""
    return text.encode().translate(_TERM).split()


def keys(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h = word_hashes(terms)[0]
    return h.view(np.int64), mixed(h ^ _SECOND).view(np.int64)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each once."""

    @lean
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch["item_id"].to_pylist(), batch["body"].to_pylist()):
                found = sorted(set(terms_of(text)))
                ids.extend([item] * len(found))
                out.extend(t.decode() for t in found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(split, "item_id long, term string").distinct()


def term_filter(terms: DataFrame, n: int) -> np.ndarray:
    """The blocked Bloom filter of the terms, of bounded size."""
    blocks = int(max(1, min(-(-n * BITS_PER_KEY // (64 * WORDS)), MAX_FILTER_BYTES // (8 * WORDS))))

    @lean
    def masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bits = keys([t.encode() for t in batch["term"].to_pylist()])
            place = (bits.view(np.uint64)[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
            mask = (np.uint64(1) << place).view(np.int64)
            columns = [np.mod(h, blocks), *mask.T.copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", *(f"w{i}" for i in range(WORDS))])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    rows = terms.mapInArrow(masks, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]).collect()
    table = np.zeros((blocks, WORDS), np.int64)
    for r in rows:
        table[r[0]] = r[1:]
    return table.view(np.uint64)


def vectors(docs: DataFrame, table, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(shard, doc_id, n, terms, counts) of every document with a term; ``terms`` are those that the filter passes.

    ``n`` counts all terms with repeats.  Documents are dealt evenly into shards.
    """

    @lean
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        number = TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, SLICE_BYTES):
                ids, sizes, found, counts = [], [], [], []
                for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["body"].to_pylist()):
                    words = terms_of(text)
                    if not words:
                        continue
                    tf = Counter(words)
                    new = [w for w in tf if w not in known]
                    if new:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                            new = list(tf)
                        known.update(zip(new, may_hold(table.value, *keys(new)).tolist()))
                    kept = [w for w in tf if known[w]]
                    ids.append(doc_id)
                    sizes.append(len(words))
                    found.append([w.decode() for w in kept])
                    counts.append([tf[w] for w in kept])
                shard = (number + np.arange(len(ids))) % shards
                number += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())),
                    ],
                    ["shard", "doc_id", "n", "terms", "counts"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")).where("body is not null")
    return rows.mapInArrow(made, "shard long, doc_id long, n long, terms array<string>, counts array<long>")


class Shard:
    """An inverted index of some documents: each term's postings lie in blocks with summaries."""

    def __init__(self, docs: list[tuple[int | None, list[str], list[int], int]]) -> None:
        """``docs`` are (doc_id, terms, counts, m)."""
        self.named = np.array([d[0] is not None for d in docs], bool)
        self.ids = np.array([d[0] or 0 for d in docs], np.int64)
        self.number: dict[str, int] = {}
        number = self.number
        flat = [number.setdefault(t, len(number)) for d in docs for t in d[1]]
        self.term = np.array(flat, np.int64)
        sizes = np.array([len(d[1]) for d in docs], np.int64)
        self.begin = np.r_[0, np.cumsum(sizes)]
        tf = np.array([c for d in docs for c in d[2]], np.int64)
        m = np.repeat(np.array([d[3] for d in docs], np.int64), sizes)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m)
        self._lists(np.repeat(np.arange(len(docs)), sizes))

    def _lists(self, doc: np.ndarray) -> None:
        n_docs, n_terms = len(self.ids), len(self.number)
        # The commonest terms have coordinates of their own.
        held = np.bincount(self.term, minlength=n_terms)
        rank = np.empty(n_terms, np.int64)
        rank[np.argsort(-held, kind="stable")] = np.arange(n_terms)
        self.coordinate = rank % COORDINATES
        width = min(n_terms, COORDINATES)
        # Impacts are at most a million; in bytes they are rounded up, so that a bound stays one.
        self.unit = int(self.impact.max(initial=0)) // 255 + 1
        dense = np.zeros((n_docs, width), np.uint8)
        level = (-(-self.impact // self.unit)).astype(np.uint8)
        order = np.argsort(level, kind="stable")
        dense[doc[order], self.coordinate[self.term[order]]] = level[order]
        signs = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), size=(n_terms, SKETCH))
        sketch = np.zeros((n_docs, SKETCH), np.float32)
        weight = self.impact / np.maximum(held[self.term], 1)
        for k in range(SKETCH):
            sketch[:, k] = np.bincount(doc, weights=weight * signs[self.term, k], minlength=n_docs)
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

        by_term = np.argsort(self.term, kind="stable")
        docs = doc[by_term]
        ends = np.r_[0, np.cumsum(held)]
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.term, self.impact)
        label = np.zeros(len(docs), np.int64)
        for t in np.flatnonzero(held > BLOCK_DOCS).tolist():
            a, b = int(ends[t]), int(ends[t + 1])
            mine = sketch[docs[a:b]]
            # Documents of the list itself, evenly chosen, are the centres.
            centres = mine[np.linspace(0, b - a - 1, -(-(b - a) // BLOCK_DOCS)).astype(np.int64)]
            label[a:b] = np.argmax(mine @ centres.T, axis=1)
        order = np.lexsort((docs, label, np.repeat(np.arange(n_terms), held)))
        self.docs, label = docs[order], label[order]
        term = np.repeat(np.arange(n_terms), held)
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (label[1:] != label[:-1])]) if len(term) else term
        self.block = np.r_[first, len(self.docs)]
        # Blocks of term t are those from list_begin[t] on.
        self.list_begin = np.searchsorted(first, ends)
        self.summary = np.zeros((len(first), width), np.uint8)
        at = 0
        while at < len(first):
            upto = max(at + 1, int(np.searchsorted(self.block, self.block[at] + GATHER, side="right")) - 1)
            lo, hi = self.block[at], self.block[upto]
            self.summary[at:upto] = np.maximum.reduceat(dense[self.docs[lo:hi]], self.block[at:upto] - lo, axis=0)
            at = upto

    def search(self, weights: dict[str, int], top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the ``top`` best documents of a score above 0, and how many were scored.

        Lists are taken by descending greatest contribution.  A document that
        is only in the lists left scores no more than the sum of theirs; one of
        a block no more than the block's summary allows.  Either is skipped
        only if that is less than the ``top``-th score so far.
        """
        q = [(self.number[t], w) for t, w in weights.items() if w > 0 and t in self.number]
        q.sort(key=lambda x: (-x[1] * int(self.most[x[0]]), x[0]))
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not q:
            return best, scores, 0
        term = np.array([t for t, _ in q])
        weight = np.array([w for _, w in q], np.int64)
        whole = np.zeros(len(self.number), np.int64)
        whole[term] = weight
        rest = np.cumsum((weight * self.most[term])[::-1])[::-1]
        columns, into = np.unique(self.coordinate[term], return_inverse=True)
        # Terms of one coordinate share its maximum.
        by_column = np.zeros(len(columns), np.int64)
        np.add.at(by_column, into, weight)
        by_column = (by_column * self.unit).astype(np.float64)
        seen = np.zeros(len(self.ids), bool)
        least, scored = 1, 0
        for j, t in enumerate(term.tolist()):
            if rest[j] < least:
                break
            blocks = np.arange(self.list_begin[t], self.list_begin[t + 1])
            bound = self.summary[blocks][:, columns] @ by_column
            order = np.argsort(-bound, kind="stable")
            blocks, bound = blocks[order], bound[order]
            at, step = 0, 2
            while at < len(blocks) and bound[at] >= least:
                upto = min(at + step, int(np.searchsorted(-bound, -least, side="right")))
                docs = np.concatenate([self.docs[self.block[b] : self.block[b + 1]] for b in blocks[at:upto].tolist()])
                at, step = upto, step * 2
                docs = docs[~seen[docs]]
                if not len(docs):
                    continue
                seen[docs] = True
                scored += len(docs)
                best, scores = np.r_[best, docs], np.r_[scores, self._exact(docs, whole)]
                if len(best) > top:
                    kth = np.partition(scores, len(scores) - top)[len(scores) - top]
                    near = scores >= kth
                    best, scores = best[near], scores[near]
                    least = max(1, int(kth))
        ranked = np.lexsort((self.ids[best], ~self.named[best], -scores))[:top]
        ranked = ranked[scores[ranked] > 0]
        return best[ranked], scores[ranked], scored

    def _exact(self, docs: np.ndarray, whole: np.ndarray) -> np.ndarray:
        begin, size = self.begin[docs], self.begin[docs + 1] - self.begin[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        return np.add.reduceat(whole[self.term[at]] * self.impact[at], ends - size)


def searched(placed: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): each item's best documents of each shard; a shard's documents come before the items."""

    @lean
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, shard = None, [], None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                if row["shard"] != number:
                    number, held, shard = row["shard"], [], None
                if row["kind"] == 0:
                    m = 50 + 50 * row["n"] * n_docs // n_terms
                    held.append((row["id"], row["terms"], row["counts"], m))
                    continue
                if shard is None:
                    shard, held = Shard(held), []
                places, scores, _ = shard.search(dict(zip(row["terms"], row["counts"])), top)
                out[0].extend([row["id"]] * len(places))
                out[1].extend(i if known else None for i, known in zip(shard.ids[places].tolist(), shard.named[places].tolist()))
                out[2].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    return placed.mapInArrow(run, "item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Each item's ``top`` documents of highest score above 0: (item_id, rank, doc_id, score).

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, A to Z in lower case.  With N documents that have a term, L terms in
    all of them, and df documents that hold a term, its weight is
    floor(1000 * ln((2N + 2) / (2 df + 1))).  A document of n terms that holds
    it tf times adds the weight times (10^9 tf) div (1000 tf + 20 m), where m is
    50 + (50 n N) div L, once for each different term of the item.

    The documents' postings of terms that any item asks for (a bounded Bloom
    filter passes them, and perhaps others) are dealt evenly into shards of
    bounded size.  In a shard, each term's postings are grouped into blocks of
    similar documents; a block's summary has the greatest impact in every
    coordinate.  Blocks are skipped only where the summary's bound is below
    what an item's best have already, so results are exact.  The shards' best
    are merged.

    Equal scores go to the smaller id, documents without id last.  Null texts
    have no terms.  Each repeated row is a document of its own; items of one id
    are one item.  An item without terms, or whose terms no document holds, has
    no rows.  Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_id, item_text), "item-terms")
    kinds = asked.select("term").distinct()
    table = spark.sparkContext.broadcast(term_filter(kinds, kinds.count()))
    shards = max(1, -(-docs.count() // shard_docs))
    found = stored(vectors(docs, table, shards, id_col, text_col), "term-vectors")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()

    df = found.select(F.explode("terms").alias("of")).groupBy("of").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, F.col("term") == F.col("of")).select("item_id", "term", weight.alias("w"))
    lists = weighted.where("w > 0").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("q"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    queries = lists.select(
        everywhere.alias("shard"), F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("n"),
        F.col("q.term").alias("terms"), F.col("q.w").alias("counts"),
    )
    held = found.where(F.size("terms") > 0).select(
        "shard", F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "n", "terms", "counts"
    )
    placed = held.unionByName(queries).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "kind")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = searched(placed, n_docs, n_terms, top).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH found AS (
  SELECT row_number() OVER () AS d, doc_id,
         list_transform(regexp_extract_all(text, '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+'),
           lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
  FROM documents WHERE text IS NOT NULL
),
texts AS (SELECT d, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM texts),
counts AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM texts) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
),
asked AS (
  SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id,
    unnest(regexp_extract_all(text, '[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+')) AS term FROM benchmark)
),
scores AS (
  SELECT item_id, d, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term), totals
  GROUP BY item_id, d, doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
