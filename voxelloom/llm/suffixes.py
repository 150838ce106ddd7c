"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitfilter import with_may
from .common import kept_in_worker, lean, slices, stored
from .wordhash import mixed

# Strings of so many bytes count as repeated.
DEPTH = 100
# The first digit: bytes of the string that is least by hash among those of a window.
DIGIT = 32
# Windows that are worked on at once.
CHUNK = 1 << 17
# Bits of a place for each of its two widths; a window may be that much longer than the first digit.
WIDTH_BITS = 16
WIDEST = (1 << WIDTH_BITS) - 1
# Bytes of text whose places a worker sorts at once.
SLICE_BYTES = 4 << 20
# First digits that so many places of one slice of texts share are dealt out by the second digit too.
CROWDED = 32
MOST_CROWDED = 65_536
SALTS = 64
# Places of one group that a task sorts; larger groups are sorted by rows of Spark.
GROUP_PLACES = 20_000
# Places of one text, and bytes of contexts, that a worker has at hand at once.
CUT_PLACES = 20_000
CONTEXT_BYTES = 2 << 20
# Texts that are cut at once.
CUT_TEXTS = 200

own = partial(lean, owner="suffixes")

_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
NO_ID = (1 << 63) - 1
SPAN = "array<struct<a:long,b:long>>"


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers of each byte, and the powers of the base up and down."""

    def make():
        n = CHUNK + WIDEST + 1
        bytes_ = np.arange(1, 257, dtype=np.uint64)
        first, second = mixed(bytes_ * np.uint64(_BASE)), mixed(mixed(bytes_ * np.uint64(_OTHER)))
        up = np.cumprod(np.full(n, np.uint64(_BASE)))
        down = np.cumprod(np.full(n, np.uint64(pow(_BASE, -1, 2**64))))
        return first, second, up, down

    return kept_in_worker("suffixes", (CHUNK,), make)


def prefix_sums(data: np.ndarray, second: bool = False) -> np.ndarray:
    """Sums from which a hash of any substring follows; there are two hashes that do not depend on each other."""
    table, other, up, _ = _powers()
    return np.r_[np.uint64(0), np.cumsum((other if second else table)[data] * up[: len(data)])]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def check_depth(depth: int, digit: int) -> int:
    """The first digit for windows of ``depth`` bytes; it is no longer than they are."""
    if depth < 1 or digit < 1:
        raise ValueError("depth and digit must be positive")
    digit = min(digit, depth)
    if depth - digit > WIDEST:
        raise ValueError(f"windows may be {WIDEST} bytes longer than the first digit at most, not {depth - digit}")
    return digit


def places(data: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """The places through which a text's windows are sorted: (g, c, c2, lo, at, hi), ascending.

    Each window of ``depth`` bytes is held by the leftmost of its ``digit``-byte
    strings of least hash, so equal windows are held at equal offsets.  A place
    at byte ``at`` holds the windows that start from ``lo`` to ``hi``; ``g`` is
    the hash of its string, and ``c`` and ``c2`` are 128 bits of all bytes of
    its windows.
    """
    out = []
    _, _, _, down = _powers()
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, len(data) - depth + 1, CHUNK):
        part = data[begin : begin + CHUNK + depth - 1]
        sums = prefix_sums(part)
        g = mixed((sums[digit:] - sums[:-digit]) * down[: len(part) - digit + 1])
        ranked = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(ranked, depth - digit + 1) & low).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        hi = np.r_[lo[1:] - 1, len(at) - 1]
        at = at[lo]
        shape = (((at - lo) << WIDTH_BITS) + (hi - lo)).astype(np.uint64)
        c = mixed(mixed((sums[hi + depth] - sums[lo]) * down[lo]) + shape)
        sums = prefix_sums(part, second=True)
        c2 = mixed(mixed((sums[hi + depth] - sums[lo]) * down[lo]) + shape)
        out.append((g[at], c, c2, lo + begin, at + begin, hi + begin))
    if not out:
        none = np.zeros(0, np.int64)
        return (*[none.astype(np.uint64)] * 3, none, none, none)
    return tuple(np.concatenate(x) for x in zip(*out))


def pack_place(lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo << 2 * WIDTH_BITS) | ((at - lo) << WIDTH_BITS) | (hi - lo)


def _batch_places(batch: pa.RecordBatch, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """(g, c, c2, d, tie, place) of all texts of a batch."""
    d, tie = batch["d"].to_numpy(), batch["tie"].to_numpy()
    parts, n = [], []
    for text in batch["body"].to_pylist():
        g, c, c2, lo, at, hi = places(np.frombuffer(text.encode(), np.uint8), depth, digit)
        parts.append((g, c, c2, pack_place(lo, at, hi)))
        n.append(len(g))
    g, c, c2, place = (np.concatenate(x) for x in zip(*parts))
    return g, c, c2, np.repeat(d, n), np.repeat(tie, n), place


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, SLICE_BYTES)


def _rows(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns]
    return pa.RecordBatch.from_arrays(arrays, names.split())


def crowded_digits(rows: DataFrame, depth: int, digit: int) -> np.ndarray:
    """First digits with very many places, ascending; only how rows are dealt out depends on them."""

    @own
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            g, n = np.unique(_batch_places(batch, depth, digit)[0], return_counts=True)
            yield _rows("g n", g[n >= CROWDED], n[n >= CROWDED])

    most = (
        rows.mapInArrow(counted, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "g").limit(MOST_CROWDED).collect()
    )
    return np.sort(np.array([r[0] for r in most], np.int64).view(np.uint64))


def dealt(rows: DataFrame, crowded: np.ndarray, depth: int, digit: int) -> DataFrame:
    """(deal, done, g, c, c2, d, tie, place) of every place; a batch's later copies are done already."""

    @own
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            g, c, c2, d, tie, place = _batch_places(batch, depth, digit)
            order = np.lexsort((place, tie, d, mixed(g + c)))
            g, c, c2, d, tie, place = (x[order] for x in (g, c, c2, d, tie, place))
            done = np.zeros(len(g), bool)
            done[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1]) & (c2[1:] == c2[:-1])
            spread = np.isin(g, crowded)
            deal = mixed(np.where(spread, g + c % np.uint64(SALTS), g))
            deal = np.where(done, mixed(d.view(np.uint64) + place.view(np.uint64)), deal)
            g, c, c2 = (np.where(done, np.uint64(0), x) for x in (g, c, c2))
            yield _rows("deal done g c c2 d tie place", deal, done, g, c, c2, d, tie, place)

    return rows.mapInArrow(made, "deal long, done boolean, g long, c long, c2 long, d long, tie long, place long")


def second_pass(sorted_rows: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(open, g, d, tie, place) from places in the order of (done, g, c, c2, d, tie, place).

    Places alike in both digits hold equal windows only: all but the first are
    repeats.  The second digit is taken as 128 bits of two hashes.  Where a
    first digit has several second ones, the first place of each stays open.
    All others hold no repeat.  Runs are followed over batches with one row in
    hand.
    """

    @own
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "open g d tie place"
        last = None  # digits of the row before
        waiting = None  # the only first place of the current first digit, not yet open
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch["done"].to_numpy(zero_copy_only=False)
            g, c, c2, d, tie, place = (batch[x].to_numpy() for x in ("g", "c", "c2", "d", "tie", "place"))
            if done.any():
                yield _rows(names, np.zeros(done.sum(), bool), g[done], d[done], tie[done], place[done])
                g, c, c2, d, tie, place = (x[~done] for x in (g, c, c2, d, tie, place))
            if not len(g):
                continue
            new_g = np.r_[last is None or g[0] != last[0], g[1:] != g[:-1]]
            other = np.r_[last is None or (c[0], c2[0]) != last[1:], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])]
            new_c = new_g | other
            again = ~new_c
            yield _rows(names, np.zeros(again.sum(), bool), g[again], d[again], tie[again], place[again])
            run = np.cumsum(new_g)
            kinds = np.bincount(run, weights=new_c, minlength=run[-1] + 1).astype(np.int64)
            # Run 0 goes on from the batch before; there it had one kind that waits, or several.
            goes_on = last is not None and not new_g[0]
            if goes_on:
                if waiting is None:
                    kinds[0] += 2
                else:
                    kinds[0] += 1
                    if kinds[0] > 1:
                        yield _rows(names, np.array([True]), *waiting)
            opened = new_c & ((kinds[run] > 1) | np.isin(g.view(np.uint64), crowded))
            yield _rows(names, np.ones(opened.sum(), bool), g[opened], d[opened], tie[opened], place[opened])
            tail = run[-1]
            if not (tail == 0 and goes_on and kinds[0] == 1):
                alone = np.flatnonzero((run == tail) & new_c & ~opened)
                waiting = tuple(x[alone] for x in (g, d, tie, place)) if len(alone) else None
            last = (g[-1], c[-1], c2[-1])

    return sorted_rows.mapInArrow(split, "open boolean, g long, d long, tie long, place long")


def contexts(rows: DataFrame, opened: DataFrame, depth: int) -> DataFrame:
    """(g, large, d, tie, place, bytes) of open places, read from their texts."""
    sizes = opened.groupBy("g").count().where(F.col("count") > GROUP_PLACES).select(F.col("g").alias("of"))
    marked = opened.join(sizes, F.col("g") == F.col("of"), "left").withColumn("large", F.col("of").isNotNull())
    wanted = stored(
        marked.groupBy("d", "tie").agg(F.collect_list(F.struct("g", "large", "place")).alias("wanted")), "open-places"
    ).withColumnsRenamed({"d": "of_d", "tie": "of_tie"})
    held = with_may(rows, wanted, "of_d", "d").where("may").join(
        wanted, (F.col("d") == F.col("of_d")) & (F.col("tie") == F.col("of_tie"))
    )
    names = ["g", "large", "d", "tie", "place", "bytes"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    @own
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            for i in range(batch.num_rows):
                d, tie, body = (batch[x][i].as_py() for x in ("d", "tie", "body"))
                want, data = batch["wanted"][i].values, body.encode()
                place = want.field("place").to_numpy()
                lo, size = place >> 2 * WIDTH_BITS, (place & WIDEST) + depth
                for at in range(0, len(place), CUT_PLACES):
                    some = slice(at, at + CUT_PLACES)
                    held = [data[a : a + n] for a, n in zip(lo[some].tolist(), size[some].tolist())]
                    n = len(held)
                    columns = (want.field("g")[some], want.field("large")[some], [d] * n, [tie] * n, place[some], held)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return held.select("d", "tie", "body", "wanted").mapInArrow(
        cut, "g long, large boolean, d long, tie long, place long, bytes binary"
    )


def _contexts(batch: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All context bytes of a batch in one array, and where each place's begin."""
    size = (batch["place"].to_numpy() & WIDEST) + depth
    return np.frombuffer(b"".join(batch["bytes"]), np.uint8), np.cumsum(size) - size


def _windows(place: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in its text, offset from the place, start in the context bytes) of every window of some places."""
    n = (place & WIDEST) + 1
    row = np.repeat(np.arange(len(place)), n)
    ends = np.cumsum(n)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    offset = ((place >> WIDTH_BITS) & WIDEST)[row] - inside
    return row, (place >> 2 * WIDTH_BITS)[row] + inside, offset, begin[row] + inside


def digits_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, most significant first; beyond the end they are 0."""
    wide = np.zeros(len(data) + 7, np.uint64)
    wide[: len(data)] = data
    pairs = (wide[:-1] << np.uint64(8)) | wide[1:]
    fours = (pairs[:-2] << np.uint64(16)) | pairs[2:]
    return (fours[:-4] << np.uint64(32)) | fours[4:]


def later_equal(group: np.ndarray, at: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Which windows equal an earlier one of their group in all ``depth`` bytes; windows come in order.

    Windows are sorted by eight bytes at a time, most significant first.  Those
    alone among the equal ones so far are dropped at each pass, so what is left
    after the last pass are exactly the repeated windows.
    """
    out = np.zeros(len(group), bool)
    digits = digits_of(data)
    left, kind = np.arange(len(group)), group
    # The last digit may overlap the one before: what it repeats is equal already.
    steps = [*range(0, max(depth - 8, 0), 8), max(depth - 8, 0)]
    short = np.uint64(8 * max(8 - depth, 0))
    for step in steps:
        value = digits[at[left] + step] >> short
        order = np.lexsort((value, kind))
        left, kind, value = left[order], kind[order], value[order]
        new = np.ones(len(left), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])
        alone = new & np.r_[new[1:], True]
        left, kind = left[~alone], np.cumsum(new)[~alone]
        if not len(left):
            return out
    # The sort is stable, so the first window of each kind is the earliest.
    out[left[1:]] = kind[1:] == kind[:-1]
    return out


def repeated_windows(held: DataFrame, depth: int) -> DataFrame:
    """(d, tie, a, b): byte ranges of the open places' windows that some earlier place has too."""
    names = ["d", "tie", "a", "b"]
    schema = "d long, tie long, a long, b long"

    def ranges(batch: pd.DataFrame, row: np.ndarray, start: np.ndarray) -> pd.DataFrame:
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else row
        last = np.r_[new[1:] - 1, len(row) - 1] if len(row) else row
        of = batch.iloc[row[new]]
        made = [of["d"].to_numpy(), of["tie"].to_numpy(), start[new], start[last] + depth]
        return pd.DataFrame(dict(zip(names, made)))

    def resolved(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole groups in order; a few at a time, one at least."""
        g = batch["g"].to_numpy()
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = (batch["place"].to_numpy() & WIDEST) + depth
        held = np.cumsum(size)[np.r_[first[1:] - 1, len(g) - 1]]
        part = held // CONTEXT_BYTES
        cuts = [0, *first[np.flatnonzero(part[1:] != part[:-1]) + 1].tolist(), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = batch.iloc[a:b]
            data, begin = _contexts(some, depth)
            row, start, offset, at = _windows(some["place"].to_numpy(), begin)
            run = np.cumsum(np.r_[0, g[a + 1 : b] != g[a : b - 1]])
            repeat = later_equal((run[row] << WIDTH_BITS) + offset, at, data, depth)
            yield ranges(some, row[repeat], start[repeat])

    @own
    def small(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sort whole groups; the last group of a batch waits for its rest."""
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            ends = batch["g"].to_numpy() != batch["g"].iloc[-1]
            whole, rest = batch[ends].reset_index(drop=True), batch[~ends].reset_index(drop=True)
            if len(whole):
                yield from resolved(whole)
        if rest is not None and len(rest):
            yield from resolved(rest)

    @own
    def exploded(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, _, down = _powers()
        for batch in batches:
            for at in range(0, len(batch), CUT_PLACES):
                some = batch.iloc[at : at + CUT_PLACES]
                data, begin = _contexts(some, depth)
                row, start, offset, at_byte = _windows(some["place"].to_numpy(), begin)
                hashed = [np.zeros(len(row), np.uint64) for _ in range(2)]
                # Sums start anew at each place, so the bytes of a batch may be many.
                edge = np.r_[begin, len(data)]
                where = np.searchsorted(row, np.arange(len(some) + 1))
                for i in range(len(some)):
                    lo, hi = where[i], where[i + 1]
                    inside = at_byte[lo:hi] - edge[i]
                    for k in range(2):
                        sums = prefix_sums(data[edge[i] : edge[i + 1]], bool(k))
                        hashed[k][lo:hi] = mixed((sums[inside + depth] - sums[inside]) * down[inside])
                of = some.iloc[row]
                yield pd.DataFrame({
                    "g": of["g"].to_numpy(), "offset": offset, "h": hashed[0].view(np.int64), "h2": hashed[1].view(np.int64),
                    "d": of["d"].to_numpy(), "tie": of["tie"].to_numpy(), "s": start,
                })

    placed = held.where("not large").repartition("g").sortWithinPartitions("g", "d", "tie", "place")
    found = placed.mapInPandas(small, schema)
    # A group too large for one task: its windows are rows, told apart by 128 bits.
    rows = held.where("large").mapInPandas(exploded, "g long, offset long, h long, h2 long, d long, tie long, s long")
    key = ["g", "offset", "h", "h2"]
    first = rows.groupBy(*key).agg(F.min(F.struct("d", "tie", "s")).alias("first"))
    large = rows.join(first, key).where(F.struct("d", "tie", "s") != F.col("first"))
    return found.unionByName(large.select("d", "tie", F.col("s").alias("a"), (F.col("s") + depth).alias("b")))


def merged(spans, n_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], min(s["b"], n_bytes)) for s in (spans if spans is not None else ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def text_key(body: Column, seed: int) -> Column:
    """64 bits that tell texts of one id apart."""
    return F.xxhash64(F.lit(seed), body)


def clear_seed(docs: DataFrame, d: Column, body: Column) -> int:
    """The first seed at which no two different texts of one id share a key."""
    seed = 0
    while True:
        texts = docs.select(
            d.alias("d"), text_key(body, seed).alias("tie"), F.sha2(body.cast("binary"), 256).alias("digest")
        ).dropDuplicates()
        if texts.groupBy("d", "tie").count().where("count > 1").isEmpty():
            return seed
        seed += 1


def with_spans(
    docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, repeat_spans): each row whole, and its byte ranges of strings that also start earlier, null for none.

    Suffixes are sorted by their first ``depth`` bytes only, most significant
    digit first, and groups of one are dropped at each pass:

    1. The first digit is the string of ``digit`` bytes with the least hash
       within the window, wherever it lies: windows that hold the same one at
       the same offset go on together, as one place.
    2. The second digit is all that a place's windows span, as 128 bits of two
       hashes.  Places equal in both are repeats of the first of them.
    3. First places of different second digits share some windows at most;
       their windows are sorted by their bytes, eight at a time, until all
       ``depth`` are equal or a window is alone.

    Earlier means a smaller id, or an earlier start in the same text; rows
    without id come last, and texts of equal id in a fixed order.  Of fully
    equal rows one counts as the first.  Matches never cross texts, ranges may
    overlap, null texts are empty, shorter texts than ``depth`` have none.  An
    empty table gives an empty result.  ``row`` holds all columns of ``docs``.
    """
    spark = docs.sparkSession
    digit = check_depth(depth, digit)
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.groupBy(d.alias("d")).count()
    plain = ids.where((F.col("count") > 1) | (F.col("d") == NO_ID)).isEmpty()
    # Where ids repeat or are null, the key tells their texts apart without a clash.
    tie = F.lit(0).cast("long") if plain else text_key(body, clear_seed(docs, d, body))
    rows = docs.select(d.alias("d"), tie.alias("tie"), body.alias("body"))
    if not plain:
        rows = rows.dropDuplicates()

    crowded = spark.sparkContext.broadcast(crowded_digits(rows, depth, digit)).value
    sorted_rows = dealt(rows, crowded, depth, digit).repartition("deal").sortWithinPartitions(
        "done", "g", "c", "c2", "d", "tie", "place"
    )
    split = stored(second_pass(sorted_rows.drop("deal"), crowded), "places")
    held = stored(contexts(rows, split.where("open").drop("open"), depth), "contexts")
    start = F.shiftright("place", 2 * WIDTH_BITS)
    whole = split.where("not open").select(
        "d", "tie", start.alias("a"), (start + F.col("place").bitwiseAND(WIDEST) + depth).alias("b")
    )
    spans = whole.unionByName(repeated_windows(held, depth))
    per_text = stored(
        spans.groupBy("d", "tie").agg(F.collect_list(F.struct("a", "b")).alias("repeat_spans")), "spans"
    ).withColumnsRenamed({"d": "of_d", "tie": "of_tie"})

    # Texts that surely have no spans are not moved.  A row stays in one column, so its names meet no others.
    whole_rows = docs.select(F.struct("*").alias("row"), d.alias("d"), tie.alias("tie"), body.alias("body"))
    whole_rows = with_may(whole_rows, per_text, "of_d", "d")
    joined = whole_rows.where("may").join(per_text, (F.col("d") == F.col("of_d")) & (F.col("tie") == F.col("of_tie")), "left")
    columns = ["row", "d", "tie", "body", "repeat_spans"]
    out = joined.select(*columns).unionByName(
        whole_rows.where("not may").withColumn("repeat_spans", F.lit(None).cast(SPAN)).select(*columns)
    )
    if not plain:
        copy = F.row_number().over(Window.partitionBy("d", "tie", F.md5(F.col("body").cast("binary"))).orderBy("d"))
        size = F.octet_length("body").cast("long")
        all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("a"), size.alias("b")))
        out = out.withColumn("copy", copy).withColumn(
            "repeat_spans",
            F.when((F.col("copy") > 1) & (size >= depth), all_of_it).when(F.col("copy") == 1, F.col("repeat_spans")),
        )
    return out.select("row", "repeat_spans")


def digests(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``with_spans`` removes of each row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    @own
    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            out = []
            for doc_id, body, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "body", "repeat_spans"))):
                data = body.encode()
                runs = merged(spans, len(data))
                kept = hashlib.sha256(without(data, runs)).hexdigest()
                out.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = with_spans(docs.select(id_col, text_col), depth, id_col=id_col, text_col=text_col).select(
        F.col("row")[id_col].cast("long").alias("doc_id"), F.coalesce(F.col("row")[text_col], F.lit("")).alias("body"), "repeat_spans"
    )
    return rows.mapInArrow(
        made, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, depth: int = DEPTH, text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` with the repeated bytes cut from its texts; characters cut in two go whole."""

    @F.arrow_udf("string")
    @own
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for body, spans in batches:
            out = []
            for at in range(0, len(body), CUT_TEXTS):
                for t, held in zip(body[at : at + CUT_TEXTS].to_pylist(), spans[at : at + CUT_TEXTS].to_pylist()):
                    data = t.encode()
                    out.append(without(data, merged(held, len(data))).decode(errors="ignore"))
            yield pa.array(out, pa.string())

    text = F.col("row")[text_col]
    kept = F.when(F.col("repeat_spans").isNull(), text).otherwise(
        cut(F.coalesce(text, F.lit("")), F.coalesce("repeat_spans", F.array().cast(SPAN)))
    )
    marked = with_spans(docs, depth, text_col=text_col, **columns)
    return marked.withColumn("row", F.col("row").withField(text_col, kept)).select("row.*")
