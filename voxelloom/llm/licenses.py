"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices
from .license_texts import TEMPLATES
from .wordhash import grouped, runs, word_hashes

FINGERPRINT_WORDS = 3
WINNOW = 4
COVERAGE = 0.8
# Bytes of text that a worker has as strings at once.
SLICE_BYTES = 4 << 20

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 0x20 for c in range(128)) + bytes(range(128, 256))
_PLAIN = _PLAIN.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

FOUND = (
    "doc_id long, license string, coverage double, n_spans int, "
    "spans array<struct<start:long,end:long,coverage:double>>"
)


def plain(text: str) -> bytes:
    """Lower case without ASCII punctuation, byte for byte."""
    return text.encode().translate(_PLAIN)


@dataclass
class Index:
    """Sorted fingerprints with the template and the place that each comes from."""

    names: list[str]
    words: list[np.ndarray]
    bags: list[tuple[np.ndarray, np.ndarray]]
    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray


def winnowed(hashed: np.ndarray) -> np.ndarray:
    """Places of the least fingerprint of each window of ``WINNOW``, the rightmost of equal ones."""
    n = len(hashed)
    width = min(WINNOW, n)
    windows = np.lib.stride_tricks.sliding_window_view(hashed, width)[:, ::-1]
    return np.unique(np.arange(n - width + 1) + width - 1 - windows.argmin(axis=1))


def build_index(templates: Mapping[str, str]) -> Index:
    names, words, bags, keys, template, place = [], [], [], [], [], []
    for name, text in templates.items():
        hashed = word_hashes([plain(text)])[0]
        if len(hashed) < FINGERPRINT_WORDS:
            raise ValueError(f"template {name!r} has fewer than {FINGERPRINT_WORDS} words")
        prints = runs(hashed, FINGERPRINT_WORDS)
        at = winnowed(prints)
        keys.append(prints[at])
        template.append(np.full(len(at), len(names)))
        place.append(at)
        names.append(name)
        words.append(hashed)
        bags.append(np.unique(hashed, return_counts=True))
    k, t, p = np.concatenate(keys), np.concatenate(template), np.concatenate(place)
    order = np.argsort(k, kind="stable")
    return Index(names, words, bags, k[order], t[order], p[order])


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Most template words found in order near the diagonal, and the first and last place they have.

    Template word i may be held against words i + shift - band to
    i + shift + band; words on either side may be skipped.
    """
    m, width = len(template), 2 * band + 1
    best = np.zeros((m + 1, width + 1), np.int64)
    offsets = np.arange(width)
    for i in range(m):
        at = i + shift - band + offsets
        inside = (at >= 0) & (at < len(words))
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == template[i])
        # Column j of the row before stands for one word less, so the diagonal step keeps the column.
        row = np.maximum(best[i, :width] + same, best[i, 1:])
        best[i + 1, :width] = np.maximum.accumulate(row)
    i, j = m, width - 1
    first = last = -1
    while i > 0 and best[i, j] > 0:
        if j > 0 and best[i, j] == best[i, j - 1]:
            j -= 1
        elif best[i, j] == best[i - 1, j + 1]:
            i, j = i - 1, j + 1
        else:
            first = i - 1 + shift - band + j
            last = first if last < 0 else last
            i -= 1
    return int(best[m, width - 1]), first, last


def in_common(bag: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> int:
    """How many of a template's words the text has in any order; an alignment has no more."""
    kinds, counts = bag
    at = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    return int(np.minimum(np.bincount(at[kinds[at] == words], minlength=len(kinds)), counts).sum())


def matches(hashed: np.ndarray, hits: list[tuple[int, int, int]], index: Index, least: float) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word, coverage) of one text; hits are (template, shift, place)."""
    out = []
    diagonals: dict[tuple[int, int], list[int]] = {}
    for t, shift, at in hits:
        diagonals.setdefault((t, shift), []).append(at)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    # Each diagonal is aligned, those of most hits first, but where too few words are for a find
    # or for a fuller one than that which holds all its hits.
    for (t, shift), places in sorted(diagonals.items(), key=lambda x: (x[0][0], -len(x[1]), x[0][1])):
        template = index.words[t]
        band = int(np.ceil((1 - least) * len(template))) + 1
        most = in_common(index.bags[t], hashed[max(0, shift - band) : max(0, shift + len(template) + band)])
        if most < least * len(template):
            continue
        near = [f for f in found.get(t, ()) if abs(shift - f[0]) <= band and most <= f[3]]
        if near and all(any(a <= at <= b for _, a, b, _ in near) for at in places):
            continue
        count, first, last = align(template, hashed, shift, band)
        if count >= least * len(template):
            found.setdefault(t, []).append((shift, first, last, count))
            out.append((t, first, last, count / len(template)))
    # Of overlapping finds of a template the fullest one stays.
    kept: list[tuple[int, int, int, float]] = []
    for m in sorted(out):
        if kept and kept[-1][0] == m[0] and m[1] <= kept[-1][2]:
            kept[-1] = max(kept[-1], m, key=lambda k: (k[3], -k[1]))
        else:
            kept.append(m)
    return kept


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: (doc_id, license, coverage, n_spans, spans).

    Every three-word fingerprint of a text is looked up in the index of the
    templates' winnowed ones, so a copy that keeps any of them is a candidate.
    Around every candidate's diagonal, the template is aligned in a band as wide
    as the words that may be missing, plus one; a find has ``coverage`` of the template's words in order.  ``spans`` are code
    points from the first to behind the last matched word; ``coverage`` is the
    best span's.

    Case and ASCII punctuation do not count.  Null and empty texts, and tables
    without rows, give no rows.  Repeated rows are found as often as they
    occur, rows without id keep a null id.  Other columns are ignored.
    """
    index = build_index(templates)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_spans", pa.int32()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
    ])

    @lean
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            ids = batch["doc_id"].to_pylist()
            texts = [plain(t) for t in batch["body"].to_pylist()]
            out = []
            for first, held in grouped(texts):
                hashed, of, at, size = word_hashes(held)
                prints = runs(hashed, FINGERPRINT_WORDS)
                low = np.searchsorted(index.keys, prints, side="left")
                near = np.minimum(low, len(index.keys) - 1)
                hit = np.flatnonzero((index.keys[near] == prints) & (of[: len(prints)] == of[len(of) - len(prints) :]))
                edges = np.searchsorted(of, np.arange(len(held) + 1))
                per_text: dict[int, list[tuple[int, int, int]]] = {}
                for p in hit.tolist():
                    text, k = int(of[p]), int(low[p])
                    inner = p - int(edges[text])
                    while k < len(index.keys) and index.keys[k] == prints[p]:
                        per_text.setdefault(text, []).append((int(index.template[k]), inner - int(index.place[k]), inner))
                        k += 1
                for text, hits in per_text.items():
                    a, b = edges[text], edges[text + 1]
                    finds = matches(hashed[a:b], hits, index, coverage)
                    if not finds:
                        continue
                    # Code points before each byte, from the bytes that begin one.
                    points = np.r_[0, np.cumsum((np.frombuffer(held[text], np.uint8) & 0xC0) != 0x80)]
                    rows: dict[int, list[dict]] = {}
                    for t, w, x, share in finds:
                        span = {"start": int(points[at[a + w]]), "end": int(points[at[a + x] + size[a + x]]), "coverage": share}
                        rows.setdefault(t, []).append(span)
                    for t, spans in rows.items():
                        best = max(s["coverage"] for s in spans)
                        out.append((ids[first + text], index.names[t], best, len(spans), spans))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(found, FOUND)
