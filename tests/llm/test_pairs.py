"""Repeated strings, near copies and license finds against brute force."""

import hashlib
import random

import pytest

from voxelloom.llm import graph, jaccard, licenses, suffixes, wordhash

from .samples import documents, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, size, lower=True):
    w = (text or "").encode()
    w = (w.translate(LOWER) if lower else w).split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_copies(rng, n):
    base = [prose(s, rng.randint(30, 160)).split() for s in range(8)]
    shared = prose(99, 50)
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6, 20])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append((i, " ".join(w) + (" " + shared if rng.random() < 0.3 else ""), "a"))
    return out


def test_shingle_hashes_agree_with_word_tuples():
    rng = random.Random(1)
    for _ in range(60):
        texts = [bytes(rng.choice(b" \t\nabAB\xc3\xa9.\x0b\x1c") for _ in range(rng.choice([0, 1, 3, 30, 200]))) for _ in range(5)]
        sets = list(wordhash.shingle_sets(texts, 4, True))
        want = []
        for t in texts:
            w = t.translate(LOWER).split()
            want.append(set(zip(*[w[k:] for k in range(4)])) if len(w) >= 4 else ({tuple(w)} if w else set()))
        for a, x in zip(sets, want):
            for b, y in zip(sets, want):
                assert len(set(a.tolist()) & set(b.tolist())) == len(x & y)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    of = {x: x for pair in links for x in pair}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    joined = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent,size,common", [(85, 4, 32), (80, 5, 3)])
def test_jaccard_components(spark, monkeypatch, percent, size, common):
    monkeypatch.setattr(jaccard, "COMMON_TEXTS", common)
    rows = near_copies(random.Random(percent), 120)
    rows += [(500, "", "a"), (501, None, "a"), (502, "one two", "a"), (503, "ONE  two", "a"), (504, " \n", "a"), (None, rows[0][1], "a")]
    # Repeated rows, and one id with two texts.
    rows += [rows[3], (700, rows[1][1], "a"), (700, rows[2][1], "a")]
    sets = [(i, shingles(t, size)) for i, t, _ in rows]
    of = {i: i for i, _ in sets if i is not None}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    got = sorted(
        (tuple(r) for r in jaccard.jaccard_components(documents(spark, rows, node="x", n="y"), percent, size).collect()), key=str
    )
    assert got == sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_bitmap_bound_is_never_too_low():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (a, b))
        bound = jaccard.overlap_bounds(x, len(a), y, np.int64(len(b)))
        assert bound >= len(np.intersect1d(a, b))


def removed(rows, depth):
    """(id, bytes, removed, runs, kept digest) in order of id, text."""
    seen, out = set(), []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            if w in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((i, len(b), gone.count(1), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeated_strings(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP_PLACES", group)
    monkeypatch.setattr(suffixes, "CROWDED", 20)
    rng = random.Random(4)
    rows = near_copies(rng, 60)
    rows += [(900, "a" * 700, "a"), (901, "ab" * 200 + "a" * 150, "a"), (902, None, "a"), (903, "", "a"), (904, "ü" * 90, "a")]
    rows += [(905, rows[5][1] * 2, "a"), (None, rows[6][1], "a"), (906, "x" * 99, "a"), (907, "x" * 99, "a")]
    got = sorted((tuple(r) for r in suffixes.digests(documents(spark, rows, body="x", d="y")).collect()), key=str)
    assert got == removed(rows, 100)


@pytest.mark.parametrize("depth", [5, 32, 160, 300])
def test_repeated_strings_of_any_depth(spark, depth):
    rng = random.Random(depth)
    rows = near_copies(rng, 25)
    shared = prose(77, 120)
    rows += [(800, prose(5, 30) + shared, "a"), (801, shared[:700] + prose(6, 20), "a"), (802, "b" * 900, "a")]
    rows += [(803, shared[100:399], "a"), (804, shared[100:400], "a")]
    got = sorted((tuple(r) for r in suffixes.digests(documents(spark, rows), depth).collect()), key=str)
    assert got == removed(rows, depth)


def test_depths_that_do_not_fit_raise(spark):
    df = documents(spark, [(1, "x", "a")])
    for depth in (0, 70_000):
        with pytest.raises(ValueError):
            suffixes.digests(df, depth)


def test_windows_are_told_apart_by_their_bytes():
    import numpy as np

    rng = np.random.default_rng(8)
    for depth in (1, 3, 8, 9, 16, 100):
        data = rng.integers(0, 2, 400 + depth).astype(np.uint8)
        data[50 : 50 + depth] = data[200 : 200 + depth]
        at = np.sort(rng.integers(0, 400, 150))
        group = rng.integers(0, 3, 150)
        seen, want = set(), []
        for g, a in zip(group.tolist(), at.tolist()):
            key = (g, bytes(data[a : a + depth]))
            want.append(key in seen)
            seen.add(key)
        assert suffixes.later_equal(group, at, data, depth).tolist() == want


def test_repeated_rows_of_one_id(spark):
    text = prose(1, 60)
    rows = [(1, text, "a"), (1, text, "a"), (1, prose(2, 60), "a"), (2, text, "a")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.digests(documents(spark, rows)).collect())
    sizes = [len(text), len(text), len(prose(2, 60))]
    assert sum(r[2] for r in got) == 2 * len(text) and [r[0] for r in got] == [1, 1, 1, 2]
    assert sorted(r[1] for r in got[:3]) == sorted(sizes) and got[3][2] == len(text)


def test_texts_of_one_id_are_told_apart(spark, monkeypatch):
    def text(i):
        return "".join(hashlib.sha256(f"{kind}{i}".encode()).hexdigest() for kind in ("", "b"))

    # Two pairs of texts whose xxhash64 agree in 31 bits; only the first of each repeats an earlier text.
    rows = [(1, text(110015) + text(131852), "a")]
    rows += [(i, text(k), "a") for i, k in ((None, 110015), (None, 114183), (7, 131852), (7, 298923))]
    want = removed(rows, 100)
    assert sorted(r[2] for r in want) == [0, 0, 0, 128, 128]
    df = documents(spark, rows)
    assert sorted((tuple(r) for r in suffixes.digests(df).collect()), key=str) == want
    # Keys that clash are made anew.
    made = suffixes.text_key
    monkeypatch.setattr(suffixes, "text_key", lambda body, seed: made(body, seed) % (2 if seed < 2 else 1 << 62))
    assert sorted((tuple(r) for r in suffixes.digests(df).collect()), key=str) == want


def test_long_text_in_chunks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 30_000).astype(np.uint8)
    whole = suffixes.places(data, 100, 32)
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    parts = suffixes.places(data, 100, 32)
    for found in (whole, parts):
        _, _, _, lo, _, hi = found
        assert lo[0] == 0 and hi[-1] == len(data) - 100 and (lo[1:] == hi[:-1] + 1).all()
    assert set(parts[4]) == set(whole[4])


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 12)
    half = " ".join(words[: len(words) // 2])
    rows = [
        (1, f"Über alles.\n{mit}\nend", "a"), (2, edited, "a"), (3, half, "a"), (4, "released under the mit-license", "a"),
        (5, None, "a"), (6, "", "a"), (7, prose(1, 300), "a"), (8, "All rights reserved. x y z All Rights Reserved!", "a"),
        (None, "Licensed under CC BY-NC 4.0.", "a"), (4, "released under the mit-license", "a"),
    ]
    got = {}
    for r in licenses.scan(documents(spark, rows, spans="x", coverage="y")).collect():
        got.setdefault((r.doc_id, r.license), []).append(r)
    assert got[1, "MIT"][0].coverage == 1.0
    s = got[1, "MIT"][0].spans[0]
    assert rows[0][1][s.start : s.end] == mit.strip()[:-1]
    assert 0.88 < got[2, "MIT"][0].coverage < 0.95
    assert (3, "MIT") not in got
    assert len(got[4, "MIT notice"]) == 2 and got[8, "All rights reserved"][0].n_spans == 2
    assert (None, "CC-BY-NC-4.0 notice") in got and not any(k[0] in (5, 6, 7) for k in got)


def test_license_with_inserted_passages(spark):
    words = licenses.TEMPLATES["MIT"].split()
    n = len(words)
    # Band 34: the whole text lies near the middle diagonal only.
    cut = [*words[: n // 3], *prose(1, 27).split(), *words[n // 3 : 2 * n // 3], *prose(2, 27).split(), *words[2 * n // 3 :]]
    # The first diagonal reaches the coverage, but a later one has more.
    tail = [*words[:20], *prose(3, 30).split(), *words[20 : n - 20], *prose(4, 30).split(), *words[n - 20 :]]
    rows = [(1, " ".join(cut), "a"), (2, " ".join(tail), "a"), (3, " ".join([*cut, *prose(5, 200).split(), *cut]), "a")]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).where("license = 'MIT'").collect()}
    for i, text, _ in rows[:2]:
        assert got[i].coverage == 1.0 and [(s.start, s.end) for s in got[i].spans] == [(0, len(text.rstrip(".")))]
    assert got[3].coverage == 1.0 and got[3].n_spans == 2


def test_band_alignment_agrees_with_full_table():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(100):
        t = rng.integers(0, 6, 12).astype(np.uint64)
        w = np.delete(t, rng.integers(0, 12, 2))
        w = np.r_[rng.integers(6, 9, 3).astype(np.uint64), np.insert(w, 4, 9)]
        full = np.zeros((len(t) + 1, len(w) + 1), int)
        for i in range(len(t)):
            for j in range(len(w)):
                full[i + 1, j + 1] = max(full[i, j + 1], full[i + 1, j], full[i, j] + (t[i] == w[j]))
        count, first, last = licenses.align(t, w, 3, 8)
        assert count == full[-1, -1]
        assert w[first] in t and w[last] in t and first <= last


def test_odd_tables(odd, spark):
    n = odd.count()
    assert jaccard.jaccard_components(odd).count() == n
    got = sorted((tuple(r) for r in suffixes.digests(odd).collect()), key=str)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got == removed(rows, 100)
    kept = suffixes.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == n
    licenses.scan(odd).collect()
    none = odd.limit(0)
    for made in (jaccard.jaccard_components(none), suffixes.digests(none), licenses.scan(none)):
        assert made.count() == 0
