"""Ranked lexical search, exact top-k and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelloom.llm import impact, lexical, spelling

from .samples import CLASHES, documents, prose


def rank_plainly(docs, items, top):
    """{item: [(doc_id, score)]} by the definition; docs are (id, text)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def terms(text):
        return [t.translate(lower) for t in pattern.findall(text or "")]

    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, words in asked.items():
        found = []
        for i, count, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * count[t]) // (1000 * count[t] + 20 * m))
                for t in words if t in count
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out[item] = [(i, -s) for s, _, _, i in sorted(found, key=lambda x: x[:3])[:top]]
    return {k: v for k, v in out.items() if v}


def ranked(rows, key, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r[key] is None, r[key] or 0, r["rank"])):
        out.setdefault(r[key], []).append((r[value], r["score"]))
        assert r["rank"] == len(out[r[key]])
    return out


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard, top", [(4096, 50), (40, 7)])
def test_lexical_search(spark, shard, top):
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(60)] + ["Äther", "MIXED", "mixed", "a1b2", "x"]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 80)))) for i in range(300)]
    docs += [(500 + i, docs[3][1]) for i in range(60)]  # ties
    docs += [(None, "w50 w51"), (600, None), (601, ""), (602, "... --- !"), (603, "w7 " * 5000), (604, docs[3][1]), (604, docs[3][1])]
    items = [(i, " ".join(rng.sample(words, 12))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "w50, W51! äther"), (94, "w1"), (94, "w59"), (None, "w3")]
    df = documents(spark, [(i, t, "s") for i, t in docs], **CLASHES)
    got = lexical.search(df, items_table(spark, items), top, shard).collect()
    assert ranked(got, "item_id", "doc_id") == rank_plainly(docs, items, top)


def test_lexical_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(4)
    docs = []
    for i in range(2000):
        kinds = rng.choice(200, 20, replace=False) + 200 * (i % 10)
        docs.append((i, [f"t{k}" for k in kinds], rng.integers(1, 9, 20).tolist(), 100))
    shard = lexical.Shard(docs)
    scored = 0
    for q in range(40):
        weights = {f"t{k}": int(w) for k, w in zip(rng.choice(2000, 15, replace=False), rng.integers(0, 9000, 15))}
        places, scores, n = shard.search(weights, 10)
        scored += n
        plain = []
        for i, terms, counts, m in docs:
            s = sum(weights.get(t, 0) * (10**9 * c // (1000 * c + 20 * m)) for t, c in zip(terms, counts))
            if s > 0:
                plain.append((-s, i))
        want = sorted(plain)[:10]
        assert [(-int(s), int(shard.ids[p])) for p, s in zip(places, scores)] == want
    assert scored < 40 * 1500


def test_lexical_search_of_empty_tables(spark):
    none = documents(spark, [])
    some = documents(spark, [(1, "w1 w2", "s")])
    assert lexical.search(none, items_table(spark, [(1, "w1")])).count() == 0
    assert lexical.search(some, items_table(spark, [])).count() == 0


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, block string, kind string")


@pytest.mark.parametrize("block", [8192, 50])
def test_exact_topk(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 16))
    rows = [(i, [float(x) for x in centres[i % 5] + 0.3 * rng.normal(size=16)], 0, "x", "y") for i in range(401)]
    rows += [(1000 + i, rows[7][1], 0, "x", "y") for i in range(150)]  # ties
    rows += [(2000, None, 0, "x", "y"), (2100, [1.0, None], 0, "x", "y"), (2200, [float("nan")] * 16, 0, "x", "y"),
             (2300, [float("inf")] * 16, 0, "x", "y"), (2400, [], 0, "x", "y"), (2401, [2.0, -3.0], 0, "x", "y"),
             (None, [3.0] * 16, 0, "x", "y"), (2500, [0.0] * 16, 0, "x", "y"), (200, rows[200][1], 0, "x", "y")]
    got = impact.top_inner_products(vectors_table(spark, rows), block_vectors=block).collect()

    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    held = [(i, whole(v)) for i, v, *_ in rows if whole(v) is not None]
    want = {}
    for i, v in {i: v for i, v in held if i is not None and i % 100 == 0}.items():
        scores = [(-sum(a * b for a, b in zip(v, w)), k is None, k or 0, k) for k, w in held if k != i]
        want[i] = [(k, -s) for s, _, _, k in sorted(scores, key=lambda x: x[:3])[:10]]
    assert ranked(got, "query_id", "vec_id") == want


def test_exact_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    rows = (1024 * (centres[np.arange(4000) % 20] + 0.2 * rng.normal(size=(4000, 32)))).astype(np.int32)
    block = impact.Block(list(range(4000)), [r.tobytes() for r in rows], impact.LEVELS)
    shares = []
    for i in range(0, 4000, 100):
        places, scores, share = block.best(i, rows[i].astype(np.int64), 10)
        every = rows.astype(np.int64) @ rows[i].astype(np.int64)
        every[i] = -(10**15)
        order = np.lexsort((np.arange(4000), -every))[:10]
        assert places.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
        shares.append(share)
    assert np.mean(shares) < 0.9


def test_exact_topk_bounds_and_empty_tables(spark):
    assert impact.top_inner_products(vectors_table(spark, [])).count() == 0
    assert impact.top_inner_products(vectors_table(spark, [(100, [1.0], 0, "", "")])).count() == 0
    with pytest.raises(Exception, match="2\\^31"):
        impact.top_inner_products(vectors_table(spark, [(100, [1e30], 0, "", "")])).collect()


def variants_plainly(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        around = [x for x in n if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (form[w], n[w], len(around), None if form[w] is None else n[form[w]])
    rows = set()
    for w, (f, count, k, c) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, f, root, count, k, c))
    return rows


def test_spelling_variants(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(spelling, "EDITS", 700)
    stems = ["spelling", "variant", "größere", "ÀÉÎõüÿ", "banana", "aaaaaaa", "letters", "wordÿword", "q" * 40, "x" * 33]
    pool = []
    for k, s in enumerate(stems):
        pool += [s] * (400 if k % 3 else 150)
        for _ in range(8):
            at = rng.randrange(len(s))
            kind = rng.choice("rdi")
            c = rng.choice("abxyzÿé")
            edited = s[:at] + ("" if kind == "d" else c) + s[at + (kind != "i") :]
            pool += [edited] * rng.choice([4, 5, 9, 40, 80])
            pool += [edited[:-1] + "z"] * rng.choice([1, 6, 30])
    rng.shuffle(pool)
    rows = [(i, ", ".join(pool[i * 20 : i * 20 + 20]).upper() if i % 9 == 0 else " ".join(pool[i * 20 : i * 20 + 20])) for i in range(len(pool) // 20 + 1)]
    rows += [(9000, None), (9001, ""), (None, "banana bananas bananas"), (9002, "short wor ds 12 34"), (1, rows[1][1]), (1, rows[1][1])]
    df = documents(spark, [(i, t, "s") for i, t in rows], edit="x", form="y", **{k: "x" for k in ("run", "near", "of")})
    got = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = variants_plainly(rows)
    assert got == want
    assert any(r[1] is not None and r[2] != r[1] for r in want), "no chain of forms"


def test_spelling_of_texts_without_words(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, "a b c 1 2 3", "s"), (2, None, "s")])).count() == 0


def test_very_long_words_are_probed_in_turns(spark, monkeypatch):
    monkeypatch.setattr(spelling, "EDITS", 500)
    long = "ab" * 700
    rows = [(i, f"{long} {long[:900]}x{long[900:]}", "s") for i in range(4, 10)] + [(i, f"{long}", "s") for i in range(40, 80)]
    got = {(r.word, r.form, r.n_near) for r in spelling.variants(documents(spark, rows)).collect()}
    assert got == variants_set(rows)


def variants_set(rows):
    return {(w, f, k) for w, f, _, _, k, _ in variants_plainly([(i, t) for i, t, _ in rows])}


def test_prose_has_no_close_words(spark):
    df = documents(spark, [(i, prose(i, 300), "s") for i in range(20)])
    assert {(r.word, r.form) for r in spelling.variants(df).collect()} == {
        (w, f) for w, f, *_ in variants_plainly([(i, prose(i, 300)) for i in range(20)])
    }
