"""Spelling variants: generated edits ask Bloom filters by length, and what passes is joined with the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bitfilter import BITS_PER_KEY, MAX_FILTER_BYTES, WORDS, may_hold
from .common import lean, stored
from .wordhash import mixed

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
# One run of so many loses a letter.
SLIP = 199
# Words of so many letters or more share one shard of the filter.
LAST_SHARD = 32
# Edits that a worker has at hand at once.
EDITS = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))
_SECOND = np.uint64(0xD1B54A32D192ED03)


def spelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word): every run of letters of at least ``LEAST_LETTERS``, in lower case, some without one letter."""
    run, h = F.col("run"), F.col("h")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    # A shorter run gives no word that counts.
    low = runs.where(F.length(run) >= LEAST_LETTERS).select("id", F.translate(run, UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return hashed.select(F.when(h % SLIP == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= LEAST_LETTERS)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur ``least`` times or more."""
    return spelled(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shard(length: np.ndarray) -> np.ndarray:
    return np.minimum(length, LAST_SHARD)


def keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a word from its polynomial: one for the block, one for the bits."""
    return mixed(h).view(np.int64), mixed(h ^ _SECOND).view(np.int64)


def polynomials(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the polynomials of words of equal length (rows of code points), and the powers."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(letters.shape[1] - 1, np.uint64(_BASE))])
    return (letters.astype(np.uint64) + np.uint64(1)) * powers, powers


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words of equal length together: (length, their places, their code points)."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        joined = "".join(words[i] for i in at)
        yield length, at, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, length)


def build_filters(words: DataFrame, n_of: dict[int, int]) -> dict[int, np.ndarray]:
    """One blocked Bloom filter per shard of lengths; together they stay below ``MAX_FILTER_BYTES``."""
    total = sum(n_of.values())
    most = MAX_FILTER_BYTES // (8 * WORDS)
    blocks = {s: max(1, min(-(-n * BITS_PER_KEY // (64 * WORDS)), most * n // total)) for s, n in n_of.items()}

    @lean
    def masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in by_length(batch["word"].to_pylist()):
                terms, _ = polynomials(letters)
                h, bits = keys(terms.sum(axis=1))
                of = min(length, LAST_SHARD)
                place = (bits.view(np.uint64)[:, None] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
                mask = (np.uint64(1) << place).view(np.int64)
                columns = [np.full(len(h), of), np.mod(h, blocks[of]), *mask.T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "block", *(f"w{i}" for i in range(WORDS))])

    schema = "shard long, block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    # A row per block: their number is bounded.
    rows = words.select("word").mapInArrow(masks, schema).groupBy("shard", "block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    ).collect()
    tables = {s: np.zeros((b, WORDS), np.int64) for s, b in blocks.items()}
    for r in rows:
        tables[r[0]][r[1]] = r[2:]
    return {s: t.view(np.uint64) for s, t in tables.items()}


def replaced(letters: np.ndarray, alphabet: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, place, letter) of the replacements by a greater letter that the filter may hold, some places at a time."""
    terms, powers = polynomials(letters)
    whole = terms.sum(axis=1)
    step = max(1, EDITS // (len(letters) * len(alphabet)))
    for begin in range(0, letters.shape[1], step):
        part = letters[:, begin : begin + step]
        word, place, letter = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        change = alphabet[letter].astype(np.uint64) - part[word, place].astype(np.uint64)
        held = may_hold(table, *keys(whole[word] + change * powers[begin + place]))
        yield word[held], begin + place[held], letter[held]


def deleted(letters: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of the deletions that the filter may hold; of equal neighbours the first is deleted."""
    terms, _ = polynomials(letters)
    before = np.cumsum(terms, axis=1) - terms
    after = terms.sum(axis=1)[:, None] - before - terms
    fresh = np.ones(letters.shape, bool)
    fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
    word, place = np.nonzero(fresh)
    held = may_hold(table, *keys((before + after * _BACK)[word, place]))
    return word[held], place[held]


def possible_pairs(words: DataFrame, alphabet: str, filters) -> DataFrame:
    """(word, n, edit): edits of each word that may be words too.

    A replacement is generated by a greater letter only and an insertion not at
    all: the other word of the pair generates it.
    """

    @lean
    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = filters.value
        marks = np.array([ord(c) for c in alphabet], np.uint32)
        for batch in batches:
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            for length, at, letters in by_length(words):
                step = max(1, EDITS // (length * len(marks)))
                same, shorter = (tables.get(min(x, LAST_SHARD)) for x in (length, length - 1))
                for begin in range(0, len(at), step):
                    part, some = at[begin : begin + step], letters[begin : begin + step]
                    of, edits = [], []
                    for word, place, letter in replaced(some, marks, same) if same is not None else ():
                        for i, k, c in zip(part[word].tolist(), place.tolist(), letter.tolist()):
                            of.append(i)
                            edits.append(words[i][:k] + alphabet[c] + words[i][k + 1 :])
                    if shorter is not None:
                        word, place = deleted(some, shorter)
                        for i, k in zip(part[word].tolist(), place.tolist()):
                            of.append(i)
                            edits.append(words[i][:k] + words[i][k + 1 :])
                    if of:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([words[i] for i in of]), pa.array(n[of]), pa.array(edits)], ["word", "n", "edit"]
                        )

    return words.mapInArrow(asked, "word string, n long, edit string")


def followed(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(of, root): where each word's forms end, by doubling steps.

    A form occurs ``times`` times as often, so the longest way follows from the
    commonest word's count.
    """
    longest = math.ceil(math.log(max(most, 2), times)) + 1
    found = forms.select(F.col("word").alias("of"), F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest + 1))):
        found = materialize(found)
        step = found.select(F.col("of").alias("at"), F.col("root").alias("next"))
        found = found.join(step, F.col("root") == F.col("at"), "left").select("of", F.coalesce("next", "root").alias("root"))
    return found


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """Every word of the texts with its near words' best form: (word, form, root, n, n_near, form_n).

    Words are runs of Latin letters in lower case (A to Z only) of six letters
    or more; where the CRC-32 of id, colon and run is divisible by 199 the run
    loses the letter at that number modulo its length.  Those that occur
    ``least`` times are the vocabulary, counted over all texts.  Two words are
    near if one inserted, deleted or replaced letter is all they differ by.  A
    word's form is its near word of largest count, the smaller one of equals,
    if it occurs ``times`` times as often; its root is the end of its forms.

    Each word generates its edits within a worker, as hashes.  Only those that
    the Bloom filter of their length passes become strings and move; the join
    with the vocabulary removes those that are no words.  The filters are
    bounded; fuller ones pass more.

    Null texts have no words, a null id counts as empty text.  Repeated rows
    count as often as they occur.  Other columns are ignored; texts without
    such words, and an empty table, give an empty result.
    """
    spark = docs.sparkSession
    words = stored(vocabulary(docs, id_col, text_col, least), "vocabulary")
    length = F.least(F.length("word"), F.lit(LAST_SHARD))
    n_of = {r[0]: r[1] for r in words.groupBy(length).count().collect()}
    # Letters are those of the pattern: 116 at most.
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    alphabet = "".join(sorted(r[0] for r in letters))
    filters = spark.sparkContext.broadcast(build_filters(words, n_of) if n_of else {})
    asked = possible_pairs(words, alphabet, filters)

    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = stored(asked.join(known, "edit"), "near-words")
    both = pairs.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(
        pairs.select(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )
    # The largest count first, then the smaller word.
    near = materialize(
        both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
        .select(F.col("word").alias("of"), "n_near", F.when(-F.col("best.col1") >= times * F.col("n"), F.col("best")).alias("best"))
    )
    forms = near.where("best is not null").select(F.col("of").alias("word"), F.col("best.near").alias("form"))
    most = words.agg(F.max("n")).first()[0] or 1
    roots = followed(forms, most, times).withColumnRenamed("of", "from")
    return (
        words.join(near, F.col("word") == F.col("of"), "left").join(roots, F.col("word") == F.col("from"), "left")
        .select(
            "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.col1")).alias("form_n"),
        )
    )


ORACLE = """
WITH RECURSIVE
crc AS (  -- CRC-32 of each byte
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS b)
  )
),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6
  GROUP BY ALL
),
bytes AS (
  SELECT run, times, flatten(list_transform(list_transform(range(1, length(s) + 1), lambda i: CAST(unicode(s[i]) AS BIGINT)),
    lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS bytes
  FROM (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs)
),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda x, b: xor(x // 256, t[CAST(xor(x, b) % 256 AS INTEGER) + 1]))) AS h
  FROM bytes, crc
),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
  )
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS part FROM places),
open_at AS (SELECT word, n, i, word[:i - 1] AS head, word[i + 1:] AS tail FROM places),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n
  FROM open_at a JOIN open_at b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.part = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.part = b.word
),
best AS (
  SELECT word, n, count(*) AS n_near, min(struct_pack(c := -near_n, w := near)) AS b FROM near GROUP BY word, n
),
forms AS (SELECT word, b.w AS form, -b.c AS form_n FROM best WHERE -b.c >= 5 * n),
steps AS (
  SELECT word, word AS root, 0 AS k FROM words
  UNION ALL
  SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON s.root = f.word
)
SELECT w.word, f.form, s.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w
LEFT JOIN best b ON w.word = b.word
LEFT JOIN forms f ON w.word = f.word
JOIN (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) s ON w.word = s.word
"""
