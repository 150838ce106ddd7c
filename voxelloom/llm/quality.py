"""Quality scores by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .wordhash import grouped, word_hashes

PASSAGE_WORDS = 64
# Labelled texts that the model learns from, all their passages; fewer texts where they have more passages than this.
TRAIN_TEXTS = 4_000
TRAIN_PASSAGES = 100_000
HIDDEN = 32
EPOCHS = 30
BATCH_TEXTS = 64
LEARNING_RATE = 0.01
# Texts that a worker has as strings at once, and bytes of them whose passages it has.
SCORE_TEXTS = 200
SCORE_BYTES = 1 << 18
DECAY = 1e-4

# Counts by hashed word, by hashed word ending, and by shape; then shares.
WORD_SLOTS = 128
ENDING_SLOTS = 256
SHAPE_SLOTS = 64
SHARES = 6
WIDTH = WORD_SLOTS + ENDING_SLOTS + SHAPE_SLOTS + SHARES

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
KINDS = 5


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and its text's number; a text without words is one passage of zeros."""
    hashed, of, at, size = word_hashes(texts)
    n = np.bincount(of, minlength=len(texts))
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    per_text = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(texts)), per_text)
    if not len(of):
        return np.zeros((len(owner), WIDTH), np.float32), owner
    mine = first[of] + place // PASSAGE_WORDS

    # Byte classes of each word, from running counts.
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = at + (np.cumsum([0, *(len(t) + 1 for t in texts)]))[of]
    kinds = np.empty((len(of), KINDS), np.int64)
    classes = _CLASS[data]
    for k in range(KINDS):
        run = np.r_[0, np.cumsum(classes == k)]
        kinds[:, k] = run[begin + size] - run[begin]
    last = data[begin + size - 1].astype(np.int64)
    second = np.where(size > 1, data[np.maximum(begin + size - 2, 0)], 0).astype(np.int64)
    ending = (last * 31 + second * 131) % ENDING_SLOTS
    has = (kinds > 0).astype(np.int64)
    shape = (has * (1 << np.arange(KINDS))).sum(axis=1) * 2 + (size > 8)
    words = (hashed % np.uint64(WORD_SLOTS)).astype(np.int64)

    total = len(owner)
    count = np.zeros((total, WIDTH), np.float32)
    edges = np.cumsum([0, WORD_SLOTS, ENDING_SLOTS, SHAPE_SLOTS])
    for slot, low, high in zip((words, ending, shape), edges[:-1], edges[1:]):
        wide = high - low
        count[:, low:high] = np.bincount(mine * wide + slot, minlength=total * wide).reshape(total, wide)
    held = np.maximum(np.bincount(mine, minlength=total), 1)
    letters = np.maximum(np.bincount(mine, weights=size, minlength=total), 1)
    order = np.lexsort((hashed, mine))
    again = np.r_[False, (hashed[order][1:] == hashed[order][:-1]) & (mine[order][1:] == mine[order][:-1])]
    count[:, : edges[-1]] = np.sqrt(count[:, : edges[-1]] / held[:, None])
    shares = [np.bincount(mine[order], weights=again, minlength=total) / held, held / PASSAGE_WORDS, letters / held / 16]
    shares += [np.bincount(mine, weights=kinds[:, k], minlength=total) / letters for k in (0, 2, 3)]
    count[:, edges[-1] :] = np.stack(shares, axis=1)
    return count, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


@dataclass
class Model:
    """Passage encoder, gated attention and the head over the weighted passages."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        """Scores per text; ``owner`` ascends and numbers texts without gaps."""
        w = self.weights
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        raw = (t * g) @ w["attend"]
        e = np.exp(raw - np.maximum.reduceat(raw, starts)[owner])
        a = e / _sums(e, starts)[owner]
        z = _sums(a[:, None] * h, starts)
        return {"starts": starts, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ w["head"] + w["head_bias"])}

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, owner)
        d_logit = (f["score"] - y) / len(y)
        d_z = d_logit[:, None] * w["head"]
        d_a = (d_z[owner] * f["h"]).sum(axis=1)
        d_raw = f["a"] * (d_a - _sums(f["a"] * d_a, f["starts"])[owner])
        d_gated = d_raw[:, None] * w["attend"]
        d_t, d_g = d_gated * f["g"] * (1 - f["t"] ** 2), d_gated * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["a"][:, None] * d_z[owner] + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {
            "encode": x.T @ d_in, "encode_bias": d_in.sum(axis=0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_raw, "head": f["z"].T @ d_logit, "head_bias": d_logit.sum(),
        }

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = [np.zeros(0)]
        for _, held in grouped(texts, SCORE_BYTES):
            x, owner = passages(held)
            out.append(self.forward(x, owner)["score"].astype(np.float64))
        return np.concatenate(out)


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """Train by Adam on the cross entropy of document labels alone."""
    if len(set(labels.tolist())) < 2:
        return Model({}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    w = {
        "encode": draw(WIDTH, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32), "tanh": draw(HIDDEN, HIDDEN),
        "gate": draw(HIDDEN, HIDDEN), "attend": draw(HIDDEN), "head": draw(HIDDEN), "head_bias": np.float32(0),
    }
    model = Model(w)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = LEARNING_RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH_TEXTS):
            some = order[at : at + BATCH_TEXTS]
            x = np.concatenate([bags[i] for i in some]).astype(np.float32)
            owner = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            step += 1
            for k, g in model.gradients(x, owner, labels[some]).items():
                g = g + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode() for t in batch["body"].to_pylist()]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit a model on labelled texts that are not held out, in the order of a hash of their id.

    It learns from every passage of each of them.  Texts are taken up to
    ``TRAIN_TEXTS`` and while they have no more than ``TRAIN_PASSAGES`` passages
    together; the first one is taken in any case.  An id of several rows counts
    once, by its least text.
    """
    order = F.xxhash64("of")
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).alias("label"))
        .orderBy(order, "of").limit(TRAIN_TEXTS)
    )
    rows = (
        docs.select(F.col(id_col).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        .join(F.broadcast(known), "of").groupBy("of", "label").agg(F.min("body").alias("body"))
    )

    @lean
    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x = passages(_texts(one))[0].astype(np.float16)
                columns = [one["of"], one["label"], pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["of", "label", "n", "bag"])

    made = rows.select("of", F.col("label").cast("long").alias("label"), "body")
    made = stored(made.mapInArrow(encoded, "of long, label long, n long, bag binary"), "training-bags").withColumn("h", order)
    # Sizes first, at most TRAIN_TEXTS of them, so that no more passages than wanted come to the driver.
    sizes = sorted((r[0], r[1], r[2]) for r in made.select("h", "of", "n").collect())
    held = np.cumsum([r[2] for r in sizes])
    n = max(1, int(np.searchsorted(held, TRAIN_PASSAGES, side="right"))) if sizes else 0
    found = made.where(F.col("h") <= sizes[n - 1][0]).collect() if n else []
    found = sorted(found, key=lambda r: (r["h"], r["of"]))[:n]
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, WIDTH) for r in found]
    return fit(bags, np.array([r["label"] for r in found], np.float32))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): each row whole, and the model's score of its whole text."""

    @F.arrow_udf("double")
    @lean
    def score(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for body in bodies:
            runs = (body[i : i + SCORE_TEXTS].to_pylist() for i in range(0, len(body), SCORE_TEXTS))
            parts = [model.scores([t.encode() for t in some]) for some in runs]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.select(F.struct("*").alias("row"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted).

    Every passage of a text is encoded from hashed words, endings, shapes and
    shares; learned gates weigh the passages, and the weighted sum is scored.
    Nothing but the text is an input of a score.

    Null and empty texts are one empty passage and get its score.  Rows
    without id are scored, never learned from.  Of several labels of an id the
    least counts.  Without labels of both values every score is the share of
    label 1, or 0.5 without any.  Repeated rows stay repeated; other columns
    are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("body"))
    return with_scores(rows, model, "body").select(
        "row.doc_id", "row.held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
