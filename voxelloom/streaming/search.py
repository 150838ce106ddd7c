"""Scoring patches and blending window scores as they arrive; running statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.arrays import similarity
from ..operators.grid import AXES, covering_starts, padded_dims
from ..operators.joins import with_dims
from ..operators.latents import encode_patches, pooled_latent
from ..operators.similarity import block_pieces, expand_blocks
from ..operators.stats import volume_stats
from ..schema import PatchShape


def token_vector(token: DataFrame) -> list[float]:
    """The token's values; one short row by construction."""
    return [float(v) for v in token.select("latent").first()["latent"]]


def stream_latent_scores(patches: DataFrame, vector: list[float], size, mode: str = "cosine", make_encoder=None, batch_size: int = 32, keys=("volume_id", "wx", "wy", "wz")) -> DataFrame:
    """Stateless scores of prepared window cubes against a fixed token."""
    keys = list(keys)
    if make_encoder is None:
        coded = pooled_latent(patches, size)
    else:
        coded = encode_patches(patches, make_encoder, size, batch_size, keys)
    target = f"array({', '.join(f'{v!r}D' for v in vector)})"
    return coded.select(*keys, similarity("latent", target, mode).alias("sim"))


def stream_overlap_add(
    scores: DataFrame, dims: DataFrame, size, stride: int, base: int = 0, patience_ms: int | None = None
) -> DataFrame:
    """Taper sums per grid block as its windows arrive: ``s_k``, ``n_k`` and ``complete``.

    A block stands for the samples that the same windows cover.  Each block
    knows from the catalog how many windows are still due.  A changed block is
    sent out after each batch, so ``partial_map`` of the newest rows is the map
    so far; with its last window a block is sent out as complete and its state
    is dropped.  Each window arrives once.  With ``patience_ms`` a block that
    hears nothing for so long is sent out as it is and dropped too, so that a
    search that ended early leaves no state; this is for queries that run on,
    since a timer keeps a query that only takes what is there from ending.
    """
    p = PatchShape.of(size)
    unit, n_pieces, pieces = block_pieces(scores, p, stride)
    grid = padded_dims(dims, p, base).select("volume_id", *[F.col(f"p{a}").alias(f"e{a}") for a in AXES]) if base else (
        dims.select("volume_id", *[F.col(f"n{a}").alias(f"e{a}") for a in AXES]))
    near = with_dims(pieces, grid, ["bx", "by", "bz"])
    # Windows start on block borders, so covering the last sample covers all.
    due = " * ".join(
        f"size({covering_starts(f'(b{a} * {unit[a]} + {unit[a] - 1})', n, stride, f'e{a}')})" for a, n in zip(AXES, p.axes)
    )
    keys = ["volume_id", "bx", "by", "bz"]
    rows = near.selectExpr(*keys, "k", "num", f"cast({due} as bigint) as due")
    sums = [f"s_{k}" for k in range(n_pieces)], [f"n_{k}" for k in range(n_pieces)]
    names = [*sums[0], *sums[1]]

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get if state.exists else [0.0] * len(names))
        complete = False
        if state.hasTimedOut:
            state.remove()
        else:
            due = 0
            for frame in frames:
                k = frame["k"].to_numpy(np.int64)
                held += np.r_[
                    np.bincount(k, frame["num"].to_numpy(np.float64), n_pieces), np.bincount(k, minlength=n_pieces)
                ]
                due = int(frame["due"].iloc[0])
            complete = held[n_pieces:].sum() >= due
            if not complete:
                state.update(tuple(held.tolist()))
                if patience_ms is not None:
                    state.setTimeoutDuration(patience_ms)
            elif state.exists:
                state.remove()
        out = pd.DataFrame([key], columns=keys)
        for name, value in zip(names, held.tolist()):
            out[name] = value
        yield out.assign(complete=complete)

    state = ", ".join(f"{n} double" for n in names)
    return rows.groupBy(*keys).applyInPandasWithState(
        follow, f"volume_id string, bx int, by int, bz int, {state}, complete boolean", state, "update",
        GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def partial_map(state: DataFrame, dims: DataFrame, size, stride: int, base: int = 0, extent: Sequence[str] = ("nx", "ny", "nz")) -> DataFrame:
    """The blend of the windows seen so far, over the full extent; 0 where none was."""
    return expand_blocks(state.drop("complete"), dims, size, stride, base, extent)


def stream_stats(samples: DataFrame) -> DataFrame:
    """Running count, mean, deviation, min and max per volume."""
    return volume_stats(samples)
