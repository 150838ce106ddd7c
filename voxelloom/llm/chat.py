"""Chat formatting by columnar byte assembly, with a loss mask and an exact way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
# Bytes of text that are put together at once.
SLICE_BYTES = 4 << 20

# A control string gets one more backslash behind its bracket than it has.
CONTROL = r"(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

PARTS = "conv_id long, part long, formatted string, loss_start array<int>, loss_bytes array<int>"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role is one line: its own backslashes and line feeds are marked first."""
    return escape(pa.array([role.replace("\\", "\\\\").replace("\n", "\\n")]))[0].as_py()


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def place(out: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ``data[start : start + length]`` to ``out[at:]`` for every segment at once; a slice's places fit in 32 bits."""
    ends = np.cumsum(length)
    steps = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    begins = ends - length
    taken = data[np.repeat((start - begins).astype(np.int32), length) + steps]
    out[np.repeat((at - begins).astype(np.int32), length) + steps] = taken


def assemble(batch: pa.RecordBatch, first_part: int) -> pa.RecordBatch:
    """Turns in order to one row for each run of the same conversation."""
    n = batch.num_rows
    content = escape(pc.fill_null(batch["body"], "").cast(pa.large_string()))
    bounds = np.frombuffer(content.buffers()[1], np.int64, n + 1, content.offset * 8)
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
    roles = pc.dictionary_encode(batch["role"])
    heads = [f"{START}{escape_role(r)}\n".encode() for r in roles.dictionary.to_pylist()]
    of = roles.indices.to_numpy(zero_copy_only=False)
    head_bytes = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_bytes) - head_bytes
    tail = np.frombuffer(f"{END}\n".encode(), np.uint8)

    head_len, body_len = head_bytes[of], np.diff(bounds)
    ends = np.cumsum(head_len + body_len + len(tail))
    begins = ends - head_len - body_len - len(tail)
    out = np.empty(ends[-1], np.uint8)
    place(out, begins, np.frombuffer(b"".join(heads), np.uint8), head_at[of], head_len)
    place(out, begins + head_len, data, bounds[:-1], body_len)
    out[(begins + head_len + body_len)[:, None] + np.arange(len(tail))] = tail

    conv = batch["conv_id"]
    ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
    null = pc.is_null(conv).to_numpy(zero_copy_only=False)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]
    first = np.flatnonzero(new)
    edges = np.r_[begins[first], ends[-1]]
    mine = np.flatnonzero(of == _index(roles.dictionary, LOSS_ROLE))
    group = np.cumsum(new)[mine] - 1
    per = np.searchsorted(group, np.arange(len(first) + 1)).astype(np.int32)
    loss_at = (begins + head_len)[mine] - edges[group]
    lists = [
        pa.ListArray.from_arrays(pa.array(per), pa.array(x.astype(np.int32))) for x in (loss_at, body_len[mine])
    ]
    formatted = pa.StringArray.from_buffers(
        len(first), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(out)
    )
    parts = pa.array(first_part + np.arange(len(first)))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), parts, formatted, *lists],
        ["conv_id", "part", "formatted", "loss_start", "loss_bytes"],
    )


def _index(values: pa.Array, wanted: str) -> int:
    return values.to_pylist().index(wanted) if wanted in values.to_pylist() else -1


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Formatted text with its loss mask: (conv_id, part, formatted, loss_start, loss_bytes).

    Turns are range-partitioned by conversation and turn, so a conversation of
    any length is spread over tasks; where a task or batch ends inside one, it
    has several rows, whose ``part`` numbers ascend.  The mask gives byte
    ranges of ``formatted`` that hold exactly the assistant's texts.

    Null texts and roles are empty.  Turns of equal number are ordered by role,
    then text, and repeated rows stay repeated.  Rows without conversation id
    form one conversation.  Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    placed = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "body")

    @lean
    def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, SLICE_BYTES):
                made = assemble(piece, part)
                part += made.num_rows
                yield made

    return placed.mapInArrow(assembled, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """Parse formatted text again: turns, text under the mask, and their digests.

    A digest runs over a conversation from start to end, so its parts pass
    through one task, one at a time; nothing but the digest's state is kept.
    """
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    @lean
    def digest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        turns = loss = None
        counts = [0, 0, 0]

        def result() -> pd.DataFrame:
            row = [current[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]
            made = pd.DataFrame([row], columns=[c.split()[0] for c in DIGESTS.split(", ")])
            return made.astype({"conv_id": "Int64"})

        for batch in batches:
            done = []
            ids = batch["conv_id"].astype("Int64").array
            rows = zip(ids, batch["formatted"], batch["loss_start"], batch["loss_bytes"])
            for conv, formatted, starts, sizes in rows:
                key = (None if conv is pd.NA else int(conv),)
                if key != current:
                    if current is not None:
                        done.append(result())
                    current, counts = key, [0, 0, 0]
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                raw = formatted.encode()
                for role, body in TURN.findall(raw):
                    turns.update(f"{unescape_role(role.decode())}\n{unescape(body.decode())}\n".encode())
                    counts[0] += 1
                for at, size in zip(starts, sizes):
                    text = unescape(raw[at : at + size].decode())
                    loss.update(text.encode())
                    counts[1] += len(text)
                counts[2] += len(formatted)
            if done:
                yield pd.concat(done)
        if current is not None:
            yield result()

    return ordered.mapInPandas(digest, DIGESTS)


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role,'') role, coalesce(text,'') body from conversations
 union all select * from (values (-7,0,'user','</s>[INST] ok [/INST]'),(-7,1,'assistant','</s>[INST] ok [/INST]')) v(conv_id,turn,role,body)),
e as (select *, regexp_replace(body, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') esc from t)
select conv_id::bigint conv_id, count(*)::bigint n_turns, sha256(string_agg(role||chr(10)||body||chr(10), '' order by turn, role, body)) turns_sha256,
 coalesce(sum(length(body)) filter (role='assistant'),0)::bigint loss_chars,
 sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (role='assistant'),'')) loss_sha256,
 sum(length(esc)+length(role)+24)::bigint formatted_chars
from e group by 1
"""
