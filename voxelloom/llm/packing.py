"""Best-two-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import kept_in_worker, lean, slices

CAPACITY = 4096
END_ID = 1
# Pieces that one task packs; a group wastes less than one sequence or so.
GROUP_PIECES = 20_000
# Words whose ids a task keeps (about 200 bytes each).
CACHE_WORDS = 250_000
MARKS = b"!$%&*#.,|?:;"
# Bytes of text that a worker has as strings at once.
SLICE_BYTES = 4 << 20

# The steps of a tokenizer whose words can be looked up one by one.
WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Loaded:
    """A tokenizer, whether its words can be looked up one by one, and its added tokens in lower case."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        added = said.get("added_tokens") or []
        plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        marks = [t["content"].encode() for t in added]
        self.marks = [m.lower() for m in marks]
        self.by_word = (
            said["normalizer"] == WORD_NORMALIZER and said["pre_tokenizer"] == WORD_SPLIT and said["model"]["type"] == "BPE"
            and not said["model"].get("dropout") and plain and not any(m != b"".join(m.split()) for m in marks)
            and not said.get("truncation")
        )


def loaded(path: str) -> Loaded:
    return kept_in_worker("packing", ("tokenizer", path), lambda: Loaded(path))


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encode_words(tokenizer, new: list[bytes]) -> list[bytes]:
    """Ids of words without white space between them, as packed numbers.

    Words of Latin letters pass the tokenizer's normalizer and word split as
    they are, so their bytes go to its model directly.
    """
    letters = kept_in_worker("packing", ("byte letters",), byte_letters)
    model, out, rest = tokenizer.model, [b""] * len(new), []
    for i, word in enumerate(new):
        text = word.decode()
        if text.isalpha() and max(text) < "\u0180" and (low := text.lower()).isalpha():
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(letters)
            out[i] = array("I", [t.id for t in model.tokenize(low)]).tobytes()
        else:
            rest.append(i)
    encoded = tokenizer.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False)
    for i, e in zip(rest, encoded):
        out[i] = array("I", e.ids).tobytes()
    return out


def token_bytes(path: str, text: str, known: dict[bytes, bytes] | None = None) -> bytes:
    """A text's ids as little-endian unsigned 32-bit numbers; ``known`` holds the words met before.

    A tokenizer that drops white space, cuts words before it merges, and is
    blind to the case of letters, is asked word by word, and only for new
    words.  Added tokens are not blind to case, so a word that has one in lower
    case is looked up as it is written.  Punctuation behind an ASCII letter or
    digit is a word of its own, and is looked up apart.  Any other tokenizer
    encodes whole texts.
    """
    held = loaded(path)
    if not held.by_word:
        return array("I", held.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    known = {} if known is None else known
    data = text.encode()
    low = data.lower()
    found = low.split()
    if any(m in low for m in held.marks):
        found = [w if any(m in l for m in held.marks) else l for w, l in zip(data.split(), found)]
    ids = list(map(known.get, found))
    if None in ids:
        gaps = [i for i, x in enumerate(ids) if x is None]
        if len(known) > CACHE_WORDS:
            known.clear()
            gaps = list(range(len(found)))
        new = list(dict.fromkeys([found[i] for i in gaps]))
        stems = [w.rstrip(MARKS) for w in new]
        parted = [bool(s) and s != w and s[-1:].isalnum() for s, w in zip(stems, new)]
        parts = dict.fromkeys(s if p else w for s, w, p in zip(stems, new, parted))
        parts |= dict.fromkeys(w[len(s) :] for s, w, p in zip(stems, new, parted) if p)
        missing = [w for w in parts if w not in known]
        known.update(zip(missing, encode_words(held.tokenizer, missing)))
        for stem, word, apart in zip(stems, new, parted):
            if apart:
                known[word] = known[stem] + known[word[len(stem) :]]
        for i in gaps:
            ids[i] = known[found[i]]
    return b"".join(ids)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenize each text, end it with ``END_ID``, and cut only what exceeds ``capacity``."""
    end = array("I", [END_ID]).tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    @partial(lean, owner="packing")
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for some in slices(batch, SLICE_BYTES):
                out = []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["body"].to_pylist()):
                    ids = token_bytes(tokenizer, text, known) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    ).mapInArrow(cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``.

    A bin takes the longest unpacked document that still fits until none does.
    Then its smallest document makes room for the two unpacked ones that
    together fit the widened gap best, as long as they leave less of it.  The
    lengths at hand are one integer's bits, a second one holds them mirrored:
    shifted against each other they show every pair of a given sum at once.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        waiting[lengths[i]].append(i)
    here = mirrored = 0
    for size in range(1, capacity + 1):
        if waiting[size]:
            here |= 1 << size
            mirrored |= 1 << (capacity - size)
    bins = [[i] for i in reversed(waiting[0])]

    def take(size: int) -> int:
        nonlocal here, mirrored
        i = waiting[size].pop()
        if not waiting[size]:
            here ^= 1 << size
            mirrored ^= 1 << (capacity - size)
        return i

    def put_back(size: int, i: int) -> None:
        nonlocal here, mirrored
        if not waiting[size]:
            here ^= 1 << size
            mirrored ^= 1 << (capacity - size)
        waiting[size].append(i)

    def pair_within(room: int, above: int) -> tuple[int, int] | None:
        least = (here & -here).bit_length() - 1
        for total in range(room, max(above, 2 * least - 1), -1):
            pairs = here & (mirrored >> (capacity - total))
            if total % 2 == 0 and len(waiting[total // 2]) == 1:
                pairs &= ~(1 << (total // 2))
            if pairs:
                longer = pairs.bit_length() - 1
                return longer, total - longer
        return None

    while here:
        held: list[int] = []
        gap = capacity
        while True:
            while gap and (size := (here & ((1 << (gap + 1)) - 1)).bit_length() - 1) > 0:
                held.append(take(size))
                gap -= size
            if not gap or not here:
                break
            least = min(held, key=lengths.__getitem__)
            pair = pair_within(gap + lengths[least], lengths[least])
            if pair is None:
                break
            held.remove(least)
            held += [take(pair[0]), take(pair[1])]
            put_back(lengths[least], least)
            gap += lengths[least] - sum(pair)
        bins.append(held)
    return bins


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids; one row per piece.

    Pieces are dealt evenly into groups of about ``group_pieces`` and packed
    per group by best-two-fit, so a task's work is bounded whatever the input,
    and a sequence is shared by pieces of one group only.  ``sequence_id`` is
    the group's number times 2^32 plus the bin's.

    A null or empty text is its end id alone.  Repeated rows are packed as
    often as they occur, equal lengths in order of id and piece.  An empty
    table gives an empty result; columns besides id and text are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, id_col, text_col))
    groups = max(1, -(-pieces.count() // group_pieces))

    @lean
    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        mine = pd.concat(rows, ignore_index=True).astype({"doc_id": "Int64"})
        mine = mine.sort_values(["doc_id", "piece", "length", "ids_crc32"], ignore_index=True)
        lengths = mine["length"].tolist()
        sequence, offset = [0] * len(mine), [0] * len(mine)
        base = TaskContext.get().partitionId() << 32
        for number, held in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in held:
                sequence[i], offset[i] = base + number, at
                at += lengths[i]
        yield mine.assign(sequence_id=sequence, offset=offset)

    return pieces.repartition(groups).mapInPandas(fill, f"{PIECES}, sequence_id long, offset long")
