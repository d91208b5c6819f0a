"""Asking the whole corpus about keys, in batches.

Several operators have to know of each of very many keys (a window of words, a phrase, an n-gram) what the whole corpus holds under
it.  One row a key would shuffle many times the corpus.  Here documents are dealt into batches of a few MB; a batch
sorts its distinct keys, which pre-aggregates hot ones, and sends each key range to its partition as one packed row:
differences of sorted keys in the fewest bytes.  A partition merges the batches' rows and sends an answer for each
key back to each batch, in the same order.  The batch then reads its texts beside the answers.

Batches and partitions are sized by bytes of text, so a group's memory does not depend on the input's size; what
a third of all documents share is one key in each batch.  A batch has a row for each partition that occurs among its keys and looks
at no other, so rows and work grow with the keys, however many partitions there are.  Documents are read three times from one shuffle of the texts, which Spark
reuses, and nothing passes through the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_bytes

__all__ = ["LAST", "MESSAGE", "Layout", "batch_of", "batched", "bits", "doc_ids", "flags", "messages", "narrow", "received", "release", "squeeze", "unsqueeze", "widen"]

U64 = np.uint64
#: Bytes of text in a batch, and bytes of text whose keys meet in one partition.
BATCH_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: A document without an id is smaller than none.
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Layout:
    """How many batches and partitions, and how many leading bits of a hash make a filter key."""

    batches: int
    parts: int
    bits: int

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U64(64 - self.bits)

    def ranges(self, keys: np.ndarray, bits: int) -> dict[int, tuple[int, int]]:
        """Of sorted keys, the partitions that occur and where each one's keys begin and end."""
        if not len(keys):
            return {}
        top = (keys >> U64(bits - 32)) * U64(self.parts) >> U64(32)
        at = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)]])
        return {int(top[i]): (int(i), int(j)) for i, j in zip(at[:-1], at[1:], strict=True)}


def batched(docs: DataFrame, *, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, Layout]:
    """(batch, doc_id, text) of all documents, and the layout."""
    total = max(text_bytes(docs), 1)
    layout = Layout(
        math.ceil(total / batch_bytes), math.ceil(total / part_bytes), min(64, max(36, (total // 6).bit_length() + 10))
    )
    return docs.select(batch_of(layout, "text"), F.col("doc_id").cast("long").alias("doc_id"), "text"), layout


def batch_of(layout: Layout, otherwise: str = "doc_id"):
    """The batch of a row, by its doc_id; rows without one are dealt by another column."""
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(otherwise)).otherwise(F.xxhash64(F.col("doc_id").cast("long")))
    return F.pmod(own, F.lit(layout.batches)).cast("int").alias("batch")


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as one width, the first key and differences of that width."""
    if not len(keys):
        return b""
    step = np.diff(keys)
    wide = (int(step.max()).bit_length() + 7) // 8 if len(step) else 1
    wide = max(wide, 1)
    return bytes([wide]) + keys[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    step = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    out = np.zeros((len(step) + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    out[1:, : raw[0]] = step
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


def narrow(values: np.ndarray) -> bytes:
    """Integers as one width, the least and distances from it of that width.  LAST, if it occurs, widens all."""
    if not len(values):
        return b""
    least = values.min()
    far = (values - least).astype("<u8")
    wide = max((int(far.max()).bit_length() + 7) // 8, 1)
    return bytes([wide]) + np.array([least], "<i8").tobytes() + far.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def widen(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    far = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    out = np.zeros((len(far), 8), np.uint8)
    out[:, : raw[0]] = far
    return out.view("<i8").ravel() + np.frombuffer(raw, "<i8", 1, 1)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


#: What batches send and partitions answer: up to three packed arrays in a row.
MESSAGE = "round int, part int, batch int, a binary, b binary, c binary"
_MESSAGE = pa.schema(
    [("round", pa.int32()), ("part", pa.int32()), ("batch", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
)


def messages(rows: list[tuple]) -> pa.Table:
    """Rows of (round, part, batch, a[, b[, c]])."""
    full = [r + (None,) * (6 - len(r)) for r in rows]
    return pa.table([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def received(table: pa.Table, round_: int) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """(part, batch, a, b, c) of one round, by part and batch."""
    rows = zip(*(table[c].to_pylist() for c in ("round", "part", "batch", "a", "b", "c")), strict=True)
    return sorted((r[1:] for r in rows if r[0] == round_), key=lambda r: r[:2])


def doc_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].to_numpy() if table["doc_id"].null_count == 0 else np.array(
        [LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64
    )
