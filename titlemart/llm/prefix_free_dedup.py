"""Exact byte repeats by prefix-free parsing.

A rolling hash over ``gram`` bytes sets triggers: a place is one if its hash is least among some ``length - gram + 1`` in
a row.  So every string of ``length`` bytes belongs to one trigger, the leftmost of its least, at the same place wherever the string
occurs, and the triggers cut each document into phrases that equal texts share.  A dictionary entry is a trigger with as many bytes on either side
as the strings that belong to it reach: at most up to the next trigger of a lesser hash.  The parse is each document's sequence of entries.

1. Triggers: which of them occur in another document?  Where the corpus does not repeat itself, the answer is no and
   no text is looked at again.
2. Dictionary and parse: batches send their distinct entries under shared triggers, each with its smallest document, to the range of
   their trigger.  There two suffix arrays are made.  That of the parse puts the entries in the order of their bytes from the trigger on, what
   the text goes on with, and has the lengths of common prefixes of neighbours.  That of the dictionary puts the bytes before, with the trigger, in order; it is
   induced from the trigger outward, one byte before a time: a stable sort by that byte of the order before it.
   Together they give the corpus order of all strings that belong to the range's triggers, and equal strings are neighbours in it; each entry learns whether a smaller
   document's is among them.
3. Removal: each document's entries, in order, give the strings that start in a smaller document; their bytes go.

Bytes are compared, never hashes of them: hashes choose triggers and ranges and say which triggers are shared.  A passage
in thousands of documents is one entry a batch.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; what is left after removal may not be valid
UTF-8, so it is binary; rows that share a doc_id are no earlier than each other; a null doc_id is later than all others; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .textkit import SLICE, first_of, mix, packed, powers, prefix_sums, sliding

U64 = np.uint64
_MORE = U64(0xD6E8FEB86659FD93)
_CODEC = "zstd"
#: Bytes of text in a batch, and bytes of text whose entries meet in one partition.
BATCH_BYTES = 1 << 20
PART_BYTES = 5 << 20


def triggers(raw: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit hashes of the triggers, in order; no trigger crosses documents."""
    width = length - gram + 1
    places, hashes = [], []
    for lo in range(0, max(len(raw) - length + 1, 0), SLICE):
        part = raw[lo : min(lo + SLICE + length - 1, len(raw))]
        p = prefix_sums(part)
        h = mix((p[gram:] - p[:-gram]) * powers(len(p))[1][: len(part) - gram + 1])
        top = (h >> U64(32)).astype(np.uint32)
        least = np.zeros(len(top) + width - 1, np.uint32)
        least[width - 1 : len(top)] = sliding(np.minimum, top, width)
        at = np.flatnonzero(sliding(np.maximum, least, width) == top)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at, once = np.unique(np.concatenate(places), return_index=True)
    h = np.concatenate(hashes)[once]
    text = np.searchsorted(starts, at, "right") - 1
    whole = at + gram <= starts[text + 1]
    return at[whole], h[whole]


def reaches(at: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before each trigger, and after it, its strings may reach: up to a trigger before it that is no greater, or a lesser one after it."""
    top = hashes >> U64(32)
    out = []
    for here, rank, stops in ((at, top, np.less_equal), (-at[::-1], top[::-1], np.less)):
        far = np.full(len(here), most)
        open_ = np.arange(len(here))
        for k in range(1, most + 1):
            open_ = open_[open_ >= k]
            gap = here[open_] - here[open_ - k]
            open_, gap = open_[gap <= most], gap[gap <= most]
            if not len(open_):
                break
            met = stops(rank[open_ - k], rank[open_])
            far[open_[met]] = gap[met] - 1
            open_ = open_[~met]
        out.append(far)
    return out[0], out[1][::-1]


class Batch:
    """Triggers of a batch's documents."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram
        # Triggers near the edge of a document depend on its neighbour in the batch, so every pass needs one order.
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_id = table["doc_id"]
        self.ids = X.doc_ids(table)
        self.raw, self.starts = packed(table["text"])
        at, hashes = triggers(self.raw, self.starts, length, gram)
        left, right = reaches(at, hashes, self.reach)
        text = np.searchsorted(self.starts, at, "right") - 1
        left = np.minimum(left, at - self.starts[text])
        right = np.minimum(right, self.starts[text + 1] - at - gram)
        some = left + right >= self.reach
        # Triggers have small hashes, being the least; ranges need even ones.
        self.at, self.hash, self.doc = at[some], mix(hashes[some] + _MORE), self.ids[text[some]]
        self.left, self.right = left[some], right[some]

    def keys(self, layout: X.Layout):
        keys, place, ((least, most),) = first_of(layout.short(self.hash), self.doc)
        return keys, place, least != most

    def entries(self, layout: X.Layout, answers: pa.Table):
        """Shared triggers' numbers, each one's entry, and of the entries, by trigger: a first occurrence, its bytes, and the smallest document."""
        keys, place, shared = self.keys(layout)
        ranges = layout.ranges(keys, layout.bits)
        for part, _, raw, _, _ in X.received(answers, 1):
            i, j = ranges[part]
            shared[i:j] |= X.flags(raw, j - i)
        which = np.flatnonzero(shared[place])
        left, right, hashes = self.left[which], self.right[which], self.hash[which]
        whole = self.context(which)
        # A hash puts equal entries side by side; those whose bytes and lengths are equal go once.
        key = mix(_folded(whole) + hashes * _MORE + (left * 256 + right).astype(U64))
        order = np.lexsort((key, hashes))
        new = np.ones(len(order), bool)
        for x in (left, right, hashes, key):
            new[1:] &= x[order[1:]] == x[order[:-1]]
        new[1:] = ~(new[1:] & (whole[order[1:]] == whole[order[:-1]]).all(1))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(self.doc[which][order], np.flatnonzero(new)) if len(order) else self.ids[:0]
        return which, entry, which[order[new]], whole[order[new]], smallest

    def context(self, which: np.ndarray) -> np.ndarray:
        """The triggers' bytes with ``reach`` places on both sides, 0 beyond what each reaches."""
        padded = np.concatenate([np.zeros(self.reach, np.uint8), self.raw, np.zeros(self.reach + self.gram, np.uint8)])
        steps = np.arange(2 * self.reach + self.gram)
        out = np.lib.stride_tricks.sliding_window_view(padded, len(steps))[self.at[which]]
        out[steps < (self.reach - self.left[which])[:, None]] = 0
        out[steps >= (self.reach + self.gram + self.right[which])[:, None]] = 0
        return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian numbers, so that they sort as the bytes do."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(">u8").astype(U64)


def _folded(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    total = np.zeros(len(rows), U64)
    for column in _words(rows).T:
        total = mix(total * _MORE + column + U64(1))
    return total


def parse_order(whole: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parse: entries by their bytes from the trigger on, and how many of these each shares with the one before it."""
    on = whole[:, reach:]
    order = np.lexsort(_words(on).T[::-1]) if len(on) else np.zeros(0, np.int64)
    differs = on[order[1:]] != on[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), on.shape[1])
    return order, np.concatenate([[-1], common])[: len(order)]


def corpus_order(
    whole: np.ndarray, left: np.ndarray, right: np.ndarray, gram: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a from 0 to ``reach``: the entries' strings that start a bytes before the trigger, in the order of their bytes, and where a new string begins.

    A string has reach + gram bytes; entries that do not reach so far to either side have none.
    """
    reach = (whole.shape[1] - gram) // 2
    order, common = parse_order(whole, reach)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # The dictionary's suffix array: a suffix is a bytes and the trigger; equal suffixes have one number.
    suffix = np.empty(len(order), np.int64)
    suffix[order] = np.cumsum(common < gram)
    for a in range(reach + 1):
        goes_on = np.cumsum(common < gram + reach - a)
        rows = order[right[order] >= reach - a]
        new = np.ones(len(rows), bool)
        then = goes_on[rank[rows]]
        new[1:] = (suffix[rows[1:]] != suffix[rows[:-1]]) | (then[1:] != then[:-1])
        yield a, rows, new
        if a < reach:
            order = order[left[order] > a]
            byte = whole[order, reach - 1 - a]
            by_byte = np.argsort(byte, kind="stable")
            order, byte = order[by_byte], byte[by_byte]
            other = np.ones(len(order), bool)
            other[1:] = (byte[1:] != byte[:-1]) | (suffix[order[1:]] != suffix[order[:-1]])
            suffix[order] = np.cumsum(other)


def earlier(whole: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Of each entry, as bits: the strings, by bytes before the trigger, that a smaller document's entry has too."""
    found = np.zeros(len(doc), U64)
    for a, rows, new in corpus_order(whole, left, right, gram):
        if len(rows):
            begins = np.flatnonzero(new)
            least = np.minimum.reduceat(doc[rows], begins)[np.cumsum(new) - 1]
            found[rows[least < doc[rows]]] |= U64(1) << U64(a)
    return found


def remove_repeats(
    docs: DataFrame, *, length: int = 50, gram: int = 20, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed array<int>, kept binary): ``removed`` holds start and end of each removed run."""
    texts, layout = X.batched(docs, batch_bytes=batch_bytes, part_bytes=part_bytes)
    reach = length - gram
    if not 0 < reach < 64:
        raise ValueError("length must be 1 to 63 more than gram")
    wide = 2 * reach + gram

    def ask_triggers(key, table):
        X.release()
        keys, _, _ = Batch(table, length, gram).keys(layout)
        return X.messages([
            (1, part, key[0].as_py(), X.squeeze(keys[i:j])) for part, (i, j) in layout.ranges(keys, layout.bits).items()
        ])

    def answer_triggers(key, table):
        X.release()
        rows = [(batch, X.unsqueeze(a)) for _, batch, a, _, _ in X.received(table, 1)]
        keys, times = np.unique(np.concatenate([a for _, a in rows]), return_counts=True)
        return X.messages([
            (1, key[0].as_py(), batch, X.bits(times[np.searchsorted(keys, a)] > 1)) for batch, a in rows
        ])

    def ask_entries(key, table, answers):
        X.release()
        if not len(table):
            return X.messages([])
        batch = Batch(table, length, gram)
        _, _, first, whole, smallest = batch.entries(layout, answers)
        hashes, left, right = batch.hash[first], batch.left[first].astype(np.uint8), batch.right[first].astype(np.uint8)
        rows = []
        for part, (i, j) in layout.ranges(hashes, 64).items():
            body = pa.compress(left[i:j].tobytes() + right[i:j].tobytes() + whole[i:j].tobytes(), _CODEC, asbytes=True)
            rows.append((2, part, key[0].as_py(), X.squeeze(hashes[i:j]), X.narrow(smallest[i:j]), body))
        return X.messages(rows)

    def answer_entries(key, table):
        X.release()
        asked, body = [], []
        for _, batch, a, b, c in X.received(table, 2):
            hashes = X.unsqueeze(a)
            n = len(hashes)
            plain = np.frombuffer(pa.decompress(c, n * (2 + wide), _CODEC, asbytes=True), np.uint8)
            asked.append((batch, hashes, X.widen(b)))
            body.append((plain[:n], plain[n : 2 * n], plain[2 * n :].reshape(n, wide)))
        # Only triggers of two documents or more can have an earlier entry.
        doc = np.concatenate([x[2] for x in asked])
        _, place, ((least, most),) = first_of(np.concatenate([x[1] for x in asked]), doc)
        live = (least != most)[place]
        left, right, whole = (np.concatenate([x[k] for x in body]) for k in range(3))
        del body
        found = np.zeros(len(doc), U64)
        found[live] = earlier(whole[live], left[live], right[live], doc[live], gram)
        out, i = [], 0
        for batch, h, _ in asked:
            mask = found[i : i + len(h)].astype("<u8").tobytes()
            out.append((2, key[0].as_py(), batch, pa.compress(mask, _CODEC, asbytes=True)))
            i += len(h)
        return X.messages(out)

    def remove(key, table, answers):
        X.release()
        if not len(table):
            return _empty()
        batch = Batch(table, length, gram)
        which, entry, first, _, smallest = batch.entries(layout, answers)
        ranges = layout.ranges(batch.hash[first], 64)
        masks = np.zeros(len(first), U64)
        for part, _, raw, _, _ in X.received(answers, 2):
            i, j = ranges[part]
            masks[i:j] = np.frombuffer(pa.decompress(raw, 8 * (j - i), _CODEC, asbytes=True), "<u8")
        own = masks[entry]
        own[batch.doc[which] > smallest[entry]] = U64((1 << (reach + 1)) - 1)  # an equal entry is in the batch, earlier
        at, left, right = batch.at[which], batch.left[which], batch.right[which]
        starts = np.zeros(len(batch.raw) + 1, np.int32)
        for a in range(reach + 1):
            ok = (own >> U64(a) & U64(1)).astype(bool) & (left >= a) & (right >= reach - a)
            starts[at[ok] - a] = 1
        running = np.cumsum(starts, dtype=np.int32)
        running[length:] -= running[:-length].copy()
        gone = running[: len(batch.raw)] > 0
        n_bytes, n_removed, runs, kept = [], [], [], []
        for lo, hi in zip(batch.starts[:-1], batch.starts[1:], strict=True):
            mine, own_bytes = gone[lo:hi], batch.raw[lo:hi]
            n_bytes.append(int(hi - lo))
            n_removed.append(int(np.count_nonzero(mine)))
            if n_removed[-1]:
                own_bytes = own_bytes[~mine]
                runs.append(np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))).tolist())
            else:
                runs.append([])
            kept.append(own_bytes.tobytes())
        return pa.table(
            [
                batch.doc_id, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(runs, pa.list_(pa.int32())), pa.array(kept, pa.binary()),
            ],
            names=_NAMES,
        )

    by_batch = texts.groupBy("batch")
    shared = by_batch.applyInArrow(ask_triggers, X.MESSAGE).groupBy("part").applyInArrow(answer_triggers, X.MESSAGE)
    order = (
        by_batch.cogroup(shared.groupBy("batch")).applyInArrow(ask_entries, X.MESSAGE)
        .groupBy("part").applyInArrow(answer_entries, X.MESSAGE)
    )
    return by_batch.cogroup(shared.unionByName(order).groupBy("batch")).applyInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, removed array<int>, kept binary"
    )


_NAMES = ["doc_id", "n_bytes", "n_removed", "removed", "kept"]


def _empty() -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
    return pa.table([pa.array([], k) for k in kinds], names=_NAMES)
