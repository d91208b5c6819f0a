"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters is matched where a document holds a string within ``budget = int(error_rate * m)`` edits of it.  An item
cut into ``budget + 1`` pieces keeps at least one piece whole in any such string, so

1. one automaton of all pieces finds their exact hits in a document in one pass over it;
2. each hit places its item on a diagonal; windows of near diagonals are merged, and Myers' bit-parallel distance, one
   machine step a character on integers of m bits, gives the least distance of the item to any string in the window.

Both sides are compared in lower case with each run of white space as one space.

The items travel to the tasks in blocks of at most ``block_bytes`` bytes, a measured bound; a larger benchmark takes one pass over the
documents a block.  Documents are not shuffled.

Defined cases: null or empty text holds nothing; items that are null or empty after normalising match nothing; items so short that
their budget is 0 must occur exactly; items with equal texts are all reported; repeated documents each; the least distance counts, at
its first end; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
BLOCK_BYTES = 8 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, error_rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget, and (offset, piece) of budget + 1 pieces of even length."""
    budget = int(error_rate * len(item))
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to any substring of ``text``, and the first end at which it occurs."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if now < best:
            best, end = now, j
    return best, end


class Finder:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.ids: dict[str, list[int]] = {}
        for key, text in items:
            if text := plain(text):
                self.ids.setdefault(text, []).append(key)
        self.items = list(self.ids)
        self.budget = []
        held: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            budget, parts = pieces(item, error_rate)
            self.budget.append(budget)
            for offset, piece in parts:
                held.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of every item that the text holds."""
        text = plain(text)
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text) if self.items else ():
            for n, offset in places:
                starts.setdefault(n, set()).add(last + 1 - size - offset)
        out = []
        for n, diagonals in starts.items():
            item, budget = self.items[n], self.budget[n]
            whole = [d for d in diagonals if d >= 0 and text.startswith(item, d)]
            if whole:
                best = (0, min(whole) + len(item))
            else:
                best = (budget + 1, 0)
                for lo, hi in self._windows(sorted(diagonals), len(item), budget):
                    distance, end = least_distance(item, text[lo:hi])
                    best = min(best, (distance, lo + end))
            if best[0] <= budget:
                out += [(key, *best) for key in self.ids[item]]
        return sorted(out)

    @staticmethod
    def _windows(diagonals: list[int], m: int, budget: int) -> Iterator[tuple[int, int]]:
        lo = hi = None
        for d in diagonals:
            a, b = max(d - budget, 0), d + m + budget
            if hi is not None and a <= hi:
                hi = max(hi, b)
                continue
            if hi is not None:
                yield lo, hi
            lo, hi = a, b
        if hi is not None:
            yield lo, hi


_READY: dict[tuple[str, float], Finder] = {}


def _finder(block: Broadcast, error_rate: float) -> Finder:
    # By a name of the block's own: workers are used again, and so are the addresses of blocks that they let go.
    name, items = block.value
    key = (name, error_rate)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Finder(items, error_rate)
    return _READY[key]


def blocks(benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    """A name and its items as (id, text), in broadcasts of about ``block_bytes`` at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    context, n = benchmark.sparkSession.sparkContext, max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [context.broadcast((uuid.uuid4().hex, [tuple(r) for r in items.filter(part == k).collect()])) for k in range(n)]


def matches(
    docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, distance, end): one row a document and item that it holds; ``end`` counts characters of normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for block in blocks(benchmark, block_bytes):

        def of(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = _finder(block, error_rate)
            for batch in batches:
                rows, hits = [], []
                for n, text in enumerate(batch.column("text")):
                    own = finder.find(text.as_py())
                    rows += [n] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                    + [pa.array([h[k] for h in hits], pa.int64()) for k in range(3)],
                    names=["doc_id", "item_id", "distance", "end"],
                )

        one = docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, item_id long, distance long, end long")
        found = one if found is None else found.unionByName(one)
    return found


def clean(
    docs: DataFrame, benchmark: DataFrame, *, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for block in blocks(benchmark, block_bytes):

        def of(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = _finder(block, error_rate)
            for batch in batches:
                yield batch.filter(pa.array(np.array([not finder.find(x.as_py()) for x in batch.column("text")], bool)))

        docs = docs.mapInArrow(of, docs.schema)
    return docs
