"""Exact repeats of word windows by fixed-block anchors.

A window of ``window`` words holds a whole block of ``(window + 1) // 2`` words of any grid of that step, whatever its offset.  So

1. every document's blocks, end to end from its first word, are the reference index; every rolling
   window of a block's length, in all documents, probes it (a hash of 36 bits or more, as a filter);
2. hits are extended: a window that holds a hit (of a probe, or of a reference block that another document's probe hit) is
   compared in full, by 128 bits of hash over two independent ones, and the smallest document that holds it is found; windows in a row that a smaller
   document holds merge, which extends each hit to both sides to the maximal exact repeat;
3. words that such a repeat covers go.

Comparing a hit's windows with the smallest document that holds each, rather than with every other document, keeps a
group of thousands of copies linear and loses nothing: which of the smaller documents holds a window does not matter.
Both questions, blocks and windows, are put by ``exchange``: the corpus is dealt into batches and keys are
pre-aggregated by batch, so a passage in a third of all documents is one key a batch.

Defined cases: null text has no words; texts shorter than a window lose nothing; rows that share a doc_id are no
earlier than each other; a null doc_id is later than all others; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .textkit import first_of, packed, span_hashes, word_grams, words

U64 = np.uint64


class Batch:
    """The words of a batch's documents, their anchors and probes."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.ids = X.doc_ids(table)
        self.raw, self.starts = packed(table["text"])
        lo, hi, self.text_of = words(self.raw, self.starts)
        self.hashes, self.spans = span_hashes(self.raw, lo, hi), (lo, hi)
        self.first_word = np.searchsorted(self.text_of, np.arange(len(self.ids) + 1))
        gram, whole = word_grams(self.hashes, self.text_of, self.block)
        self.probe_at = np.flatnonzero(whole)
        self.probe = gram[whole]
        own = self.text_of[self.probe_at]
        self.is_anchor = (self.probe_at - self.first_word[own]) % self.block == 0
        self.doc = self.ids[own]

    def keys(self, layout: X.Layout):
        """Distinct anchor and probe keys, and each probe's place among them; least and largest document of an anchor."""
        key = layout.short(self.probe)
        anchors, anchor_place, ((least, most),) = first_of(key[self.is_anchor], self.doc[self.is_anchor])
        probes, probe_place, ((p_least, p_most),) = first_of(key, self.doc)
        return anchors, anchor_place, least, most, probes, probe_place, p_least, p_most

    def candidates(self, layout: X.Layout, answers: pa.Table):
        """Places of the windows around hits, both halves of their distinct keys, each window's place among them, each key's smallest document."""
        anchors, anchor_place, least, most, probes, probe_place, p_least, p_most = self.keys(layout)
        a_ranges, p_ranges = layout.ranges(anchors, layout.bits), layout.ranges(probes, layout.bits)
        a_hit, p_hit = np.zeros(len(anchors), bool), np.zeros(len(probes), bool)
        for part, _, a, p, _ in X.received(answers, 1):
            for hit, ranges, raw in ((a_hit, a_ranges, a), (p_hit, p_ranges, p)):
                i, j = ranges.get(part, (0, 0))
                hit[i:j] = X.flags(raw, j - i)
        # Inside the batch: an anchor of one document, a probe of another.
        to = np.searchsorted(probes, anchors)
        a_hit |= p_least[to] != p_most[to]
        p_hit[to] |= (least != most) | (p_least[to] != least) | (p_most[to] != least)
        marked = np.zeros(len(self.hashes) + 1, np.int32)
        marked[self.probe_at] = p_hit[probe_place]
        anchor_at = self.probe_at[self.is_anchor]
        marked[anchor_at] |= a_hit[anchor_place]
        gram, whole = word_grams(self.hashes, self.text_of, self.window)
        seen = np.concatenate([[0], np.cumsum(marked)])
        inner = self.window - self.block + 1
        at = np.flatnonzero(whole & (seen[inner : inner + len(gram)] > seen[: len(gram)])) if len(gram) else np.zeros(0, int)
        doc = self.ids[self.text_of[at]]
        half = word_grams(span_hashes(self.raw, *self.spans, other=True), self.text_of, self.window, other=True)[0][at]
        keys, place, ((smallest, _),) = first_of(gram[at], doc, second=half)
        halves = np.empty(len(keys), U64)
        halves[place] = half
        return at, doc, keys, halves, place, smallest


def remove_repeats(docs: DataFrame, *, window: int = 13, **sizes) -> DataFrame:
    """(doc_id, n_words, n_removed, removed array<int>, kept_text): ``removed`` holds start and end of each removed run of words."""
    texts, layout = X.batched(docs, **sizes)

    def ask_blocks(key, table):
        batch = Batch(table, window)
        anchors, _, _, _, probes, *_ = batch.keys(layout)
        # Anchors are probes too, so they have no partition beyond those of the probes.
        of = layout.ranges(anchors, layout.bits)
        return X.messages([
            (1, k, key[0].as_py(), X.squeeze(anchors[slice(*of.get(k, (0, 0)))]), X.squeeze(probes[i:j]))
            for k, (i, j) in layout.ranges(probes, layout.bits).items()
        ])

    def answer_blocks(key, table):
        rows = [(batch, X.unsqueeze(a), X.unsqueeze(p)) for _, batch, a, p, _ in X.received(table, 1)]
        index, _, ((first, last),) = first_of(
            np.concatenate([a for _, a, _ in rows]), np.concatenate([np.full(len(a), b) for b, a, _ in rows])
        )
        probed, times = np.unique(np.concatenate([p for _, _, p in rows]), return_counts=True)
        out = []
        for batch, a, p in rows:
            hit = np.zeros(len(p), bool)
            if len(index):
                at = np.minimum(np.searchsorted(index, p), len(index) - 1)
                hit = (index[at] == p) & ((first[at] != batch) | (last[at] != batch))
            out.append((1, key[0].as_py(), batch, X.bits(times[np.searchsorted(probed, a)] > 1), X.bits(hit)))
        return X.messages(out)

    def ask_windows(key, table, answers):
        if not len(table):
            return X.messages([])
        _, _, keys, halves, _, smallest = Batch(table, window).candidates(layout, answers)
        return X.messages([
            (2, k, key[0].as_py(), X.squeeze(keys[i:j]), X.narrow(smallest[i:j]), halves[i:j].tobytes())
            for k, (i, j) in layout.ranges(keys, 64).items()
        ])

    def answer_windows(key, table):
        received = X.received(table, 2)
        rows = [(batch, X.unsqueeze(a), X.widen(b)) for _, batch, a, b, _ in received]
        _, place, ((smallest, _),) = first_of(
            np.concatenate([k for _, k, _ in rows]), np.concatenate([d for _, _, d in rows]), second=np.frombuffer(b"".join(r[4] for r in received), U64)
        )
        out, i = [], 0
        for batch, k, d in rows:
            out.append((2, key[0].as_py(), batch, X.bits(smallest[place[i : i + len(k)]] < d)))
            i += len(k)
        return X.messages(out)

    def remove(key, table, answers):
        if not len(table):
            return _empty()
        batch = Batch(table, window)
        at, doc, keys, _, place, smallest = batch.candidates(layout, answers)
        ranges, earlier = layout.ranges(keys, 64), np.zeros(len(keys), bool)
        for part, _, raw, _, _ in X.received(answers, 2):
            i, j = ranges[part]
            earlier[i:j] = X.flags(raw, j - i)
        gone_at = at[earlier[place] | (doc > smallest[place])]
        n = len(batch.hashes)
        edge = np.zeros(n + 1, np.int32)
        edge[gone_at] += 1
        edge[gone_at + window] -= 1
        gone = np.cumsum(edge[:n]) > 0
        n_words, n_removed, runs, kept = [], [], [], []
        raw = batch.raw.tobytes()
        for d in range(len(table)):
            lo, hi = batch.first_word[d : d + 2]
            own, mine = raw[batch.starts[d] : batch.starts[d + 1]].split(), gone[lo:hi]
            n_words.append(len(own))
            n_removed.append(int(mine.sum()))
            if n_removed[-1]:
                own = compress(own, (~mine).tolist())
                runs.append(np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))).tolist())
            else:
                runs.append([])
            kept.append(b" ".join(own))
        return pa.table(
            [
                table["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(runs, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=_NAMES,
        )

    by_batch = texts.groupBy("batch")
    blocks = by_batch.applyInArrow(ask_blocks, X.MESSAGE).groupBy("part").applyInArrow(answer_blocks, X.MESSAGE)
    windows = (
        by_batch.cogroup(blocks.groupBy("batch")).applyInArrow(ask_windows, X.MESSAGE)
        .groupBy("part").applyInArrow(answer_windows, X.MESSAGE)
    )
    return by_batch.cogroup(blocks.unionByName(windows).groupBy("batch")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, removed array<int>, kept_text string"
    )


_NAMES = ["doc_id", "n_words", "n_removed", "removed", "kept_text"]


def _empty() -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
    return pa.table([pa.array([], k) for k in kinds], names=_NAMES)
