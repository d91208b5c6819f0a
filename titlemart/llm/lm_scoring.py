"""Cross-entropy difference: how much better a target model than a background model predicts a document, per token.

Both models are bigram models of one form over one vocabulary, counted over all documents: the background over every document, the
target over those labelled good.  The vocabulary is every word of the corpus (blank-separated, A-Z in lower case) and the mark before a
document's first word.  A token's probability is

    p(w | v) = (c(v, w) + mu * u(w)) / (c(v) + mu),   u(w) = (c(w) + 1) / (n + size of the vocabulary)

with counts of the model's own documents, less the token itself where its document is one of them (leaving one out), so that
target documents are not scored by their own text.  The score is the mean over tokens of target loss less background loss, in nats: lower is
nearer to the target.

Counts are asked for through ``exchange``: batches send their distinct words and bigrams with the counts of both models, partitions
add them up and answer each batch's keys; nothing is cut off and the tables grow with the corpus, spread over the
partitions.  Keys are hashes of 63 bits and one that tells words from bigrams.

Defined cases: null or empty text has no tokens, and null losses and score; a document with several labels is a target if any is good; a null doc_id
is never labelled; repeated rows count each; without any labelled document the target is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .textkit import LOWER, first_of, mix, packed, span_hashes, words

U64 = np.uint64
_CODEC = "zstd"
_BOS = U64(0x1F83D9ABFB41BD6B)
_PAIR = U64(0x9E3779B97F4A7C15)


def _counts(values: np.ndarray) -> bytes:
    """Counts below 255 in a byte each, the others after them."""
    most = values >= 255
    plain = np.minimum(values, 255).astype(np.uint8).tobytes() + values[most].astype("<u4").tobytes()
    return np.array([len(values), len(plain)], "<u4").tobytes() + pa.compress(plain, _CODEC, asbytes=True)


def _uncounts(raw: bytes) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    plain = pa.decompress(raw[8:], size, _CODEC, asbytes=True)
    out = np.frombuffer(plain, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(plain, "<u4", offset=n)
    return out


class Batch:
    """Tokens of a batch: word and bigram keys, and which documents are the target's."""

    def __init__(self, table: pa.Table, labels: pa.Table, bits: int):
        raw, starts = packed(table["text"])
        raw = LOWER[raw]
        lo, hi, self.text_of = words(raw, starts)
        word = span_hashes(raw, lo, hi)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        new = np.ones(len(word), bool)
        new[1:] = self.text_of[1:] != self.text_of[:-1]
        before[new] = _BOS
        pair = mix(before * _PAIR + word)
        good = set(labels["doc_id"].to_pylist()) - {None}
        self.is_target = np.array([d in good for d in table["doc_id"].to_pylist()], bool)
        shift = U64(64 - bits)
        # First words follow a mark that counts as a word once a document.
        marks = np.full(int(new.sum()), _BOS)
        owners = self.text_of[new]
        # The last bit tells words (0) from bigrams (1).
        every = np.concatenate([word, pair, marks]) >> shift & ~U64(1)
        every[len(word) : 2 * len(word)] |= U64(1)
        of = np.concatenate([self.text_of, self.text_of, owners])
        self.keys, place, _ = first_of(every)
        self.background = np.bincount(place, minlength=len(self.keys))
        self.target = np.bincount(place, self.is_target[of] if len(of) else None, len(self.keys)).astype(np.int64)
        n = len(word)
        self.word_at, self.pair_at = place[:n], place[n : 2 * n]
        self.before_at = np.empty(n, np.int64)
        self.before_at[1:] = self.word_at[:-1]
        self.before_at[new] = place[2 * n :]


def score(docs: DataFrame, good: DataFrame, *, mu: float = 5.0, batch_bytes: int = 6 << 20, **sizes) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score); ``good`` holds the doc_id of target documents."""
    texts, layout = X.batched(docs, batch_bytes=batch_bytes, **sizes)
    width = 64
    none = [F.lit(None).cast("binary").alias(c) for c in "abc"]
    labels = (
        good.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        .select(F.lit(0).alias("round"), F.lit(0).alias("part"), X.batch_of(layout), *none, "doc_id")
    )

    def ask(key, table, labels):
        if not len(table):
            return X.messages([])
        b = Batch(table, labels, width)
        return X.messages([
            (1, k, key[0].as_py(), X.squeeze(b.keys[i:j]), _counts(b.background[i:j]), _counts(b.target[i:j]))
            for k, (i, j) in layout.ranges(b.keys, width).items()
        ])

    def answer(key, table):
        rows = [(batch, X.unsqueeze(a), _uncounts(b), _uncounts(c)) for _, batch, a, b, c in X.received(table, 1)]
        keys, place, _ = first_of(np.concatenate([r[1] for r in rows]))
        both = [
            np.bincount(place, np.concatenate([r[k] for r in rows]), len(keys)).astype(np.int64) for k in (2, 3)
        ]
        a_word = keys & U64(1) == 0
        totals = [int(both[0][a_word].sum()), int(both[1][a_word].sum()), int(a_word.sum())]
        out, i = [(2, key[0].as_py(), -1, ",".join(map(str, totals)).encode())], 0
        for batch, k, *_ in rows:
            own = place[i : i + len(k)]
            out.append((1, key[0].as_py(), batch, None, _counts(both[0][own]), _counts(both[1][own])))
            i += len(k)
        return X.messages(out)

    asked = texts.groupBy("batch").cogroup(labels.groupBy("batch")).applyInArrow(ask, X.MESSAGE)
    answers = asked.groupBy("part").applyInArrow(answer, X.MESSAGE)
    # One row of totals goes to every batch beside its answers, within one plan: what was asked is shuffled once.
    said = F.split(F.decode("a", "utf-8"), ",")
    totals = answers.filter("round = 2").agg(F.array(*(F.coalesce(F.sum(said[i].cast("long")), F.lit(0)) for i in range(3))).alias("totals"))

    def losses(key, table, told):
        if not len(table):
            return _empty()
        b = Batch(table, told, width)
        at = layout.ranges(b.keys, width)
        counts = np.zeros((2, len(b.keys)))
        n_target, n_background, vocabulary = 0, 0, 1
        if len(b.keys):  # then some row has the totals
            n_background, n_target, vocabulary = told["totals"].drop_null()[0].as_py()
        for part, _, _, x, y in X.received(told, 1):
            i, j = at[part]
            counts[0, i:j], counts[1, i:j] = _uncounts(x), _uncounts(y)
        n = np.bincount(b.text_of, minlength=len(table))
        out = []
        for c, total, own in ((counts[1], n_target, b.is_target[b.text_of]), (counts[0], n_background, 1)):
            word = (c[b.word_at] - own + 1) / (total - own + vocabulary)
            p = (c[b.pair_at] - own + mu * word) / (c[b.before_at] - own + mu)
            out.append(np.bincount(b.text_of, -np.log(p), len(table)))
        target, background = (np.divide(x, n, out=np.full(len(n), np.nan), where=n > 0) for x in out)
        columns = [
            pa.array(x, pa.float64(), from_pandas=True) for x in (target, background, target - background)
        ]
        return pa.table([table["doc_id"], pa.array(n, pa.int64()), *columns], names=_NAMES)

    told = answers.filter("round = 1").withColumns({"doc_id": F.lit(None).cast("long"), "totals": totals.scalar()})
    told = told.unionByName(labels.withColumn("totals", F.lit(None).cast("array<long>")))
    return texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        losses, "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    )


_NAMES = ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]


def _empty() -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.table([pa.array([], k) for k in kinds], names=_NAMES)
