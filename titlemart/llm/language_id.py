"""Language identification as inference of a mixture.

Model: for each language, the distribution of hashed byte trigrams (letters in lower case, all else as one blank), counted over all
training documents.  A document is a bag of trigrams from a mixture of languages.  Its proportions are fitted by expectation-maximisation;
which languages take part is chosen by penalised likelihood:

1. start from the language of greatest likelihood alone;
2. of the languages left, take the one whose addition raises the likelihood fastest (the gradient that EM itself needs) and
   fit the proportions of the enlarged set;
3. keep it if the log-likelihood gains more than ``penalty * log(trigrams)``, and go on; else stop.

The prediction is the language of the greatest proportion, and the score is that proportion.

A batch's documents are fitted side by side in numpy: all steps are sums over (document, trigram) entries, and documents
leave the work when their set is settled.  The model is at most ``MAX_CELLS`` numbers, whatever the corpus: with many
languages there are fewer buckets.  Training counts leave a task as at most that many sums.

Defined cases: text that is null or has no letter is ``und`` with score 0; training rows with null language or text are left
out; ties go to the language that sorts first; without any training row all are ``und``; repeated rows count each; an empty table gives an
empty result; other columns are carried along, but for those that have the name of a result, which takes their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others, slices
from .textkit import packed

U64 = np.uint64
#: Bound of the model that travels to the tasks: languages times buckets.
MAX_CELLS = 1 << 22
BUCKETS = 1 << 16
#: Texts are fitted so many bytes at a time.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[65:91] += 32
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def trigrams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the texts, and its text.  Trigrams of two blanks in a row are left out."""
    raw, starts = packed(pc.utf8_lower(texts.cast(pa.string())))
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = _LETTERS[raw]
    wide = raw.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    blank = raw == 32
    ok = (text_of[:-2] == text_of[2:]) & ~(blank[1:-1] & (blank[:-2] | blank[2:]))
    code = code[ok] * np.uint32(2654435761)
    return (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64), text_of[:-2][ok].astype(np.int64)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (bucket, language), from (text, lang)."""
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, SLICE_BYTES):
            bucket, text = trigrams(batch.column("text"), BUCKETS)
            lang = batch.column("lang").dictionary_encode()
            code = lang.indices.to_numpy()
            counts = np.bincount(code[text] * BUCKETS + bucket, minlength=len(lang.dictionary) * BUCKETS)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + counts[k * BUCKETS : (k + 1) * BUCKETS]
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(of, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_CELLS // 256 + 1).collect())
    if len(languages) > MAX_CELLS // 256:
        raise ValueError(f"more than {MAX_CELLS // 256} languages")
    fewer = 0
    while len(languages) * (BUCKETS >> fewer) > MAX_CELLS:
        fewer += 1
    folded = counted.groupBy("lang", F.shiftright("bucket", fewer).alias("bucket")).agg(F.sum("n").alias("n"))
    model = np.zeros((BUCKETS >> fewer, len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    table = folded.toArrow()  # at most MAX_CELLS rows
    code = table["lang"].combine_chunks().dictionary_encode()
    column = np.array([place[name] for name in code.dictionary.to_pylist()], int)
    if len(table):
        model[table["bucket"].to_numpy(), column[code.indices.to_numpy()]] = table["n"].to_numpy()
    total = model.sum(0, keepdims=True)
    return languages, np.log((model + 0.5) / (total + 0.5 * len(model))).astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that are not empty."""
    return np.add.reduceat(values, starts, axis=0)


def infer(bucket: np.ndarray, text: np.ndarray, n_texts: int, logs: np.ndarray, penalty: float, rounds: int):
    """Proportions (text, language); rows of texts without trigrams are 0."""
    buckets, languages = logs.shape
    out = np.zeros((n_texts, languages))
    if not len(bucket) or not languages:
        return out
    entry, count = np.unique(text * buckets + bucket, return_counts=True)
    text, bucket = entry // buckets, entry % buckets
    count = count.astype(np.float64)
    texts, starts = np.unique(text, return_index=True)
    own = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(text))))
    size = _sums(count, starts)
    # Likelihoods relative to each trigram's best language keep every product in range.
    best = logs.max(1)
    relative = np.exp(logs - best[:, None]).astype(np.float64)
    alone = _sums(count[:, None] * (logs[bucket] - best[bucket][:, None]), starts)
    share = np.zeros((len(texts), languages))
    share[np.arange(len(texts)), alone.argmax(1)] = 1
    level = alone.max(1)
    active = np.arange(len(texts)) if languages > 1 else np.zeros(0, int)
    while len(active):
        mine = np.isin(own, active)
        at, n, who = bucket[mine], count[mine], np.searchsorted(active, own[mine])
        begin = np.searchsorted(who, np.arange(len(active)))
        p = relative[at]
        now = share[active]
        mixed = np.einsum("ij,ij->i", p, now[who])
        gain = _sums((n / np.maximum(mixed, 1e-300))[:, None] * p, begin)
        gain[now > 0] = -1
        added = gain.argmax(1)
        rows = np.arange(len(active))
        open_ = gain[rows, added] > size[active]  # else no proportion of it raises the likelihood
        trial = now.copy()
        trial[rows, added] = 0.1
        trial /= trial.sum(1, keepdims=True)
        for _ in range(rounds):
            mixed = np.einsum("ij,ij->i", p, trial[who])
            trial *= _sums((n / mixed)[:, None] * p, begin) / size[active][:, None]
        mixed = np.einsum("ij,ij->i", p, trial[who])
        reached = _sums(n * np.log(np.maximum(mixed, 1e-300)), begin)
        better = open_ & (reached - level[active] > penalty * np.log(size[active] + 1)) & ((now > 0).sum(1) < languages)
        took = active[better]
        share[took], level[took] = trial[better], reached[better]
        active = took[(share[took] > 0).sum(1) < languages]
    out[texts] = share
    return out


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], *, penalty: float = 2.0, rounds: int = 12) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, lang_score and lang_mix (map of language to proportion)."""
    languages, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    docs = docs.select(*(F.col(f"`{c}`") for c in others(docs, "lang_pred", "lang_score", "lang_mix")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in slices(batches, SLICE_BYTES):
            texts = batch.column("text")
            bucket, text = trigrams(texts, len(logs))
            share = infer(bucket, text, len(batch), logs, penalty, rounds)
            worded = pc.match_substring_regex(texts.cast(pa.string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
            if not languages:
                worded[:] = False
            # A text with a letter but too short for a trigram is the likeliest language by its own share of nothing: the first.
            first = share.argmax(1) if languages else np.zeros(len(batch), int)
            score = share[np.arange(len(batch)), first] if languages else np.zeros(len(batch))
            score = np.where(worded & (score == 0), 1 / max(len(languages), 1), score)
            names = [languages[k] if w else UNKNOWN for k, w in zip(first, worded, strict=True)]
            mix = [
                [(languages[j], float(share[i, j])) for j in np.flatnonzero(share[i])] if worded[i] else []
                for i in range(len(batch))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(names, pa.string()), pa.array(np.where(worded, np.clip(score, 0, 1), 0.0)),
                    pa.array(mix, pa.map_(pa.string(), pa.float64())),
                ],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_mix"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(of, f"{kinds}, lang_pred string, lang_score double, lang_mix map<string,double>")
