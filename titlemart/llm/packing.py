"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

1. Each document becomes token ids plus an end id, cut into pieces of at most ``capacity`` ids.  Only lengths and
   checksums leave the task, never ids.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input's size) goes to the driver.  Patterns of
   one to three pieces that fill a sequence exactly are enumerated on its support, repeat counts are fitted to the
   histogram by non-negative least squares (projected gradient) and rounded down to what the histogram holds; the residual histogram is
   packed by best fit, longest first, again by lengths and repeat counts, so the work does not grow with pieces.
3. Pieces take their places by arithmetic: a piece's rank among those of its length falls into one segment of the plan,
   which gives sequence and offset.  Ranks come from counts by (length, hash bucket) and a window inside each bucket, so
   a length that a third of all pieces share is spread over many tasks.

The plan is bounded by ``capacity`` (patterns of exact fill are at most ``MAX_PATTERNS``, best-fit steps at most a few for each
length), so it travels to the tasks as a broadcast.

Defined cases: null or empty text is the end id alone; repeated rows are pieces of their own; a null doc_id is carried
through; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Exactly filling patterns that the fit looks at; a coarser grid of second lengths is taken where there would be more.
MAX_PATTERNS = 60_000
#: Distinct white-space-free chunks, and words, whose ids a task remembers.
CACHED_CHUNKS = 400_000
LONGEST_CACHED = 48
#: Pieces that one hash bucket of a length holds, about; a length that many pieces share has as many buckets as they ask for.
PIECES_A_BUCKET = 500


def _byte_letters() -> dict[int, str]:
    """The vocabulary's letter of each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds(dict):
    """Ids, as bytes, of single words as the vocabulary's splitter makes them, in lower case."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if len(self) < CACHED_CHUNKS:
            self[word] = ids
        return ids


class ChunkIds(dict):
    """Ids, as bytes, of chunks between blanks.

    The vocabulary's splitter never lets a token cross white space, and its normaliser changes nothing across it, so a text's
    ids are those of its chunks in order; most chunks repeat, and are looked up.  A chunk of printable ASCII and Latin-1
    letters is split here into words, which repeat more; other chunks take the tokenizer's own way.
    """

    #: The splitter's pattern, for text in lower case of the characters that ``plain`` accepts.
    words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = WordIds(self.tokenizer)

    def __missing__(self, chunk: str) -> bytes:
        short = len(chunk) <= LONGEST_CACHED
        if short and "<|" not in chunk and self.plain.fullmatch(chunk):
            ids = b"".join(map(self.by_word.__getitem__, self.words.findall(chunk.lower())))
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if short and len(self) < CACHED_CHUNKS:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def forget(self) -> None:
        """Lets all but the tokenizer go: workers outlive their tasks, and later stages need the memory."""
        self.clear()
        self.by_word.clear()
        self[""] = b""
        release()


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, *, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = chunk_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = ids_of.of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        ids_of.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def exact_patterns(counts: np.ndarray, capacity: int, most: int = MAX_PATTERNS) -> np.ndarray:
    """At most ``most`` rows of three lengths, long to short (0: none), that fill ``capacity`` and occur in ``counts``."""
    have = np.flatnonzero(counts)
    found = [np.array([[capacity, 0, 0]])] if counts[capacity] else []
    pairs = have[(have * 2 >= capacity) & (have < capacity)]
    pairs = pairs[counts[capacity - pairs] > 0]
    found.append(np.stack([pairs, capacity - pairs, 0 * pairs], 1))
    first = have[(have * 3 >= capacity) & (have < capacity)]
    step = max(1, math.ceil(len(first) * len(have) / (4 * most)))
    for a in first:
        rest = capacity - a
        b = have[(have <= a) & (have * 2 >= rest) & (have < rest)]
        b = b[a % step :: step]
        b = b[counts[rest - b] > 0]
        found.append(np.stack([np.full_like(b, a), b, rest - b], 1))
    out = np.concatenate(found) if found else np.zeros((0, 3), int)
    return out[:: max(1, math.ceil(len(out) / most))].astype(np.int64)


def fitted(patterns: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near ``counts`` in least squares, by accelerated projected gradient."""
    size = len(counts)
    ones = (patterns > 0).astype(float)

    def lengths(x: np.ndarray) -> np.ndarray:
        y = np.bincount(patterns.ravel(), (ones * x[:, None]).ravel(), size)
        y[0] = 0
        return y

    def back(y: np.ndarray) -> np.ndarray:
        return (y[patterns] * ones).sum(1)

    # A pattern's step is bounded by how many patterns its lengths take part in.
    busy = lengths(np.ones(len(patterns)))
    step = 1 / np.maximum(back(np.maximum(busy, 1)), 1)
    x = ahead = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(ahead - step * back(lengths(ahead) - counts), 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], capacity: int, max_patterns: int = MAX_PATTERNS) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences): every piece of the histogram once.

    ``max_patterns`` bounds what the fit looks at; what its patterns leave is packed by best fit, so no piece is left out.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    made: list[tuple[list[int], int]] = []
    patterns = exact_patterns(counts, capacity, max_patterns)
    if len(patterns):
        x = fitted(patterns, counts.astype(float))
        for k in np.argsort(-x, kind="stable"):
            own = [int(v) for v in patterns[k] if v]
            n = min(int(x[k]), *(int(counts[v]) // own.count(v) for v in own))
            if n > 0:
                made.append((own, n))
                for v in own:
                    counts[v] -= n
    left = [int(v) for v in np.flatnonzero(counts)]
    while left:  # best fit, longest first, for as many sequences at once as the scarcest length allows
        own, room = [], capacity
        need: dict[int, int] = {}
        at = len(left)
        while at:
            at = bisect.bisect_right(left, room, 0, at)
            if not at:
                break
            length = left[at - 1]
            take = min(room // length, int(counts[length]))
            own += [length] * take
            need[length] = take
            room -= take * length
            at -= 1
        n = min(int(counts[v]) // k for v, k in need.items())
        made.append((own, n))
        for v, k in need.items():
            counts[v] -= n * k
            if not counts[v]:
                left.pop(bisect.bisect_left(left, v))
    return made


def segments(made: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: ranks from ``first`` on go ``per`` to a sequence from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for own, n in made:
        offset = 0
        for length in dict.fromkeys(own):
            per = own.count(length)
            rows.append((length, used[length], per, sequence, offset))
            used[length] += n * per
            offset += per * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "per", "sequence", "offset"))}


def pack(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = 4096, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place, gapless in its sequence."""
    spark = docs.sparkSession
    cut = checkpointed(pieces(docs, path, end_id=end_id, capacity=capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= capacity rows
    table = segments(plan(histogram, capacity, max_patterns), capacity)
    keys = table["length"] << 40 | table["first"]  # ranks stay below 2**40
    place = spark.sparkContext.broadcast((keys, table))

    buckets = [(length, math.ceil(n / PIECES_A_BUCKET)) for length, n in histogram.items()]  # <= capacity rows
    by_length = F.broadcast(spark.createDataFrame(buckets, "length long, buckets int"))
    dealt = cut.join(by_length, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets").cast("int")).drop("buckets")
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    )
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, t = place.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            nth = rank - t["first"][at]
            sequence = t["sequence"][at] + nth // t["per"][at]
            offset = t["offset"][at] + nth % t["per"][at] * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).cast("long").alias("rank")
    ).mapInArrow(
        seat, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
