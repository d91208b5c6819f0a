"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each codebook.  Codebooks start as residual k-means and are
refitted together by least squares over beam-searched codes, on a sample of at most ``SAMPLE`` vectors (the rows of least hash), on the
driver.  Every vector is then coded by beam search; beside its codes goes the squared norm of the coded vector and the scale that brings it
nearest to the vector itself.

A query's inner products with all codewords form a lookup table, and a coded vector's score is the sum of its entries, scaled (for
Euclidean distance, joined with the stored norm).  The ``pool`` best by that score are ranked again by the exact measure on the original
vectors.

Equal vectors are one class, searched once under its smallest id, so copies can't crowd others out of the pool; of each
class the first ``k + 1`` members by id are all that an answer can need.

Every query is scored against the whole index, at every size alike: the vectors are dealt by hash into parts, the queries into blocks, by
counted size, and best-of lists shrink before they are shuffled.  So work grows with queries times vectors, at one addition a codebook.  With
``probes`` the index is dealt into coarse cells of about ``cell_rows`` vectors around centres fitted on the same sample, and a query visits only the
``probes`` cells nearest to it; what that costs in recall depends on the vectors, and is for the caller to measure.

Defined cases: vectors that are null, empty, zero, of another length than the index's, or that hold null or non-finite components take no
part, as query or candidate; a row is not its own candidate, but rows of equal id are one (of several vectors that of least hash); ties go to the smaller id; fewer candidates
than ``k`` give all; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, two_hashes

#: Bound of the sample that codebooks are fitted on: rows.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 32, 64, 8
#: Vectors of a cell, about, and at most in one of its parts, about; guesses that one task may return, about.
CELL_ROWS, GUESSES = 8192, 1 << 20
#: Bound of the centres that travel to the tasks, where cells are asked for.
MOST_CELLS = 1024
POOL = 500


class Codebooks:
    """``books`` codebooks as rows of one matrix."""

    def __init__(self, words: np.ndarray, books: int):
        self.words, self.books = np.ascontiguousarray(words, np.float32), books

    @property
    def per_book(self) -> int:
        return len(self.words) // self.books

    def encode(self, vectors: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Row numbers of ``words``, one a book: the best codes that a beam search finds."""
        out = np.empty((len(vectors), self.books), np.int32)
        for lo in range(0, len(vectors), 256):
            out[lo : lo + 256] = self._encode(vectors[lo : lo + 256].astype(np.float32), beam)
        return out

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        k = self.per_book
        codes = np.zeros((len(x), 1, 0), np.int32)
        rest = x[:, None, :]
        for m in range(self.books):
            own = self.words[m * k : (m + 1) * k]
            cost = (rest**2).sum(2)[:, :, None] + (own**2).sum(1) - 2 * (rest @ own.T)
            flat = cost.reshape(len(x), -1)
            keep = min(beam if m + 1 < self.books else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            from_, word = best // k, best % k
            codes = np.concatenate(
                [np.take_along_axis(codes, from_[:, :, None], 1), (word + m * k).astype(np.int32)[:, :, None]], 2
            )
            rest = np.take_along_axis(rest, from_[:, :, None], 1) - own[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[codes].sum(1)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres.astype(np.float32)


def fit(sample: np.ndarray, *, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 1) -> Codebooks:
    rng = np.random.default_rng(seed)
    rest, found = sample.astype(np.float32).copy(), []
    for _ in range(books):
        centres = _k_means(rest, words, 8, rng)
        found.append(centres)
        rest -= centres[(rest @ centres.T * -2 + (centres**2).sum(1)).argmin(1)]
    made = Codebooks(np.concatenate(found), books)
    for _ in range(rounds):
        codes = made.encode(sample)
        n = len(made.words)
        both = np.zeros((n, n), np.float32)
        for i in range(books):
            for j in range(books):
                np.add.at(both, (codes[:, i], codes[:, j]), 1)
        sums = np.zeros((n, sample.shape[1]), np.float32)
        for i in range(books):
            np.add.at(sums, codes[:, i], sample)
        # A little weight on the present codewords keeps unused ones where they are.
        solved = np.linalg.solve(both + 0.1 * np.eye(n, dtype=np.float32), sums + 0.1 * made.words)
        made = Codebooks(solved, books)
    return made


def usable(vector: Column, size: int | None = None) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(vector) == size), F.lit(False))


def _matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), size)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` cells, of unit length."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    made = _k_means(unit.astype(np.float32), cells, 10, np.random.default_rng(2))
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-30)


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    pool: int = POOL,
    probes: int | None = None,
    metric: str = "inner",
    books: int = BOOKS,
    words: int = WORDS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row the ``k`` nearest other rows of (vec_id, embedding).

    ``metric`` "inner": greatest inner product; "l2": least squared distance, scored as its negative.
    """
    if metric not in ("inner", "l2"):
        raise ValueError(f"no such metric: {metric}")
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"), is_query.alias("is_query")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )
    sample = base.select("v").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).toArrow()
    if not len(sample):
        return base.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")
        ).limit(0)
    lengths = np.array([len(x) for x in sample["v"]])
    size = int(np.bincount(lengths).argmax())
    fitted = np.array([x.as_py() for x, n in zip(sample["v"], lengths, strict=True) if n == size])
    hashed = base.filter(F.size("v") == size).withColumns(dict(zip(("h1", "h2"), two_hashes(F.col("v")), strict=True)))
    one = F.min_by(F.struct("v", "h1", "h2"), F.struct("h1", "h2")).alias("one")
    base = checkpointed(hashed.groupBy("vec_id").agg(F.max("is_query").alias("is_query"), one).select("vec_id", "is_query", "one.*"))
    n = base.count()
    cells = 1 if probes is None else min(MOST_CELLS, math.ceil(n / cell_rows))
    shared = spark.sparkContext.broadcast((fit(fitted, books=books, words=words), _centres(fitted, cells) if cells > 1 else None))

    # Classes of equal vectors; row_number() is cut to k + 1 before its shuffle.
    same = W.partitionBy("h1", "h2").orderBy("vec_id")
    members = (
        base.select("h1", "h2", "vec_id").withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
    )
    reps = base.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.first("v").alias("v"))

    def near(x: np.ndarray, centres: np.ndarray | None, most: int) -> np.ndarray:
        """Row by row the nearest cells."""
        if centres is None:
            return np.zeros((len(x), 1), np.int32)
        return np.argsort(-(x.astype(np.float32) @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)

    def code(batches):
        made, centres = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            codes = made.encode(x)
            decoded = made.decode(codes).astype(np.float64)
            norm = (decoded**2).sum(1)
            scale = np.where(norm > 0, (decoded * x).sum(1) / np.maximum(norm, 1e-30), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary()),
                 pa.array(norm, pa.float64()), pa.array(scale, pa.float64()), pa.array(near(x, centres, 1)[:, 0])],
                names=["rep", "codes", "norm", "scale", "cell"],
            )

    def visit(batches):
        for batch in batches:
            cell = near(_matrix(batch.column("v"), size), shared.value[1], probes or 1)
            own = np.repeat(np.arange(len(batch)), cell.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(own)) for c in ("query_id", "v")), pa.array(cell.ravel())], names=["query_id", "v", "cell"]
            )

    coded = reps.select("rep", "v").mapInArrow(code, "rep long, codes binary, norm double, scale double, cell int")
    queries = base.filter("is_query").select(F.col("vec_id").alias("query_id"), "v")
    visits = queries.mapInArrow(visit, "query_id long, v array<double>, cell int")
    if cells > 1:
        coded, visits = checkpointed(coded), checkpointed(visits)
        in_cell, to_cell = ({r["cell"]: r["count"] for r in x.groupBy("cell").count().collect()} for x in (coded, visits))  # <= MOST_CELLS rows
    else:
        in_cell, to_cell = {0: n}, {0: queries.count()}
    # A cell has parts and query blocks as its size asks for.  Parts are dealt by hash, so each holds its share of a query's best; six deviations more than the mean are kept.
    rows, part = [], 0
    for cell, held in sorted(in_cell.items()):
        parts = math.ceil(held / cell_rows)
        share = pool / parts
        keep = min(pool, math.ceil(share + 6 * math.sqrt(share) + 10))
        rows.append((cell, part, parts, max(1, math.ceil(to_cell.get(cell, 0) * keep / GUESSES)), keep))
        part += parts
    dealt = F.broadcast(spark.createDataFrame(rows, "cell int, base int, parts int, asks int, keep int"))
    index = coded.join(dealt, "cell").select(
        "rep", "codes", "norm", "scale", "keep", (F.col("base") + F.pmod(F.xxhash64("rep"), "parts")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"),
    )
    asked = visits.join(dealt, "cell").select(
        "query_id", "v", F.pmod(F.xxhash64("query_id"), "asks").cast("int").alias("ask"),
        F.explode(F.sequence(F.col("base").cast("long"), F.col("base").cast("long") + F.col("parts") - 1)).alias("part"),
    )

    def scan(key, index, queries):
        found_q, found_r, found_s = [], [], []
        if len(index) and len(queries):
            made, keep = shared.value[0], index["keep"][0].as_py()
            index = index.sort_by("rep")
            reps = index["rep"].to_numpy()
            codes = np.frombuffer(b"".join(index["codes"].to_pylist()), "<u2").reshape(len(reps), -1).astype(np.int64)
            norm, scale = index["norm"].to_numpy(), index["scale"].to_numpy()
            q, ids = _matrix(queries["v"], size), queries["query_id"].to_numpy()
            for lo in range(0, len(q), 32):
                own = q[lo : lo + 32].astype(np.float32) @ made.words.T
                score = np.zeros((len(own), len(reps)), np.float32)
                for m in range(made.books):
                    score += own[:, codes[:, m]]
                score = 2 * score - norm if metric == "l2" else score * scale
                for i, s in enumerate(score):
                    if len(s) > keep:
                        least = np.partition(s, len(s) - keep)[len(s) - keep]
                        over = np.flatnonzero(s > least)
                        at = np.concatenate([over, np.flatnonzero(s == least)[: keep - len(over)]])
                    else:
                        at = np.arange(len(s))
                    found_q.append(np.full(len(at), ids[lo + i]))
                    found_r.append(reps[at])
                    found_s.append(s[at].astype(np.float64))
        none = [np.zeros(0)]
        return pa.table({
            "query_id": pa.array(np.concatenate(found_q or none).astype(np.int64)),
            "rep": pa.array(np.concatenate(found_r or none).astype(np.int64)),
            "guess": pa.array(np.concatenate(found_s or none)),
        })

    guessed = index.groupBy("part", "ask").cogroup(asked.groupBy("part", "ask")).applyInArrow(
        scan, "query_id long, rep long, guess double"
    )
    by_guess = W.partitionBy("query_id").orderBy(F.desc("guess"), "rep")
    pooled = guessed.withColumn("nth", F.row_number().over(by_guess)).filter(F.col("nth") <= pool).select("query_id", "rep")

    step = (lambda a, b: a * b) if metric == "inner" else (lambda a, b: -(a - b) * (a - b))
    exact = F.aggregate(F.zip_with("q", "v", step), F.lit(0.0), lambda s, x: s + x)
    ranked = (
        pooled.join(reps, "rep").join(queries.withColumnRenamed("v", "q"), "query_id")
        .select("query_id", "rep", "h1", "h2", exact.alias("score"))
        .withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "rep")))
        .filter(F.col("nth") <= k + 1).drop("nth")
    )
    last = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        ranked.join(members, ["h1", "h2"])
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
