"""Centroid clustering over zone maps along a space-filling curve.

Vectors of integers are put in the order of a Hilbert curve, which keeps near ones together, and cut into blocks; a block is one row that holds its
ids, its vectors as one matrix, and the box of their least and greatest components (its zone map).  For a centroid the box gives the
least and greatest squared distance that any vector of the block can have.  Centroids whose least distance is beyond the smallest
greatest one can be nobody's nearest; the others are the block's candidates.  A single candidate takes the block whole, by sums that are stored with it; several
are compared exactly, in one matrix product a block.

Each round is one narrow pass over the written blocks.  A task adds up its sums by cluster before they leave it, so a round moves
clusters times components numbers a task, whatever the rows and however they are divided among clusters.  All arithmetic is in integers, so results do not
depend on how rows are dealt.

Defined cases: vectors that are null, of another length than ``size``, or that hold null or non-finite components take no part, nor do those with a
component of ``LIMIT`` or more beside zero after scaling, whose squared distances would not fit 64 bits; repeated rows and rows that share an id count
each; a null id hashes last; ties of hash go to the lesser vector and ties of distance to the smaller number; fewer vectors than clusters make fewer
clusters; an inertia beyond 64 bits is null; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors of a block; blocks of a task, about; bits of each component on the curve.
BLOCK, BLOCKS_A_TASK, BITS = 256, 128, 4
#: Components after scaling lie within this: (2 * LIMIT)^2 * 64 components is less than 2^63.
LIMIT = 1 << 27
#: Centroids travel to all tasks: at most so many numbers in all.
MOST_NUMBERS = 1 << 24


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes whose order is that of the Hilbert curve through a grid of 2^bits cells a side (the transposed form of public knowledge).

    ``cells``: (rows, dimensions), unsigned.
    """
    x = cells.T.astype(np.uint32).copy()
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(len(x)):
            high = ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(bool)
            turned = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, turned)
            x[i] ^= turned
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    planes = np.concatenate([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.astype(np.uint8).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, in order, of the centroids that may be nearest to a vector of the box."""
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    return np.flatnonzero((least * least).sum(1) <= (most * most).sum(1).min())


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; ``among`` is in order, and the first of equals is taken.

    Products of doubles are exact while they and their sums stay below 2^53; larger numbers are multiplied as integers.
    """
    own = centroids[among]
    if len(among) == 1:
        return np.full(len(vectors), among[0]), ((vectors - own[0]) ** 2).sum(1)
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(own).max(initial=0)))
    if largest * largest * vectors.shape[1] < 1 << 53:
        products = np.rint(vectors.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
    else:
        products = vectors @ own.T
    apart = (own * own).sum(1) - 2 * products
    best = apart.argmin(1)
    return among[best], (vectors * vectors).sum(1) + apart[np.arange(len(vectors)), best]


def _ints(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def usable(vector: Column, size: int, scale: float) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float(LIMIT))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & sound, F.lit(False))


class Blocks:
    """Written blocks of vectors in the order of the curve."""

    def __init__(self, table: DataFrame, size: int):
        self.table, self.size = table, size

    def assigned(self, centroids: np.ndarray, *, totals: bool) -> DataFrame:
        """Of each vector (vec_id, cluster, distance); with ``totals`` of each cluster (cluster, n, distance, sums), added up by task."""
        size, k = self.size, len(centroids)
        shared = self.table.sparkSession.sparkContext.broadcast(centroids)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            # Sums of a task: components of 28 bits, and distances of 62 bits in two halves.
            n, sums, upper, lower = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
            for batch in batches:
                lows, highs, whole = (_ints(batch.column(c), size) for c in ("low", "high", "total"))
                for at in range(len(batch)):
                    vectors = np.frombuffer(batch.column("vectors")[at].as_py(), "<i8").reshape(-1, size)
                    among = candidates(lows[at], highs[at], centroids)
                    number, distance = nearest(vectors, centroids, among)
                    if not totals:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("ids")[at].values, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                        )
                        continue
                    for c in np.unique(number):
                        mine = number == c
                        n[c] += mine.sum()
                        sums[c] += whole[at] if mine.all() else vectors[mine].sum(0)
                        upper[c] += (distance[mine] >> 31).sum()
                        lower[c] += (distance[mine] & (2**31 - 1)).sum()
            if totals:
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), *(pa.array(x[own]) for x in (n, upper, lower)), pa.array(list(sums[own]), pa.list_(pa.int64()))],
                    names=["cluster", "n", "upper", "lower", "sums"],
                )

        kinds = "cluster int, n long, upper long, lower long, sums array<long>" if totals else "vec_id long, cluster int, distance long"
        return self.table.mapInArrow(of, kinds)

    def totals(self, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
        """Of each cluster that is not empty: vectors, summed distances, component sums.  As many rows as there are numbers in all centroids come back."""
        whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
        added = (
            self.assigned(centroids, totals=True).select("cluster", "n", "upper", "lower", F.posexplode("sums").alias("pos", "x"))
            .groupBy("cluster", "pos").agg(*(whole(c).alias(c) for c in ("n", "upper", "lower", "x")))
        )
        found: dict[int, tuple[int, int, list[int]]] = {}
        for r in added.orderBy("cluster", "pos").collect():
            found.setdefault(r.cluster, (int(r.n), (int(r.upper) << 31) + int(r.lower), []))[2].append(int(r.x))
        return found


def blocks(vectors: DataFrame, *, size: int, scale: float, block: int = BLOCK, bits: int = BITS) -> Blocks:
    """The usable vectors of (vec_id, embedding), scaled and floored, in blocks along the curve."""
    scaled = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).filter(usable(F.col("v"), size, scale))
    # The curve's grid spans the greatest component of all; one number.
    n, reach = base.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    reach = max(float(reach or 0.0), 1e-300)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            cells = np.clip((x / reach + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.uint32)
            keys = [k.tobytes() for k in hilbert(cells, bits)]
            ints = np.floor(x * scale).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in ints], pa.binary())], names=["vec_id", "place", "ints"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block:
                held = yield from emitted(held, last=False)
        yield from emitted(held, last=True)

    def emitted(held: list[pa.RecordBatch], *, last: bool):
        if not sum(map(len, held)):
            return []
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        end = len(whole) if last else len(whole) // block * block
        for at in range(0, end, block):
            part = whole.slice(at, block)
            x = _ints(part.column("ints"), size)
            raw = [a.astype("<i8").tobytes() for a in (x, x.min(0), x.max(0), x.sum(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("vec_id")), *(pa.array([r], pa.binary()) for r in raw)],
                names=["ids", "vectors", "low", "high", "total"],
            )
        return [whole.slice(end)]

    # Equal vectors have equal places, however many they are: ids and row numbers divide them among ranges.
    order = ("place", "vec_id", "row_number")
    dealt = (
        base.mapInArrow(placed, "vec_id long, place binary, ints binary").withColumn("row_number", F.monotonically_increasing_id())
        .repartitionByRange(max(1, math.ceil(n / (block * BLOCKS_A_TASK))), *order).sortWithinPartitions(*order)
    )
    kinds = "ids array<long>, vectors binary, low binary, high binary, total binary"
    return Blocks(checkpointed(dealt.select("vec_id", "ints").mapInArrow(cut, kinds)), size)


def first_centroids(vectors: DataFrame, k: int, *, size: int, scale: float) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``1:<vec_id>``, in that order."""
    v = F.col("embedding").cast("array<double>")
    ints = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select("vec_id", v.alias("v")).filter(usable(F.col("v"), size, scale)).select(hashed.alias("h"), ints.alias("ints"))
    return np.array([r.ints for r in rows.orderBy(F.asc_nulls_last("h"), "ints").limit(k).collect()], np.int64).reshape(-1, size)


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable row of (vec_id, embedding).

    ``rounds`` times all vectors are assigned and every non-empty centroid moves to the floor of its mean; then they are assigned once more.
    """
    if k * size > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} numbers in all centroids")
    spark = vectors.sparkSession
    made = blocks(vectors, size=size, scale=scale, block=block, bits=bits)
    centroids = first_centroids(vectors, k, size=size, scale=scale)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, _, sums) in made.totals(centroids).items():
            centroids[c] = [x // n for x in sums]
    inertia = {c: apart for c, (_, apart, _) in made.totals(centroids).items()} if len(centroids) else {}
    fits = lambda x: x if x < 1 << 63 else None
    rows = [
        (c, fits(apart), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, apart in inertia.items()
    ]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.assigned(centroids, totals=False).join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """The same for ``embeddings`` in SQL, round by round."""
    apart = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    ctes = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {size})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS (SELECT vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS n
 FROM (SELECT v.vec_id, v.x, c.c, {apart}::BIGINT AS d FROM v CROSS JOIN c{r} AS c) GROUP BY vec_id)"""
        )
        if r < rounds:
            ctes.append(
                f"""s{r} AS (SELECT c, i, sum(y) AS s, count(*) AS n FROM (SELECT n.c AS c, unnest(x) AS y, unnest(range(1, {size + 1})) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN m{r} AS m ON c.c = m.c)"""
            )
    ctes = ",\n".join(ctes)
    return f"""WITH {ctes}
SELECT vec_id, n.c::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS f ON f.c = n.c
"""
