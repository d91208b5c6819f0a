import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from titlemart.llm import queries, zone_clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def key(row):
    return [(x is None, x or 0) if not isinstance(x, str) else x for x in row]


def same(df, want):
    return sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_the_curve_visits_every_cell_by_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (5, 1), (2, 5)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in zone_clusters.hilbert(cells, bits)]
        assert len(set(keys)) == side**dims
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path.astype(int), axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(3)
    fewer = 0
    for _ in range(200):
        vectors = rng.integers(-9, 9, (rng.integers(1, 20), 4)) + rng.integers(-40, 40, 4)
        centroids = rng.integers(-50, 50, (12, 4))
        among = zone_clusters.candidates(vectors.min(0), vectors.max(0), centroids)
        apart = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        number, distance = zone_clusters.nearest(vectors, centroids, among)
        assert (number == apart.argmin(1)).all() and (distance == apart.min(1)).all()
        fewer += len(among) < len(centroids)
    assert fewer > 100


def test_large_numbers_are_exact():
    big = zone_clusters.LIMIT - 1
    vectors = np.array([[big] * 64, [-big] * 64, [big - 1] * 64], np.int64)
    centroids = np.array([[-big] * 64, [big] * 64, [big - 1] * 63 + [big]], np.int64)
    number, distance = zone_clusters.nearest(vectors, centroids, np.arange(3))
    assert number.tolist() == [1, 0, 2] and distance.tolist() == [0, 0, 1]
    assert int(zone_clusters.nearest(vectors[:1], centroids, np.array([0]))[1][0]) == 64 * (2 * big) ** 2


@pytest.mark.parametrize("block", [3, 64])
def test_a_hot_vector_and_ties(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 64) / 64], 1) for i in range(150)]
    rows += [(1000 + i, [0.25] * 64, 2) for i in range(80)] + [(7, rows[7][1], 3), (None, [0.5] * 64, 4), (None, [0.5] * 64, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute.clusters([r[:2] for r in rows])
    assert same(zone_clusters.cluster(df, block=block), want)
    assert same(zone_clusters.cluster(df, k=3, rounds=1, block=block, bits=1), brute.clusters([r[:2] for r in rows], 3, 1))


def test_a_driver_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert same(queries.op11_centroid_clusters(spark, sf_dir), brute.clusters(rows))


def test_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [1.0] * 63, 0), (4, [math.nan] + [1.0] * 63, 0), (5, [math.inf] + [1.0] * 63, 0), (6, [None] + [1.0] * 63, 0),
        (7, [0.0] * 64, 0), (8, [-0.01] * 64, 0), (8, [-0.01] * 64, 0), (9, [3e38] * 64, 0), (10, [1.0] * 64, None),
    ]
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("mine"), "ids": F.lit(1), "PLACE": F.lit(2)})
    assert same(zone_clusters.cluster(clashing), brute.clusters([r[:2] for r in rows if r[0] in (7, 8, 10)]))
    assert zone_clusters.cluster(clashing.limit(0)).count() == zone_clusters.cluster(clashing.filter("vec_id < 7")).count() == 0


def test_an_inertia_beyond_64_bits_is_null(spark):
    big = float(zone_clusters.LIMIT - 1) / 64
    rows = [(i, [big if i % 2 else -big] * 64, 0) for i in range(16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = zone_clusters.cluster(df, k=1, rounds=1).collect()
    assert len(got) == 16 and {r.inertia for r in got} == {None} == {r.cluster_inertia for r in got} and all(r.distance > 1 << 58 for r in got)


def test_blocks_lie_along_the_curve_and_split_equal_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 64)) * 3
    rows = [(int(i), [float(x) for x in centres[i % 6] + rng.normal(size=64) * 0.02], 0) for i in range(600)] + [(1000 + i, [0.1] * 64, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = zone_clusters.blocks(df, size=64, scale=64.0, block=16)
    held = made.table.collect()
    assert sum(len(b.ids) for b in held) == 900 and max(len(b.ids) for b in held) == 16
    ints = lambda raw: np.frombuffer(bytes(raw), "<i8")
    first = zone_clusters.first_centroids(df, 16, size=64, scale=64.0)
    left = [len(zone_clusters.candidates(ints(b.low), ints(b.high), first)) for b in held]
    assert np.median(left) < 8  # of 16
    for b in held:
        x = ints(b.vectors).reshape(-1, 64)
        assert (x.min(0) == ints(b.low)).all() and (x.max(0) == ints(b.high)).all() and (x.sum(0) == ints(b.total)).all()
