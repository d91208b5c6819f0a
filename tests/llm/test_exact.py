import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titlemart.llm import exact_dedup, queries


def key(row):
    return [(x is None, x or 0) if not isinstance(x, str) else x for x in row]


def same(df, want):
    return sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def hot_rows():
    """A text in a third of all rows, groups of two to forty, blanks of all kinds."""
    rng = random.Random(4)
    rows = [(d, "the very same\ttext  of all") for d in range(500, 700)]
    for g in range(40):
        rows += [(rng.randrange(10_000), f"group{' ' * rng.randint(1, 3)}{g}\v{'x' * g}") for _ in range(rng.randint(1, g + 1))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [1, 4, 1024])
def test_groups_match_brute_force(spark, share):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert same(exact_dedup.exact_duplicates(df, share=share), brute.exact(rows))


def test_a_driver_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute.exact(docs)
    assert any(not x[3] for x in want)
    assert same(queries.op13_exact_dedup(spark, sf_dir), want)


def test_odd_rows(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact_dedup.exact_duplicates(odd)
    assert same(got, brute.exact(docs))
    by = {r.doc_id: r for r in got.collect() if r.doc_id not in (4, 5)}
    assert by[2].keep_id == 1 and by[2].group_size == 3 and by[7].keep_id == 6 and not by[7].kept
    assert sum(r.kept for r in got.collect() if r.doc_id == 4) == 1
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.keep_first(none).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_that_stay_keep_their_columns(odd, monkeypatch, most):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    named = odd.withColumns({"digest": F.lit("mine"), "KEPT": F.lit("mine too"), "row": F.lit(3)})
    rows = exact_dedup.keep_first(named)
    assert rows.columns == named.columns
    got = rows.collect()
    want = [(d, t) for (d, t), x in zip([(r.doc_id, r.text) for r in odd.collect()], brute.exact([(r.doc_id, r.text) for r in odd.collect()]), strict=True) if x[3]]
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted(((d, t or "") for d, t in want), key=str)
    assert all(r.digest == "mine" and r.KEPT == "mine too" for r in got)


def test_nulls_and_repeats_leave_one(spark):
    rows = [(None, "a  b"), (None, "a b"), (7, "c"), (7, "c"), (7, "c"), (None, "c"), (3, None), (2, ""), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 1024):
        got = exact_dedup.exact_duplicates(df, share=share).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == 4
        assert {(r.keep_id, r.group_size) for r in got if r.kept} == {(None, 2), (7, 4), (2, 2), (9, 1)}
    assert exact_dedup.keep_first(df).count() == 4


def test_summaries_miss_no_frequent_digest():
    rng = np.random.default_rng(2)
    for counters in (1, 5, 20):
        draws = np.minimum(rng.zipf(1.4, 3000), 400)
        batches = [(pa.array([str(x).encode() for x in part]), np.ones(len(part), np.int64)) for part in np.array_split(draws, 9)]
        keys, counts = exact_dedup.misra_gries(iter(batches), counters)
        told = dict(zip(keys.to_pylist(), counts.tolist(), strict=True))
        assert len(told) <= counters
        for x, n in zip(*np.unique(draws, return_counts=True), strict=True):
            assert n - len(draws) / (counters + 1) <= told.get(str(x).encode(), 0) <= n


def test_frequent_digests_are_few_and_decided_without_a_shuffle(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = df.select(exact_dedup.digest(F.col("text")).alias("digest"))
    assert exact_dedup.frequent(rows, 100).count() == 1
    done = exact_dedup.exact_duplicates(df, share=100)
    assert done.filter("group_size = 6667").count() == 6667 and done.filter("kept").count() == 13_334
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the other digests
