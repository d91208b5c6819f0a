import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from titlemart.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def told(df):
    rows = [tuple(r)[:8] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(turns):
    return [(c, k, role, text) for c, t in turns.items() for k, (role, text) in enumerate(t)]


def shared(seed=2, n=150):
    """Conversations that branch off each other, a first turn in most of them, a conversation of many turns, and copies of one."""
    rng = random.Random(seed)
    out = {0: [("system", "be brief")]}
    for c in range(1, n):
        base = rng.choice(list(out.values()))
        own = [(rng.choice(["user", "bot"]), rng.choice("abc") * rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
        out[c * 3 - 40] = base[: rng.randint(0, len(base))] + own if c % 9 else [("system", "be brief")]
    out[7777] = [("user", f"turn {k % 5}") for k in range(400)]
    out[-7] = [("user", f"turn {k % 5}") for k in range(390)] + [("user", "é漢😀")]
    return out


@pytest.mark.parametrize("turns_a_range, nodes_a_range", [(40, 30), (1 << 17, 1 << 15)])
def test_tries_match_brute_force(spark, turns_a_range, nodes_a_range):
    turns = shared()
    df = spark.createDataFrame(rows_of(turns), SCHEMA).repartition(5)
    ids = spark.createDataFrame([(c,) for c in turns], "conv_id long")
    done = prefix_trie.build(df, ids, turns_a_range=turns_a_range, nodes_a_range=nodes_a_range)
    want = brute.trie(turns)
    assert told(done) == want and any(x[7] == brute.sha(b"") for x in want)
    # Places are those of one tour, and children lie inside their parents.
    places = done.collect()
    assert sorted([r.enter for r in places] + [r.exit for r in places]) == list(range(2 * len(places)))
    by = {(r.conv_id, r.depth): r for r in places}
    for r in places:
        assert (r.exit - r.enter == 1) == (r.n_children == 0)
        if r.depth:
            p = by[r.parent_conv_id, r.depth - 1]
            assert p.enter < r.enter < r.exit < p.exit


@pytest.mark.parametrize("turns_a_range", [25, 1 << 17])
def test_openings_are_those_of_the_first_of_a_hundred(spark, turns_a_range):
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 120, 3), *range(195, 310, 5), 1001, -5, -100, -230]:
        rows += [(c, k, rng.choice(["user", None]), rng.choice([None, "", "hm", f"text {c}"])) for k in range(rng.randint(1, 9))]
    rows += [(1002, None, "user", "null first"), (1002, 5, "b", "tie"), (1002, 5, "a", "tie"), (1002, 5, "a", "tie"), (None, 1, "user", "no id")]
    rows += [(100, k, "user", f"long {k}") for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns, ids = prefix_trie.with_shared_openings(df, turns_a_range=turns_a_range)
    want = brute.rebuilt(rows)
    assert {r.conv_id for r in ids.collect()} == set(want) and any(not t for t in want.values())
    got = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got == {c: t for c, t in want.items() if t}
    assert told(prefix_trie.build(turns, ids, turns_a_range=turns_a_range, nodes_a_range=turns_a_range)) == brute.trie(want)


def test_a_driver_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert told(queries.op12_prefix_trie(spark, sf_dir)) == brute.trie(brute.rebuilt(rows))


def test_odd_turns(spark):
    rows = [
        (1, None, None, None), (1, None, None, None), (2, None, "", ""), (3, 1, "user", "x" * 100_000), (3, 0, "user", "first"), (4, 0, "user", "first"),
        (None, 0, "user", "no id"), (None, None, None, None), (5, 0, "us", "erfirst"), (6, 0, "userf", "irst"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("mine"), "DEPTH": F.lit(2), "range": F.lit(3), "saved": F.lit(4)})
    turns = {1: [("", "")] * 2, 2: [("", "")], 3: [("user", "first"), ("user", "x" * 100_000)], 4: [("user", "first")], 5: [("us", "erfirst")], 6: [("userf", "irst")]}
    assert told(prefix_trie.build(df)) == brute.trie(turns)
    assert prefix_trie.build(df.limit(0)).count() == prefix_trie.build(df.filter("conv_id IS NULL")).count() == 0
    none = spark.createDataFrame([(9,), (8,), (None,)], "conv_id long")
    got = prefix_trie.build(df.limit(0), none).collect()
    assert [tuple(r)[:8] for r in got] == [(8, 0, None, 2, 0, 1, 0, brute.sha(b"8,9"))]
    turns, ids = prefix_trie.with_shared_openings(df.limit(0))
    assert turns.count() == ids.count() == 0


def test_a_conversation_over_many_ranges(spark):
    """A third of all turns are one conversation's; another shares all but its last."""
    turns = {5: [("u", str(k)) for k in range(500)], 6: [("u", str(k)) for k in range(499)] + [("u", "end")]}
    turns |= {10 + c: [("u", str(c))] for c in range(500)}
    df = spark.createDataFrame(rows_of(turns), SCHEMA).repartition(6)
    got = prefix_trie.chained(df, range_rows=30)
    assert {(r.conv_id, r.depth) for r in got.collect()} == {(c, d + 1) for c, t in turns.items() for d in range(len(t))}
    whole = {(r.conv_id, r.depth): (r.node, r.parent) for r in prefix_trie.chained(df).collect()}
    assert {(r.conv_id, r.depth): (r.node, r.parent) for r in got.collect()} == whole
    done = prefix_trie.build(df, turns_a_range=30, nodes_a_range=20)
    assert told(done) == brute.trie(turns)


def test_local_pieces_have_their_sums():
    """A path of three nodes of which the middle one is elsewhere."""
    conv, depth = np.array([4, 8]), np.array([2, 4])
    no, yes = np.array([0, 0]), np.array([True, False])
    to = {"child": (np.array([6, 0]), yes), "sibling": (no, np.array([False, False])), "parent": (np.array([0, 6]), ~yes)}
    of, sums, first, after, there = prefix_trie.local_ranks(conv, depth, to, np.ones((4, 1), np.int64))
    assert first.tolist() == [0, 1, 2] and of.tolist() == [0, 1, 2, 2] and sums.ravel().tolist() == [1, 1, 2, 1]
    assert after.tolist()[0] == [6, 3, 0] and after.tolist()[2] == [6, 3, 1] and there.tolist() == [True, False, True]


@pytest.mark.parametrize("ids_a_text", [1, 3, 4096])
def test_ends_of_a_hot_node(spark, ids_a_text):
    rows = [(b"hot", c) for c in range(-500, 1500, 2)] + [(f"n{c % 7}".encode(), c) for c in range(20)]
    df = spark.createDataFrame(rows, "node binary, conv_id long").repartition(5)
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_hashed(df, ids_a_text=ids_a_text).collect()}
    want = {}
    for node, c in sorted(rows):
        want.setdefault(node, []).append(str(c))
    assert got == {k: brute.sha(",".join(v).encode()) for k, v in want.items()}
