import brute
import pytest
from pyspark.sql import functions as F

from titlemart.llm import common, exchange, line_dedup, minhash, prefix_free_dedup, queries, substring_dedup

SMALL = {"batch_bytes": 2000, "part_bytes": 3000}  # many batches and partitions on a small table


def words_digest(df):
    return {tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}


def bytes_digest(df):
    spans = (F.size("removed") / 2).cast("long")
    return {tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256)).collect()}


def test_word_windows_match_brute_force(shared_texts):
    docs, df = shared_texts
    want = brute.substring(docs)
    assert sum(x[2] for x in want) > 100
    assert words_digest(substring_dedup.remove_repeats(df, **SMALL)) == want
    assert words_digest(substring_dedup.remove_repeats(df)) == want


@pytest.mark.parametrize("window", [2, 5, 8])
def test_word_windows_of_any_length(shared_texts, window):
    docs, df = shared_texts
    assert words_digest(substring_dedup.remove_repeats(df, window=window, **SMALL)) == brute.substring(docs, window)


def test_byte_strings_match_brute_force(shared_texts):
    docs, df = shared_texts
    want = brute.byte_repeats(docs)
    assert sum(x[2] for x in want) > 500
    assert bytes_digest(prefix_free_dedup.remove_repeats(df, **SMALL)) == want
    assert bytes_digest(prefix_free_dedup.remove_repeats(df)) == want


def test_bytes_of_one_letter(spark):
    docs = {1: "a" * 49, 2: "a" * 50, 3: "b" * 10 + "a" * 120, 4: "a" * 60 + "é" * 40}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert bytes_digest(prefix_free_dedup.remove_repeats(df, batch_bytes=100, part_bytes=100)) == brute.byte_repeats(docs)


def test_corpus_order_is_that_of_the_bytes():
    import numpy as np

    rng = np.random.default_rng(1)
    reach, gram, n = 6, 3, 400
    whole = rng.integers(97, 99, (n, 2 * reach + gram)).astype(np.uint8)
    left, right = rng.integers(0, reach + 1, n), rng.integers(0, reach + 1, n)
    place = np.arange(2 * reach + gram)
    whole[place < (reach - left)[:, None]] = 0
    whole[place >= (reach + gram + right)[:, None]] = 0
    for a, rows, new in prefix_free_dedup.corpus_order(whole, left, right, gram):
        strings = [whole[i, reach - a : 2 * reach + gram - a].tobytes() for i in rows]
        assert strings == sorted(strings)
        assert sorted(rows) == [i for i in range(n) if left[i] >= a and right[i] >= reach - a]
        assert new.tolist() == [not i or strings[i] != strings[i - 1] for i in range(len(rows))]


def test_triggers_are_dealt_evenly(spark, sf_dir):
    """Triggers have the least hashes; the ranges of their keys are even all the same."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toArrow()
    batch = prefix_free_dedup.Batch(table, 50, 20)
    keys, _, _ = batch.keys(layout := exchange.Layout(1, 8, 40))
    sizes = [j - i for i, j in layout.ranges(keys, 40).values()]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)


def test_ranges_hold_all_keys_in_order():
    import numpy as np

    keys = np.unique(np.random.default_rng(4).integers(0, 2**40, 500, dtype=np.uint64))
    ranges = exchange.Layout(1, 10**6, 40).ranges(keys, 40)
    assert [k for i, j in ranges.values() for k in range(i, j)] == list(range(len(keys))) and list(ranges) == sorted(ranges)
    assert exchange.Layout(1, 7, 40).ranges(keys[:0], 40) == {}


def test_registered_repeats_on_a_driver_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op2_substring_dedup(spark, sf_dir).collect()} == brute.substring(docs)
    assert {tuple(r) for r in queries.op6_suffix_array_dedup(spark, sf_dir).collect()} == brute.byte_repeats(docs)
    assert {tuple(r) for r in queries.op7_minhash_near_dedup(spark, sf_dir).collect()} == brute.near(docs)


def test_repeats_of_odd_rows(odd, none):
    rows = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 80, 0), (6, 36000, 0), (7, 36000, 36000)} <= rows
    assert substring_dedup.remove_repeats(odd).count() == odd.count()
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in prefix_free_dedup.remove_repeats(odd).collect()]
    assert len(got) == odd.count() and (7, 156000, 156000) in got and (1, 0, 0) in got and (10, 100_000, 0) in got
    assert substring_dedup.remove_repeats(none).count() == prefix_free_dedup.remove_repeats(none).count() == 0


def test_a_null_id_is_later_than_all(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (9, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()) == [(0, 30), (0, 30), (9, 0)]


def test_packed_keys_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (exchange.unsqueeze(exchange.squeeze(keys)) == keys).all()
        values = rng.integers(-5, 2**40, n)
        assert (exchange.widen(exchange.narrow(values)) == values).all()


def test_lines_by_threshold(spark, shared_texts):
    docs, df = shared_texts
    want = brute.lines(docs, 10)
    assert sum(x[2] for x in want) > 20
    assert {tuple(r) for r in line_dedup.digest(df, at_least=10).collect()} == want


def test_first_lines_stay(shared_texts):
    docs, df = shared_texts
    assert {tuple(r) for r in line_dedup.digest(df, rule="first").collect()} == brute.first_lines(docs)


def test_lines_of_odd_rows(odd, none, spark):
    rows = line_dedup.drop_lines(odd, at_least=2)
    assert rows.count() == odd.count() and set(odd.columns) <= set(rows.columns)
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in rows.collect()}
    assert {(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 1, 0), (6, 1, 1), (7, 1, 1)} <= got  # a repeated row is one document
    assert line_dedup.drop_lines(none).count() == 0
    plan = line_dedup.digest(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_that_lose_several_lines(spark):
    """A repeated row is one document: its runs, and what it loses, are those of one."""
    texts = {d: f"shared by all\nown line {d}\nalso shared\nshared by all\nthe end" for d in range(12)}
    want = brute.lines(texts, 10)
    rows = [*texts.items(), (1, texts[1]), (1, texts[1]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.digest(df, at_least=10).collect()]
    assert len(got) == len(rows) and set(got) == want
    first = [tuple(r) for r in line_dedup.digest(df, rule="first").collect()]
    assert len(first) == len(rows) and set(first) == brute.first_lines(texts)
    nine = spark.createDataFrame([(d, texts[d]) for d in range(9)] * 2, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.digest(nine, at_least=10).collect()} == {0}


def test_lines_are_sorted_in_ranges_and_scanned_once(spark, sf_dir):
    df = line_dedup.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate posexplode") == 1 and plan.count("FileScan parquet") == 2  # the other reads the texts that are cut
    order = "h1 ASC, h2 ASC, doc_id ASC, print ASC"
    found = [" ".join(line.replace(" NULLS FIRST", "").split("[")[1].split("]")[0].split(", ")) for line in plan.splitlines() if "Sort [h1" in line]
    import re

    assert any(re.sub(r"#\d+L?", "", x).startswith(order.replace(",", "") + " pos ASC") for x in found)
    assert "Exchange rangepartitioning(h1" in plan


def test_halves_of_a_key_do_not_follow_from_each_other(spark):
    df = spark.range(100).select(F.concat(F.lit("line "), "id").alias("x"))
    h1, h2 = common.two_hashes(F.col("x"))
    follows = [F.xxhash64("x", F.lit(k)) for k in (1, 7)]  # made from the first hash alone
    assert df.filter((h1 == h2) | (h2 == follows[0]) | (h2 == follows[1])).count() == 0
    assert df.select(h1).distinct().count() == df.select(h2).distinct().count() == 100


def test_columns_named_as_results_are_kept_apart(odd):
    named = odd.withColumns({"n_dropped": F.lit("mine"), "kept_text": F.lit(1), "whole": F.lit(2), "row": F.lit(3)})
    rows = line_dedup.decided(named, at_least=2).select("row.*", F.col("n_dropped").alias("lost")).collect()
    assert len(rows) == odd.count() and all(r.n_dropped == "mine" and r.row == 3 for r in rows) and sum(r.lost for r in rows) == 2
    assert {r.n_dropped for r in line_dedup.drop_lines(named, at_least=2).collect()} == {0, 1}


def test_columns_named_as_results_in_another_case(odd):
    rows = line_dedup.drop_lines(odd.withColumns({"N_DROPPED": F.lit("mine"), "Kept_Text": F.lit(1)}), at_least=2)
    assert rows.count() == odd.count() and {r.n_dropped for r in rows.collect()} == {0, 1} and "N_DROPPED" not in rows.columns


def test_hot_keys_in_many_places(spark, shared_texts, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_SALT", 4)
    docs = shared_texts[0] | {100 + d: "the very same words in all of these documents\na line" for d in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.digest(df, at_least=10).collect()} == brute.lines(docs, 10)
    assert {tuple(r) for r in line_dedup.digest(df, rule="first").collect()} == brute.first_lines(docs)
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == brute.near(docs)


def test_near_duplicates_match_brute_force(shared_texts):
    docs, df = shared_texts
    want = brute.near(docs)
    assert len({x[2] for x in want}) < len(docs)
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == want


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].component_id == 6 and not by[7].kept and by[1].n_shingles == 0 and by[1].kept and by[11].n_shingles == 1
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_agree_as_often_as_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (5, 40, 600):
        agree = []
        for _ in range(60):
            both, a, b = (np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (6 * n, n, n))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            s = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 128)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - 0.75) < 0.03


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def test_a_crowded_bucket_stays_linear(spark):
    """Short texts around one passage: found links equal brute force."""
    import random

    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(16))
    rows = {d: f"{passage} " + " ".join(f"u{rng.randrange(3000)}" for _ in range(9)) for d in range(120)}
    rows |= {200 + d: rows[d] + " end" for d in range(0, 120, 10)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == brute.near(rows)


def edited_copies(n, seed=11, family=0):
    """An original of 100 shingles and n copies, each with two words changed: copies resemble it, and not each other."""
    import random

    rng = random.Random(seed)
    words = [f"f{family}w{i}" for i in range(104)]
    rows = []
    for d in range(n):
        own = list(words)
        first = rng.randrange(5, 94)
        for at in (first, rng.choice([k for k in range(5, 99) if abs(k - first) >= 5])):
            own[at] = f"x{family}n{d}at{at}"
        rows.append(" ".join(own))
    rows.insert(n // 2, " ".join(words))
    return rows


def near_of_many(docs):
    """As brute.near(), by a product of matrices."""
    import numpy as np

    sets = brute.shingle_sets(docs, 5)
    place = {g: i for i, g in enumerate(sorted(set().union(*sets.values())))}
    ids = sorted(docs)
    held = np.zeros((len(ids), len(place)), np.float32)
    for k, d in enumerate(ids):
        held[k, [place[g] for g in sets[d]]] = 1
    both, n = held @ held.T, held.sum(1)
    linked = (both > 0) & (100 * both >= 75 * (n[:, None] + n[None, :] - both))
    least = np.arange(len(ids))
    while True:
        new = np.where(linked, least[None, :], len(ids)).min(1)
        new = np.minimum(new, least)
        if (new == least).all():
            return {(d, int(n[k]), ids[least[k]], bool(least[k] == k)) for k, d in enumerate(ids)}
        least = new


@pytest.mark.parametrize("n", [300, 2000])
def test_copies_that_resemble_only_their_original(spark, n):
    docs = dict(enumerate(edited_copies(n)))
    want = near_of_many(docs)
    assert len({x[2] for x in want}) == 1
    assert {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()} == want


def test_crowded_families_without_an_original(spark):
    """Two originals under each passage, one of them missing: pairs of copies are found one by one."""
    import random

    texts = edited_copies(60, 1, 1) + edited_copies(60, 2, 2) + [t for k, t in enumerate(edited_copies(60, 3, 3)) if k != 30]
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(16))
    texts = [f"{passage} {t}" for t in texts] + [f"{passage} " + " ".join(f"u{rng.randrange(3000)}" for _ in range(9)) for _ in range(60)]
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    assert {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()} == near_of_many(docs)
