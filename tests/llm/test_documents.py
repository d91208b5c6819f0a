import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from titlemart.llm import additive_ann, decontamination, language_id, lm_scoring, packing, queries, secrets


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_are_told_by_their_shares(spark):
    rng = random.Random(1)
    vocab = {"aa": ["bab", "dada", "gab", "abba"], "zz": ["zyx", "wuzy", "xyzu", "zuw"], "kk": ["kilk", "mkik", "olk", "lomk"]}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    train = spark.createDataFrame([(text(k, 60), k) for k in vocab for _ in range(10)], "text string, lang string")
    model = language_id.train(train)
    docs = [(1, text("aa", 200)), (2, text("zz", 150) + " " + text("kk", 50)), (3, text("aa", 60) + " " + text("zz", 60) + " " + text("kk", 60))]
    got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert set(got[1].lang_mix) == {"aa"} and set(got[2].lang_mix) == {"zz", "kk"} and set(got[3].lang_mix) == set(vocab)
    assert got[2].lang_pred == "zz" and abs(got[2].lang_score - 0.75) < 0.08


def test_language_of_odd_rows(odd, none):
    model = language_id.train(odd)
    rows = language_id.predicted(odd, model).collect()
    assert len(rows) == odd.count() and rows[0].batch == 1
    by = {r.doc_id: r for r in rows}
    assert by[1].lang_pred == by[2].lang_pred == by[8].lang_pred == "und" and by[8].lang_score == 0
    assert by[6].lang_pred == by[7].lang_pred in ("en", "fr") and by[11].lang_pred in ("de", "en", "fr")
    assert language_id.predicted(none, model).count() == 0
    capitals = language_id.predicted(odd.withColumns({"LANG_PRED": F.lit("mine"), "Lang_Mix": F.lit(1)}), model)
    assert "LANG_PRED" not in capitals.columns and {r.lang_pred for r in capitals.collect()} == {r.lang_pred for r in rows}
    assert {r.lang_pred for r in language_id.predicted(odd, language_id.train(none)).collect()} == {"und"}


@pytest.mark.parametrize("seed", range(3))
def test_proportions_match_plain_expectation_maximisation(seed):
    rng = np.random.default_rng(seed)
    buckets, languages, n_texts = 40, 4, 30
    logs = np.log(rng.dirichlet(np.full(buckets, 0.3), languages).T + 1e-4).astype(np.float32)
    bags = []
    for _ in range(n_texts):
        share = rng.dirichlet(np.full(languages, 0.4))
        p = np.exp(logs.astype(float)) @ share
        bags.append(rng.choice(buckets, rng.integers(0, 400), p=p / p.sum()))
    text = np.concatenate([np.full(len(b), i) for i, b in enumerate(bags)])
    got = language_id.infer(np.concatenate(bags), text, n_texts, logs, 2.0, 12)
    for own, bag in zip(got, bags, strict=True):
        assert own == pytest.approx(brute.mixture(bag.tolist(), logs.astype(float).tolist(), 2.0, 12), abs=1e-6)
    assert (got > 0).sum(1).max() > 1


# --- secrets ----------------------------------------------------------------------------------------------------------


def test_base_secrets_match_a_plain_scan(spark, sf_dir):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_secret_scan(spark, sf_dir).collect():
        base = brute.base_secrets(docs[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text",
    [
        'PassWord" : "abcdefghijkl', "api-key=abcdefghijklm api_key=short APIKEY= 'ABCDEFGHIJKLMN'", "token=token=abcdefghijkl", "paſſwd=abcdefghijklmn",
        "AKIA" * 6, "AKIAAKIA1234567890", "ÉÉ deadbeefdeadbeef0 g", "f" * 15 + "g" + "f" * 40, "secret:\x20\x20=abcdefghijklmnop", "toKen=abcdefghijkl",
    ],
)
def test_base_secrets_of_hard_texts(text):
    assert secrets.base_spans(text) == brute.base_secrets(text)


def test_weak_parts_need_their_complements():
    key, weak, url = "AKIA" + "A" * 16, "abcDEF1234" * 4, "https://s3.example.com/bucket"
    whole = f"id {key}\n{weak}\nat {url}"
    base = secrets.base_spans(whole)
    more, links = secrets.linked_spans(whole, base, 300)
    assert [secrets.KINDS[s[1]] for s in more] == ["secret", "endpoint"] and len(links) == 1
    for lone in (weak, url, f"{key} {url}", f"{key}\n\n{weak}", f"{key} {'word ' * 80}{weak}"):
        assert secrets.linked_spans(lone, secrets.base_spans(lone), 300)[0] == []


@pytest.mark.parametrize(
    "form", ["AWS_SECRET_ACCESS_KEY={}", "secretKey={}", "aws_secret_access_key:{}", 'key="{}"', '{{"secretAccessKey":"{}"}}', "key = {}", "key={}==", "key={}\nregion=x"]
)
def test_assigned_secrets_beside_an_identifier(form):
    weak, key, url = "abcDEF1234" * 4, "AKIA" + "A" * 16, "https://s3.example.com/bucket"
    text = f"AWS_ACCESS_KEY_ID={key}\n{form.format(weak)}\nurl={url}"
    more, links = secrets.linked_spans(text, secrets.base_spans(text), 300)
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in more] == [("secret", weak), ("endpoint", url)]
    assert [[text[p[0] : p[2]] for p in link] for link in links] == [[key, weak, url]]


def test_runs_that_are_no_secrets():
    key, weak = "AKIA" + "A" * 16, "abcDEF1234" * 4
    for run in (f"{weak}x", f"x{weak}", f"{weak}=value", f"{weak}==x", f"{weak}==="):
        assert secrets.linked_spans(f"{key} {run}", secrets.base_spans(f"{key} {run}"), 300) == ([], [])
    text = f"secret={weak}\n{key}"
    assert [secrets.KINDS[p[1]] for p in secrets.linked_spans(text, secrets.base_spans(text), 300)[1][0] if p] == ["access", "assign"]


def test_an_identifier_after_a_long_assignment_is_linked():
    first, second, weak = "AKIA" + "A" * 16, "AKIA" + "B" * 16, "abcDEF1234" * 4
    text = f"{first} token=x.{weak}-{'y.' * 200}{' ' * 10}{second}"
    more, links = secrets.linked_spans(text, secrets.base_spans(text), 300)
    assert [text[p[0] : p[2]] for p, *_ in links] == [first, second] and all(text[s[0] : s[2]].startswith("token") for _, s, _ in links)


@pytest.mark.parametrize("seed", range(40))
def test_links_match_all_pairs(seed):
    rng = random.Random(seed)
    key = lambda: "AKIA" + "".join(rng.choice("AB1") for _ in range(16))
    parts = [
        key, lambda: rng.choice("ab") * 39 + rng.choice("CD"), lambda: f"https://h{rng.randrange(9)}.example/{'p' * rng.randrange(60)}",
        lambda: f"token=x.{'e' * 40}-{'y.' * rng.randrange(120)}", lambda: f"secret: {'z' * rng.randrange(8, 90)}", lambda: f"https://u/{'k' * 5}={'E' * 40}/t",
        lambda: "word " * rng.randrange(30), lambda: f"password={key()}", lambda: "\n \n",
    ]
    text = "".join(rng.choice(parts)() + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(4, 40)))
    base = secrets.base_spans(text)
    assert secrets.linked_spans(text, base, 60) == brute.linked(text, base, 60)


def test_secrets_of_odd_rows(odd, none):
    rows = secrets.scan(odd).collect()
    assert len(rows) == odd.count() and all(r.n_access == 0 for r in rows)
    assert secrets.scan(none).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_a_driver_table(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_best_fit_packing(spark, sf_dir).collect()
    want = set()
    for d, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.add((d, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    total = sum(r.length for r in rows)
    assert check_packing(rows, 4096) <= total / 4096 * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    from collections import Counter

    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 512)
    made = packing.plan(dict(Counter(lengths.tolist())), 512)
    used = Counter()
    for own, n in made:
        assert 0 < sum(own) <= 512 and n > 0
        for x in own:
            used[x] += n
    assert used == Counter(lengths.tolist())
    assert sum(n for _, n in made) <= lengths.sum() / 512 * 1.01 + 1


def test_chunks_have_the_tokenizers_ids():
    ids_of = packing.chunk_ids(queries.vocabulary())
    rng = random.Random(4)
    letters = "abcXYZ'sstre llvd019 .,;:!?()|@#<>\\/\"~ÀÉÿßöþ×÷ñ ªº½µ\t\r\n\x0b\x1c  ́Σςσİſﬁ漢字かな한😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["<|endoftext|>x", "a<|startoftext|> b", "ab'S'T'LL'd", "y" * 3000]
    for text, e in zip(texts, ids_of.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids_of.of(text), "<u4").tolist() == e.ids


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, queries.vocabulary(), capacity=64).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == odd.count() and [r.length for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(none, queries.vocabulary()).count() == 0


# --- language models --------------------------------------------------------------------------------------------------


def test_scores_match_a_plain_model(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    want = brute.lm_scores(docs, {r.doc_id for r in labels if r.quality == 1})
    rows = queries.op9_lm_scoring(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9, nan_ok=True)
    good, bad = ([r.score for r in rows if r.doc_id in {x.doc_id for x in labels if x.quality == q}] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] < np.array(bad)[None, :]) > 0.8


def test_scores_in_many_batches(shared_texts):
    docs, df = shared_texts
    good = df.filter("doc_id % 2 = 0").select("doc_id")
    want = brute.lm_scores(docs, {d for d in docs if d % 2 == 0})
    for r in lm_scoring.score(df, good, batch_bytes=2000, part_bytes=3000).collect():
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9, nan_ok=True)


def test_scores_of_odd_rows(odd, none):
    rows = lm_scoring.score(odd, odd.filter("doc_id > 4").select("doc_id")).collect()
    assert len(rows) == odd.count()
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)
    assert lm_scoring.score(none, odd.select("doc_id")).count() == 0
    assert lm_scoring.score(odd, none.select("doc_id")).count() == odd.count()


# --- decontamination --------------------------------------------------------------------------------------------------


def test_distance_is_the_least_of_all_substrings():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontamination.least_distance(item, text)[0] == brute.edit_matches(text, item)


def test_matches_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("lo", "ni", "tur", "sek")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(20)) for k in range(8)] + [(8, None), (9, "  "), (10, "short")]
    items.append((11, items[0][1].upper()))
    docs = []
    for d in range(60):
        text = say(30)
        if d % 2:
            held = list(items[d // 2 % 8][1])
            for _ in range(d % 9):
                at = rng.randrange(len(held))
                held[at : at + 1] = rng.choice([[], ["x"], [held[at], "y"]])
            text = f"{text}\n{''.join(held)} {say(10)}"
        docs.append((d, text))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for k, item in items:
            if plain := decontamination.plain(item):
                distance = brute.edit_matches(decontamination.plain(text), plain)
                if distance <= int(decontamination.ERROR_RATE * len(plain)):
                    want.add((d, k, distance))
    assert any(x[2] > 0 for x in want) and any(x[1] == 11 for x in want)
    for block_bytes in (1 << 20, 300):  # one block, and several
        assert {tuple(r)[:3] for r in decontamination.matches(df, bench, block_bytes=block_bytes).collect()} == want
    gone = {x[0] for x in want}
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {d for d, _ in docs} - gone


def test_a_blocks_address_used_again(spark):
    """A worker that unpickles a block where a freed one lay looks for the new block's items."""
    from types import SimpleNamespace

    room = []
    for k, item in enumerate(("one item of some length", "another text to be found")):
        (block,) = decontamination.blocks(spark.createDataFrame([(k, item)], "item_id long, text string"), 1 << 20)
        room[:] = block.value
        assert decontamination._finder(SimpleNamespace(value=room), 0.08).find(f"with {item} inside") == [(k, 0, len(item) + 5)]
    near = SimpleNamespace(value=room)
    assert decontamination._finder(near, 0.0).find("another text to be fxund") == []
    assert decontamination._finder(near, 0.08).find("another text to be fxund") == [(1, 1, 24)]


def test_matches_of_odd_rows(odd, none, spark):
    items = spark.createDataFrame([(1, "the same row twice the same row"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.matches(odd, items).collect()) == [4, 4]
    assert decontamination.clean(odd, items).columns == odd.columns
    assert decontamination.matches(none, items).count() == 0 == decontamination.matches(odd, items.limit(0)).count()


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def recall(spark, df, k=20, metric="inner", **how):
    table = df.toArrow()
    x, ids = np.array(table["embedding"].to_pylist(), float), table["vec_id"].to_numpy()
    got: dict = {}
    for r in additive_ann.search(df, F.col("vec_id") % 20 == 0, k=k, metric=metric, **how).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i] if metric == "inner" else -((x - x[i]) ** 2).sum(1)
        best = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        mine = got[ids[i]]
        assert sorted(mine) == list(range(1, min(k, len(ids) - 1) + 1))
        assert all(abs(v[1] - s[list(ids).index(v[0])]) < 1e-9 for v in mine.values())
        hit += len({v[0] for v in mine.values()} & set(ids[best].tolist()))
        total += len(best)
    return hit / total


@pytest.mark.parametrize("metric", ["inner", "l2"])
def test_recall_against_brute_force(spark, sf_dir, metric):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assert recall(spark, df, metric=metric) >= 0.95


def test_copies_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(spark, df) >= 0.95


def test_repeated_rows_are_one_vector(spark):
    """Repeats of one row don't take the places of other ids with the same vector."""
    rows = [(1, [1.0, 0.0])] * 50 + [(i, [1.0, 0.0]) for i in range(2, 9)] + [(20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = additive_ann.search(df, F.col("vec_id") % 20 == 0, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_an_id_with_two_vectors_is_one_row(spark):
    rows = [(20, [1.0, 1.0]), (20, [1.0, 0.5]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 1.0]), (3, [0.1, 0.1])]
    for shuffled in (rows, rows[::-1]):
        df = spark.createDataFrame(shuffled, "vec_id long, embedding array<double>")
        for k in (2, 3, 9):
            got = additive_ann.search(df, F.col("vec_id") % 20 == 0, k=k).collect()
            assert {r.vec_id for r in got} <= {1, 2, 3} and len(got) == len({r.vec_id for r in got}) == min(k, 3)


def test_recall_does_not_depend_on_the_number_of_parts(spark):
    """Unit vectors in random directions, which no cells fit, and the driver's own; parts as many as those of millions of vectors."""
    x = np.random.default_rng(9).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    for own in (df, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")):
        for cell_rows in (20, 8192):
            assert recall(spark, own, k=20, cell_rows=cell_rows) >= 0.95


@pytest.mark.parametrize("metric", ["inner", "l2"])
def test_cells_find_the_neighbours_of_grouped_vectors(spark, metric):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    assert recall(spark, df, metric=metric, cell_rows=60, probes=6) >= 0.9
    assert recall(spark, df, metric=metric, cell_rows=60, probes=None) >= 0.95


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (20, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 2.0]), (2, [1.0, 0.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(a, v, 1) for a, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in additive_ann.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0)]
    assert additive_ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
