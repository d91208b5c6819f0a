"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

1. A document's set holds 64-bit hashes of its distinct word shingles.  One permutation fills ``bins`` bins with
   the least hash each; an empty bin borrows from the bin that its own sequence of random draws reaches first (optimal
   densification), so bins agree with the sets' similarity as probability.
2. Equal sets are one class, stood for by its smallest document: copies cost one membership row each.
3. ``bins / rows`` bands of ``rows`` bins make buckets: at a similarity of 0.75, all 32 bands of 4 miss a pair
   with a probability of 5e-6, for small sets too.  In each bucket every class is paired with one centre, the first in one of a
   few random orders: a bucket of n classes gives n - 1 edges.
4. Edges are confirmed on full sets: 100 * intersection >= percent * union.  Confirmed edges are joined to components by
   alternating large and small stars.
5. What stars can miss is a link between two classes of a bucket that its centre resembles neither of.  So buckets whose classes
   have not become one component are looked at again.  In those of up to ``CROWD`` classes, each class outside the commonest
   component is compared with the classes of the other components, so every pair is accounted for.
6. Crowded buckets gather dissimilar documents around a passage, or copies that resemble one original and not each other.  Their
   classes meet on rare shingles instead: with each set in one order of all shingles, rare ones first, two sets as similar as ``percent`` share one of
   the first n - ceil(percent * n / 100) + 1 of each.  Any order will do, so frequencies are counts in ``CELLS`` cells.  First the classes of a shingle meet the one whose
   shingles are commonest, which is an original rather than its copies; then a second one, not linked with any; and then every pair of different
   components that sizes and places allow.  So each pair that shares a bucket is either in one component or compared.

Defined cases: null or empty text, or text without words, has no shingles and is linked with nothing; fewer words than a shingle
are one shingle of all of them; rows that share a doc_id each count as that document; a null doc_id is linked with nothing and kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alike, by_ids, checkpointed, in_few, settled, slices
from .textkit import LOWER, first_of, mix, packed, span_hashes, word_grams, words

U64 = np.uint64
BINS, ROWS = 128, 4
#: Orders from which a bucket takes its centre.
DRAWS = 4
#: Buckets of up to so many classes are looked at pair by pair the second time, larger ones by rare shingles.
CROWD = 16
#: Cells in which frequencies of shingles are counted: they order shingles, and no result depends on them.
CELLS = 1 << 20
#: Texts are hashed so many bytes at a time.
SLICE_BYTES = 2 << 20


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    raw, starts = packed(texts)
    raw = LOWER[raw]
    lo, hi, text_of = words(raw, starts)
    hashes = span_hashes(raw, lo, hi)
    gram, whole = word_grams(hashes, text_of, width)
    gram, of = gram[whole], text_of[: len(gram)][whole]
    n_words = np.bincount(text_of, minlength=len(texts))
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        begin = np.searchsorted(text_of, few)
        short = np.zeros(len(few), U64)
        for j in range(width - 1):
            has = n_words[few] > j
            short[has] = mix(short[has] * U64(31) + hashes[begin[has] + j] + U64(j + 1))
        gram, of = np.concatenate([gram, mix(short)]), np.concatenate([of, few])
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, of = gram[new], of[new]
    return gram, np.searchsorted(of, np.arange(len(texts) + 1))


def _draws(bins: int) -> np.ndarray:
    """Row i: the bins that an empty bin i tries, in order."""
    seed = np.arange(bins, dtype=U64)[:, None] * U64(1 << 20) + np.arange(8 * bins, dtype=U64)[None, :]
    return (mix(seed + U64(0x51ED270B)) % U64(bins)).astype(np.int64)


def signatures(gram: np.ndarray, starts: np.ndarray, bins: int) -> np.ndarray:
    """One row of densified bins a text with shingles; rows of texts without are 0."""
    n = len(starts) - 1
    of = np.repeat(np.arange(n), np.diff(starts))
    value = mix(gram * U64(0x2545F4914F6CDD1D) + U64(99))
    cell = of * bins + (value >> U64(64 - bins.bit_length() + 1)).astype(np.int64)
    out = np.full(n * bins, np.iinfo(np.uint64).max, U64)
    cells, _, ((least, _),) = first_of(cell, value)
    out[cells] = least
    out = out.reshape(n, bins)
    full = np.zeros(n * bins, bool)
    full[cells] = True
    full = full.reshape(n, bins)
    some = full.any(1)
    draws = _draws(bins)
    todo, empty = np.nonzero(~full & some[:, None])
    for k in range(draws.shape[1]):
        if not len(todo):
            break
        from_ = draws[empty, k]
        ok = full[todo, from_]
        out[todo[ok], empty[ok]] = out[todo[ok], from_[ok]]
        todo, empty = todo[~ok], empty[~ok]
    for t, e in zip(todo, empty, strict=True):  # no draw reached a full bin: take the first full one
        out[t, e] = out[t, np.argmax(full[t])]
    out[~some] = 0
    return out


def sketches(docs: DataFrame, *, width: int, bins: int, rows: int) -> DataFrame:
    """(doc_id, n, print, keys array<long>): set size, 128-bit print of the set, and bucket keys."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            gram, starts = shingles(batch.column("text"), width)
            n = np.diff(starts)
            two = np.stack([gram, mix(gram + U64(1))], 1)
            sums = np.zeros((len(gram) + 1, 2), U64)
            np.cumsum(two, axis=0, out=sums[1:])
            total = np.ascontiguousarray(sums[starts[1:]] - sums[starts[:-1]])
            bin_values = signatures(gram, starts, bins).reshape(len(n), bins // rows, rows)
            band = np.zeros(bin_values.shape[:2], U64) + np.arange(bins // rows, dtype=U64)
            for r in range(rows):
                band = mix(band * U64(0x9FB21C651E98DF25) + bin_values[:, :, r])
            band[n == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(total)]).cast(pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(0, band.size + 1, bins // rows, dtype=np.int32), pa.array(band.view(np.int64).ravel())
                    ),
                ],
                names=["doc_id", "n", "print", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        of, "doc_id long, n long, print binary, keys array<long>"
    )


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams binary): full sets as sorted 64-bit hashes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            gram, starts = shingles(batch.column("text"), width)
            raw = [gram[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, grams binary")


def confirmed(edges: DataFrame, docs: DataFrame, *, width: int, percent: int) -> DataFrame:
    """The edges (a, b) of class representatives whose full sets are similar enough."""
    possible, n = settled(edges.select("a", "b"))
    if not n:
        return possible
    ends = possible.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ends, "left_semi")
    sets = sets_of(needed, width)
    pairs = possible.join(sets.withColumnsRenamed({"doc_id": "a", "grams": "set_a"}), "a").join(
        sets.withColumnsRenamed({"doc_id": "b", "grams": "set_b"}), "b"
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(of, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b), by alternating large and small stars.

    Each round is two aggregates and joins by node; a node of very many edges is pre-aggregated by min() and its join is
    one that adaptive execution splits.  The lineage is cut each round.
    """
    now, rows = settled(edges.select("a", "b").filter("a <> b").distinct())
    few = lambda df: in_few(df, 2 * rows)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumn("alike", alike("a"))
        large = both.filter("b > a").withColumn("alike", alike("a")).join(least, ["a", "alike"])
        large = few(large.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        down = few(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumn("alike", alike("a"))
        small = down.withColumn("alike", alike("a")).join(least, ["a", "alike"])
        small = few(small.select(F.explode(F.array("a", "b")).alias("x"), "m").filter("x <> m")).distinct()
        now = few(checkpointed(few(small.select(F.col("x").alias("a"), F.col("m").alias("b")))))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Every node now has one edge, to its component's least node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _cells(gram: np.ndarray) -> np.ndarray:
    return (mix(gram + U64(7)) % U64(CELLS)).astype(np.int64)


def rare_prefixes(docs: DataFrame, *, width: int, percent: int) -> DataFrame:
    """(rep, n, common, place, gram): the rare shingles of which two similar sets share one, and how common a set's shingles are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches, SLICE_BYTES):
            cells, n = np.unique(_cells(shingles(batch.column("text"), width)[0]), return_counts=True)
            total[cells] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["cell", "n"])

    table = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            gram, starts = shingles(batch.column("text"), width)
            n = np.diff(starts)
            row = np.repeat(np.arange(len(n)), n)
            many = shared.value[_cells(gram)]
            common = np.bincount(row, np.log(many), len(n)) / np.maximum(n, 1)
            order = np.lexsort((gram, many, row))
            place = np.arange(len(gram)) - starts[row]
            # A shingle alone in its cell is in no other set.
            held = (place <= n[row] - (percent * n[row] + 99) // 100) & (many[order] > 1)
            row = row[held]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(n[row]), pa.array(common[row]), pa.array(place[held]),
                 pa.array(gram[order][held].view(np.int64))],
                names=["rep", "n", "common", "place", "gram"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(of, "rep long, n long, common double, place long, gram long")
    met = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("gram")
    return settled(rows.join(met, "gram").select("rep", "n", "common", "place", "gram"))[0]


def _open(rare: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``rare`` with their components and whether they are ``lone``, and of their shingle the main component and the two hubs."""
    placed = rare.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumns(
        {"lone": F.col("component").isNull(), "component": F.coalesce("component", "rep")}
    )
    hub = [F.col(c) for c in ("common", "rep", "n", "place", "component")]
    of = placed.groupBy("gram", "component").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.struct(*hub)).alias("hub"), F.max(F.struct("lone", *hub)).alias("lone_hub")
    )
    split = of.groupBy("gram").agg(
        F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", F.col("component").alias("main"))).alias("most"),
        F.max("hub").alias("hub"), F.max("lone_hub").alias("lone_hub"),
    )
    open_ = split.filter("parts > 1").select("gram", "most.main", "hub", "lone_hub", alike("gram"))
    return placed.withColumn("alike", alike("gram")).join(open_, ["gram", "alike"]).drop("alike")


def _may(n: str, place: str, m: str, at: str, percent: int) -> Column:
    """Whether sets of n and m shingles whose first common one is at these places can be similar enough."""
    rest, size = F.least(F.col(n) - F.col(place), F.col(m) - F.col(at)), F.col(n) + F.col(m)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= size * percent)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def hub_pairs(open_: DataFrame, hub: str, percent: int) -> DataFrame:
    """(a, b): the classes of each shingle with its hub, where that is of another component."""
    flat = open_.select("rep", "n", "place", "component", *(F.col(f"{hub}.{c}").alias(f"{c}_h") for c in ("rep", "n", "place", "component")))
    met = flat.filter((F.col("component") != F.col("component_h")) & _may("n", "place", "n_h", "place_h", percent))
    return _ordered(met.select(F.col("rep_h").alias("x"), "rep"))


def rest_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components that share a shingle and can be similar enough."""
    every = open_.select("gram", "rep", "n", "place", "component", (F.col("component") == F.col("main")).alias("is_main"))
    lesser = every.filter("NOT is_main").select("gram", *(F.col(c).alias(f"{c}_x") for c in ("rep", "n", "place", "component")))
    met = lesser.join(every, "gram").filter(
        (F.col("component") != F.col("component_x")) & (F.col("is_main") | (F.col("rep") > F.col("rep_x")))
        & _may("n", "place", "n_x", "place_x", percent)
    )
    return _ordered(met.select(F.col("rep_x").alias("x"), "rep"))


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 75, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row a document."""
    marks = checkpointed(sketches(docs, width=width, bins=bins, rows=rows))
    named = marks.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # Equal sets have equal bucket keys, so any row's will do.
    classes = named.groupBy("n", "print").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    held = classes.select("rep", "n", F.explode(F.array_distinct("keys")).alias("key"))
    # The centre is the class with the least of a few draws: groups then meet under few centres, but not under one.
    draw = F.xxhash64(F.pmod("key", F.lit(DRAWS)), "rep")
    shared = (
        held.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min_by("rep", draw).alias("centre"), F.min_by("n", draw).alias("m"))
        .filter("many > 1").select("key", "centre", "m", alike("key"))
    )
    # A class may hold a third of all documents, and a bucket a third of all classes: see alike().
    members, _ = settled(held.withColumn("alike", alike("key")).join(shared, ["key", "alike"]).drop("alike"))

    def near_in_size(n: str, m: str) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    star, _ = settled(
        members.filter((F.col("rep") != F.col("centre")) & near_in_size("n", "m"))
        .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    )
    grouped, _ = settled(components(confirmed(star, docs, width=width, percent=percent)))

    # Buckets whose classes are in more than one component.
    placed = members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    by_part = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    split = by_part.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", F.col("component").alias("main"))).alias("most")
    ).filter("parts > 1").select("key", "all", "most.main", alike("key"))
    open_, _ = settled(placed.withColumn("alike", alike("key")).join(split, ["key", "alike"]).drop("alike"))
    few = open_.filter(F.col("all") <= CROWD)
    lesser = few.filter("component <> main").select("key", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("component").alias("of"))
    each = lesser.join(few.select("key", "rep", "n", "component"), "key").filter((F.col("of") != F.col("component")) & near_in_size("n", "n_x"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    crowd, n_crowd = settled(open_.filter(F.col("all") > CROWD).select(F.col("rep").alias("doc_id")).distinct())
    rare = rare_prefixes(by_ids(texts, crowd, "left_semi"), width=width, percent=percent) if n_crowd else None

    tested, final = star, grouped
    for turn in range(3):
        if turn == 0:
            pairs = _ordered(each.select("x", "rep"))
            if rare is not None:
                pairs = pairs.unionByName(hub_pairs(_open(rare, final), "hub", percent)).distinct()
        elif rare is not None:
            pairs = hub_pairs(_open(rare, final), "lone_hub", percent) if turn == 1 else rest_pairs(_open(rare, final), percent)
        else:
            break
        again, n_again = settled(pairs.join(tested, ["a", "b"], "left_anti"))
        if not n_again:
            continue
        tested = tested.unionByName(again)
        more, n_more = settled(confirmed(again, docs, width=width, percent=percent))
        if n_more:
            # Components so far are stars; the new links join them.
            so_far = final.select(F.col("component").alias("a"), F.col("node").alias("b"))
            final, _ = settled(components(so_far.unionByName(more)))

    answer = (
        named.select("doc_id", "n", "print", alike("n", "print"))
        .join(named.groupBy("n", "print").agg(F.min("doc_id").alias("rep")).withColumn("alike", alike("n", "print")), ["n", "print", "alike"])
        .join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    )
    alone = marks.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select(
        "doc_id", "n", F.col("doc_id").alias("component_id")
    )
    return answer.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
