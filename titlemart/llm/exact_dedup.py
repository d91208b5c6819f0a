"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of blanks has become one space; a text goes by the SHA-256 digest of that form.
Misra-Gries summaries, one a task and added up by digest, name the digests that may hold more than a share of all rows.  Their groups are
counted exactly, which combines before its shuffle; the winners that are verified so are few whatever the corpus, and are broadcast: a row of
such a group is decided where it is read.  All other digests take an ordinary shuffle, in which no group is larger than that share.

Only digests, ids and row numbers are shuffled, never texts.  They are written once, so that a lost executor recomputes nothing
that was already decided and a row keeps its number.

Defined cases: a null text is the empty text; a text of blanks alone is one space, so not the empty text; of rows that share the smallest doc_id of a group (repeated rows) exactly one
stays; a null doc_id comes after all others, and ``keep_id`` is null where a group has no other; an empty table gives an empty result; ``keep_first``
carries columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, settled

#: A digest of more than one row in so many is decided by broadcast.
SHARE = 1024
#: Counters of a summary for each such digest: an estimate misses at most a quarter of the share.
COUNTERS = 4
#: Up to so many (id, digest) pairs, of 40 bytes, are sent to all tasks.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def misra_gries(batches: Iterator[tuple[pa.Array, np.ndarray]], counters: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``counters`` keys with lower bounds of their counts, each short by at most n / (counters + 1).

    Batches of (keys, counts) are added to the summary; where it grows too long, the first count that finds no room is taken from all.
    """
    keys, counts = pa.array([], pa.binary()), np.zeros(0, np.int64)
    for more, n in batches:
        table = pa.table({"k": pa.concat_arrays([keys, more.cast(pa.binary())]), "n": np.concatenate([counts, n])})
        table = table.group_by("k").aggregate([("n", "sum")])
        keys, counts = table["k"].combine_chunks(), table["n_sum"].to_numpy().astype(np.int64)
        if len(counts) > counters:
            counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
            stay = counts > 0
            keys, counts = keys.filter(pa.array(stay)), counts[stay]
    return keys, counts


def frequent(digests: DataFrame, share: int) -> DataFrame:
    """(digest): a few that hold, perhaps, more than one row in ``share``; every digest that does is among them.

    A digest's estimates add up to at least its count less n / (COUNTERS * share), so those of three quarters of the share are at most 4 / 3 of ``share`` in number.
    """

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]

        def counted() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for batch in batches:
                seen[0] += len(batch)
                yield batch.column("digest"), np.ones(len(batch), np.int64)

        keys, counts = misra_gries(counted(), COUNTERS * share)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([keys, pa.array([None], pa.binary())]), pa.array(np.append(counts, seen[0]))], names=["digest", "n"]
        )

    added = digests.select("digest").mapInArrow(summarised, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    added = checkpointed(added)
    n = added.filter("digest IS NULL").agg(F.sum("n")).first()[0] or 0
    return added.filter(F.col("digest").isNotNull() & (F.col("n") * share * COUNTERS >= n * (COUNTERS - 1))).select("digest")


def _group(df: DataFrame) -> DataFrame:
    """(digest, first, group_size) with ``first`` the row that stays: of non-null doc_ids the smallest, then the first by number."""
    return df.groupBy("digest").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("group_size"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_number")


def decided(docs: DataFrame, *, share: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, row_number), one row for each of ``docs``.

    ``share`` is by default 1024 or the number of shuffle partitions, if that is more: no group in the shuffle holds more rows than a task's fair share.
    """
    share = share or max(SHARE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = checkpointed(docs.select("doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row_number")))
    candidates = F.broadcast(frequent(rows, share))  # at most 4 / 3 of share rows
    winners = checkpointed(_group(rows.join(candidates, "digest")))
    told = rows.join(F.broadcast(winners), "digest", "left")
    same = W.partitionBy("digest")
    rest = told.filter("first IS NULL").select(
        "digest", "doc_id", "row_number", F.min(_place()).over(same).alias("first"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    both = told.filter("first IS NOT NULL").select(rest.columns).unionByName(rest)
    return both.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_number") == F.col("first.row_number")).alias("kept"), "digest", "row_number"
    )


def exact_duplicates(docs: DataFrame, *, share: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each of ``docs``, dropped ones too."""
    return decided(docs, share=share).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, *, share: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is told by (doc_id, digest).  Those that go, and those that occur again (repeated rows, of which one is picked), come to the
    texts by broadcast while they are at most ``BROADCAST_ROWS``, counted first, and by a shuffle beyond.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").alias("own_id"), digest(F.col("text")).alias("own_digest"))
    told = decided(docs, share=share).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    told, n = settled(told.filter("times > 1 OR NOT kept"))
    told = F.broadcast(told) if n <= BROADCAST_ROWS else told
    joined = own.join(told, own.own_id.eqNullSafe(told.doc_id) & (own.own_digest == told.digest), "left")
    once = joined.filter("times IS NULL").select("row.*")
    again = joined.filter("times > 1 AND kept").groupBy("own_id", "own_digest").agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
