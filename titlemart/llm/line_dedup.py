"""Line deduplication with DataFrame functions only.

The key of a line is the line without blanks at both ends and with A-Z in lower case.  128-bit hashes of the
keys, never the lines, are dealt into ranges by (hash, document) and sorted by (hash, document, position); first occurrences in a document are
told as this order streams by.  What comes back is, for each document, the run-length form of its keep bitmap.  Two rules share this layout:

``at_least``  keys that occur in at least so many documents lose all their lines;
``first``     every line but the first occurrence of its key, by (document, position), goes.

Lines are split, hashed and dealt once; both the count of a key's documents and the taking back of decisions read the same exchange.

Hot keys: the ranges are by (hash, document), so one frequent line spreads over many tasks, and documents are counted by partial
aggregates.  A decision meets its lines by (hash, salt), the salt being a hash of the document: a key is repeated for the
salts that its own documents have, and there are as many salts as the number of documents asks for.

Defined cases: a null or empty text is one empty line; a key shorter than ``min_chars`` never counts and always stays; rows
that repeat both doc_id and text are one document, rows that share only doc_id are two; a null doc_id is a document like
any other (ordered before all others); an empty table gives an empty result; other columns are left alone, but for those that have the
name of a result, which ``drop_lines`` replaces and ``decided`` keeps apart.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, others, salt, salts_for, two_hashes


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(BLANKS))
    # lower() is the cheap way and right for ASCII; other lines keep their other capitals.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _print(text: Column) -> Column:
    """Tells apart documents of one doc_id."""
    return F.xxhash64(F.lit(1), text)


def keep_runs(docs: DataFrame, *, at_least: int = 10, min_chars: int = 1, rule: str = "at_least") -> DataFrame:
    """(doc_id, print, dropped long, dropped_runs array<struct<start int, length int>>) of documents that lose lines.

    ``print`` tells apart documents that share a doc_id.  Runs are of consecutive dropped lines, in order, from 0.
    """
    if rule not in ("at_least", "first"):
        raise ValueError(f"no such rule: {rule}")
    text = F.coalesce("text", F.lit(""))
    salts = salts_for(docs.count())
    lines = (
        docs.select("doc_id", _print(text).alias("print"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= max(min_chars, 1))
        .select(*(h.alias(c) for h, c in zip(two_hashes(F.col("key")), ("h1", "h2"), strict=True)), "doc_id", "print", "pos")
    )
    in_document = W.partitionBy("h1", "h2", "doc_id", "print").orderBy("pos")
    sorted_ = (
        lines.repartitionByRange("h1", "h2", "doc_id", "print")
        .withColumns({"opens": F.row_number().over(in_document) == 1, "nth": F.dense_rank().over(in_document)})
        .withColumn("salt", salt(salts, "doc_id", "print"))
    )
    counted = sorted_.groupBy("h1", "h2").agg(
        F.count_if("opens").alias("n_docs"), F.max("nth").alias("most"),
        F.min(F.struct("doc_id", "print")).alias("owner"), F.collect_set("salt").alias("salts"),
    )
    losing = F.col("n_docs") >= at_least if rule == "at_least" else (F.col("n_docs") > 1) | (F.col("most") > 1)
    decided = counted.filter(losing).select("h1", "h2", "owner", F.explode("salts").alias("salt"))
    dropped = sorted_.join(decided, ["h1", "h2", "salt"])
    if rule == "first":
        dropped = dropped.filter(~(F.struct("doc_id", "print").eqNullSafe(F.col("owner")) & (F.col("nth") == 1)))
    # A repeated row has each of its lines as often as itself: equal positions take one place, and a run is as long as its span.
    w = W.partitionBy("doc_id", "print").orderBy("pos")
    runs = (
        dropped.select("doc_id", "print", "pos").withColumn("run", F.col("pos") - F.dense_rank().over(w))
        .groupBy("doc_id", "print", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    )
    return runs.groupBy("doc_id", "print").agg(
        F.sum("length").alias("dropped"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("dropped_runs")
    )


def decided(docs: DataFrame, **rule) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): each row of ``docs`` as a struct, and what is left of its text."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("whole"), F.col("doc_id").alias("doc"), _print(text).alias("own")
    )
    runs = keep_runs(docs.select("doc_id", "text"), **rule)
    joined = own.join(runs, own.doc.eqNullSafe(runs.doc_id) & (own.own == runs.print), "left")
    lines = F.split("whole", "\n", -1)
    runs_or_none = F.coalesce("dropped_runs", F.array().cast("array<struct<start:int,length:int>>"))
    # Kept runs lie between the dropped ones.
    begins = F.concat(F.array(F.lit(0)), F.transform(runs_or_none, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(runs_or_none, lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(
        F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda r: F.slice(lines, r["b"] + 1, r["e"] - r["b"]))
    )
    return joined.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def drop_lines(docs: DataFrame, **rule) -> DataFrame:
    """All rows and columns of ``docs`` plus ``kept_text``, ``n_lines`` and ``n_dropped``."""
    made = ("kept_text", "n_lines", "n_dropped")
    return decided(docs, **rule).select(*(F.col(f"row.`{c}`").alias(c) for c in others(docs, *made)), *made)


def digest(docs: DataFrame, **rule) -> DataFrame:
    """What op3 returns: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_lines(docs.select("doc_id", "text"), **rule).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY k.doc_id
"""
