"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut as checkpointed
from ..functions.lineage import shared_folder

__all__ = ["BLANKS", "alike", "by_ids", "checkpointed", "in_few", "others", "read", "release", "salt", "salts_for", "settled", "shared_table", "slices", "text_bytes", "two_hashes"]

#: The six white-space bytes that separate words and pad lines.
BLANKS = " \t\n\v\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` but those that Spark would take for one of ``made``: by default it does not tell capitals from small letters."""
    told = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    taken = set(made) if told else {c.lower() for c in made}
    return [c for c in df.columns if (c if told else c.lower()) not in taken]


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Up to so many ids of 8 bytes are sent to all tasks; more are joined by a shuffle of both sides.
BROADCAST_IDS = 4_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with distinct ids (one column, doc_id): texts stay where they are while the ids are few."""
    ids, n = settled(ids)
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", how).select(*docs.columns)


#: About so many rows of one key meet in one task, and into at most so many places is a key split.
ROWS_A_SALT, MOST_SALTS = 4096, 4096


def salts_for(rows: int) -> int:
    """Into how many places the rows of a key that may hold them all are dealt."""
    return min(MOST_SALTS, max(1, math.ceil(rows / ROWS_A_SALT)))


def salt(salts: int, *of: str) -> Column:
    """The place of a row.  A key is then joined by (key, salt), repeated for the salts that its own rows have (``collect_set``)."""
    # coalesce() tells the optimizer that it is not null: a filter in one branch alone would keep two branches from one exchange.
    return F.coalesce(F.pmod(F.xxhash64(*of), F.lit(salts)).cast("int"), F.lit(0))


#: Tables of which little is left go on in tasks of about so many rows, and in no fewer than so many tasks.
ROWS_A_TASK, LEAST_TASKS = 100_000, 8


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in as many tasks as they ask for: each task that writes a shuffle leaves files, however few its rows."""
    return df.coalesce(max(LEAST_TASKS, math.ceil(rows / ROWS_A_TASK)))


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """Checkpointed, in as many tasks as its rows ask for; and their number."""
    done = checkpointed(df)
    rows = done.count()
    return in_few(done, rows), rows


def alike(*of: str) -> Column:
    """A further join column that follows from the key.

    A side that an aggregate has dealt by the key alone is then shuffled for the join, like the other, and adaptive execution
    may split a hot key's rows among tasks and repeat the key's one row for each.
    """
    return F.pmod(F.xxhash64(*of), F.lit(8)).alias("alike")


def two_hashes(of: Column) -> tuple[Column, Column]:
    """128 bits of hash: the second begins from another seed, so that neither half follows from the other."""
    return F.xxhash64(of), F.xxhash64(F.lit(7), of)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one narrow aggregate, used to size batches and partitions."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about ``most`` bytes of text; a longer text is one by itself.  Memory is given back at the end."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
            yield batch.slice(at, end - at)
            at = end
    release()


def release() -> None:
    """Gives back to the system what a worker has freed: workers outlive their tasks, and two of them and the JVM share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
