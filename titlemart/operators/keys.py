"""One row per key, ranks over a whole table, and dense keys: the helpers that other jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut


def latest(c: Column | str, order: Column, *, non_null: bool = False) -> Column:
    """Aggregate: the value at the greatest ``order``; with ``non_null``, among values that are there."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(c, F.when(c.isNotNull(), order) if non_null else order)


def earliest(c: Column | str, order: Column, *, non_null: bool = False) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.min_by(c, F.when(c.isNotNull(), order) if non_null else order)


def latest_row(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of greatest ``order`` of each key: one aggregate, which combines before its shuffle."""
    row = F.max_by(F.struct(*df.columns), order).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that may put nulls last."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


#: Into so many places the rows of one value are dealt when something comes back to them.
SALTS = 16


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    """Aggregate: the salts of a group's rows, as bits of one number, so that groups stay in a hash aggregate."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_salt"))).alias("_salts")


def _each_salt() -> Column:
    bits = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.explode(F.filter(bits, lambda k: F.call_function("getbit", F.col("_salts"), k) == 1)).alias("_salt")


def running(df: DataFrame, by: list[str], n: str, *carry: str) -> DataFrame:
    """``before``: the sum of ``n`` over all rows that come earlier in the order of ``by[-1]`` among rows of equal ``by[:-1]``.

    Rows are range-partitioned; a running sum inside each partition meets the sum of its first group in the partitions before it: one number a
    partition, as its other groups begin there.  The dealt rows are cut off from their lineage, so that both uses see the same ranges.  Groups must not be null.
    """
    group = by[:-1]
    dealt = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*group, "_part").orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_part").agg(F.sum(n).alias("_n"))
    base = sums.select(*group, "_part", F.sum("_n").over(upto).alias("_base")).filter("_base <> 0")
    run = dealt.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    before = F.col("_inside") + F.coalesce("_base", F.lit(0))
    return run.join(F.broadcast(base), [*group, "_part"], "left").select(*by, n, *carry, before.alias("before"))


def average_ranks(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_rank``: average-method ranks among all rows (1 for the least), without a single-task window.

    Equal values are counted first, so a value that a third of all rows share is one row when ranks are made; all columns share
    one pass in long form.  A rank comes back to its rows by value and salt, repeated only for the salts that they have, so a hot value's rows meet it in many
    tasks.  Values must not be null, and ``key`` must be unique.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))
    long = df.select(key, F.explode(pairs).alias("x")).select(key, "x.name", "x.v", _salt(key).alias("_salt"))
    counts = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("k"), _salts())
    ranks = running(counts, ["name", "v"], "k", "_salts").select("name", "v", (F.col("before") + (F.col("k") + 1) / 2).alias("r"), _each_salt())
    wide = long.join(ranks, ["name", "v", "_salt"]).groupBy(key).agg(
        *(F.max(F.when(F.col("name") == c, F.col("r"))).alias(f"{c}_rank") for c in columns)
    )
    return df.join(wide, key)


def dense_key(df: DataFrame, by: str, name: str) -> DataFrame:
    """Distinct values of ``by`` with consecutive keys from 1 in their order."""
    one = df.select(by).filter(F.col(by).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, [by], "_one").select((F.col("before") + 1).cast("bigint").alias(name), by)


def dense_ranks(df: DataFrame, group: str, value: str, name: str, key: str) -> DataFrame:
    """``df`` with the dense rank of ``value``, greatest first and nulls last, within each ``group``; no task holds a group.

    Each value of a group counts once, so a value that many rows share is one row when ranks are made; values are dealt in ranges by (group, value), and a running count inside
    each range meets the counts of the group's ranges before it.  Ranks come back to rows by group, value and the salt of ``key``.
    """
    # Nulls are the last of two kinds; a whole number's bits turned over, or a number's negative, run from the greatest down.  As structs, null groups and values meet themselves.
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    down = F.bitwise_not(value) if whole else -F.col(value)
    place = F.struct(F.col(value).isNull().alias("none"), F.when(F.col(value).isNotNull(), down).otherwise(0).alias("down"))
    placed = df.withColumns({"_group": F.struct(F.col(group).alias("g")), "_place": place, "_salt": _salt(key)})
    one = placed.groupBy("_group", "_place").agg(F.lit(1).cast("bigint").alias("_one"), _salts())
    ranks = running(one, ["_group", "_place"], "_one", "_salts")
    ranks = ranks.select("_group", "_place", (F.col("before") + 1).cast("int").alias(name), _each_salt())
    return placed.join(ranks, ["_group", "_place", "_salt"]).select(*df.columns, name)
