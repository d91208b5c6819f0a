"""Anomalies; the thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def largest_step(daily: DataFrame, value: str, *, floor: float = 1.0) -> DataFrame:
    """By title: the largest change and the largest relative jump of one step, where the base is at least ``floor``."""
    w = W.partitionBy("comic_id").orderBy("date")
    before = F.lag(value).over(w)
    steps = daily.filter(F.col(value).isNotNull()).withColumn("_before", before).withColumn("_step", F.col(value) - F.col("_before"))
    return steps.groupBy("comic_id").agg(
        F.max(F.abs("_step")).alias("largest_step"),
        F.max(F.when(F.col("_before") >= floor, F.col("_step") / F.col("_before"))).alias("largest_jump"),
    )


def rank_leaps(ranks: DataFrame, *, least: int = 20) -> DataFrame:
    """Titles whose rank (a column ``rank`` by ``date``) moved at least so far in one step."""
    return largest_step(ranks, "rank").filter(F.col("largest_step") >= least).select("comic_id", "largest_step")


def view_surges(daily: DataFrame, *, least: float = 5.0, floor: float = 1000.0) -> DataFrame:
    return largest_step(daily, "views", floor=floor).filter(F.col("largest_jump") >= least).select("comic_id", "largest_jump")


def author_clusters(flags: list[DataFrame], authors: DataFrame, *, least: int = 2) -> DataFrame:
    """Authors of at least so many flagged titles."""
    ids = None
    for f in flags:
        ids = f.select("comic_id") if ids is None else ids.union(f.select("comic_id"))
    return (
        ids.distinct().join(authors, "comic_id").filter("author IS NOT NULL").groupBy("author")
        .agg(F.count(F.lit(1)).alias("flagged")).filter(F.col("flagged") >= least)
    )
