"""Daily increments: observations that arrive as files, taken into the day table as they come.

The batch jobs stay the definition of every table; this is how a day's files reach them without a full run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SILVER


def observations(spark: SparkSession, root: str, *, files_a_batch: int = 1000) -> DataFrame:
    """New files of observations under a folder, as a stream."""
    return spark.readStream.schema(SILVER).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(root)


def day_measures(stream: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Greatest measures of each title and day; a day is final when the watermark has passed it."""
    return (
        stream.withWatermark("scraped_at", late)
        .groupBy(F.window("scraped_at", "1 day").alias("w"), "comic_id")
        .agg(F.max("views").alias("views"), F.max("likes").alias("likes"), F.min("rank").alias("rank"))
        .select("comic_id", F.to_date("w.start").alias("date"), "views", "likes", "rank")
    )


def write_days(stream: DataFrame, root: str, checkpoint: str):
    """Appends final days to Parquet, exactly once; stops when the files at hand are read."""
    return (
        day_measures(stream).writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
