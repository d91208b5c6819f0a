"""Sources and sinks of the medallion tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SILVER

#: A platform and day, as folders name them.
DAY = T.StructType([T.StructField("source", T.StringType()), T.StructField("date", T.DateType())])


def read_silver(spark: SparkSession, root: str, *, sources: Sequence[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All observations under ``root/source=*/date=*``, or in flat files under ``root``; of some platforms, and of days from ``since`` to ``until``, if asked for.

    The types of the folders' columns are given, not guessed, so both conditions prune folders before a file is opened.  Flat files
    have no folders to prune: there the observation's own platform and time are asked.
    """
    columns = [f for f in SILVER if f.name != "source"]
    rows = spark.read.schema(T.StructType([*columns, *DAY])).parquet(root)
    one = rows.select(F.input_file_name().alias("path")).first()
    in_folders = one is None or "/source=" in one.path
    day = F.col("date") if in_folders else F.to_date("scraped_at")
    if sources is not None:
        rows = rows.filter(F.col("source").isin(*sources))
    for bound, keep in ((since, lambda b: day >= b), (until, lambda b: day <= b)):
        if bound is not None:
            rows = rows.filter(keep(F.lit(bound).cast("date")))
    return rows.select(*SILVER.names)


def write_silver(records: DataFrame, root: str, *, files_a_day: int = 1) -> None:
    """Folders of the touched platforms and days, written anew; others stay.  A large day spreads over ``files_a_day`` tasks."""
    out = records.withColumns({"date": F.to_date("scraped_at"), "_salt": F.pmod(F.xxhash64("comic_id"), F.lit(files_a_day))})
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rewrite_folders(out.repartition(parts, "source", "date", "_salt").drop("_salt"), root, "source", "date")


def rewrite_folders(df: DataFrame, root: str, *folders: str) -> None:
    """The folders of ``root`` that rows of ``df`` belong to, written anew; all others are left as they are."""
    df.write.partitionBy(*folders).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def write_snapshot(df: DataFrame, root: str, run: int, fmt: str = "parquet") -> None:
    """A table under its run's stamp."""
    df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{root}/run={run}")


def read_newest(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The newest snapshot: the greatest stamp is found among partition values, and only its files are read."""
    runs = spark.read.format(fmt).option("header", "true").load(root)
    newest = runs.agg(F.max("run")).first()[0]
    return runs.filter(F.col("run") == newest).drop("run")


def write_manifest(manifest: DataFrame, root: str) -> None:
    """All pages as Parquet, and those that failed as JSON lines."""
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    manifest.filter(~F.col("status").isin("ok", "empty")).write.mode("overwrite").json(f"{root}/quarantine")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_records").alias("records"))


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Tables as the fields of one JSON document, each row a line of it, in the order of their JSON.

    One document is one file, so its lines pass through one task, sorted with spill; no table is ever held as one value.
    """
    rows = [df.select(F.lit(k).alias("part"), F.lit(1).alias("kind"), F.to_json(F.struct(*df.columns)).alias("line")) for k, df in enumerate(parts.values())]
    names = list(parts)
    edges = [(k, 0, f"{',' if k else '{'}{json.dumps(name)}:[") for k, name in enumerate(names)] + [(k, 2, "]") for k in range(len(names))] + [(len(names), 0, "}")]
    spark = rows[0].sparkSession
    lines = reduce(DataFrame.union, rows, spark.createDataFrame(edges, "part int, kind int, line string"))
    after_row = F.lag("kind").over(W.orderBy("part", "kind", "line")) == 1
    told = lines.select(F.concat(F.when((F.col("kind") == 1) & after_row, ",").otherwise(""), "line").alias("value"))
    told.write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report's document as one row."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """A commented CSV of contracts; rows without a title go, what does not parse is null."""
    rows = spark.read.csv(path, header=True, comment="#")
    return rows.filter(F.coalesce("title_id", F.lit("")) != "").select(
        "title_id", "title", "publisher", "platform", F.col("contract_date").try_cast("date").alias("contract_date"),
        F.col("contract_size_usd").try_cast("double").alias("contract_size_usd"), F.col("term_months").try_cast("int").alias("term_months"),
        "territory", "rights", "notes",
    )
