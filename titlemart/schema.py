"""The contract of a dated title observation, and the typed tables that hang on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

#: One title on one platform at one time.
SILVER = T.StructType(
    [T.StructField(n, _S) for n in ("comic_id", "source", "platform_native_id", "title", "author", "genre", "url")]
    + [T.StructField("rank", _I), T.StructField("primary_metric", _L), T.StructField("metric_type", _S)]
    + [T.StructField(n, _L) for n in ("views", "likes", "subscribers", "comments")]
    + [T.StructField("rating", _D)]
    + [T.StructField(n, _I) for n in ("episode_count", "chapter_count", "volume_count")]
    + [T.StructField("synopsis", _S), T.StructField("tags", T.ArrayType(_S))]
    + [T.StructField(n, _S) for n in ("cover_url", "publisher", "status", "content_type")]
    + [T.StructField("scraped_at", T.TimestampType()), T.StructField("source_file", _S)]
)

#: Accepted domains and what stands for anything else.
METRIC_TYPES = ("views", "likes", "subscribers", "reads", "rank", "unknown")
CONTENT_TYPES = ("comic", "novel")

#: Declared type of the weekly aggregate.
WEEKLY_TRENDS = T.StructType(
    [
        T.StructField("genre", _S), T.StructField("source", _S), T.StructField("week_start", T.DateType()),
        T.StructField("total_views", _L), T.StructField("view_velocity", T.DecimalType(18, 6)),
        T.StructField("view_acceleration", T.DecimalType(18, 6)), T.StructField("trend_status", _S),
        T.StructField("mann_kendall_z", T.DecimalType(18, 4)), T.StructField("r_squared", T.DecimalType(18, 6)),
        T.StructField("n_points", _L),
    ]
)


def order_of() -> Column:
    """The total order of a title's observations: time, then file."""
    return F.struct("scraped_at", "source_file")


def validated(records: DataFrame) -> DataFrame:
    """Records with exactly the contract's columns, types and domains; missing columns are null, counts that must be there are 0."""
    from .functions.exprs import collapse_ws, domain_check

    held = set(records.columns)
    columns = []
    for field in SILVER:
        c = F.col(field.name).try_cast(field.dataType) if field.name in held else F.lit(None).cast(field.dataType)
        if field.name in ("title", "author", "genre", "publisher", "status", "synopsis"):
            c = collapse_ws(c)
        elif field.name in ("views", "likes", "primary_metric"):
            c = F.coalesce(c, F.lit(0).cast(field.dataType))
        elif field.name == "metric_type":
            c = domain_check(c, METRIC_TYPES, "unknown")
        elif field.name == "content_type":
            c = domain_check(c, CONTENT_TYPES, "comic")
        columns.append(c.alias(field.name))
    return records.select(*columns)
