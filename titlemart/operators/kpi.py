"""KPI tables over the scored universe: by genre, platform, author, publisher, and the whole market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hhi_band, script_language
from .daily import hhi


def _share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int")) * 100


def genre_kpi(scored: DataFrame) -> DataFrame:
    """One aggregate by genre; titles without one are left out."""
    reach = F.col("reach_raw")
    return (
        scored.filter(F.coalesce("genre", F.lit("")) != "")
        .groupBy("genre")
        .agg(
            F.count(F.lit(1)).alias("titles"), F.sum(reach).alias("reach"), F.avg("composite_score").alias("avg_score"),
            F.max("composite_score").alias("top_score"), F.avg("momentum").alias("avg_momentum"), F.sum("est_usd").alias("est_usd"),
            hhi(reach).alias("hhi"), F.avg("rating").alias("avg_rating"), (F.avg("like_through") * 100).alias("like_through_pct"),
            _share(F.col("content_type") == "novel").alias("novel_pct"),
        )
        .withColumns({"band": hhi_band("hhi"), "whitespace": F.col("reach") / F.col("titles")})
    )


def platform_kpi(scored: DataFrame) -> DataFrame:
    cover = F.col("cover_url").isNotNull() if "cover_url" in scored.columns else F.lit(False)
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("titles"), F.sum("reach_raw").alias("reach"),
        F.coalesce(F.sum("subscribers"), F.lit(0)).alias("subscribers"), F.sum("likes").alias("likes"),
        F.avg("composite_score").alias("avg_score"), F.sum("est_usd").alias("est_usd"), F.avg("rating").alias("avg_rating"),
        (F.avg("like_through") * 100).alias("like_through_pct"), _share(cover).alias("cover_pct"),
        _share(F.col("content_type") == "novel").alias("novel_pct"),
    )


def author_kpi(scored: DataFrame) -> DataFrame:
    return scored.filter("author IS NOT NULL").groupBy("author").agg(
        F.count(F.lit(1)).alias("titles"), F.countDistinct("source").alias("platforms"), F.sum("reach_raw").alias("reach"),
        F.max("composite_score").alias("best_score"), F.avg("composite_score").alias("avg_score"), F.sum("est_usd").alias("est_usd"),
    )


def publisher_kpi(scored: DataFrame) -> DataFrame:
    return scored.filter("publisher IS NOT NULL").groupBy("publisher").agg(
        F.count(F.lit(1)).alias("titles"), F.sum("reach_raw").alias("reach"), F.avg("composite_score").alias("avg_score"),
        F.sum("est_usd").alias("est_usd"),
    )


def market_catalog(scored: DataFrame) -> DataFrame:
    """One row: size, readership, revenue, coverage, concentration of revenue where there is any."""
    est = F.when(F.col("est_usd") > 0, F.col("est_usd"))
    return scored.agg(
        F.count(F.lit(1)).alias("titles"), F.countDistinct("source").alias("platforms"), F.countDistinct("genre").alias("genres"),
        F.countDistinct("author").alias("authors"), F.sum("views").alias("views"), F.sum("reach_raw").alias("reach"),
        F.sum("est_usd").alias("est_usd"), (F.count("author") / F.count(F.lit(1)) * 100).alias("author_pct"),
        (F.count("genre") / F.count(F.lit(1)) * 100).alias("genre_pct"),
        F.count_if(F.col("content_type") == "novel").alias("novels"), F.coalesce(hhi(est), F.lit(0.0)).alias("revenue_hhi"),
    )


def popular_tags(obs: DataFrame, limit: int = 20) -> DataFrame:
    """Tags by the number of titles that carry them."""
    return (
        obs.select("comic_id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("titles"))
        .orderBy(F.desc("titles"), "tag").limit(limit)
    )


def distribution(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram of equal bins; 0 and bins + 1 hold what lies outside."""
    bucket = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(bucket.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fill_rates(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Percent of rows that are not null, of all columns in one pass."""
    return df.groupBy(*by).agg(*((F.count(c) / F.count(F.lit(1)) * 100).alias(f"{c}_pct") for c in columns))


def genre_table(scored: DataFrame, daily_share: bool = True) -> DataFrame:
    """By genre: platforms, best rank, the author of most reach, share of all reach."""
    by_author = scored.filter("genre IS NOT NULL AND author IS NOT NULL").groupBy("genre", "author").agg(F.sum("reach_raw").alias("r"))
    top = by_author.groupBy("genre").agg(F.max_by("author", F.struct("r", "author")).alias("top_author"))
    total = scored.filter("genre IS NOT NULL").agg(F.sum("reach_raw").alias("_all"))
    out = scored.filter("genre IS NOT NULL").groupBy("genre").agg(
        F.countDistinct("source").alias("platforms"), F.min("best_rank").alias("best_rank"), F.sum("reach_raw").alias("reach")
    )
    return out.join(F.broadcast(total)).join(top, "genre", "left").select(
        "genre", "platforms", "best_rank", "top_author", "reach", F.when(F.col("_all") > 0, F.col("reach") / F.col("_all")).otherwise(0.0).alias("share")
    )


def author_table(scored: DataFrame) -> DataFrame:
    """By author: mixes as sorted lists, and the title of most score."""
    return scored.filter("author IS NOT NULL").groupBy("author").agg(
        F.array_join(F.array_sort(F.collect_set("genre")), ", ").alias("genres"),
        F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"),
        F.array_join(F.array_sort(F.collect_set(script_language("title"))), ", ").alias("languages"),
        F.max_by("title", F.struct("composite_score", "comic_id")).alias("top_title"), F.count(F.lit(1)).alias("titles"),
    )


def platform_cards(scored: DataFrame, top: int = 3) -> DataFrame:
    """The best titles of each platform."""
    from pyspark.sql import Window as W

    best = W.partitionBy("source").orderBy(F.desc("composite_score"), "comic_id")
    return scored.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top).select("source", "nth", "comic_id", "title", "composite_score")


def platform_coverage(scored: DataFrame, units: DataFrame) -> DataFrame:
    """By platform: percent of titles with measures, genre, author and status, and how many episodes, chapters and volumes they come to."""
    status = F.col("status") if "status" in scored.columns else F.lit(None)
    u = units.select("comic_id", "episode_count", "chapter_count", "volume_count")
    depth = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{c.split('_')[0]}s")
    return scored.join(u, "comic_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("titles"), _share((F.col("views") > 0) | (F.col("subscribers") > 0)).alias("metrics_pct"),
        _share(F.col("genre").isNotNull()).alias("genre_pct"), _share(F.col("author").isNotNull()).alias("author_pct"),
        _share(status.isNotNull()).alias("status_pct"), *(depth(c) for c in u.columns[1:]),
    )
