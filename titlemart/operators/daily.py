"""Dated observations to daily, weekly and rolling measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import engagement_ratio_of_table, hhi_band
from ..schema import order_of
from .keys import dense_ranks, earliest, latest


def daily_snapshot(obs: DataFrame) -> DataFrame:
    """One row a title and day: first title, genre and source in time order, greatest views and likes."""
    return obs.groupBy("comic_id", F.to_date("scraped_at").alias("date")).agg(
        *(earliest(c, order_of()).alias(c) for c in ("title", "genre", "source")),
        F.max("views").alias("views"), F.max("likes").alias("likes"),
    )


def _by_day(df: DataFrame) -> W:
    return W.partitionBy("comic_id").orderBy("date")


def day_over_day(daily: DataFrame) -> DataFrame:
    """``views_gained`` and ``likes_gained`` since the title's last snapshot; 0 for the first."""
    w = _by_day(daily)
    return daily.withColumns({f"{c}_gained": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in ("views", "likes")})


def pct_change(gained: Column, now: Column) -> Column:
    before = now - gained
    return gained / F.when(before > 0, before).otherwise(1) * 100


def report_pct_change(gained: Column, now: Column) -> Column:
    before = now - gained
    return F.when(before > 0, F.round(gained / before * 100, 2)).otherwise(0.0)


def rolling_mean(c: str, w: W, n: int = 7) -> Column:
    """Mean of the last n rows, null before there are n."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def moving_average(c: str, keys: list[str], by: str, n: int) -> Column:
    """Mean of up to n rows; a series shorter than n is itself."""
    whole = W.partitionBy(*keys)
    return F.when(F.count(F.lit(1)).over(whole) < n, F.col(c).cast("double")).otherwise(
        F.avg(c).over(whole.orderBy(by).rowsBetween(-(n - 1), 0))
    )


def all_metrics(daily: DataFrame) -> DataFrame:
    """Engagement, gains, percentages and rolling means of daily rows: one window, one shuffle."""
    w = _by_day(daily)
    return (
        day_over_day(daily)
        .withColumns({
            "engagement": engagement_ratio_of_table("likes", "views"),
            "views_pct": pct_change(F.col("views_gained"), F.col("views")),
            "likes_pct": pct_change(F.col("likes_gained"), F.col("likes")),
            "views_ma7": rolling_mean("views", w), "likes_ma7": rolling_mean("likes", w),
        })
    )


def daily_rank(daily: DataFrame) -> DataFrame:
    """Dense rank by views of each day; a day's titles are ranked in ranges, not in one task."""
    return dense_ranks(daily, "date", "views", "day_rank", "comic_id")


def rank_delta(obs: DataFrame) -> DataFrame:
    """First and last rank of titles ranked more than once; a positive delta is a rise."""
    o = order_of()
    return (
        obs.groupBy("comic_id")
        .agg(earliest("rank", o, non_null=True).alias("first_rank"), latest("rank", o, non_null=True).alias("last_rank"), F.count("rank").alias("n_ranked"))
        .filter("n_ranked > 1").withColumn("delta", F.col("first_rank") - F.col("last_rank"))
    )


def with_week(df: DataFrame, c: str = "date", *, iso_year: bool = False) -> DataFrame:
    """ISO week with the calendar's year, or with the week's own."""
    year = F.extract(F.lit("yearofweek"), F.col(c)) if iso_year else F.year(c)
    return df.withColumns({"week": F.weekofyear(c), "year": year, "week_start": F.to_date(F.date_trunc("week", c))})


def seen_dates(obs: DataFrame) -> DataFrame:
    d = F.to_date("scraped_at")
    return obs.groupBy("comic_id").agg(
        F.min(d).alias("first_seen"), F.max(d).alias("last_seen"), F.countDistinct(d).alias("n_days")
    )


def gap_analysis(gold: DataFrame) -> DataFrame:
    """Supply, demand and their ratios by genre."""
    return (
        gold.groupBy("genre")
        .agg(F.countDistinct("comic_id").alias("supply"), F.sum("views").alias("demand"), F.sum("views_gained").alias("momentum"))
        .withColumns({
            "opportunity": F.col("demand") / (F.col("supply") + 1), "saturation": F.col("supply") / (F.col("demand") + 1)
        })
    )


def genre_daily(daily: DataFrame, *more: str) -> DataFrame:
    """By genre (and more) and day: sums, distinct titles, mean engagement."""
    return daily.groupBy("genre", *more, "date").agg(
        F.sum("views").alias("total_views"), F.sum("likes").alias("total_likes"), F.countDistinct("comic_id").alias("titles"),
        F.avg(engagement_ratio_of_table("likes", "views")).alias("mean_engagement"),
    )


def market_share(df: DataFrame, value: str, *by: str) -> DataFrame:
    total = F.sum(value).over(W.partitionBy(*by))
    return df.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col(value) / total))


def weekly_tables(gold: DataFrame) -> DataFrame:
    """By week and genre, week and source, and week, source and genre, from one scan: ``level`` tells which."""
    ranked = with_week(daily_rank(gold)).withColumn("engagement", engagement_ratio_of_table("likes", "views"))
    out = None
    for level, keys in (("genre", ["genre"]), ("source", ["source"]), ("source_genre", ["source", "genre"])):
        one = ranked.groupBy("year", "week", *keys).agg(
            F.sum("views").alias("total_views"), F.sum("likes").alias("total_likes"), F.countDistinct("comic_id").alias("titles"),
            F.avg("day_rank").alias("mean_rank"), F.avg("engagement").alias("mean_engagement"), F.sum("views_gained").alias("gained"),
        )
        one = one.select(
            F.lit(level).alias("level"), "year", "week",
            *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("source", "genre")),
            "total_views", "total_likes", "titles", "mean_rank", "mean_engagement", "gained",
        )
        out = one if out is None else out.unionByName(one)
    return out


def hhi(value: Column) -> Column:
    """Aggregate: sum of squared shares times 10,000; 0 where the total is 0."""
    v = value.cast("double")
    total = F.sum(v)
    return F.when(total == 0, 0.0).otherwise(F.sum(v * v) / (total * total) * 10000)


def genre_concentration(gold: DataFrame) -> DataFrame:
    """HHI and band of each genre over its titles' summed views: two aggregates, title then genre."""
    by_title = gold.groupBy("genre", "comic_id").agg(F.sum("views").alias("v"))
    out = by_title.groupBy("genre").agg(hhi(F.col("v")).alias("hhi"), F.sum("v").alias("_total"))
    return out.select("genre", "hhi", F.when(F.col("_total") == 0, "N/A").otherwise(hhi_band("hhi")).alias("band"))


def cv(value: Column) -> Column:
    """Aggregate: population deviation over mean; 0 for fewer than two values or a mean of 0."""
    return F.when((F.count(value) < 2) | (F.avg(value) == 0), 0.0).otherwise(F.stddev_pop(value) / F.avg(value))


def z_scores(df: DataFrame, value: str, *by: str, threshold: float = 2.0) -> DataFrame:
    w = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    z = F.when((F.count(value).over(w) < 2) | (sd == 0), 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd)
    return df.withColumn("z", z).withColumn("outlier", F.abs("z") > threshold)


def market_scores(days: DataFrame, scores: DataFrame) -> DataFrame:
    """By day: mean score and modelled revenue of the titles seen, and how many of them have a rank."""
    s = scores.select("comic_id", "composite_score", "est_usd")
    return days.join(s, "comic_id", "left").groupBy("date").agg(
        F.avg("composite_score").alias("mean_score"), F.sum("est_usd").alias("est_usd"), F.count("rank").alias("ranked_titles"), F.count(F.lit(1)).alias("titles")
    )


def market_over_time(gold: DataFrame, first_seen: DataFrame) -> DataFrame:
    """By day: titles, new titles, reach so far, HHI over genres.  The running sum is over days, few rows."""
    by_genre = gold.groupBy("date", "genre").agg(F.sum("views").alias("v"))
    concentration = by_genre.groupBy("date").agg(hhi(F.col("v")).alias("genre_hhi"), F.count(F.lit(1)).alias("genres"))
    new = first_seen.groupBy(F.col("first_seen").alias("date")).agg(F.count(F.lit(1)).alias("new_titles"))
    days = gold.groupBy("date").agg(F.countDistinct("comic_id").alias("titles"), F.sum("views").alias("reach"))
    return (
        days.join(concentration, "date").join(new, "date", "left")
        .withColumn("new_titles", F.coalesce("new_titles", F.lit(0)))
        .withColumn("cumulative_reach", F.sum("reach").over(W.orderBy("date")))
    )
