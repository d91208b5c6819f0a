"""Trend statistics by group: Mann-Kendall with Theil-Sen, least squares, and the report that joins them.

Everything is built-in, p-values too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import volatility_band
from ..functions.pvalues import normal_two_sided, student_two_sided
from .daily import cv, genre_concentration, genre_daily
from .longseries import dealt, kendall_s, median_slope


def indexed(df: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """(keys, i from 0, y) in the order of ``by``."""
    w = W.partitionBy(*keys).orderBy(by)
    return df.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.col(value).cast("double").alias("y"))


def mann_kendall(series: DataFrame, keys: list[str], *, alpha: float = 0.05) -> DataFrame:
    """Of (keys, i, y): S, z, p, Theil-Sen slope over index distance, status; fewer than 4 points: 'Insufficient Data'.

    Pairs are made by an equi-join on the group, i < j, which is for series of days: a group's pairs are bounded by its days.  ``mann_kendall_long`` returns the same for series of any length.
    """
    left = series.select(*keys, F.col("i").alias("a"), F.col("y").alias("ya"))
    right = series.select(*keys, F.col("i").alias("b"), F.col("y").alias("yb"))
    pairs = left.join(right, keys).filter("a < b")
    s = pairs.groupBy(*keys).agg(
        F.sum(F.signum(F.col("yb") - F.col("ya"))).alias("s"), F.median((F.col("yb") - F.col("ya")) / (F.col("b") - F.col("a"))).alias("slope")
    )
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _judged(n.join(s, keys, "left"), keys, alpha)


def mann_kendall_long(series: DataFrame, keys: list[str], *, alpha: float = 0.05) -> DataFrame:
    """``mann_kendall`` of series of any length: S by counting, the slope by selection, no pairs of a group.  Null and NaN values take no part in pairs; null keys are a group."""
    group = F.struct(*keys).alias("g")
    told = dealt(series.filter(F.col("y").isNotNull() & ~F.isnan("y")).select(group, "i", "y"))
    n = series.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    joined = n.join(kendall_s(*told), "g", "left").join(median_slope(*told), "g", "left")
    return _judged(joined.select("g.*", "n", "s", "slope"), keys, alpha)


def _judged(counted: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Of (keys, n, s, slope): with z, p and status."""
    # In doubles: whole numbers of this size leave a long's range from 1.7 million points on.
    n = F.col("n").cast("double")
    var = n * (n - 1) * (2 * n + 5) / 18
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    enough = F.col("n") >= 4
    out = counted.select(
        *keys, "n", F.when(enough, F.col("s")).otherwise(0.0).alias("s"), F.when(enough, z).otherwise(0.0).alias("z"),
        F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"),
    )
    out = out.withColumn("p", F.when(F.col("n") >= 4, normal_two_sided("z")).otherwise(1.0))
    rising = F.when(F.col("z") > 0, "Rising").otherwise("Falling")
    return out.withColumn(
        "status", F.when(F.col("n") < 4, "Insufficient Data").when(F.col("p") < alpha, rising).otherwise("Stable")
    )


def linear_trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, i, y): least-squares slope, intercept, r squared, p, standard error and slope's bounds; fewer than 3 points: zeros, p = 1."""
    agg = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "i").alias("b"), F.regr_intercept("y", "i").alias("a"),
        F.regr_sxx("y", "i").alias("sxx"), F.regr_syy("y", "i").alias("syy"), F.regr_sxy("y", "i").alias("sxy"),
    )
    enough = F.col("n") >= 3
    r2 = F.when(F.col("syy") > 0, F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))).otherwise(0.0)
    out = agg.select(
        *keys, "n", F.when(enough, F.col("b")).otherwise(0.0).alias("slope"), F.when(enough, F.col("a")).otherwise(0.0).alias("intercept"),
        F.when(enough, F.least(F.lit(1.0), r2)).otherwise(0.0).alias("r2"), "sxx", "syy",
    )
    left = F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("syy"))
    se = F.when(enough, F.sqrt(left / (F.col("n") - 2) / F.col("sxx"))).otherwise(0.0)
    out = out.withColumn("se", se)
    t = F.when(F.col("se") > 0, F.col("slope") / F.col("se")).when(F.col("r2") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("p", F.when(enough, student_two_sided(t, F.col("n") - 2)).otherwise(1.0)).select(
        *keys, "n", "slope", "intercept", "r2", "p", "se",
        (F.col("slope") - 1.96 * F.col("se")).alias("slope_low"), (F.col("slope") + 1.96 * F.col("se")).alias("slope_high"),
    )


def trend_report(daily: DataFrame, *, least_days: int = 3) -> DataFrame:
    """By genre with at least so many days: totals, both trends of daily views, concentration, volatility."""
    by_day = genre_daily(daily.filter(F.coalesce("genre", F.lit("")) != ""))
    size = by_day.groupBy("genre").agg(
        F.count(F.lit(1)).alias("days"), F.sum("total_views").alias("total_views"), F.max("titles").alias("max_titles"),
        F.avg("mean_engagement").alias("mean_engagement"), cv(F.col("total_views")).alias("cv"),
    ).filter(F.col("days") >= least_days)
    series = indexed(by_day.join(size.select("genre"), "genre", "left_semi"), ["genre"], "date", "total_views")
    mk = mann_kendall(series, ["genre"]).select("genre", F.col("status").alias("trend"), F.col("z").alias("mk_z"), F.col("p").alias("mk_p"), F.col("slope").alias("sen_slope"))
    lin = linear_trend(series, ["genre"]).select("genre", "slope", "r2", F.col("p").alias("lin_p"))
    return (
        size.join(mk, "genre").join(lin, "genre").join(genre_concentration(daily), "genre")
        .withColumns({"both_significant": (F.col("mk_p") < 0.05) & (F.col("lin_p") < 0.05), "volatility": volatility_band("cv")})
    )


def weekly_trends(daily: DataFrame) -> DataFrame:
    """By genre, source and week: views, velocity and acceleration week on week, with the series' trend measures, as the declared table's types."""
    from ..functions.exprs import acceleration, velocity
    from ..schema import WEEKLY_TRENDS

    weekly = daily.groupBy("genre", "source", F.to_date(F.date_trunc("week", "date")).alias("week_start")).agg(F.sum("views").alias("total_views"))
    w = W.partitionBy("genre", "source").orderBy("week_start")
    v = weekly.withColumn("view_velocity", velocity(F.col("total_views"), F.lag("total_views").over(w)))
    v = v.withColumn("view_acceleration", acceleration(F.col("view_velocity"), F.coalesce(F.lag("view_velocity").over(w), F.lit(0.0))))
    series = indexed(weekly, ["genre", "source"], "week_start", "total_views")
    mk = mann_kendall(series, ["genre", "source"]).select("genre", "source", F.col("status").alias("trend_status"), F.col("z").alias("mann_kendall_z"), F.col("n").alias("n_points"))
    lin = linear_trend(series, ["genre", "source"]).select("genre", "source", F.col("r2").alias("r_squared"))
    out = v.join(mk, ["genre", "source"]).join(lin, ["genre", "source"])
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in WEEKLY_TRENDS))


