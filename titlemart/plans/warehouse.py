"""The dimensional build: dimensions, facts, bridges, aggregates and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import platform_name, with_genre
from ..functions.lineage import cut
from ..functions.tables import PLATFORM_NAMES
from ..operators.episodes import engagement_decay, per_title
from ..operators.keys import running, dense_key, earliest
from ..schema import order_of
from ..sources.files import rewrite_folders

#: Files that one day of an updated table is written in, at most.
FILES_A_DAY = 8


def title_day(obs: DataFrame) -> DataFrame:
    """One row a title and day: first attributes, greatest measures, least rank."""
    o = order_of()
    return obs.groupBy("comic_id", F.to_date("scraped_at").alias("date")).agg(
        earliest("source", o).alias("source"), earliest("platform_native_id", o).alias("platform_native_id"),
        *(F.max(c).alias(c) for c in ("views", "likes", "subscribers", "rating")), F.min("rank").alias("rank"),
    )


def dim_platform(scored: DataFrame) -> DataFrame:
    """Known platforms and seen ones; those without titles stay, with 0."""
    known = scored.sparkSession.createDataFrame(list(PLATFORM_NAMES.items()), "source string, platform string")
    counts = scored.groupBy("source").agg(F.count(F.lit(1)).alias("titles"))
    return known.join(counts, "source", "full").select(
        "source", F.coalesce("platform", "source").alias("platform"), F.coalesce("titles", F.lit(0)).alias("titles")
    )


def dim_date(daily: DataFrame) -> DataFrame:
    return daily.select("date").distinct().select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), F.weekofyear("date").alias("iso_week"),
        (F.dayofweek("date") - 1).alias("day_of_week"), F.date_format("date", "yyyy-MM").alias("year_month"),
    )


def dim_name(scored: DataFrame, column: str) -> DataFrame:
    """Distinct names that are not empty, with keys from 1 in their order."""
    return dense_key(scored.filter(F.col(column) != ""), column, f"{column}_key")


def dim_title(scored: DataFrame, seen: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    from ..operators.entities import restricted_flag

    named = with_genre(scored.join(seen, "comic_id"))
    flagged = restricted_flag(named, restricted) if restricted is not None else named.withColumn("restricted", F.lit(False))
    return flagged.select(
        F.col("comic_id").alias("title_key"), "title", "source", platform_name("source").alias("platform"), "author", "content_type",
        F.col("genre").alias("genre_raw"), "genre_en", "genre_parent", "first_seen", "last_seen", "n_days", "restricted",
    )


def dim_episode(episodes: DataFrame) -> DataFrame:
    """Keys by (title, number): one running count over their order."""
    ids = episodes.select("comic_id", "episode_no").distinct().withColumn("_by", F.struct("comic_id", "episode_no"))
    keyed = running(ids.select("_by", F.lit(1).cast("bigint").alias("_one")), ["_by"], "_one")
    return keyed.select((F.col("before") + 1).cast("bigint").alias("episode_key"), F.col("_by.comic_id").alias("title_key"), F.col("_by.episode_no").alias("episode_no"))


def fact_episode(episodes: DataFrame, dim: DataFrame) -> DataFrame:
    e = episodes.groupBy(F.col("comic_id").alias("title_key"), "episode_no").agg(F.max("likes").alias("likes"))
    return dim.join(e, ["title_key", "episode_no"]).select(
        "episode_key", "title_key", "likes", F.lit(None).cast("bigint").alias("views"), F.lit(None).cast("bigint").alias("comments")
    )


def fact_score(scored: DataFrame) -> DataFrame:
    return scored.select(
        F.col("comic_id").alias("title_key"), "composite_score", *(f"{c}_pct" for c in ("reach", "momentum", "engagement", "monetization", "quality")), "est_usd"
    )


def fact_platform_daily(days: DataFrame) -> DataFrame:
    return days.groupBy("source", "date").agg(
        F.countDistinct("comic_id").alias("titles"), F.sum("views").alias("views"), F.sum("likes").alias("likes"),
        F.coalesce(F.sum("subscribers"), F.lit(0)).alias("subscribers"), F.round(F.avg("rating"), 3).alias("mean_rating"),
    )


def bridge(scored: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """(title, key of its name)."""
    return scored.select(F.col("comic_id").alias("title_key"), column).join(dim, column).select("title_key", f"{column}_key")


def period_aggregate(days: DataFrame, periods: dict[str, int | str | None] | None = None) -> DataFrame:
    """By title and period back from the last day: one aggregate with conditions, so a day counts in all its periods and is one row all the same.

    A period is a number of days back, ``"year"`` for the last day's calendar year, or None for all days.
    """
    periods = periods or {"all": None, "30d": 30, "7d": 7}
    last = days.agg(F.max("date").alias("_last"))

    def of(name: str, back: int | str | None) -> Column:
        cutoff = F.to_date(F.trunc("_last", "year")) if back == "year" else F.date_sub("_last", back) if back is not None else None
        inside = F.col("date").isNotNull() if cutoff is None else F.col("date") >= cutoff
        views, rank = (F.when(inside, F.col(c)) for c in ("views", "rank"))
        return F.struct(
            F.lit(name).alias("period"), F.count_if(inside).alias("n"), F.avg(views).alias("mean_views"), F.max(views).alias("max_views"), F.avg(rank).alias("mean_rank"), F.min(rank).alias("min_rank")
        )

    held = days.join(F.broadcast(last)).groupBy("comic_id").agg(*(of(*p).alias(f"_{k}") for k, p in enumerate(periods.items())))
    return held.select("comic_id", F.explode(F.array(*(f"_{k}" for k in range(len(periods))))).alias("p")).select("comic_id", "p.*").filter("n > 0")


def genre_daily(days: DataFrame, titles: DataFrame, scores: DataFrame) -> DataFrame:
    t = titles.select(F.col("title_key").alias("comic_id"), "genre_parent")
    s = scores.select(F.col("title_key").alias("comic_id"), "composite_score")
    return (
        days.join(t, "comic_id").join(s, "comic_id", "left").groupBy("genre_parent", "date")
        .agg(F.countDistinct("comic_id").alias("titles"), F.sum("views").alias("views"), F.avg("composite_score").alias("mean_score"))
    )


def platform_period(platform_days: DataFrame) -> DataFrame:
    return platform_days.groupBy("source").agg(
        F.countDistinct("date").alias("days"), F.avg("titles").alias("mean_titles"), F.max("views").alias("peak_views")
    )


def title_current(days: DataFrame, titles: DataFrame) -> DataFrame:
    """Each title with its last day's measures."""
    last = days.groupBy("comic_id").agg(F.max_by(F.struct("date", "views", "likes", "rank"), "date").alias("l"))
    return titles.join(last, titles.title_key == last.comic_id, "left").select(
        "title_key", "title", "source", "genre_parent", F.col("l.date").alias("date"), F.col("l.views").alias("views"), F.col("l.likes").alias("likes"), F.col("l.rank").alias("rank")
    )


def platform_summary(platforms: DataFrame, periods: DataFrame) -> DataFrame:
    """Each platform with what its days come to; platforms without days stay."""
    return platforms.join(periods, "source", "left").select("source", "platform", "titles", "days", "mean_titles", "peak_views")


def content_structure(scored: DataFrame, units: DataFrame, episodes: DataFrame) -> DataFrame:
    """Titles with their units, and of those with tracked episodes how these do."""
    e = per_title(episodes).select("comic_id", F.col("n").alias("episodes"), F.col("mean_likes"), F.col("max_likes"))
    decay = engagement_decay(episodes).select("comic_id", "decay_pct")
    u = units.select("comic_id", "units", "unit_type", "chapters_per_volume")
    return scored.join(u, "comic_id").join(e, "comic_id", "left").join(decay, "comic_id", "left").select(
        "comic_id", "title", platform_name("source").alias("platform"), "genre", "author", "content_type", "unit_type", "units", "chapters_per_volume",
        "episodes", "mean_likes", "max_likes", "decay_pct", "composite_score", "views",
    )


def market(scored: DataFrame) -> DataFrame:
    """One row: size, titles with measures, reach, revenue and like-through of the whole market."""
    return scored.agg(
        F.count(F.lit(1)).alias("titles"), F.count_if((F.col("views") > 0) | (F.col("subscribers") > 0)).alias("with_metrics"),
        F.countDistinct("author").alias("authors"), F.countDistinct("genre").alias("genres"), F.sum("views").alias("total_reach"),
        F.sum("est_usd").alias("est_monthly_usd"), F.round(F.avg("like_through") * 100, 2).alias("mean_like_through_pct"),
    )


def leaderboard(titles: DataFrame, scores: DataFrame, limit: int = 100) -> DataFrame:
    return titles.join(scores, "title_key").orderBy(F.desc_nulls_last("composite_score"), "title_key").limit(limit).select("title_key", "title", "source", "composite_score", "est_usd")


def upsert_daily(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("comic_id", "date")) -> DataFrame:
    """Rows of ``changes`` over those of ``base`` with the same key; the later order wins among changes.

    Changes become one row a key in an aggregate, which combines before its shuffle; of ``base``, keys are joined and nothing is sorted by its columns.
    """
    rest = [c for c in base.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest))
    return base.join(newest.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(newest)


def upsert_table(changes: DataFrame, root: str, *, day: str = "date", keys: tuple[str, ...] = ("comic_id", "date")) -> list:
    """Takes ``changes`` into the table in folders by ``day`` under ``root``; returns the days that were touched, in order.

    Only the touched days are read, merged and written again; files of all other days stay as they are.  The merged days are written to the shared
    folder before any of the table's files goes, so a lost executor finds what it needs.  The table's columns and types stay; of ``changes``, other columns are left out.
    ``keys`` hold ``day``: a row never moves from one day to another.
    """
    if day not in keys:
        raise ValueError("the day must be among the keys")
    touched = sorted(r[0] for r in changes.select(day).distinct().collect())  # one row a day
    if not touched:
        return []
    table = changes.sparkSession.read.parquet(root)
    own = changes.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema))
    merged = cut(upsert_daily(table.filter(F.col(day).isin(*touched)), own, keys))
    rewrite_folders(merged.repartition(day, F.pmod(F.xxhash64(*keys), F.lit(FILES_A_DAY))), root, day)
    return touched


def insert_first_wins(dim: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows stay; keys that are not there come in once."""
    fresh = new.select(*dim.columns).join(dim.select(key), key, "left_anti")
    w = W.partitionBy(key).orderBy(*(c for c in dim.columns if c != key))
    return dim.unionByName(fresh.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Tables under the names that users' SQL knows."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
