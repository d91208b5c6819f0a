"""Episodes and units: cadence, decay, spikes, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import parse_upload_date
from .keys import latest


def newest_episodes(rows: DataFrame) -> DataFrame:
    """The newest row of each (title, number)."""
    row = F.max_by(F.struct(*rows.columns), F.struct("scraped_at", "source_file")).alias("_row")
    return rows.groupBy("comic_id", "episode_no").agg(row).select("_row.*")


def with_upload_day(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("upload_day", parse_upload_date("upload_date"))


def per_title(episodes: DataFrame) -> DataFrame:
    """Counts, likes, span of dates, episodes a week."""
    e = with_upload_day(episodes).groupBy("comic_id").agg(
        F.max("episode_no").alias("max_no"), F.count(F.lit(1)).alias("n"), F.avg("likes").alias("mean_likes"),
        F.median("likes").alias("median_likes"), F.max("likes").alias("max_likes"),
        F.min("upload_day").alias("first_day"), F.max("upload_day").alias("last_day"),
    )
    span = F.datediff("last_day", "first_day")
    return e.withColumns({
        "span_days": span, "per_week": F.when((span > 0) & (F.col("n") > 1), (F.col("n") - 1) / (span / 7))
    })


def per_author(episodes: DataFrame, authors: DataFrame) -> DataFrame:
    """By author of (comic_id, author): titles, episodes, likes."""
    return (
        episodes.drop("author").join(authors, "comic_id", "left").filter("author IS NOT NULL").groupBy("author")
        .agg(F.countDistinct("comic_id").alias("titles"), F.count(F.lit(1)).alias("episodes"),
             F.avg("likes").alias("mean_likes"), F.sum("likes").alias("total_likes"))
    )


def series_map(episodes: DataFrame, limit: int | None = 200) -> DataFrame:
    """(episode, likes) pairs in order, of the titles of most likes; None: of all."""
    kept = episodes
    if limit is not None:
        top = episodes.groupBy("comic_id").agg(F.sum("likes").alias("_t")).orderBy(F.desc("_t"), "comic_id").limit(limit)
        kept = episodes.join(top, "comic_id", "left_semi")
    return kept.groupBy("comic_id").agg(F.array_sort(F.collect_list(F.struct("episode_no", "likes"))).alias("series"))


def weekly_releases(episodes: DataFrame) -> DataFrame:
    return (
        with_upload_day(episodes).filter("upload_day IS NOT NULL")
        .groupBy(F.to_date(F.date_trunc("week", "upload_day")).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("releases"), F.avg("likes").alias("mean_likes"))
    )


def unit_table(obs: DataFrame) -> DataFrame:
    """One row a title: its units, of the first kind that it counts, and chapters a volume."""
    o = F.struct("scraped_at", "source_file")
    kinds = ("episode", "chapter", "volume")
    counts = {k: f"{k}_count" for k in kinds}
    for c in counts.values():
        if c not in obs.columns:
            obs = obs.withColumn(c, F.lit(None).cast("int"))
    u = obs.groupBy("comic_id").agg(
        *(latest(c, o, non_null=True).alias(c) for c in ("source", "title", "genre", "content_type")),
        *(F.max(c).alias(c) for c in counts.values()),
    )
    return units_of(u)


def units_of(titles: DataFrame) -> DataFrame:
    """Titles with their units, of the first kind that they count; a kind that has no column is counted by none."""
    kinds = ("episode", "chapter", "volume")
    counts = {k: F.col(f"{k}_count") if f"{k}_count" in titles.columns else F.lit(None).cast("int") for k in kinds}
    kind = F.coalesce(*(F.when(c.isNotNull(), k) for k, c in counts.items()))
    ratio = F.when((counts["chapter"] > 0) & (counts["volume"] > 0), F.round(counts["chapter"] / counts["volume"], 1))
    return titles.withColumns({"units": F.coalesce(*counts.values()), "unit_type": kind, "chapters_per_volume": ratio})


def engagement_decay(episodes: DataFrame) -> DataFrame:
    """Fall of mean likes from the first half (n // 2 episodes) to the rest, in percent; one episode: 0; nothing early: null."""
    w = W.partitionBy("comic_id").orderBy("episode_no", "likes")
    whole = W.partitionBy("comic_id")
    half = F.floor(F.count(F.lit(1)).over(whole) / 2)
    e = episodes.withColumn("_early", F.row_number().over(w) <= half)
    out = e.groupBy("comic_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_early"), F.col("likes"))).alias("early"),
        F.avg(F.when(~F.col("_early"), F.col("likes"))).alias("late"),
    )
    return out.withColumn(
        "decay_pct", F.when(F.col("n") == 1, 0.0).when(F.col("early") > 0, (F.col("early") - F.col("late")) / F.col("early") * 100)
    )


def unit_rollup(units: DataFrame, *by: str) -> DataFrame:
    return units.filter("units IS NOT NULL").groupBy(*by).agg(
        F.count(F.lit(1)).alias("titles"), F.avg("units").alias("mean_units"), F.median("units").alias("median_units"),
        F.max("units").alias("max_units"), F.sum("units").alias("total_units"),
    )


def robust_z(episodes: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Episodes whose likes stand out of their series: 0.6745 * (x - median) / MAD; no spread: none."""
    m = episodes.groupBy("comic_id").agg(F.median("likes").alias("_m"))
    gap = episodes.join(m, "comic_id").withColumn("_gap", F.abs(F.col("likes") - F.col("_m")))
    mad = gap.groupBy("comic_id").agg(F.median("_gap").alias("_mad"))
    z = F.when(F.col("_mad") > 0, 0.6745 * (F.col("likes") - F.col("_m")) / F.col("_mad"))
    return gap.join(mad, "comic_id").withColumn("z", z).filter(F.abs("z") >= threshold).select("comic_id", "episode_no", "likes", "z")
