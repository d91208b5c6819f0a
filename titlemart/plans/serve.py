"""Serving queries and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import engagement_ratio_of_table, platform_name, script_language
from ..operators.daily import hhi, report_pct_change
from ..operators.episodes import per_title, units_of
from ..operators.keys import dense_ranks, first_row
from ..operators.score import adaptation_readiness, ratios
from ..schema import order_of

_SORTS = {"score": "composite_score", "reach": "reach_raw", "revenue": "est_usd"}


def titles_query(
    scored: DataFrame, *, source: str | None = None, genre: str | None = None, min_score: float | None = None, sort: str = "score", limit: int = 50, offset: int = 0
) -> DataFrame:
    rows = scored
    if min_score is not None:
        rows = rows.filter((F.col("composite_score") >= min_score) | F.col("composite_score").isNull())
    if source:
        rows = rows.filter(F.col("source") == source)
    if genre:
        rows = rows.filter(F.col("genre") == genre)
    return rows.orderBy(F.desc_nulls_last(_SORTS[sort]), "comic_id").offset(offset).limit(limit)


def title_profile(scored: DataFrame, comic_id: str, style: DataFrame | None = None) -> DataFrame:
    one = scored.filter(F.col("comic_id") == comic_id)
    return one if style is None else one.join(style, "comic_id", "left")


def movers(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The largest rises and falls by rank, of titles that were ranked more than once; scored titles know their first and last rank."""
    moved = scored.filter("n_rank_obs > 1").withColumn("delta", F.col("first_rank") - F.col("latest_rank"))
    up = moved.filter("delta > 0").orderBy(F.desc("delta"), "comic_id").limit(limit).withColumn("direction", F.lit("rising"))
    down = moved.filter("delta < 0").orderBy("delta", "comic_id").limit(limit).withColumn("direction", F.lit("falling"))
    return up.unionByName(down).select("direction", "comic_id", "title", "delta", "composite_score")


def search(scored: DataFrame, text: str, limit: int = 20) -> DataFrame:
    found = scored.filter(F.contains(F.lower("title"), F.lower(F.lit(text))))
    return found.orderBy(F.desc_nulls_last("composite_score"), "comic_id").limit(limit).select("comic_id", "title", "source", "composite_score")


def feed_page(scored: DataFrame, *, limit: int = 100, offset: int = 0) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("composite_score"), "comic_id").offset(offset).limit(limit)


def _last_day(gold: DataFrame) -> DataFrame:
    """Rows of the last day, each title's of most views."""
    last = gold.agg(F.max("date").alias("_last"))
    rows = gold.join(F.broadcast(last), gold.date == F.col("_last")).drop("_last")
    return first_row(rows, ["comic_id"], F.desc("views"), F.col("title"))


def daily_report(gold: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Of the last day: summary, most viewed, most gained, and genres."""
    rows = _last_day(gold).withColumn("change_pct", report_pct_change(F.col("views_gained"), F.col("views")))
    picked = ("comic_id", "title", "genre", "views", "views_gained", "change_pct")
    return {
        "summary": rows.agg(
            F.count(F.lit(1)).alias("titles"), F.sum("views").alias("views"), F.sum("likes").alias("likes"), F.sum("views_gained").alias("gained"),
            F.countDistinct("genre").alias("genres"),
        ),
        "top_views": rows.orderBy(F.desc("views"), "comic_id").limit(top).select(*picked),
        "top_gainers": rows.orderBy(F.desc("views_gained"), "comic_id").limit(top).select(*picked),
        "genres": rows.groupBy("genre").agg(
            F.count(F.lit(1)).alias("titles"), F.sum("views").alias("views"), hhi(F.col("views")).alias("hhi"),
            F.avg(engagement_ratio_of_table("likes", "views")).alias("engagement"),
        ),
    }


def visual_report(gold: DataFrame) -> dict[str, DataFrame]:
    """Top genres, daily series of the five largest, five-number summaries of eight."""
    genres = gold.groupBy("genre").agg(F.sum("views").alias("views"))
    top = lambda n: genres.orderBy(F.desc("views"), "genre").limit(n)
    series = gold.join(top(5).select("genre"), "genre", "left_semi").groupBy("genre", "date").agg(F.sum("views").alias("views"))
    five = F.percentile("views", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0))))
    box = gold.join(top(8).select("genre"), "genre", "left_semi").groupBy("genre").agg(five.alias("p"))
    return {
        "top_genres": top(10), "series": series,
        "summary": box.select("genre", *(F.col("p")[k].alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high")))),
    }


def title_documents(
    scored: DataFrame, obs: DataFrame, episodes: DataFrame | None = None, *, parts: dict[str, DataFrame] | None = None, tags: int = 14, top: int | None = None
) -> DataFrame:
    """One nested row a title: its rank series, its views series (of two days at least), its episodes, its first tags.

    ``parts`` are tables of one row a comic_id (content structure, cover style, verification), each a struct of its own in the document.
    """
    keep = scored if top is None else scored.orderBy(F.desc_nulls_last("composite_score"), "comic_id").limit(top)
    rows = obs.join(keep.select("comic_id"), "comic_id", "left_semi")
    days = rows.groupBy("comic_id", F.to_date("scraped_at").alias("date")).agg(F.min("rank").alias("rank"), F.max("views").alias("views"))
    pair = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("date", c))))
    series = days.groupBy("comic_id").agg(pair("rank").alias("ranks"), F.when(F.count(F.lit(1)) >= 2, pair("views")).alias("views_series"))
    first_tags = rows.groupBy("comic_id").agg(F.min_by("tags", F.when(F.size("tags") > 0, order_of())).alias("_t"))
    out = keep.join(series, "comic_id", "left").join(first_tags, "comic_id", "left")
    if episodes is not None:
        from ..operators.episodes import series_map

        out = out.join(series_map(episodes, None).withColumnRenamed("series", "episodes"), "comic_id", "left")
    for name, part in (parts or {}).items():
        fields = [c for c in part.columns if c != "comic_id"]
        out = out.join(part.select("comic_id", F.struct(*fields).alias(name)), "comic_id", "left")
    if "synopsis" in out.columns:
        out = out.withColumn("synopsis", F.substring("synopsis", 1, 600))
    return out.withColumn("tags", F.slice(F.filter("_t", lambda x: x != ""), 1, tags)).drop("_t")


def genre_tree(titles: DataFrame) -> DataFrame:
    """Counts by subgenre, nested under their parent."""
    sub = titles.filter("genre_en IS NOT NULL").groupBy("genre_parent", "genre_en").agg(F.count(F.lit(1)).alias("n"))
    return sub.groupBy("genre_parent").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("genre_en", "n"))).alias("subgenres")
    )


def titles_table(scored: DataFrame, cross: DataFrame, episodes: DataFrame) -> DataFrame:
    """The flat table that users query, 29 columns beside the id: identity, score and readiness, measures, ratios, structure, cadence.

    ``scored`` are titles with their history, so that observations are read once for all columns.
    """
    cadence = per_title(episodes).select("comic_id", F.col("n").alias("episodes"), F.col("per_week").alias("cadence_wk"))
    rows = units_of(ratios(adaptation_readiness(scored))).withColumn("status", F.col("status") if "status" in scored.columns else F.lit(None).cast("string"))
    return (
        rows.join(cross.select("comic_id", "n_platforms"), "comic_id").join(cadence, "comic_id", "left")
        .select(
            "comic_id", "title", platform_name("source").alias("platform"), F.col("content_type").alias("type"), "genre", "author",
            script_language("title").alias("language"), "status", "publisher", "composite_score", F.col("readiness").alias("adaptation"),
            "views", "subscribers", "likes", "comments", "rating", F.col("est_usd").alias("revenue_usd"), "best_rank", "latest_rank",
            F.col("n_obs").alias("observations"), "like_through", "subs_per_1k", "comments_per_1k", "growth_pct", F.col("n_platforms").alias("cross_platform"),
            "units", "unit_type", "episodes", "cadence_wk", F.year("first_seen").cast("string").alias("first_year"),
        )
    )


def windowed_leaderboard(days: DataFrame, value: str = "views", top: int = 10) -> DataFrame:
    """The most of a measure in each period back from the last day."""
    from .warehouse import period_aggregate

    periods = {"1D": 0, "1W": 6, "YTD": "year", "1Y": 364, "All": None}
    agg = period_aggregate(days.withColumn("views", F.col(value)), periods)
    w = W.partitionBy("period").orderBy(F.desc("max_views"), "comic_id")
    return agg.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).select("period", "nth", "comic_id", F.col("max_views").alias(value))


def top_performers(days: DataFrame, *, metric: str = "views", back: int | None = 30, top: int = 15) -> DataFrame:
    """Daily ranks, by a measure, of the titles of most of it within a period."""
    rows = days
    if back is not None:
        last = days.agg(F.max("date").alias("_last"))
        rows = days.join(F.broadcast(last)).filter(F.col("date") > F.date_sub("_last", back)).drop("_last")
    best = rows.groupBy("comic_id").agg(F.sum(metric).alias("_m")).orderBy(F.desc("_m"), "comic_id").limit(top)
    ranked = dense_ranks(rows, "date", metric, "day_rank", "comic_id")
    return ranked.join(best, "comic_id", "left_semi").select("comic_id", "date", metric, "day_rank")
