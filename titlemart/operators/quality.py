"""The data-quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.tables import THRESHOLDS
from ..schema import order_of
from .keys import latest_row

#: Fixed values.  As patterns they are case-sensitive, but for the badge; ``ignore_case`` makes all of them not.
METRIC = r"\b\d[\d.,]*\s*[KMB]\b|\b(?:views?|likes?|reads?|subscribers?|eps?|episodes?)\b"
EPISODE = r"화|\bEps\b|episode|^\s*\d"
BADGE = r"(?i)^(?:up|new|hot|event)\s"


def _field_checks(rows: DataFrame, flag: str = "") -> DataFrame:
    return rows.withColumns({
        "title_eq_author": F.coalesce(F.col("author") == F.col("title"), F.lit(False)),
        "author_has_metric": F.coalesce(F.col("author").rlike(flag + METRIC), F.lit(False)),
        "genre_is_episode_token": F.coalesce(F.col("genre").rlike(flag + EPISODE), F.lit(False)),
        "title_leading_badge": F.coalesce(F.col("title").rlike(BADGE), F.lit(False)),
    })


def contamination(obs: DataFrame, *, ignore_case: bool = False) -> DataFrame:
    """The latest row of each title with one flag for each field check."""
    now = latest_row(obs.select("comic_id", "source", "title", "author", "genre", "scraped_at", "source_file"), ["comic_id"], order_of())
    return _field_checks(now, "(?i)" if ignore_case else "")


def conflicts(obs: DataFrame, column: str) -> DataFrame:
    """Titles with more than one value of a column over all rows, and the values."""
    values = obs.filter(F.col(column).isNotNull()).groupBy("comic_id").agg(F.collect_set(column).alias("_v"))
    return values.filter(F.size("_v") > 1).select("comic_id", F.size("_v").alias("n_values"), F.array_join(F.array_sort("_v"), " | ").alias("values"))


#: An author on so many titles of one platform is likely none.
MISLATCHED = 8


def mislatched_authors(obs: DataFrame, least: int = MISLATCHED) -> DataFrame:
    """Authors on so many titles of one platform that they are likely no authors."""
    now = latest_row(obs.select("comic_id", "source", "title", "author", "scraped_at", "source_file"), ["comic_id"], order_of())
    return now.filter("author IS NOT NULL").groupBy("source", "author").agg(F.countDistinct("title").alias("n_titles")).filter(F.col("n_titles") >= least)


FLAGS = (
    "title_eq_author", "author_has_metric", "genre_is_episode_token", "title_leading_badge",
    "within_title_author_conflict", "within_title_genre_conflict",
)


def checked_titles(obs: DataFrame) -> DataFrame:
    """One row a title: its latest row, the flags of all checks of titles, and the authors and genres it ever had where they are in conflict."""
    values = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    rows = obs.groupBy("comic_id").agg(F.max_by(F.struct("source", "title", "author", "genre"), order_of()).alias("now"), values("author"), values("genre"))
    rows = rows.select("comic_id", "now.*", "authors", "genres")
    return _field_checks(rows).withColumns({"within_title_author_conflict": F.size("authors") > 1, "within_title_genre_conflict": F.size("genres") > 1})


def _by_author(titles: DataFrame) -> DataFrame:
    return titles.groupBy("source", "author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("n_titles"), *(F.count_if(f).alias(f) for f in FLAGS))


def scorecard(obs: DataFrame, *, n_examples: int = 8) -> DataFrame:
    """One row a check: severity, count, percent of titles, threshold, failed, examples.

    One pass over observations: titles are cut, summed by platform and author, then over all; the few examples of each check are chosen among the
    same titles.
    """
    titles = cut(checked_titles(obs))
    latched = F.count_if(F.col("author").isNotNull() & (F.col("n_titles") >= MISLATCHED))
    one = _by_author(titles).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), latched.alias("author_mislatched"),
        *(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FLAGS),
    )
    checks = F.array(
        *(F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.col(c).alias("count"), F.lit(t).cast("long").alias("threshold"))
          for c, (s, t) in THRESHOLDS.items())
    )
    row = F.struct("place", "source", "title", "author", "genre")
    shown = examples(titles, k=n_examples).groupBy("check").agg(F.array_sort(F.collect_list(row)).alias("examples"))
    return one.select("n", F.explode(checks).alias("c")).select("n", "c.*").join(F.broadcast(shown), "check", "left").select(
        "check", "severity", "count", F.round(F.col("count") * 100 / F.greatest(F.col("n"), F.lit(1)), 3).alias("pct"),
        "threshold", (F.col("count") > F.col("threshold")).alias("failed"),
        F.coalesce(F.transform("examples", lambda x: F.struct(*(x[c].alias(c) for c in ("source", "title", "author", "genre")))), F.array()).alias("examples"),
    )


def examples(titles: DataFrame, k: int = 8) -> DataFrame:
    """(check, place, source, title, author, genre): of each check that fails for some of ``checked_titles`` the first ``k``.

    Titles come by their id, and show all authors or genres that are in conflict; mislatched authors by their number of titles, which stands under genre.
    """
    joined = {"author": "within_title_author_conflict", "genre": "within_title_genre_conflict"}
    shown = F.array(*(
        F.when(F.col(f), F.struct(
            F.lit(f).alias("check"), "source", "title",
            *((F.array_join(f"{c}s", " | ") if joined[c] == f else F.col(c)).alias(c) for c in joined),
        ))
        for f in FLAGS
    ))
    some = titles.select("comic_id", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("x")).select(F.lit(0).cast("long").alias("least"), "comic_id", "x.*")
    latched = _by_author(titles).filter(F.col("author").isNotNull() & (F.col("n_titles") >= MISLATCHED)).select(
        (-F.col("n_titles")).alias("least"), F.concat_ws(":", "source", "author").alias("comic_id"), F.lit("author_mislatched").alias("check"), "source",
        F.lit(None).cast("string").alias("title"), "author", F.col("n_titles").cast("string").alias("genre"),
    )
    w = W.partitionBy("check").orderBy("least", "comic_id")
    return some.unionByName(latched).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("check", "place", "source", "title", "author", "genre")


def coverage_by_source(obs: DataFrame) -> DataFrame:
    return coverage_of(latest_row(obs.drop("tags"), ["comic_id"], order_of()))


def coverage_of(now: DataFrame) -> DataFrame:
    """By platform: titles, and percent of them with each attribute, of latest observations, one a title."""
    pct = lambda c: F.round(F.count(c) / F.count(F.lit(1)) * 100, 1).alias(f"{c}_pct")
    told = [c for c in ("author", "genre", "publisher", "synopsis") if c in now.columns]
    return now.groupBy("source").agg(F.count(F.lit(1)).alias("titles"), *(pct(c) for c in told))


def strict_gate(card: DataFrame) -> DataFrame:
    """The failed checks that stop a run: critical and high ones."""
    return card.filter(F.col("failed") & F.col("severity").isin("CRITICAL", "HIGH"))
