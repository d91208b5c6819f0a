"""Titles and authors across platforms, matching with outside catalogs, and what to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import normalize_author, normalize_title, norm_match_text, tokens
from ..functions.lineage import cut


def _entity_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 12))


def with_title_key(df: DataFrame) -> DataFrame:
    """Titles whose key has under two characters stay by themselves."""
    key = normalize_title("title")
    return df.withColumn("ip_key", F.when(F.char_length(key) < 2, F.col("comic_id")).otherwise(key))


def resolve_ip(scored: DataFrame) -> DataFrame:
    """One row for each title key: all aggregates combine before the shuffle, so a generic title is no hot group."""
    by = with_title_key(scored).groupBy("ip_key").agg(
        F.max_by("title", F.struct(F.char_length("title"), "title")).alias("title"),
        F.countDistinct("source").alias("n_platforms"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("platforms"),
        F.count(F.lit(1)).alias("variants"), F.sum("views").alias("views"), F.coalesce(F.sum("subscribers"), F.lit(0)).alias("subscribers"),
        F.sum("likes").alias("likes"), F.max("composite_score").alias("best_score"),
        F.min_by("genre", F.when(F.col("genre").isNotNull(), F.col("comic_id"))).alias("genre"),
        F.min_by("author", F.when(F.col("author").isNotNull(), F.col("comic_id"))).alias("author"),
    )
    return by.withColumn("ip_id", _entity_id("ip:", F.col("ip_key")))


def resolve_authors(scored: DataFrame) -> DataFrame:
    keyed = scored.withColumn("author_key", normalize_author("author")).filter(F.char_length("author_key") >= 2)
    return keyed.groupBy("author_key").agg(
        F.min("author").alias("author"), F.count(F.lit(1)).alias("titles"), F.countDistinct("source").alias("platforms"),
        F.sum("views").alias("views"), F.max("composite_score").alias("best_score"), F.avg("composite_score").alias("avg_score"),
    ).withColumn("author_id", _entity_id("au:", F.col("author_key")))


def cross_platform_count(scored: DataFrame, ip: DataFrame) -> DataFrame:
    return with_title_key(scored).join(ip.select("ip_key", "n_platforms"), "ip_key").select("comic_id", "n_platforms")


def top_ip(ip: DataFrame, limit: int = 25) -> DataFrame:
    return ip.orderBy(F.desc_nulls_last("best_score"), "ip_key").limit(limit).select("ip_key", "title", "platforms", "n_platforms", "views", "best_score")


#: Up to so many words of the left side, and texts of it, are sent to all tasks; more are joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def _few(df: DataFrame, most: int = BROADCAST_WORDS) -> DataFrame:
    """``df`` cut, and marked for broadcast if it is counted to be small."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= most else done


def _prefixes(texts: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """(id, n, place, word): of each of (id, w) the words that two sets so similar must share one of, in the order that ``df`` (word, df) gives.

    Words that ``df`` lacks meet nothing.  They come first in the order, so a text with too many of them has no prefix left.
    """
    words = texts.select("id", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word")
    held = words.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("held"))
    lacking = F.col("n") - F.size("held")
    length = F.col("n") - F.ceil(F.col("n") * threshold) + 1 - lacking
    prefix = held.withColumns({"lacking": lacking, "prefix": F.slice("held", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))})
    return prefix.select("id", "n", "lacking", F.posexplode("prefix").alias("k", "x")).select("id", "n", (F.col("lacking") + F.col("k") + 1).alias("place"), F.col("x.word").alias("word"))


def fuzzy_match(left: DataFrame, right: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    """Of each l_id, the best r_id by word Jaccard of their texts at or over the threshold: (l_id, r_id, similarity).

    An id may have several texts (alternative titles), one a row; its best pair counts, and of equal ones the smallest r_id.  Texts are compared once for
    each distinct normalised text.  Of the right side only words that the left side has are ever dealt, and only texts of a size that may match.  Two
    sets that similar share a word among each one's first ``n - ceil(threshold * n) + 1`` words in any common order; words are ordered rarest first,
    so the join meets on rare words.  Where a pair meets, sizes and places must leave room for enough words in common.
    """

    def texts(df: DataFrame, key: str) -> DataFrame:
        """(id, <key>, t, w) of distinct texts, with the smallest id that has it."""
        one = df.select(key, norm_match_text("text").alias("t")).filter("t <> ''").groupBy("t").agg(F.min(key).alias(key))
        return cut(one.select(key, "t", tokens(F.col("t")).alias("w"), F.monotonically_increasing_id().alias("id")))

    a, b = texts(left, "l_id"), texts(right, "r_id")
    least, most = a.agg(F.min(F.size("w")), F.max(F.size("w"))).first()
    own = _few(a.select(F.explode("w").alias("word")).distinct())
    sized = b.filter(F.size("w").between((least or 0) * threshold, (most or 0) / threshold))
    counts = sized.select(F.explode("w").alias("word")).join(own, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = _few(own.join(counts, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df")))
    pa = _few(_prefixes(a, df, threshold).select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("place").alias("ka"), "word"))
    pb = _prefixes(sized, df, threshold).select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("place").alias("kb"), "word")
    room = 1 + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    met = pb.join(pa, "word").filter(
        (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
        & (room >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9))
    ).select("ia", "ib").distinct()
    wa = a.select(F.col("id").alias("ia"), F.col("t").alias("ta"), F.col("w").alias("wa"))
    wb = b.select(F.col("id").alias("ib"), "r_id", F.col("t").alias("tb"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    similarity = F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(both / (F.size("wa") + F.size("wb") - both))
    pairs = met.join(wa, "ia").join(wb, "ib").select("ta", "r_id", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    best = lambda r: F.min_by(r, F.struct(-F.col("similarity"), r))
    of_text = pairs.groupBy("ta").agg(best("r_id").alias("r_id"), F.max("similarity").alias("similarity"))
    each = left.select("l_id", norm_match_text("text").alias("t")).filter("t <> ''").distinct()
    return each.join(of_text, each.t == of_text.ta).groupBy("l_id").agg(best("r_id").alias("r_id"), F.max("similarity").alias("similarity"))


def author_confidence(official: Column, external: list[Column], corroborating: list[Column] | None = None) -> tuple[Column, Column]:
    """(label, chosen author): verified where any two sources share a word, conflict where two say different things.

    What ``corroborating`` sources say can confirm or contradict, but is never chosen, and alone counts as nothing.
    """
    from ..functions.exprs import author_tokens

    trusted, more = [official, *external], corroborating or []
    sets = [author_tokens(F.coalesce(s, F.lit(""))) for s in (*trusted, *more)]
    agree = F.lit(False)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            agree = agree | F.coalesce(F.arrays_overlap(sets[i], sets[j]), F.lit(False))
    count = lambda some: sum((F.when(F.size(s) > 0, 1).otherwise(0) for s in some), F.lit(0))
    said, n = count(sets[: len(trusted)]), count(sets)
    label = F.when(said == 0, "unverified").when(agree, "verified").when(n == 1, "single_source").otherwise("conflict")
    return label, F.coalesce(*trusted)


#: Fixed value: words by which an article tells that it is about a work of this kind.
MEDIA_WORDS = r"(?i)webtoon|manhwa|manhua|manga|comic|graphic novel|light novel|web novel|novel|serial|manwha|webcomic|series"


def first_staff(staff: Column, limit: int = 3) -> Column:
    """Distinct names of the first people with a telling role, joined; null if there are none."""
    told = F.filter(staff, lambda s: F.lower(s["role"]).rlike("story|art|original|author|creator") & (F.coalesce(s["name"], F.lit("")) != ""))
    return F.nullif(F.array_join(F.slice(F.array_distinct(F.transform(told, lambda s: s["name"])), 1, limit), ", "), F.lit(""))


def top_tags(tags: Column, limit: int = 8) -> Column:
    """Names of the highest tags that spoil nothing."""
    plain = F.filter(tags, lambda t: ~F.coalesce(t["is_spoiler"], F.lit(False)))
    ordered = F.array_sort(F.transform(plain, lambda t: F.struct((-t["rank"]).alias("r"), t["name"].alias("name"))))
    return F.slice(F.transform(ordered, lambda t: t["name"]), 1, limit)


def stale(titles: DataFrame, cache: DataFrame, *, now: Column, max_age_days: int = 30) -> DataFrame:
    """Titles without a fresh cache row."""
    fresh = cache.filter(F.datediff(now, F.col("checked_at")) <= max_age_days)
    return titles.join(fresh, "comic_id", "left_anti")


def gap_fill(titles: DataFrame, checked: DataFrame, columns: tuple[str, ...] = ("author", "genre", "synopsis")) -> DataFrame:
    """Official values stay; nulls are filled from verified or single-source ones (``<column>`` and ``<column>_status``)."""
    renamed = checked.select("comic_id", *(F.col(c).alias(f"_{c}") for c in columns), *(F.col(f"{c}_status").alias(f"_{c}_s") for c in columns))
    joined = titles.join(renamed, "comic_id", "left")
    fills = {c: F.coalesce(c, F.when(F.col(f"_{c}_s").isin("verified", "single_source"), F.col(f"_{c}"))) for c in columns}
    return joined.withColumns(fills).select(*titles.columns)


def restricted_flag(titles: DataFrame, restricted: DataFrame) -> DataFrame:
    listed = restricted.select("comic_id").distinct().withColumn("_listed", F.lit(True))
    return titles.join(listed, "comic_id", "left").withColumn("restricted", F.col("_listed").isNotNull()).drop("_listed")


def crawl_targets(obs: DataFrame, *, source: str | None = None, limit: int = 300, only_missing: bool = True) -> DataFrame:
    """Titles to visit: with an address and without views and subscribers, each at its best rank."""
    rows = obs.filter(F.col("url").isNotNull())
    if source:
        rows = rows.filter(F.col("source") == source)
    if only_missing:
        rows = rows.filter((F.coalesce("views", F.lit(0)) == 0) & (F.coalesce("subscribers", F.lit(0)) == 0))
    # The best rank, then the latest time, nulls last in both, then the file.
    place = F.struct(F.col("rank").isNull(), "rank", F.col("scraped_at").isNull(), -F.unix_micros("scraped_at"), "source_file")
    best = rows.groupBy("comic_id").agg(F.min_by(F.struct("source", "url", "rank"), place).alias("_b")).select("comic_id", "_b.*")
    return best.orderBy(F.asc_nulls_last("rank"), "comic_id").limit(limit).select("comic_id", "source", "url", "rank")


def cover_targets(scored: DataFrame, have: DataFrame, limit: int = 500) -> DataFrame:
    left = scored.filter("cover_url IS NOT NULL").join(have, "comic_id", "left_anti")
    return left.orderBy(F.desc_nulls_last("composite_score"), "comic_id").limit(limit).select("comic_id", "cover_url", "composite_score")


def thin_snapshots(snapshots: DataFrame, *, limit: int, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Of (keys, ts, digest): each digest's first time, then every k-th in time, k = max(1, n // limit)."""
    once = snapshots.groupBy(*keys, "digest").agg(F.min("ts").alias("ts"))
    whole = W.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / limit))
    n = F.row_number().over(whole.orderBy("ts", "digest"))
    return once.withColumns({"_k": k, "_n": n}).filter((F.col("_n") - 1) % F.col("_k") == 0).drop("_k", "_n")


def verify_titles(
    titles: DataFrame, catalog: DataFrame, *, threshold: float = 0.9, second: DataFrame | None = None, second_threshold: float = 0.6
) -> DataFrame:
    """Each title beside its best record of an outside catalog (ext_id, title, author, genres, synopsis), with labels.

    A record may have more titles in ``alt_titles``; the best of all counts.  ``second`` is another source of (ext_id, title, author, synopsis), an
    encyclopedia, whose titles need to be less alike; its articles count only where their synopsis has a word for such a work, and its authors only confirm or contradict.  Author: see ``author_confidence``.  Genre: verified if it is among the record's genres, by its key,
    unverified without any, else conflict.  Synopsis: in how many places there is one.
    """
    own = titles.select(F.col("comic_id").alias("l_id"), F.col("title").alias("text"))

    def matched(source: DataFrame, least: float, id_: str) -> DataFrame:
        said = F.array("title")
        if "alt_titles" in source.columns:
            said = F.concat(said, F.coalesce("alt_titles", F.array().cast("array<string>")))
        match = fuzzy_match(own, source.select(F.col("ext_id").alias("r_id"), F.explode(said).alias("text")), threshold=least)
        return match.withColumnsRenamed({"l_id": "comic_id", "r_id": id_})

    outside = catalog.select("ext_id", F.col("author").alias("ext_author"), "genres", F.col("synopsis").alias("ext_synopsis"))
    rows = titles.join(matched(catalog, threshold, "ext_id"), "comic_id", "left").join(outside, "ext_id", "left")
    corroborating, synopses = [], ["ext_synopsis"]
    more: list[str] = []
    if second is not None:
        second = second.filter(F.coalesce("synopsis", F.lit("")).rlike(MEDIA_WORDS))
        other = second.select(F.col("ext_id").alias("second_id"), F.col("author").alias("second_author"), F.col("synopsis").alias("second_synopsis"))
        found = matched(second, second_threshold, "second_id").withColumnRenamed("similarity", "second_similarity")
        rows = rows.join(found, "comic_id", "left").join(other, "second_id", "left")
        corroborating, synopses, more = [F.col("second_author")], [*synopses, "second_synopsis"], ["second_id", "second_similarity"]
    label, chosen = author_confidence(F.col("author"), [F.col("ext_author")], corroborating)
    held = F.array_contains(F.transform("genres", lambda g: F.lower(g)), F.lower("genre"))
    genre = F.when(held, "verified").when(F.coalesce(F.size("genres"), F.lit(0)) == 0, "unverified").otherwise("conflict")
    told = [F.col(c) for c in synopses] + ([F.col("synopsis")] if "synopsis" in titles.columns else [])
    return rows.select(
        "comic_id", "ext_id", "similarity", *more, label.alias("author_status"), chosen.alias("author"), genre.alias("genre_status"),
        sum((F.when(c.isNotNull(), 1).otherwise(0) for c in told), F.lit(0)).alias("synopsis_sources"),
    )
