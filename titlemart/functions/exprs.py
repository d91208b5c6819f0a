"""Scalar rules as column expressions: all built-in, all inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import GENRES, PLATFORM_NAMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A number with its suffix; what an author field drops, and a page's heading.
NUMBER = r"(-?\d[\d,]*\.?\d*)\s*([BMK]?)"
NUMBER_STRICT = r"(-?\d[\d,]*\.?\d*)\s*((?:[BMK]\b)?)"
WIKI_LINK = r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]"
WIKI_REST = (r"\{\{[^}]*\}\}", "<[^>]+>", r"\([^)]*\)")
READ_PREFIX, TITLE_BAR = r"(?i)^\s*read\s+", r"\s+\|\s+"


def clean_metric(text: Column | str, *, strict_suffix: bool = False) -> Column:
    """``'UP 26.6K'`` -> 26600: first number with an optional B, M or K; none -> 0.

    By default the suffix is any letter that follows, as in ``'5 books'`` -> 5 billion; ``strict_suffix`` asks for a word's end.
    """
    up = F.upper(F.trim(_col(text)))
    pattern = NUMBER_STRICT if strict_suffix else NUMBER
    number = F.regexp_replace(F.regexp_extract(up, pattern, 1), ",", "").try_cast("double")
    suffix = F.regexp_extract(up, pattern, 2)
    factor = F.when(suffix == "B", 1e9).when(suffix == "M", 1e6).when(suffix == "K", 1e3).otherwise(1.0)
    return F.coalesce((number * factor).try_cast("bigint"), F.lit(0).cast("bigint"))


def collapse_ws(c: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")), F.lit(""))


def domain_check(c: Column | str, allowed: Iterable[str], default: str) -> Column:
    c = _col(c)
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


#: What a title key drops.
BRACKETED = r"\(.*?\)|\[.*?\]|\{.*?\}"
VOLUME = r"\b(season|vol|volume|part|book|chapter|ch|s)\s*\.?\s*\d+\b"
STOP_WORDS = r"\b(the|a|an|official|uncensored|complete|completed|webtoon|comic|novel)\b"
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def normalize_title(c: Column | str) -> Column:
    """The key under which titles of several platforms meet; null -> ''."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    for pattern in (BRACKETED, "(?U)" + VOLUME, "(?U)" + NOT_WORD, "(?U)" + STOP_WORDS, r"(?U)\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def normalize_author(c: Column | str) -> Column:
    t = F.substring_index(F.substring_index(F.lower(F.coalesce(_col(c), F.lit(""))), "/", 1), ",", 1)
    return F.trim(F.regexp_replace(t, "(?U)" + NOT_WORD, ""))


def title_case(c: Column | str) -> Column:
    """A capital after every character that is no letter; one letter for one, so a sharp s has its own capital."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def cased(r: Column) -> Column:
        first = F.translate(F.substring(r, 1, 1), "ß", "ẞ")
        return F.concat(F.when(F.char_length(F.upper(first)) == 1, F.upper(first)).otherwise(first), F.lower(r.substr(F.lit(2), F.char_length(r))))

    return F.array_join(F.transform(runs, cased), "")


def genre_key(c: Column | str) -> Column:
    return F.lower(collapse_ws(c))


def with_genre(df: DataFrame, column: str = "genre") -> DataFrame:
    """``genre_en`` and ``genre_parent``: by the table of known labels, else the label in title case under 'Other'."""
    spark = df.sparkSession
    known = spark.createDataFrame([(k, *v) for k, v in GENRES.items()], "_key string, _en string, _parent string")
    keyed = df.withColumn("_key", genre_key(column)).join(F.broadcast(known), "_key", "left")
    return keyed.withColumns({
        "genre_en": F.when(F.col("_key").isNotNull(), F.coalesce("_en", title_case(collapse_ws(column)))),
        "genre_parent": F.when(F.col("_key").isNotNull(), F.coalesce("_parent", F.lit("Other"))),
    }).drop("_key", "_en", "_parent")


def unescape_html(c: Column | str) -> Column:
    c = _col(c)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def norm_match_text(c: Column | str) -> Column:
    t = F.lower(unescape_html(F.coalesce(_col(c), F.lit(""))))
    return F.trim(F.regexp_replace(t, r"[^0-9a-z가-힣぀-ヿ一-鿿]+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    """1 for equal texts, else shared words over all words; an empty side -> 0."""
    a, b = _col(a), _col(b)
    ta, tb = tokens(a), tokens(b)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb)))
    )


def script_language(c: Column | str) -> Column:
    """The language that a title's script tells of: Korean, Japanese, Chinese, else English."""
    c = _col(c)
    return F.when(c.rlike("[가-힣]"), "ko").when(c.rlike("[぀-ヿ]"), "ja").when(c.rlike("[一-鿿]"), "zh").otherwise("en")


def best_match(a: Column, candidates: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(candidates, lambda b: token_jaccard(a, b))), F.lit(0.0))


def strip_html(c: Column | str) -> Column:
    return collapse_ws(F.regexp_replace(unescape_html(c), "<[^>]+>", " "))


def clean_author(c: Column | str) -> Column:
    """An author field of a wiki infobox without links, templates, tags and remarks in brackets."""
    t = F.regexp_replace(_col(c), WIKI_LINK, "$1")
    for pattern in WIKI_REST:
        t = F.regexp_replace(t, pattern, " ")
    return collapse_ws(t)


def author_tokens(c: Column | str) -> Column:
    return F.filter(tokens(norm_match_text(c)), lambda x: F.char_length(x) > 1)


def parse_upload_date(c: Column | str) -> Column:
    """The first of the known spellings that parses."""
    c = F.trim(_col(c))
    forms = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "MMM. d, yyyy")
    return F.coalesce(*(F.try_to_date(c, f) for f in forms))


def safe_id(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", "_")


def engagement_ratio(likes: Column | str, views: Column | str) -> Column:
    """Likes per view; 0 without views."""
    likes, views = _col(likes), _col(views)
    return F.when(views > 0, likes / views).otherwise(0.0)


def engagement_ratio_of_table(likes: Column | str, views: Column | str) -> Column:
    """The tables' form: without views, likes over 1."""
    likes, views = _col(likes), _col(views)
    return likes / F.when(views > 0, views).otherwise(1)


def velocity(current: Column | str, previous: Column | str) -> Column:
    current, previous = _col(current), _col(previous)
    return F.when(previous > 0, (current - previous) / previous).otherwise(0.0)


def acceleration(v_now: Column | str, v_before: Column | str) -> Column:
    return _col(v_now) - _col(v_before)


def hhi_band(hhi: Column | str) -> Column:
    hhi = _col(hhi)
    return F.when(hhi > 2500, "Concentrated").when(hhi > 1500, "Moderate").otherwise("Competitive")


def volatility_band(cv: Column | str) -> Column:
    cv = _col(cv)
    return F.when(cv > 0.5, "High").when(cv > 0.2, "Medium").otherwise("Low")


def pick_primary(views: Column | str, subscribers: Column | str, likes: Column | str) -> tuple[Column, Column]:
    """(metric, its name): the first of views, subscribers, likes that is not zero."""
    named = [(_col(c), n) for c, n in ((views, "views"), (subscribers, "subscribers"), (likes, "likes"))]
    metric, name = F.lit(0).cast("bigint"), F.lit("unknown")
    for c, n in reversed(named):
        there = F.coalesce(c, F.lit(0)) != 0
        metric, name = F.when(there, c.cast("bigint")).otherwise(metric), F.when(there, n).otherwise(name)
    return metric, name


def platform_name(code: Column | str) -> Column:
    code = _col(code)
    names = F.create_map(*(F.lit(x) for pair in PLATFORM_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


#: Text of a page's chrome, and tails that sites add to titles.
CHROME = (
    r"(?i)^(up|new|hot|free with gold|latest\s?24hours|read more|detail|more|"
    r"\d+(hr|h|d|m)|wed|mon|tue|thu|fri|sat|sun|completed|ongoing)$"
)
NUMERIC = r"(?i)^\s*(up\s*)?[\d.,]+\s*[kmb]?\s*$"
METRIC_TOKEN = r"(?i)\b\d[\d.,]*\s*[KMB]\b"
TIME_TOKEN = r"(?i)\b\d+\s?(hr|h|min|d)\b"
LEAD_CHROME = r"(?i)^(free with gold|up|new|latest\s?24hours)\s+"
SITE_SUFFIX = (
    r"(?i)\s*(\||::|[-–—])\s*(tapas.*|line\s*webtoon.*|webtoon.*|wattpad.*|manga\s*plus.*|"
    r"globalcomix.*|webcomics.*|ridibooks.*)$"
)
JUNK_TITLES = ("comics", "webcomics", "releases", "read more", "home", "profile", "browse")


def clean_detail_title(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(_col(c), READ_PREFIX, ""), SITE_SUFFIX, "")
    return collapse_ws(F.element_at(F.split(t, TITLE_BAR, -1), 1))


def names_no_title(c: Column | str) -> Column:
    t = F.lower(F.trim(_col(c)))
    return t.isin(*JUNK_TITLES) | t.contains("publisher profile") | t.endswith(" profile")


def reads_as_title(c: Column | str) -> Column:
    t = F.trim(_col(c))
    reject = F.lit(False)
    for pattern in (NUMERIC, CHROME, METRIC_TOKEN, TIME_TOKEN):
        reject = reject | t.rlike(pattern)
    return F.coalesce((F.char_length(t) >= 2) & ~reject, F.lit(False))


def title_of_slug(c: Column | str) -> Column:
    return title_case(F.trim(F.regexp_replace(_col(c), "[-_]+", " ")))
