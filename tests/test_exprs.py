import pytest
from pyspark.sql import functions as F

from titlemart.functions import exprs as E
from titlemart.functions.pvalues import normal_two_sided, student_two_sided


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "value"),
    [("1.2M", 1200000), ("10,999", 10999), ("315.6K", 315600), ("UP 26.6K", 26600), ("3.1B", 3100000000), (None, 0), ("abc", 0), ("5 books", 5_000_000_000)],
)
def test_clean_metric(spark, text, value):
    assert one(spark, E.clean_metric("x"), text) == value


def test_strict_suffix(spark):
    assert one(spark, E.clean_metric("x", strict_suffix=True), "5 books") == 5
    assert one(spark, E.clean_metric("x", strict_suffix=True), "5 k reads") == 5000


@pytest.mark.parametrize(
    ("title", "key"),
    [("The X (Official) Season 2", "x"), ("판타지 로맨스!", "판타지 로맨스"), (None, ""), ("", ""), ("A Tale, of Two: Vol. 3", "tale of two"), ("[Uncensored] Moon {x}", "moon")],
)
def test_normalize_title(spark, title, key):
    assert one(spark, E.normalize_title("x"), title) == key


def test_text_rules(spark):
    assert one(spark, E.normalize_author("x"), "Kim, Lee / Park") == "kim"
    assert one(spark, E.collapse_ws("x"), " a  \t b ") == "a b" and one(spark, E.collapse_ws("x"), "  ") is None
    assert one(spark, E.title_case("x"), "sci-fi o'neil") == "Sci-Fi O'Neil"
    assert one(spark, E.title_of_slug("x"), "my-great_story") == "My Great Story"
    assert one(spark, E.strip_html("x"), "&lt;b&gt;Hi&lt;/b&gt; &amp; <i>you</i>") == "Hi & you"
    assert one(spark, E.clean_author("x"), "[[Kim|Kim A]] {{note}} (art) <br>") == "Kim A"
    assert one(spark, E.safe_id("x"), "a:1/é") == "a_1_é"
    assert one(spark, E.clean_detail_title("x"), "Read My Story | Tapas Web Comics") == "My Story"
    assert one(spark, E.platform_name("x"), "tapas_io") == "Tapas" and one(spark, E.platform_name("x"), "q") == "q"


def test_title_candidates(spark):
    for text, good in (("My Title", True), ("28.7K", False), ("UP", False), ("x", False), ("3hr", False), ("Chapter of 1.2M", False), (None, False)):
        assert one(spark, E.reads_as_title("x"), text) is good
    assert one(spark, E.names_no_title("x"), "Some Publisher Profile") and not one(spark, E.names_no_title("x"), "Moon")


@pytest.mark.parametrize("text", ["Jan 5, 2024", "January 5, 2024", "2024-01-05", "Jan. 5, 2024"])
def test_dates(spark, text):
    assert str(one(spark, E.parse_upload_date("x"), text)) == "2024-01-05"


def test_bad_date(spark):
    assert one(spark, E.parse_upload_date("x"), "yesterday") is None


def test_jaccard(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("a", "a"), ("", "a")], "a string, b string")
    assert [r.y for r in df.select(E.token_jaccard("a", "b").alias("y")).collect()] == [0.5, 1.0, 0.0]


def test_genres(spark):
    df = spark.createDataFrame([("LitRPG",), ("  로판 ",), ("odd-one out",), (None,), ("",)], "genre string")
    got = [(r.genre_en, r.genre_parent) for r in E.with_genre(df).collect()]
    assert sorted(got, key=str) == sorted([("LitRPG", "Fantasy"), ("Romance Fantasy", "Romance"), ("Odd-One Out", "Other"), (None, None), (None, None)], key=str)


def test_primary_metric(spark):
    df = spark.createDataFrame([(5, 1, 1), (0, 7, 1), (0, None, 3), (None, None, 0)], "v long, s long, l long")
    metric, name = E.pick_primary("v", "s", "l")
    assert [tuple(r) for r in df.select(metric, name).collect()] == [(5, "views"), (7, "subscribers"), (3, "likes"), (0, "unknown")]


def test_bands(spark):
    assert [one(spark, E.hhi_band("x"), v, "double") for v in (2501.0, 1501.0, 1500.0)] == ["Concentrated", "Moderate", "Competitive"]
    assert [one(spark, E.volatility_band("x"), v, "double") for v in (0.6, 0.3, 0.2)] == ["High", "Medium", "Low"]
    assert one(spark, E.engagement_ratio(F.lit(3), F.lit(0)), "x") == 0 and one(spark, E.engagement_ratio_of_table(F.lit(3), F.lit(0)), "x") == 3


def test_p_values(spark):
    import math

    def told(rows, schema, c):
        return [r.p for r in spark.createDataFrame(rows, schema).coalesce(1).select(c.alias("p")).collect()]

    zs = [0.0, -1.959963984540054, 1e-9, 0.3, 2.0, -3.0, 4.2, 4.25, 6.0, 9.5, 30.0, math.inf]
    got = told([(z,) for z in zs], "z double", normal_two_sided("z"))
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=1e-14) and got[:2] == pytest.approx([1, 0.05])
    assert got[6:10] == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs[6:10]], rel=1e-12)
    ts = [0.0, 0.5, -1.0, 3.0, 40.0, math.inf]
    student = lambda t, df: told([(t, df)], "t double, df long", student_two_sided("t", "df"))[0]
    for t in ts:
        assert student(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)
        assert student(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t) if math.isfinite(t) else 0, abs=1e-12)

    def density(x, df):
        return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)

    for t, df in ((0.7, 3), (2.1, 4), (1.5, 9), (3.3, 28), (2.0, 401), (0.1, 1000)):
        steps = 20_000
        area = sum((4 if k % 2 else 2) * density(t * k / steps, df) for k in range(1, steps)) + density(0, df) + density(t, df)
        assert student(t, df) == pytest.approx(1 - 2 * area * t / steps / 3, abs=1e-9)


def test_titles_of_any_script_are_normalized(spark):
    """Every benchmark row against a plain version."""
    import re

    from titlemart.plans.registry import QUERIES

    def plain(t):
        t = (t or "").lower()
        for pattern in (
            r"\(.*?\)|\[.*?\]|\{.*?\}", r"\b(season|vol|volume|part|book|chapter|ch|s)\s*\.?\s*\d+\b", r"[^\w\s]",
            r"\b(the|a|an|official|uncensored|complete|completed|webtoon|comic|novel)\b", r"\s+",
        ):
            t = re.sub(pattern, " ", t)
        return t.strip()

    d = "/root/testdata/sf0.01"
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    assert any(t and not t.isascii() for t in texts.values())
    assert {r.item_id: r.title_key for r in QUERIES["b4_normalize_title"](spark, d).collect()} == {k: plain(t) for k, t in texts.items()}
