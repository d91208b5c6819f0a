import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from titlemart.operators import style
from titlemart.plans import warehouse
from titlemart.schema import SILVER, validated
from titlemart.sources import bronze, files, markup
from titlemart.streaming import increments

LISTING = """<html><title>List</title><body><ul>
<li><a href="/story/11-moon"><img data-src="https://c/1.jpg" alt="Moon Song by Kim"></a><a href="/story/11">Moon</a><span>1.2M</span><span>4.6</span></li>
<li><a href="/story/22" title="Second Title">28K</a><p>300 reads</p></li>
<li><a href="/about">About</a></li><li><a href="/story/33">UP</a></li></ul></body></html>"""
DETAIL = """<html><head><title>x</title><meta property="og:title" content="Read Sun &amp; Sea | Tapas"><meta content="https://c/9.png" property="og:image">
<link rel="canonical" href="https://tapas.io/series/77"></head><body><h1>no</h1><b>1.5M views</b> <i>2,000 subscribers</i> 88 likes 12 episodes</body></html>"""


def pages(spark):
    rows = [
        ("p1", "wattpad", "listing", LISTING), ("p2", "tapas_io", "detail", DETAIL), ("p3", "unknown", "listing", LISTING), ("p4", "wattpad", "listing", "<p>tiny</p>"),
        ("p5", "wattpad", "listing", "<title>Just a moment...</title>" + "x" * 300), ("p6", "wattpad", "listing", "<title>ok</title><!-- blocked -->" + "y" * 300), ("p7", "wattpad", "listing", None),
    ]
    return spark.createDataFrame(rows, "path string, source string, kind string, html string").withColumn("scraped_at", F.lit(dt.datetime(2024, 1, 2)))


def test_pages_to_records(spark):
    records, manifest = bronze.parse_pages(pages(spark), min_bytes=100)
    status = {r.path: (r.status, r.n_records) for r in manifest.collect()}
    assert status == {"p1": ("ok", 2), "p2": ("ok", 1), "p3": ("no_adapter", 0), "p4": ("blocked", 0), "p5": ("blocked", 0), "p6": ("empty", 0), "p7": ("blocked", 0)}
    by = {r.comic_id: r for r in records.collect()}
    moon, second, sun = by["wattpad:11"], by["wattpad:22"], by["tapas_io:77"]
    assert (moon.title, moon.author, moon.rank, moon.views, moon.rating, moon.cover_url) == ("Moon Song", "Kim", 1, 1200000, 4.6, "https://c/1.jpg")
    assert moon.url == "https://www.wattpad.com/story/11-moon" and moon.content_type == "novel"
    assert (second.title, second.rank, second.views) == ("Second Title", 2, 28000)
    assert (sun.title, sun.views, sun.subscribers, sun.likes, sun.episode_count, sun.primary_metric, sun.metric_type) == ("Sun & Sea", 1500000, 2000, 88, 12, 1500000, "views")
    assert records.schema.names == SILVER.names


def test_bronze_and_silver_files(spark, tmp_path):
    for name in ("wattpad/2024-01-02/listing_1704153600.html", "wattpad/2024-01-02/listing.html"):
        (tmp_path / "b" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / name).write_text(LISTING)
    read = bronze.read_bronze(spark, str(tmp_path / "b"))
    assert read.filter(F.col("scraped_at") == dt.datetime(2024, 1, 2)).count() == 1 and read.count() == 2
    records, manifest = bronze.parse_pages(read, min_bytes=100)
    records = records.filter(F.col("scraped_at") == dt.datetime(2024, 1, 2))
    for _ in range(2):  # a second run leaves the same rows
        files.write_silver(records, str(tmp_path / "s"), files_a_day=2)
        assert sorted(r.comic_id for r in files.read_silver(spark, str(tmp_path / "s")).collect()) == ["wattpad:11", "wattpad:22"]
    files.write_manifest(manifest, str(tmp_path / "m"))
    assert [tuple(r) for r in files.manifest_summary(spark.read.parquet(str(tmp_path / "m/manifest"))).collect()] == [("ok", 2, 4)]
    for run in (1, 2):
        files.write_snapshot(spark.range(run), str(tmp_path / "g"), run)
    assert files.read_newest(spark, str(tmp_path / "g")).count() == 2


def test_report_is_one_document_of_lines(spark, tmp_path):
    odd = spark.createDataFrame([(1, 'a "quoted"\nline'), (2, None)], "k int, s string")
    files.write_report({"a": spark.range(300).repartition(5), 'b "x"': odd, "none": spark.range(0)}, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r")).selectExpr("size(a)").first()[0] == 300
    (file,) = (tmp_path / "r").glob("part-*")
    told = json.loads(file.read_text())
    assert sorted(r["id"] for r in told["a"]) == list(range(300)) and told['b "x"'] == [{"k": 1, "s": 'a "quoted"\nline'}, {"k": 2}] and told["none"] == []
    assert len(file.read_text().splitlines()) > 300


def test_silver_is_read_by_folder_and_flat(spark, tmp_path):
    days = [(f"c{k}", f"s{k % 3}", k, dt.datetime(2024, 1, 1 + k % 4, 5)) for k in range(24)]
    records = validated(spark.createDataFrame(days, "comic_id string, source string, views long, scraped_at timestamp"))
    files.write_silver(records, str(tmp_path / "parts"))
    records.write.parquet(str(tmp_path / "flat"))
    want = sorted(c for c, s, _, t in days if s in ("s1", "s2") and t.day in (2, 3))
    for root in ("parts", "flat"):
        whole = files.read_silver(spark, str(tmp_path / root))
        assert whole.columns == SILVER.names and sorted((r.comic_id, r.source, r.views, r.scraped_at) for r in whole.collect()) == sorted(days)
        some = files.read_silver(spark, str(tmp_path / root), sources=["s1", "s2"], since="2024-01-02", until="2024-01-03")
        assert sorted(r.comic_id for r in some.collect()) == want
    scan = files.read_silver(spark, str(tmp_path / "parts"), sources=["s1"], since="2024-01-02").select("views")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in scan or "PartitionFilters: [isnotnull(source" in scan
    assert "date#" in scan.split("PartitionFilters")[1].split("]")[0] and "ReadSchema: struct<views:bigint>" in scan


def test_updates_leave_other_days_alone(spark, tmp_path):
    root = str(tmp_path / "facts")
    rows = [(f"c{k}", dt.date(2024, 1, 1 + k % 5), k) for k in range(40)]
    table = spark.createDataFrame(rows, "comic_id string, date date, views long")
    files.rewrite_folders(table, root, "date")
    stamp = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}
    before = stamp()
    changes = spark.createDataFrame([("c1", dt.date(2024, 1, 2), 700), ("c1", dt.date(2024, 1, 2), 800), ("n", dt.date(2024, 1, 2), 9), ("n", dt.date(2024, 2, 9), 10)], table.schema)
    assert warehouse.upsert_table(changes.withColumn("more", F.lit(1)), root) == [dt.date(2024, 1, 2), dt.date(2024, 2, 9)]
    after = stamp()
    other = {p for p in before if "date=2024-01-02" not in str(p)}
    assert len(other) >= 4 and all(after[p] == before[p] for p in other)
    assert not any(p in after for p in before if p not in other) and any("date=2024-02-09" in str(p) for p in after)
    want = {(c, d): v for c, d, v in rows} | {("c1", dt.date(2024, 1, 2)): 800, ("n", dt.date(2024, 1, 2)): 9, ("n", dt.date(2024, 2, 9)): 10}
    assert {(r.comic_id, r.date): r.views for r in spark.read.parquet(root).collect()} == want
    assert warehouse.upsert_table(changes.limit(0), root) == [] and stamp() == after


def test_contracts(spark, tmp_path):
    head = "title_id,title,publisher,platform,contract_date,contract_size_usd,term_months,territory,rights,notes\n"
    (tmp_path / "c.csv").write_text(f"# remark\n{head}t1,A,P,X,2024-01-05,12.5,bad,US,all,\n,B,P,X,,,,,,\n")
    rows = files.read_contracts(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.title_id, str(r.contract_date), r.contract_size_usd, r.term_months) for r in rows] == [("t1", "2024-01-05", 12.5, None)]


def test_records_without_columns(spark):
    r = validated(spark.createDataFrame([("a", " x \t y ", "odd")], "comic_id string, title string, metric_type string")).first()
    assert (r.title, r.metric_type, r.content_type, r.views, r.rank) == ("x y", "unknown", "comic", 0, None)


def test_merge_takes_the_best_of_each(spark):
    day = dt.datetime(2024, 1, 2)
    rows = [("a", "s", "Short", None, 3, 10, 0, day, "f1"), ("a", "s", "A longer title", "Kim", None, 5, 9, day + dt.timedelta(hours=1), "f2")]
    df = spark.createDataFrame(rows, "comic_id string, source string, title string, author string, rank int, views long, likes long, scraped_at timestamp, source_file string")
    r = bronze.merge_enrich(df.withColumn("subscribers", F.lit(None).cast("long"))).first()
    assert (r.title, r.author, r.rank, r.views, r.likes, r.primary_metric, r.metric_type) == ("A longer title", "Kim", 3, 10, 9, 10, "views")


def test_works_of_a_wiki_page(spark):
    html = """<a class=x href='/w/One%20Two' title='One Two'>1</a><a href='/w/Cat:Three' title='Three'>2</a><a href='/w/a/b' title='Folder'>3</a>
      <a href='/w/one' title='one two'>4</a><a href='/w/x' title='Kakao page'>5</a><a href='/w/Naver%20X' title='fine'>6</a><a href='/w/y' title=' Z '>7</a>
      <A HREF="/w/%ED%8B%80+1" id=q title="A+B">8</A><a href='/w/no-title'>9</a><a href='/w/late?x' title='Query'>10</a><a href="/w/Last" title="Last one">11</a>"""
    df = spark.createDataFrame([("p", html), ("q", html[:60]), ("r", None), ("s", "")], "path string, html string")
    assert sorted(tuple(r) for r in bronze.denylist_index(df).collect()) == [("p", "Last", "Last one"), ("p", "One Two", "One Two"), ("q", "One Two", "One Two")]
    assert sorted(r.title for r in bronze.denylist_index(df, "(?i)two").filter("path = 'p'").collect()) == ["A+B", "Kakao page", "Last one", "fine"]


CARD_PAGES = {
    "nested": "<div><ul><li><a href='/w/1'>One</a><span>9.9K</span><li><a href='/w/2' title='Two &amp; more'><img alt=bare src=/no.png><IMG SRC='https://c/2.png' ALT='Img > two'></a><b>4.5</b></ul>tail</div>",
    "quotes": """<!-- <a href='/w/9'>no</a> --><script>var t="<a href='/w/8'>no</a>";</script><a class="x>y" href = "/w/3" >a <i>b</i>
      c</a> out <a>none</a> <a href=''>none</a><article><img src='https://c/card.png'><a href='/w/4'></a>later</article><img src='https://c/far.png'>""",
    "bare": "text only < 5", "open": "<a href='/w/5'>never <b>closed", "empty": "", "none": None,
}


def test_anchors_know_their_cards(spark):
    df = spark.createDataFrame(list(CARD_PAGES.items()), "path string, html string").repartition(3)
    got = {}
    for r in sorted(markup.anchors(df, "path").collect(), key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path, []).append((r.pos, r.href, r.alt, r.title_attr, r.text, r.cover, r.card))
    assert got == {
        "nested": [(0, "/w/1", None, None, "One", "https://c/2.png", ["One", "9.9K", "4.5", "tail"]), (1, "/w/2", "bare", "Two & more", "", "https://c/2.png", ["4.5", "tail"])],
        "quotes": [(0, "/w/3", None, None, "a b c", None, []), (1, "/w/4", None, None, "", "https://c/card.png", ["later"])],
        "open": [(0, "/w/5", None, None, "never closed", None, [])],
    }
    plan = markup.anchors(df, "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == 1 and "Python" not in plan and "Arrow" not in plan


def test_a_card_holds_its_first_texts(spark):
    html = "<div>" + "".join(f"<p>t{k}</p>" for k in range(40)) + "</div><div>a<div>b<a href='/w/1'>c</a></div>d</div>"
    pages = [("p", html), ("q", html.replace("<div>", "<div><a href='/w/0'>first</a>", 1))]
    got = {(r.path, r.href): r.card for r in markup.anchors(spark.createDataFrame(pages, "path string, html string"), "path").collect()}
    assert got == {("p", "/w/1"): ["b", "c"], ("q", "/w/1"): ["b", "c"], ("q", "/w/0"): ["first", *(f"t{k}" for k in range(15))]}


def test_labelled_numbers_are_of_the_first_pattern(spark):
    html = "<p>Reads 1.5K</p><style>9 views</style><b>2,000 followers</b> Volume 3 <script>7 likes</script>"
    df = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    tries = {"views": [r"([\d.,]+\s*[kmb]?)\s+views", r"reads\s*([\d.,]+\s*[kmb]?)"], "subscribers": [r"([\d,]+)\s*followers"], "likes": [r"(\d+)\s*likes"]}
    got = [r.m for r in df.select(bronze.labelled_metrics(F.col("html"), tries).alias("m")).collect()]
    nothing = dict.fromkeys(tries)
    assert got == [{"views": 1500, "subscribers": 2000, "likes": None}, nothing, nothing]


def test_a_page_that_cannot_be_parsed_is_an_error(spark, tmp_path):
    class Fragile(bronze._Anchors):
        """A parser that fails on one page."""

        def feed(self, data):
            if "BROKEN" in data:
                raise ValueError("cannot read this")
            super().feed(data)

    page = "<ul><li><a href='/books/{0}'><img alt='Title {0}'></a><span>판타지 소설</span><span>4.5</span></li></ul>"
    rows = [(f"p{k}", "ridibooks", "listing", dt.datetime(2024, 1, 2), page.format(k) + ("BROKEN" if k == 2 else "")) for k in range(1, 4)]
    pages = spark.createDataFrame(rows, "path string, source string, kind string, scraped_at timestamp, html string")
    records, manifest = bronze.parse_pages(pages, min_bytes=1, parser=Fragile)
    got = {r.path: (r.status, r.reason, r.n_records) for r in manifest.collect()}
    assert got == {"p1": ("ok", None, 1), "p2": ("error", "ValueError: cannot read this", 0), "p3": ("ok", None, 1)}
    assert {(r.title, r.genre, r.rating) for r in records.collect()} == {("Title 1", "판타지 소설", 4.5), ("Title 3", "판타지 소설", 4.5)}
    files.write_manifest(manifest, str(tmp_path))
    assert [r.path for r in spark.read.json(f"{tmp_path}/quarantine").collect()] == ["p2"]


def test_colours(spark):
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 2] = 255  # blue first
    df = spark.createDataFrame([("a", 4, 4, 3, bytearray(red.tobytes()))], "safe_id string, height int, width int, channels int, data binary")
    r = style.color_features(df).first()
    assert (r.saturation, r.warmth, r.palette[0]) == (1.0, 1.0, "#ff0000") and abs(r.brightness - 0.299) < 1e-9


def test_days_come_in_as_a_stream(spark, tmp_path):
    rows = [("a", d, 10 * d + h) for d in (1, 2, 9) for h in range(3)]
    df = spark.createDataFrame(rows, "comic_id string, d int, views long").select("comic_id", "views", F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(3), F.lit(0), F.lit(0)).alias("scraped_at"))
    validated(df).write.parquet(str(tmp_path / "in"))
    stream = increments.observations(spark, str(tmp_path / "in"))
    increments.write_days(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(str(r.date), r.views) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("2024-01-01", 12), ("2024-01-02", 22)} <= got


def repeated(spark):
    """Addresses seen several times, by one platform or more, as listings and as details."""
    item = lambda k: f"<li><a href='/story/{k}'>Title number {k}</a><img src='https://c/{k}.png'></li>"
    listing = lambda *ks: f"<ul>{''.join(map(item, ks))}</ul>" + " " * 200
    detail = "<h1>Some Heading</h1>" + " " * 200
    rows = [
        ("a", "wattpad", "listing", listing(1, 2), 1), ("a", "wattpad", "listing", listing(3, 1), 2), ("b", "wattpad", "listing", listing(4), 3), ("b", "unknown", "listing", listing(5), 4),
        ("c", "wattpad", "listing", listing(6, 7), 5), ("c", "wattpad", "detail", detail, 6), ("d", "wattpad", "listing", listing(8), 7),
    ]
    made = spark.createDataFrame(rows, "path string, source string, kind string, html string, at int")
    return made.select("path", "source", "kind", "html", F.timestamp_seconds("at").alias("scraped_at"))


def test_snapshots_of_one_address_are_read_apart(spark):
    listed = bronze.anchor_listing(repeated(spark).filter("path = 'a'"))
    assert sorted((r.platform_native_id, r.rank, r.title, r.cover_url) for r in listed.collect()) == [
        ("1", 1, "Title number 1", "https://c/1.png"), ("2", 3, "Title number 2", "https://c/2.png"), ("3", 2, "Title number 3", "https://c/3.png"),
    ]
    by_parser = bronze.anchor_scan(repeated(spark), bronze._Anchors)
    assert sorted((r.path, r.scraped_at.second, r.pos, r.href) for r in by_parser.collect()) == sorted((r.path, r.scraped_at.second, r.pos, r.href) for r in bronze.anchor_scan(repeated(spark)).collect())


def test_each_snapshot_has_its_manifest_row(spark, tmp_path):
    records, manifest = bronze.parse_pages(repeated(spark), min_bytes=100)
    told = sorted((r.path, r.source, r.kind, r.status, r.n_records) for r in manifest.collect())
    assert told == [
        ("a", "wattpad", "listing", "ok", 3), ("a", "wattpad", "listing", "ok", 3), ("b", "unknown", "listing", "no_adapter", 0), ("b", "wattpad", "listing", "ok", 1),
        ("c", "wattpad", "detail", "ok", 1), ("c", "wattpad", "listing", "ok", 2), ("d", "wattpad", "listing", "ok", 1),
    ]
    assert records.count() == 8
    by_address = sorted((r.path, r.kind, r.status, r.n_records) for r in bronze.manifest_by_address(records, manifest).collect())
    assert by_address == [
        ("a", "listing", "ok", 3), ("a", "listing", "ok", 3), ("b", "listing", "no_adapter", 1), ("b", "listing", "ok", 1),
        ("c", "detail", "ok", 1), ("c", "detail", "ok", 2), ("c", "listing", "ok", 1), ("c", "listing", "ok", 2), ("d", "listing", "ok", 1),
    ]


def test_queries_of_pages_with_repeated_addresses(spark, sf_dir, tmp_path):
    """The manifest and its files equal their SQL where an address occurs twice; the listing does but for the order among titles of two snapshots at one place."""
    import duckdb
    from test_entry import rows

    import __spark_entry__ as entry

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("length(html) >= 1000")
    doubled = p.unionByName(p.withColumns({"page_id": F.col("page_id") + 1001, "html": F.replace("html", F.lit('href="/a'), F.lit('href="/b'))}).filter("page_id % 4 < 3"))
    doubled.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name, loose in (("c2_manifest", ()), ("a4_manifest_files", ()), ("c3_anchor_listing", ("rank",))):
        got = entry.queries()[name](spark, str(tmp_path)).drop(*loose)
        told = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})")
        assert rows(got.columns, got.collect()) == rows(told.columns, told.fetchall()), name


def test_listing_ranks_are_an_order_that_the_sql_allows(spark, sf_dir, tmp_path):
    """Titles of two snapshots at one place have no order in the SQL: our ranks are those of the SQL with that order closed, and all else is equal as it stands."""
    import duckdb
    from test_entry import rows

    import __spark_entry__ as entry

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("length(html) >= 1000")
    # Of another platform and kind, and of the same ones with other titles at the same places.
    as_moved = {"html": F.replace("html", F.lit('href="/'), F.lit('href="/x'))}
    moved = [p.withColumns({"page_id": F.col("page_id") + k} | as_moved) for k in (1001, 1005)]
    p.unionByName(moved[0]).unionByName(moved[1]).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    sql, end = entry.oracle_sql()["c3_anchor_listing"], "OVER (PARTITION BY path ORDER BY pos{})"
    assert sql.count(end.format("")) == 1
    got = entry.queries()["c3_anchor_listing"](spark, str(tmp_path))

    def told(more):
        return rows(got.columns, con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql.replace(end.format(''), end.format(more))})").fetchall())

    ours = rows(got.columns, got.collect())
    assert ours == told(", source, kind, native_id")
    assert ours != told(", source DESC, kind, native_id") and ours != told(", source, kind, native_id DESC")
