import json
import zipfile

from pyspark.sql import functions as F

from cairnframe.operators import pages, search
from cairnframe.plans.export import write_xlsx
from cairnframe.sources import records as R
from cairnframe.streaming import landing

HTML = """<html lang="en"><head><title>A  plant</title><meta name="description" content="about it"><meta property="article:author" content="Me">
<script type="application/ld+json">{"name": "x", "a": {"b": [1, 2]}}</script><script>var x = 1;</script></head>
<body><nav><a href="/n">menu</a></nav><h1>A plant</h1><div class="row"><p class="price_color">£51.77</p><p class="star Three">ok</p></div><ul><li>one</li><li>two</li></ul><a href="/b#c">b</a><footer>foot</footer></body></html>"""


def test_parse(spark):
    r = pages.parse_pages(spark.createDataFrame([("u", HTML), ("v", None)], "url string, html string")).collect()
    a = next(x for x in r if x.url == "u")
    assert a.title == "A plant" and a.author == "Me" and a.lang == "en" and a.headings == "A plant" and "menu" not in a.text and "£51.77" in a.text and a.links == ["/n", "/b#c"]
    assert pages.structured_fields(a.structured[0]) == {"name": "x", "a.b": "1; 2"}
    assert pages.select(HTML, "p.price_color") == ["£51.77"] and pages.select(HTML, "p.star@class") == ["star Three"] and pages.select(HTML, "ul li:nth-child(2)") == ["two"] and pages.select(HTML, r"regex:£([\d.]+)") == ["51.77"]


def test_addresses(spark):
    df = spark.createDataFrame([("HTTPS://www.A.test:8080/x/#y",)], "u string")
    assert df.select(pages.domain_of(F.col("u"))).first()[0] == "a.test:8080" and df.select(pages.clean_url(F.col("u"))).first()[0] == "HTTPS://www.A.test:8080/x"
    links = spark.createDataFrame([("http://a.test/1", "http://a.test/2"), ("http://a.test/2", "http://a.test/3"), ("http://a.test/2", "http://b.test/9"), ("http://a.test/3", "http://a.test/1")], "from_url string, to_url string")
    got = {r.url: r.depth for r in pages.frontier(spark.createDataFrame([("http://a.test/1",)], "url string"), links, 2).collect()}
    assert got == {"http://a.test/1": 0, "http://a.test/2": 1, "http://a.test/3": 2}


def test_search(spark):
    p = spark.createDataFrame([(1, "u1", "Herb plant", None, None, "grows"), (2, "u2", "x", None, None, "a plant herb herb"), (3, "u3", "y", None, None, None)], "page_id bigint, url string, title string, description string, headings string, text string").withColumn("domain", F.lit("a.test"))
    assert {r.page_id for r in search.search(p, "plant herb").collect()} == {1, 2}
    assert search.search(p, "").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Place,Kind\nX,town\n\"Y, Z\",\n")
    p, f = R.read_source(spark, str(tmp_path / "a.csv"), key="Place")
    assert p.count() == 2 and {tuple(r) for r in f.select("name", "value").collect()} == {("Place", "X"), ("Kind", "town"), ("Place", "Y, Z")}
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"id": 1, "tags": ["a", "b"], "n": {"m": 2}}]}))
    _, f = R.read_source(spark, str(tmp_path / "b.json"))
    assert {tuple(r) for r in f.select("name", "value").collect()} == {("id", "1"), ("tags", "a; b"), ("n.m", "2")}
    write_xlsx({"s": spark.createDataFrame([("v", 1)], "h string, n int")}, str(tmp_path / "c.xlsx"))
    _, f = R.read_source(spark, str(tmp_path / "c.xlsx"))
    assert {tuple(r) for r in f.select("name", "value").collect()} == {("h", "v"), ("n", "1")}
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p></w:body></w:document>')
    assert R.read_source(spark, str(tmp_path / "d.docx"))[0].first().text == "Hi"
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "S"}}, {"type": "way", "id": 2, "tags": {"name": "T"}}, {"type": "way", "id": 3, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"x": "y"}}]}))
    assert R.osm_features(spark, str(tmp_path / "o.json")).count() == 1


def test_small_readers():
    assert R.cell_name(2, 28) == "AB2" and R.page_numbers("1-3,7") == {1, 2, 3, 7}
    assert R.osm_filter("amenity=school, shop") == [("amenity", "school"), ("shop", None)]
    assert R.feed_links("<rss><channel><item><link>http://a</link></item></channel></rss>") == ["http://a"]
    assert [R.guess_type(x) for x in ("a.csv", "http://x/y", "x/feed/", "http://x/feed", "osm:shop", "b.docx", "http://x/api/y")] == ["csv", "website", "folder", "feed", "osm", "docx", "api"]
    assert R.column_map(["Shop ID", "x"], ["shop_id"]) == {"Shop ID": "shop_id"}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "2024-01-01 00:10:00"), ("a", 2.0, "2024-01-01 00:20:00"), ("b", 3.0, "2024-01-01 02:00:00")], "k string, value double, t string").selectExpr("k", "value", "cast(t as timestamp) as ts")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = landing.each_batch(landing.first_seen(landing.landed(spark, str(tmp_path / "in"), df.schema), "k", "ts"), lambda b, _: got.extend(r.k for r in b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(got) == ["a", "b"]
    assert {(r.k, r.n, r.total) for r in landing.windowed(df, "ts", ["k"], "1 hour").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_an_unclosed_menu_ends_with_its_parent():
    from cairnframe.operators.pages import Parsed

    page = Parsed()
    page.feed("<body><div><nav><ul><li>menu</div><p>kept</aside> too<p>and <nav>x</nav>this</body>")
    assert page.text() == "kept too\nand this"
