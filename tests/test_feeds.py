import json

from pyspark.sql import functions as F

from lodestone.sources import feeds


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_sitemaps(spark, tmp_path):
    one = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
    put(tmp_path / "maps", "a.xml", one.format("<url><loc> http://www.News.org/x/?utm_source=q&amp;b=1 </loc><lastmod>2024-01-02T03:04:05+01:00</lastmod></url><url><loc><![CDATA[https://news.org/y]]></loc></url><url><loc>bad & worse</loc></url><url><loc>https://news.org/v</url><url><lastmod>2024-01-01</lastmod></url>"))
    put(tmp_path / "maps", "b.xml", one.format("<url><loc>https://news.org/z</loc></url>"))
    put(tmp_path / "index", "index.xml", "<sitemapindex><sitemap><loc>https://news.org/maps/a.xml</loc></sitemap><sitemap><loc>https://news.org/maps/a.xml?again</loc></sitemap><sitemap><loc>https://news.org/maps/c.xml</loc></sitemap></sitemapindex>")
    name = F.element_at(F.split("file", "/"), -1)
    entries = feeds.xml_records(spark, str(tmp_path / "maps"), "url", feeds.PLACE).withColumn("sitemap", name)
    index = feeds.xml_records(spark, str(tmp_path / "index"), "sitemap", feeds.PLACE)
    got = {(r.sitemap, r.url, r.s, r.reason) for r in feeds.sitemap_urls(index, entries).select("sitemap", "url", F.unix_seconds("lastmod").alias("s"), "reason").collect()}
    bad = [g for g in got if g[3] == "corrupt"]
    assert bad == [("a.xml", None, None, "corrupt")]
    assert got - set(bad) == {("a.xml", "https://news.org/x?b=1", 1704161045, None), ("a.xml", "https://news.org/y", None, None), ("a.xml", None, 1704067200, "no address"), ("b.xml", "https://news.org/z", None, "unlisted"), ("c.xml", None, None, "empty sitemap")}
    assert feeds.sitemap_urls(index.limit(0), entries.limit(0)).count() == 0


def post(**change):
    return {"id": 7, "link": "http://www.news.org/a/", "date_gmt": "2024-03-01T10:00:00", "title": {"rendered": "A &amp; <b>B</b>"}, "excerpt": {"rendered": "<p>What is\n said</p>"}} | change


def test_articles(spark, tmp_path):
    terms = [[{"name": "News", "taxonomy": "category"}, {"name": "Uncategorized", "taxonomy": "category"}, {"name": "news", "taxonomy": "category"}], None, [{"name": "T" * 81, "taxonomy": "post_tag"}, {"name": "x &amp; y", "taxonomy": "post_tag"}]]
    posts = [post(_embedded={"wp:term": terms}), post(id=8, title="plain", date_gmt="", date="2024-03-02T00:00:00+02:00", modified_gmt="2024-04-01T00:00:00"), post(id=None), post(id=9, link="https://other.org/a"), post(id=10, link="https://news.org.evil.org/a"),
             post(id=11, date_gmt="soon"), post(id=12, date_gmt="2023-12-31T23:59:59"), post(id=13, title=""), post(id=14, excerpt={"rendered": " <p></p>"}), post(id=15, title=None)]
    put(tmp_path / "posts", "p.json", "\n".join([*map(json.dumps, posts), "{broken", json.dumps(posts[1])]))
    rows = feeds.articles(feeds.json_records(spark, str(tmp_path / "posts")), "news.org", "2024-01-01T00:00:00Z").collect()
    assert sorted((r.id, r.reason) for r in rows if r.id and r.reason) == [(f"news.org-{k}", why) for k, why in ((10, "other host"), (11, "no date"), (12, "before the cutoff"), (13, "no title"), (14, "no excerpt"), (15, "no title"), (9, "other host"))]
    assert sorted(r.reason for r in rows if r.id is None) == ["corrupt", "no id"] and len(rows) == 12
    first = next(r for r in rows if r.id == "news.org-7")
    assert (first.url, first.title, first.excerpt, first.categories, first.tags) == ("https://news.org/a", "A & B", "What is said", ["News"], ["x & y"])
    again = [r for r in rows if r.id == "news.org-8"]
    assert len(again) == 2 and again[0].reason is None and again[0].title == "plain" and again[0].modified is not None and again[0].categories == []


def test_feed_items(spark, tmp_path):
    item = "<item><title>{t}</title><link>{l}</link><pubDate>{d}</pubDate><description><![CDATA[<p>Some <i>words</i>.</p>]]></description><category>News</category><category domain=\"post_tag\">a</category><category domain=\"post_tag\">A</category></item>"
    good = [item.format(t="One", l="https://news.org/2024/one/?utm_medium=rss", d="Fri, 01 Mar 2024 10:00:00 GMT"), item.format(t="Two", l="https://news.org/", d="Fri, 01 Mar 2024 10:00:00 +0100"), item.format(t="Old", l="https://news.org/old", d="Fri, 01 Mar 2019 10:00:00 +0000")]
    put(tmp_path / "rss", "f.xml", f"<rss><channel>{''.join(good)}<item><title>R & D</title></item></channel></rss>")
    rows = feeds.feed_articles(feeds.xml_records(spark, str(tmp_path / "rss"), "item", feeds.RSS), "news.org", "2024-01-01T00:00:00Z").select("*", F.unix_seconds("date").alias("s")).collect()
    got = {r.id: (r.url, r.title, r.s, r.categories, r.tags, r.excerpt, r.reason) for r in rows if r.reason != "corrupt"}
    assert got["news.org-one"] == ("https://news.org/2024/one", "One", 1709287200, ["News"], ["a"], "Some words.", None)
    assert got["news.org-item"][2] == 1709283600 and got["news.org-old"][-1] == "before the cutoff"
    assert [r.reason for r in rows].count("corrupt") == 1 and len(rows) == 4


def test_curated(spark, tmp_path):
    entry = {"id": "a", "title": "t", "text": "x", "category": "c"}
    lines = [json.dumps(entry | change) for change in ({}, {"id": 5}, {"title": None}, {"text": " \t"}, {"category": ["c"]}, {"more": {"x": 1}})]
    put(tmp_path / "curated", "c.json", "\n".join([*lines, "[]", "{", '"text"', json.dumps({"id": "a"})]))
    rows = feeds.curated(spark, str(tmp_path / "curated")).collect()
    assert [r.reason for r in rows] == [None, "no id", "no title", "blank text", "no category", None, "corrupt", "corrupt", "corrupt", "no title"]
    assert rows[0][1:5] == ("a", "t", "x", "c")
