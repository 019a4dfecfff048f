"""Sitemaps, site checks and submission payloads."""

import json

from pyspark.sql import functions as F

from pagemill.operators import site as W

DOCS = "host string, path string, status int, content_type string, location string, body string"
XML = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def doc(host, path, body, status=200, kind="text/html", location=None):
    return (host, path, status, kind, location, body)


def test_sitemaps_of_all_kinds(spark):
    one = "<url><loc> https://a.example/?x=1&amp;y=2 </loc><lastmod>2024-01-02</lastmod></url>"
    docs = [doc("a", "/sitemap.xml", XML.format(one + "<url><loc></loc></url><url/>")), doc("a", "/sitemap-2.xml", XML.format(one)), doc("b", "/sitemap.xml", "<html>no"),
            doc("c", "/sitemap.xml", XML.format(one), 404), doc("d", "/sitemap.xml", ""), doc("e", "/sitemap.xml", None), doc("f", "/x/sitemap.xml", XML.format(one))]
    got = sorted(tuple(r) for r in W.sitemap_urls(spark.createDataFrame(docs, DOCS)).collect())
    url = "https://a.example/?x=1&y=2"
    assert got == [("a", "/sitemap-2.xml", url, "2024-01-02"), ("a", "/sitemap.xml", url, "2024-01-02")]


def test_coverage(spark):
    expected = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("c", "3")], "host string, loc string")
    listed = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "1"), ("b", "2"), ("c", "1")], "host string, loc string")
    assert sorted(map(tuple, W.sitemap_missing(expected, listed).collect())) == [("b", "1"), ("c", "3")]
    assert sorted(map(tuple, W.sitemap_coverage(expected, listed).collect())) == [("a", 2, 2, True), ("b", 1, 0, False), ("c", 1, 0, False)]


def test_eleven_checks(spark):
    o = "https://good"
    head = f'<link rel="canonical" href="{o}/" /><meta  name="description"><script type="application/ld+json">'
    good = [doc("good", "/", head), doc("good", "/robots.txt", f"x\nSitemap: {o}/sitemap.xml"), doc("good", "/og.png", "", kind="image/png"),
            doc("good", "/sitemap.xml", "".join(f"<loc>{o}{p}</loc>" for p in ["/", *W.GUIDES])), doc("good", W.WWW, "", 308, location=o + "/")]
    good += [doc("good", p, f'<h1>{t}</h1><link rel="canonical" href="{o}{p}">') for p, (_, t) in W.GUIDES.items()]
    bad = [("bad", r[1], 500, "text/html", None, (r[5] or "").replace("good", "other")) for r in good if r[1] != "/og.png"]
    got = W.site_checks(spark.createDataFrame(good + bad + [doc("bad", "/", "twice", 200)], DOCS))
    rows = {(r.host, r.check_name): r.passing for r in got.collect()}
    assert len(rows) == 22 and all(v for (h, _), v in rows.items() if h == "good")
    assert not any(v for (h, n), v in rows.items() if h == "bad" and n != "root")
    assert sorted(map(tuple, W.site_score(got).collect())) == [("bad", 1, 11), ("good", 11, 11)]


def test_submissions_of_a_hot_host(spark):
    urls = [("hot", f"https://hot/{i % 230}") for i in range(500)] + [("small", "https://small/\"q\""), ("small", "https://small/b"), (None, "x"), ("none", None)]
    got = W.submissions(spark.createDataFrame(urls, "host string, url string").withColumn("part", F.lit(5)), "k", limit=10).collect()
    assert all(1 <= r.n_urls <= 10 for r in got)
    hot = [u for r in got if r.host == "hot" for u in json.loads(r.payload)["urlList"]]
    assert len(hot) == len(set(hot)) == 230 and len({(r.host, r.batch) for r in got}) == len(got)
    small = [json.loads(r.payload) for r in got if r.host == "small"]
    assert small == [{"host": "small", "key": "k", "keyLocation": "https://small/k.txt", "urlList": ['https://small/"q"', "https://small/b"]}]
