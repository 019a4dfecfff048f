"""URL admission rules on addresses of our own, plus properties."""

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import admission as A


def _one(spark, col_fn, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("v"))).collect()]


def test_canonical_form(spark):
    vals = ["HTTPS://Garden.Example/Beds?row=2#late", "http://g.example:80/x/./y/../z", "https://g.example/a/b/..", "HTTP://G.EXAMPLE",
            "https://g.example/été/日?q=ñ", "https://g.example/a b\"c"]
    assert _one(spark, U.canonical_url, vals) == [
        "https://garden.example/Beds?row=2", "http://g.example/x/z", "https://g.example/a/", "http://g.example/",
        "https://g.example/%C3%A9t%C3%A9/%E6%97%A5?q=%C3%B1", "https://g.example/a%20b%22c"]


def test_reasons_in_order(spark):
    vals = ["", "no address", "gopher://g.example/", "https://me:pw@g.example/", "http://g.example:8443/", "http://db.internal/",
            "https://g.example:443/a", "http://[::1]/", "https://@g.example/", "http://192.168.7.1/", "http://LOCALHOST./"]
    assert _one(spark, U.rejection_reason, vals) == [
        "missing_url", "unparseable", "scheme", "credentials", "port", "private", None, "private", None, "private", "private"]


def test_private_addresses(spark):
    vals = ["172.20.3.4", "172.32.0.1", "9.9.9.9", "2620:fe::9", "fe90::2", "fd12::1", "::ffff:192.168.0.9", "::ffff:9.9.9.9",
            "100.100.1.1", "198.18.5.5", "230.1.1.1", "2001:db8:7::1", "host.example."]
    assert _one(spark, U.private_address, vals) == [True, False, False, False, True, True, True, False, True, True, True, True, True]


def test_post_urls(spark):
    vals = ["https://x.com/gardener/status/77", "https://www.twitter.com/gardener/article/78?s=1", "https://g.example/gardener/status/79"]
    assert _one(spark, U.is_post_url, vals) == [True, True, False]
    df = spark.createDataFrame([("https://x.com/gardener/status/77",), ("https://x.com/I/status/78",)], "v string")
    rows = df.select(U.post_ref(F.col("v")).alias("r")).collect()
    assert (rows[0].r.id, rows[0].r.username) == ("77", "gardener") and rows[1].r.id is None


def test_cache_keys_stable_and_distinct(spark):
    keys = _one(spark, U.cache_key, ["https://g.example/1", "https://g.example/1", "https://g.example/2"])
    assert keys[0] == keys[1] != keys[2] and keys[0].startswith("results/v2/") and keys[0].endswith(".json")


def test_wiki_titles(spark):
    vals = ["https://de.wikipedia.org/wiki/Humus", "https://en.wikipedia.org/wiki/Loam_%28soil%29", "https://en.wikipedia.org/wiki/Talk:Loam",
            "https://g.example/wiki/Loam", "https://en.wikipedia.org/wiki/%zz"]
    assert _one(spark, U.wiki_title, vals) == ["Humus", "Loam_(soil)", None, None, None]


def test_resolved_locations(spark):
    df = spark.createDataFrame([(x,) for x in ("../up", "./a/../b?x#y", "//cdn.example/p/../q", "https://o.example/s/./t", "?n=2", "",
                                               "mailto:a@b.example", "/r/..")], "loc string")
    got = [r[0] for r in df.select(U.resolve_location(F.lit("https://g.example:8080/d/e/f?o=1"), F.col("loc"))).collect()]
    assert got == ["https://g.example:8080/d/up", "https://g.example:8080/d/e/b?x#y", "https://cdn.example/q", "https://o.example/s/t",
                   "https://g.example:8080/d/e/f?n=2", "https://g.example:8080/d/e/f?o=1", "mailto:a@b.example", "https://g.example:8080/"]


def test_normalize_is_idempotent_and_keys_follow(spark):
    vals = ["  https://G.EXAMPLE:443/ü b?x=\"1\"#f ", "http://G.example", "https://x.com/u/status/1"]
    df = spark.createDataFrame([(v,) for v in vals], "raw_url string")
    once = A.admit(df).select("canonical_url", "cache_key")
    twice = A.admit(once.withColumnRenamed("canonical_url", "raw_url").drop("cache_key"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select("canonical_url", "cache_key").collect()))


def test_scanner_paths(spark):
    vals = ["/.ENV", "/.env.prod", "/.hg/store", "/wp-admin", "/old/Shell.PHP", "/api/extract"]
    assert _one(spark, U.is_scanner_path, vals) == [True, True, True, True, True, False]


def test_submitted_url_of_malformed_requests(spark):
    rows = [("GET", "https://s/api?url=%zz%20x", None, None), ("POST", "u", "application/json", '{"url": 5}'),
            ("POST", "u", "application/json", '{"a": {"url": "n"}, "url": "https://g.example/"}'),
            ("POST", "u", "application/json", '{"url": "x"} junk'), ("POST", "u", "application/json", ""),
            ("POST", "u", "form", "a=1&url=a%2Bb+c"), ("PUT", "u", None, None)]
    df = spark.createDataFrame(rows, "m string, u string, c string, b string")
    got = [r[0] for r in df.select(A.request_url(F.col("m"), F.col("u"), F.col("c"), F.col("b"))).collect()]
    assert got == ["%zz%20x", "", "https://g.example/", "", "", "a+b c", ""]


def test_beacon_statuses(spark):
    ok = '{"event":"%s","page":"%s"}' % (U.BROWSER_EVENTS[0], U.BROWSER_PAGES[0])
    own = A.SITE_ORIGIN
    rows = [("POST", own, None, 10, ok), ("POST", None, None, 10, ok), ("POST", own, "", 10, ok), ("POST", own, "cross-site", 10, ok),
            ("POST", own, "same-origin", 10, ok + " junk"), ("POST", own, None, 200, ok), ("POST", own, None, 10, ok + " " * 128),
            ("POST", own, None, 10, '{"event":1,"page":"home"}'), ("GET", own, None, 10, ok), ("POST", own, None, 10, "")]
    df = spark.createDataFrame(rows, "method string, origin string, sec_fetch_site string, content_length long, body string")
    assert [r.status for r in A.beacon_status(df).collect()] == [204, 404, 204, 404, 400, 413, 413, 400, 404, 400]


def test_redirect_chains_keep_their_last_node(spark):
    starts = spark.createDataFrame([(i,) for i in range(10)], "start long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    got = {r.start: (r.final, r.hops, r.status) for r in A.resolve_redirects(starts, edges).collect()}
    assert got[0] == (6, 6, "TOO_MANY") and got[4] == (9, 5, "OK") and got[9] == (9, 0, "OK")


def test_admitted_parts_are_those_of_the_canonical_url(spark):
    """The parts that admission hands on are what parsing its canonical URL gives."""
    from pagemill.operators.admission import admit

    raw = ["https://Example.com:443/a b/../é?q='x'#f", "http://example.com", "http://example.com:80/./x/%2e%2e/y", "https://example.com/a{b}?",
           "http://[2606:4700::1111]/x", "https://x.com/u/status/12", "ftp://example.com/", "nope", "https://a.example/..", None]
    rows = admit(spark.createDataFrame([(r,) for r in raw], "raw_url string"))
    rows = U.with_url_parts(rows.select("canonical_url", "canon_parts"), "canonical_url", "again").where("canonical_url is not null")
    got = rows.select("canon_parts", "again").collect()
    assert len(got) == 7 and all(r.canon_parts == r.again for r in got)


def test_chains_of_located_redirects(spark):
    """Blocked hop, relative location, loop, redirect without location, unknown page, refused start, chains of five and six."""
    from pagemill.operators import admission as A

    c = [(f"https://a.example/{i}", 302, f"/{i + 1}") for i in range(1, 8)] + [("https://a.example/8", 200, None), ("https://b.example/x/y", 301, "../z?q#f"),
         ("https://b.example/z?q", 200, None), ("https://b.example/p", 307, "http://10.1.2.3/"), ("https://b.example/n", 301, None), ("https://b.example/l", 301, "https://b.example/l"),
         ("https://b.example/u", 301, "//c.example/gone"), ("https://b.example/e", 500, "/z"), ("https://b.example/f", 301, "ftp://b.example/")]
    starts = [(1, "https://a.example/3"), (2, "https://a.example/2"), (3, "https://b.example/x/y"), (4, "https://b.example/p"), (5, "https://b.example/n"), (6, "HTTPS://B.example:443/l"),
              (7, "https://b.example/u"), (8, "https://b.example/e"), (9, "http://localhost/"), (10, "https://b.example/f"), (11, None)]
    got = A.follow_locations(spark.createDataFrame(starts, "start int, url string"), spark.createDataFrame(c, "url string, status int, location string"))
    assert {r.start: (r.final, r.hops, r.status) for r in got.collect()} == {
        1: ("https://a.example/8", 5, "OK"), 2: ("https://a.example/7", 5, "TOO_MANY"), 3: ("https://b.example/z?q", 1, "OK"), 4: ("https://b.example/p", 0, "REFUSED:private"),
        5: ("https://b.example/n", 0, "NO_LOCATION"), 6: ("https://b.example/l", 5, "TOO_MANY"), 7: ("https://c.example/gone", 1, "NOT_CAPTURED"),
        8: ("https://b.example/e", 0, "OK"), 9: ("http://localhost/", 0, "REFUSED:private"), 10: ("https://b.example/f", 0, "REFUSED:scheme"), 11: (None, 0, "REFUSED:missing_url")}


def test_locations_without_dots_are_passed_on(spark):
    rows = [("https://a.example/x/y", "https://h.example?q"), ("https://a.example/x/y", ""), ("https://a.example/x/y", "z/"), ("https://a.example", "z")]
    got = spark.createDataFrame(rows, "b string, l string").select(U.resolve_location(F.col("b"), F.col("l")).alias("u")).collect()
    assert [r.u for r in got] == ["https://h.example?q", "https://a.example/x/y", "https://a.example/x/z/", "https://a.example/z"]
