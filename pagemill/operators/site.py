"""Site documents (S11, J08, A11, P22, A07) and submission payloads.

A crawl's documents are rows (host, path, status, content_type, location,
body).  Sitemaps are XML files of bounded size, so a host with many pages has
many of them; each is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
# guide path → check name and heading
GUIDES = {
    "/url-to-markdown/": ("url_guide", "URL to Markdown"),
    "/webpage-to-markdown/": ("webpage_guide", "Webpage to Markdown"),
    "/x-to-markdown/": ("x_guide", "X post to Markdown"),
}
# ---------------------------------------------------------------------------
WWW = "www"                     # path of the row that holds the answer of the www host
SUBMIT_URLS = 10_000            # URLs of one submission
URLSET = "struct<url:array<struct<loc:string,lastmod:string>>>"


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """Host, path, loc and lastmod of each entry of the answered sitemaps; text that is no XML has none."""
    maps = docs.where((F.col("status") == 200) & F.col("path").rlike(r"^/sitemap[^/]*\.xml$"))
    url = F.from_xml("body", URLSET, {"mode": "PERMISSIVE"})["url"]
    entry = maps.select("host", "path", F.explode(url).alias("u"))
    return entry.select("host", "path", F.trim("u.loc").alias("loc"), "u.lastmod").where(F.col("loc").isNotNull() & (F.col("loc") != ""))


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """Host and sitemap address of each ``Sitemap:`` line of a robots text."""
    text = docs.where((F.col("status") == 200) & (F.col("path") == "/robots.txt"))
    return text.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap"))


def sitemap_missing(expected: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Rows of ``expected`` (host, loc) that no sitemap of the host lists."""
    return expected.join(sitemap.select("host", "loc"), ["host", "loc"], "left_anti")


def sitemap_coverage(expected: DataFrame, sitemap: DataFrame) -> DataFrame:
    """For each host whether every expected address is listed: a division, by two counts a host."""
    listed = sitemap.select("host", "loc", F.lit(True).alias("listed")).distinct()
    j = expected.select("host", "loc").distinct().join(listed, ["host", "loc"], "left")
    return j.groupBy("host").agg(F.count("*").alias("expected"), F.count("listed").alias("listed"), F.every(F.col("listed").isNotNull()).alias("covered"))


def site_checks(docs: DataFrame) -> DataFrame:
    """Host, check_name and passing of the eleven checks; a document that was not brought fails its checks.

    Of two documents of one path the one of the lower status counts.
    """
    paths = ["/", "/robots.txt", "/sitemap.xml", "/og.png", *GUIDES, WWW]
    row = F.struct("status", "content_type", "location", "body")
    site = docs.where(F.col("path").isin(paths)).groupBy("host").agg(
        *[F.min_by(row, F.when(F.col("path") == p, F.col("status"))).alias(f"d{i}") for i, p in enumerate(paths)])
    at = {p: F.col(f"d{i}") for i, p in enumerate(paths)}
    origin = F.concat(F.lit("https://"), F.col("host"))

    def ok(p: str) -> Column:
        return at[p]["status"].between(200, 299)

    def holds(p: str, *parts) -> Column:
        return at[p]["body"].contains(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))

    root = at["/"]["body"]
    canonical = F.regexp_extract_all(root, F.lit(r'<link rel="canonical" href="([^"]*)"\s*/>'), F.lit(1))
    checks = {
        "canonical": F.array_contains(canonical, F.concat(origin, F.lit("/"))),
        "description": root.rlike(r'<meta\s+name="description"'),
        "json_ld": root.contains('<script type="application/ld+json">'),
        "og_image": ok("/og.png") & at["/og.png"]["content_type"].startswith("image/"),
        "robots": ok("/robots.txt") & holds("/robots.txt", "Sitemap: ", origin, "/sitemap.xml"),
        "root": ok("/"),
        "sitemap": ok("/sitemap.xml") & F.forall(F.array(*[F.lit(p) for p in ["/", *GUIDES]]), lambda p: at["/sitemap.xml"]["body"].contains(
            F.concat(F.lit("<loc>"), origin, p, F.lit("</loc>")))),
        "www_redirect": (at[WWW]["status"] == 308) & (at[WWW]["location"] == F.concat(origin, F.lit("/"))),
    }
    for p, (name, title) in GUIDES.items():
        checks[name] = ok(p) & holds(p, f"<h1>{title}</h1>") & holds(p, 'rel="canonical" href="', origin, p + '"')
    told = [F.struct(F.lit(n).alias("check_name"), F.coalesce(c, F.lit(False)).alias("passing")) for n, c in checks.items()]
    return site.select("host", F.inline(F.array(*told)))


def site_score(checks: DataFrame, key: str = "host") -> DataFrame:
    """How many of a site's checks pass."""
    return checks.groupBy(key).agg(F.count_if("passing").cast("bigint").alias("passing"), F.count("*").cast("bigint").alias("checks"))


def submissions(urls: DataFrame, key: str, limit: int = SUBMIT_URLS) -> DataFrame:
    """Host, batch, n_urls and payload (JSON) of the submissions of each host's distinct URLs.

    No batch has more than ``limit`` URLs.  A host's URLs are dealt by hash
    into parts of half that size on average, and a part that is larger all the
    same is cut, so no list and no window grows with a host.
    """
    one = urls.select("host", "url").where(F.col("host").isNotNull() & F.col("url").isNotNull()).distinct()
    parts = one.groupBy("host").agg(F.count("*").alias("n"))
    parts = parts.select("host", F.when(F.col("n") <= limit, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / limit)).alias("parts"))
    dealt = one.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("url"), F.col("parts")))
    within = F.row_number().over(Window.partitionBy("host", "part").orderBy("url")) - 1
    dealt = dealt.withColumn("cut", F.floor(within / limit))
    made = dealt.groupBy("host", "part", "cut").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    origin = F.concat(F.lit("https://"), F.col("host"))
    payload = F.to_json(F.struct("host", F.lit(key).alias("key"), F.concat(origin, F.lit(f"/{key}.txt")).alias("keyLocation"), F.col("urls").alias("urlList")))
    batch = F.concat_ws("-", F.col("part").cast("string"), F.col("cut").cast("string"))
    return made.select("host", batch.alias("batch"), F.size("urls").alias("n_urls"), payload.alias("payload"))
