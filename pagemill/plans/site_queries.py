"""Site-health queries (P22, A07, S11, J08, K07): page checks, site checks, sitemaps and submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import admission as A
from pagemill.operators import site as W
from pagemill.plans import duck as D
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX
from pagemill.sources.tables import read_pages

# The page-level checks and the patterns that pass them.
SEO_CHECKS = [
    ("canonical", r'<link rel="canonical" href="[^"]+"\s*/?>'),
    ("description", r'<meta\s+name="description"'),
    ("json_ld", r'<script type="application/ld\+json">'),
    ("h1", r"<h1[\s>]"),
    ("title", r"<title>[^<]+</title>"),
]


@register("q_page_checks", "D17",
          "select page_id, check_name, passing from (select page_id, " +
          ", ".join(f"regexp_matches(html, {D.q(p)}) as {n}" for n, p in SEO_CHECKS) +
          " from pages) unpivot (passing for check_name in (" + ", ".join(n for n, _ in SEO_CHECKS) + "))")
def q_page_checks(spark, d):
    p = read_pages(spark, d, "page_id", "html")
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col("html").rlike(pat).alias("passing"))
                       for n, pat in SEO_CHECKS])
    return p.select("page_id", F.inline(checks))


@register("q_page_score", "D17",
          "select page_id, cast(" + " + ".join(f"(case when regexp_matches(html, {D.q(p)}) then 1 else 0 end)" for _, p in SEO_CHECKS)
          + f" as bigint) as passing, cast({len(SEO_CHECKS)} as bigint) as checks from pages")
def q_page_score(spark, d):
    c = q_page_checks(spark, d)
    return c.groupBy("page_id").agg(F.count_if("passing").cast("bigint").alias("passing"),
                                    F.count("*").cast("bigint").alias("checks"))


_HOSTS = f"""p as (
  select page_id, {D.canonical_url('url')} as loc, u_host as host from ({D.parts_cte('pages', 'url', 'page_id, url')}) where {D.rejection_reason('url')} is null
)"""
_OWN = ["/", *W.GUIDES]


def _expected(spark, d):
    p = A.admit(read_pages(spark, d, "page_id", "url"), "url").where(F.col("verdict") == "ok")
    return p.select("page_id", F.col("canon_parts.host").alias("host"), F.col("canonical_url").alias("loc"))


@register("q_sitemap_urls", "S11", f"""with {_HOSTS}, h as (select host, min(page_id) as hid from p group by host)
select host, '/sitemap-' || (page_id // 1000) || '.xml' as path, loc, '2024-01-' || lpad(cast(page_id % 28 + 1 as varchar), 2, '0') as lastmod from p where page_id % 10 <> 7
union all select host, '/sitemap.xml', 'https://' || host || x, null from h, (select unnest({_OWN}) as x) where x <> '/x-to-markdown/' or hid % 2 = 0""")
def q_sitemap_urls(spark, d):
    return W.sitemap_urls(FX.site_documents(spark, d))


@register("q_robots_sitemaps", "S11", f"""with {_HOSTS} select host, 'https://' || host || '/sitemap.xml' as sitemap from p group by host having min(page_id) % 3 <> 1""")
def q_robots_sitemaps(spark, d):
    return W.robots_sitemaps(FX.site_documents(spark, d))


@register("q_sitemap_missing", "J08", f"""with {_HOSTS} select page_id, host, loc from p where (host, loc) not in (select (host, loc) from p where page_id % 10 <> 7)""")
def q_sitemap_missing(spark, d):
    return W.sitemap_missing(_expected(spark, d), W.sitemap_urls(FX.site_documents(spark, d))).select("page_id", "host", "loc")


@register("q_sitemap_coverage", "J08 A11", f"""with {_HOSTS}, e as (select host, loc, bool_or(page_id % 10 <> 7) as l from p group by host, loc)
select host, count(*) as expected, count(*) filter (l) as listed, bool_and(l) as covered from e group by host""")
def q_sitemap_coverage(spark, d):
    return W.sitemap_coverage(_expected(spark, d), W.sitemap_urls(FX.site_documents(spark, d)))


_SITE = f"""with {_HOSTS}, h as (select host, min(page_id) as hid from p group by host), c as (
  select host, true as canonical, hid % 3 = 0 as description, hid % 4 = 0 as json_ld, hid % 7 <> 0 as og_image, hid % 3 <> 1 as robots, hid % 5 <> 4 as root,
    hid % 2 = 0 as sitemap, hid % 2 = 0 as www_redirect, true as url_guide, hid % 6 <> 0 as webpage_guide, false as x_guide from h
), u as (unpivot c on columns(* exclude host) into name check_name value passing)"""


@register("q_seo_checks", "P22 S11", f"{_SITE} select host, check_name, passing from u")
def q_seo_checks(spark, d):
    return W.site_checks(FX.site_documents(spark, d))


@register("q_seo_score", "A07", f"{_SITE} select host, count(*) filter (passing) as passing, count(*) as checks from u group by host")
def q_seo_score(spark, d):
    return W.site_score(W.site_checks(FX.site_documents(spark, d)))


@register("q_submit_payload", "K07", f"""with {_HOSTS}, g as (select host, list_sort(list(distinct loc)) as urls from p group by host)
select host, '0-0' as batch, cast(len(urls) as integer) as n_urls,
  '{{"host":"' || host || '","key":"{FX.SITE_KEY}","keyLocation":"https://' || host || '/{FX.SITE_KEY}.txt","urlList":["' || array_to_string(urls, '","') || '"]}}' as payload from g""")
def q_submit_payload(spark, d):
    return W.submissions(_expected(spark, d).withColumnRenamed("loc", "url"), FX.SITE_KEY)
