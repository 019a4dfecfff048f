"""Encyclopedia queries over payloads made of the page table's articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import documents as Dm
from pagemill.operators import encyclopedia as E
from pagemill.plans import duck as D
from pagemill.plans.doc_queries import d_text
from pagemill.plans.registry import register
from pagemill.sources.tables import read_pages


ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"


MISSING = "The page is missing."


def _payloads(spark, d):
    """Four answers a page: a parse payload with its whole article (some without a title), an error beside the article, no text, no JSON."""
    pid = F.col("page_id")
    p = read_pages(spark, d, "page_id", "html").withColumn("art", F.regexp_extract("html", ARTICLE, 1))
    title = F.when(pid % 5 == 4, F.lit("  ")).when(pid % 5 == 2, F.lit(None)).otherwise(F.concat(F.lit(" Page "), pid.cast("string")))
    parse = F.struct(title.alias("title"), F.col("art").alias("text")).alias("parse")
    answers = {"article": F.to_json(F.struct(parse)),
               "error": F.to_json(F.struct(F.struct(F.lit(MISSING).alias("info")).alias("error"), parse)),
               "no text": F.to_json(F.struct(F.struct(F.lit("No text").alias("title")).alias("parse"))),
               "broken": F.lit("{broken")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("answer"), v.alias("body")) for k, v in answers.items()])).alias("a")
    return p.select("page_id", F.concat(F.lit("Some_page_"), pid.cast("string")).alias("page_title"), each).select("page_id", "page_title", "a.*")


@register("q_wiki_payload", "S04 F08",
          f"""with a as (select page_id, regexp_extract(html, '{ARTICLE}', 1) as art from pages),
  p as (select page_id, art, unnest(['article', 'error', 'no text', 'broken']) as answer from a)
select page_id,
  case when answer = 'article' and art <> '' then case when page_id % 5 in (2, 4) then 'Some page ' else 'Page ' end || cast(page_id as varchar) end as display_title,
  case when answer = 'error' then {D.q(MISSING)} when answer <> 'article' or art = '' then {D.q(E.ERROR_NO_ARTICLE)} end as error,
  case when answer = 'article' and art <> '' then cast(octet_length(encode(art)) as bigint) end as source_bytes from p""")
def q_wiki_payload(spark, d):
    return E.parse_payload(_payloads(spark, d)).select("page_id", "display_title", "error", "source_bytes")


def _fragments(spark, d):
    """The pages' articles, followed by appendix sections of several kinds, some inside a wrapper, and bulk to strip."""
    pid = F.col("page_id")
    s = pid.cast("string")
    names = F.element_at(F.array(*[F.lit(x) for x in Dm.APPENDIX_HEADINGS]), (pid % len(Dm.APPENDIX_HEADINGS) + 1).cast("int"))
    inner = F.concat(
        F.regexp_extract("html", ARTICLE, 1),
        F.lit("<p>Lead"), s, F.lit('<sup class="reference">[1]</sup></p><table><tr><td>cell</table><h2>History</h2><p>Early days</p><h2>'),
        F.lower(names), F.lit("<span>[edit]</span></h2><p>Gone one</p><h3>Notes on maps</h3><ul><li>Gone two</ul>"),
        F.when(pid % 3 == 0, F.lit("<h2>Legacy</h2><p>Stays</p>")).otherwise(F.lit("<h4>Deep</h4><p>Gone three</p>")))
    fragment = F.when(pid % 2 == 0, F.concat(F.lit('<div class="mw-parser-output">'), inner, F.lit("</div><p>Outside</p>"))).otherwise(inner)
    return read_pages(spark, d, "page_id", "html").select("page_id", fragment.alias("fragment"), F.concat(F.lit("T & "), s).alias("display_title"))


@register("q_appendix_drop", "H07 H08 W06",
          lambda: f"""select page_id, 'T & ' || cast(page_id as varchar) || {d_text(f"regexp_extract(html, '{ARTICLE}', 1)")} || 'Lead' || cast(page_id as varchar) || 'HistoryEarly days'
    || case when page_id % 3 = 0 then 'LegacyStays' else '' end || case when page_id % 2 = 0 then 'Outside' else '' end as text_left,
  cast(case when page_id % 3 = 0 then 2 else 1 end as integer) as headings_left from pages""")
def q_appendix_drop(spark, d):
    n = E.clean_fragments(_fragments(spark, d))
    nodes = F.col("nodes")
    body = Dm._at(F.filter(nodes, lambda x: x["tag"] == "article"), 1)
    left = F.filter(nodes, lambda x: x["k"] & x["tag"].isin("h2", "h3"))
    return n.select("page_id", U.js_trim(Dm.text_of(nodes, body)).alias("text_left"), F.size(left).alias("headings_left"))
