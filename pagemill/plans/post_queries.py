"""Post-layer queries: list numbering, block lines, article assembly,
best video variant, plain post rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.urls import JS_WS
from pagemill.operators import posts as X
from pagemill.plans import duck as D
from pagemill.plans import oracle_fixtures as OF
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX
from pagemill.sources.tables import read_table


def _blocks(spark, d):
    return FX.post_blocks(spark, d).withColumnRenamed("conv_id", "doc_id").withColumnRenamed("turn", "pos")


_NUM = f"""
n as (
  select *, case when type = 'ordered-list-item' then row_number() over (partition by conv_id, run order by turn) end as list_number
  from (select *, sum(case when prev is null or prev <> type then 1 else 0 end)
                  over (partition by conv_id order by turn rows between unbounded preceding and current row) as run
        from (select *, lag(type) over (partition by conv_id order by turn) as prev from ({OF.POST_BLOCKS})))
)"""

_LINE = """(case when type = 'header-one' then '## ' || text
  when type = 'ordered-list-item' then repeat('  ', cast(greatest(depth, 0) as integer)) || cast(list_number as varchar) || '. ' || text
  when type = 'unordered-list-item' then repeat('  ', cast(greatest(depth, 0) as integer)) || '- ' || text
  when type = 'blockquote' then '> ' || replace(text, chr(10), chr(10) || '> ')
  when type = 'code-block' then '```' || chr(10) || text || chr(10) || '```'
  else text end)"""

_IS_LIST = "type in ('ordered-list-item', 'unordered-list-item')"
_LINES = f"""{_NUM},
l0 as (select *, case when {_IS_LIST} then {_LINE} else regexp_replace({_LINE}, '[{JS_WS}]+$', '') end as line from n),
l1 as (select *, {_IS_LIST} or line <> '' as keep from l0),
l as (select *, case when {_IS_LIST} then has_out and coalesce(prev, '') <> type else has_out end as blank_before
      from (select *, coalesce(sum(cast(keep as integer)) over (partition by conv_id order by turn
                     rows between unbounded preceding and 1 preceding), 0) > 0 as has_out from l1))"""


@register("q_list_numbers", "X17 W01", f"with {_NUM.strip()} select conv_id, turn, list_number from n")
def q_list_numbers(spark, d):
    n = X.number_lists(_blocks(spark, d), "doc_id", "pos")
    return n.select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), "list_number")


@register("q_block_lines", "X16 X18 F06 W02",
          f"with {_LINES.strip()} select conv_id, turn, line, blank_before from l where keep")
def q_block_lines(spark, d):
    r = X.render_blocks(_blocks(spark, d), "doc_id", "pos").where("keep")
    return r.select(F.col("doc_id").alias("conv_id"), F.col("pos").alias("turn"), "line", "blank_before")


@register("q_article_markdown", "X19 F04 F05",
          f"""with {_LINES.strip()}
select conv_id, count(*) as lines,
  {D.js_trim("regexp_replace(string_agg(case when blank_before then chr(10) else '' end || line, chr(10) order by turn), '\\n{3,}', chr(10) || chr(10), 'g')")} as markdown
from l where keep group by conv_id""")
def q_article_markdown(spark, d):
    r = X.render_blocks(_blocks(spark, d), "doc_id", "pos")
    return X.assemble(r, "doc_id", "pos").select(F.col("doc_id").alias("conv_id"), "lines", "markdown")


@register("q_best_variant", "X12 T03",
          f"""select media_id, url from (select *, row_number() over (partition by media_id
  order by coalesce(bit_rate, 0) desc, variant_id asc) as rn from ({OF.MEDIA_VARIANTS}) where contains(content_type, 'video')) where rn = 1""")
def q_best_variant(spark, d):
    return X.best_variant(FX.media_variants(spark, d))


def _posts(spark, d):
    c = read_table(spark, d, "conversations")
    cid = F.col("conv_id").cast("string")
    media = (F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("photo").alias("type"),
                     F.concat(F.lit("https://img.example.org/"), cid, F.lit(".jpg")).alias("url"),
                     F.concat(F.lit("Figure "), cid).alias("alt"))))
             .when(F.col("conv_id") % 3 == 1, F.array(F.struct(F.lit("video").alias("type"),
                   F.concat(F.lit("https://video.example.org/"), cid, F.lit(".mp4")).alias("url"),
                   F.lit(None).cast("string").alias("alt"))))
             .otherwise(F.array(F.struct(F.lit("photo").alias("type"), F.lit(None).cast("string").alias("url"),
                                         F.lit("no url").alias("alt")))))
    return c.select(
        "conv_id", "turn", "text", media.alias("media"),
        F.when(F.col("conv_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("Person "), cid)).alias("name"),
        F.when(F.col("conv_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("user"), cid)).alias("screen_name"),
    )


def _post_sql():
    cid = "cast(conv_id as varchar)"
    name = f"(case when conv_id % 4 = 0 then null else 'Person ' || {cid} end)"
    user = f"(case when conv_id % 5 = 0 then null else 'user' || {cid} end)"
    author = (f"(case when coalesce({name}, '') <> '' then {name} || case when coalesce({user}, '') <> '' "
              f"then ' (@' || {user} || ')' else '' end when coalesce({user}, '') <> '' then '@' || {user} end)")
    title = f"(case when coalesce({user}, '') <> '' then 'Post by @' || {user} else 'X Post' end)"
    media = (f"(case when conv_id % 3 = 0 then '![Figure ' || {cid} || '](https://img.example.org/' || {cid} || '.jpg)' "
             f"when conv_id % 3 = 1 then '[Video](https://video.example.org/' || {cid} || '.mp4)' end)")
    text = D.js_trim("coalesce(text, '')")
    body = (f"concat_ws(chr(10) || chr(10), '# ' || {title}, '**' || {author} || '**', "
            f"case when {text} <> '' then {text} end, {media})")
    return (f"select conv_id, turn, {title} as title, {author} as author, {D.js_trim(body)} || chr(10) as markdown "
            f"from conversations")


@register("q_post_markdown", "X02 X03 X04 D10 D18", _post_sql)
def q_post_markdown(spark, d):
    return X.render_post(_posts(spark, d)).select("conv_id", "turn", "title", "author", "markdown")
