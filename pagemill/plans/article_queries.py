"""Article-layer queries over post payloads: entity maps, inline marks, media, emoji, atomic blocks, whole documents.

The SQL never reads the payloads: it states, over the turns they are made of,
what each step must give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.urls import JS_WS
from pagemill.operators import articles as A
from pagemill.plans import duck as D
from pagemill.plans.registry import register
from pagemill.sources import fixtures as FX

_T = """t as (
  select *, conv_id || '-' || turn as name, turn % 3 = 2 as atomic, (conv_id + turn) % 6 = 5 as has_table, turn * 10 as k,
    case when (conv_id + turn) % 4 = 0 then chr(128512) || ' ' || text else text end as btext,
    case when turn % 3 = 2 then 'atomic' when role = 'system' then 'header-one'
      when role = 'user' then case when turn % 4 < 2 then 'ordered-list-item' else 'blockquote' end
      when turn % 3 = 0 then 'unstyled' else 'code-block' end as type
  from conversations where conv_id % 5 <> 4 and conv_id % 11 <> 10
)"""

_E = """e as (
  select conv_id, turn, k + 0 as key, 'LINK' as type, case when turn % 4 <> 3 then 'https://link.example/' || name end as url from t
  union all select conv_id, turn, k + 1, 'MEDIA', 'https://own.example/' || name from t
  union all select conv_id, turn, k + 2, 'TWEMOJI', 'https://emoji.example/' || case when turn % 2 = 0 then '72x72/1f468-200d-1f469.svg?x=1' else '72x72/smile.svg' end from t
  union all select conv_id, turn, k + 3, 'MARKDOWN', null from t
)"""

# characters with their first UTF-16 offset (p) and the offset after them (q)
_CH = """ch as (
  select conv_id, turn, i, c, sum(w) over o - w as p, sum(w) over o as q
  from (select *, case when ord(c) > 65535 then 2 else 1 end as w
        from (select conv_id, turn, unnest(range(1, len(cs) + 1)) as i, unnest(cs) as c
              from (select conv_id, turn, string_split(btext, '') as cs from t where btext <> '')))
  window o as (partition by conv_id, turn order by i)
), size as (
  select t.conv_id, t.turn, coalesce(max(q), 0) as n from t left join ch using (conv_id, turn) group by t.conv_id, t.turn
)"""

_MARKS = """m as (
  select conv_id, turn, s.start, s.stop, s.priority, s.opens, s.closes
  from t, (values (0, 4, 20, '**', '**'), (0, 8, 30, '_', '_'), (2, 5, 60, '`', '`'), (4, 9, 50, '~~', '~~'), (3, 100003, 40, '<u>', '</u>')) s(start, stop, priority, opens, closes)
  union all select conv_id, turn, 5, 13, 10, '[', '](' || url || ')' from e where type = 'LINK' and url is not null
)"""

_INLINE = """mv as (
  select m.* from m join size using (conv_id, turn) where stop <= n
), ends as (
  select conv_id, turn, stop as at, string_agg(closes, '' order by start desc, priority desc) as x from mv group by 1, 2, 3
), begins as (
  select conv_id, turn, start as at, string_agg(opens, '' order by stop desc, priority) as x from mv group by 1, 2, 3
), body as (
  select ch.conv_id, ch.turn, string_agg(coalesce(a.x, '') || coalesce(b.x, '') || c, '' order by i) as x
  from ch left join ends a on a.conv_id = ch.conv_id and a.turn = ch.turn and a.at = ch.p
          left join begins b on b.conv_id = ch.conv_id and b.turn = ch.turn and b.at = ch.p group by 1, 2
), inl as (
  select t.conv_id, t.turn, coalesce(body.x, '') || coalesce(fin.x, '') as inline
  from t left join body on body.conv_id = t.conv_id and body.turn = t.turn
         left join size on size.conv_id = t.conv_id and size.turn = t.turn
         left join ends fin on fin.conv_id = t.conv_id and fin.turn = t.turn and fin.at = size.n
)"""

_MEDIA = """md as (
  select conv_id, 'm' || name as id, case when turn % 4 = 0 then 'https://img.example/' || name || '.jpg' end as image,
    case when turn % 4 = 2 then 'https://v.example/' || name end as video from t where turn % 2 = 0
  union all select distinct conv_id, 'cover' || conv_id, 'https://cover.example/' || conv_id || '.jpg', null from t where conv_id % 3 <> 1
), item as (
  select conv_id, turn, k + 1 as key, 0 as item, 'm' || name as id from t union all select conv_id, turn, k + 1, 1, 'cover' || conv_id from t
), ml as (
  select conv_id, key, item * 2 as line_no, '![Cap \\[c\\]](' || image || ')' as line from item join md using (conv_id, id) where image is not null
  union all select conv_id, key, item * 2 + 1, '[Video](' || video || ')' from item join md using (conv_id, id) where video is not null
), mline as (
  select conv_id, key, cast(row_number() over (partition by conv_id, key order by line_no) - 1 as integer) as line_no, line from ml
  union all select conv_id, key, 0, '![Cap \\[c\\]](' || url || ')' from e where type = 'MEDIA' and (conv_id, key) not in (select (conv_id, key) from ml)
)"""

_ATOMIC = f"""al as (
  select conv_id, turn, 0 as line_no, '| a |' || chr(10) || '| b |' as line from t where atomic and has_table
  union all select t.conv_id, turn, line_no, line from t join mline on mline.conv_id = t.conv_id and mline.key = t.k + 1 where atomic and not has_table
  union all select conv_id, turn, 1000, chr(128104) || chr(8205) || chr(128105) from t where atomic and not has_table and turn % 2 = 0
), aline as (
  select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by line_no) - 1 as integer) as line_no, line from al
)"""

_HEADS = f"with {_T},\n{_E}"


def _entities(spark, d):
    df = A.read_payloads(FX.post_payloads(spark, d))
    return A.resolved_entities(df.where(F.col("article").isNotNull()))


@register("q_post_payload", "X01 S05 X20",
          """select conv_id, case when conv_id % 11 = 10 then 'invalid_json' end as error, case when conv_id % 11 <> 10 then 'user' || conv_id end as screen_name,
  conv_id % 11 <> 10 and conv_id % 5 <> 4 as is_article, cast(case when conv_id % 11 <> 10 and conv_id % 5 <> 4 then count(*) else 0 end as integer) as blocks
from conversations group by conv_id""")
def q_post_payload(spark, d):
    df = A.read_payloads(FX.post_payloads(spark, d))
    return df.select("conv_id", "error", "screen_name", F.col("article").isNotNull().alias("is_article"),
                     F.size(A._list(F.col("article"), "$.content.blocks")).alias("blocks"))


@register("q_entity_map", "X06 F18", f"{_HEADS} select conv_id, cast(key as double) as key, type, url from e")
def q_entity_map(spark, d):
    df = A.read_payloads(FX.post_payloads(spark, d))
    df = A.entity_map(df.where(F.col("article").isNotNull()))
    return df.select("conv_id", F.explode("entities").alias("key", "e")).select("conv_id", "key", "e.type", "e.url")


@register("q_decorations", "X07 X08 E02",
          f"{_HEADS}, {_MARKS} select conv_id, turn, cast(start as double) as start, cast(stop as double) as stop, priority, opens, closes from m")
def q_decorations(spark, d):
    b = A.blocks_of(_entities(spark, d), "conv_id")
    m = b.select("conv_id", F.col("pos").cast("long").alias("turn"), F.explode(A.decorations(F.col("styles"), F.col("ranges"))).alias("m"))
    return m.select("conv_id", "turn", "m.start", F.col("m.end").alias("stop"), "m.priority", F.col("m.open").alias("opens"), F.col("m.close").alias("closes"))


@register("q_inline", "X09 T02", f"{_HEADS}, {_CH}, {_MARKS}, {_INLINE} select conv_id, turn, inline from inl")
def q_inline(spark, d):
    b = A.render_inline(A.blocks_of(_entities(spark, d), "conv_id"))
    return b.select("conv_id", F.col("pos").cast("long").alias("turn"), "inline")


@register("q_media_join", "X10 X11 J05", f"{_HEADS}, {_MEDIA} select conv_id, cast(key as double) as key, item, id, image, video from item left join md using (conv_id, id)")
def q_media_join(spark, d):
    df = A.entity_map(A.media_map(A.read_payloads(FX.post_payloads(spark, d)).where(F.col("article").isNotNull())))
    items = df.select("conv_id", "media", F.explode("entities").alias("key", "e")).where("e.type = 'MEDIA'")
    items = items.select("conv_id", "key", "media", F.posexplode("e.items").alias("item", "id"))
    return items.select("conv_id", "key", "item", "id", F.try_element_at("media", F.col("id"))["image"].alias("image"),
                        F.try_element_at("media", F.col("id"))["video"].alias("video"))


@register("q_media_lines", "X13 F03", f"{_HEADS}, {_MEDIA} select conv_id, cast(key as double) as key, line_no, line from mline")
def q_media_lines(spark, d):
    e = _entities(spark, d).select("conv_id", F.explode("entities").alias("key", "e"))
    return e.select("conv_id", "key", F.posexplode("e.lines").alias("line_no", "line"))


@register("q_emoji", "X14", f"{_HEADS} select conv_id, cast(key as double) as key, case when turn % 2 = 0 then chr(128104) || chr(8205) || chr(128105) end as emoji "
          "from e where type = 'TWEMOJI'")
def q_emoji(spark, d):
    e = _entities(spark, d).select("conv_id", F.explode("entities").alias("key", "e"))
    return e.where("e.type = 'TWEMOJI'").select("conv_id", "key", "e.emoji")


@register("q_atomic", "X15", f"{_HEADS}, {_MEDIA}, {_ATOMIC} select conv_id, turn, line_no, line from aline")
def q_atomic(spark, d):
    b = A.blocks_of(_entities(spark, d), "conv_id").where("type = 'atomic'")
    return b.select("conv_id", F.col("pos").cast("long").alias("turn"), F.posexplode(A.atomic_lines(F.col("text"), F.col("ranges"))).alias("line_no", "line"))


def _article_sql():
    trim_end = lambda x: f"regexp_replace({x}, '[{JS_WS}]+$', '')"
    # a blockquote, code block or other block with text in it, after the block's kind of line
    indent = "repeat('  ', cast(turn % 3 as integer))"
    return f"""{_HEADS}, {_CH}, {_MARKS}, {_INLINE}, {_MEDIA}, {_ATOMIC}, run as (
  select t.*, inline, lag(t.type) over w as prev, sum(case when t.type = lag_type then 0 else 1 end) over w as run
  from (select *, lag(type) over (partition by conv_id order by turn) as lag_type from t) t join inl using (conv_id, turn)
  window w as (partition by t.conv_id order by turn)
), num as (
  select *, row_number() over (partition by conv_id, run order by turn) as n from run
), line as (
  select conv_id, turn, type, prev, type = 'ordered-list-item' as is_list, case type
    when 'atomic' then coalesce((select string_agg(line, chr(10) || chr(10) order by line_no) from aline a where (a.conv_id, a.turn) = (num.conv_id, num.turn)), '')
    when 'ordered-list-item' then {indent} || n || '. ' || inline
    when 'header-one' then {trim_end("'## ' || inline")}
    when 'blockquote' then {trim_end("'> ' || replace(inline, chr(10), chr(10) || '> ')")}
    when 'code-block' then {trim_end("'```' || chr(10) || btext || chr(10) || '```'")}
    else {trim_end("inline")} end as line
  from num
), kept as (
  select *, lag(turn) over (partition by conv_id order by turn) is not null and (not is_list or prev <> type) as gap from line where is_list or line <> ''
), whole as (
  select conv_id, {D.js_trim("regexp_replace(string_agg(case when gap then chr(10) else '' end || line, chr(10) order by turn), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} as body
  from kept group by conv_id
), d as (
  select conv_id, count(*) as n, min_by(text, turn) as first, conv_id % 5 <> 4 as art, 'user' || conv_id as usr,
    case when conv_id % 4 <> 0 then 'Person ' || conv_id || ' (@user' || conv_id || ')' else '@user' || conv_id end as author,
    case when conv_id % 5 = 4 then 'Post by @user' || conv_id when conv_id % 7 = 0 then '{A.P.UNTITLED_ARTICLE}' else 'Title ' || conv_id end as title
  from conversations where conv_id % 11 <> 10 group by conv_id
)
select d.conv_id, author, title, cast(case when art then n else 0 end as integer) as block_count, cast(case when art then 4 * n else 0 end as integer) as entity_count, cast(null as varchar) as error,
  {D.js_trim("concat_ws(chr(10) || chr(10), '# ' || title, case when not art then '**' || author || '**' end, case when art and d.conv_id % 3 <> 1 then '![Cover image](https://cover.example/' || d.conv_id || '.jpg)' end, case when art then coalesce(nullif(body, ''), 'Preview') else nullif(" + D.js_trim("first") + ", '') end, case when not art then '![Alt](https://img.example/' || d.conv_id || '.jpg)' end)")} || chr(10) as markdown
from d left join whole using (conv_id)
union all select distinct conv_id, null, null, 0, 0, 'invalid_json', null from conversations where conv_id % 11 = 10"""


@register("q_article", "X05 X16 X20 H13", _article_sql)
def q_article(spark, d):
    return A.convert_posts(FX.post_payloads(spark, d), "conv_id")


@register("q_block_counts", "X20",
          """select conv_id, cast(case when conv_id % 5 = 4 then 0 else count(*) end as integer) as block_count,
  cast(case when conv_id % 5 = 4 then 0 else 4 * count(*) end as integer) as entity_count
from conversations where conv_id % 11 <> 10 group by conv_id""")
def q_block_counts(spark, d):
    return A.convert_posts(FX.post_payloads(spark, d), "conv_id").where("error is null").select("conv_id", "block_count", "entity_count")
