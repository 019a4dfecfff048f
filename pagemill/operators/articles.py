"""Posts and articles from provider payloads.

A payload is a JSON text.  It is read as VARIANT, since its parts vary in type:
the entity map is an array or an object, and a field of another type than
expected counts as absent.  A document's entities and media become maps of the
document's row (in both a later entry wins), and each block's ranges take
their entities from there, so no join is needed; then a block is a row.
Inline styles are a sweep over interval events on UTF-16 offsets, the unit in
which the ranges are written.

A payload that is not JSON, or in which an object has a key twice, gives a
row with an error; so does one without a post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import js_trim
from pagemill.operators import posts as P
from pagemill.operators.staging import stage

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference service's behaviour.
# ---------------------------------------------------------------------------
# style → (marker before, marker after, priority)
STYLES = {
    "Bold": ("**", "**", 20),
    "Italic": ("_", "_", 30),
    "Underline": ("<u>", "</u>", 40),
    "Strikethrough": ("~~", "~~", 50),
    "Code": ("`", "`", 60),
    "Monospace": ("`", "`", 60),
}
LINK_PRIORITY = 10
MEDIA_TYPES = ("MEDIA", "IMAGE")
EMOJI_FILE = r"(?i)/([0-9a-f-]+)\.(?:svg|png)(?:\z|\?)"
# ---------------------------------------------------------------------------

ERROR_JSON = "invalid_json"
ERROR_NO_POST = "no_post"


# ------------------------------------------------------------- typed access
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _list(v: Column, path: str) -> Column:
    """Elements of an array (empty if there is none)."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(_at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(_at(v, path)).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, path, "double"))


def _record(v: Column) -> Column:
    """``v`` if it is an object or an array."""
    return F.when(_kind(v).rlike("^(OBJECT|ARRAY)"), v)


def _number_of(text: Column) -> Column:
    """The finite number that a string stands for: decimal or hexadecimal, blank is 0; else null."""
    t = js_trim(text)
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
            .when(t.rlike("^0[xX][0-9a-fA-F]{1,13}$"), F.conv(F.substring(t, 3, 13), 16, 10).cast("double")))


def _key_of(v: Column) -> Column:
    """The number an entity's key stands for (null, an empty text and false are 0; none: null)."""
    kind = _kind(v)
    return (F.when(kind == "VOID", F.lit(0.0))
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
            .when(kind == "STRING", _number_of(F.try_variant_get(v, "$", "string")))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(v, "$", "double")))


def _last_of_each(df: DataFrame, entries: str, out: str, value) -> DataFrame:
    """Map ``out`` from the array ``entries`` of structs with ``key`` (and ``rank``): of equal keys the last stays."""
    e = F.col(entries)
    df = stage(df, _order=F.array_sort(F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), x["rank"].alias("rank"), i.alias("i")))))
    order = F.col("_order")
    last = F.filter(order, lambda x, j: (j == F.size(order) - 1) | (F.get(order, j + 1)["key"] != x["key"]))
    return stage(df, **{out: F.map_from_entries(F.transform(last, lambda x: F.struct(
        x["key"].alias("key"), value(F.get(e, x["i"])).alias("value"))))}).drop("_order")


# ------------------------------------------------------------------ payload
def read_payloads(posts: DataFrame, payload: str = "payload") -> DataFrame:
    """``tweet`` (the post as VARIANT), ``error``, ``article`` and the author's names."""
    df = stage(posts, _root=F.try_parse_json(F.col(payload)))
    df = stage(df, tweet=_record(_at(F.col("_root"), "$.tweet")))
    t = F.col("tweet")
    return stage(df, article=_record(_at(t, "$.article")), name=_string(t, "$.author.name"), screen_name=_string(t, "$.author.screen_name"),
                 error=F.when(F.col("_root").isNull(), F.lit(ERROR_JSON)).when(t.isNull(), F.lit(ERROR_NO_POST))).drop("_root")


# ----------------------------------------------------------------- entities
def _media(v: Column) -> Column:
    """Id, image and best video of a media object."""
    variants = F.filter(F.transform(_list(v, "$.media_info.variants"), lambda x, i: F.struct(
        (-F.coalesce(_number(x, "$.bit_rate"), F.lit(0.0))).alias("rate"), i.alias("i"),
        _string(x, "$.content_type").alias("kind"), _string(x, "$.url").alias("url"))), lambda x: x["kind"].contains("video"))
    image = F.coalesce(_string(v, "$.media_info.original_img_url"), _string(v, "$.media_info.preview_image.original_img_url"))
    return F.struct(_string(v, "$.media_id").alias("key"), F.nullif(image, F.lit("")).alias("image"),
                    F.nullif(F.get(F.array_sort(variants), F.lit(0))["url"], F.lit("")).alias("video"))


def media_map(articles: DataFrame) -> DataFrame:
    """X11: ``media``, from media id to image and video; the cover comes last, so it wins."""
    a = F.col("article")
    cover = F.filter(F.array(_at(a, "$.cover_media")), lambda x: x.isNotNull())
    df = stage(articles, _media_list=F.transform(F.concat(_list(a, "$.media_entities"), cover), _media))
    df = stage(df, _media_list=F.filter(F.transform(F.col("_media_list"), lambda m, i: m.withField("rank", i)), lambda m: m["key"] != ""))
    df = _last_of_each(df, "_media_list", "media", lambda m: F.struct(m["image"].alias("image"), m["video"].alias("video"))).drop("_media_list")
    return stage(df, cover=_media(_at(a, "$.cover_media"))["image"])


def _entity(v: Column) -> Column:
    items = F.transform(_list(v, "$.data.mediaItems"), lambda x: F.coalesce(_string(x, "$.mediaId"), _string(x, "$.media_id")))
    return F.struct(_string(v, "$.type").alias("type"), F.nullif(_string(v, "$.data.url"), F.lit("")).alias("url"),
                    js_trim(F.coalesce(_string(v, "$.data.caption"), F.lit(""))).alias("caption"),
                    F.nullif(js_trim(_string(v, "$.data.markdown")), F.lit("")).alias("markdown"), items.alias("items"))


def entity_map(articles: DataFrame) -> DataFrame:
    """``entities``, from number to entity.

    The map is an array of {key, value}, or an object whose values are such
    wrappers or the entities themselves.  Keys that are no number, and values
    that are no record, are left out.  Of equal keys the last wins; in an
    object whole numbers come first, by size, then the other names.
    """
    m = _at(F.col("article"), "$.content.entityMap")
    listed = F.transform(F.try_variant_get(m, "$", "array<variant>"), lambda x, i: F.struct(
        _key_of(_at(x, "$.key")).alias("key"), F.struct(F.lit(0).alias("other"), i.cast("double").alias("at"), F.lit("").alias("name")).alias("rank"),
        _record(_at(x, "$.value")).alias("entity")))
    whole = lambda k: k.rlike("^(0|[1-9][0-9]{0,8})$")
    named = F.transform(F.map_entries(F.try_variant_get(m, "$", "map<string,variant>")), lambda x: F.struct(
        F.when(F.coalesce(_kind(_at(x["value"], "$.key")), F.lit("VOID")) == "VOID", _number_of(x["key"]))
        .otherwise(_key_of(_at(x["value"], "$.key"))).alias("key"),
        F.struct(F.when(whole(x["key"]), 0).otherwise(1).alias("other"), F.coalesce(F.when(whole(x["key"]), x["key"].cast("double")), F.lit(0.0)).alias("at"),
                 x["key"].alias("name")).alias("rank"),
        F.coalesce(_record(_at(x["value"], "$.value")), _record(x["value"])).alias("entity")))
    none = "array<struct<key:double,rank:struct<other:int,at:double,name:string>,entity:variant>>"
    df = stage(articles, _entries=F.coalesce(listed, named, F.array().cast(none)))
    df = stage(df, _entries=F.filter("_entries", lambda x: x["key"].isNotNull() & x["entity"].isNotNull()))
    return _last_of_each(df, "_entries", "entities", lambda x: _entity(x["entity"])).drop("_entries")


def emoji(type_: Column, url: Column) -> Column:
    """The characters named by the hexadecimal code points of an emoji's file; null if one is no code point."""
    parts = F.transform(F.split(F.lower(F.regexp_extract(url, EMOJI_FILE, 1)), "-"), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    # parts of the surrogate range stand for no character
    parts = F.transform(parts, lambda x: F.when(x.rlike("^d[89a-f]..$"), F.lit("fffd")).otherwise(x))
    ok = F.forall(parts, lambda x: x.rlike("^([0-9a-f]{1,5}|10[0-9a-f]{4})$"))
    text = F.decode(F.unhex(F.array_join(F.transform(parts, lambda x: F.lpad(x, 8, "0")), "")), "UTF-32")
    return F.when((type_ == "TWEMOJI") & url.rlike(EMOJI_FILE), F.when(ok, text))


def caption_escape(text: Column) -> Column:
    """brackets of an image's caption."""
    return F.regexp_replace(text, r"([\[\]])", r"\\$1")


def media_lines(entity: Column, media: Column) -> Column:
    """Image and video line of each media item; without any, the entity's own address as an image."""
    def image(url):
        return F.concat(F.lit("!["), caption_escape(entity["caption"]), F.lit("]("), url, F.lit(")"))

    def lines(item):
        m = F.when(item != "", F.try_element_at(media, item))
        return F.filter(F.array(image(m["image"]), F.concat(F.lit("[Video]("), m["video"], F.lit(")"))), lambda x: x.isNotNull())

    found = F.flatten(F.transform(entity["items"], lines))
    own = F.filter(F.array(image(entity["url"])), lambda x: x.isNotNull())
    return F.when(entity["type"].isin(*MEDIA_TYPES), F.when(F.size(found) > 0, found).otherwise(own)).otherwise(F.array().cast("array<string>"))


def resolved_entities(articles: DataFrame) -> DataFrame:
    """``entities`` with each entity's media lines and emoji, once an entity."""
    df = entity_map(media_map(articles))
    df = stage(df, entities=F.transform_values("entities", lambda k, e: e.withField("lines", media_lines(e, F.col("media")))))
    return stage(df, entities=F.transform_values("entities", lambda k, e: F.struct(
        e["type"].alias("type"), e["url"].alias("url"), e["markdown"].alias("markdown"), e["lines"].alias("lines"),
        emoji(e["type"], e["url"]).alias("emoji"))))


# ------------------------------------------------------------------- blocks
def blocks_of(articles: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row a block: ``keep``, pos, type, text, depth, styles and ranges with their entities.

    ``outer``: a row (pos is null) also for a document without blocks.
    """
    def styles(b):
        return F.transform(_list(b, "$.inlineStyleRanges"), lambda r: F.struct(
            _number(r, "$.offset").alias("offset"), _number(r, "$.length").alias("length"), _string(r, "$.style").alias("style")))

    def ranges(b):
        return F.transform(_list(b, "$.entityRanges"), lambda r: F.struct(
            _number(r, "$.offset").alias("offset"), _number(r, "$.length").alias("length"),
            F.try_element_at(F.col("entities"), _number(r, "$.key")).alias("entity")))

    blocks = _list(F.col("article"), "$.content.blocks")
    df = articles.select(*keep, "entities", (F.posexplode_outer if outer else F.posexplode)(blocks).alias("pos", "_b"))
    b = F.col("_b")
    return stage(df, type=F.coalesce(_string(b, "$.type"), F.lit("unstyled")), text=F.coalesce(_string(b, "$.text"), F.lit("")),
                 depth=F.coalesce(_number(b, "$.data.depth"), F.lit(0.0)).cast("int"), styles=styles(b), ranges=ranges(b)).drop("_b", "entities")


def decorations(styles: Column, ranges: Column) -> Column:
    """The marks of a block's styles, then those of its links: from, to, priority, open, close."""
    def made(r, mark):
        ok = (r["length"] > 0) & r["offset"].isNotNull() & mark["open"].isNotNull()
        return F.when(ok, F.struct(r["offset"].alias("start"), (r["offset"] + r["length"]).alias("end"), mark["priority"].alias("priority"),
                                   mark["open"].alias("open"), mark["close"].alias("close")))

    def of_style(r):
        pick = lambda i: F.coalesce(*[F.when(r["style"] == s, F.lit(v[i])) for s, v in STYLES.items()])
        return made(r, {"open": pick(0), "close": pick(1), "priority": pick(2)})

    def of_link(r):
        e = r["entity"]
        link = (e["type"] == "LINK") & e["url"].isNotNull()
        return made(r, {"open": F.when(link, F.lit("[")), "close": F.concat(F.lit("]("), e["url"], F.lit(")")), "priority": F.lit(LINK_PRIORITY)})

    return F.filter(F.concat(F.transform(styles, of_style), F.transform(ranges, of_link)), lambda d: d.isNotNull())


def _utf16_slice(units: Column, start: Column, end: Column) -> Column:
    """Text of the UTF-16 units (big-endian bytes) from ``start`` to ``end``; half of a pair becomes U+FFFD."""
    part = F.substring(units, start * 2 + 1, (end - start) * 2)
    half = F.lit(b"\xff\xfd")
    part = F.when(F.hex(F.substring(part, 1, 1)).rlike("^D[C-F]"), F.concat(half, F.substring(units, start * 2 + 3, (end - start) * 2 - 2))).otherwise(part)
    last = F.hex(F.substring(units, end * 2 - 1, F.when(end > start, 1).otherwise(0)))
    part = F.when(last.rlike("^D[89AB]"), F.concat(F.substring(part, F.lit(1), (end - start) * 2 - 2), half)).otherwise(part)
    return F.decode(part, "UTF-16BE")


def render_inline(blocks: DataFrame, out: str = "inline") -> DataFrame:
    """``text`` with the marks of ``styles`` and ``ranges``.

    Marks are events of a sweep over the text: at one place those that end
    come first, the latest begun and of these the highest priority before
    others, then those that begin, the longest and of these the lowest
    priority before others.  Marks that leave the text are dropped.  A mark at
    a place between the units of one character cuts it in two U+FFFD.
    """
    df = stage(blocks, _units=F.encode("text", "UTF-16BE"), _marks=decorations(F.col("styles"), F.col("ranges")))
    units = F.col("_units")
    length = F.octet_length(units) / 2
    df = stage(df, _marks=F.filter("_marks", lambda d: (d["start"] >= 0) & (d["end"] <= length)))

    def event(at, kind, other, priority, i, token):
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), (-other).alias("other"), priority.alias("priority"), i.alias("i"), token.alias("token"))

    marks = F.col("_marks")
    events = F.concat(F.transform(marks, lambda d, i: event(d["end"], 0, d["start"], -d["priority"], i, d["close"])),
                      F.transform(marks, lambda d, i: event(d["start"], 1, d["end"], d["priority"], i, d["open"])))
    df = stage(df, _events=F.array_sort(F.filter(events, lambda e: e["at"] == F.floor(e["at"]))))
    ev = F.col("_events")

    def piece(e, i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(ev, i - 1)["at"].cast("int"))
        return F.concat(_utf16_slice(units, begin, e["at"].cast("int")), e["token"])

    df = stage(df, _pieces=F.transform(ev, piece))
    tail = _utf16_slice(units, F.get(ev, F.size(ev) - 1)["at"].cast("int"), length.cast("int"))
    df = stage(df, **{out: F.when(F.size(ev) == 0, F.col("text")).otherwise(F.concat(F.array_join("_pieces", ""), tail))})
    return df.drop("_units", "_marks", "_events", "_pieces")


def atomic_lines(text: Column, ranges: Column) -> Column:
    """Of an atomic block embedded Markdown alone; else media lines and emoji; else its text."""
    entities = F.filter(F.transform(ranges, lambda r: r["entity"]), lambda e: e.isNotNull())
    embedded = F.filter(F.transform(entities, lambda e: F.when(e["type"] == "MARKDOWN", F.replace(e["markdown"], F.lit("\r\n"), F.lit("\n")))),
                        lambda x: x.isNotNull())
    lines = F.flatten(F.transform(entities, lambda e: F.when(F.size(e["lines"]) > 0, e["lines"]).when(
        F.coalesce(e["emoji"], F.lit("")) != "", F.array(e["emoji"])).otherwise(F.array().cast("array<string>"))))
    own = js_trim(text)
    return (F.when(F.size(embedded) > 0, embedded).when(F.size(lines) > 0, lines)
            .when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")))


def rendered_blocks(articles: DataFrame, doc: str, *keep: str) -> DataFrame:
    """X16 over payload blocks: each block's line, atomic blocks included; a row also for a document without blocks."""
    b = render_inline(blocks_of(articles, doc, *keep, outer=True))
    b = stage(b, type=F.when(F.col("pos").isNotNull(), F.col("type")))
    b = stage(b, atomic=F.when(F.col("type") == P.ATOMIC, atomic_lines(F.col("text"), F.col("ranges"))))
    return P.render_blocks(b.drop("styles", "ranges"), doc, "pos")


def convert_posts(posts: DataFrame, doc: str, payload: str = "payload") -> DataFrame:
    """``doc``, author, title, markdown, block_count, entity_count and error of each payload.

    ``doc`` must tell the rows apart.  One pass: what a document is apart from
    its blocks travels with them, and a document without blocks is one row.
    """
    df = read_payloads(posts.select(doc, payload), payload).drop(payload)
    t, a = F.col("tweet"), F.col("article")
    media = F.transform(_list(t, "$.media"), lambda m: F.struct(_string(m, "$.type").alias("type"), _string(m, "$.url").alias("url"),
                                                                _string(m, "$.altText").alias("alt")))
    df = P.render_post(stage(df, text=_string(t, "$.text"), media=media)).withColumnRenamed("markdown", "_post")
    df = resolved_entities(df.drop("text", "media"))
    is_post, ok = a.isNull() & F.col("error").isNull(), F.col("error").isNull()
    title = F.when(is_post, F.col("title")).otherwise(F.coalesce(F.nullif(js_trim(_string(a, "$.title")), F.lit("")), F.lit(P.UNTITLED_ARTICLE)))
    df = stage(df, _head=F.struct(
        F.when(ok, F.col("author")).alias("author"), F.when(ok, title).alias("title"), F.when(is_post, F.col("_post")).alias("post"), "cover", "error",
        F.nullif(js_trim(_string(a, "$.preview_text")), F.lit("")).alias("preview"),
        F.size(_list(a, "$.content.blocks")).alias("block_count"), F.size("entities").alias("entity_count")))
    lines = rendered_blocks(df, doc, "_head")
    piece = F.concat(F.when(F.col("blank_before"), F.lit("\n")).otherwise(F.lit("")), F.col("line"))
    whole = lines.groupBy(doc).agg(F.any_value("_head").alias("_head"),
                                   F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("pos", piece.alias("p"))))).alias("ps"))
    h = F.col("_head")
    body = P.joined_lines(F.transform("ps", lambda s: s["p"]))
    parts = F.array(F.concat(F.lit("# "), h["title"]), F.concat(F.lit("![Cover image]("), h["cover"], F.lit(")")),
                    F.coalesce(F.nullif(body, F.lit("")), h["preview"]))
    article = F.concat(js_trim(F.array_join(parts, "\n\n")), F.lit("\n"))         # null parts are left out
    markdown = F.when(h["error"].isNull(), F.coalesce(h["post"], article))
    return whole.select(doc, "_head.author", "_head.title", markdown.alias("markdown"), "_head.block_count", "_head.entity_count", "_head.error")
