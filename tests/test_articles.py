"""Article payloads: entity maps, inline marks, atomic blocks, whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import articles as A

MARKS = {"Bold": ("**", "**", 20), "Italic": ("_", "_", 30), "Underline": ("<u>", "</u>", 40), "Code": ("`", "`", 60)}


def plain_inline(text, styles, links):
    """Marks put into a list of UTF-16 units, place by place."""
    units = text.encode("utf-16-be")
    n = len(units) // 2
    marks = [(o, o + k, *MARKS[s]) for o, k, s in styles if s in MARKS] + [(o, o + k, "[", f"]({u})", 10) for o, k, u in links]
    marks = [m for m in marks if m[0] >= 0 and m[0] < m[1] <= n]
    out = b""
    for at in range(n + 1):
        ends = sorted((m for m in marks if m[1] == at), key=lambda m: (-m[0], -m[4]))
        begins = sorted((m for m in marks if m[0] == at), key=lambda m: (-m[1], m[4]))
        for token in [m[3] for m in ends] + [m[2] for m in begins]:
            out += token.encode("utf-16-be")
        out += units[2 * at:2 * at + 2]
    return out.decode("utf-16-be", "replace")


BLOCKS = ("id int, text string, styles array<struct<offset:double,length:double,style:string>>, "
          "ranges array<struct<offset:double,length:double,entity:struct<type:string,url:string>>>")


def inline(spark, rows):
    df = spark.createDataFrame([(i, t, s, [(o, k, ("LINK", u)) for o, k, u in x]) for i, (t, s, x) in enumerate(rows)], BLOCKS)
    return [r.inline for r in A.render_inline(df).orderBy("id").collect()]


def test_marks_by_hand(spark):
    rows = [("bold and link", [(0.0, 4.0, "Bold"), (0.0, 8.0, "Italic")], [(5.0, 8.0, "u")]),
            ("plain", [], []), ("", [(0.0, 1.0, "Bold")], []), ("abc", [(0.0, 9.0, "Bold"), (-1.0, 2.0, "Code"), (1.0, 0.0, "Bold"), (0.0, 3.0, "Blink")], []),
            ("a\U0001F600b", [(1.0, 2.0, "Bold")], []), ("ab", [(0.0, 2.0, "Bold"), (0.0, 2.0, "Bold")], []), ("abcd", [(1.0, 1.5, "Code")], [])]
    assert inline(spark, rows) == ["_**bold** [and_ link](u)", "plain", "", "abc", "a**\U0001F600**b", "****ab****", "a`bcd"]


def test_marks_that_overlap_touch_and_cut_characters(spark):
    rng, rows = random.Random(4), []
    for _ in range(150):
        text = "".join(rng.choice("ab é\U0001F600\U0001F468東\n") for _ in range(rng.randint(0, 14)))
        span = lambda: (float(rng.randint(-1, 12)), float(rng.randint(0, 9)))
        rows.append((text, [(*span(), rng.choice([*MARKS, "Other"])) for _ in range(rng.randint(0, 6))],
                     [(*span(), "https://l.example/") for _ in range(rng.randint(0, 2))]))
    assert inline(spark, rows) == [plain_inline(*r) for r in rows]


def test_many_marks_stay_linear(spark):
    import time

    text = "x" * 200_000
    rows = [(text, [(float(i * 10), 5.0, "Bold") for i in range(20_000)], [])]
    began = time.time()
    got = inline(spark, rows)[0]
    assert time.time() - began < 40 and got.count("**") == 40_000 and got.startswith("**xxxxx**xxxxx**")


def entities(spark, value):
    payload = json.dumps({"tweet": {"article": {"content": {"entityMap": value}}}})
    df = A.entity_map(A.read_payloads(spark.createDataFrame([(1, payload)], "id int, payload string")))
    return {k: (e.type, e.url) for k, e in df.first().entities.items()}


def test_entity_maps_of_both_shapes(spark):
    link = lambda u: {"type": "LINK", "data": {"url": u}}
    assert entities(spark, [{"key": "0", "value": link("a")}, {"key": 1, "value": link("b")}, {"key": "0", "value": link("c")}, {"key": "x", "value": link("d")},
                            {"value": link("e")}, {"key": 5, "value": "text"}, "text", {"key": " 0x10 ", "value": link("f")}, {"key": None, "value": link("g")}]
                    ) == {0.0: ("LINK", "g"), 1.0: ("LINK", "b"), 16.0: ("LINK", "f")}
    assert entities(spark, {"0": {"key": "3", "value": link("a")}, "1": {"value": link("b")}, "2": link("c"), "x": link("d"), "y": {"key": 3, "value": link("e")},
                            "10": link("f"), "4": "text", "5": {"key": "z", "value": link("g")}}
                    ) == {3.0: ("LINK", "e"), 1.0: ("LINK", "b"), 2.0: ("LINK", "c"), 10.0: ("LINK", "f")}
    assert entities(spark, None) == entities(spark, "text") == entities(spark, []) == {}
    assert entities(spark, {"1": {"type": 7, "data": {"url": 8}}, "2": {"type": "LINK"}}) == {1.0: (None, None), 2.0: ("LINK", None)}


@pytest.mark.parametrize("name, want", [
    ("/72x72/1f468-200d-1f469.svg", "\U0001F468‍\U0001F469"), ("/a/0023-20E3.PNG?v=1", "#⃣"), ("/zz.svg", None), ("/1f600.gif", None),
    ("/110000.svg", None), ("/1f600-.svg", None), ("/000000001f600.svg", "\U0001F600"), ("/1f600.svgx", None), ("/d83d.svg", "�"), ("1f600.svg", None)])
def test_emoji(spark, name, want):
    df = spark.createDataFrame([("TWEMOJI", "https://e.example" + name if name[0] == "/" else name), ("LINK", "https://e.example/1f600.svg")], "t string, u string")
    assert [r[0] for r in df.select(A.emoji(F.col("t"), F.col("u"))).collect()] == [want, None]


def article(**more):
    media = {"media_id": "m1", "media_info": {"original_img_url": "https://i.example/1.jpg", "variants": [
        {"bit_rate": 1, "content_type": "video/mp4", "url": "low"}, {"content_type": "video/mp4", "url": "none"},
        {"bit_rate": 5, "content_type": "video/mp4", "url": "high"}, {"bit_rate": 9, "content_type": "application/x", "url": "list"}]}}
    cover = {"media_id": "m2", "media_info": {"preview_image": {"original_img_url": "https://i.example/c.jpg"}}}
    entity = {
        0: {"type": "LINK", "data": {"url": "https://l.example"}},
        1: {"type": "MEDIA", "data": {"caption": " a [b] ", "mediaItems": [{"mediaId": "m1"}, {"media_id": "m2"}, {"mediaId": "gone"}]}},
        2: {"type": "IMAGE", "data": {"url": "https://i.example/own.png"}}, 3: {"type": "TWEMOJI", "data": {"url": "/1f600.svg"}},
        4: {"type": "MARKDOWN", "data": {"markdown": " | a |\r\n| b | "}}, 5: {"type": "DIVIDER"}}
    at = lambda *keys: [{"key": k, "offset": 0, "length": 1} for k in keys]
    blocks = [
        {"type": "header-one", "text": "Head", "inlineStyleRanges": [{"offset": 0, "length": 4, "style": "Bold"}]},
        {"text": "go here", "entityRanges": [{"key": 0, "offset": 3, "length": 4}]},
        {"type": "atomic", "text": " ", "entityRanges": at(1, 3)}, {"type": "atomic", "text": " ", "entityRanges": at(2, 5)},
        {"type": "atomic", "text": " ", "entityRanges": at(1, 4, 3)}, {"type": "atomic", "text": " note ", "entityRanges": at(5, 9)},
        {"type": "atomic", "text": "  "}, {"type": "ordered-list-item", "text": "one"}, {"type": "ordered-list-item", "text": "two", "data": {"depth": 2}},
        {"type": "unordered-list-item", "text": "dot"}, {"type": "blockquote", "text": "q\nr"},
        {"type": "code-block", "text": "x = 1", "inlineStyleRanges": [{"offset": 0, "length": 1, "style": "Bold"}]}, {"type": "unstyled", "text": " "}]
    return {"tweet": {"author": {"name": "N", "screen_name": "u"}, "article": {
        "title": " T ", "cover_media": cover, "media_entities": [media, {"media_id": ""}, {"media_id": "m2", "media_info": {"original_img_url": "old"}}],
        "content": {"blocks": blocks, "entityMap": {str(k): v for k, v in entity.items()}}, **more}}}


WANT = """# T

![Cover image](https://i.example/c.jpg)

## **Head**

go [here](https://l.example)

![a \\[b\\]](https://i.example/1.jpg)

[Video](high)

![a \\[b\\]](https://i.example/c.jpg)

\U0001F600

![](https://i.example/own.png)

| a |
| b |

note

1. one
    2. two

- dot

> q
> r

```
x = 1
```
"""


def converted(spark, *payloads):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    return A.convert_posts(spark.createDataFrame(rows, "id int, payload string"), "id").orderBy("id").collect()


def test_whole_documents(spark):
    empty = {"tweet": {"article": {"title": "  ", "preview_text": " soon "}}}
    post = {"tweet": {"text": " A useful post. ", "author": {"screen_name": "p"}, "media": [
        {"type": "video", "url": "v"}, {"type": "photo", "url": "i", "altText": "alt"}, {"type": "photo"}]}}
    rows = converted(spark, article(), empty, post, {"tweet": None}, "{", None, "[1]", '{"tweet": {"text": "a", "text": "b"}}')
    assert rows[0].markdown == WANT and (rows[0].author, rows[0].title, rows[0].block_count, rows[0].entity_count) == ("N (@u)", "T", 13, 6)
    assert rows[1].markdown == "# Untitled X Article\n\nsoon\n" and rows[1].author is None
    assert rows[2].markdown == "# Post by @p\n\n**@p**\n\nA useful post.\n\n[Video](v)\n\n![alt](i)\n" and rows[2].block_count == 0
    assert [r.error for r in rows] == [None] * 3 + [A.ERROR_NO_POST, A.ERROR_JSON, A.ERROR_JSON, A.ERROR_NO_POST, A.ERROR_JSON]


def test_no_rows_and_other_columns(spark):
    assert converted(spark) == []
    df = spark.createDataFrame([(1, json.dumps(article()), "own", 5)], "id int, payload string, text string, pos int")
    assert A.convert_posts(df, "id").first().markdown == WANT
