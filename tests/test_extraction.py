"""Fallback chain: which capture is taken, and what is told if none is."""

import datetime as dt
import json

import pytest

from pagemill.operators import documents as Dm
from pagemill.operators import extraction as Ex

BODY = "<html><head><title>T</title><meta name='author' content=' Ann '></head><body><article><h1>Head</h1><p>" + "word " * 40 + "</p></article></body></html>"
EMPTY = "<html><body><nav>Menu</nav></body></html>"
SCHEMA = ("id int, source_url string, fetched_at timestamp, fetch_error string, final_url string, status int, location string, content_type string, body string, "
          f"wiki_body string, rendered_html {Ex.ANSWER}, rendered_md {Ex.ANSWER}, provider string, rank string")
ANSWER = lambda text, status=200, ok=True: (status, ok, text)


def case(**more):
    row = dict(source_url="https://a.example/x", fetched_at=dt.datetime(2024, 1, 1), final_url="https://a.example/y", status=200, content_type="text/html", body=BODY,
               provider="own", rank="own")
    return {**row, **more}


CASES = {
    "fetched": (case(), 1, "direct-html", None),
    "markdown": (case(content_type="text/x-markdown", body="# M\n\ntext"), 1, "native-markdown", None),
    "rendered html": (case(status=500, rendered_html=ANSWER(BODY), rendered_md=ANSWER("# R")), 2, "browser-run", None),
    "rendered markdown": (case(body=EMPTY, rendered_html=ANSWER(EMPTY), rendered_md=ANSWER(" # R ")), 3, "browser-run", None),
    "failed rendering": (case(body=EMPTY, rendered_html=ANSWER(BODY, ok=False), rendered_md=ANSWER("# R", ok=None)), 3, "browser-run", None),
    "nothing renders": (case(status=404), None, None, "The website returned HTTP 404."),
    "blank rendering": (case(status=404, rendered_html=ANSWER(" "), rendered_md=ANSWER("\n")), None, None,
                        "The website returned HTTP 404. Browser fallback: " + Ex.ERROR_RENDERED),
    "chrome": (case(status=404, rendered_md=ANSWER("Main menu. Personal tools.")), None, None, "The website returned HTTP 404. Browser fallback: " + Ex.ERROR_RENDERED_CHROME),
    "policy": (case(fetch_error="Only standard web ports are supported.", rendered_html=ANSWER(BODY)), None, None, "Only standard web ports are supported."),
    "no policy": (case(fetch_error="Fetch failed.", rendered_html=ANSWER(BODY)), 2, "browser-run", None),
    "type": (case(content_type=None), None, None, "Unsupported content type: unknown."),
    "redirects": (case(status=302, location="/z"), None, None, Ex.ERROR_REDIRECTS),
    "lost redirect": (case(status=302), None, None, "Redirect 302 had no destination."),
    "nothing found": (case(body=EMPTY), None, None, Dm.ERROR_NOTHING),
    "no body": (case(body=None), None, None, Dm.ERROR_NOTHING),
    "encyclopedia": (case(source_url="https://en.wikipedia.org/wiki/A_b", wiki_body=json.dumps({"parse": {"text": "<p>" + "fact " * 30 + "</p><h2>Notes</h2><p>gone</p>"}})),
                     0, "direct-html", None),
    "encyclopedia fails": (case(source_url="https://en.wikipedia.org/wiki/A_b", wiki_body="{"), 1, "direct-html", None),
    "not an encyclopedia": (case(wiki_body=json.dumps({"parse": {"text": "x"}})), 1, "direct-html", None),
}


@pytest.fixture(scope="module")
def rows(spark):
    names = [c.split()[0] for c in SCHEMA.replace("struct<status:int,success:boolean,result:string>", "s").split(", ")]
    data = [tuple({**c[0], "id": i}.get(n) for n in names) for i, c in enumerate(CASES.values())]
    got = Ex.extract(spark.createDataFrame(data, SCHEMA), 3600).collect()
    assert len(got) == len(CASES)
    return {list(CASES)[r.id]: r for r in got}


@pytest.mark.parametrize("name", CASES)
def test_choice(rows, name):
    _, rank, provider, error = CASES[name]
    r = rows[name]
    assert (r.rank, r.provider, r.error) == (rank, provider, error)
    if error:
        assert r.markdown is None and r.fetched_at is None and r.version is None


def test_fields(rows):
    r = rows["fetched"]
    assert (r.source_url, r.final_url, r.title, r.author, r.version) == ("https://a.example/x", "https://a.example/y", "Head", "Ann", 1)
    assert r.source_bytes == len(BODY) and r.words == 41 and r.markdown_bytes == len(r.markdown.encode()) and r.markdown.startswith("# Head\n")
    assert r.expires_at - r.fetched_at == dt.timedelta(hours=1)
    r = rows["rendered html"]
    assert r.final_url == "https://a.example/x" and r.source_bytes == len(BODY)
    assert rows["rendered markdown"].markdown == "# R\n" and rows["rendered markdown"].source_bytes is None
    r = rows["encyclopedia"]
    assert r.title == "A b" and "gone" not in r.markdown and "fact" in r.markdown
    assert r.final_url == r.source_url == "https://en.wikipedia.org/wiki/A_b"


def test_posts(spark):
    post = json.dumps({"tweet": {"text": "Hello [link](https://a.example)", "author": {"screen_name": "u"}}})
    data = [(1, "https://x.com/u/status/1", dt.datetime(2024, 1, 1), 200, post), (2, "s", None, 500, "{"), (3, "s", None, 404, "{}"), (4, "s", None, 200, "{}"), (5, "s", None, 500, post)]
    rows = {r.id: r for r in Ex.extract_posts(spark.createDataFrame(data, "id int, source_url string, fetched_at timestamp, status int, payload string"), 60).collect()}
    r = rows[1]
    assert (r.provider, r.title, r.author, r.words, r.final_url) == ("x-fxtwitter", "Post by @u", "@u", 5, "https://x.com/u/status/1")
    assert r.source_bytes == len(post) and r.expires_at - r.fetched_at == dt.timedelta(seconds=60)
    assert [rows[i].error for i in (2, 3, 4, 5)] == ["The X provider returned invalid JSON (HTTP 500).", "The X provider returned HTTP 404.",
                                                     Ex.ERROR_NO_POST, "The X provider returned HTTP 500."]


def test_no_captures(spark):
    assert Ex.extract(spark.createDataFrame([], SCHEMA), 60).collect() == []
