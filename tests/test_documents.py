"""HTML extraction rules on pages of our own."""

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import documents as Dm
from pagemill.operators.html_nodes import parse_nodes

PAD = "<p>" + "filler words to pass the length rule " * 4 + "</p>"


def _extract(spark, html, url="https://garden.example/soil/beds"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, final_url string, html string")
    return Dm.extract_html(df).collect()[0]


def _markdown(spark, inner):
    return _extract(spark, f"<html><body><article><h1>H</h1>{inner}{PAD}</article></body></html>").markdown


def test_title_text_and_absolute_link(spark):
    r = _extract(spark, '<html><head><title>Compost</title></head><body><main><h1>Compost heaps</h1>'
                        '<p>Turn them <a href="https://tools.example/fork">with a fork</a> each week.</p></main></body></html>')
    assert r.title == "Compost heaps" and r.error is None
    assert "[with a fork](https://tools.example/fork)" in r.markdown and r.markdown.startswith("# Compost heaps\n")
    assert "<" not in r.markdown and r.markdown.endswith("\n")


def test_chrome_is_removed_and_descendant_selector_found(spark):
    html = f"""<body><nav>Beds Tools</nav><div id="mw-head">Tabs</div><div id="mw-content-text"><div class="mw-parser-output">
      <p><b>Loam</b> holds water.</p>{PAD}<div class="navbox"><p>More soils</p></div></div></div><footer>Imprint</footer></body>"""
    r = _extract(spark, html)
    assert "**Loam** holds water." in r.markdown
    assert not any(x in r.markdown for x in ("Tabs", "Tools", "More soils", "Imprint"))
    assert r.root_tag == "div"


def test_relative_links_resolve(spark):
    md = _markdown(spark, "<p><a href='../pots'>a</a> <a href='./x/../y?z'>b</a> <a href='/r'>c</a> <a href='#f'>d</a></p>")
    for link in ("[a](https://garden.example/pots)", "[b](https://garden.example/soil/y?z)", "[c](https://garden.example/r)",
                 "[d](https://garden.example/soil/beds#f)"):
        assert link in md


def test_code_keeps_indentation_and_blank_lines(spark):
    md = _markdown(spark, "<pre><code>def f(x):\n    if x:\n\n\n\t\treturn 1   \n</code></pre>")
    assert "```\ndef f(x):\n    if x:\n\n\n\t\treturn 1   \n\n```" in md


def test_literal_asterisks_and_adjacent_bold(spark):
    md = _markdown(spark, "<p>a **** b</p><p><b>one</b><b>two</b></p><p><em>x</em> <code>y</code></p>")
    assert "a **** b" in md and "**onetwo**" in md and "_x_ `y`" in md


def test_quotes_prefix_every_line(spark):
    md = _markdown(spark, "<p>before</p><blockquote><p>first</p><p>second<br>third</p><blockquote>inner</blockquote></blockquote><p>after</p>")
    assert "before\n\n> first\n>\n> second\n> third\n>\n> > inner\n\nafter" in md


def test_nested_lists(spark):
    md = _markdown(spark, "<ol><li>one<ul><li>sub<li>sub2</ul><li>two</ol>")
    assert "1. one" in md and "\n  - sub\n" in md.replace("\n\n", "\n") and "\n  - sub2" in md and "2. two" in md


def test_tables_have_cells_and_rule(spark):
    md = _markdown(spark, "<table><tr><th>Crop<th>Days</tr><tr><td><p>Pea</p><td>60</table>")
    assert "| Crop | Days |\n| --- | --- |\n| Pea | 60 |" in md


def test_short_root_falls_back_to_body(spark):
    r = _extract(spark, "<body><div>opening words</div><article><h1>Hoe</h1><p>tiny</p></article><footer>end</footer></body>")
    assert r.root_tag == "body" and "opening words" in r.markdown and "end" not in r.markdown


def test_size_rules_are_flags(spark):
    big = "<body><article><h1>Big</h1><p data-x='" + "a" * 1_000_000 + "'>kept words</p>" + PAD + "</article></body>"
    r = _extract(spark, big)
    assert r.slim_bytes > Dm.MAX_SLIM_BYTES and r.error == Dm.ERROR_SLIM_SIZE
    assert r.title == "Big" and "kept words" in r.markdown


def test_deep_nesting_stays_linear():
    n = 100_000
    nodes, error = parse_nodes("<b>" * n + "x" + "</b>" * n)
    assert error is None and len(nodes) == n + 1
    assert sum(len(x["closes"] or ()) for x in nodes) <= n
    assert parse_nodes("<p>" * n)[0][-1]["depth"] == 0


def test_closed_elements_are_listed_once():
    nodes, _ = parse_nodes("<div><p>a<p>b</div>c<ul><li>x</ul>")
    told = [c for x in nodes for c in x["closes"] or ()]
    assert len(told) == len(set(told)) and [x["tag"] for x in nodes if x["pos"] in told] == ["div", "p", "p"]


def test_chrome_phrases_anywhere(spark):
    far = "x" * 5000 + "\nMain menu and then toggle the table of contents"
    df = spark.createDataFrame([(far,), ("Only one Main Menu here",)], "md string")
    assert [r[0] for r in df.select(X.is_chrome_dump(F.col("md"))).collect()] == [True, False]
    assert [r[0] for r in df.select(X.is_chrome_dump(F.col("md"), X.CHROME_HEAD_CHARS)).collect()] == [False, False]


def test_word_counts(spark):
    df = spark.createDataFrame([("# Beds\n\nRead [the list](https://x.example/a) and ![pic](i.png)\n```\nlet x\n```\nlast",)], "md string")
    r = df.select(X.word_count(F.col("md")), X.word_count_post(F.col("md"))).collect()[0]
    assert r[0] == 6   # Beds Read the list and last
    assert r[1] == 7   # whole links dropped, the '!' stays: Beds Read and ! let x last


def test_safe_filename(spark):
    df = spark.createDataFrame([("Éclair — Crème & Søn?",), ("???",), ("long " * 60,)], "t string")
    names = [r[0] for r in df.select(X.safe_filename(F.col("t"))).collect()]
    assert names[:2] == ["Eclair-Creme-Sn", "document"] and len(names[2]) > 200


def test_clean_up_is_linear_in_lines(spark):
    """Lines are split once: the plan holds one split, and 4,000 lines take no longer than a few short texts."""
    import time

    from pagemill.operators.staging import stage

    raw = spark.createDataFrame([("\n".join(["> a  b", "", "c" * 40] * 1400),)], "_raw_md string")
    df = stage(raw, _split=Dm.split_lines(F.col("_raw_md")))
    df = stage(df, _lines=Dm.kept_lines(F.col("_split")))
    plan = df.select(F.size("_lines").alias("n"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    began = time.time()
    assert plan.collect()[0].n == 2800
    assert time.time() - began < 15


def test_extraction_splits_the_markdown_once(spark):
    pages = spark.createDataFrame([("https://a.example/", "<p>x</p>")], "final_url string, html string")
    plan = Dm.extract_html(pages).select("markdown")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(_raw_md") == 1


def test_encyclopedia_payloads_without_an_article(spark):
    from pagemill.operators import encyclopedia as E

    rows = [('{"error":{"info":"The page is missing."}}', "A_b"), ('{"parse":{"title":"No text"}}', "A_b"), ("{broken", "A_b"), (None, "A_b"), ('{"error":{}}', "A_b"),
            ('{"parse":{"title":" T ","text":"<p>x"}}', "A_b"), ('{"parse":{"title":" ","text":"é"}}', "A_b")]
    got = E.parse_payload(spark.createDataFrame(rows, "body string, page_title string")).collect()
    assert [r.error for r in got] == ["The page is missing."] + [E.ERROR_NO_ARTICLE] * 4 + [None] * 2
    assert [(r.fragment, r.display_title, r.source_bytes) for r in got[5:]] == [("<p>x", "T", 4), ("é", "A b", 2)]


def test_encyclopedia_query_reads_every_article_and_every_kind_of_answer(spark, tmp_path):
    from pagemill.operators import encyclopedia as E
    from pagemill.plans.wiki_queries import q_wiki_payload

    text = "<h1>Peat \"é\"</h1>" + "<p>bog</p>" * 500
    html = [(i, f"<body><article class='x'>{text}{i}</article></body>") for i in range(5)] + [(5, "<p>no article</p>")]
    spark.createDataFrame(html, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in q_wiki_payload(spark, str(tmp_path)).collect()), key=repr)
    size, no_article = len(text.encode()) + 1, E.ERROR_NO_ARTICLE
    want = [(i, f"Some page {i}" if i in (2, 4) else f"Page {i}", None, size) for i in range(5)] + [(5, None, no_article, None)]
    want += [(i, None, error, None) for i in range(6) for error in ("The page is missing.", no_article, no_article)]
    assert got == sorted(want, key=repr)


def test_title_query_falls_back_to_the_markdown_and_the_host(spark, tmp_path):
    import duckdb

    from pagemill.plans import ORACLES
    from pagemill.plans.doc_queries import q_title

    html = [(1, "https://a.example/x", f"<html><head><title>T</title></head><body><article><h1>H &amp; I</h1>{PAD}</article></body></html>"),
            (2, "https://a.example/x", f"<html><head><title> T </title></head><body>{PAD}</body></html>"),
            (3, "https://a.example/x", f"<html><body><article><h1> </h1><p>one</p><h1>Second</h1>{PAD}</article></body></html>"),
            (4, "https://a.example/x", f"<html><body><p>one</p><p>#  From a\nline</p><p># later</p>{PAD}</body></html>"),
            (5, "https://B.example/x", f"<html><body><h2>no level one</h2><p>a # b</p><p>#c</p>{PAD}</body></html>"),
            (6, "https://c.example/x", "")]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(1, "H & I", "H & I"), (2, "T", "T"), (3, "", "one"), (4, "", "From a line"), (5, "", "b.example"), (6, "", "c.example")]
    assert sorted((r.page_id, r.slim_title, r.title) for r in q_title(spark, str(tmp_path)).collect()) == want
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(f"select page_id, slim_title, title from ({ORACLES['q_title']})").fetchall()) == want
