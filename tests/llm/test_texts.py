"""Operators 5, 7, 8 and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontamination, html_text, language_id

from . import brute
from .conftest import prose


def _contamination(docs, items):
    got = decontamination.contamination(docs, items).where("doc_id is not null").collect()
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)


def _expected(rows, items):
    import hashlib
    return sorted((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
                  for i, n, hit, found in brute.contaminated(rows, items))


def test_contamination_long_short_and_shared_items(spark):
    passage = prose(40, 30)
    items = [(1, passage), (2, prose(41, 4) + " " + passage[:120]), (3, prose(42, 6)), (4, "Only Two"), (5, ""), (6, None),
             (7, passage), (7, prose(43, 12)), (None, prose(44, 20)), (10, "word " * 12)]
    rows = [(1, prose(50, 5) + " " + passage.upper() + " x"), (2, " ".join(passage.split()[:10])), (3, " ".join(passage.split()[:9])),
            (4, "only, two!"), (5, None), (6, ""), (7, prose(42, 6) + " " + prose(51, 20_000)), (8, prose(43, 12)), (8, prose(43, 12)),
            (8, "another text"), (9, "word " * 300), (10, "...")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _contamination(docs, bench) == _expected(rows, [i for i in items if i[0] is not None])
    assert _contamination(docs, bench.limit(0)) == _expected(rows, [])
    assert _contamination(docs.limit(0), bench) == []


def test_contamination_of_edge_rows(edge_docs, spark):
    items = [(1, prose(2, 60)), (2, prose(4, 9))]
    rows = [(r.doc_id, r.text) for r in edge_docs.where("doc_id is not null").collect()]
    assert _contamination(edge_docs, spark.createDataFrame(items, "item_id long, text string")) == _expected(rows, items)


def _page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_blocks_of_an_article():
    patterns = html_text._patterns()
    page = _page("""<nav><ul><li>Menu</ul></nav><header>Site</header><div class="ad">Buy</div>
      <main><article><header><h1>Head &amp; line</h1></header><p>One<b>two</b> three<br>four
      <p>Five<script>var t="</p><p>no";</script> six<p class="cookie-notice">Accept</p>
      <section id="comments"><p>First!</p></section><aside>Side</aside><form><input>Name</form>
      <table><tr><td>a<td>b<tr><td>c</table><!-- <p>gone</p> --><p hidden>h</p><p style="display: none">s</p>
      <ul><li>x<li>y</ul>5 < 6 &lt; 7</article><div>related words</div></main><footer>&copy; end</footer>""")
    assert html_text.page_blocks(page, patterns) == (
        ["Head & line", "Onetwo three four", "Five six", "a", "b", "c", "x", "y", "5 < 6 < 7"], True)
    for odd in ("", "<", "<<<>>>", "<p", "<!--", "<script>x", "</p></div>", "<a href='x", "<p title=\"a>b\">t", "&#0; &bogus; &#x110000;",
                "<![CDATA[x]]>", "plain text"):
        blocks, inside = html_text.page_blocks(odd, patterns)
        assert inside is False and isinstance(blocks, list)
    assert html_text.page_blocks('<p title="a>b">t', patterns)[0] == ["t"]
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    assert html_text.page_blocks(deep, patterns)[0] == ["deep"]


def test_host_boilerplate_goes_and_copies_stay(spark):
    notice = "All prices are shown without any kind of guarantee by this shop"
    rows = [(i, f"http://Shop.example/{i}", _page(f"<div>{notice}</div><div>{prose(60 + i, 30)}</div>"), "x") for i in range(12)]
    rows += [(20 + i, f"http://news.example/{i}", _page(f"<article><p>{prose(80, 20)}</p><p>{prose(90 + i, 9)}</p></article>"), "y")
             for i in range(3)] + [(30 + i, f"http://news.example/{i}", _page(f"<article><p>{prose(200 + i, 15)}</p></article>"), "z") for i in range(9)]
    rows += [(50, None, None, None), (51, "no url", "", ""), (52, "http://shop.example/z", None, ""), (52, "http://shop.example/z", None, ""),
             (None, "http://one.example/", "<p>no id</p>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    assert html_text.main_text(pages).count() == len(rows)
    for i in range(12):
        assert got[i, f"http://Shop.example/{i}"] == (prose(60 + i, 30), len(prose(60 + i, 30)))
    for i in range(3):
        assert got[20 + i, f"http://news.example/{i}"][0] == prose(80, 20) + " " + prose(90 + i, 9)
    assert got[50, None] == ("", 0) and got[51, "no url"] == ("", 0) and got[52, "http://shop.example/z"] == ("", 0)
    assert got[None, "http://one.example/"] == ("no id", 5)
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_results_do_not_depend_on_the_groups(spark, monkeypatch):
    """A notice on few of a host's pages goes from all of them; in an article what is on half of the pages goes."""
    notice, line = prose(300, 12), prose(301, 14)
    rows = [(i, f"http://big.example/{i}", _page(f"<div>{prose(1000 + i, 15)}</div>" + f"<div>{notice}</div>" * (i % 8 == 0))) for i in range(80)]
    rows += [(500 + i, f"http://art.example/{i}", _page(
        f"<article><p>{prose(2000 + i, 15)}</p>" + f"<p>{line}</p>" * (i % 20 < 11) + f"<p>{notice}</p>" * (i % 20 < 9) + "</article>"))
             for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: prose(1000 + i, 15) for i in range(80)}
    want |= {500 + i: " ".join([prose(2000 + i, 15)] + [notice] * (i % 20 < 9)) for i in range(80)}
    for group in (400, 10):
        monkeypatch.setattr(html_text, "GROUP_PAGES", group)
        assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want


def test_repeated_cover_against_all_substrings():
    rng = random.Random(8)
    tokens = np.array([rng.randrange(3) for _ in range(400)])
    page = np.repeat(np.arange(10), 40)
    tokens[39::40] = 100 + np.arange(10)
    cover = html_text.repeated_cover(html_text.suffix_ranks(tokens, 4), page, 4, 3)
    want = np.zeros(400, bool)
    on = {}
    for i in range(397):
        on.setdefault(tuple(tokens[i:i + 4]), set()).add(page[i])
    for i in range(397):
        if len(on[tuple(tokens[i:i + 4])]) >= 3:
            want[i:i + 4] = True
    assert (cover == want).all()


def test_forward_backward_is_the_sum_over_all_labellings(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(language_id, "CHUNK", 2)
    emission, transition, starts = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), [0, 5, 6]
    p, z, _ = language_id.posteriors(emission, transition, starts)
    for chain, (a, b) in enumerate(zip(starts, [5, 6, 9])):
        total, mass = 0.0, np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            # the message into the first word is uniform over labels
            score = np.exp(sum(emission[a + i, k] for i, k in enumerate(path))
                           + sum(transition[j, k] for j, k in itertools.pairwise(path))) * np.exp(transition[:, path[0]]).mean()
            total += score
            for i, k in enumerate(path):
                mass[i, k] += score
        assert np.allclose(p[a:b], mass / total) and np.isclose(z[chain], np.log(total))


def test_held_out_accuracy(sample_docs):
    found = language_id.identify(sample_docs, language_id.learn(sample_docs)).where(language_id.held_out(F.col("doc_id")))
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_languages_without_spaces_are_learned(spark):
    rng = random.Random(4)
    letters = {"zh": "的一是不了人我在有他这为之大来以个中上们", "th": "กขคงจฉชซญดตถทนบปผพฟม"}
    rows = [(i, "".join(rng.choice(letters[x]) for _ in range(rng.randrange(50, 400))), x) for i in range(120) for x in [("zh", "th")[i % 2]]]
    rows += [(1000 + i, prose(700 + i, 40), "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert model[0] == ["en", "th", "zh"]
    found = language_id.identify(df, model).where(language_id.held_out(F.col("doc_id"))).collect()
    assert {r.lang for r in found} == {"en", "th", "zh"} and all(r.lang == r.lang_pred and r.score > 0.5 for r in found)
    assert language_id.words_of("ab " + "c" * 81) == ["ab", "c" * 40, "c" * 40, "c"]


def test_code_switched_words_are_labelled(sample_docs):
    rows = sample_docs.where("lang in ('en', 'de')").collect()
    labels, weights, trans = language_id.learn(sample_docs)
    en, de = (next(r.text.split()[:30] for r in rows if r.lang == x and len(r.text.split()) > 40) for x in ("en", "de"))
    p = language_id.posteriors(language_id.scores(en + de + en, weights), trans, [0])[0].argmax(axis=1)
    want = [labels.index("en")] * 30 + [labels.index("de")] * 30 + [labels.index("en")] * 30
    assert (p == want).mean() > 0.95


def test_language_of_edge_rows(edge_docs, no_docs, sample_docs):
    model = language_id.learn(sample_docs)
    got = language_id.identify(edge_docs, model).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and 0 <= r.score <= 1 and (has_letter or r.score == 0)
        assert r.row == "e"
    assert language_id.identify(no_docs, model).collect() == []
    nothing = language_id.learn(no_docs)
    assert {r.lang_pred for r in language_id.identify(edge_docs, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def pipeline_rows(spark, sample_docs):
    """Documents with planted copies, a benchmark passage and junk."""
    some = sample_docs.orderBy("doc_id").limit(60).collect()
    rows = [tuple(r) for r in some]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first().text
    rows += [(9001, rows[0][1], "en", "copy", 1), (9002, "12 34 !!", None, "junk", 8), (9003, None, None, None, None),
             (9004, rows[3][1] + "\nA leak: " + item + " and so on", "en", "leak", 1), (9005, "", "en", "empty", 0),
             (9006, rows[1][1], "en", "copy", 1), (None, "no id at all", "en", "x", 1)]
    return spark.createDataFrame(rows, sample_docs.schema).repartition(4)


def test_pipeline_against_plain_stages(spark, pipeline_rows):
    import corpus_pipeline
    from pagemill.llm.common import staged

    docs, seen = pipeline_rows, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        seen[name] = (before.collect(), docs.collect(), docs.columns)
    names = pipeline_rows.columns
    assert all(seen[n][2] == names for n in list(seen)[:-1])

    start, kept, _ = seen["language_id"]
    assert {r.doc_id for r in start} - {r.doc_id for r in kept} == {9002, 9003, 9005, None}

    start, kept, _ = seen["line_dedup"]
    first = brute.line_components([(r.doc_id, r.text) for r in start], line_sets=brute.dense_line_sets)
    want = {}
    for r in start:
        lines = [x for k, x in enumerate(r.text.split("\n")) if first.get((r.doc_id, k), (r.doc_id, k)) == (r.doc_id, k)]
        if any(x.strip() for x in lines):
            want[r.doc_id] = "\n".join(lines)
    assert {r.doc_id: r.text for r in kept} == want and all(r.n_chars == len(r.text) for r in kept)

    start, kept, _ = seen["near_dedup"]
    want = {i for i, _, _, stays in brute.near_duplicates([(r.doc_id, r.text) for r in start], 5, 80) if stays}
    assert {r.doc_id for r in kept} == want

    start, kept, _ = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = {i for i, _, hit, _ in brute.contaminated([(r.doc_id, r.text) for r in start], items) if not hit}
    assert {r.doc_id for r in kept} == want and 9004 not in want

    import public_tokenizers
    import tiktoken
    from pagemill.llm import bpe
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    start, kept, _ = seen["byte_bpe"]
    assert {r.doc_id: r.ids for r in kept} == {r.doc_id: library.encode_ordinary(r.text) for r in start}


def test_language_stage_sends_each_column_once(spark, sample_docs, monkeypatch):
    import corpus_pipeline

    sent, own = [], language_id.identify

    def told(docs, model):
        sent.append(docs)
        return own(docs, model)

    monkeypatch.setattr(language_id, "identify", told)
    docs = sample_docs.withColumn("score", F.lit("own")).withColumn("Lang_Pred", F.lit(7))
    out = corpus_pipeline._languages(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r) for r in out.select("score", "Lang_Pred").collect()} == {("own", 7)}
    assert out.exceptAll(docs).count() == 0
    assert [f.dataType.typeName() for f in sent[0].schema].count("string") == len([f for f in docs.schema if f.dataType.typeName() == "string"])
    assert all(f.dataType.typeName() != "struct" for f in sent[0].schema)


def test_line_stage_finds_one_changed_character(spark):
    import corpus_pipeline

    line = "Copyright %d Example Publishers and their partners in many other places of the world."
    rows = [(1, line % 2023, "en", "s", 1), (2, line % 2024 + "\n" + prose(2, 30), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "")
    assert {r.doc_id: r.text for r in got.collect()} == {1: line % 2023, 2: prose(2, 30)}


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    rows = [(1, prose(1, 30), "en", "s", 1), (1, prose(1, 30), "en", "s", 1), (2, prose(1, 30), "en", "t", 1), (3, "", None, None, None),
            (5, prose(7, 30), "en", "s", 1), (5, prose(8, 30), "en", "s", 1), (4, prose(8, 30), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, prose(1, 30)), (3, ""), (4, prose(8, 30)), (5, prose(7, 30))]


def test_contamination_of_rows_without_doc_id(spark):
    item = prose(40, 30)
    rows = [(None, "before " + item), (None, prose(41, 30)), (None, None), (3, item)]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in got) == [(0, 0, 0, False), (0, 30, 0, False), (0, 31, 30, True), (3, 30, 30, True)]


def test_a_language_worker_scores_few_words_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    class Model:
        value = (["de", "en"], np.random.default_rng(3).normal(size=(1 << language_id.BITS, 2)).astype(np.float32), np.zeros((2, 2)))

    texts = [" ".join(f"w{i}x{k}" for k in range(40)) if i % 7 else None for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    seen, features = [], language_id.features
    monkeypatch.setattr(language_id, "features", lambda words: seen.append(len(words)) or features(words))
    monkeypatch.setattr(language_id, "_STATE", {})
    out = list(language_id._predict(Model())(iter([batch, batch.slice(0, 0)])))
    assert sum(seen) == 40 * sum(t is not None for t in texts) and max(seen) <= 8_000
    assert [x.num_rows for x in out] == [1000, 0]
    # each text alone has the same prediction
    got = dict(zip(out[0].column("doc_id").to_pylist(), zip(out[0].column("lang_pred").to_pylist(), out[0].column("score").to_pylist())))
    for i in (0, 1, 255, 256, 500, 999):
        monkeypatch.setattr(language_id, "_STATE", {})
        alone = next(language_id._predict(Model())(iter([batch.slice(i, 1)])))
        assert got[i][0] == alone.column("lang_pred")[0].as_py()
        assert abs(got[i][1] - alone.column("score")[0].as_py()) < 1e-9


def test_language_worker_keeps_nothing_after_a_task(monkeypatch):
    import pyarrow as pa

    class Model:
        value = language_id.fit([("en", ["the", "and"]), ("fr", ["le", "et"])], rounds=2)

    freed = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda pool=pa.default_memory_pool(): type("Pool", (), {"release_unused": lambda self: freed.append(pool.release_unused())})())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["the and le"])], names=["doc_id", "text"])
    assert [b.num_rows for b in language_id._predict(Model())(iter([batch]))] == [1]
    assert not language_id._STATE and freed
