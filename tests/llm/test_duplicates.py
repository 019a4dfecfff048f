"""Operators 3, 4 and 9 against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import graph, line_dedup, near_dedup, suffix_dedup
from pagemill.llm.common import staged

from . import brute
from .conftest import prose


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").where("doc_id is not null").collect()]


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of near copies, a chain of texts each like its neighbour only, and others that share a passage."""
    rng, rows, base = random.Random(5), [], prose(10, 150).split()
    for i in range(120):
        own = list(base)
        own[rng.randrange(150)] = f"edit{i}"
        rows.append((1000 + i, " ".join(own)))
    chain = prose(11, 120).split()
    for i in range(25):
        own = list(chain)
        own[4 * i:4 * i + 4] = [f"link{i}{j}" for j in range(4)]
        chain = own
        rows.append((2000 + (i * 7) % 25, " ".join(own)))
    passage = prose(12, 40)
    rows += [(3000 + i, prose(100 + i, 25) + " " + passage + " " + prose(300 + i, 10)) for i in range(60)]
    small = [f"s{i}" for i in range(9)]
    rows += [(4000 + n, " ".join(small[:n])) for n in range(1, 10)] + [(4100, " ".join(small[:4] + ["x"] + small[4:]))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def _near(df, **options):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                  near_dedup.near_duplicates(df, **options).where("doc_id is not null").collect())


@pytest.mark.parametrize("k, threshold", [(3, 85), (5, 80)])
def test_near_duplicates_of_copies(copies, k, threshold):
    assert _near(copies, words_a_shingle=k, threshold=threshold) == brute.near_duplicates(_rows(copies), k, threshold)


def test_near_duplicates_of_edge_rows(edge_docs, no_docs):
    assert _near(edge_docs) == brute.near_duplicates(_rows(edge_docs))
    assert near_dedup.near_duplicates(no_docs).collect() == []


def test_near_duplicates_without_doc_id(spark):
    rows = [(None, prose(30, 40)), (None, prose(31, 40)), (7, prose(31, 40)), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, False), (0, 38, 0, False), (0, 38, 7, False), (7, 38, 7, True)]


def _lines(df, dense=False):
    return {(r.doc_id, r.line_no): (r.rep_doc_id, r.rep_line_no) for r in line_dedup.line_components(df, dense=dense).collect()}


SETS = [(False, brute.line_sets), (True, brute.dense_line_sets)]


@pytest.mark.parametrize("dense, sets", SETS)
def test_lines_of_sample_and_edge_rows(sample_docs, edge_docs, no_docs, dense, sets):
    assert _lines(sample_docs, dense) == brute.line_components(_rows(sample_docs), line_sets=sets)
    assert _lines(edge_docs, dense) == brute.line_components(_rows(edge_docs), line_sets=sets)
    assert line_dedup.line_components(no_docs, dense=dense).collect() == []


@pytest.mark.parametrize("dense, sets", SETS)
def test_lines_of_many_near_copies(copies, dense, sets):
    assert _lines(copies, dense) == brute.line_components(_rows(copies), line_sets=sets)


def test_deduped_documents_keep_first_lines(spark):
    a, b = prose(20, 30), prose(21, 30)
    rows = [(1, a + "\n\n" + b, "x"), (2, b + "\n" + prose(22, 12), "y"), (3, a, "z"), (4, "", "e"), (5, None, "n"), (6, " \n ", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __line_no string")
    got = {r.doc_id: (r.text, r["__line_no"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (rows[0][1], "x"), 2: (prose(22, 12), "y"), 4: ("", "e"), 5: (None, "n"), 6: (" \n ", "b")}


def test_lines_with_one_edit_are_linked(spark, edge_docs, no_docs):
    """One changed or added character, in short, long and unspaced lines, against the plain version on dense shingles."""
    rng, rows = random.Random(9), []
    for i in range(60):
        line = prose(500 + i, 6 + i % 20)
        if i % 4 == 3:
            line = "".join(rng.choice("東京都大阪府北海道沖縄県山川田中村森林") for _ in range(60 + i))
        at = rng.randrange(len(line))
        rows.append((i, line))
        rows.append((1000 + i, line[:at] + "\u00d8" + line[at + i % 2:]))
    rows += [(3000, "Copyright 2023 Example Publishers and their partners in many other places of the world."),
             (3001, "Copyright 2024 Example Publishers and their partners in many other places of the world.")]
    # small sets, of which one holds the other or one character differs, at the threshold and below it
    small = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows += [(4000 + 50 * n + k, t) for n in range(3, 24) for k, t in enumerate((small[:n], small[:n + 1], "_" + small[:n], "#" + small[:n - 1]))]
    rows += [(9000 + i, "=" * (30 + i)) for i in range(60)] + [(9100, "\U0001F600" * 40 + "ab"), (9101, "\U0001F600" * 41 + "ab"), (9102, "ab" * 500), (9103, "ab" * 501)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line_no): (r.rep_doc_id, r.rep_line_no) for r in line_dedup.line_components(df, dense=True).collect()}
    assert got == brute.line_components(rows, line_sets=brute.dense_line_sets)
    assert got[3001, 0] == (3000, 0)
    assert sum(got[1000 + i, 0] == (i, 0) for i in range(60)) >= 55
    got = {(r.doc_id, r.line_no): (r.rep_doc_id, r.rep_line_no) for r in line_dedup.line_components(edge_docs, dense=True).collect()}
    assert got == brute.line_components(_rows(edge_docs), line_sets=brute.dense_line_sets)
    assert line_dedup.line_components(no_docs, dense=True).collect() == []
    plan = line_dedup.line_components(edge_docs, dense=True)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_signatures_are_the_least_hashes_without_a_row_for_each_place(spark, monkeypatch):
    """The set of a line is made in its row: repeated and long lines, short ones, characters of any width."""
    rng = random.Random(4)
    lines = [(i, "".join(rng.choice("abc déø\U0001F600") for _ in range(n))) for i, n in enumerate((1, 4, 5, 6, 20, 36, 37, 70, 400, 3000))]
    lines += [(20, "=" * 500), (21, "ab" * 400), (22, "abcdefghij" * 90 + "xyz"), (23, prose(77, 300) * 3)]
    made = [(i, s.encode("utf-32-be")) for i, x in lines for s in ({x[k:k + 5] for k in range(len(x) - 4)} or {x})]
    hashed = spark.createDataFrame(made, "h long, s binary").select("h", F.xxhash64("s").alias("x")).collect()
    want = {i: [x % 2 ** 31 for x in sorted(r.x for r in hashed if r.h == i)[:line_dedup.SKETCH]] for i, _ in lines}
    df = spark.createDataFrame(lines, "h long, line string")
    assert {r.h: r.signature for r in line_dedup._signatures(df, True).collect()} == want

    plans, own = [], line_dedup.staged

    def told(df, name):
        plans.append(df)
        return own(df, name)

    monkeypatch.setattr(line_dedup, "staged", told)
    line_dedup.line_components(df.select(F.col("h").alias("doc_id"), F.col("line").alias("text")), dense=True).count()
    table = next(df for df in plans if "signature" in df.columns)
    assert "ObjectHashAggregate" not in table._jdf.queryExecution().executedPlan().toString()


def test_lists_and_their_members_are_read_from_one_exchange(edge_docs, monkeypatch):
    plans, own = [], line_dedup.staged

    def told(df, name):
        plans.append(df)
        return own(df, name)

    monkeypatch.setattr(line_dedup, "staged", told)
    line_dedup.line_components(edge_docs, dense=True).count()
    shared = [df for df in plans if {"list", "id", "n"} <= set(df.columns)]
    assert len(shared) == 1
    shared[0].collect()
    plan = shared[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(list" in x]
    assert sum("ReusedExchange" not in x for x in dealt) == sum("ReusedExchange" in x for x in dealt) == 1


def test_line_dedup_has_no_python(edge_docs):
    plan = line_dedup.line_components(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(500, 501 + i) for i in range(40)] + [(540, 700)]
    edges = spark.createDataFrame(path + hub + [(900, 900)], "u long, v long")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 500 for i in [*range(500, 541), 700]}


def _removed(df):
    return sorted(tuple(r) for r in suffix_dedup.repeated_removed(df).where("doc_id is not null").collect())


def test_repeated_strings_of_copies(copies):
    assert _removed(copies) == brute.removed(_rows(copies))


def test_repeated_strings_of_edge_rows(edge_docs, no_docs):
    assert _removed(edge_docs) == brute.removed(_rows(edge_docs))
    assert suffix_dedup.repeated_removed(no_docs).collect() == []


def test_repeated_strings_near_the_limit(spark):
    text = prose(30, 40)
    rows = [(1, "a" + text[:49] + "b"), (2, "c" + text[:49] + "d"), (3, text[:50]), (4, "éé" + text[:50] + "é"), (5, "z" * 200),
            (6, "z" * 120 + "y"), (7, text), (8, text[100:151] + text[100:151])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _removed(df) == brute.removed(rows)


def test_no_task_sorts_all_contexts_of_a_hot_anchor(copies, monkeypatch):
    real = suffix_dedup._cover

    def cover(span):
        inner = real(span)

        def run(batches):
            from collections import Counter
            seen = Counter()

            def counted():
                for batch in batches:
                    seen.update(batch.column("anchor").to_pylist())
                    assert max(seen.values(), default=0) <= 5
                    yield batch

            yield from inner(counted())

        return run

    monkeypatch.setattr(suffix_dedup, "_cover", cover)
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 5, raising=False)
    assert _removed(copies) == brute.removed(_rows(copies))


def test_merged_transforms_are_the_sorted_suffixes():
    rng = random.Random(6)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(40)]
    docs = [rng.randrange(20) for _ in segments]
    suffix_dedup.SHARD_BYTES, old = 200, suffix_dedup.SHARD_BYTES
    try:
        import numpy as np
        got = list(zip(*(x.tolist() for x in suffix_dedup.smallest_documents(segments, np.array(docs), 5))))
    finally:
        suffix_dedup.SHARD_BYTES = old
    least = {}
    for s, d in zip(segments, docs):
        for i in range(len(s) - 4):
            least[s[i:i + 5]] = min(d, least.get(s[i:i + 5], d))
    assert sorted(got) == sorted((k, i, least[s[i:i + 5]]) for k, s in enumerate(segments) for i in range(len(s) - 4))


def test_bit_table_marks_all_hashes(spark):
    import numpy as np
    h = np.random.default_rng(1).integers(0, 2 ** 63, 5000).astype(np.uint64) * np.uint64(2)
    rows = [(b, int((h >> np.uint64(60) == b).sum()), h[h >> np.uint64(60) == b].tobytes()) for b in range(16)]
    table = np.frombuffer(suffix_dedup.bit_table(spark.createDataFrame(rows, "bucket int, n long, hashes binary"), 4), np.uint8)
    assert suffix_dedup._marked(table, h).all()
    assert suffix_dedup._marked(table, h + np.uint64(2 ** 50)).mean() < 0.2


def test_no_members_no_links(copies):
    nothing = copies.select(F.lit(1).alias("list"), F.col("doc_id").alias("id"), F.lit(1).alias("size")).limit(0)
    links = graph.linked(nothing, lambda ids: None, 0.1, "none")
    assert links.collect() == []


def test_staged_leaves_no_shuffle_files_and_discard_no_table(spark):
    import os

    from pagemill.llm import common

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    shuffles = lambda: {b.toString() for b in _java_list(spark, manager.diskBlockManager().getAllBlocks()) if "shuffle_" in b.toString()}
    before, setting = shuffles(), spark.conf.get(common.SHUFFLE_CLEANUP)
    table = common.staged(spark.range(1000).repartition(5, "id"), "test")
    assert not shuffles() - before and spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    assert table.count() == 1000
    path = table._staged_path.removeprefix("file://")
    assert os.path.isdir(path)
    common.discard(table)
    assert not os.path.exists(path)


def _java_list(spark, seq):
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))


def test_links_leave_no_table_of_lists(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    members = spark.createDataFrame([(k, i) for k in range(4) for i in range(k, 40)], "list long, id long").withColumn("size", F.lit(None).cast("int"))
    distance = F.when((F.col("a") % 5) == (F.col("b") % 5), F.lit(0.0)).otherwise(F.lit(0.15))
    links = graph.linked(members, lambda ids: lambda pairs: pairs.withColumn("distance", distance), 0.1, "lists-of-test", pairs_a_row=0)
    assert {r.id: r.component for r in graph.components(links).collect()} == {i: i % 5 for i in range(40)}
    made = [set(spark.read.parquet(f"{folder}/{x}").columns) for x in os.listdir(folder) if x.startswith("llm-lists-of-test-")]
    # the links and the judged pairs; the last round's lists stay
    assert made and sum("list" in columns for columns in made) <= 1


def test_compared_lines_leave_no_table(edge_docs, monkeypatch):
    """The lines that are compared, their signatures and pairs are gone when the components are known."""
    made = []
    monkeypatch.setattr(line_dedup, "staged", lambda df, name, *a: made.append(staged(df, name, *a)) or made[-1])
    lines = line_dedup.line_components(edge_docs, dense=True)
    compared = [t for t in made if set(t.columns) in ({"id", "line"}, {"id", "signature"}, {"a", "b"})]
    assert len(compared) > 2 and not any(os.path.isdir(t._staged_path.removeprefix("file:")) for t in compared)
    assert lines.where("not kept").count()
