"""Operators 2 and 6."""

import math
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from pagemill.llm import sharding, topk


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string")


def _best(rows, k):
    vectors = [(i, [math.floor(256 * v) for v in e]) for i, e, *_ in rows
               if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = set()
    for q, x in {i: x for i, x in vectors if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def _run(df):
    x = topk.quantised(df)
    return [tuple(r) for r in topk.top_k(x, x.where(F.col("vec_id") % 50 == 0)).collect()]


def test_top_k_with_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-64, 64) / 128 for _ in range(6)], "r", "s") for i in range(300)]
    rows += [(400, None, None, None), (450, [0.1, None], None, None), (500, [float("nan")] * 6, None, None),
             (550, [float("inf")] * 6, None, None), (600, [], "x", "y"), (None, [0.5] * 6, None, None),
             (1001, rows[50][1], "tie", "tie"), (1002, rows[50][1], "tie", "tie")]
    got = _run(_vectors(spark, rows))
    assert len(got) == len(set(got)) and set(got) == _best(rows, 5)


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 200)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(4)
    rows = [(i, [float(rng.gauss(0, .2)) for _ in range(16)], "", "") for i in range(900)]
    import numpy as np
    rows = [(i, [float(np.float32(v)) for v in e], a, b) for i, e, a, b in rows]
    assert set(_run(_vectors(spark, rows))) == _best(rows, 5)


def test_top_k_with_few_or_no_vectors(spark):
    assert _run(_vectors(spark, [])) == []
    assert _run(_vectors(spark, [(0, [1.0], "", ""), (50, [2.0], "", "")])) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]


def _check_shards(rows, texts, tolerance):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < 16 for s in slots)
    assert {r.law for r in rows} <= {"bytes"} and {r.grown_shard for r in rows} <= {None}
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.size
    target = sum(size.values()) / 16
    assert all(abs(size[s] - target) <= tolerance * target for s in range(16))
    return where


def test_shards_are_even(sample_docs):
    texts = [(r.doc_id, r.text) for r in sample_docs.collect()]
    where = _check_shards(sharding.shard(sample_docs).collect(), texts, 0.25)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_of_a_third_is_kept_whole(spark):
    texts = [(i, f"text {i} " * 20) for i in range(2000)] + [(5000 + i, "the same text " * 15) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    where = _check_shards(sharding.shard(df).collect(), texts, 0.02)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_of_a_third_of_the_bytes_is_cut(spark):
    texts = [(i, f"text {i} " * 20) for i in range(2000)] + [(5000 + i, "the same text " * 15) for i in range(1000)]
    texts += [(7000 + i, "a second text " * 15) for i in range(300)] + [(None, None)] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert 0.25 < sum(len(t or "") + 1 for _, t in texts if t == texts[2000][1]) / sum(len(t or "") + 1 for _, t in texts) < 0.4
    where = _check_shards(sharding.shard(df).collect(), texts, 0.03)
    small = {(len(t) + 1, zlib.crc32(t.encode())) for i, t in texts[:2000]}
    assert all(len(s) == 1 for k, s in where.items() if k in small)


def test_one_documents_rows_stay_together(spark):
    texts = [(i, f"text {i} " * 20) for i in range(200)] + [(5000, "the same text " * 15)] * 100
    where = _check_shards(sharding.shard(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, 6)
    assert all(len(s) == 1 for s in where.values())


def test_shards_of_edge_rows(edge_docs, no_docs):
    rows = sharding.shard(edge_docs).collect()
    _check_shards(rows, [(r.doc_id, r.text) for r in edge_docs.collect()], 16)
    assert sharding.shard(no_docs).collect() == []


def test_written_shards_hold_the_texts(sample_docs, tmp_path):
    sharding.write_shards(sample_docs, str(tmp_path / "out"))
    back = sample_docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in sample_docs.collect())
    assert back.select("shard").distinct().count() == 16
