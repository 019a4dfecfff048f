"""Operators 1 and 10 against the tokenizer libraries."""

import ctypes
import hashlib
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import bpe, token_counts
from pagemill.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")))


def test_counts_are_the_librarys(edge_docs, library):
    rows = edge_docs.select("doc_id", "text").collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(edge_docs).collect())
    want = []
    for r in rows:
        n = len(library.encode(r.text, add_special_tokens=False).ids) if r.text else 0
        want.append((r.doc_id or 0, len((r.text or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_counts_do_not_depend_on_the_table(sample_docs, library):
    plain = {r.doc_id: r.n_tokens for r in token_counts.token_counts(sample_docs, frequent=[]).collect()}
    table = {r.doc_id: r.n_tokens for r in token_counts.token_counts(sample_docs).collect()}
    assert plain == table == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in sample_docs.collect()}


def test_summaries_merge_over_many_partitions(sample_docs):
    few = token_counts.frequent_pretokens(sample_docs)
    many = token_counts.frequent_pretokens(sample_docs.repartition(70))
    assert few == many and few[0] in (" the", ".")


def test_summaries_are_made_side_by_side(spark, sample_docs):
    docs, context = sample_docs.repartition(12).cache(), spark.sparkContext
    docs.count()
    context.setJobGroup("summaries", "all partitions in one job")
    try:
        assert token_counts.frequent_pretokens(docs)
        told = context.statusTracker()
        jobs = [told.getJobInfo(j) for j in told.getJobIdsForGroup("summaries")]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 12 in {told.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if told.getStageInfo(s)}


def test_a_summary_is_cut_without_sorting_all_of_it(monkeypatch):
    compared = []

    class Token(str):
        __hash__ = str.__hash__

        def __lt__(self, other):
            compared.append(1)
            return str.__lt__(self, other)

    monkeypatch.setattr(token_counts, "SUMMARY", 100)
    rows = [(Token(f"t{i * 7919 % 5000}"), 9 if i < 95 else 5 if i < 105 else 1) for i in range(5000)]
    summary = token_counts._Summary()
    summary.add(iter(rows))
    summary.cut()
    compared_in_cuts = len(compared)
    want = sorted(rows, key=lambda x: (-x[1], str(x[0])))[:100]
    assert sorted((str(t), n) for t, n in summary.items()) == sorted((str(t), n) for t, n in want)
    assert compared_in_cuts < 1000


def test_counts_with_a_cache_that_starts_anew(spark, sample_docs, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_counts, "CACHE", 50)
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 3000)
    rows = sample_docs.limit(60).collect()
    path = tokenizer_file("byte_bpe_50k.json")

    class Table:
        value = token_counts._packed_table([" the", ".", " of"], path)

    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in rows]), pa.array([r.text for r in rows])], names=["doc_id", "text"])
    got = [n for b in token_counts._count(path, Table())([batch]) for n in b.column("n_tokens").to_pylist()]
    assert got == [len(library.encode(r.text, add_special_tokens=False).ids) for r in rows]


def test_a_worker_keeps_the_state_of_one_operator(ranks, sample_docs):
    import pyarrow as pa

    path = bpe._vocabulary("byte_bpe_50k.tiktoken", None)
    codec = bpe._codec(*path)
    assert bpe._STATE["codec"] is codec is bpe._codec(*path)
    token_counts._tokenizer(tokenizer_file("byte_bpe_50k.json"))
    assert not bpe._STATE
    batch = pa.RecordBatch.from_arrays([pa.array(["some text", None])], names=["text"])
    assert [b.column("n_tokens").to_pylist() for b in bpe._encode(*path, True, True)([batch])] == [[2, 0]]
    assert not token_counts._STATE


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library is not glibc")
@pytest.mark.parametrize("how", ["worker_frees(state)", "worker_holds({})"])
def test_a_worker_gives_its_memory_back(how):
    """Also what lies below memory still in use, which the C library keeps by itself."""
    code = f"""
import re
from pagemill.llm.common import worker_frees, worker_holds
def mb():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
state = worker_holds({{}})
state["rows"] = [bytearray(4000) for _ in range(30_000)]
above, held = bytearray(4000), mb()
{how}
assert not state and held - mb() > 90, (held, mb())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


def test_unstable_characters_are_told():
    assert token_counts.stable_characters("plain été 東京 12", set())
    assert not token_counts.stable_characters("a\x1cb", set())
    assert not token_counts.stable_characters("a\U0001FAE0b", set())


def test_no_documents(no_docs):
    assert token_counts.token_counts(no_docs).collect() == []
    assert bpe.round_trip(no_docs).collect() == []


def test_ids_and_bytes_are_the_librarys(edge_docs, ranks):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(edge_docs).collect())
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = ranks.encode_ordinary(r.text or "")
        want.append((r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_sample_round_trip(sample_docs, ranks):
    encoded = bpe.encode(sample_docs.select("doc_id", "text", F.col("source").alias("kept_column")))
    decoded = bpe.decode(encoded).select("doc_id", F.col("decoded").cast("string").alias("back"), "kept_column")
    rows = {r.doc_id: r for r in encoded.join(decoded, "doc_id").collect()}
    for r in sample_docs.collect():
        assert rows[r.doc_id].ids == ranks.encode_ordinary(r.text)
        assert rows[r.doc_id].back == r.text


def test_contraction_in_many_short_queries(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_ROWS", 10)      # two steps a query
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = ["internationalization" * 9, "aaaaaaaaaaaaaaaaaaaaaaaab", "====" * 50, "abab" * 100, "é" * 33]
    assert [x.tolist() for x in codec.encode(texts)] == [ranks.encode_ordinary(t) for t in texts]
    assert codec._contract_long(b"abab" * 700) == ranks.encode_ordinary("abab" * 700)
