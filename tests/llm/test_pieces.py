"""Operator 13 against the sentencepiece library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import pieces
from pagemill.llm.common import tokenizer_file

ALPHABET = list("abcdefgh the ing \n\t .,'\"0123▁▁   éü漢字ﬁ①Å̈½ア゛　 \x00�\U0001F600 ́")
TEXTS = ["", " ", "  ", "▁", " ▁ ", " a", "a ", "\n", " \n ", "a" * 500, " " * 300 + "x", "abc" * 400, "漢" * 100, "x y" * 3000]


@pytest.fixture(scope="module")
def data():
    with open(tokenizer_file(pieces.MODEL), "rb") as f:
        return f.read()


def texts(n=1500):
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def compare(data, cases):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.PieceModel(data)
    for text in cases:
        ids, begin, end = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        proto = [dict(pieces._fields(v)) for k, v in pieces._fields(library.encode(text, out_type="serialized_proto")) if k == 2]
        assert list(zip(begin.tolist(), end.tolist())) == [(p.get(4, 0), p.get(5, 0)) for p in proto], text
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), text
    return library, own


def test_ids_spans_and_texts_are_the_librarys(data, sample_docs):
    compare(data, texts() + [r.text for r in sample_docs.select("text").collect()])


def test_any_ids_decode_as_in_the_library(data):
    library, own = compare(data, [])
    rng = random.Random(5)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, 259, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("change", ["none", "spare", "no prefix", "suffix", "no bytes"])
def test_character_maps_and_spaces(data, rule, change):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model, spec = pb.ModelProto(), pb.ModelProto()
    model.ParseFromString(data)
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = change == "spare"
    model.normalizer_spec.add_dummy_prefix = change != "no prefix"
    model.trainer_spec.treat_whitespace_as_suffix = change == "suffix"
    if change == "no bytes":
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = 1 if p.type == 6 else p.type
    compare(model.SerializeToString(), texts(600))


def test_other_models_are_refused(data):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(data)
    model.pieces[500].type = pieces.USER_DEFINED
    with pytest.raises(ValueError):
        pieces.PieceModel(model.SerializeToString())


def test_a_cleared_cache_changes_nothing(data, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    compare(data, texts(200))


def test_query_rows(edge_docs, no_docs, data):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in edge_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(edge_docs).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.round_trip(no_docs).collect() == []


def test_spans_cover_the_source(edge_docs):
    encoded = pieces.encode(edge_docs.withColumn("source_text", F.col("text")))
    rows = encoded.collect()
    assert len(rows) == edge_docs.count() and "key" in encoded.columns
    for r in rows:
        raw, at = (r.source_text or "").encode(), 0
        for a, b in zip(r.begin, r.end):
            assert a == at and b >= a
            at = b
        assert at == len(raw) and len(r.ids) == r.n_tokens
    back = pieces.decode(encoded).select("source_text", "decoded").collect()
    assert all(b.decoded == (b.source_text or "") for b in back)
