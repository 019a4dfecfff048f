"""Operator 12 against a plain Merkle tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import manifest

from .conftest import prose


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H(*low[i:i + arity]) for i in range(0, len(low), arity)])
    return levels


def way_up(levels, i, arity):
    out = []
    for low in levels[:-1]:
        first = i // arity * arity
        out.append(("".join(low[first:i]), "".join(low[i + 1:first + arity])))
        i //= arity
    return out


def plain(rows, arity=8):
    """rows: doc_id, source, lang, n_chars, text."""
    leaves = {}
    for r in rows:
        leaf = found = H(*map(field, r))
        if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            found = H(*map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
        leaves.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, found))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = [tree([x[2] for x in sorted(leaves[lang])], arity) for lang in langs]
    top = tree([t[-1][0] for t in trees], arity) if trees else []
    out = []
    for k, (lang, t) in enumerate(zip(langs, trees)):
        for i, (_, doc_id, leaf, found) in enumerate(sorted(leaves[lang])):
            path = way_up(t, i, arity) + way_up(top, k, arity)
            for before, after in path:
                found = H(before, found, after)
            out.append((doc_id, leaf, t[-1][0], top[-1][0], H(*(b + a for b, a in path)), found, found == top[-1][0]))
    return sorted(out)


def found(docs, **how):
    rows = manifest.Manifest(docs, observed=manifest.tampered(docs), **how).checked().collect()
    return sorted((r.id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows)


@pytest.fixture(scope="module")
def rows():
    """Groups of one, of a whole run, of one more, a hot one, nulls, repeated ids and repeated rows."""
    made = [(i, "s", "en", 5, "Text " + prose(i, 3)) for i in range(600)]
    made += [(700 + i, None, "Ünï", None, f"T{i}") for i in range(8)] + [(800 + i, "x", "de", i, None) for i in range(9)]
    made += [(900, "s", None, 1, ""), (None, "s", None, 1, "No id"), (None, None, None, None, None), (901, "s", "", 1, "Z" * 50_000)]
    made += [(902, "s", "fr", 1, "Same Row")] * 20 + [(903, "s", "fr", 1, "A"), (903, "s", "fr", 1, "B")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("g", "pos", "m", "h", "id", "part", "seq", "block", "path"):
        made = made.withColumn(c, F.lit("own"))
    return made.repartition(7)


def test_against_a_plain_tree(docs, rows):
    assert found(docs) == plain(rows)


@pytest.mark.parametrize("step", [1, 2])
def test_other_checkpoints_and_runs(docs, rows, step):
    assert found(docs, arity=3, step=step) == plain(rows, 3)


def test_proofs_fold_to_the_root(docs, rows):
    made = manifest.Manifest(docs)
    root = made.root().first().root
    proofs = made.proofs().collect()
    assert len(proofs) == len(rows)
    assert all(manifest.fold(p.leaf, p.path) == root == p.root for p in proofs)
    assert all(manifest.fold(H(p.leaf), p.path) != root for p in proofs[:50])


def test_one_row_and_none(docs, rows):
    assert found(docs.limit(0)) == []
    one = docs.where("doc_id = 900")
    got = found(one)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("") and got == plain([r for r in rows if r[0] == 900])


def test_whole_sample(sample_docs):
    rows = [tuple(r) for r in sample_docs.select(*manifest.FIELDS).collect()]
    assert found(sample_docs) == plain(rows)
