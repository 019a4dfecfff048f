"""Operator 1: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's most frequent pre-tokens and
their lengths in tokens, found by one pass in which every task keeps a bounded
summary; only summaries are merged, pre-tokens are never shuffled.  Tier two
is a bounded cache in each Python worker; what it misses is encoded by the
tokenizer library, a batch at a time.  The tables only save work: any table
gives the same counts.

A text that holds an added token's string, or a character whose class (letter,
number, space) is not the same in all Unicode versions since 3.2, is encoded
whole by the library.

Null and empty texts have no bytes and no tokens.  Repeated rows are counted
one by one; other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query, staged, tokenizer_file, worker_holds

FREQUENT = 32_768          # entries of the broadcast table, each of at most LONGEST bytes: under 4 MB
LONGEST = 64
SUMMARY = 65_536           # pre-tokens that a task's summary keeps
PENDING = 500_000          # pre-tokens counted before they are added to a task's summary
CACHE = 400_000            # pre-tokens that a worker's cache keeps before it starts anew
FAN_IN = 32                # summaries merged at once
BATCH_CHARS = 2_000_000

_STATE: dict = {}


def _tokenizer(path: str):
    if ("tok", path) not in worker_holds(_STATE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _STATE["tok", path] = Tokenizer.from_file(path)
    return _STATE["tok", path]


def _splitter():
    if "split" not in _STATE:
        import regex

        # words and numbers come first, being the most; contractions start with neither, so the order tells no difference
        space = r"\p{White_Space}"
        _STATE["split"] = regex.compile(
            rf" ?\p{{L}}+| ?\p{{N}}+|'(?:[stmd]|re|ve|ll)| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?!\P{{White_Space}})|{space}+").findall
    return _STATE["split"]


def stable_characters(text: str, known: set) -> bool:
    """Whether all characters have the class that every Unicode version since 3.2 gives them."""
    import unicodedata

    for c in set(text) - known:
        old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        if old == "Cn" or old[0] != new[0] or c in "\x1c\x1d\x1e\x1f\x85\u180e\u200b":
            return False
        known.add(c)
    return True


def most_frequent(counts: dict, k: int) -> list[tuple[str, int]]:
    """The k largest counts, of equal ones those of the smaller tokens; in no order."""
    import numpy as np

    if len(counts) <= k:
        return list(counts.items())
    least = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - k)[len(counts) - k])
    above = [(t, n) for t, n in counts.items() if n > least]
    return above + [(t, least) for t in sorted(t for t, n in counts.items() if n == least)[:k - len(above)]]


class _Summary(dict):
    """Pre-token counts, cut back to the most frequent when they outgrow the bound."""

    def add(self, counts) -> None:
        if self:
            for token, n in counts:
                self[token] = self.get(token, 0) + n
        else:
            self.update(counts)
        if len(self) > 4 * SUMMARY:
            self.cut()

    def cut(self) -> None:
        if len(self) > SUMMARY:
            kept = most_frequent(self, SUMMARY)
            self.clear()
            self.update(kept)

    def packed(self) -> bytes:
        import pickle
        import zlib

        self.cut()
        return zlib.compress(pickle.dumps(sorted(self.items())), 1)


def _unpacked(blob: bytes):
    import pickle
    import zlib

    return pickle.loads(zlib.decompress(blob))


def _summarise(batches):
    import pyarrow as pa
    from collections import Counter

    from pyspark import TaskContext

    split, total, pending = _splitter(), _Summary(), Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                pending.update(split(text))
                if len(pending) > PENDING:
                    total.add((t, n) for t, n in pending.items() if len(t) <= LONGEST)
                    pending = Counter()
    total.add((t, n) for t, n in pending.items() if len(t) <= LONGEST)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.packed()])],
                                         names=["task", "summary"])


def _merge(key, pdf):
    import pandas as pd

    total = _Summary()
    for blob in pdf["summary"]:
        total.add(_unpacked(blob))
    return pd.DataFrame({"task": [key[0]], "summary": [total.packed()]})


def frequent_pretokens(texts: DataFrame, column: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts, at most FREQUENT.

    Tasks' summaries are merged FAN_IN at a time; the driver sees FAN_IN of them.
    """
    rows = texts.select(F.col(column).alias("text")).mapInArrow(_summarise, "task long, summary binary")
    left = max(1, texts.rdd.getNumPartitions())
    while left > FAN_IN:
        rows = (rows.groupBy(F.floor(F.col("task") / FAN_IN).alias("g"))
                .applyInPandas(_merge, "task long, summary binary"))
        left = -(-left // FAN_IN)
    total = _Summary()
    # written by all tasks side by side: an iterator over ``rows`` itself would run one task after the other
    for row in staged(rows, "op1").toLocalIterator():
        total.add(_unpacked(row.summary))
    return [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if len(t.encode()) <= LONGEST]


def _lengths(tokens: list[str], path: str) -> list[int]:
    if not tokens:
        return []
    tok = _tokenizer(path)
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)       # without offsets, where the library has it
    return [len(e) for e in encode(tokens, add_special_tokens=False)]


def _packed_table(tokens: list[str], path: str):
    import numpy as np

    return "".join(tokens), np.cumsum([0, *map(len, tokens)]).astype(np.uint32), np.array(_lengths(tokens, path), np.uint16)


def _table(broadcast) -> dict:
    if _STATE.get("table_of") is not broadcast:
        text, at, n = broadcast.value
        cuts = at.tolist()
        _STATE["table"] = dict(zip((text[a:b] for a, b in zip(cuts, cuts[1:])), n.tolist()))
        _STATE["table_of"] = broadcast
    return _STATE["table"]


def _both_tiers(frequent: dict) -> dict:
    """The worker's cache, which starts from the table; a function, since tasks get copies of what they name themselves."""
    if _STATE.get("cache_of") is not frequent:
        _STATE.update(cache_of=frequent, cache=dict(frequent))
    return _STATE["cache"]


def _count(path: str, table):
    def run(batches):
        from itertools import repeat

        import pyarrow as pa
        import pyarrow.compute as pc

        tok = _tokenizer(path)
        frequent, split, known = _table(table), _splitter(), set()
        cache = _both_tiers(frequent)
        added = [t.content for t in tok.get_added_tokens_decoder().values()]

        def counted(texts):
            out, missing = [], []
            for text in texts:
                if not text:
                    out.append(0)
                elif not stable_characters(text, known) or any(a in text for a in added):
                    out.append(len(tok.encode(text, add_special_tokens=False).ids))
                else:
                    tokens = split(text)
                    found = list(map(cache.get, tokens, repeat(0)))      # no pre-token has 0 tokens
                    if 0 in found:
                        missing.append((len(out), [t for t, n in zip(tokens, found) if not n]))
                    out.append(sum(found))
            new = list({t for _, ts in missing for t in ts})
            if len(cache) + len(new) > len(frequent) + CACHE:
                cache.clear()
                cache.update(frequent)
            cache.update(zip(new, _lengths(new, path)))
            for i, ts in missing:
                out[i] += sum(map(cache.__getitem__, ts))
            return out

        for batch in batches:
            column, counts, group, chars = batch.column("text"), [], [], 0
            for text in column.to_pylist():
                group.append(text)
                chars += len(text or "")
                if chars > BATCH_CHARS:
                    counts += counted(group)
                    group, chars = [], 0
            counts += counted(group)
            sizes = pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024,
                 frequent: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text)."""
    path = tokenizer_file(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if frequent is None:
        frequent = frequent_pretokens(docs)
    table = docs.sparkSession.sparkContext.broadcast(_packed_table(frequent, path))
    return (docs.mapInArrow(_count(path, table), "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
