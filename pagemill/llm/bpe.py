"""Operator 10: byte-level BPE encoding and decoding with DuckDB queries per partition.

A worker keeps the merge table (left, right, merged) and the tokens' bytes in
an in-memory DuckDB.  The distinct pre-tokens of a batch become token-position
rows; a recursive query joins neighbours with the merge table and contracts
the leftmost pair of minimum rank of each word until none is left.  Decoding
joins (row, position, id) with the tokens' bytes and aggregates them in order.

A word that is itself a token is that token, as in the tiktoken library.  The
recursion stops after a number of steps that bounds its rows, and goes on from
there in a new query.  Contracting row by row is quadratic in a word's length;
words over LONG_WORD bytes follow the same rule with a heap instead.

Null and empty texts encode to no ids and decode to no bytes.  Repeated rows
are encoded each; other columns may be kept.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query, tokenizer_file, worker_holds

LONG_WORD = 1024
BATCH_CHARS = 1_500_000
STEP_ROWS = 4_000_000      # rows that one recursive query may pile up
CACHE = 700_000            # encoded words that a worker keeps before it starts anew

_STATE: dict = {}

# g = word * 1024 + position; key = rank of the pair * 2**20 + position * 1024 + position of its right half,
# so that the least key of a word is its leftmost pair of minimum rank.
ENCODE = """
WITH RECURSIVE r(step, g, w, tok, key) AS (
  SELECT 0::INT, g, w, tok, m.m + (g % 1024) * 1024 + nxt % 1024
  FROM (SELECT g, w, tok, lead(tok) OVER o AS rt, lead(g) OVER o AS nxt FROM seed WINDOW o AS (ORDER BY g)) s
  LEFT JOIN merges m ON m.pair = CASE WHEN nxt // 1024 = g // 1024 THEN s.tok * 1048576::BIGINT + s.rt END
  UNION ALL
  SELECT step, g, w, tok, m.m + (g % 1024) * 1024 + nxt % 1024
  FROM (SELECT step, g, w, tok, lead(tok) OVER o AS rt, lead(g) OVER o AS nxt
        FROM (SELECT step + 1 AS step, g, r.w, CASE WHEN key = best THEN (best // 1048576)::INT ELSE tok END AS tok
              FROM r JOIN (SELECT w, min(key) AS best, w::BIGINT * 1024 + min(key) % 1024 AS gone
                           FROM r GROUP BY w HAVING min(key) IS NOT NULL) b ON r.w = b.w
              WHERE g <> gone AND step < {steps})
        WINDOW o AS (ORDER BY g)) s
  LEFT JOIN merges m ON m.pair = CASE WHEN nxt // 1024 = g // 1024 THEN s.tok * 1048576::BIGINT + s.rt END
)
SELECT g, w, tok, step = {steps} AND key IS NOT NULL AS open
FROM r SEMI JOIN (SELECT w, max(step) AS step FROM r GROUP BY w) USING (w, step) ORDER BY g
"""

DECODE = """
SELECT d, string_agg(hex, '' ORDER BY pos) AS hex
FROM ids JOIN tokens USING (tok) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One worker's DuckDB with a vocabulary's tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.first = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.cache: dict[str, bytes] = {}          # ids as little-endian uint32
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        left, right, tok = zip(*pairs) if pairs else ((), (), ())
        merges = pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()), "tok": pa.array(tok, pa.int64())})
        tokens = pa.table({"tok": pa.array(list(ranks.values()), pa.int64()), "hex": pa.array([t.hex() for t in ranks])})
        self.db.register("m", merges)
        self.db.register("t", tokens)
        self.db.execute("CREATE TABLE merges AS SELECT l * 1048576 + r AS pair, tok * 1048576 AS m FROM m")
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM t")

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (no word is a token, none is empty)."""
        import numpy as np
        import pyarrow as pa

        out: list[list[int]] = [[] for _ in words]
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(x) for x in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        g = w * np.int64(1024) + np.arange(len(data)) - np.repeat(starts, sizes)
        tok = np.array(self.first, np.int32)[data]
        while len(w):
            steps = max(2, STEP_ROWS // len(w))
            self.db.register("seed", pa.table({"g": g, "w": w, "tok": tok}))
            got = self.db.execute(ENCODE.format(steps=steps)).fetchnumpy()
            self.db.unregister("seed")
            again = np.isin(got["w"], np.unique(got["w"][np.asarray(got["open"])]))
            ws, ts = got["w"][~again], got["tok"][~again].tolist()
            cuts = [*np.flatnonzero(np.diff(ws, prepend=-1)).tolist(), len(ws)]
            for at, i, j in zip(ws[cuts[:-1]].tolist(), cuts, cuts[1:]):
                out[at] = ts[i:j]
            g, w, tok = got["g"][again], got["w"][again], got["tok"][again]
        return out

    def _contract_long(self, word: bytes) -> list[int]:
        """The same rule with a heap: the leftmost pair of minimum rank first."""
        import heapq

        ranks, n = self.ranks, len(word)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != to:
                continue
            end[i], alive[j], nxt[i] = to, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(word[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prv[i] >= 0 and (r := ranks.get(word[prv[i]:to])) is not None:
                heapq.heappush(heap, (r, prv[i], to))
        return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> list:
        """uint32 array of ids for each text."""
        import struct

        import numpy as np

        split = [self.split(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.cache))
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = list({w for ws in split for w in ws})
        todo = []
        for word in new:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                ids = self._contract_long(raw)
                self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                todo.append((word, raw))
        if todo:
            for (word, _), ids in zip(todo, self._contract([r for _, r in todo])):
                self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        known = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(known, ws)), "<u4") for ws in split]

    def decode(self, rows: list) -> list[bytes]:
        """Bytes of each array of ids."""
        import numpy as np
        import pyarrow as pa

        sizes = np.array([len(x) for x in rows], np.int64)
        out = [b""] * len(rows)
        if sizes.sum():
            starts = np.cumsum(sizes) - sizes
            self.db.register("ids", pa.table({
                "d": np.repeat(np.arange(len(rows)), sizes), "pos": np.arange(sizes.sum()) - np.repeat(starts, sizes),
                "tok": np.concatenate(rows).astype(np.int64)}))
            for d, text in self.db.execute(DECODE).fetchall():
                out[d] = bytes.fromhex(text)
            self.db.unregister("ids")
        return out


def _codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if worker_holds(_STATE).get("key") != key:
        _STATE.update(key=key, codec=Codec(read_ranks(path), pattern))
    return _STATE["codec"]


def _grouped(values: list, size) -> list[list]:
    groups, group, total = [], [], 0
    for v in values:
        group.append(v)
        total += size(v)
        if total > BATCH_CHARS:
            groups.append(group)
            group, total = [], 0
    return groups + [group] if group else groups


def _encode(path: str, pattern: str, ids_too: bool, digest: bool):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        codec = _codec(path, pattern)
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            columns = [batch.column(x) for x in names]
            ids = []
            made = {"n_tokens": None, "ids": None, "ids_sha256": [], "decoded_sha256": []}
            for texts in _grouped(batch.column("text").to_pylist(), lambda t: len(t or "")):
                own = codec.encode(texts)
                ids += own
                if digest:
                    made["ids_sha256"] += [hashlib.sha256(x.tobytes()).hexdigest() for x in own]
                    made["decoded_sha256"] += [hashlib.sha256(x).hexdigest() for x in codec.decode(own)]
            n = np.array([len(x) for x in ids], np.int64)
            made["n_tokens"] = pa.array(n)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            made["ids"] = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *n])), pa.array(flat.astype(np.int32)))
            told = ["n_tokens"] + ["ids"] * ids_too + ["ids_sha256", "decoded_sha256"] * digest
            made["ids"] = made["ids"].cast(pa.list_(pa.int32())) if ids_too else None
            yield pa.RecordBatch.from_arrays(columns + [x if isinstance(x, pa.Array) else pa.array(x, pa.string())
                                                        for x in map(made.get, told)], names=names + told)

    return run


def _decode(path: str, pattern: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = _codec(path, pattern)
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "ids"]
            names = [x for x in batch.schema.names if x != "ids"]
            made = []
            for rows in _grouped(batch.column("ids").to_pylist(), lambda x: 4 * len(x or ())):
                made += codec.decode([np.array(x or (), np.int64) for x in rows])
            yield pa.RecordBatch.from_arrays(rest + [pa.array(made, pa.binary())], names=names + ["decoded"])

    return run


def _vocabulary(ranks: str, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return tokenizer_file(ranks), pattern


def _schema(df: DataFrame, without: str, more: str) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != without)
    return ", ".join(x for x in (kept, more) if x)


def encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None,
           checked: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids in place of text.

    ``checked`` adds ids_sha256 and decoded_sha256: the ids are decoded again
    in the same task.  Columns of ``docs`` with the new names are replaced.
    """
    docs = docs.drop("n_tokens", "ids", *["ids_sha256", "decoded_sha256"] * checked)
    more = "n_tokens long, ids array<int>" + ", ids_sha256 string, decoded_sha256 string" * checked
    return docs.mapInArrow(_encode(*_vocabulary(ranks, pattern), True, checked), _schema(docs, "text", more))


def decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """``encoded`` with the binary column decoded in place of ids (null: no bytes)."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(*_vocabulary(ranks, pattern)), _schema(encoded, "ids", "decoded binary"))


def round_trip(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again within one task."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(*_vocabulary(ranks, pattern), False, True),
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
