"""Operator 13: SentencePiece (BPE) encoding and decoding that keeps source offsets.

Encoding has three steps.  Normalisation takes at each position of the text
the longest key of the model's compiled character map, or else one character
as it is, and records for every byte it writes the byte of the source it came
from.  The normalised text is cut where no piece of the vocabulary can reach
across, and each unit is merged pair by pair, best score first, leftmost among
equals; characters outside the vocabulary become byte pieces.  At last each
piece's span in the normalised text is projected through the recorded
alignment to a span of the source's bytes.  Units repeat, so a worker keeps a
bounded cache of them.

Decoding joins the pieces' texts, assembles byte pieces to characters (a byte
that belongs to none becomes U+FFFD) and drops the space put before the text.

Null and empty texts have no pieces (with ``end`` the end id alone, its span
empty) and decode to an empty text.  Long texts are merged with a heap, in
n log n steps.  Repeated rows are encoded each; other columns may be kept, and
those with a new column's name are replaced.  An empty table gives an empty
result.  Models other than BPE, or with user-defined or unused pieces, are
refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query, tokenizer_file, worker_holds

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE = 700_000            # units that a worker keeps before it starts anew
CACHED_CHARS = 64          # longer units are not kept
SHORT = 24                 # characters of a unit that is merged by looking at all its pairs

_STATE: dict = {}

# Fixed values of the model file: field numbers and piece types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, SPARE_SPACES, ESCAPED_SPACES = 2, 3, 4, 5
BPE = 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

NEVER = float("inf")


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message; values are ints or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, and the texts they become."""

    def __init__(self, blob: bytes):
        import numpy as np

        self.units, self.texts = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4:4 + size], "<u4")
            self.texts = blob[4 + size:]
        self.starts = self._first_characters()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _first_characters(self) -> str:
        """Characters that a key begins with."""
        import numpy as np

        labels = np.arange(256)
        found, todo = [], [(self._offset(int(self.units[0])), b"")] if len(self.units) else []
        while todo:
            node, prefix = todo.pop()
            slots = node ^ labels
            units = np.where(slots < len(self.units), self.units[np.minimum(slots, len(self.units) - 1)], 0).astype(np.int64)
            for b in np.flatnonzero((units & 0x800000FF) == labels).tolist():
                if b == 0:
                    continue
                text = prefix + bytes([b])
                try:
                    found.append(text.decode())
                except UnicodeDecodeError:
                    todo.append((int(slots[b]) ^ self._offset(int(units[b])), text))
        return "".join(sorted(found))

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Text and length of the longest key at byte ``at`` of ``data``."""
        units, best = self.units, None
        if not len(units):
            return None
        node = self._offset(int(units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(units[node]) if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = int(units[node]) & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.texts[best[0]:self.texts.index(b"\0", best[0])], best[1]


class Normaliser:
    def __init__(self, spec: dict, suffix_space: bool):
        import re

        self.map = CharacterMap(spec.get(CHARACTER_MAP, b""))
        self.dummy = bool(spec.get(DUMMY_PREFIX, 1))
        self.spare = bool(spec.get(SPARE_SPACES, 1))       # leading, trailing and repeated spaces go
        self.space = SPACE.encode() if spec.get(ESCAPED_SPACES, 1) else b" "
        self.suffix = suffix_space
        self.starts = re.compile("[" + re.escape(self.map.starts) + "]") if self.map.starts else None

    def _replaced(self, text: str):
        """(bytes, source byte of each) after the character map."""
        import numpy as np

        raw = text.encode()
        source = np.arange(len(raw))
        if self.starts is None or not self.starts.search(text):
            return np.frombuffer(raw, np.uint8), source
        parts, origins, done, chars, byte = [], [], 0, 0, 0
        for m in self.starts.finditer(text):
            byte += len(text[chars:m.start()].encode())
            chars = m.start()
            if byte < done:
                continue                       # inside the last key
            hit = self.map.longest(raw, byte)
            if hit is None:
                continue
            parts += [raw[done:byte], hit[0]]
            origins += [source[done:byte], np.full(len(hit[0]), byte)]
            done = byte + hit[1]
        parts.append(raw[done:])
        origins.append(source[done:])
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(origins)

    def normalise(self, text: str):
        """Normalised text, and the source byte of each of its bytes (and of its end)."""
        import numpy as np

        size = len(text.encode())
        data, source = self._replaced(text)
        end = size
        if self.spare:
            space = data == 32
            before = np.concatenate(([True], space[:-1]))
            kept = ~(space & before)
            data, source = data[kept], source[kept]
            while len(data) and (width := next((w for w in {b" ", self.space} if data[-len(w):].tobytes() == w), b"")):
                data, source, end = data[:-len(width)], source[:-len(width)], int(source[-len(width)])
        if not len(data):
            return "", np.zeros(1, np.int64)
        first = int(source[0]) if self.spare else 0
        if len(self.space) > 1:
            width = np.where(data == 32, len(self.space), 1)
            source = np.repeat(source, width)
            data = data.tobytes().replace(b" ", self.space)
        else:
            data = data.tobytes()
        if self.dummy:
            pad = np.full(len(self.space), end if self.suffix else first)
            data = data + self.space if self.suffix else self.space + data
            source = np.concatenate((source, pad) if self.suffix else (pad, source))
        return data.decode(), np.concatenate((source, [end]))


class Pasted:
    """Byte strings by number, to be strung together for a whole array of numbers."""

    def __init__(self, strings: list[bytes]):
        import numpy as np

        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, numbers) -> bytes:
        import numpy as np

        size = self.size[numbers]
        end = np.cumsum(size)
        return self.data[np.repeat(self.start[numbers] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


class PieceModel:
    """Vocabulary, normaliser and merges of one model file."""

    def __init__(self, data: bytes):
        import re
        import struct

        import numpy as np

        self.pieces, kinds, scores, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == PIECES:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_TYPE) != BPE or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models without user-defined or unused pieces")
        suffix = bool(trainer.get(SUFFIX_SPACE, 0))
        self.normaliser = Normaliser(normalizer, suffix)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.cost = {p: -scores[i] for p, i in self.ids.items()}
        self.packed = {p: struct.pack("2i", i, len(p.encode())) for p, i in self.ids.items()}
        self.unknown = kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.byte = [0] * 256
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        surface = trainer.get(UNKNOWN_SURFACE, b" \xe2\x81\x87 ")
        self.raw, self.control = [], set()
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
            if k == CONTROL:
                self.control.add(i)
            self.raw.append(b"" if k == CONTROL else surface if k == UNKNOWN
                            else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode())
        # Units: characters that no longer piece holds stand alone; a run of spaces opens a unit if no
        # piece has a space after another character.  No merge crosses a unit's edge then.
        longer = [p for p in self.ids if len(p) > 1]
        self.pairs = {p[i:i + 2] for p in longer for i in range(len(p) - 1)}
        merging = "".join(sorted({c for p in longer for c in p} - {SPACE}))
        inner = any(SPACE in p.lstrip(SPACE) for p in longer)
        some = "[" + re.escape(merging) + "]+" if merging else "(?!)"
        self.units = re.compile(f"(?:{some}|{SPACE})+|." if inner else f"{SPACE}*{some}|{SPACE}+|.", re.S).findall
        self.cache: dict = {}
        self.texts, self.numbers = Pasted(self.raw), Pasted([b"%d " % i for i in range(len(self.raw))])
        self.controls = np.isin(np.arange(len(self.raw)), list(self.control))

    def merged(self, unit: str) -> list[str]:
        """Pieces of a unit: of all neighbours that form a piece the best-scored, leftmost first, is joined."""
        import heapq

        cost, n = self.cost.get, len(unit)
        if n <= SHORT:
            parts = list(unit)
            found = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while found and (best := min(found)) < NEVER:
                at = found.index(best)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                del found[at]
                if at < len(found):
                    found[at] = cost(parts[at] + parts[at + 1], NEVER)
                if at:
                    found[at - 1] = cost(parts[at - 1] + parts[at], NEVER)
            return parts
        end = list(range(1, n + 1))                       # end of the part that starts here; 0: joined
        before = list(range(-1, n - 1))                   # start of the part to the left
        heap = [(s, i, i + 2) for i in range(n - 1) if (s := cost(unit[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue                                  # one of the two has changed since
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (s := cost(unit[i:end[to]])) is not None:
                    heapq.heappush(heap, (s, i, end[to]))
            if i and (s := cost(unit[before[i]:to])) is not None:
                heapq.heappush(heap, (s, before[i], to))
        return [unit[i:end[i]] for i in range(n) if end[i]]

    def _piece(self, part: str) -> bytes:
        """Pairs of id and length of one piece; the last byte piece covers a character outside the vocabulary."""
        import struct

        raw = part.encode()
        if not self.fallback:
            return struct.pack("2i", self.unknown, len(raw))
        return struct.pack(f"{2 * len(raw)}i", *(x for i, b in enumerate(raw, 1) for x in (self.byte[b], i // len(raw) * len(raw))))

    def _unit(self, unit: str) -> bytes:
        """Pairs of id and length (in bytes of the normalised text) of a unit's pieces, as int32."""
        known = self.cache.get(unit)
        if known is None:
            # no piece holds neighbours that are cut here, so none reaches across
            tried = range(1, len(unit)) if len(unit) > SHORT else (len(unit) - 1,) * (len(unit) > 1)
            cuts = [i for i in tried if unit[i - 1:i + 1] not in self.pairs]
            if cuts:
                known = b"".join([self._unit(unit[a:b]) for a, b in zip([0, *cuts], [*cuts, len(unit)])])
            else:
                packed = self.packed.get
                known = b"".join([packed(p) or self._piece(p) for p in self.merged(unit)])
            if len(unit) <= CACHED_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[unit] = known
        return known

    def encode(self, text: str | None):
        """Arrays ids, begin, end: the pieces of a text and the source bytes they stand for."""
        import numpy as np

        norm, source = self.normaliser.normalise(text or "")
        known = self.cache.get
        pairs = np.frombuffer(b"".join([known(u) or self._unit(u) for u in self.units(norm)]), np.int32).reshape(-1, 2)
        ids, sizes = pairs[:, 0], pairs[:, 1].astype(np.int64)
        if not self.fallback and len(ids):               # neighbouring unknown characters are one piece
            first = np.concatenate(([True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)))
            starts = np.flatnonzero(first)
            ids, sizes = ids[starts], np.add.reduceat(sizes, starts)
        ends = np.cumsum(sizes)
        return ids, source[ends - sizes], source[ends]

    def decode(self, ids) -> str:
        """Text of a sequence of ids."""
        import codecs

        import numpy as np

        ids = np.asarray(ids, np.int64)
        control = self.controls[ids]
        spare = 0                                        # spaces put before the text
        if self.normaliser.dummy or self.normaliser.spare:
            for i in ids[~control]:
                if not self.pieces[i].startswith(SPACE):
                    break
                spare += 1
                if not self.normaliser.spare or len(self.pieces[i]) > 1:
                    break
        parts = [self.texts(ids)]
        if control[:-1].any():                           # byte pieces do not meet across control pieces
            parts = [self.texts(x) for x in np.split(ids, np.flatnonzero(control))]
        try:
            return "".join([x.decode() for x in parts])[spare:]
        except UnicodeDecodeError:
            codecs.register_error("pagemill-bytes", lambda e: ("\ufffd" * (e.end - e.start), e.end))
            return "".join([x.decode("utf-8", "pagemill-bytes") for x in parts])[spare:]

    def listed(self, ids) -> bytes:
        """Decimal ids, joined by one space."""
        return self.numbers(ids)[:-1]


def _model(path: str) -> PieceModel:
    if worker_holds(_STATE).get("path") != path:
        with open(path, "rb") as f:
            _STATE.update(path=path, model=PieceModel(f.read()))
    return _STATE["model"]


def _encode(path: str, end: bool, told: tuple):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        model = _model(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            names = [x for x in batch.schema.names if x != "text"]
            columns = [batch.column(x) for x in names]
            rows: dict = {x: [] for x in ("ids", "begin", "end", "ids_sha256", "spans_sha256", "decoded_sha256")}
            for text in batch.column("text"):
                text = text.as_py()
                ids, begin, stop = model.encode(text)
                if end:
                    size = len(text.encode()) if text else 0
                    ids, begin, stop = np.append(ids, np.int32(model.end)), np.append(begin, size), np.append(stop, size)
                rows["ids"].append(ids)
                rows["begin"].append(begin.astype(np.int32))
                rows["end"].append(stop.astype(np.int32))
                if "ids_sha256" in told:
                    rows["ids_sha256"].append(sha(model.listed(ids)))
                    rows["spans_sha256"].append(sha(np.stack((rows["begin"][-1], rows["end"][-1]), axis=1).tobytes()))
                    rows["decoded_sha256"].append(sha(model.decode(ids).encode()))
            n = np.array([len(x) for x in rows["ids"]], np.int64)
            cuts = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            made = {"n_tokens": pa.array(n)}
            for x in ("ids", "begin", "end"):
                if x in told:
                    made[x] = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(rows[x]) if len(n) else np.zeros(0, np.int32)))
            made |= {x: pa.array(rows[x], pa.string()) for x in told if x.endswith("_sha256")}
            yield pa.RecordBatch.from_arrays(columns + [made[x] for x in told], names=names + list(told))

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        model = _model(path)
        for batch in batches:
            names = [x for x in batch.schema.names if x != "ids"]
            texts = [model.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(texts, pa.string())],
                                             names=names + ["decoded"])

    return run


def _schema(df: DataFrame, without: str, more: str) -> str:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != without)
    return ", ".join(x for x in (kept, more) if x)


def encode(docs: DataFrame, model: str = MODEL, end: bool = False, checked: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids, begin and end (arrays, one entry a piece) in place of text.

    begin and end are byte positions in the UTF-8 source.  ``end`` appends the
    end id.  ``checked`` adds ids_sha256, spans_sha256 and decoded_sha256.
    """
    told = ("n_tokens", "ids", "begin", "end") + ("ids_sha256", "spans_sha256", "decoded_sha256") * checked
    docs = docs.drop(*told)
    kinds = {"n_tokens": "long", "ids": "array<int>", "begin": "array<int>", "end": "array<int>"}
    more = ", ".join(f"`{x}` {kinds.get(x, 'string')}" for x in told)
    return docs.mapInArrow(_encode(tokenizer_file(model), end, told), _schema(docs, "text", more))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the column decoded in place of ids (null: an empty text)."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode(tokenizer_file(model)), _schema(encoded, "ids", "decoded string"))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, spans_sha256, decoded_sha256 with the end id.

    spans_sha256 is over the pieces' begin and end as pairs of little-endian 32-bit integers.
    """
    told = ("n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_encode(tokenizer_file(model), True, told),
                           "doc_id long, n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string")


@query("op13_pieces")
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
