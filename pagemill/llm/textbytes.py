"""Words of whole texts as 64-bit hashes, computed over an Arrow column's bytes."""

from __future__ import annotations

CHUNK_BYTES = 2_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {}


def lower_ascii():
    import numpy as np

    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def table_without(separators) -> "object":
    """uint8 map: A-Z to a-z, the given bytes to 0 (no word holds byte 0 then)."""
    table = lower_ascii()
    table[list(separators)] = 0
    return table


def mix(h):
    """Finalizer of splitmix64, on uint64 arrays."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    import numpy as np

    if len(_STATE.get("pow", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        inverse = pow(_MULTIPLIER, -1, 2 ** 64)
        for name, base in (("pow", _MULTIPLIER), ("inv", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _STATE[name] = np.cumprod(p)
        _STATE["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _STATE["pow"], _STATE["inv"], _STATE["byte"]


def chunks(column, size: int = CHUNK_BYTES):
    """(first row, offsets, bytes) of stretches of an Arrow string or binary column of about ``size`` bytes.

    Null values have no bytes.  A longer value is a stretch of its own.
    """
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]]
        first = last


def words(offsets, data, table):
    """(row, hash, start, end) of each word of a stretch, in order; rows count from the stretch's first."""
    import numpy as np

    mapped = table[data]
    inside = mapped != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev, after = np.zeros_like(inside), np.zeros_like(inside)
    prev[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~prev | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse, byte = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[mapped] * power[:len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, h, starts, ends


def byte_sums(data):
    """Prefix sums whose differences, with ``span_hash``, hash any span of the bytes."""
    import numpy as np

    power, _, byte = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * power[:len(data)], out=sums[1:])
    return sums


def span_hash(sums, start, end):
    """Hash of the bytes from ``start`` to ``end`` (arrays, or slices' bounds)."""
    inverse = _powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start])


def grams(row, h, k: int):
    """(row, hash, first word) of each run of k words of one row."""
    import numpy as np

    n = len(h) - k + 1
    if n <= 0:
        return row[:0], h[:0], np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1:])
    total = np.full(len(at), k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + h[at + j]
    return row[at], mix(total), at
