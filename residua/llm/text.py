"""Vectorised word helpers shared by the operators of this subpackage.

All functions work on Arrow string arrays inside Spark tasks.  A word is a
maximal run of bytes outside ``0x20, 0x09-0x0D``, which is what
``bytes.split()`` returns.  Word hashes are 64-bit and depend on the word's
bytes alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20            # bytes hashed at once; bounds the scratch arrays
SLICE = 8 << 20            # bytes of text per slice of documents

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift-multiply), in place on a copy."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = stream(11, 256) | U64(1)
_BASE = U64(0xD6E8FEB86659FD93)                 # odd, so it has an inverse
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(PIECE + 1, U64)
_INV = np.ones(PIECE + 1, U64)
_POW[1:] = _BASE
_INV[1:] = _BASE_INV
np.multiply.accumulate(_POW, out=_POW)
np.multiply.accumulate(_INV, out=_INV)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.fill_null("").cast(pa.large_string())
    if len(a) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE,
           gather: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, one row at least.

    ``gather`` also joins small batches, so that slices are near the limit
    whatever the batch size of the session is.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        off = buffers(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + max(limit - size, 0), "right")) - 1
            if to <= at and held:
                yield _joined(held)
                held, size = [], 0
                continue
            to = min(max(to, at + 1), batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(off[to] - off[at])
            at = to
            if size >= limit or not gather:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``PIECE`` bytes (or one longer word) that cut no word."""
    n, at = len(data), 0
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            k = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if k <= at:
                back = np.flatnonzero(SPACE[data[at:to]])
                if len(back):
                    k = at + int(back[-1]) + 1
                else:
                    ahead = to
                    nxt = int(offsets[np.searchsorted(offsets, to, "right")])
                    while ahead < nxt and not SPACE[data[ahead]]:
                        ahead += 1
                    k = ahead
            to = k
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False):
    """Start, end (byte positions), document index and hash of every word.

    ``fold`` lower-cases A-Z first.
    """
    parts = []
    table = _BYTE[LOWER] if fold else _BYTE
    for a, b in pieces(data, offsets):
        chunk = data[a:b]
        solid = ~SPACE[chunk]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[np.searchsorted(offsets, a, "left"):np.searchsorted(offsets, b, "left")] - a
        cuts = cuts[cuts < b - a]
        first[cuts] = solid[cuts]
        inner = cuts[cuts > 0] - 1
        last[inner] = solid[inner]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if b - a <= PIECE:
            power, inverse = _POW, _INV
        else:                                    # one word longer than a piece
            power = np.full(b - a + 1, _BASE, U64)
            inverse = np.full(b - a + 1, _BASE_INV, U64)
            power[0] = inverse[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(inverse, out=inverse)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(table[chunk] * power[:b - a], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        parts.append((s + a, e + a, mix(h + (e - s).astype(U64) * U64(0xA24BAED4963EE407))))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U64)
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = np.searchsorted(offsets[1:], s, "right")
    return s, e, doc, h


def counts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)


def windows(h: np.ndarray, doc: np.ndarray, k: int, seed: int = 5):
    """Hash of the ``k`` words from each position, and whether they lie in one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, bool)
    factors = stream(seed + k, k) | U64(1)
    out = h[:n] * factors[0]
    for j in range(1, k):
        out += mix(h[j:j + n] + U64(j)) * factors[j] if j % 2 else h[j:j + n] * factors[j]
    return mix(out), doc[:n] == doc[k - 1:k - 1 + n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        rest = w - span
        out = np.minimum(out[:len(out) - rest], out[rest:])
    return out
