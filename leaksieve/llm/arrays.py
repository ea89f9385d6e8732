"""Texts of an Arrow batch as byte arrays: words, fingerprints, pieces.

Fingerprints are polynomials over bytes modulo 2**64 with a random value per byte, mixed at the end: any
piece's fingerprint follows from prefix sums, so a whole chunk of texts is hashed without a loop.
They are the same on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # any odd number
_POWERS: dict[str, np.ndarray] = {}
_HELD: dict[tuple, object] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
NOT_BLANK = ~BLANK
# letters and digits after lower-casing, and every byte of a character beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def _powers(kind: str, n: int) -> np.ndarray:
    known = _POWERS.get(kind)
    if known is None or len(known) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 16, 0 if known is None else 2 * len(known))
        grown = np.full(size, base, dtype=U64)
        grown[0] = 1
        known = _POWERS[kind] = np.multiply.accumulate(grown)
    return known[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, dtype=U64)
    sums[0] = 0
    terms = VALUE.take(data)
    terms *= _powers("up", len(data))
    np.cumsum(terms, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the pieces ``[begin, end)``."""
    out = sums.take(end)
    out -= sums.take(begin)
    out *= _powers("down", len(sums)).take(begin)
    out += (end - begin).astype(U64)
    return mix(out)


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` neighbours."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=U64)
    for k in range(width if n > 0 else 0):
        out = mix(out + hashes[k : k + n] * U64(2 * k + 0x100000001B3))
    return out


def stable_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys of so many bits: one sort of numbers that end in their places, if there is room."""
    places = len(keys).bit_length()
    if bits + places > 64:
        return np.argsort(keys, kind="stable")
    packed = (keys << U64(places)) | np.arange(len(keys), dtype=U64)
    packed.sort()
    packed &= U64((1 << places) - 1)
    return packed.view(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    if column.null_count:  # a null row may cover bytes
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(at), 0)
        if sizes.sum() != at[-1] - at[0]:
            parts = [raw[a:b] for a, b, k in zip(at[:-1], at[1:], keep) if k]
            raw = np.concatenate(parts) if parts else raw[:0]
            return raw, np.concatenate([[0], np.cumsum(sizes)])
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs of ``inside`` bytes, which never cross rows, and the first word of each row."""
    mask = np.zeros(len(data) + 2, dtype=bool)
    # the table as bytes: several times as fast as by index
    mask[1:-1] = np.frombuffer(data.tobytes().translate(inside.tobytes()), dtype=bool)
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    begin, end = edges[::2], edges[1::2]
    cuts = np.unique(offsets)
    cuts = cuts[mask[cuts] & mask[cuts + 1]]  # a row ends inside a run
    if len(cuts):
        at = np.searchsorted(begin, cuts)
        begin, end = np.insert(begin, at, cuts), np.insert(end, at - 1, cuts)
    return begin, end, np.searchsorted(begin, offsets)


def held(key: tuple, build: Callable):
    """What a worker process builds once and keeps for its next tasks: the latest alone, so that no operator pays for the
    model of another that ran before it."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = build()
    return _HELD[key]


def forget() -> None:
    """Let go of what ``held`` keeps."""
    _HELD.clear()


def give_back() -> None:
    """Return freed memory to the machine. Workers serve one task after another, and what they keep adds up."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable, model: bool = False) -> Callable:
    """A function over batches that gives its memory back at the end of a task. Unless it works with a ``held`` model, that of
    an operator before it goes first."""

    def tidied(batches):
        if not model:
            forget()
        yield from run(batches)
        give_back()

    return tidied
