"""Vectorised text kernels over Arrow string buffers (UTF-8 bytes, no Python strings)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_LANES = np.uint64(0x0101010101010101)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
_pow = _inv = np.ones(1, dtype=np.uint64)
#: Bytes of text at once where a pass makes many arrays of eight bytes for each of them.
CHUNK = 1 << 18
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow; at its end what it has freed goes back to the system. Workers are used
    again, and several wait in an executor: else each keeps the most that it ever had."""

    def lean_run(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return lean_run


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        a = np.full(size, _MULT, dtype=np.uint64)
        a[0] = 1
        b = np.full(size, _INV, dtype=np.uint64)
        b[0] = 1
        _pow, _inv = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold_table() -> np.ndarray:
    """Byte classes for normalised words: ASCII letters in lower case, digits and all
    non-ASCII bytes stay, everything else is a separator (32)."""
    t = np.full(256, 32, dtype=np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            t[c] = ord(chr(c).lower())
    t[128:] = np.arange(128, 256)
    return t


FOLD = fold_table()


def fold(buf: np.ndarray) -> np.ndarray:
    """Normalised bytes of the same length; the upper-case letters of the Latin-1
    supplement (UTF-8 C3 80..9E) are folded as well."""
    b = FOLD[buf]
    if len(buf) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        b[1:][up] += 0x20
    return b


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array without nulls; bounds has len + 1 entries."""
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        arr, kind = arr.cast(pa.string()), np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    bounds = np.frombuffer(offs, dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch holding about ``max_bytes`` of text (one row at least), each with
    its text buffer and row bounds; null texts count as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    buf, bounds = string_buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield batch.slice(i, j - i), buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True; a run is also broken at every position of ``cuts``."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums of a polynomial."""
    p, inv = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=c[1:])
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(h: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each run h[bounds[i]:bounds[i+1]] as an ordered sequence."""
    p, inv = _powers(len(h) + 1)
    c = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ _SEEDS[seed]) * p[: len(h)], out=c[1:])
    lo, hi = bounds[:-1], bounds[1:]
    return mix((c[hi] - c[lo]) * inv[lo] + (hi - lo).astype(np.uint64))


def bigrams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of word pairs within each group; a group of one word has that word."""
    n = np.diff(bounds)
    if len(h) == 0:
        return h, bounds
    pair = h.copy()
    pair[:-1] = h[:-1] * np.uint64(_MULT) + (h[1:] ^ (h[1:] >> np.uint64(29)))
    alone = bounds[:-1][n == 1]
    pair[alone] = h[alone]
    keep = np.ones(len(h), dtype=bool)
    keep[bounds[1:][n > 1] - 1] = False
    out = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(np.where(n > 1, n - 1, n), out=out[1:])
    return pair[keep], out


def simhash(feat: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """(groups, words) uint64 sign bits of the summed feature hashes. Groups must not be
    empty. Votes are counted in eight byte lanes at once over blocks of 255 features."""
    n = np.diff(bounds)
    g = len(n)
    out = np.zeros((g, words), dtype=np.uint64)
    if g == 0:
        return out
    nb = (n + 254) // 255
    first = np.zeros(g + 1, dtype=np.int64)
    np.cumsum(nb, out=first[1:])
    within = np.arange(first[-1]) - np.repeat(first[:-1], nb)
    starts = np.repeat(bounds[:-1], nb) + 255 * within
    split = bool((nb > 1).any())
    half = (n // 2)[:, None] if split else (n // 2).astype(np.uint8)[:, None]
    for k in range(words):
        x = mix(feat ^ _SEEDS[k])
        for j in range(8):
            lane = np.add.reduceat((x >> np.uint64(j)) & _LANES, starts)
            votes = lane.view(np.uint8).reshape(-1, 8)
            if split:
                votes = np.add.reduceat(votes.astype(np.int64), first[:-1], axis=0)
            packed = np.packbits(votes > half, axis=1, bitorder="little").reshape(-1)
            # byte lane l, bit j of the hash -> bit j * 8 + l of the signature
            out[:, k] |= packed.astype(np.uint64) << np.uint64(8 * j)
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)
