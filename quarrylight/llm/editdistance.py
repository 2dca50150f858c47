"""Exact bounded edit distances of many pairs at once.

Pairs whose characters differ in more places
than allowed, whatever their order, are refused; for the others waves of one more edit each go out
along the diagonals, for many pairs side by side, until one reaches both ends (``_waves``): the work
follows the square of the distance, not the length. Texts of more than
LONG characters are compared one pair at a time, after a screen of their common runs of characters.
Distances count characters, not bytes. Empty strings are allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textkernel import popcount, string_buffers

#: Cells of a block of waves.
_WAVE = 1 << 18
#: Words of 8 bytes that are compared at once where the first is alike.
_AHEAD = 16
LONG = 8000
#: Characters of a block that are compared at once.
_GRID = 1 << 20


@dataclass
class Texts:
    """Characters of many texts in one array."""

    codes: np.ndarray  # uint32
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(arr: pa.Array) -> Texts:
        buf, bounds = string_buffers(arr)
        if len(buf) and buf.max() >= 0x80:
            at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[bounds]
            codes = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        else:
            at, codes = bounds, buf.astype(np.uint32)
        return Texts(codes, at[:-1], np.diff(at))

    def take(self, i: np.ndarray) -> Texts:
        return Texts(self.codes, self.start[i], self.size[i])

    def one(self, i: int) -> np.ndarray:
        return self.codes[self.start[i] : self.start[i] + self.size[i]]

    def grid(self, fill: int, back: bool = False) -> np.ndarray:
        """(longest, texts) characters by place, as numbers from 2; ``back`` puts them last to
        first, so that all end at the bottom."""
        n = int(self.size.max(initial=0))
        at = np.arange(n)[:, None]
        if back:
            at = n - 1 - at
        inside = at < self.size
        if not len(self.codes):
            return np.full(inside.shape, fill, np.uint32)
        return np.where(inside, self.codes[np.where(inside, self.start + at, 0)] + np.uint32(2), np.uint32(fill))


def _grams(c: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``q`` characters and how often each occurs."""
    h = np.zeros(len(c) - q + 1, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - q + 1 + i]
    return np.unique(h, return_counts=True)


def _long_within(a: Texts, b: Texts, most: int) -> bool:
    """For one pair of long texts: pairs with too few common runs of characters are refused (an
    edit breaks at most q runs of q), the others are compared by waves."""
    x, y = a.one(0).astype(np.uint64), b.one(0).astype(np.uint64)
    for q in (6, 8, 10):
        need = max(len(x), len(y)) - q + 1 - q * most
        if need > 0:
            if min(len(x), len(y)) < q:
                return False
            (u, m), (v, n) = _grams(x, q), _grams(y, q)
            _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            if np.minimum(m[i], n[j]).sum() < need:
                return False
    return bool(_waves(a, b, np.array([most]))[0])


def _alike(a: Texts, b: Texts, back: bool) -> np.ndarray:
    """How many characters each pair has in common at its beginning, or at its end."""
    at_end = lambda t: Texts(t.codes[::-1], len(t.codes) - t.start - t.size, t.size) if back else t
    x, y = at_end(a).grid(0), at_end(b).grid(1)
    n = min(len(x), len(y))
    differ = np.concatenate([x[:n] != y[:n], np.ones((1, x.shape[1]), bool)])
    return differ.argmax(axis=0)


def _trim(a: Texts, b: Texts) -> tuple[Texts, Texts]:
    head = _alike(a, b, False)
    a, b = (Texts(t.codes, t.start + head, t.size - head) for t in (a, b))
    tail = _alike(a, b, True)
    return Texts(a.codes, a.start, a.size - tail), Texts(b.codes, b.start, b.size - tail)


def _bags(t: Texts) -> np.ndarray:
    """(texts, 64) characters by their number modulo 64."""
    n = len(t.size)
    total = int(t.size.sum())
    at = np.arange(total) + np.repeat(t.start - (np.cumsum(t.size) - t.size), t.size)
    row = np.repeat(np.arange(n), t.size)
    return np.bincount(row * 64 + (t.codes[at] & 63).astype(np.int64), minlength=64 * n).reshape(n, 64)


def _words_at(t: Texts, numbers: np.ndarray, mark: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(8 bytes from every character on, start of each text among them); behind every text there is
    one ``mark``."""
    n, total = len(t.size), int(t.size.sum())
    flat = np.full(total + n + 8 * (_AHEAD + 1), mark, kind)
    at = np.cumsum(t.size + 1) - t.size - 1
    place = np.repeat(at - (np.cumsum(t.size) - t.size), t.size) + np.arange(total)
    flat[place] = numbers
    w = flat.astype(np.uint64)
    for k in range(int(math.log2(8 // flat.itemsize))):
        w[: -(1 << k)] |= w[1 << k :] << np.uint64(8 * flat.itemsize << k)
    return w, at


def _flat(t: Texts) -> np.ndarray:
    return t.codes[np.arange(int(t.size.sum())) + np.repeat(t.start - (np.cumsum(t.size) - t.size), t.size)]


def _numbered(a: Texts, b: Texts) -> tuple[np.ndarray, np.ndarray, type]:
    """The characters as numbers from 2, of one byte if there are few enough kinds."""
    x, y = _flat(a), _flat(b)
    top = int(max(x.max(initial=0), y.max(initial=0)))
    if top < 254:
        return x + 2, y + 2, np.uint8
    there = np.zeros(top + 1, bool)
    there[x] = there[y] = True
    if there.sum() < 254:
        number = np.cumsum(there) + 1
        return number[x], number[y], np.uint8
    return x + np.uint32(2), y + np.uint32(2), np.uint32


def _waves(a: Texts, b: Texts, most: np.ndarray) -> np.ndarray:
    """Whether each distance is at most ``most``; lengths differ by no more than that. ``far`` has, for
    each pair and diagonal, how much of the left text the edits so far can match at most."""
    n, k = len(most), int(most.max())
    x, y, kind = _numbered(a, b)
    (wa, at), (wb, bt) = _words_at(a, x, 0, kind), _words_at(b, y, 1, kind)
    per, bits = 8 // np.dtype(kind).itemsize, 8 * np.dtype(kind).itemsize
    ahead = np.arange(_AHEAD) * per
    ok, who = np.zeros(n, bool), np.arange(n)
    end, other, most = (v.astype(np.int32) for v in (a.size, b.size, most))
    shift = other - end
    slack = int(np.abs(shift).max())
    none = -(1 << 30)
    far = np.full((n, 2 * k + 3), none, np.int32)
    for e in range(k + 1):
        w = min(e, k - e + slack)
        lo, hi = k + 1 - w, k + 2 + w
        d = np.arange(-w, w + 1, dtype=np.int32)
        if e:
            new = np.maximum(far[:, lo:hi], far[:, lo + 1 : hi + 1])
            new += 1
            np.maximum(new, far[:, lo - 1 : hi - 1], out=new)
            np.minimum(new, np.minimum(end[:, None], other[:, None] - d), out=new)
        else:
            new = np.zeros((len(who), 2 * w + 1), np.int32)
        # a diagonal from which the last one can no longer be reached is left out
        new[(new < np.maximum(0, -d)) | (np.abs(shift[:, None] - d) > (most - e)[:, None])] = none
        row, col = np.nonzero(new >= 0)
        i = new[row, col].astype(np.int64)
        p, q = at[row] + i, bt[row] + i + d[col]
        differ = wa[p] ^ wb[q]
        i = i + popcount((differ & (~differ + np.uint64(1))) - np.uint64(1)) // bits
        go = np.flatnonzero(differ == 0)
        while len(go):  # these go on for many characters
            p, q = at[row[go]] + i[go], bt[row[go]] + i[go] + d[col[go]]
            differ = wa[p[:, None] + ahead] ^ wb[q[:, None] + ahead]
            first = (differ != 0).argmax(axis=1)
            differ = differ[np.arange(len(go)), first]
            on = differ == 0
            i[go] += np.where(on, len(ahead) * per, first * per + popcount((differ & (~differ + np.uint64(1))) - np.uint64(1)) // bits)
            go = go[on]
        new[row, col] = i
        far[:, lo:hi] = new
        there = far[np.arange(len(who)), shift + k + 1] >= end
        ok[who[there]] = True
        stay = ~there & (most > e)
        if not stay.all():
            who, far, at, bt, end, other, shift, most = (v[stay] for v in (who, far, at, bt, end, other, shift, most))
            if not len(who):
                break
    return ok


def within_texts(a: Texts, b: Texts, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``; texts of any length."""
    n = len(most)
    ok = np.zeros(n, bool)
    todo = np.flatnonzero((most >= 0) & (np.abs(a.size - b.size) <= most))
    todo = todo[np.argsort(np.maximum(a.size, b.size)[todo], kind="stable")]
    longer = np.maximum(a.size, b.size)[todo]
    left: list[tuple[np.ndarray, Texts, Texts]] = []
    i = 0
    while i < len(todo):
        j = i + 1
        while j < len(todo) and (j - i + 1) * longer[min(len(todo) - 1, max(j, i))] <= _GRID and longer[j] <= 2 * longer[i] + 32:
            j = min(len(todo), j + max(1, (j - i) // 2))
        while j > i + 1 and (j - i) * longer[j - 1] > _GRID:
            j -= max(1, (j - i) // 4)
        part = todo[i:j]
        x, y, room = a.take(part), b.take(part), most[part]
        plain = np.minimum(x.size, y.size) == 0
        ok[part[plain]] = longer[i:j][plain] <= room[plain]
        open_ = np.flatnonzero(~plain)
        if len(open_):
            gap = _bags(x.take(open_)) - _bags(y.take(open_))
            far = np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1))
            left.append(part[open_[far <= room[open_]]])
        i = j
    if not left:
        return ok
    rows = np.concatenate(left)
    longer = np.maximum(a.size, b.size)[rows]
    for p in rows[longer > LONG]:
        x, y = _trim(a.take([p]), b.take([p]))
        ok[p] = max(x.size[0], y.size[0]) <= most[p] or (min(x.size[0], y.size[0]) > 0 and _long_within(x, y, int(min(most[p], max(x.size[0], y.size[0])))))
    rows, longer = rows[longer <= LONG], longer[longer <= LONG]
    room = np.minimum(most[rows], longer)
    order = np.lexsort((longer, room))
    rows, room = rows[order], room[order]
    i = 0
    while i < len(rows):
        # as many pairs as their waves have room for
        j = int(np.searchsorted(room, 2 * room[i] + 8, side="right"))
        j = min(j, i + max(1, _WAVE // (2 * int(room[j - 1]) + 3)))
        part = rows[i:j]
        ok[part] = _waves(a.take(part), b.take(part), room[i:j])
        i = j
    return ok


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """The same for lists."""
    x, y = (pa.array(t, pa.large_string()) for t in (a, b))
    return within_texts(Texts.of(x), Texts.of(y), np.asarray(most, np.int64))
