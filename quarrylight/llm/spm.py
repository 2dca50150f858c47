"""SentencePiece encoding and decoding (operator 6) by suffix-array matching.

A batch's texts are split where no piece of the vocabulary can reach across: before a run of
spaces and around characters without a piece. The distinct stretches are concatenated and
indexed by a suffix array; every piece is looked up in it by binary search, which gives all
its occurrences; these edges are sorted by the position at which they end and relaxed in
that order. For a BPE vocabulary the relaxation keeps, at every position, the one edge
that is consistent with the best edge of the prefix: two neighbouring pieces are consistent
when no merge across their border comes before the merges inside them. The result equals
merging pair by pair by score, leftmost first.

Decoding joins the bytes of the pieces and drops the space put before every text.

Defined cases: a null text has null ids and 0 tokens, an empty one no ids; characters
without a piece become byte pieces; the character U+2581 in a text is an ordinary
character here (byte pieces), so that decoding always gives the text back; repeated
rows are encoded each; an empty table gives an empty result. Tokens of a long text are
never cut.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import chunks, lean, span_hashes, string_buffers

MODEL = os.environ.get("QUARRYLIGHT_SP_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
_SPACE = "\u2581"
_CACHE_WORDS = 400_000


@dataclass
class Vocabulary:
    """Pieces as bytes (the space mark is a plain space) with the order of their merges."""

    pieces: list[bytes]  # by id; empty for ids that stand for no text
    normal: np.ndarray  # ids that merging can produce
    rank: np.ndarray  # by id: place in the order of merges, -1 for single characters
    tied: np.ndarray  # by id: shares its score with another piece
    left: np.ndarray  # by id: the pair that its own last merge joins
    right: np.ndarray
    pair_key: np.ndarray  # sorted left * size + right of all pairs that can merge
    pair_rank: np.ndarray
    byte_id: np.ndarray  # by byte
    chars: np.ndarray  # sorted code points that have a piece

    @property
    def size(self) -> int:
        return len(self.pieces)


def load(model: str = MODEL) -> Vocabulary:
    """Read a BPE model with byte fallback. The file is only read, never trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces, byte_id, score = [b""] * n, np.full(256, sp.unk_id(), np.int32), np.zeros(n)
    normal, by_text = [], {}
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            pieces[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if _SPACE in p.lstrip(_SPACE):
                raise ValueError("a piece has a space after its first letter; texts cannot be split at spaces")
            pieces[i] = p.replace(_SPACE, " ").encode()
            score[i] = sp.get_score(i)
            normal.append(i)
            by_text[p.replace(_SPACE, " ")] = i
    order = sorted((i for i in normal if len(pieces[i].decode()) > 1), key=lambda i: (-score[i], i))
    rank = np.full(n, -1, np.int32)
    scores = [score[i] for i in order]
    for r, i in enumerate(order):  # equal scores have equal rank
        rank[i] = rank[order[r - 1]] if r and scores[r - 1] == scores[r] else r
    seen, count = np.unique(score[order], return_counts=True)
    tied = np.isin(score, seen[count > 1]) & (rank >= 0)
    pairs: dict[tuple[int, int], int] = {}
    for text, i in by_text.items():
        for k in range(1, len(text)):
            a, b = by_text.get(text[:k]), by_text.get(text[k:])
            if a is not None and b is not None:
                pairs[a, b] = i
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    usable = []
    for text, i in by_text.items():
        if len(text) == 1:
            usable.append(i)
            continue
        parts = [by_text.get(c, -1) for c in text]
        while len(parts) > 1:
            best = min(((rank[pairs[p]], k) for k in range(len(parts) - 1) if (p := (parts[k], parts[k + 1])) in pairs), default=None)
            if best is None:
                break
            k = best[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [pairs[last]]
        if parts == [i]:
            left[i], right[i] = last
            usable.append(i)
    keys = np.array([a * n + b for a, b in pairs], np.int64)
    ranks = np.array([rank[i] for i in pairs.values()], np.int32)
    o = np.argsort(keys)
    chars = np.array(sorted(ord(t) for t in by_text if len(t) == 1), np.int64)
    return Vocabulary(pieces, np.array(sorted(usable), np.int32), rank, tied, left, right, keys[o], ranks[o], byte_id, chars)


class Encoder:
    """Encodes buffers of texts; keeps the stretches seen so far within one task."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        size = max(len(v.pieces[i]) for i in v.normal)
        self.plen = np.array([len(p) for p in v.pieces], np.int64)
        words = -(-max(size, 16) // 8)
        low, high = np.zeros((len(v.normal), words * 8), np.uint8), np.full((len(v.normal), words * 8), 255, np.uint8)
        for k, i in enumerate(v.normal):
            p = np.frombuffer(v.pieces[i], np.uint8)
            low[k, : len(p)] = high[k, : len(p)] = p
        self.low, self.high = (x.view(">u8").astype(np.uint64) for x in (low, high))
        self.known = np.zeros(128, bool)
        self.known[[c for c in v.chars if c < 128]] = True
        self.memo_key = np.full(1 << 21, -1, np.int64)
        self.memo = np.zeros(1 << 21, bool)
        self._reset()

    def _reset(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    # -- which pieces may stand side by side --

    def _consistent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between pieces a and b, computed by undoing
        their merges from the last to the first."""
        v, rank, n = self.v, self.v.rank, self.v.size
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int32).max, np.int64)
        while len(live):
            key = a * n + b
            i = np.minimum(np.searchsorted(v.pair_key, key), len(v.pair_key) - 1)
            crosses = (v.pair_key[i] == key) & (v.pair_rank[i] < limit)
            ok[live[crosses]] = False
            go = ~crosses & ((rank[a] >= 0) | (rank[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            undo_a = rank[a] > rank[b]
            # of equal merges the left one comes first: it wins against a's own, not against b's
            limit = np.where(undo_a, rank[a], rank[b].astype(np.int64) + 1)
            a, b = np.where(undo_a, v.right[a], a).astype(np.int64), np.where(undo_a, b, v.left[b]).astype(np.int64)
        return ok

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.v.size + b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        miss = self.memo_key[slot] != key
        if miss.any():
            new = np.unique(key[miss])
            got = self._consistent(new // self.v.size, new % self.v.size)
            out = np.empty(len(key), bool)
            out[~miss] = self.memo[slot[~miss]]
            out[miss] = got[np.searchsorted(new, key[miss])]
            at = ((new.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
            self.memo_key[at] = new
            # of several new keys in one slot the one that was stored keeps its own value
            mine = self.memo_key[at] == new
            self.memo[at[mine]] = got[mine]
            return out
        return self.memo[slot]

    # -- stretches --

    def _stretches(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the stretches of the buffer and whether each is a character without a piece."""
        n = len(buf)
        lead = (buf & 0xC0) != 0x80
        pos = np.flatnonzero(lead)
        c = buf[pos]
        unknown = np.zeros(len(pos), bool)
        one = c < 128
        unknown[one] = ~self.known[c[one]]
        many = np.flatnonzero(~one)
        if len(many):
            p, c = pos[many], c[many].astype(np.int64)
            pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64) & 0x3F
            two, three = c < 0xE0, (c >= 0xE0) & (c < 0xF0)
            code = np.where(
                two,
                ((c & 0x1F) << 6) | pad[p + 1],
                np.where(three, ((c & 0x0F) << 12) | (pad[p + 1] << 6) | pad[p + 2], ((c & 0x07) << 18) | (pad[p + 1] << 12) | (pad[p + 2] << 6) | pad[p + 3]),
            )
            i = np.minimum(np.searchsorted(self.v.chars, code), len(self.v.chars) - 1)
            unknown[many] = (self.v.chars[i] != code) | (code == 0x2581)
        space = buf[pos] == 32
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        new = first[pos] | unknown
        new[1:] |= unknown[:-1] | (space[1:] & ~space[:-1])
        return pos[new], unknown[new]

    def _new(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode known-character stretches, given as spans of ``text``: (token counts, tokens)."""
        n = len(starts)
        off = np.zeros(n + 1, np.int64)
        np.cumsum(sizes + 1, out=off[1:])
        total = int(off[-1])
        flat = np.full(total + 8 * self.low.shape[1] + 8, 255, np.uint8)
        idx = np.arange(int(sizes.sum()))
        within = idx - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[np.repeat(off[:-1], sizes) + within] = text[np.repeat(starts, sizes) + within]
        # suffixes ordered by their first 16 bytes
        k = np.zeros(total + 8, np.uint64)
        for j in range(8):
            k |= flat[j : j + total + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
        k1, k2 = k[:total], k[8 : total + 8]
        sa = np.lexsort((k2, k1))
        s1, s2 = k1[sa], k2[sa]
        ids = self.v.normal
        plen = self.plen[ids]
        lo = np.searchsorted(s1, self.low[:, 0], "left")
        hi = np.searchsorted(s1, self.high[:, 0], "right")
        deep = np.flatnonzero((plen > 8) & (hi > lo))
        if len(deep):
            lo[deep], hi[deep] = _bisect(s2, self.low[deep, 1], lo[deep], hi[deep], False), _bisect(s2, self.high[deep, 1], lo[deep], hi[deep], True)
        lens = hi - lo
        some = np.flatnonzero(lens > 0)
        ids, lo, lens = ids[some], lo[some], lens[some]
        at = np.arange(int(lens.sum())) + np.repeat(lo - (np.cumsum(lens) - lens), lens)
        pos, pid = sa[at], np.repeat(ids, lens)
        longer = self.plen[pid] > 16
        if longer.any():
            good = np.ones(len(pos), bool)
            for i in np.flatnonzero(longer):
                good[i] = flat[pos[i] : pos[i] + self.plen[pid[i]]].tobytes() == self.v.pieces[pid[i]]
            pos, pid = pos[good], pid[good]
        # edges sorted by the place in their stretch at which they end
        seg = np.searchsorted(off, pos, side="right") - 1
        end = pos + self.plen[pid]
        rel = end - off[seg]
        top = int(rel.max(initial=0))
        order = np.argsort(rel.astype(np.uint16) if top < 65536 else rel, kind="stable")
        pos, pid, end, rel, seg = pos[order], pid[order], end[order], rel[order], seg[order]
        opens = pos == off[seg]
        last = np.full(total + 1, -1, np.int32)
        step = np.flatnonzero(np.diff(rel, prepend=-1))
        for i, j in zip(step, np.append(step[1:], len(rel)), strict=True):
            p, q = last[pos[i:j]], pid[i:j]
            good = opens[i:j].copy()
            inner = np.flatnonzero(~good & (p >= 0))
            if len(inner):
                good[inner] = self._allowed(p[inner], q[inner])
            last[end[i:j][good]] = q[good]
        slow = np.zeros(n, bool)
        if self.v.tied.any():  # merges of equal score are ordered by place, not by piece
            slow[seg[self.v.tied[pid]]] = True
        # walk back from the ends
        cur = off[1:] - 1
        live = np.flatnonzero(~slow & (sizes > 0))
        who, toks = [], []
        while len(live):
            t = last[cur[live]]
            lost = t < 0
            if lost.any():
                slow[live[lost]] = True
                live, t = live[~lost], t[~lost]
            who.append(live)
            toks.append(t)
            cur[live] -= self.plen[t]
            live = live[cur[live] > off[live]]
        who = np.concatenate(who) if who else np.zeros(0, np.int64)
        toks = np.concatenate(toks) if toks else np.zeros(0, np.int32)
        if slow.any():
            keep = ~slow[who]
            who, toks = who[keep], toks[keep]
            for i in np.flatnonzero(slow):
                ids = self.merge(text[starts[i] : starts[i] + sizes[i]].tobytes().decode())[::-1]
                who = np.concatenate([who, np.full(len(ids), i)])
                toks = np.concatenate([toks, np.array(ids, np.int32)])
        # within a stretch the tokens were found from the last to the first
        order = np.argsort(who, kind="stable")
        count = np.bincount(who, minlength=n)
        ends = np.cumsum(count)
        rank = np.arange(len(who)) - np.repeat(ends - count, count)
        out = np.empty(len(who), np.int32)
        out[np.repeat(ends - 1, count) - rank] = toks[order]
        return count, out

    def merge(self, text: str) -> list[int]:
        """One stretch by an agenda of merges, as the definition says."""
        v = self.v
        if not hasattr(self, "_by_text"):
            self._by_text = {v.pieces[i].decode(): int(i) for i in range(v.size) if v.rank[i] >= 0}
            self._by_text |= {chr(c): None for c in v.chars}
            for i in v.normal:
                self._by_text[v.pieces[i].decode()] = int(i)
        ids = self._by_text
        parts: list[str | None] = list(text)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        agenda: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(parts) and (w := parts[i] + parts[j]) in ids:
                heapq.heappush(agenda, (int(v.rank[ids[w]]), i, w))

        for i in range(len(parts) - 1):
            offer(i)
        while agenda:
            _, i, w = heapq.heappop(agenda)
            j = nxt[i] if i < len(parts) and parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != w:
                continue
            parts[i], parts[j], nxt[i] = w, None, nxt[j]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
                offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [ids[p] for p in parts if p is not None]

    # -- texts --

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of the texts in them)."""
        n = np.diff(bounds)
        full = np.flatnonzero(n > 0)
        # a space before every text that is not empty
        b2 = np.zeros(len(bounds), np.int64)
        np.cumsum(n + (n > 0), out=b2[1:])
        text = np.full(int(b2[-1]), 32, np.uint8)
        keep = np.ones(len(text), bool)
        keep[b2[:-1][full]] = False
        text[keep] = buf
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        starts, unknown = self._stretches(text, b2)
        sizes = np.diff(np.append(starts, len(text)))
        h = span_hashes(text, starts, starts + sizes)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(uniq) > _CACHE_WORDS:
            self._reset()
        i = np.minimum(np.searchsorted(self.hash, uniq), max(len(self.hash) - 1, 0))
        have = (self.hash[i] == uniq) if len(self.hash) else np.zeros(len(uniq), bool)
        new = first[~have]
        plain, odd = new[~unknown[new]], new[unknown[new]]
        count, toks = self._new(text, starts[plain], sizes[plain])
        odd_idx = np.arange(int(sizes[odd].sum())) + np.repeat(starts[odd] - (np.cumsum(sizes[odd]) - sizes[odd]), sizes[odd])
        toks = np.concatenate([toks, self.v.byte_id[text[odd_idx]]])
        count = np.concatenate([count, sizes[odd]])
        at = len(self.tokens) + np.cumsum(count) - count
        hashes = np.concatenate([self.hash, h[plain], h[odd]])
        order = np.argsort(hashes)
        self.hash = hashes[order]
        self.at = np.concatenate([self.at, at])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.tokens = np.concatenate([self.tokens, toks])
        u = np.searchsorted(self.hash, uniq)
        word_at, word_n = self.at[u][inverse], self.count[u][inverse]
        ends = np.cumsum(word_n)
        ids = self.tokens[np.arange(int(ends[-1])) + np.repeat(word_at - (ends - word_n), word_n)]
        w = np.searchsorted(starts, b2)
        return ids, np.concatenate([[0], ends])[w]


def _bisect(s: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each want[i] in the sorted s[lo[i]:hi[i]]."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        m = np.minimum(mid, len(s) - 1)
        go = open_ & ((s[m] <= want) if after else (s[m] < want))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


class Decoder:
    def __init__(self, v: Vocabulary) -> None:
        self.size = np.array([len(p) for p in v.pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(v.pieces), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds) of the texts; the space before each of them is dropped."""
        n = self.size[ids]
        ends = np.cumsum(n)
        out = self.bytes[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - n), n)]
        tb = np.concatenate([[0], ends])[bounds]
        some = np.flatnonzero(np.diff(tb) > 0)
        keep = np.ones(len(out), bool)
        lead = tb[:-1][some]
        keep[lead[out[lead] == 32]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], kept[tb]


def _list(ids: np.ndarray, bounds: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    off = pa.array(bounds.astype(np.int32), mask=None if nulls is None else np.append(nulls, False))
    return pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32)))


def _encode(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for part, buf, bounds in chunks(batch, "__text", 1 << 19):
                ids, ib = enc.encode(buf, bounds)
                back, bb = dec.decode(ids, ib)
                same = np.diff(bb) == np.diff(bounds)
                if not (same.all() and np.array_equal(back, buf)):
                    for i in range(len(same)):
                        same[i] = back[bb[i] : bb[i + 1]].tobytes() == buf[bounds[i] : bounds[i + 1]].tobytes()
                nulls = part.column("__text").is_null().to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    [*[part.column(c) for c in columns], _list(ids, ib, nulls if nulls.any() else None), pa.array(np.diff(ib)), pa.array(same)],
                    names=[*columns, "ids", "n_tokens", "exact"],
                )

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model: str = MODEL) -> DataFrame:
    """(*keep, ids, n_tokens, exact): ``exact`` tells that decoding the ids gives the text back.

    The vocabulary (its size is fixed by the model) is read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    names = [f"__k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("__text"))
    kinds = ", ".join(f"{n} {d.schema[n].dataType.simpleString()}" for n in names)
    out = d.mapInArrow(lean(_encode(shared, names)), f"{kinds}, ids array<int>, n_tokens long, exact boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "ids", "n_tokens", "exact")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(shared.value)
        for batch in batches:
            col = batch.column("ids")
            lens = np.array([0 if x is None else x for x in pa.compute.list_value_length(col).to_pylist()], np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, tb = dec.decode(flat, np.concatenate([[0], np.cumsum(lens)]))
            raw = data.tobytes()
            null = col.is_null().to_pylist()
            texts = [None if null[i] else raw[tb[i] : tb[i + 1]].decode("utf-8", "replace") for i in range(len(lens))]
            yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c != "ids"], pa.array(texts, pa.string())], names=[*[c for c in batch.schema.names if c != "ids"], "text"])

    return run


def decode(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(*keep, text) from lists of ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    d = tokens.select(*keep, F.col(ids).alias("ids"))
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep)
    return d.mapInArrow(_decode(shared), f"{kinds}, text string")
