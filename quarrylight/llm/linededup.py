"""Fuzzy line deduplication (operator 10).

Lines are normalised (letters in lower case, punctuation dropped) and signed by a SimHash
of 128 bits over the halves of their words, so that a misspelt word keeps one of its two
features. Equal normalised lines are one node. Nodes that agree in a block of the signature
(pigeonhole: with ``blocks`` of them every pair within ``blocks - 1`` bits does), whose lengths
allow the edit similarity, and which lie near enough in the signature and in a second one of as many bits
over pairs of words (``screens``), are candidates; a candidate pair
is linked when the edit similarity of the normalised lines, 1 - levenshtein / longer length, is at
least ``similarity``, whatever their length. Connected nodes form a group, and of all its
occurrences the first one stays, in the order (doc_id with nulls last, row hash, line number).

Recall. All bounds follow from one assumption: one of TOUCHED half words differs, one at least. ``key_plan`` derives the width of a block from the number of nodes and the number of
blocks from the width and the words of a line, so that pairs in which one of TOUCHED half words
differs (one at least) share a block with probability RECALL at every number of nodes and every
length; the screens hold such pairs up to MARGIN standard deviations. Blocks beyond those of one signature are taken from its bits in another order. With w
words the edit similarity of 0.92 allows more scattered edits than that, up to about w / 2 single
letters in as many words; such a pair is found with less probability by itself, and mostly by way
of others of its group.

Verification goes in three rounds, so that a group of thousands of variants does not cost the
square of its size: first one candidate for each line, then one for each two groups between which there
are candidates, then every other candidate pair whose ends are still in different groups. The groups
are the same as if all pairs were verified.

Defined cases: lines of fewer than ``min_words`` words (blank ones too) are not compared and
stay; where a script has no spaces, runs of a few characters count as words; a document is dropped
when it had compared lines and all of them leave; rows that agree in doc_id and text are one
document, of which one row stays; a null text has no lines and stays; an empty table gives an
empty result. ``n_chars``, if there is such a column, follows the text of a changed document. All
other columns are carried through with their values, whatever their names: inside, columns have
names of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, row_id, row_order, sized
from .components import components
from .editdistance import Texts, within_texts
from .textkernel import CHUNK, bigrams, chunks, fold, lean, mix, popcount, sequence_hashes, simhash, span_hashes, spans, string_buffers

BITS = 128
TOUCHED = 16
RECALL = 0.9
#: Rows that a block's value has on average, as a power of two.
OCCUPANCY_BITS = 11
LEAST_BITS = 13
MARGIN = 2.3
PAIR_BITS = 128
SIMILARITY = 0.92
MIN_WORDS = 4
_SUFFIX = np.uint64(0xD6E8FEB86659FD93)
_SIZES, _WORDS = 20, 4  # bits of a length and of a number of words in a sort key
_LOW = _SIZES + _WORDS
HASHES = ("h1", "h2", "s1", "s2", "s3", "s4")
#: Pairs of lines that are compared at once.
_CELLS = 1 << 16
#: Lines of a block that are shuffled as one group, on average; rows that a worker holds for spreading and sorting.
GROUP, _HELD = 1 << 15, 1 << 17


def _lines(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line of each document, line starts, line ends); n line ends make n + 1 lines."""
    brk = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([bounds[:-1], brk + 1]), kind="stable")
    ends = np.sort(np.concatenate([brk, bounds[1:]]), kind="stable")
    per_doc = np.searchsorted(brk, bounds[1:]) - np.searchsorted(brk, bounds[:-1]) + 1
    first = np.zeros(len(bounds), np.int64)
    np.cumsum(per_doc, out=first[1:])
    # an empty document's start equals the next one's; stable order keeps one line for each
    return first, starts, ends


def _words(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words. Texts without spaces (three-byte characters from E0 to ED) are
    broken after every character whose number says so, about one in four, wherever it stands."""
    cuts = bounds
    wide = np.flatnonzero((b[:-2] >= 0xE0) & (b[:-2] <= 0xED)) if len(b) > 2 else np.zeros(0, np.int64)
    if len(wide):
        c = (b[wide].astype(np.uint32) << 12) ^ (b[wide + 1].astype(np.uint32) << 6) ^ b[wide + 2]
        cuts = np.union1d(bounds, wide[(c * np.uint32(0x9E3779B1)) >> np.uint32(30) == 0] + 3)
    return spans(b != 32, cuts)


def _signer(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, bounds in chunks(batch, "__text", CHUNK):
                first, ls, le = _lines(buf, bounds)
                b = fold(buf)
                s, e = _words(b, bounds)
                w0, w1 = np.searchsorted(s, ls), np.searchsorted(s, le)
                take = np.flatnonzero(w1 - w0 >= min_words)
                rows = part.num_rows
                doc = np.searchsorted(first, take, side="right") - 1
                zero = pa.array(np.zeros(rows, np.int64))
                compared = np.bincount(doc, minlength=rows).astype(np.int32)
                names = ["__id", "__rid", "__line", "h1", "h2", "s1", "s2", "s3", "s4", "size", "words"]
                mark = [pa.array(np.full(rows, -1, np.int32)), zero, zero, zero, zero, zero, zero, pa.array(np.zeros(rows, np.int32)), pa.array(compared)]
                yield pa.record_batch([part.column("__id"), part.column("__rid"), *mark], names=names)
                if not len(take):
                    continue
                n = (w1 - w0)[take]
                wb = np.zeros(len(take) + 1, np.int64)
                np.cumsum(n, out=wb[1:])
                idx = np.arange(wb[-1]) + np.repeat(w0[take] - wb[:-1], n)
                ws, we = s[idx], e[idx]
                mid = ws + (we - ws + 1) // 2
                head, tail, hw = span_hashes(b, np.concatenate([ws, mid, ws]), np.concatenate([mid, we, we])).reshape(3, -1)
                halves = np.empty(2 * len(idx), np.uint64)
                halves[::2], halves[1::2] = head, tail ^ _SUFFIX
                sig = simhash(halves, 2 * wb, BITS // 64).view(np.int64)
                pair = simhash(*bigrams(hw, wb), PAIR_BITS // 64).view(np.int64)
                gap = np.ones(len(idx), np.int64)
                gap[1:] = ws[1:] != we[:-1]
                gap[wb[:-1]] = 0
                if b.max() >= 0x80:  # lengths are in characters
                    at = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
                    chars = at[we] - at[ws]
                else:
                    chars = we - ws
                size = np.add.reduceat(chars + gap, wb[:-1])
                yield pa.record_batch(
                    [
                        part.column("__id").take(pa.array(doc)),
                        part.column("__rid").take(pa.array(doc)),
                        pa.array((take - first[doc]).astype(np.int32)),
                        pa.array(sequence_hashes(hw, wb, 0).view(np.int64)),
                        pa.array(sequence_hashes(hw, wb, 1).view(np.int64)),
                        pa.array(sig[:, 0]),
                        pa.array(sig[:, 1]),
                        pa.array(pair[:, 0]),
                        pa.array(pair[:, 1]),
                        pa.array(size.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=names,
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("__id"), row_id(F.col("doc_id"), F.col("text")).alias("__rid"), F.col("text").alias("__text"))


def signed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __rid, __line, h1, h2, s1, s2, s3, s4, size, words) of every line with enough words; besides,
    each row of ``docs`` has an entry with __line = -1, whose ``words`` are its compared lines."""
    d = _rows(docs)
    kind = d.schema["__id"].dataType.simpleString()
    return d.mapInArrow(lean(_signer(min_words)), f"__id {kind}, __rid long, __line int, h1 long, h2 long, s1 long, s2 long, s3 long, s4 long, size int, words int")


def apart(words: float) -> float:
    """Share of bits that differ, on average, between lines of so many words when one of TOUCHED
    half words differs, one at least."""
    touched = max(1.0, 2 * words / TOUCHED)
    return math.acos(max(0.0, 1 - touched / (2 * words))) / math.pi


def screens() -> tuple[np.ndarray, np.ndarray]:
    """(bits, bits of the second signature) within which candidates lie, by words, from 0 to 15 for
    lines of that many and more. Of few words too few pairs stay the same for the second one to tell."""

    def most(bits: int, share: float) -> int:
        return math.ceil(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))

    one, two = [], []
    for w in range(1 << _WORDS):
        w = max(w, MIN_WORDS)
        one.append(most(BITS, apart(w)))
        broken = 2 * max(1.0, 2 * w / TOUCHED) / (w - 1)  # a word is in two pairs
        two.append(most(PAIR_BITS, math.acos(1 - broken) / math.pi) if w >= 8 else PAIR_BITS)
    return np.array(one), np.array(two)


def key_plan(nodes: int, recall: float = RECALL) -> tuple[int, list[int]]:
    """(bits of a block, blocks for lines of 0, 1, 2 ... words; the last for all longer ones, and that
    of MIN_WORDS for shorter ones)."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, nodes))) - OCCUPANCY_BITS)
    own = BITS // bits  # those of the signature as it is
    need = []
    for words in range(MIN_WORDS, TOUCHED + 1):
        differ = round(BITS * apart(words))
        intact = math.comb(BITS - bits, differ) / math.comb(BITS, differ)
        need.append(max(own, math.ceil(math.log(1 - recall) / math.log1p(-intact))))
    return bits, [need[0]] * MIN_WORDS + need


def block_places(bits: int, blocks: int) -> list[np.ndarray]:
    """The bits of each block: a signature is cut up whole, then again in another order."""
    own = BITS // bits
    out: list[np.ndarray] = []
    while len(out) < blocks:
        turn = len(out) // own
        order = np.arange(BITS) if turn == 0 else np.random.default_rng([11, turn]).permutation(BITS)
        out += [order[i * bits : (i + 1) * bits] for i in range(own)]
    return out[:blocks]


def _records(bits: int) -> np.dtype:
    """A line in a block, as it is shuffled: value and size as one number, little end first, hash and signatures."""
    return np.dtype([("k", "u1", ((bits + _LOW + 7) // 8,)), *((c, "<u8") for c in ("h1", "s1", "s2", "s3", "s4"))])


def group_count(nodes: int) -> int:
    """Into how many groups the values of each block are put, so that one has about GROUP lines."""
    return max(1, nodes // GROUP)


def _spread(bits: int, blocks: list[int], groups: int):
    """(g, lines) lines of each block by groups of values, _records one after another."""
    places, kind = block_places(bits, max(blocks)), _records(bits)
    wide, per = kind["k"].shape[0], np.array(blocks)

    def spread(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, size, words = [c.view(np.uint64) for c in cols[1:3]], cols[5], cols[6]
        own = per[np.minimum(words, len(per) - 1)]
        low = np.minimum(size.astype(np.uint64), np.uint64((1 << _SIZES) - 1)) << np.uint64(_WORDS)
        low |= np.minimum(words, (1 << _WORDS) - 1).astype(np.uint64)
        for t in range(int(own.max(initial=0))):
            value = np.zeros(len(own), np.uint64)
            for i, p in enumerate(places[t].tolist()):
                value |= ((s[p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(i)
            group = (mix(value) % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.uint64)
            at = np.flatnonzero(own > t)
            at = at[np.argsort(group[at], kind="stable")]
            out = np.empty(len(at), kind)
            out["k"] = ((value << np.uint64(_LOW)) | low)[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
            for name, c in zip(("h1", "s1", "s2", "s3", "s4"), cols, strict=False):
                out[name] = c.view(np.uint64)[at]
            group = group[at].astype(np.int64)
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = (np.append(first, len(at)) * kind.itemsize).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.record_batch([pa.array(t * groups + group[first]), lines], names=["g", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("h1", "s1", "s2", "s3", "s4", "size", "words")])
            rows += batch.num_rows
            if rows >= _HELD:
                yield from spread([np.concatenate(x) for x in zip(*held, strict=True)])
                held, rows = [], 0
        if rows:
            yield from spread([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _sorted(bits: int, groups: int):
    """(k, h1, s1, s2, s3, s4) rows sorted by k, of whole groups; they come by groups. ``k`` is block, value,
    size and words."""
    kind = _records(bits)
    wide, shift = kind["k"].shape[0], np.uint64(bits + _LOW)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, lines = (np.concatenate(x) for x in zip(*held, strict=True))
        k = np.zeros((len(lines), 8), np.uint8)
        k[:, :wide] = lines["k"]
        k = k.view("<u8").reshape(-1) | (block << shift)
        order = np.argsort(k)
        return pa.record_batch([pa.array(k[order].view(np.int64)), *[pa.array(lines[c][order].view(np.int64)) for c in kind.names[1:]]], names=["k", *kind.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many, last = 0, -1
        for batch in batches:
            g = batch.column("g").to_numpy()
            buf, bounds = string_buffers(batch.column("lines").cast(pa.large_binary()).view(pa.large_string()))
            lines = buf.view(kind)
            at = bounds // kind.itemsize
            block = np.repeat((g // groups).astype(np.uint64), np.diff(at))
            # groups end before these rows
            i = 0
            for j in np.flatnonzero(np.diff(g, prepend=last)):
                if many + at[j] - at[i] >= _HELD:
                    held.append((block[at[i] : at[j]], lines[at[i] : at[j]]))
                    yield rows(held)
                    held, many, i = [], 0, j
            held.append((block[at[i] :], lines[at[i] :].copy()))
            many += int(at[-1] - at[i])
            last = g[-1] if len(g) else last
        if many:
            yield rows(held)

    return run


def _masks(places: list[np.ndarray]) -> list[tuple[np.uint64, np.uint64]]:
    out = []
    for p in places:
        lo, hi = (sum(1 << int(x - base) for x in p if base <= x < base + 64) for base in (0, 64))
        out.append((np.uint64(lo), np.uint64(hi)))
    return out


def _candidates(bits: int, blocks: list[int], similarity: float):
    places = block_places(bits, max(blocks))
    masks, wide = _masks(places), np.uint64(bits)
    sizes, (first, second) = np.uint64((1 << _SIZES) - 1), screens()

    def emit(k, h1, s1, s2, s3, s4):
        u = k.view(np.uint64)
        bucket, size = u >> np.uint64(_LOW), ((u >> np.uint64(_WORDS)) & sizes).astype(np.int64)
        words = (u & np.uint64((1 << _WORDS) - 1)).astype(np.int64)
        n = len(bucket)
        new = np.ones(n, bool)
        new[1:] = bucket[1:] != bucket[:-1]
        at = np.append(np.flatnonzero(new), n)
        # in a bucket sizes ascend: partners beyond this length cannot be similar
        most = np.floor(size / similarity + 1e-9).astype(np.int64)
        most[size == int(sizes)] = 1 << 40  # lengths from here on are not told apart
        upto = np.repeat(at[1:], np.diff(at))
        # last row of the bucket that is short enough: sizes ascend within buckets
        order = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at)) << 42
        upto = np.minimum(upto, np.searchsorted(order + size, order + np.minimum(most, (1 << 41)), side="right"))
        one, two = first[words].astype(np.uint8), second[words].astype(np.uint8)  # fewer words allow more

        def near(a, b):
            fewer = np.minimum(words[a], words[b])
            far = popcount(s1[a] ^ s1[b]) + popcount(s2[a] ^ s2[b])
            some = (far <= first[fewer]) & (popcount(s3[a] ^ s3[b]) + popcount(s4[a] ^ s4[b]) <= second[fewer])
            a, b, far = a[some], b[some], far[some]
            if not len(a):
                return
            # a pair that shares several blocks is reported under the first of them
            d1, d2 = s1[a] ^ s1[b], s2[a] ^ s2[b]
            t = bucket[a] >> wide
            keep = np.ones(len(a), bool)
            for i in range(int(t.max())):
                keep &= ~((t > i) & (((d1 & masks[i][0]) | (d2 & masks[i][1])) == 0))
            a, b, far = a[keep], b[keep], far[keep]
            yield pa.record_batch([pa.array(np.minimum(h1[a], h1[b])), pa.array(np.maximum(h1[a], h1[b])), pa.array(far.astype(np.int32))], names=["a", "b", "apart"])

        # rows meet the rows behind them in blocks, of which what lies beyond a row's last partner is taken out;
        # all in the same memory, as new pages cost more than counting bits
        found, many, i = [], 0, 0
        both, bits_u, bits_v, close = (np.empty(_CELLS, kind) for kind in (np.uint64, np.uint8, np.uint8, bool))
        while i < n:
            if upto[i] - i < 2:  # on to the next row that has a partner
                more = upto[i : i + 4096] - np.arange(i, min(n, i + 4096)) > 1
                i += int(more.argmax()) if more.any() else len(more)
                continue
            end = min(n, i + 64)
            last = int(upto[end - 1])
            for c in range(i + 1, last, _CELLS // 64):
                d = min(last, c + _CELLS // 64)
                pairs = two[i:d].max() if c == i + 1 else max(two[i:end].max(), two[c:d].max())
                # word pairs tell lines of one vocabulary apart, if there are enough of them
                u, v, most_far = (s3, s4, pairs) if pairs < PAIR_BITS else (s1, s2, max(one[i:end].max(), one[c:d].max()))
                cells = (end - i) * (d - c)
                x, far, rest, hit = both[:cells], bits_u[:cells], bits_v[:cells], close[:cells]
                grid = x.reshape(end - i, d - c)
                np.bitwise_count(np.bitwise_xor(u[i:end, None], u[c:d], out=grid).reshape(-1), out=far)
                np.bitwise_count(np.bitwise_xor(v[i:end, None], v[c:d], out=grid).reshape(-1), out=rest)
                far += rest
                hit = np.less_equal(far, most_far, out=hit).nonzero()[0]
                if len(hit):
                    x, y = np.divmod(hit, d - c)
                    x, y = x + i, y + c
                    own = (y > x) & (y < upto[x])
                    found.append((x[own], y[own]))
                    many += len(found[-1][0])
                if many > 1 << 16:
                    yield from near(*[np.concatenate(v) for v in zip(*found, strict=True)])
                    found, many = [], 0
            i = end
        if found:
            yield from near(*[np.concatenate(v) for v in zip(*found, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("k", "h1")] + [batch.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2", "s3", "s4")]
            held.append(cols)
            rows += batch.num_rows
            last = cols[0][-1] >> _LOW
            if rows < 1 << 18 or cols[0][0] >> _LOW == last:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(cols[0] >> _LOW, last))  # the last bucket may go on in the next batch
            yield from emit(*[c[:end] for c in cols])
            held = [[c[end:].copy() for c in cols]]
            rows = len(held[0][0])
        if held:
            yield from emit(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def candidate_pairs(nodes: DataFrame, n_nodes: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, apart) line hashes and their distance, each pair once, from nodes(h1, s1, s2, s3, s4, size, words)."""
    bits, blocks = key_plan(n_nodes)
    groups = group_count(n_nodes)
    compare, in_order = _candidates(bits, blocks, similarity), _sorted(bits, groups)
    return (
        nodes.select("size", "words", "h1", "s1", "s2", "s3", "s4")
        .mapInArrow(lean(_spread(bits, blocks, groups)), "g long, lines binary")
        .repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(lean(lambda batches: compare(in_order(batches))), "a long, b long, apart int")
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normalised texts of the wanted lines of each document."""
    for batch in batches:
        for part, buf, bounds in chunks(batch, "__text", CHUNK):
            first, ls, le = _lines(buf, bounds)
            b = fold(buf)
            s, e = _words(b, bounds)
            want = part.column("__want")
            flat = want.flatten()
            doc = np.repeat(np.arange(part.num_rows), np.diff(want.offsets.to_numpy()))
            at = first[doc] + flat.field("__line").to_numpy()
            w0, w1 = np.searchsorted(s, ls[at]), np.searchsorted(s, le[at])
            keep = b != 32
            keep[e[e < len(b)]] = True  # one separator behind each word
            place = np.concatenate([[0], np.cumsum(keep)])
            lo, hi = place[s[w0]], place[e[w1 - 1]]
            n = hi - lo
            offsets = np.concatenate([[0], np.cumsum(n)])
            idx = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], n)
            data = b[keep][idx]
            lines = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            yield pa.record_batch([flat.field("h1"), lines.cast(pa.string())], names=["h", "line"])


def _verify(allowed: int):
    """Keep the pairs within ``allowed`` thousandths of the longer line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb = (Texts.of(batch.column(c)) for c in ("la", "lb"))
            # exact in integers: distance * 1000 <= longer length * allowed thousandths
            ok = within_texts(la, lb, np.maximum(la.size, lb.size) * allowed // 1000)
            yield batch.drop_columns(["la", "lb"]).filter(pa.array(ok))

    return run


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b and other numbers) whose lines have at least the edit similarity."""
    x = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(
        texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b"
    )
    return x.select(*pairs.columns, "la", "lb").mapInArrow(lean(_verify(round((1 - similarity) * 1000))), ", ".join(f"{c} long" for c in pairs.columns))


def line_groups(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, __group) of the nodes that have a link or several occurrences, a written table."""
    nodes = cut(
        lines.filter("__line >= 0")
        .groupBy("h1", "h2")
        # columns of any one occurrence, of the same one: hash aggregation without a sort
        .agg(*[F.first(c).alias(c) for c in ("s1", "s2", "s3", "s4", "size", "words", "__rid", "__line")], F.count(F.lit(1)).alias("n")),
        (*HASHES, "__rid"),
    )
    pairs = cut(candidate_pairs(nodes, nodes.count(), similarity), ("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    want = cut(nodes.select("h1", "__rid", "__line").join(wanted, "h1").groupBy("__rid").agg(F.collect_list(F.struct("__line", "h1")).alias("__want")))
    found = _rows(docs).join(sized(want), "__rid").select("__text", "__want").mapInArrow(lean(_fetch), "h long, line string")
    texts = cut(found.groupBy("h").agg(F.first("line").alias("line")))
    one = cut(pairs.groupBy("b").agg(F.min_by("a", "apart").alias("a")))
    first = cut(_similar(one, texts, similarity))
    near = cut(components(first))
    rest = cut(
        pairs.join(near.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(near.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .join(one.select("b", F.col("a").alias("tried")), "b")
        .select("a", "b", "apart", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), "tried")
        .filter("ra <> rb and a <> tried")
        .drop("tried")
    )
    between = rest.groupBy(F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v")).agg(F.min_by(F.struct("a", "b", "ra", "rb"), "apart").alias("p"))
    second = cut(between.select("p.*"))
    linked = cut(_similar(second, texts, similarity))
    joined = cut(components(linked.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    known = sized(joined)
    last = (
        rest.join(known.select(F.col("node").alias("ra"), F.col("root").alias("sa")), "ra", "left")
        .join(known.select(F.col("node").alias("rb"), F.col("root").alias("sb")), "rb", "left")
        .filter(F.coalesce("sa", "ra") != F.coalesce("sb", "rb"))
        .join(second.select("a", "b"), ["a", "b"], "left_anti")
        .select("a", "b")
    )
    # of what is known, stars are enough
    stars = near.filter("node <> root").unionByName(joined.filter("node <> root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = cut(components(stars.unionByName(_similar(last, texts, similarity))))
    out = cut(
        nodes.join(roots, nodes["h1"] == roots["node"], "left").filter("root is not null or n > 1").select("h1", "h2", F.coalesce("root", "h1").alias("__group"))
    )
    discard(nodes, pairs, want, texts, one, first, near, rest, second, linked, joined, roots)
    return out


def decisions(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(__rid, __drop = lines that leave, __left = compared lines that stay, __rows) of the
    documents that lose a line or have several rows, a written table."""
    lines = cut(signed_lines(docs, min_words), HASHES)
    groups = line_groups(docs, lines, similarity)
    own = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__rid").alias("rid"), F.col("__line").alias("line"))
    again = cut(lines.filter("__line >= 0").join(groups, ["h1", "h2"]).select("__group", "__rid", "__line", own.alias("__own")))
    first = cut(again.groupBy("__group").agg(F.min("__own").alias("__first")))
    leave = again.join(sized(first), "__group").filter("__own <> __first")
    # repeated rows bring every line several times: sets of line numbers, and the marks count the rows
    drop = leave.groupBy("__rid").agg(F.collect_set("__line").alias("__drop"))
    marks = lines.filter("__line < 0").groupBy("__rid").agg(F.first("words").alias("__compared"), F.count(F.lit(1)).alias("__rows"))
    out = cut(
        marks.join(drop, "__rid", "left")
        .filter("__drop is not null or __rows > 1")
        .select("__rid", "__drop", (F.col("__compared") - F.coalesce(F.size("__drop"), F.lit(0))).alias("__left"), "__rows")
    )
    discard(lines, groups, again, first)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines, with the same columns."""
    fate = decisions(docs, min_words, similarity)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*inner.values())
    text = F.col(inner["text"])
    x = d.withColumn("__rid", row_id(F.col(inner["doc_id"]), text)).join(sized(fate), "__rid", "left").filter("__drop is null or __left > 0")
    changed = F.col("__drop").isNotNull()
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col("__drop"), i))
    x = x.withColumn("__after", F.when(changed, F.array_join(kept, "\n")).otherwise(text))
    new = {"text": F.col("__after")}
    if "n_chars" in inner:
        new["n_chars"] = F.when(changed, F.length("__after").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(inner["n_chars"]))
    out = [new.get(c, F.col(i)).alias(i) for c, i in inner.items()]
    if fate.filter("__rows > 1").isEmpty():
        return x.select(*out).toDF(*docs.columns)
    many = F.coalesce(F.col("__rows"), F.lit(1)) > 1
    same = Window.partitionBy("__rid").orderBy(row_order(list(inner.values())))
    one = x.filter(many).withColumn("__n", F.row_number().over(same)).filter("__n = 1")
    return x.filter(~many).select(*out).unionByName(one.select(*out)).toDF(*docs.columns)
