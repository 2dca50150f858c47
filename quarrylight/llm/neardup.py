"""SimHash near-duplicates (operator 4).

A document's signature has 256 sign bits over its word pairs. Documents with equal
signatures are one node. Random bit-sampling hashing finds candidates among the nodes: each
of several tables groups them by sampled coordinates. Buckets are never split, so that their
pairs keep the planned recall: all pairs are compared, save those that links already connect. Up to
``cap`` rows all near pairs are links, above it, where they are many, as few as connect the same nodes.
Candidates within ``radius`` bits are linked, and connected nodes form a group.

The number of base bits follows the number of nodes, and the number of tables follows from
the base bits so that a pair at ``radius``, the farthest that counts, shares a bucket with
probability ``recall``; both are computed, neither is a cap.

Rows travel once per table with 8 bytes of key and 32 of signature; texts are read once and
never shuffled by the search.

Defined cases: a null or empty text, and one without any letter or digit, has no signature
and belongs to no group; a text of one word is compared by that word; repeated rows and
rows that share a doc_id are members like any other; the representative is the least
doc_id (nulls last), then the least row hash; an empty table gives an empty result. Columns
other than those named are carried by ``keep_one`` and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, row_id, row_order, sized
from .components import components
from .textkernel import CHUNK, bigrams, chunks, fold, lean, popcount, simhash, span_hashes, spans

BITS = 256
RADIUS = 56
RECALL = 0.95
OCCUPANCY_BITS = 9
CAP = 256
#: Buckets of up to so many rows are compared many at once; and pairs that are compared at once in others.
_FEW, _CELLS = 24, 1 << 17


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, bounds in chunks(batch, "__text", CHUNK):
            b = fold(buf)
            s, e = spans(b != 32, bounds)
            feat, fb = bigrams(span_hashes(b, s, e), np.searchsorted(s, bounds))
            some = np.flatnonzero(np.diff(fb) > 0)
            sig = simhash(feat, np.concatenate([fb[:-1][some], fb[-1:]]), BITS // 64)
            keep = part.take(pa.array(some))
            yield pa.record_batch(
                [keep.column("__id"), keep.column("__rid"), pa.array([x.tobytes() for x in sig], pa.binary())], names=["__id", "__rid", "__sig"]
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __rid, __sig) of the rows that have a signature."""
    d = docs.select(F.col(id_col).alias("__id"), row_id(F.col(id_col), F.col(text)).alias("__rid"), F.col(text).alias("__text"))
    kind = d.schema["__id"].dataType.simpleString()
    return d.mapInArrow(lean(_sign), f"__id {kind}, __rid long, __sig binary")


def table_plan(nodes: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(base bits, tables) for so many nodes."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, nodes))) - OCCUPANCY_BITS))
    hit = (1 - radius / BITS) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log1p(-hit)))


def _matrix(col: pa.Array) -> np.ndarray:
    """(rows, BITS / 64) words of a binary column without nulls."""
    if len(col) == 0:
        return np.zeros((0, BITS // 64), np.uint64)
    start = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    data = np.frombuffer(col.buffers()[2], np.uint8)[start : start + len(col) * BITS // 8]
    return data.view(np.uint64).reshape(-1, BITS // 64) if start % 8 == 0 else data.copy().view(np.uint64).reshape(-1, BITS // 64)


def _spread(tables: int, seed: int = 7):
    places = np.stack([np.random.default_rng([seed, t]).permutation(BITS)[:64] for t in range(tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                col = batch.column("__sig").slice(i, 4096)
                bits = np.unpackbits(_matrix(col).view(np.uint8).reshape(len(col), -1), axis=1)
                for t in range(tables):
                    key = np.packbits(np.ascontiguousarray(bits[:, places[t]]), axis=1).copy().view(">i8").reshape(-1).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(col), t, np.int32)), pa.array(key), col], names=["t", "key", "sig"])

    return run


def _buckets(t: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Bounds of the buckets: rows of the same table with the same base bits."""
    new = np.flatnonzero((top[1:] != top[:-1]) | (t[1:] != t[:-1])) + 1
    return np.concatenate([[0], new, [len(t)]])


def _near(w: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the rows within ``radius``: all are compared. Rows that differ too much
    in all words but the last need no look at that one."""
    far = popcount(w[0][x][:, None] ^ w[0][y])
    for word in w[1:-1]:
        far += popcount(word[x][:, None] ^ word[y])
    at = np.flatnonzero(far.reshape(-1) <= radius)
    i, j = np.divmod(at, len(y))
    near = far.reshape(-1)[at] + popcount(w[-1][x[i]] ^ w[-1][y[j]]) <= radius
    return i[near], j[near]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each component) after these links."""
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if not (lo != hi).any():
            return label
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these links some that connect what the labels don't connect yet; the labels then."""
    left, right = [a[:0]], [b[:0]]
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        other, first = np.unique(b, return_index=True)
        left.append(a[first])
        right.append(other)
        label = _merge(label, a[first], other)
    return label, np.concatenate(left), np.concatenate(right)


def _bucket_links(w: np.ndarray, radius: int, thin: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of the rows of one bucket, all compared by blocks of rows; with ``thin``, where they are
    many, only such as connect what is not connected yet."""
    out = []
    todo, label = np.arange(w.shape[1]), None
    while len(todo) > 1:
        many = min(64, max(1, _CELLS // len(todo)))
        x, y, rest = todo[:many], todo, todo[many:]
        if label is not None:
            same = label[todo] == label[todo[0]]
            if np.count_nonzero(same) > many:  # rows of one component need not meet each other
                x, y = todo[same][:many], todo[~same]
                rest = todo[~same | (np.cumsum(same) > many)]
        i, j = _near(w, x, y, radius)
        a, b = x[i], y[j]
        if y is todo:  # rows of a block meet each other once
            once = j > i
            a, b = a[once], b[once]
        if thin and len(a) > 4 * many:
            label, a, b = _forest(np.arange(w.shape[1]) if label is None else label, a, b)
        if len(a):
            out.append((a, b))
        todo = rest
    return out


def _links(at: np.ndarray, sig: np.ndarray, radius: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers within ``radius`` in the same bucket: all of them up to ``cap`` rows, above
    it at least as many as connect the same rows."""
    size = np.diff(at)
    w = np.ascontiguousarray(sig.T)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = (size > 1) & (size <= min(cap, _FEW))
    ends = np.repeat(at[1:], size)
    rows = np.flatnonzero(np.repeat(few, size))
    step = 1
    while len(rows):  # many small buckets at once
        rows = rows[rows + step < ends[rows]]
        far = sum(popcount(word[rows] ^ word[rows + step]).astype(np.int16) for word in w)
        left.append(rows[far <= radius])
        right.append(left[-1] + step)
        step += 1
    for large in (False, True):
        some = [[x + at[k] for x in ab] for k in np.flatnonzero((size > 1) & ~few & ((size > cap) == large)) for ab in _bucket_links(w[:, at[k] : at[k + 1]], radius, large)]
        if some:
            a, b = (np.concatenate(x) for x in zip(*some, strict=True))
            if large:
                _, a, b = _forest(np.arange(len(sig)), a, b)
            left.append(a)
            right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _pairs(bits: int, radius: int, cap: int):
    def emit(t, key, sig):
        a, b = _links(_buckets(t, key.view(np.uint64) >> np.uint64(64 - bits)), sig, radius, cap)
        raw = np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1)
        for i in range(0, len(a), 20000):
            x, y = raw[a[i : i + 20000]], raw[b[i : i + 20000]]
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, sig = batch.column("t").to_numpy(), batch.column("key").to_numpy(), _matrix(batch.column("sig"))
            if held is not None:
                t, key, sig = (np.concatenate([x, y]) for x, y in zip(held, (t, key, sig), strict=True))
            top = key.view(np.uint64) >> np.uint64(64 - bits)
            last = np.flatnonzero((top != top[-1]) | (t != t[-1]))
            end = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if end:
                yield from emit(t[:end], key[:end], sig[:end])
            held = (t[end:].copy(), key[end:].copy(), sig[end:].copy())
        if held is not None:
            yield from emit(*held)

    return run


def near_pairs(nodes: DataFrame, n_nodes: int, radius: int = RADIUS, cap: int = CAP, tables: int | None = None) -> DataFrame:
    """Distinct (a, b) signatures within ``radius`` found by the tables, from nodes(__sig)."""
    bits, planned = table_plan(n_nodes, radius)
    spread = nodes.mapInArrow(lean(_spread(tables or planned)), "t int, key long, sig binary")
    bucket = F.shiftrightunsigned("key", 64 - bits)
    return (
        spread.repartition("t", bucket)
        .sortWithinPartitions("t", bucket, "key")
        .mapInArrow(lean(_pairs(bits, radius, cap)), "a binary, b binary")
        .distinct()
    )


def _line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line))


def signatures_before(docs: DataFrame, before: DataFrame) -> DataFrame:
    """Signatures of ``docs`` by the texts that they had in ``before``: where a row of the same
    doc_id is there, one only, and has every line of the text as it is now, its signature is used;
    else that of the text itself. Only signatures and hashes of lines are joined, never texts."""
    now = docs.select(
        F.col("doc_id").alias("__id"), row_id(F.col("doc_id"), F.col("text")).alias("__rid"), _line_hashes(F.col("text")).alias("__lines")
    ).filter("__id is not null and __lines is not null")
    one = before.filter("doc_id is not null and text is not null")
    was = signatures(one).select("__id", F.col("__rid").alias("__was"), "__sig")
    lines = one.select(F.col("doc_id").alias("__id"), row_id(F.col("doc_id"), F.col("text")).alias("__was"), _line_hashes(F.col("text")).alias("__all"))
    # an id that several texts have says nothing
    single = lines.groupBy("__id").agg(F.min("__was").alias("__lo"), F.max("__was").alias("__hi")).filter("__lo = __hi").select("__id", F.col("__lo").alias("__was"))
    known = lines.join(single, ["__id", "__was"]).dropDuplicates(["__id"]).join(was.dropDuplicates(["__id"]).select("__id", "__sig"), "__id")
    earlier = now.join(known, "__id").filter(F.size(F.array_except("__lines", "__all")) == 0).select("__id", "__rid", "__sig")
    earlier = cut(earlier)
    own = signatures(docs)
    return own.join(earlier.select("__rid").distinct(), "__rid", "left_anti").unionByName(earlier)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, before: DataFrame | None = None) -> DataFrame:
    """(__id, __rid, __group, __rank) of every row with a near duplicate. __group is the
    representative's id; the representative has rank 1. With ``before`` (columns doc_id and text)
    rows are compared by the texts that they had there."""
    sig = cut(signatures(docs, id_col, text) if before is None else signatures_before(docs, before))
    nodes = cut(sig.groupBy("__sig").agg(F.count(F.lit(1)).alias("n")))
    edges = cut(near_pairs(nodes.select("__sig"), nodes.count(), radius))
    roots = cut(components(edges))
    discard(edges)
    # only nodes with a link or with several rows matter; the rest leaves here
    multi = cut(
        nodes.join(sized(roots), nodes["__sig"] == roots["node"], "left")
        .filter("root is not null or n > 1")
        .select("__sig", F.coalesce("root", "__sig").alias("__root"))
    )
    discard(nodes, roots)
    order = Window.partitionBy("__root").orderBy(F.col("__id").asc_nulls_last(), "__rid")
    members = sig.join(sized(multi), "__sig").withColumn("__rank", F.row_number().over(order))
    return members.withColumn("__group", F.first("__id").over(order)).select("__id", "__rid", "__group", "__rank")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, keep) of every document with a near duplicate; group_id is the
    doc_id of the one that stays."""
    return groups(docs, id_col, text, radius).select(
        F.col("__id").alias(id_col), F.col("__group").alias("group_id"), (F.col("__rank") == 1).alias("keep")
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, before: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each group, and all rows of no group. Inside, columns
    have names of their own, so that any name may come in. ``before`` has the texts by which rows are
    compared, where lines have been taken from them since: what is left of a copy no longer resembles
    its original."""
    members = cut(groups(docs, radius=radius, before=before))
    return drop_others(docs, members)


def drop_others(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``members``(__rid, __rank) knows and that are no representative."""
    # a row leaves when its (doc_id, text) is never a representative
    fate = cut(members.groupBy("__rid").agg(F.min("__rank").alias("__best"), F.count(F.lit(1)).alias("__many")))
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cols = list(inner.values())
    d = docs.toDF(*cols).withColumn("__rid", row_id(F.col(inner["doc_id"]), F.col(inner["text"])))
    drop = cut(fate.filter("__best > 1").select("__rid"))
    left = d.join(sized(drop), "__rid", "left_anti")
    twice = cut(fate.filter("__best = 1 and __many > 1").select("__rid"))
    if twice.isEmpty():
        return left.select(*cols).toDF(*docs.columns)
    # rows that agree in doc_id and text: one of them stays
    same = Window.partitionBy("__rid").orderBy(row_order(cols))
    one = left.join(sized(twice), "__rid", "left_semi").withColumn("__n", F.row_number().over(same)).filter("__n = 1")
    return left.join(sized(twice), "__rid", "left_anti").select(*cols).unionByName(one.select(*cols)).toDF(*docs.columns)
