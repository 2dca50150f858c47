"""Approximate nearest neighbours by multi-index hashing (operator 7).

Vectors are centred, rotated by principal axes and by a learned rotation that brings them
close to the corners of the cube (iterative quantisation); the signs are the binary code.
Codes are split into substrings, each with inverted lists over its values. By the pigeonhole
principle a code within ``radius`` of a query lies within a small radius of it in one of the
substrings, so probing the lists around the query's substrings retrieves every such code;
these are checked in full and their vectors are reranked by exact cosine.

The queries are a stated set: every item whose id is divisible by ``query_step`` (1 for all),
against all items. Mean and covariance are sums over all vectors; the rotation is fitted on a
bounded sample of them, ``FIT_ROWS`` at most, and every vector is indexed. Each query has its own
radius in each block of the index: it is widened until k codes are found, then to the radius that
belongs to the k-th exact cosine found so far. That radius is calibrated over all queries: each is
compared in full with the block that it belongs to, and of those whose k-th cosine falls into
the same band, ``ROWS`` have ``RECALL`` of their neighbours within it. Where no query fell into a
band or above, the radius is the whole code.

Vectors are packed, ``block_rows`` to a block, by one shuffle. A block of the index meets each
block of queries once, and a block of queries holds the queries of ``query_step`` blocks, so that
the index is moved once more for every ``block_rows`` queries.

Defined cases: null vectors, vectors of another length than most, with a null or a value
that is not finite, and zero vectors are left out (they are nobody's neighbours); rows with a
null id are left out; rows of the same id are one item, the one with the least hash; ties in
cosine (steps of 1e-6) go to the smaller id; an item with fewer than k others has fewer
neighbours; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard

BITS = 64
SUBSTRINGS = 8
NEIGHBOURS = 10
BLOCK_ROWS = 8192
FIT_ROWS = 20_000
RECALL = 0.95
ROWS = 0.99
QUERY_STEP = 100
BANDS = 100
WIDEN = 4
_STEP = 1_000_000


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray  # (dimensions, bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.axes) > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, width)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column("__v")
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null element becomes NaN
        first = np.cumsum(size) - size
        for w in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == w)
            x = flat[first[rows][:, None] + np.arange(w)]
            with np.errstate(over="ignore", invalid="ignore"):
                n = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(n) & (n > 0)
            unit = (x[ok] / n[ok, None]).astype(np.float32)
            yield pa.record_batch([batch.column("__id").take(pa.array(rows[ok])), pa.array([r.tobytes() for r in unit], pa.binary())], names=["__id", "__v"])


def unit_vectors(items: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(__id, __v) with unit vectors as bytes, one row per id, a written table."""
    d = items.select(F.col(id_col).alias("__id"), F.col(vector).alias("__v")).filter("__id is not null and __v is not null")
    packed = d.mapInArrow(_pack, f"__id {d.schema['__id'].dataType.simpleString()}, __v binary")
    one = packed.groupBy("__id").agg(F.min_by("__v", F.struct(F.xxhash64("__v"), "__v")).alias("__v"))
    all_rows = cut(one)
    common = all_rows.groupBy(F.length("__v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return all_rows if common is None else all_rows.filter(F.length("__v") == common["w"])


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            x = _matrix(batch.column("__v"), width).astype(np.float64)
            total[:width] += x.T @ x
            total[width] += x.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(width + 1)), *[pa.array(total[:, i]) for i in range(width)]], names=["r", *[f"c{i}" for i in range(width)]])

    return run


def fit(vectors: DataFrame, rows: int, width: int, fit_rows: int = FIT_ROWS, rounds: int = 30) -> Coder:
    """Principal axes over all vectors, and a rotation learned on a bounded sample."""
    cols = [f"c{i}" for i in range(width)]
    sums = vectors.mapInArrow(_moments(width), "r long, " + ", ".join(f"{c} double" for c in cols)).groupBy("r").agg(*[F.sum(c).alias(c) for c in cols])
    m = np.array([[r[c] for c in cols] for r in sums.orderBy("r").collect()])
    mean = m[width] / rows
    cov = m[:width] / rows - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    bits = min(BITS, width)
    axes = axes[:, order[:bits]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(bits)])
    u = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    part = vectors.filter(u <= 1.2 * fit_rows / max(rows, 1)).orderBy(u, "__id").limit(fit_rows).collect()
    x = (np.frombuffer(b"".join(bytes(r["__v"]) for r in part), np.float32).reshape(-1, width) - mean) @ axes
    rot = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(x @ rot > 0, 1.0, -1.0).T @ x)
        rot = (left @ right).T
    full = np.zeros((width, BITS))
    full[:, :bits] = axes @ rot  # bits beyond the dimensions are constant
    return Coder(mean, full)


def band(s: np.ndarray) -> np.ndarray:
    """Bands of cosines given in steps; what is below every cosine has band 0."""
    return np.clip((s + _STEP) * BANDS // (2 * _STEP), 0, BANDS).astype(np.int64)


def _stack(x: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block as one row."""
    ids = x["__id"].to_numpy(np.int64)
    order = np.argsort(ids)
    return pd.DataFrame({"b": [int(x["__b"].iloc[0])], "ids": [ids[order].tobytes()], "v": [b"".join(x["__v"].to_numpy()[order])]})


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """(b, ids, v): vectors in blocks by a hash of their id, each block one row, a written table."""
    v = vectors.select(F.col("__id").cast("long").alias("__id"), "__v").withColumn("__b", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    return cut(v.groupBy("__b").applyInPandas(_stack, "b int, ids binary, v binary"))


def _rows(width: int, ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(v, np.float32).reshape(-1, width)


def _needs(width: int, coder: Coder, k: int, recall: float, step: int):
    """Per block: band of the k-th exact cosine and the distance that holds ``recall`` of the k, of each query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, raw in zip(frame["ids"], frame["v"], strict=True):
                i, v = _rows(width, ids, raw)
                queries = np.flatnonzero(i % step == 0)
                if len(i) <= k or not len(queries):
                    continue
                codes, count = coder.codes(v), np.zeros((BANDS + 1, BITS + 1), np.int64)
                for at in range(0, len(queries), 512):
                    q = queries[at : at + 512]
                    s = np.floor(v[q] @ v.T * _STEP + 0.5).astype(np.int64)
                    s[np.arange(len(q)), q] = -10 * _STEP
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    far = np.sort(np.bitwise_count(codes[top] ^ codes[q, None]), axis=1)[:, int(np.ceil(recall * k)) - 1]
                    np.add.at(count, (band(np.take_along_axis(s, top, axis=1).min(axis=1)), far.astype(np.int64)), 1)
                b, d = np.nonzero(count)
                yield pd.DataFrame({"b": b.astype(np.int32), "d": d.astype(np.int32), "n": count[b, d]})

    return run


def calibrate(blocks: DataFrame, width: int, coder: Coder, k: int, step: int, recall: float = RECALL, rows: float = ROWS) -> np.ndarray:
    """The radius for each band of the k-th cosine, from packed blocks; it never grows with the cosine."""
    count = np.zeros((BANDS + 1, BITS + 1), np.int64)
    for r in blocks.mapInPandas(_needs(width, coder, k, recall, step), "b int, d int, n long").groupBy("b", "d").agg(F.sum("n").alias("n")).collect():
        count[r["b"], r["d"]] = r["n"]
    some = count.sum(axis=1) > 0
    below = np.cumsum(count, axis=1)
    need = np.where(some, (below >= rows * below[:, -1:]).argmax(axis=1), 0)
    radii = np.maximum.accumulate(need[::-1])[::-1]
    if not some.any():
        return np.full(BANDS + 1, BITS)
    radii[: some.argmax()] = BITS
    return radii


def substring_radii(radius: int, substrings: int = SUBSTRINGS) -> list[int]:
    """Pigeonhole: a code within ``radius`` is within one of these of the query in its substring."""
    base, more = divmod(radius, substrings)
    return [base if j <= more else base - 1 for j in range(substrings)]


class Index:
    """Inverted lists of one block, as bitmaps per substring value, widened to the probed balls."""

    def __init__(self, codes: np.ndarray, radius: int, substrings: int = SUBSTRINGS) -> None:
        self.width = BITS // substrings
        self.substrings = substrings
        self.codes = codes
        values = np.arange(1 << self.width)
        self.near = np.bitwise_count(values[:, None] ^ values[None])
        self.lists = []
        for j in range(substrings):
            lists = np.zeros((len(values), len(codes)), bool)
            lists[self._part(codes, j), np.arange(len(codes))] = True
            self.lists.append(np.packbits(lists, axis=1))
        self.balls: dict[tuple[int, int], np.ndarray] = {}
        for j, r in enumerate(substring_radii(radius, substrings)):
            self._ball(j, r)

    def _ball(self, j: int, r: int) -> np.ndarray | None:
        """The lists of substring ``j`` within ``r``, made when first asked for."""
        if r < 0:
            return None
        if (j, r) not in self.balls:
            ball = np.zeros_like(self.lists[j])
            for x in np.unique(self._part(self.codes, j)):
                ball[self.near[x] <= r] |= self.lists[j][x]
            self.balls[j, r] = ball
        return self.balls[j, r]

    def _part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def probe(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, codes) bool: retrieved by some list and within the radius."""
        found = np.zeros((len(queries), (len(self.codes) + 7) // 8), np.uint8)
        for j, r in enumerate(substring_radii(radius, self.substrings)):
            if (ball := self._ball(j, r)) is not None:
                found |= ball[self._part(queries, j)]
        hit = np.unpackbits(found, axis=1, count=len(self.codes)).astype(bool)
        if hit.mean() > 0.1:
            hit &= np.bitwise_count(queries[:, None] ^ self.codes[None]) <= radius
        else:
            a, b = np.nonzero(hit)
            hit[a, b] = np.bitwise_count(queries[a] ^ self.codes[b]) <= radius
        return hit


def _best(hit: np.ndarray, qv: np.ndarray, xv: np.ndarray, xi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, cosine in steps) of the k best retrieved ones, best first for each query."""
    if hit.mean() > 0.01:
        s = np.where(hit, np.floor(qv @ xv.T * _STEP + 0.5), -4 * _STEP).astype(np.int64)
        n = min(k, len(xi))
        key = s * len(xi) + np.arange(len(xi))[::-1]  # of equal cosines the smaller id
        top = np.argpartition(-key, n - 1, axis=1)[:, :n]
        a, b = np.repeat(np.arange(len(s)), n), top.reshape(-1)
        s = s[a, b]
        a, b, s = a[s > -2 * _STEP], b[s > -2 * _STEP], s[s > -2 * _STEP]
    else:
        a, b = np.nonzero(hit)
        s = np.floor(np.einsum("ij,ij->i", qv[a], xv[b]) * _STEP + 0.5).astype(np.int64)
    o = np.lexsort((xi[b], -s, a))
    a, b, s = a[o], b[o], s[o]
    keep = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[keep], b[keep], s[keep]


def _search(width: int, coder: Coder, radii: np.ndarray, k: int):
    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"), "s": pd.Series([], dtype="int64")})
        if not len(q) or not len(x):
            return none
        xi, xv = _rows(width, x["ids"].iloc[0], x["v"].iloc[0])
        qi, qv = (np.concatenate(a) for a in zip(*[_rows(width, i, v) for i, v in zip(q["ids"], q["v"], strict=True)], strict=True))
        radius = int(radii[-1])
        index = Index(coder.codes(xv), radius)
        parts = []
        for i in range(0, len(qi), 512):
            v, own = qv[i : i + 512], qi[i : i + 512]
            codes = coder.codes(v)
            due, radius = np.full(len(v), int(radii[-1])), int(radii[-1])
            todo = np.arange(len(v))
            while len(todo):
                now = todo[due[todo] <= radius]
                if len(now):
                    hit = index.probe(codes[now], radius)
                    hit &= own[now, None] != xi[None]
                    a, b, s = _best(hit, v[now], xv, xi, k)
                    found = np.bincount(a, minlength=len(now))
                    worst = np.full(len(now), -4 * _STEP)
                    full = np.flatnonzero(found == k)
                    worst[full] = s[np.searchsorted(a, full, side="right") - 1]
                    due[now] = np.where(found == k, radii[band(worst)], radius + 1)
                    over = (due[now] <= radius) | (radius >= BITS)
                    sent = over[a]
                    parts.append((own[now[a[sent]]], xi[b[sent]], s[sent]))
                    todo = np.setdiff1d(todo, now[over])
                radius = min(BITS, radius + WIDEN)
        if not parts:
            return none
        return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(("id", "other", "s"))})

    return run


def _questions(width: int, step: int):
    """The queries of each packed block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, ids, raw in zip(frame["b"], frame["ids"], frame["v"], strict=True):
                i, v = _rows(width, ids, raw)
                mine = i % step == 0
                if mine.any():
                    yield pd.DataFrame({"b": np.array([b], np.int32), "ids": [i[mine].tobytes()], "v": [np.ascontiguousarray(v[mine]).tobytes()]})

    return run


def neighbours(
    items: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, radius: int | None = None, block_rows: int = BLOCK_ROWS,
    query_step: int = QUERY_STEP,
) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine) of the k nearest of every query; ids are integers.
    A given ``radius`` takes the place of the calibrated ones."""
    vectors = unit_vectors(items, id_col, vector)
    rows = vectors.count()
    schema = f"{id_col} long, rank int, neighbour_id long, cosine double"
    if rows < 2:
        return items.sparkSession.createDataFrame([], schema)
    width = len(vectors.first()["__v"]) // 4
    coder = fit(vectors, rows, width)
    blocks = -(-rows // block_rows)
    index = packed(vectors, blocks)
    discard(vectors)
    radii = calibrate(index, width, coder, k, query_step) if radius is None else np.full(BANDS + 1, radius)
    asked = -(-blocks // query_step)
    q = index.mapInPandas(_questions(width, query_step), "b int, ids binary, v binary").select(
        F.pmod(F.col("b"), F.lit(asked)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("xb"), "ids", "v"
    )
    x = index.select(F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("qb"), F.col("b").alias("xb"), "ids", "v")
    pairs = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb"))
    found = pairs.applyInPandas(_search(width, coder, radii, k), "id long, other long, s long")
    best = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("id").alias(id_col), "rank", F.col("other").alias("neighbour_id"), (F.col("s") / float(_STEP)).alias("cosine"))
    )
