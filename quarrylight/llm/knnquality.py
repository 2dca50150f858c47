"""Quality classifier by nearest-neighbour voting (operator 9).

Documents are bags of hashed character trigrams and a few shape terms, weighted by inverse
document frequencies counted over the whole corpus. A latent-semantic projection is fitted
on at most ``PER_LABEL`` labelled documents of each label; their vectors are broadcast (a
size that parameters bound). Every document is compared with all of them by exact blocked
cosine products, and the ``K`` nearest vote with their similarity as weight.

A labelled document does not vote on itself. Similarities are compared in steps of 1e-5,
of equal ones the smaller place in the sample wins.

Defined cases: a null or empty text has no neighbours and gets the labelled mean; without
any labels scores are null and everything is kept; repeated rows are scored each; of
several labels of a document the largest counts; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized
from .sampling import by_label
from .textkernel import chunks, span_hashes

BUCKETS = 2048
SHAPES = 6
SHAPE_WEIGHT = 4.0
TERMS = BUCKETS + SHAPES
DIMENSIONS = 64
PER_LABEL = 2000
K = 25
THRESHOLD = 0.5
ROWS = 1024


def term_counts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, TERMS) counts. Shape terms: doubled punctuation, symbols, upper-case pairs,
    digits, lone bars, and a word equal to the word before it."""
    n = len(bounds) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(buf) < 3:
        return out
    doc = np.repeat(np.arange(n), np.diff(bounds))
    c = buf.astype(np.uint32)
    h = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(0x9E3779B1)
    inside = doc[:-2] == doc[2:]
    h = (h >> np.uint32(21)).astype(np.int64)[inside]
    out[:, :BUCKETS] = np.bincount(doc[:-2][inside] * BUCKETS + h, minlength=n * BUCKETS).reshape(n, BUCKETS)

    def shape(k: int, at: np.ndarray) -> None:
        out[:, BUCKETS + k] = np.bincount(doc[at], minlength=n)

    pair = doc[:-1] == doc[1:]
    shape(0, np.flatnonzero((buf[:-1] == buf[1:]) & np.isin(buf[:-1], list(b"!?.;,")) & pair))
    shape(1, np.flatnonzero(np.isin(buf, list(b"#$%&*|@^~"))))
    up = (buf >= 65) & (buf <= 90)
    shape(2, np.flatnonzero(up[:-1] & up[1:] & pair))
    shape(3, np.flatnonzero((buf >= 48) & (buf <= 57)))
    shape(4, np.flatnonzero(buf == 124))
    # a word equal to the one before: equal lengths, and equal hashes
    space = (buf == 32) | (buf == 10)
    edge = np.flatnonzero(space | np.append(pair == False, False))  # noqa: E712
    size = np.diff(edge)
    i = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 1)) + 1
    if len(i):
        w, lag = edge[i] + 1, size[i]
        h = span_hashes(buf, w, w + lag - 1)
        same = h == span_hashes(buf, w - lag, w - 1)
        shape(5, w[same])
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log counts by inverse document frequency; a document without terms is zero."""
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of bounded text and, as every row has a dense vector, bounded rows."""
    for part, buf, bounds in chunks(batch, "__text", 1 << 20):
        for i in range(0, part.num_rows, ROWS):
            j = min(i + ROWS, part.num_rows)
            yield part.slice(i, j - i), buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, df = 0, np.zeros(TERMS, np.int64)
    for batch in batches:
        for part, buf, bounds in _parts(batch):
            df += (term_counts(buf, bounds) > 0).sum(axis=0)
            total += part.num_rows
    yield pa.record_batch([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(np.append(df, total))], names=["term", "n"])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that have each term, and all documents, counted over the whole table."""
    rows = docs.select(F.col(text).alias("__text")).mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    return df[:-1], int(df[-1])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, bounds in _parts(batch):
            c = term_counts(buf, bounds)
            yield pa.record_batch([part.column("__id"), part.column("__label"), pa.array([r.tobytes() for r in c], pa.binary())], names=["__id", "__label", "v"])


class Voters:
    """The labelled sample in the latent space."""

    def __init__(self, ids: list, labels: np.ndarray, counts: np.ndarray, df: np.ndarray, n: int) -> None:
        self.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
        self.idf[BUCKETS:] *= SHAPE_WEIGHT  # six terms against two thousand
        x = weigh(counts, self.idf).astype(np.float64)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32))
        self.vectors = self._unit(x.astype(np.float32) @ self.basis)
        self.labels = labels.astype(np.float64)
        self.place = {i: k for k, i in enumerate(ids)}
        self.mean = float(self.labels.mean())

    @staticmethod
    def _unit(y: np.ndarray) -> np.ndarray:
        norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return y / np.where(norm > 1e-6, norm, np.inf)

    def vote(self, counts: np.ndarray, ids: list, k: int = K) -> np.ndarray:
        q = self._unit(weigh(counts, self.idf).astype(np.float32) @ self.basis)
        steps = np.floor(q @ self.vectors.T * 100000 + 0.5).astype(np.int64)
        for row, i in enumerate(ids):
            if i in self.place:
                steps[row, self.place[i]] = 0
        m = len(self.labels)
        key = steps * m + np.arange(m)[::-1]
        k = min(k, m)
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(steps, top, axis=1), 0).astype(np.float64)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), self.mean)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Voters | None:
    """The voters: at most ``per_label`` documents of each label. None without labels."""
    one = labels.filter(F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("__y"))
    picked = by_label(one, id_col, "__y", per_label)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).filter("__text is not null").join(sized(picked), "__id")
    kind = rows.schema["__id"].dataType.simpleString()
    got = rows.mapInArrow(_vectors, f"__id {kind}, __label int, v binary").collect()
    by_id = {r["__id"]: r for r in sorted(got, key=lambda r: (r["__id"], r["v"]))}  # one row of repeated ids
    if not by_id:
        return None
    df, n = document_frequencies(docs, text)
    rows_ = [by_id[i] for i in sorted(by_id)]
    counts = np.stack([np.frombuffer(r["v"], np.float32) for r in rows_])
    return Voters([r["__id"] for r in rows_], np.array([r["__label"] for r in rows_]), counts, df, n)


def _score(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters: Voters = shared.value
        for batch in batches:
            for part, buf, bounds in _parts(batch):
                ids = part.column("__id")
                yield pa.record_batch([ids, pa.array(voters.vote(term_counts(buf, bounds), ids.to_pylist(), k))], names=["__id", "score"])

    return run


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = PER_LABEL,
    k: int = K,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, score, keep): score is the weighted share of neighbours labelled 1."""
    voters = fit(docs, labels, id_col, text, label, per_label)
    if voters is None:
        return docs.select(F.col(id_col), F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    d = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    out = d.mapInArrow(_score(shared, k), f"__id {d.schema['__id'].dataType.simpleString()}, score double")
    return out.select(F.col("__id").alias(id_col), "score", (F.col("score") >= threshold).alias("keep"))
