"""Language identification of spans (operator 3).

The script of a word (by ranges of its characters) narrows the languages it may be in. Each
word is scored per language by its character trigrams; Viterbi decoding over the words of a
document with a penalty for every switch gives its spans.

Trigram scores are trained on at most ``PER_LANGUAGE`` labelled documents of each language
(whole texts). Scripts that no trained language uses stand for one language each.

Defined cases: a null or empty text, or one without words, gives one span 'und' with no
words over the whole text; words without letters are neutral and take the language around
them; of equal scores the earlier language in order of name wins, and staying is preferred to
switching; repeated rows are labelled each; an empty table gives an empty result. Offsets
are in characters, from a span's first word to the end of its last. Other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized
from .sampling import by_label
from .textkernel import chunks, fold, spans

PER_LANGUAGE = 400
PENALTY = 12.0
TABLE_BITS = 16
_NEVER = -1e6

#: (name, language it stands for if no trained language uses it)
SCRIPTS = [
    ("none", ""), ("latin", "und"), ("greek", "el"), ("cyrillic", "ru"), ("armenian", "hy"), ("hebrew", "he"), ("arabic", "ar"),
    ("devanagari", "hi"), ("thai", "th"), ("georgian", "ka"), ("kana", "ja"), ("han", "zh"), ("hangul", "ko"), ("other", "und"),
]
_CODE = {name: i for i, (name, _) in enumerate(SCRIPTS)}


def _script_tables() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Script by lead byte, and by second byte for the lead bytes that need it."""
    lead = np.zeros(256, np.uint8)
    lead[ord("a") : ord("z") + 1] = lead[ord("A") : ord("Z") + 1] = _CODE["latin"]
    for lo, hi, name in [
        (0xC3, 0xCC, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD4, 0xD5, "armenian"), (0xD6, 0xD7, "hebrew"),
        (0xD8, 0xDB, "arabic"), (0xDC, 0xE2, "other"), (0xE3, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xEE, 0xEF, "other"), (0xF0, 0xF0, "han"),
    ]:
        lead[lo : hi + 1] = _CODE[name]
    second: dict[int, np.ndarray] = {}
    for at, base, parts in [
        (0xE0, "other", [(0xA4, 0xA5, "devanagari"), (0xB8, 0xB9, "thai")]),
        (0xE1, "other", [(0x82, 0x83, "georgian"), (0xB8, 0xBB, "latin"), (0xBC, 0xBF, "greek"), (0x84, 0x87, "hangul")]),
        (0xE3, "han", [(0x81, 0x83, "kana")]),
        (0xF0, "other", [(0xA0, 0xAF, "han")]),
    ]:
        t = np.full(256, _CODE[base], np.uint8)
        for lo, hi, name in parts:
            t[lo : hi + 1] = _CODE[name]
        second[at] = t
    return lead, second


_LEAD, _SECOND = _script_tables()


def word_scripts(buf: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Script of each word (runs starting at s): the last one, in the order of SCRIPTS, of its characters."""
    c = _LEAD[buf]
    for at, t in _SECOND.items():
        i = np.flatnonzero(buf[:-1] == at)
        c[i] = t[buf[i + 1]]
    return np.maximum.reduceat(c, s) if len(s) else np.zeros(0, np.uint8)


def trigrams(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all words, bounds of the words in them). A word of n bytes has
    n + 1 trigrams: what is outside of it counts as a space."""
    n = e - s + 1
    ends = np.cumsum(n)
    first = ends - n
    lo, hi = (int(s[0]), int(e[-1]) + 1) if len(s) else (0, 0)
    pad = np.append(b[lo : min(hi, len(b))], np.uint8(32))
    idx = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(s - lo - first, n)
    c0 = pad[idx]
    del idx
    c0[ends - 1] = 32
    c1 = np.concatenate([[np.uint8(32)], c0[:-1]])
    c1[first] = 32
    c2 = np.concatenate([[np.uint8(32)], c1[:-1]])
    c2[first] = 32
    h = ((c2.astype(np.uint32) << np.uint32(16)) | (c1.astype(np.uint32) << np.uint32(8)) | c0) * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - TABLE_BITS), first


@dataclass
class Model:
    languages: list[str]  # the trained ones first, then those that only a script stands for
    scores: np.ndarray  # (trained languages, 2 ** TABLE_BITS)
    allowed: np.ndarray  # (scripts, languages)


def train(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows."""
    names = sorted({lang for _, lang in rows})
    counts = np.zeros((len(names), 1 << TABLE_BITS))
    used = np.zeros((len(SCRIPTS), len(names)))
    for text, lang in rows:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        b = fold(raw)
        s, e = spans(b != 32, np.array([0, len(raw)]))
        if len(s):
            k = names.index(lang)
            counts[k] += np.bincount(trigrams(b, s, e)[0], minlength=1 << TABLE_BITS)
            used[:, k] += np.bincount(word_scripts(raw, s), minlength=len(SCRIPTS))
    logp = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << TABLE_BITS)))
    scores = (logp - logp.mean(axis=0)).astype(np.float32) if names else np.zeros((0, 1 << TABLE_BITS), np.float32)
    share = used / np.maximum(used[1:].sum(axis=0), 1)
    allowed = share >= 0.02
    for i, (_, lang) in enumerate(SCRIPTS):
        if i and not allowed[i].any():
            if lang not in names:
                names.append(lang)
                allowed = np.hstack([allowed, np.zeros((len(SCRIPTS), 1), bool)])
            allowed[i, names.index(lang)] = True
    allowed[0] = True
    return Model(names, np.ascontiguousarray(scores), allowed)


#: Trigrams that are looked up at once: bounds the memory of one very long text.
_AT_ONCE = 1 << 20


def word_scores(m: Model, buf: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(words, languages) float32; impossible languages have a very low score. Languages that
    only a script stands for score 0 and are not in the table. Words are looked up in runs of
    about ``_AT_ONCE`` trigrams, one language after the other."""
    out = np.zeros((len(s), len(m.languages)), np.float32)
    if not len(s):
        return out
    upto = np.cumsum(e - s + 1)
    i = 0
    while i < len(s):
        before = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + _AT_ONCE, side="right")))
        h, first = trigrams(b, s[i:j], e[i:j])
        for k, table in enumerate(m.scores):
            out[i:j, k] = np.add.reduceat(table[h], first)
        i = j
    script = word_scripts(buf, s)
    out[script == 0] = 0
    out[~m.allowed[script]] = _NEVER
    return out


def viterbi(score: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word; documents are decoded side by side, word by word."""
    n = np.diff(bounds)
    state = np.zeros(len(score), np.int64)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return state
    start, size = bounds[:-1][order], n[order]
    steps = int(size[0])
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # documents longer than t
    v = score[start].astype(np.float64)
    stays, tops = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    for t in range(1, steps):
        k = alive[t]
        x = v[:k]
        top = x.argmax(axis=1)
        best = x[np.arange(k), top] - penalty
        stay = x >= best[:, None]
        v[:k] = np.where(stay, x, best[:, None]) + score[start[:k] + t]
        stays[start[:k] + t] = stay
        tops[start[:k] + t] = top
    now = v.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        state[start[:k] + t] = now[:k]
        if t:
            i = start[:k] + t
            now[:k] = np.where(stays[i, now[:k]], now[:k], tops[i])
    return state


def _label(shared, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part, buf, bounds in chunks(batch, "__text", 1 << 20):
                b = fold(buf)
                s, e = spans(b != 32, bounds)
                wb = np.searchsorted(s, bounds)
                state = viterbi(word_scores(m, buf, b, s, e), wb, penalty)
                doc = np.repeat(np.arange(len(wb) - 1), np.diff(wb))
                new = np.ones(len(s), bool)
                new[1:] = (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])
                i = np.flatnonzero(new)
                j = np.append(i[1:], len(s))
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                bare = np.flatnonzero(np.diff(wb) == 0)
                d = np.concatenate([doc[i], bare])
                lo = np.concatenate([chars[s[i]], chars[bounds[bare]]]) - chars[bounds[d]]
                hi = np.concatenate([chars[e[j - 1]], chars[bounds[bare + 1]]]) - chars[bounds[d]]
                o = np.lexsort((lo, d))
                d = d[o]
                within = np.arange(len(d)) - np.searchsorted(d, d, side="left")
                lang = names[np.concatenate([state[i], np.full(len(bare), len(m.languages))])[o]]
                yield pa.record_batch(
                    [
                        part.column("__id").take(pa.array(d)),
                        pa.array(within.astype(np.int32)),
                        pa.array(lo[o]),
                        pa.array(hi[o]),
                        pa.array(lang, pa.string()),
                        pa.array(np.concatenate([j - i, np.zeros(len(bare), np.int64)])[o]),
                    ],
                    names=["__id", "span", "start", "end", "lang", "n_words"],
                )

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on a bounded sample: ``per_language`` labelled documents of each language."""
    picked = by_label(docs, id_col, lang, per_language)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("t")).filter("t is not null").join(sized(picked), "__id")
    return train(sorted((r["t"], r["__label"]) for r in texts.select("t", "__label").collect()))


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, span, start, end, lang, n_words), the spans of each document numbered from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by TABLE_BITS and the languages
    d = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    kind = d.schema["__id"].dataType.simpleString()
    out = d.mapInArrow(_label(shared, penalty), f"__id {kind}, span int, start long, end long, lang string, n_words long")
    return out.withColumnRenamed("__id", id_col)
