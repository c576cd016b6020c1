"""Quality by co-training: a text-content view and a page-metadata view teach each other, then score together.

Content view: logistic regression over FEATURES statistics of the whole text.
Metadata view: naive Bayes over language, source and the order of magnitude of the
stated length. Both are fitted from sums over all rows (gradients, Hessians and
counts of fixed size), never from a collected sample. In each round a view's
confident scores of unlabelled documents are labels of weight ``PSEUDO`` for the
other. A fifth of the labelled documents is held out; on it each view is
calibrated, and a two-term logistic regression combines the calibrated views.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import gram, product, solve
from ._spark import col, materialize
from ._text import Words, chunks, doc_terms, per_text

ROUNDS, WARM_UP, CONFIDENT, PSEUDO, RIDGE, HOLD_OUT = 3, 6, 0.97, 0.3, 1.0, 5
#: Documents scored under this are rejected.
KEEP = 0.5
FEATURES = 20
LANGS, SOURCES, ORDERS = 256, 4096, 24
_META = LANGS + SOURCES + ORDERS
_GRID, _SPAN = 64, 12.0  # the held-out histogram of the two views' logits

_UPPER, _ALPHA, _DIGIT, _SPACE, _MARK, _STOP = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_STOP[list(b".,;:?!")] = True


def content_features(text: pa.Array) -> np.ndarray:
    """(n, FEATURES) float32 of whole texts; an empty or null one has only the constant."""
    out = np.zeros((len(text), FEATURES), np.float32)
    for first, b, off in chunks(text):
        n = np.diff(off).astype(float)
        w = Words(b, off)
        edge = np.searchsorted(w.doc, np.arange(len(off)))
        words = np.diff(edge).astype(float)
        doc, _, count = doc_terms(w.doc, w.hash)
        distinct = np.diff(np.searchsorted(doc, np.arange(len(off)))).astype(float)
        top = np.zeros(len(n))
        np.maximum.at(top, doc, count)
        same = np.zeros(len(w.hash), bool)
        if len(w.hash) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        bare = np.zeros(len(w.hash), bool)  # words right before one or two marks
        if len(w.hash):
            after = b[np.minimum(w.ends, len(b) - 1)]
            bare = (_MARK[after] | (after == 33)) & (w.ends < off[w.doc + 1])
        upper_word = _UPPER[b[w.starts]] & _UPPER[b[np.maximum(w.ends - 1, 0)]] & (w.ends - w.starts > 1) if len(w.hash) else bare
        per = lambda m: per_text(m, off)
        on = lambda m: (lambda c: c[edge[1:]] - c[edge[:-1]])(np.concatenate(([0], np.cumsum(m))))
        c, v = np.maximum(n, 1), np.maximum(words, 1)
        letters, lines, stops = np.maximum(per(_ALPHA[b]), 1), per(b == 10), per(_STOP[b])
        cols = [
            np.ones(len(n)), np.log1p(n) / 10, np.log1p(words) / 8, np.minimum(n / v, 30) / 10, per(_UPPER[b]) / letters,
            per(_DIGIT[b]) / c, per(_SPACE[b]) / c, per(_MARK[b]) / c * 5, np.minimum(stops / v, 2), per(b == 33) / v,
            per(b == 124) / v, np.minimum(lines / v, 1), distinct / v, top / v, on(same) / v, on(bare) / v, on(upper_word) / v,
            np.sqrt(on(same) / v), np.sqrt(on(bare) / v), np.sqrt(on(upper_word) / v),
        ]
        x = np.stack(cols, axis=1)
        x[n == 0, 1:] = 0
        out[first : first + len(n)] = x
    return out


def meta_slots(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """(n, 3) slots of the metadata view; null is a value of its own."""
    def hashed(arr: pa.Array, size: int) -> np.ndarray:
        d = arr.cast(pa.string()).dictionary_encode()
        table = np.array([zlib.crc32(x.encode()) % (size - 1) + 1 if x is not None else 0 for x in d.dictionary.to_pylist()] + [0], np.int64)
        return table[np.nan_to_num(d.indices.to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)]

    size = np.nan_to_num(chars.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1)
    order = np.where(size < 0, 0, np.minimum(1 + np.log2(np.maximum(size, 1)).astype(np.int64), ORDERS - 1))
    return np.stack((hashed(lang, LANGS), LANGS + hashed(source, SOURCES), LANGS + SOURCES + order), axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of the content view, log odds of the metadata slots, and the calibrations."""

    content: np.ndarray
    meta: np.ndarray
    scale_content: tuple[float, float] = (1.0, 0.0)
    scale_meta: tuple[float, float] = (1.0, 0.0)
    combine: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def logits(self, x: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zc, zm = x @ self.content, self.meta[-1] + self.meta[slots].sum(axis=1)
        return self.scale_content[0] * zc + self.scale_content[1], self.scale_meta[0] * zm + self.scale_meta[1]

    def score(self, x: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zc, zm = self.logits(x, slots)
        return _sigmoid(zc), _sigmoid(zm), _sigmoid(self.combine[0] * zc + self.combine[1] * zm + self.combine[2])


def _newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int = 25) -> np.ndarray:
    w = start.astype(float)
    for _ in range(steps):
        p = _sigmoid(product(z, w))
        h = gram(z, weight * p * (1 - p)) + 1e-3 * np.eye(len(w))
        w = w + np.clip(solve(h, product(z.T, weight * (y - p)) - 1e-3 * (w - start)), -2, 2)
    return w


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip(((z / _SPAN + 1) / 2 * _GRID).astype(np.int64), 0, _GRID - 1)


def fit(features: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Co-train on (x, slots, y, fold): y is 0, 1 or null; None without labelled rows of both classes."""
    d, grid = FEATURES, _GRID * _GRID
    at_hess, at_count, at_hist = d, d + d * d, d + d * d + 2 * (_META + 1)

    def sums(model: Model, pseudo: bool) -> np.ndarray:
        def run(batches):
            total = np.zeros(at_hist + 2 * grid)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, d).astype(float)
                slots = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, 3).astype(np.int64)
                y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                held = (batch.column(3).to_numpy(zero_copy_only=False) == 0) & ~np.isnan(y)
                zc, zm = model.logits(x, slots)
                known = ~np.isnan(y) & ~held
                for_c, for_m = np.where(known, y, 0.0), np.where(known, y, 0.0)
                wc, wm = known.astype(float), known.astype(float)
                if pseudo:
                    pc, pm, none = _sigmoid(zc), _sigmoid(zm), np.isnan(y)
                    sure_m, sure_c = none & (np.abs(pm - 0.5) >= CONFIDENT - 0.5), none & (np.abs(pc - 0.5) >= CONFIDENT - 0.5)
                    for_c, wc = np.where(sure_m, pm > 0.5, for_c), np.where(sure_m, PSEUDO, wc)
                    for_m, wm = np.where(sure_c, pc > 0.5, for_m), np.where(sure_c, PSEUDO, wm)
                p = _sigmoid(x @ model.content)
                total[:d] += x.T @ (wc * (for_c - p))
                total[at_hess:at_count] += ((x * (wc * p * (1 - p))[:, None]).T @ x).ravel()
                for k in (0, 1):
                    s = wm * (for_m == k)
                    base = at_count + k * (_META + 1)
                    total[base : base + _META] += np.bincount(slots.ravel(), np.repeat(s, 3), _META)
                    total[base + _META] += s.sum()
                cell = at_hist + y[held].astype(np.int64) * grid + _bins(zc[held]) * _GRID + _bins(zm[held])
                total += np.bincount(cell, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["i", "v"])

        out = np.zeros(at_hist + 2 * grid)
        for i, v in features.select("x", "slots", "y", "fold").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v  # at most as many rows as there are sums
        return out

    def meta_of(s: np.ndarray) -> np.ndarray:
        neg, pos = (s[at_count + k * (_META + 1) : at_count + (k + 1) * (_META + 1)] for k in (0, 1))
        prior = np.log((pos[-1] + 1) / (neg[-1] + 1))
        # smoothed towards the prior, so that an unseen or rare value says nothing
        odds = np.log((pos[:-1] + 5 * (pos[-1] + 1) / (pos[-1] + neg[-1] + 2)) / (neg[:-1] + 5 * (neg[-1] + 1) / (pos[-1] + neg[-1] + 2)))
        return np.append(odds - prior, prior)

    def calibrated(model: Model, s: np.ndarray) -> Model:
        hist = s[at_hist:].reshape(2, _GRID, _GRID)
        mid = ((np.arange(_GRID) + 0.5) / _GRID * 2 - 1) * _SPAN
        if not (hist[0].any() and hist[1].any()):
            return model
        zc, zm = np.repeat(mid, _GRID), np.tile(mid, _GRID)
        z, y, w = np.tile(np.stack((zc, zm, np.ones(grid)), axis=1), (2, 1)), np.repeat([0.0, 1.0], grid), hist.reshape(-1)
        use = w > 0
        z, y, w = z[use], y[use], w[use]
        a = _newton(z[:, [0, 2]], y, w, np.array([1.0, 0.0]))
        b = _newton(z[:, [1, 2]], y, w, np.array([1.0, 0.0]))
        sc, sm = model.scale_content, model.scale_meta
        sc, sm = (a[0] * sc[0], a[0] * sc[1] + a[1]), (b[0] * sm[0], b[0] * sm[1] + b[1])
        both = np.stack((a[0] * z[:, 0] + a[1], b[0] * z[:, 1] + b[1], np.ones(len(z))), axis=1)
        return Model(model.content, model.meta, sc, sm, tuple(_newton(both, y, w, np.array([1.0, 0.0, 0.0]))))

    def stepped(model: Model, s: np.ndarray) -> np.ndarray:
        ridge = RIDGE * np.eye(d)
        ridge[0, 0] = 1e-6
        move = solve(s[at_hess:at_count].reshape(d, d) + ridge, s[:d] - product(ridge, model.content))
        return model.content + move * min(1.0, 10 / max(np.abs(move).max(), 1e-9))

    model = Model(np.zeros(d), np.zeros(_META + 1))
    for k in range(WARM_UP):
        s = sums(model, False)
        neg, pos = s[at_count + _META], s[at_count + 2 * _META + 1]
        if not (neg and pos):
            return None
        model = Model(stepped(model, s), meta_of(s))
    for k in range(rounds):
        model = calibrated(Model(model.content, model.meta), sums(Model(model.content, model.meta), False))
        s = sums(model, True)
        # one Newton step from a warm start with the other view's labels, and new counts with this view's
        model = Model(stepped(model, s), meta_of(s))
    return calibrated(model, sums(model, False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars") -> Model | None:
    """Co-train over all ``docs`` with ``labels`` (doc_id, quality); of several labels of an id the least counts, null ones and those other than 0 and 1 are none."""
    def vector(text: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(text) + 1, dtype=np.int32) * FEATURES, content_features(text).ravel())

    def slots(lang: pa.Array, source: pa.Array, chars: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(lang) + 1, dtype=np.int32) * 3, meta_slots(lang, source, chars).ravel().astype(np.int32))

    y = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    f = docs.select(
        col(id_col).alias("id"), F.arrow_udf(vector, "array<float>")(col(text_col)).alias("x"),
        F.arrow_udf(slots, "array<int>")(col(lang_col).cast("string"), col(source_col).cast("string"), col(chars_col).cast("double")).alias("slots"),
    )
    f = f.join(y, F.col("id") == F.col("doc_id"), "left").select("x", "slots", "y", F.pmod(F.xxhash64("id"), F.lit(HOLD_OUT)).cast("int").alias("fold"))
    return fit(materialize(f, "views"))


def scored(docs: DataFrame, model: Model | None, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars"):
    """The column STRUCT<content, meta, score> over the columns of ``docs``; all null without a model."""
    if model is None:
        return F.lit(None).cast("struct<content:double,meta:double,score:double>")

    def run(text: pa.Array, lang: pa.Array, source: pa.Array, chars: pa.Array) -> pa.Array:
        parts = model.score(content_features(text).astype(float), meta_slots(lang, source, chars))
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], ["content", "meta", "score"])

    made = F.arrow_udf(run, "struct<content:double,meta:double,score:double>")
    return made(col(text_col), col(lang_col).cast("string"), col(source_col).cast("string"), col(chars_col).cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(doc_id, p_content, p_meta, p_quality, keep) for every row, repeated ones and null ids too.

    Nulls in metadata are values of their own; a null or empty text has no
    content but the constant. Without labels of both classes the scores are null
    and everything is kept. An empty table gives an empty table.
    """
    s = scored(docs, train(docs, labels, id_col=id_col, **columns), **columns)
    out = docs.select(col(id_col).alias("doc_id"), s.alias("s"))
    return out.select(
        "doc_id", F.col("s.content").alias("p_content"), F.col("s.meta").alias("p_meta"), F.col("s.score").alias("p_quality"),
        F.coalesce(F.col("s.score") >= KEEP, F.lit(True)).alias("keep"),
    )


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The documents that are not rejected, columns unchanged; see quality_scores."""
    s = scored(docs, train(docs, labels, id_col=id_col, **columns), **columns)
    return docs.where(F.coalesce(s.getField("score") >= KEEP, F.lit(True)))
