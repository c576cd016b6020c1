"""Toxic spans by a linear-chain conditional random field.

States: 0 clean, 1 toxic. A token's state scores come from hashed features of the
word, its prefixes and suffix and its neighbours; transitions are learned. The
forward-backward marginals give each token's probability of being toxic; a
document's score and its offending character offsets are taken from them.

Sequences are sentences, cut after SENTENCE tokens. For two states the messages
are kept as log odds, and all sentences of a chunk advance together.

Labelled tokens: ``label_tokens`` derives them from document labels. A feature is
marked if its share among toxic documents is too great for chance, and the tokens
of toxic documents that carry a marked feature are labelled toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col
from ._text import Words, chunks, mix64

#: The most labelled documents the field is fitted on: toxic and clean ones, drawn by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 4500
SENTENCE, SLOTS, EPOCHS, STEPS, RATE, DECAY, DAMP = 256, 1 << 18, 8, 64, 0.5, 1e-5, 0.1
#: Tokens at or above this marginal are offending.
THRESHOLD = 0.5
#: What a feature must show against chance to label tokens.
NATS = 12
_TEMPLATES = 6
_SALT = mix64(np.arange(1, _TEMPLATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Chain:
    """The tokens of a chunk in text order: features, and the first token of each sequence."""

    words: Words
    slots: np.ndarray
    first: np.ndarray
    marks: np.ndarray  # feature hashes that can carry a label


def tokens(b: np.ndarray, off: np.ndarray) -> Chain:
    """Tokens of a chunk of texts; no sequence crosses texts."""
    w = Words(b, off)
    n = len(w.hash)
    if not n:
        return Chain(w, np.zeros((_TEMPLATES, 0), np.int32), np.zeros(0, np.int64), np.zeros((3, 0), np.uint64))
    stop = (b == 46) | (b == 33) | (b == 63) | (b == 10)
    seen = np.concatenate(([0], np.cumsum(stop)))
    new = np.ones(n, bool)
    new[1:] = (w.doc[1:] != w.doc[:-1]) | (seen[w.starts[1:]] != seen[w.ends[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(n) - first[np.cumsum(new) - 1]
    new |= place % SENTENCE == 0
    first = np.flatnonzero(new)
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    pad = np.concatenate((w.folded, np.zeros(8, np.uint8)))
    size = w.ends - w.starts

    def affix(start: np.ndarray, k: int) -> np.ndarray:
        v = np.minimum(size, k).astype(np.uint64) << np.uint64(56)
        for i in range(k):
            v |= np.where(i < size, pad[start + i], 0).astype(np.uint64) << np.uint64(8 * i)
        return mix64(v ^ np.uint64((k * 0xD6E8FEB86659FD93) & (2**64 - 1)))

    zero = np.zeros(1, np.uint64)
    before = np.where(new, np.uint64(3), np.concatenate((zero, w.hash[:-1])))
    after = np.where(last, np.uint64(5), np.concatenate((w.hash[1:], zero)))
    four, five = affix(w.starts, 4), affix(w.starts, 5)
    raw = (w.hash, before, after, four, five, affix(np.maximum(w.ends - 3, w.starts), 3))
    slots = np.empty((_TEMPLATES, n), np.int32)
    for t, v in enumerate(raw):
        slots[t] = (mix64(v ^ _SALT[t]) >> np.uint64(46)).astype(np.int32)
    return Chain(w, slots, first, np.stack((w.hash, four, five)))


@dataclass
class Field:
    """Weights (template, slot) of state 1 against 0, the bias, and the 2 x 2 log transitions."""

    weight: np.ndarray
    bias: float
    move: np.ndarray

    def emission(self, slots: np.ndarray) -> np.ndarray:
        e = np.full(slots.shape[1], self.bias)
        for t in range(_TEMPLATES):
            e += self.weight[t][slots[t]]
        return e


def messages(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of state 1 at each token, given emissions and where sequences start."""
    n = len(e)
    fwd, bwd = np.array(e, float), np.zeros(n)
    if not n:
        return fwd, bwd
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    begin, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # sequences longer than t
    a = np.exp(move)
    for t in range(1, int(size[0])):
        at = begin[: live[t]] + t
        r = np.exp(np.clip(fwd[at - 1], -40, 40))
        fwd[at] = e[at] + np.log((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
    end = begin + size
    for t in range(1, int(size[0])):
        at = end[: live[t]] - 1 - t
        r = np.exp(np.clip(e[at + 1] + bwd[at + 1], -40, 40))
        bwd[at] = np.log((a[1, 0] + a[1, 1] * r) / (a[0, 0] + a[0, 1] * r))
    return fwd, bwd


def marginals(field: Field, chain: Chain) -> np.ndarray:
    """P(toxic) of each token given its whole sequence."""
    fwd, bwd = messages(field.emission(chain.slots), chain.first, field.move)
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -40, 40)))


def pair_marginals(e: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected transitions (2, 2) over all neighbouring tokens of the same sequence."""
    inner = np.ones(len(e), bool)
    inner[first] = False
    t = np.flatnonzero(inner)
    r, s = np.exp(np.clip(fwd[t - 1], -40, 40)), np.exp(np.clip(e[t] + bwd[t], -40, 40))
    a = np.exp(move)
    p = np.array([[np.full(len(t), a[0, 0]), a[0, 1] * s], [r * a[1, 0], r * a[1, 1] * s]])
    return (p / p.sum(axis=(0, 1))).sum(axis=2)


@dataclass
class Labelled:
    """What fitting needs of a chunk: slots, sequence starts and 0/1 token labels."""

    slots: np.ndarray
    first: np.ndarray
    y: np.ndarray


def fit(chains: list[Labelled], epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by AdaGrad, a chunk a step, STEPS at least; DAMP keeps features seen a few times from large weights."""
    epochs = max(epochs, -(-STEPS // max(len(chains), 1)))
    weight, grown = np.zeros((_TEMPLATES, SLOTS)), np.full((_TEMPLATES, SLOTS), DAMP)
    field = Field(weight, -2.0, np.zeros((2, 2)))
    grown_bias, grown_move = DAMP, np.full((2, 2), DAMP)
    for _ in range(epochs):
        for c in chains:
            n = len(c.y)
            if not n:
                continue
            e = field.emission(c.slots)
            fwd, bwd = messages(e, c.first, field.move)
            gap = c.y - 1 / (1 + np.exp(-np.clip(fwd + bwd, -40, 40)))
            for t in range(_TEMPLATES):
                g = np.bincount(c.slots[t], gap, SLOTS)
                some = np.flatnonzero(g)
                g = g[some] / 32 - DECAY * weight[t][some]
                grown[t][some] += g * g
                weight[t][some] += RATE * g / np.sqrt(grown[t][some])
            inner = np.ones(n, bool)
            inner[c.first] = False
            k = np.flatnonzero(inner)
            seen = np.bincount(2 * c.y[k - 1].astype(np.int64) + c.y[k].astype(np.int64), minlength=4).reshape(2, 2)
            g = (seen - pair_marginals(e, fwd, bwd, c.first, field.move)) / 32
            grown_move += g * g
            field.move += RATE * g / np.sqrt(grown_move)
            g = gap.sum() / 32
            grown_bias += g * g
            field.bias += RATE * g / np.sqrt(grown_bias)
    return Field(weight.astype(np.float32), field.bias, field.move)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def marked_features(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Hashes of words and prefixes that toxic documents hold far beyond chance.

    A toxic document counts for a feature only by an occurrence whose word before
    and whose word after are both new to the feature, so that copies of one
    document don't pass for many.
    """
    tox, clean = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    z = np.zeros(0, np.uint64)
    keys, counts, rows = [z], [np.zeros(0)], [np.zeros((4, 0), np.uint64)]
    for i, b, off in chunks(texts):
        c = tokens(b, off)
        h = c.words.hash
        before, after = np.concatenate((h[-1:], h[:-1])), np.concatenate((h[1:], h[:1]))
        bad = toxic[i + c.words.doc]
        for mark in c.marks:
            rows.append(np.stack((mark[bad], before[bad], after[bad], (i + c.words.doc[bad]).astype(np.uint64))))
            m, d = mark[~bad], c.words.doc[~bad]
            order = np.lexsort((d, m))
            at = _runs(m[order], d[order])
            m = m[order][at]
            at = _runs(m)
            keys.append(m[at])
            counts.append(np.diff(np.append(at, len(m))).astype(float))
    m, before, after, doc = np.concatenate(rows, axis=1)
    fresh = np.ones(len(m), bool)
    for other in (before, after):
        order = np.lexsort((other, m))  # stable: the earliest document first
        first = np.zeros(len(m), bool)
        first[order[_runs(m[order], other[order])]] = True
        fresh &= first
    m, doc = m[fresh], doc[fresh]
    order = np.lexsort((doc, m))
    m = m[order][_runs(m[order], doc[order])]
    at = _runs(m)
    known, t = m[at], np.diff(np.append(at, len(m))).astype(float)
    k = np.concatenate(keys)
    at = np.searchsorted(known, k)
    hit = known[np.minimum(at, max(len(known) - 1, 0))] == k if len(known) else np.zeros(len(k), bool)
    n = np.bincount(at[hit], np.concatenate(counts)[hit], len(known))
    # nats against chance, and a rate far above that among clean documents; with labels too few for that, three quarters of what they can show
    nats = np.log((tox + clean) / tox)
    need, least = (NATS, 4) if tox * nats >= 2 * NATS else (0.75 * tox * nats, 2)
    return known[(t * nats >= need) & (t >= least) & ((t + 0.5) / tox >= min(30.0, clean / 2) * (n + 0.5) / clean)]


def label_tokens(texts: pa.Array, toxic: np.ndarray) -> list[Labelled]:
    """Labelled chunks of texts: in toxic ones the tokens with a marked feature, in clean ones none."""
    marked, out = marked_features(texts, toxic), []
    for i, b, off in chunks(texts):
        c = tokens(b, off)
        y = np.isin(c.marks, marked).any(axis=0) & toxic[i + c.words.doc]
        out.append(Labelled(c.slots, c.first.astype(np.int32), y))
    return out


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN) -> Field | None:
    """Fit on at most ``most_toxic`` and ``most_clean`` labelled documents.

    ``labels`` has (doc_id, toxic); of several labels of an id the greatest counts. Null
    labels and labels other than 0 and 1 are none. None without both kinds, and where
    no word or prefix tells them apart: a single toxic document shows nothing.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = None
    for flag, most in ((1, most_toxic), (0, most_clean)):
        part = known.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.union(part)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null")
    got = rows.join(F.broadcast(pick), F.col("id") == F.col("doc_id"))  # at most most_toxic + most_clean rows
    got = got.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(most_toxic + most_clean).select("text", "toxic").toArrow()
    toxic = got.column("toxic").to_numpy() > 0
    if toxic.all() or not toxic.any():
        return None
    labelled = label_tokens(got.column("text").combine_chunks(), toxic)
    return fit(labelled) if any(c.y.any() for c in labelled) else None


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN) -> DataFrame:
    """(doc_id, score, toxic_tokens, is_toxic, spans) for every row.

    ``score`` is 1 - prod(1 - p) over the offending tokens, or without one the
    greatest marginal; ``toxic_tokens`` is the sum of marginals; ``spans`` lists
    (start, end, p) in characters, end exclusive, neighbours of one sentence
    joined, p their greatest marginal. Null, empty and wordless texts score 0
    with no spans, as does every text where no field can be fitted (see ``train``).
    Repeated rows and null ids are scored like others; an empty table gives an
    empty table.
    """
    field = field or train(docs, labels, id_col=id_col, text_col=text_col, most_toxic=most_toxic, most_clean=most_clean)
    kind = "struct<score:double,toxic_tokens:double,spans:array<struct<start:int,end:int,p:double>>>"
    if field is None:
        made = F.lit(None).cast(kind)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

        def run(text: pa.Array) -> pa.Array:
            return score_texts(sent.value, text, threshold)

        made = F.arrow_udf(run, kind)(col(text_col))
    out = docs.select(col(id_col).alias("doc_id"), made.alias("t"))
    return out.select(
        "doc_id", F.coalesce("t.score", F.lit(0.0)).alias("score"), F.coalesce("t.toxic_tokens", F.lit(0.0)).alias("toxic_tokens"),
        (F.coalesce("t.score", F.lit(0.0)) >= threshold).alias("is_toxic"),
        F.coalesce(F.col("t.spans"), F.array().cast("array<struct<start:int,end:int,p:double>>")).alias("spans"),
    )


def score_texts(field: Field, text: pa.Array, threshold: float = THRESHOLD) -> pa.Array:
    """The struct of ``toxicity`` for each text."""
    n = len(text)
    score, total, count = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    starts, ends, probs = [], [], []
    for i, b, off in chunks(text):
        c = tokens(b, off)
        if not len(c.first):
            continue
        p, w, m = marginals(field, c), c.words, len(off) - 1
        total[i : i + m] = np.bincount(w.doc, p, m)
        best = np.zeros(m)
        np.maximum.at(best, w.doc, p)
        bad = p >= threshold
        miss = np.bincount(w.doc[bad], np.log1p(-np.minimum(p[bad], 1 - 1e-12)), m)
        score[i : i + m] = np.where(miss < 0, -np.expm1(miss), best)
        at = np.flatnonzero(bad)
        if not len(at):
            continue
        opens = np.zeros(len(p), bool)
        opens[c.first] = True
        head = np.ones(len(at), bool)
        head[1:] = (at[1:] != at[:-1] + 1) | opens[at[1:]]
        h = np.flatnonzero(head)
        tail = np.append(h[1:], len(at)) - 1
        chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
        doc = w.doc[at[h]]
        base = chars[off[doc]]
        starts.append(chars[w.starts[at[h]]] - base)
        ends.append(chars[w.ends[at[tail]]] - base)
        probs.append(np.maximum.reduceat(p[at], h))
        count[i : i + m] = np.bincount(doc, minlength=m)
    join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
    spans = pa.StructArray.from_arrays([join(starts, np.int32), join(ends, np.int32), join(probs, float)], ["start", "end", "p"])
    edge = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(score), pa.array(total), pa.ListArray.from_arrays(edge, spans)], ["score", "toxic_tokens", "spans"])
