"""SimHash near-dedup over a positional byte index with count filtering; no pair that qualifies is left out.

A document's signature has 256 sign bits: each distinct word adds its 256 hash
bits as +-1, weighted by the square root of its count. Long texts of one language
share the common words that make up a signature, whatever they say, so a text also
has a sketch: for each of SKETCH seeded orders one byte of its least run of SHINGLE
words. The share of equal bytes estimates the Jaccard similarity of the runs. Two
texts are near duplicates if their signatures differ in at most ``max_bits`` bits
and their sketches agree in AGREE bytes at least, about a quarter. Texts of the same
words in another order are therefore no near duplicates.

Index: the SKETCH positions are dealt into AGREE - 1 sets, so AGREE equal bytes, the
guaranteed minimum, have two in one set. A posting list for each two positions of one
set, 58 in all, holds the signatures that agree in both bytes, 16 bits; every pair
that qualifies meets in a list. Inside a list pairs are verified by Hamming distance
and by tallying the bytes they share. A long list emits a spanning forest of its
verified pairs, which has the same components as all of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, components, free, materialize, small
from ._text import Words, chunks, doc_terms, mix64

BITS = 256
SHINGLE, SKETCH, AGREE = 3, 32, 8
#: Lists up to SHORT are compared pair by pair, PAIRS pairs at once.
SHORT, PAIRS = 32, 1 << 16
_SEEDS = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(arr: pa.Array) -> np.ndarray:
    """(n, 4) uint64; rows of texts without a word are 0."""
    return signatures_and_sketches(arr)[:, :4]


def sketches(w: Words, n: int) -> np.ndarray:
    """(n, SKETCH) uint8 of a chunk of n texts; the last runs of a text are shorter, so short texts have some too."""
    out = np.zeros((n, SKETCH), np.uint8)
    if not len(w.doc):
        return out
    run = w.hash
    for k in range(1, SHINGLE):
        run = mix64(run)
        run[:-k] += np.where(w.doc[k:] == w.doc[:-k], w.hash[k:], np.uint64(0))
    run = mix64(run)
    at = np.flatnonzero(np.concatenate(([True], w.doc[1:] != w.doc[:-1])))
    for i, order in enumerate(_ORDERS):
        out[w.doc[at], i] = mix64(np.minimum.reduceat(run * order, at)) & np.uint64(255)
    return out


def signatures_and_sketches(arr: pa.Array) -> np.ndarray:
    """(n, 8) uint64: the signature, then the sketch."""
    out = np.zeros((len(arr), 8), np.uint64)
    for first, b, off in chunks(arr):
        w = Words(b, off)
        out[first : first + len(off) - 1, 4:] = sketches(w, len(off) - 1).view(np.uint64)
        doc, term, count = doc_terms(w.doc, w.hash)
        weight = np.sqrt(count).astype(np.float32)
        edge = np.searchsorted(doc, np.arange(len(off)))
        # whole texts, about 16k terms at a time
        i = 0
        while i < len(off) - 1:
            j = min(max(int(np.searchsorted(edge, edge[i] + 16384, "right")) - 1, i + 1), len(off) - 1)
            lo, hi = edge[i], edge[j]
            if hi > lo:
                h = mix64(term[lo:hi, None] * np.uint64(2) + np.uint64(1) ^ _SEEDS)
                bits = np.unpackbits(h.view(np.uint8), axis=1).astype(np.float32)
                sums = np.zeros((j - i, BITS), np.float32)
                for d in range(i, j):
                    s, t = edge[d] - lo, edge[d + 1] - lo
                    if t > s:
                        sums[d - i] = weight[edge[d] : edge[d + 1]] @ bits[s:t] * 2 - weight[edge[d] : edge[d + 1]].sum()
                out[first + i : first + j, :4] = np.packbits(sums > 0, axis=1).view(np.uint64)
            i = j
    return out


def key_positions() -> list[tuple[int, ...]]:
    """Two positions of a sketch each, so that any AGREE positions hold one of them."""
    return [two for part in np.array_split(np.arange(SKETCH), AGREE - 1) for two in combinations(part.tolist(), 2)]


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which rows of a and b are within ``max_bits`` and share enough bytes of their sketches.

    Rows are signatures, or signatures and sketches.
    """
    ok = np.bitwise_count(a[:, :4] ^ b[..., :4]).sum(1, dtype=np.int64) <= max_bits
    if a.shape[1] > 4 and ok.any():
        left, right = np.broadcast_arrays(a[:, 4:], b[..., 4:])
        ok[ok] = ((left[ok] ^ right[ok]).view(np.uint8) == 0).sum(1) >= AGREE
    return ok


def _forest(sid: np.ndarray, sig: np.ndarray, key: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each run of one key, what its verified pairs connect."""
    order = np.argsort(key, kind="stable")
    sid, sig, key = sid[order], sig[order], key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(at, len(key)))
    us, vs = [], []

    # short lists: each row with those after it in its list, many lists at once
    end = np.repeat(at + size, size)
    row = np.flatnonzero(np.repeat(size <= SHORT, size))
    after = end[row] - row - 1
    total = np.cumsum(after)
    for k in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        i, j = np.searchsorted(total, (k, k + PAIRS), "right")
        a = np.repeat(row[i:j], after[i:j])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[i:j]) - after[i:j], after[i:j])
        ok = _close(sig[a], sig[b], max_bits)
        us.append(sid[a[ok]])
        vs.append(sid[b[ok]])
    for s, n in zip(at[size > SHORT], size[size > SHORT]):  # long lists: rows close to none go many at once, from others breadth first
        left = np.arange(s, s + n)
        while len(left):
            head = left[: max(1, min(64, PAIRS // len(left)))]
            met = _close(np.repeat(sig[head], len(left), axis=0), np.tile(sig[left], (len(head), 1)), max_bits).reshape(len(head), -1).sum(1) > 1
            left = np.concatenate((head[met], left[len(head) :]))  # in order; a row is close to itself
            for x in head[met]:
                i = np.searchsorted(left, x)
                if i == len(left) or left[i] != x:
                    continue
                queue, left = [x], np.delete(left, i)
                while queue and len(left):
                    x = queue.pop()
                    ok = _close(sig[left], sig[x], max_bits)
                    if ok.any():
                        got, left = left[ok], left[~ok]
                        us.append(np.full(len(got), sid[x]))
                        vs.append(sid[got])
                        queue.extend(got)
    z = [np.zeros(0, np.int64)]
    return np.concatenate(us + z), np.concatenate(vs + z)


def similar_edges(sigs: DataFrame, max_bits: int = 44, count: int | None = None, width: int = 4) -> DataFrame:
    """Edges (u, v) over distinct signatures (sid BIGINT, sig BINARY) whose components are those of all pairs that qualify.

    ``width`` is the length of ``sig`` in 8-byte words: 8 with sketches, or 4. Without
    sketches there is nothing to index by: one task compares all pairs.
    """
    picks = key_positions() if width > 4 else [()]
    # a bucket holds about 64k postings, whatever the size of the corpus
    per_table = max(1, (sigs.count() if count is None else count) // 65536)
    mult = np.uint64(0x9E3779B97F4A7C15)

    def post(batches):
        for batch in batches:
            sid = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(sid):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, width)
            sketch = np.ascontiguousarray(sig[:, 4:]).view(np.uint8)
            rows = np.concatenate((sid.view(np.uint64)[:, None], sig), axis=1)
            for t, pick in enumerate(picks):
                bucket, blob = [], []
                key = _pack(sketch[:, pick])
                part = (((key * mult) >> np.uint64(33)) % np.uint64(per_table)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(per_table + 1)) if per_table > 1 else np.array([0, len(part)])
                for p in np.flatnonzero(np.diff(edge)):
                    bucket.append(t * per_table + p)
                    blob.append(rows[order[edge[p] : edge[p + 1]]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "rows"])

    def compare(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(pdf["rows"]), np.uint64).reshape(-1, width + 1)
        sid, sig = np.ascontiguousarray(rows[:, 0]).view(np.int64), np.ascontiguousarray(rows[:, 1:])
        key = _pack(np.ascontiguousarray(sig[:, 4:]).view(np.uint8)[:, picks[int(keys[0]) // per_table]])
        u, v = _forest(sid, sig, key, max_bits)
        e = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), axis=1), axis=0)
        return pd.DataFrame({"u": e[:, 0], "v": e[:, 1]})

    return sigs.select("sid", "sig").mapInArrow(post, "bucket bigint, rows binary").groupBy("bucket").applyInPandas(compare, "u bigint, v bigint")


def _pack(byte: np.ndarray) -> np.ndarray:
    key = np.zeros(len(byte), np.uint64)
    for k in range(byte.shape[1]):
        key = (key << np.uint64(8)) | byte[:, k].astype(np.uint64)
    return key


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 44) -> DataFrame:
    """(id, th, rows, root, keep) for every row key (id, hash of text) of a near-duplicate group of two rows or more.

    ``keep`` marks the row key with the least id of its group, ``rows`` how many rows have that key.
    """
    make = F.arrow_udf(_sig_udf, "binary")
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"), make(col(text_col)).alias("sig"))
    rows = materialize(rows.where("id is not null and sig is not null"), "signatures")
    keys = rows.groupBy("sig", "id", "th").agg(F.count("*").alias("rows"))
    sigs = keys.groupBy("sig").agg(F.sum("rows").alias("n")).withColumn("sid", F.monotonically_increasing_id())
    sigs = materialize(sigs, "distinct-signatures")
    comp = materialize(components(similar_edges(sigs, max_bits, width=8)), "components")
    # groups: joined signatures, and single ones that several rows have
    of = keys.join(sigs, "sig").join(comp.withColumnRenamed("node", "sid"), "sid", "left")
    of = of.where("root is not null or n > 1").select("id", "th", "rows", F.coalesce("root", "sid").alias("root"))
    of = materialize(of, "members")
    best = of.groupBy("root").agg(F.min(F.struct("id", "th")).alias("best"))
    return of.join(best, "root").select("id", "th", "rows", "root", (F.struct("id", "th") == F.col("best")).alias("keep"))


def _sig_udf(text: pa.Array) -> pa.Array:
    sig = signatures_and_sketches(text)
    some = sig[:, :4].any(axis=1)
    offsets = np.zeros(len(sig) + 1, np.int32)
    np.cumsum(np.where(some, 64, 0), out=offsets[1:])
    body = np.ascontiguousarray(sig[some]).tobytes()
    valid = pa.py_buffer(np.packbits(some, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sig), [valid, pa.py_buffer(offsets), pa.py_buffer(body)])


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 44) -> DataFrame:
    """The documents without near duplicates: of each group the row with the least id stays. Columns are unchanged.

    Groups are connected components of pairs close in signature and in shingles. Texts without a word (null, empty, only
    punctuation) and rows with a null id are no one's duplicates and stay.
    Repeated rows count as duplicates: one stays, that with the least JSON. Rows outside groups pass
    through without a shuffle. An empty table gives an empty table.
    """
    groups = materialize(
        near_groups(docs, id_col=id_col, text_col=text_col, max_bits=max_bits).select("id", "th", "keep", "rows"), "groups"
    )
    n = groups.count()
    g_id, g_th, g_keep, g_rows, th = free(docs, "gid", "gth", "keep", "rows", "th")
    marks = groups.toDF(g_id, g_th, g_keep, g_rows)
    joined = docs.withColumn(th, F.xxhash64(col(text_col)))
    joined = joined.join(small(marks, n), (col(id_col) == F.col(g_id)) & (F.col(th) == F.col(g_th)), "left")
    stay = F.coalesce(F.col(g_keep), F.lit(True))
    once = joined.where(stay & (F.coalesce(F.col(g_rows), F.lit(1)) == 1))
    again = joined.where(F.col(g_keep) & (F.col(g_rows) > 1))
    out = [col(c) for c in docs.columns]
    first = again.groupBy(g_id, g_th).agg(F.min_by(F.struct(*out), F.to_json(F.struct(*out))).alias(g_keep))
    return once.select(*out).union(first.select(*[F.col(g_keep).getField(c).alias(c) for c in docs.columns]))
