"""Embedding near-dedup by comparing all pairs of vectors; no pair at or over the threshold is left out.

Rows of equal vectors are linked first and searched as one. The others are dealt into
blocks by a hash of their id, and a task for each two blocks compares their vectors
by cosine, as matrix products. How many blocks there are decides what a task does,
not what is found. The verified pairs are united into groups.

A vector travels as one signed byte an element, with the length of the error that
makes. Cosines are therefore known to within the errors of both sides: pairs surely
at or over the threshold are edges, pairs within the error are compared once more on
the vectors themselves. A task emits a spanning forest of its sure pairs, which joins
the same vectors as all of them, and every unsure pair that the forest doesn't join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, components, materialize, small
from ._text import mix64

THRESHOLD = 0.95
#: A block has at most BLOCK_BYTES elements, and about BLOCK_ROWS vectors as long as there are fewer than BLOCKS blocks.
BLOCK_BYTES, BLOCK_ROWS, BLOCKS = 1 << 23, 2048, 8
#: Vectors of either side of a matrix product.
TILE = 1024


def unit(batch: pa.Array) -> np.ndarray:
    """Unit vectors of a list array of one size without nulls; of any length that a float can tell."""
    x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1), np.float32)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.float32(1e-45))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _vector_keys(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell vectors apart."""
    if not len(vec):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vec), -1)
    bits = (x + np.float32(0)).view(np.uint32).astype(np.uint64)  # no negative zero
    odd = np.random.Generator(np.random.PCG64(17)).integers(0, 2**63, (2, x.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return tuple(mix64((mix64(bits + k) * o).sum(axis=1, dtype=np.uint64)).view(np.int64) for k, o in zip(odd[:, 0], odd))


def _record(size: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("error", "<f4"), ("q", "i1", (size,))])


def rounded(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Records of unit vectors: one byte an element, and the length of the error, rounded up."""
    out = np.zeros(len(x), _record(x.shape[1]))
    out["id"] = ids
    out["q"] = np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30)))
    out["error"] = np.linalg.norm(x - restored(out), axis=1) * 1.001 + 1e-6
    return out


def restored(records: np.ndarray) -> np.ndarray:
    """The unit vectors that the bytes stand for."""
    q = records["q"].astype(np.float32)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)


class Pairs:
    """Edges found among the records of two blocks: sure ones, and those to be compared on the vectors themselves."""

    def __init__(self, records: np.ndarray, threshold: float):
        self.ids, self.x, self.error, self.threshold = records["id"], restored(records), records["error"], threshold
        self.parent = np.arange(len(records))
        self.sure: list[np.ndarray] = []
        self.unsure: list[np.ndarray] = []

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[at] = r
        return r

    def apart(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that the forest doesn't join yet."""
        open_ = self.roots(a) != self.roots(b)
        return a[open_], b[open_]

    def tile(self, a: slice, b: slice) -> None:
        """Each of a with each of b; of one slice with itself, each two once."""
        cos = self.x[a] @ self.x[b].T
        ea, eb = float(self.error[a].max()), float(self.error[b].max())
        band = ea + eb + ea * eb + 1e-6
        i, j = np.divmod(np.flatnonzero(cos >= self.threshold - band), cos.shape[1])
        if a == b:
            i, j = i[i < j], j[i < j]
        surely = cos[i, j] >= self.threshold + band
        i, j = i + a.start, j + b.start
        left, right = self.apart(i[surely], j[surely])
        edge = np.flatnonzero(np.diff(left, prepend=-1, append=-1)) if len(left) else left
        for s, e in zip(edge[:-1], edge[1:]):  # a row, and what it is close to
            root, first = np.unique(self.roots(right[s:e]), return_index=True)
            own = self.roots(left[s : s + 1])[0]
            other = root != own
            self.parent[root[other]] = own
            if other.any():
                self.sure.append(np.stack((np.full(other.sum(), left[s]), right[s:e][first[other]])))
        self.unsure.append(np.stack(self.apart(i[~surely], j[~surely])))

    def found(self) -> pd.DataFrame:
        none = [np.zeros((2, 0), np.int64)]
        sure, unsure = np.concatenate(none + self.sure, axis=1), np.concatenate(none + self.unsure, axis=1)
        unsure = np.stack(self.apart(*unsure))  # as the whole forest joins them
        e = self.ids[np.concatenate((sure, unsure), axis=1)]
        return pd.DataFrame({"u": e.max(axis=0), "v": e.min(axis=0), "sure": np.arange(e.shape[1]) < sure.shape[1]})


def compare_blocks(one: np.ndarray, two: np.ndarray | None, threshold: float, tile: int = TILE) -> pd.DataFrame:
    """(u, v, sure) of the records of one block with those of another, or with each other."""
    pairs = Pairs(one if two is None else np.concatenate((one, two)), threshold)
    n = len(pairs.ids)
    for s in range(0, len(one), tile):
        for t in range(s if two is None else len(one), n, tile):
            pairs.tile(slice(s, min(s + tile, len(one))), slice(t, min(t + tile, n)))
    return pairs.found()


def similar_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """Edges (u, v, sure) over (id BIGINT, vec ARRAY<FLOAT>) of one size: the sure ones, and those still to be compared on the vectors.

    ``blocks`` is in how many parts the vectors are dealt, by default as many as their number and size ask for.
    """
    if blocks is None:
        n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
        blocks = max(1, min(BLOCKS, -(-n // BLOCK_ROWS)), -(-n * size // BLOCK_BYTES))

    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            records = rounded(ids, unit(batch.column(1)))
            block = (mix64(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for b in np.unique(block):
                data = records[block == b].tobytes()
                for k in range(0, blocks, 64):
                    other = np.arange(k, min(k + 64, blocks))
                    same = [np.full(len(other), v, t) for v, t in ((b, np.int64), (records["q"].shape[1], np.int32))]
                    columns = [np.minimum(other, b), np.maximum(other, b), same[0], pa.array([data] * len(other), pa.binary()), same[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "block", "records", "size"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        record = _record(int(pdf["size"].iloc[0]))
        one, two = (np.frombuffer(b"".join(pdf["records"][pdf["block"] == k]), record) for k in key)
        return compare_blocks(one, None if key[0] == key[1] else two, threshold)

    placed = vectors.select("id", "vec").mapInArrow(place, "one bigint, two bigint, block bigint, records binary, size int")
    return placed.groupBy("one", "two").applyInPandas(compare, "u bigint, v bigint, sure boolean")


def verified(edges: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of the sure edges of ``similar_vectors`` and of those whose vectors reach the threshold."""
    found = materialize(edges.groupBy("u", "v").agg(F.bool_or("sure").alias("sure")), "pairs")
    sure, open_ = found.where("sure").select("u", "v"), found.where("NOT sure").select("u", "v")
    if open_.isEmpty():
        return sure
    a, b = vectors.select(F.col("id").alias("u"), F.col("vec").alias("x")), vectors.select(F.col("id").alias("v"), F.col("vec").alias("y"))

    def reach(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array((unit(x) * unit(y)).sum(axis=1) >= threshold - 1e-6)

    return sure.union(open_.join(a, "u").join(b, "v").where(F.arrow_udf(reach, "boolean")("x", "y")).select("u", "v"))


def _search(vectors: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links of copies to the one that is searched, and the found pairs of those."""
    def vector_keys(vec: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(k) for k in _vector_keys(vec)], ["k", "l"])

    made = F.arrow_udf(vector_keys, "struct<k:bigint,l:bigint>")
    keys = materialize(vectors.select("id", made("vec").alias("d")).select("id", "d.k", "d.l"), "vector-keys")
    first = keys.groupBy("k", "l").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "l", "first")
    links = materialize(keys.join(first, ["k", "l"]).where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")), "copies")
    few = links.count()
    if few:
        vectors = materialize(vectors.join(small(links.select(F.col("u").alias("id")), few), "id", "left_anti"), "searched")
    return links.union(verified(similar_vectors(vectors, threshold=threshold), vectors, threshold))


def embedding_groups(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, group_id, keep) for every row: the group's least id, and whether the row is the one that stays.

    Groups join vectors whose cosine reaches ``threshold``, over chains too. A
    null vector, one with a null, NaN or infinite element, a zero vector or an
    empty one is alone in its group, as is a row with a null id (group null,
    kept). Vectors are compared within their size. Rows that repeat an id are one
    vector, the least by value; each such row is listed, marked alike. Ids are
    whole numbers; what is no BIGINT counts as a null id. An empty table gives an
    empty table.
    """
    rows = table.select(col(id_col).try_cast("bigint").alias("id"), col(vector_col).cast("array<float>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vec", lambda v: v != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    twice = materialize(good.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    few = twice.count()
    if few:  # only rows of repeated ids meet with their vectors
        once = good.join(small(twice, few), "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
        good = good.join(small(twice, few), "id", "left_anti").union(once)
    good = materialize(good, "vectors")
    sizes = [r[0] for r in good.select(F.size("vec")).distinct().collect()]  # one row for each vector size
    edges = None
    for size in sorted(sizes):
        part = _search(good.where(F.size("vec") == size), threshold)
        edges = part if edges is None else edges.union(part)
    if edges is None:
        return rows.select(F.col("id").alias("vec_id"), F.col("id").alias("group_id"), F.lit(True).alias("keep"))
    comp = materialize(components(edges), "components")
    out = rows.select("id").join(comp, F.col("id") == F.col("node"), "left")
    group = F.coalesce("root", "id")
    return out.select(F.col("id").alias("vec_id"), group.alias("group_id"), F.coalesce(group == F.col("id"), F.lit(True)).alias("keep"))
