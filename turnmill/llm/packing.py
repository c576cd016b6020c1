"""Packing by cutting-stock column generation.

Lengths are counted into classes of ``step`` tokens. A linear program over
patterns (how many pieces of each class fill one bin) is solved by column
generation: its duals price new patterns through a knapsack dynamic program.
Pattern counts are rounded down and the rest is filled first-fit decreasing, so
every class is met exactly. The program's size depends on the number of classes
alone. Documents are then ranked within their class and a rank falls into a
pattern's bin and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import inverse as invert
from ._linear import product
from ._spark import col, materialize, small
from .mixing import tokens

CAPACITY, STEP, BUCKET_ROWS = 2048, 16, 65536


def _price(dual: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest dual value that fits: unbounded knapsack by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c], took[c] = best[c - 1], -1
        k = int(np.searchsorted(sizes, c, "right"))
        if k:
            v = best[c - sizes[:k]] + dual[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    a, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            a[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), a


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 5000) -> list[tuple[int, np.ndarray]]:
    """[(bins, pattern)] meeting ``demand`` pieces of ascending ``sizes`` exactly, bins of ``room``; near the fewest."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1 / basis.diagonal())
    x = product(inverse, demand)
    for k in range(rounds):
        if k % 100 == 99:
            inverse = invert(basis)
            x = np.maximum(product(inverse, demand), 0)
        value, a = _price(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        d = product(inverse, a)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x -= theta * d
        x[out] = theta
        np.maximum(x, 0, out=x)
        basis[:, out] = a
        row = inverse[out] / d[out]
        inverse -= np.multiply.outer(d, row)
        inverse[out] = row
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        a = basis[:, j].round().astype(np.int64)
        some = a > 0
        n = min(int(np.floor(x[j] + 1e-9)), int((left[some] // a[some]).min()))
        if n > 0:
            plan.append((n, a))
            left -= n * a
    while left.any():  # at most about one bin a pattern is left: first-fit decreasing, as often as it fits
        a, free_ = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            n = min(int(left[i]), free_ // int(sizes[i]))
            a[i], free_ = n, free_ - n * int(sizes[i])
        some = a > 0
        n = int((left[some] // a[some]).min())
        plan.append((n, a))
        left -= n * a
    return plan


def pack(
    docs: DataFrame, *, capacity: int = CAPACITY, step: int = STEP, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a bin: (bin_id, n_tokens, doc_ids, starts, lengths), pieces in slot order.

    A piece is ``length`` tokens of a document from token ``start``. A document
    over ``capacity`` tokens is cut into full pieces and a rest; every token of
    every row is in exactly one piece and no bin exceeds ``capacity``. Rows
    without a token (null, empty) are in no bin. Repeated rows are packed each on
    their own; a null id is carried as null. An empty table gives no bins.
    """
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    n = F.col("n")
    whole = docs.select(col(id_col).alias("id"), tokens(col(text_col)).alias("n")).where("n > 0")
    cuts = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / capacity) * capacity, F.lit(capacity).cast("bigint"))
    pieces = whole.select("id", "n", F.explode(cuts).alias("start")).select("id", "start", F.least(F.lit(capacity), n - F.col("start")).alias("n"))
    pieces = pieces.withColumn("class", F.ceil(n / step).cast("int")).withColumn("h", F.xxhash64("id", "start"))
    pieces = materialize(pieces, "pieces")
    counts = {r["class"]: r["k"] for r in pieces.groupBy("class").agg(F.count("*").alias("k")).collect()}  # at most capacity / step rows
    total = sum(counts.values())
    buckets = max(1, total // BUCKET_ROWS)
    # ranks without one task a class: counts of (class, bucket) give each bucket's first rank
    part = F.pmod("h", F.lit(buckets)).alias("part")
    pieces = pieces.select("*", part)
    per = materialize(pieces.groupBy("class", "part").agg(F.count("*").alias("k")), "ranks")
    first = per.selectExpr("class", "part", "sum(k) OVER (PARTITION BY class ORDER BY part) - k AS first")
    ranked = pieces.selectExpr("*", "row_number() OVER (PARTITION BY class, part ORDER BY h, id, start) - 1 AS place")
    ranked = ranked.join(small(first, len(counts) * buckets), ["class", "part"]).withColumn("rank", F.col("first") + F.col("place"))
    sizes = np.array(sorted(counts), np.int64)
    plan = solve(sizes, np.array([counts[s] for s in sizes], np.int64), capacity // step)
    rows, used, bin0 = [], np.zeros(len(sizes), np.int64), 0
    for bins, a in plan:
        for i in np.flatnonzero(a):
            rows.append((int(sizes[i]), int(used[i]), int(used[i] + bins * a[i]), bin0, int(a[i])))
            used[i] += bins * a[i]
        bin0 += bins
    spark = docs.sparkSession
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=["class", "lo", "hi", "bin0", "each"]), "class int, lo bigint, hi bigint, bin0 bigint, each bigint") if rows else spark.createDataFrame([], "class int, lo bigint, hi bigint, bin0 bigint, each bigint")
    placed = ranked.join(F.broadcast(slots), (ranked["class"] == slots["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # slots: at most patterns x classes
    placed = placed.select((F.col("bin0") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("bin_id"), F.struct(-n, "rank", "id", "start", "n").alias("p"))
    bins = placed.groupBy("bin_id").agg(F.array_sort(F.collect_list("p")).alias("p"))  # a bin has at most capacity pieces
    pick = lambda f: F.transform("p", lambda p: p[f])
    return bins.select(
        "bin_id", F.aggregate(pick("n"), F.lit(0).cast("bigint"), lambda s, k: s + k).alias("n_tokens"),
        pick("id").alias("doc_ids"), pick("start").alias("starts"), pick("n").alias("lengths"),
    )
