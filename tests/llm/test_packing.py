import re
from collections import Counter

import numpy as np
import pytest

from turnmill.llm._linear import gram
from turnmill.llm._linear import inverse as invert
from turnmill.llm.packing import _price, pack, solve

from .helpers import no_docs, odd_docs


def test_knapsack_against_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, dual, room = np.sort(rng.choice(np.arange(1, 9), 3, replace=False)), rng.uniform(0, 1, 3), 14
        best = max(a * dual[0] + b * dual[1] + c * dual[2] for a in range(15) for b in range(15) for c in range(15) if a * sizes[0] + b * sizes[1] + c * sizes[2] <= room)
        value, pattern = _price(dual, sizes, room)
        assert abs(value - best) < 1e-9 and pattern @ sizes <= room and abs(pattern @ dual - best) < 1e-9


def first_fit_decreasing(sizes, demand, room):
    left, bins = demand.copy(), 0
    while left.any():
        space, a = room, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            a[i] = min(left[i], space // sizes[i])
            space -= a[i] * sizes[i]
        n = int((left[a > 0] // a[a > 0]).min())
        left -= n * a
        bins += n
    return bins


def lower_bound(sizes, demand, room):
    """Martello and Toth's L2: no packing needs fewer bins."""
    best = 0
    for k in range(room // 2 + 1):
        big, mid, low = sizes > room - k, (sizes > room / 2) & (sizes <= room - k), (sizes >= k) & (sizes <= room / 2)
        spare = demand[mid].sum() * room - (sizes * demand)[mid].sum()
        best = max(best, demand[big].sum() + demand[mid].sum() + max(0, -(-((sizes * demand)[low].sum() - spare) // room)))
    return int(best)


def test_plan_meets_demand_with_few_bins():
    rng = np.random.default_rng(4)
    for m in (1, 5, 60):
        sizes = np.sort(rng.choice(np.arange(1, 129), m, replace=False))
        demand = rng.integers(1, 400, m)
        plan = solve(sizes, demand, 128)
        assert (sum(n * a for n, a in plan) == demand).all() and all(a @ sizes <= 128 for _, a in plan)
        bins = sum(n for n, _ in plan)
        assert bins <= first_fit_decreasing(sizes, demand, 128) + m
        assert bins <= lower_bound(sizes, demand, 128) * 1.02 + m
    assert solve(np.zeros(0, np.int64), np.zeros(0, np.int64), 128) == []


def test_all_classes_beside_a_session(spark):
    """Every class of the program, solved in a driver that has a JVM, over the rounds after which the inverse is made anew."""
    rng = np.random.default_rng(6)
    sizes, demand = np.arange(1, 129), rng.integers(1, 2000, 128)
    assert spark.range(3).count() == 3
    plan = solve(sizes, demand, 128)
    assert (sum(n * a for n, a in plan) == demand).all() and all(a @ sizes <= 128 for _, a in plan)


def test_inverse():
    rng = np.random.default_rng(8)
    for n in (1, 2, 40, 128):
        a = rng.normal(size=(n, n))
        a[0, 0] = 0.0 if n > 1 else 2.0
        assert np.allclose((invert(a)[:, :, None] * a[None]).sum(axis=1), np.eye(n), atol=1e-7)
        assert np.allclose(gram(a, np.arange(n) + 1.0), (a.T * (np.arange(n) + 1.0)) @ a)
    with pytest.raises(ValueError):
        invert(np.zeros((2, 2)))


def tokens(text):
    return len(re.findall(r"[^ \t\n\f\r]+", text or ""))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_token_once(spark, capacity):
    odd = odd_docs(spark)
    bins = pack(odd, capacity=capacity).collect()
    seen = Counter()
    for b in bins:
        assert sum(b.lengths) == b.n_tokens <= capacity
        seen.update(zip(b.doc_ids, b.starts, b.lengths))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        n = tokens(r.text)
        want.update((r.doc_id, s, min(capacity, n - s)) for s in range(0, n, capacity))
    assert seen == want and len({b.bin_id for b in bins}) == len(bins)


def test_few_bins_on_the_given_table(spark, sf01):
    bins = pack(spark.read.parquet(f"{sf01}/documents.parquet")).collect()
    total = sum(b.n_tokens for b in bins)
    assert len(bins) <= -(-total // 2048) * 1.06 + 2


def test_empty(spark):
    assert pack(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        pack(no_docs(spark), capacity=100)
