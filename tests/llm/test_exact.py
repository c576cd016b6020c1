from collections import Counter

import numpy as np

from turnmill.llm.exact_dedup import _positions, exact_dedup, probes, twice_filter

from .helpers import no_docs, odd_docs, odd_rows


def brute(rows):
    best = {}
    for r in rows:
        if r[1] is not None and (r[1] not in best or (r[0] is None, r[0] or 0) < (best[r[1]][0] is None, best[r[1]][0] or 0)):
            best[r[1]] = r
    return Counter([(r[0], r[1]) for r in best.values()] + [(r[0], r[1]) for r in rows if r[1] is None])


def test_against_brute_force(spark):
    odd = odd_docs(spark)
    for bits in (1 << 29, 1 << 16):
        got = exact_dedup(odd, max_bits=bits)
        assert got.columns == odd.columns
        assert Counter((r.doc_id, r.text) for r in got.collect()) == brute(odd_rows())


def test_small_filter_gives_the_same(spark):
    rows = [(i, f"t{i % 30_000}") for i in range(45_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for bits in (1 << 29, 1 << 16):
        assert sorted(r.doc_id for r in exact_dedup(df, max_bits=bits).collect()) == list(range(30_000))


def test_no_repeated_hash_is_missed(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 20_000)
    h = np.concatenate((h, h[:500]))
    bits, packed = twice_filter(spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(4), len(h))
    pos = _positions(h, bits)
    got = ((packed[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    assert got[:500].all() and got[20_000:].all()
    assert got[500:20_000].mean() < 0.05


def test_crowded_filter_still_passes_unique_rows(spark):
    """At two bits a row and at one, with the probes that suit them."""
    rng = np.random.default_rng(2)
    for rows, share in ((32_768, 0.1), (65_536, 0.3)):
        h = rng.integers(-(2**63), 2**63 - 1, rows)
        h = np.concatenate((h[: rows - 300], h[:300]))
        bits, packed = twice_filter(spark.createDataFrame([(int(x),) for x in h], "h bigint"), rows, 1 << 16)
        pos = _positions(h, bits, probes(bits, rows))
        got = ((packed[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        assert bits == 1 << 16 and got[:300].all() and got[-300:].all() and (~got[300:-300]).mean() > share


def test_ties_and_empty(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (2, "b", None), (2, "b", "z")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, row string")).collect()
    assert sorted((r.doc_id, r.row or "") for r in got) in ([(1, "x"), (2, "")], [(1, "x"), (2, "z")])
    assert exact_dedup(no_docs(spark)).count() == 0
