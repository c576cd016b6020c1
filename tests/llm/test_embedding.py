import numpy as np
import pyarrow.dataset as ds

from turnmill.llm import embedding_dedup as E
from turnmill.llm.embedding_dedup import embedding_groups, similar_vectors, verified

from .helpers import components


def close(x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    return list(zip(a.tolist(), b.tolist()))


def test_recall_on_the_given_table(spark, sf01):
    t = ds.dataset(f"{sf01}/embeddings.parquet").to_table().to_pylist()
    ids, x = [r["vec_id"] for r in t], np.array([r["embedding"] for r in t], np.float32)
    want = components((ids[a], ids[b]) for a, b in close(x, 0.95))
    got = {r.vec_id: r for r in embedding_groups(spark.read.parquet(f"{sf01}/embeddings.parquet")).collect()}
    assert len(got) == len(ids)
    assert all(got[i].group_id == want.get(i, i) and got[i].keep == (want.get(i, i) == i) for i in ids)


def test_no_pair_is_left_out_in_any_number_of_blocks(spark):
    """Pairs with no chain to help, close and just at the threshold: all are joined, and nothing else, however the work is dealt."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate((base, base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.3, (1500, 1)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>").repartition(4)
    pairs = close(x, 0.95)
    assert len(pairs) > 1000
    for how in ({}, {"blocks": 1}, {"blocks": 5}):
        assert components((r.u, r.v) for r in verified(similar_vectors(df, **how), df, 0.95).collect()) == components(pairs)


def test_rows_added_don_t_part_what_is_joined(spark):
    """Isolated pairs just over the threshold, alone and beside a crowd of 6,000 vectors."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(1000, 16)), rng.normal(size=(1000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.stack((a, 0.951 * a + np.sqrt(1 - 0.951**2) * b), axis=1).reshape(2000, 16)
    c = rng.normal(size=16)
    x = np.concatenate((pairs, c / np.linalg.norm(c) + rng.normal(size=(6000, 16)) * 0.003)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for n in (2000, 8000):
        got = embedding_groups(spark.createDataFrame(rows[:n], "vec_id bigint, embedding array<float>")).collect()
        assert [r.group_id for r in sorted(got) if r.vec_id < 2000] == [i // 2 * 2 for i in range(2000)], n


def test_tiles_join_what_their_pairs_join():
    """A cluster, chains and lone vectors, in a block with itself and with another; a forest joins the cluster."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    x[:300] = x[0] + rng.normal(size=(300, 24)) * 0.05
    for i in range(301, 600, 2):
        x[i] = x[i - 1] + rng.normal(size=24) * 0.2
    x = x[rng.permutation(900)].astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    records = E.rounded(np.arange(900), x)
    for one, two, among in ((records, None, lambda a, b: True), (records[:350], records[350:], lambda a, b: a < 350 <= b)):
        e = E.compare_blocks(one, two, 0.95, tile=100)
        assert e.sure.sum() < 900
        reach = e.sure | ((x[e.u] * x[e.v]).sum(axis=1) >= 0.95)
        assert components(zip(e.u[reach].tolist(), e.v[reach].tolist())) == components(p for p in close(x, 0.95) if among(*p))


def test_a_near_copy_has_links_of_its_own(spark):
    """The third vector reaches the second, but not the first, which the second all but equals."""
    t, d = np.arccos(0.95 - 5e-6), 3.2e-5
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in ((1, 0.0), (2, d), (3, t))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert {r.group_id for r in embedding_groups(df).collect()} == {1}
    assert sorted(r.group_id for r in embedding_groups(df.where("vec_id <> 2")).collect()) == [1, 3]


def test_vectors_of_any_length_are_compared(spark):
    rows = [(1, [1e-38, 2e-38]), (2, [1e30, 2.05e30]), (3, [1.0, 2.1]), (4, [1e30, -1e30])]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted(r.group_id for r in got) == [1, 1, 1, 4]


def test_rounding_error_is_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)).astype(np.float32) * rng.uniform(0.01, 1, (300, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = E.rounded(np.arange(300), x)
    e = r["error"].max()
    assert np.abs(x @ x.T - E.restored(r) @ E.restored(r).T).max() <= 2 * e + e * e


def test_pairs_within_the_error_are_compared_again(spark):
    """Cosines from under to over the threshold by less than a byte can tell."""
    rng = np.random.default_rng(4)
    rows, pairs = [], []
    for i in range(200):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.95 + (i - 100) * 1e-4
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
        if i > 100:
            pairs.append((2 * i, 2 * i + 1))
    got = embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted(r.group_id for r in got if r.group_id != r.vec_id and r.vec_id != 201) == [a for a, _ in pairs]


def test_copies_and_scaled_copies_are_one_vector(spark):
    rows = [(i, [1.0 * (i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(500)] + [(600, [0.0, 1.0, -3.0])]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.group_id, r.keep) for r in got if r.vec_id < 600} == {(0, True), (0, False)} and sum(r.keep for r in got) == 2


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(1200)] + [(5000, [-1.0, 0.5, 0.0])], "vec_id bigint, embedding array<float>")
    got = embedding_groups(df).collect()
    assert sum(r.keep for r in got) == 2 and {r.group_id for r in got} == {0, 5000}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.001]), (2, [1.0, 0.001]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]),
        (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [inf, 1.0]), (10, [2.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "vec_id bigint, embedding array<float>, id string, vec string, node string")
    got = sorted(((r.vec_id, r.group_id, r.keep) for r in embedding_groups(df).collect()), key=str)
    want = [(1, 1, True), (2, 1, False), (2, 1, False), (10, 1, False), (None, None, True)] + [(i, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)
    assert embedding_groups(df.limit(0)).count() == 0
