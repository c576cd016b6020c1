import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from turnmill.llm import simhash_dedup as S

from .helpers import PROSE, components, no_docs, odd_docs


def close_pairs(sig, bits):
    out = set()
    for i in range(len(sig)):
        d = np.bitwise_count(sig[i + 1 :] ^ sig[i]).sum(1)
        out |= {(i, i + 1 + int(j)) for j in np.flatnonzero(d <= bits)}
    return out


def test_recall_of_all_close_pairs(spark, sf01):
    """Every document is a query: pairs within 44 bits by brute force against pairs in the same group."""
    t = ds.dataset(f"{sf01}/documents.parquet").to_table()
    ids, sig = t["doc_id"].to_pylist(), S.signatures(t["text"])
    pairs = [(ids[a], ids[b]) for a, b in close_pairs(sig, 44) if sig[a].any() and sig[b].any()]
    root = {r.id: r.root for r in S.near_groups(spark.read.parquet(f"{sf01}/documents.parquet")).collect()}
    hit = [a in root and root.get(a) == root.get(b) for a, b in pairs]
    assert len(pairs) > 50 and np.mean(hit) >= 0.9, np.mean(hit)
    # and nothing is joined that no chain of close pairs joins
    comp = components(pairs)
    for group in {r for r in root.values()}:
        assert len({comp[i] for i, r in root.items() if r == group}) == 1


def test_recall_by_distance(spark):
    """Random pairs of signatures alone, with no chain to help: all found, the far ones too."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (4000, 4), dtype=np.uint64) * np.uint64(2)
    far = base.copy()
    distance = np.tile(np.array([4, 16, 24, 28, 36, 44]), 700)[:4000]
    for i, k in enumerate(distance):
        for b in rng.choice(256, k, replace=False):
            far[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rows = [(i, base[i].tobytes()) for i in range(4000)] + [(10_000 + i, far[i].tobytes()) for i in range(4000)]
    edges = S.similar_edges(spark.createDataFrame(rows, "sid bigint, sig binary").repartition(4)).collect()
    found = {(min(r.u, r.v), max(r.u, r.v)) for r in edges}
    assert all(b == a + 10_000 for a, b in found)
    got = np.array([(i, 10_000 + i) in found for i in range(4000)])
    assert got.all()


def test_no_pair_at_the_limits_is_left_out(spark):
    """Isolated pairs 44 bits apart that share 8 bytes of their sketches, in short lists and in one of all rows; none past a limit."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, (600, 8), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (600, 8), dtype=np.uint64)
    base[:200].view(np.uint8)[:, [32, 33]] = 7  # two bytes that 400 rows share
    far = base.copy()
    for i in range(600):
        for b in rng.choice(256, 45 if i % 3 == 1 else 44, replace=False):
            far[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        free = np.arange(34, 64) if i < 200 else np.arange(32, 64)
        other = rng.choice(free, 25 if i % 3 == 2 else 24, replace=False)
        far[i].view(np.uint8)[other] ^= rng.integers(1, 256, len(other), dtype=np.uint8)
    rows = [(i, base[i].tobytes()) for i in range(600)] + [(10_000 + i, far[i].tobytes()) for i in range(600)]
    edges = S.similar_edges(spark.createDataFrame(rows, "sid bigint, sig binary").repartition(4), width=8).collect()
    assert {(r.v, r.u) for r in edges} == {(i, 10_000 + i) for i in range(0, 600, 3)}


def test_short_and_long_lists_join_what_their_pairs_join():
    """Clusters, pairs and lone rows in lists of one key, on both sides of the limits for whole lists and for blocks of rows."""
    rng = np.random.default_rng(6)
    key = np.repeat(np.arange(6, dtype=np.uint64), (1, 2, 32, 33, 500, 3000))
    sig = rng.integers(0, 2**63, (len(key), 4), dtype=np.uint64)
    for i in rng.choice(np.arange(1, len(key)), 1500, replace=False):  # chains of rows 30 bits apart
        sig[i] = sig[i - 1]
        for b in rng.choice(256, 30, replace=False):
            sig[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    mixed = rng.permutation(len(key))
    u, v = S._forest(mixed, sig[mixed], key[mixed], 44)
    want = components((a, b) for a, b in close_pairs(sig, 44) if key[a] == key[b])
    assert len(want) > 2000 and components(zip(u.tolist(), v.tolist())) == want


def test_guaranteed_minimum():
    a = np.zeros((1, 4), np.uint64)
    b = a.copy()
    b[0, 0] = np.uint64(2**44 - 1)
    assert S._close(a, b, 44)[0] and not S._close(a, b, 43)[0]


def test_signatures_do_not_depend_on_batches():
    text = [None, "", "??", PROSE, " ".join(f"w{i}" for i in range(40_000)), PROSE.upper()]
    whole = S.signatures(pa.array(text))
    assert (whole == np.concatenate([S.signatures(pa.array([t], pa.string())) for t in text])).all()
    assert (whole[3] == whole[5]).all() and not whole[:3].any()


def test_odd_rows(spark):
    odd = odd_docs(spark)
    got = S.simhash_dedup(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sum(r.doc_id is None for r in rows) == 3
    assert {200, 201, 202, 203, 204, 300, 301, 302} <= {r.doc_id for r in rows}
    assert [r.doc_id for r in rows if r.text == PROSE and r.doc_id is not None] in ([], [100])
    assert len([r for r in rows if r.doc_id is not None]) == len({r.doc_id for r in rows if r.doc_id is not None})
    assert S.simhash_dedup(no_docs(spark)).count() == 0
    same = odd.where(F.col("doc_id") == 101)
    assert S.simhash_dedup(same).count() == 1


def test_long_texts_of_one_language_stay(spark):
    """Disjoint texts of 50,000 words and more, some within 44 bits by their common words; a copy edited at 5 % still goes."""
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(200_000)])
    weight = 1 / np.arange(1, 200_001)
    texts = [" ".join(rng.choice(vocab, n, p=weight / weight.sum())) for n in (50_000,) * 12 + (100_000,) * 12]
    edited = np.array(texts[0].split(), object)
    edited[rng.choice(50_000, 2_500, replace=False)] = "edit"
    assert close_pairs(S.signatures(pa.array(texts)), 44)
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(edited)])), "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in S.simhash_dedup(docs).select("doc_id").collect()) == list(range(24))


def test_a_signature_whose_hash_is_another_s_stays(spark, monkeypatch):
    """With one hash for all signatures only those of the one that stands for it are grouped, by the second hash."""
    real = S.F.xxhash64

    class Functions:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def xxhash64(*cols):
            return F.lit(7).cast("bigint") if len(cols) == 1 and isinstance(cols[0], str) and cols[0] == "sig" else real(*cols)

    monkeypatch.setattr(S, "F", Functions())
    rows = [(i, f"{w} river mill keeper barrel rain {w} hill market letter {w} window") for i, w in enumerate(["alpha", "beta", "gamma", "delta"])] + [(9, "alpha river mill keeper barrel rain alpha hill market letter alpha window")]
    got = S.simhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    ids = sorted(r.doc_id for r in got.collect())
    assert {0, 1, 2, 3} <= set(ids)
