import random

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

from turnmill.llm import cotraining as C

from .helpers import no_docs, odd_docs


def corpus(n, seed=5):
    rng, rows = random.Random(seed), []
    nouns = "river mill keeper barrel rain hill market letter window bridge sailor winter candle story harbour".split()
    for i in range(n):
        good = i % 2 == 0
        if good:
            text = ". ".join(" ".join(rng.choice(nouns) for _ in range(rng.randint(6, 12))).capitalize() for _ in range(8)) + "."
        else:
            text = " ".join(rng.choice(["BUY NOW!!!", "click $$$", "WIN ### 99%", "|||"]) for _ in range(30))
        rows.append((i, text, "en", ("books" if good else "spam") if rng.random() < 0.9 else "web", len(text), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 5 < 2], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in C.quality_scores(docs, labels).collect()}
    held = [r for r in rows if r[0] % 5 >= 2]
    assert np.mean([got[r[0]].keep == bool(r[5]) for r in held]) >= 0.97
    assert np.mean([(got[r[0]].p_meta >= 0.5) == bool(r[5]) for r in held]) >= 0.8
    assert C.quality_filter(docs, labels).columns == docs.columns


def test_rounds_use_unlabelled_rows(spark):
    """With few labels the exchange must not hurt: accuracy over unlabelled rows stays high."""
    rows = corpus(500, seed=9)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] < 60], "doc_id bigint, quality int")
    got = {r.doc_id: r.keep for r in C.quality_scores(docs, labels).collect()}
    assert np.mean([got[r[0]] == bool(r[5]) for r in rows if r[0] >= 60]) >= 0.95


def test_held_out_on_the_given_table(spark, sf01):
    labels = spark.read.parquet(f"{sf01}/labels.parquet")
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in ds.dataset(f"{sf01}/labels.parquet").to_table().to_pylist() if r["quality"] is not None}
    got = {r.doc_id: r.keep for r in C.quality_scores(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = [d for d in truth if d % 3 == 0]
    right = np.mean([got[d] == bool(truth[d]) for d in held])
    assert right >= 0.85, right


def test_features_do_not_depend_on_batches():
    text = [None, "", "Abc def!", "x" * 3_000_000, "a b a b a b"]
    whole = C.content_features(pa.array(text))
    single = np.concatenate([C.content_features(pa.array([t], pa.string())) for t in text])
    assert np.allclose(whole, single)
    assert not whole[:2, 1:].any()


def test_odd_rows(spark):
    odd = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (None, 1), (4, None), (5, 1), (5, 0)], "doc_id bigint, quality int")
    got = C.quality_scores(odd, labels).collect()
    assert len(got) == odd.count()
    assert C.quality_filter(odd, labels).columns == odd.columns
    assert C.quality_filter(no_docs(spark), labels).count() == 0
    assert C.quality_filter(odd, labels.limit(0)).count() == odd.count()


def brute_model(x, slots, y, held):
    """Co-training row by row as the module's docstring tells it, on arrays in memory."""
    d, meta = C.FEATURES, C._META
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    known = ~np.isnan(y) & ~held
    test = np.flatnonzero(~np.isnan(y) & held)

    def newton(rows, target, weight, start):
        w = np.array(start, float)
        for _ in range(25):
            hess, grad = 1e-3 * np.eye(len(w)), -1e-3 * (w - start)
            for r, t, k in zip(rows, target, weight):
                p = sig(r @ w)
                hess += k * p * (1 - p) * np.outer(r, r)
                grad += k * (t - p) * r
            w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
        return w

    def middle(z):
        cell = min(max(int((z / C._SPAN + 1) / 2 * C._GRID), 0), C._GRID - 1)
        return ((cell + 0.5) / C._GRID * 2 - 1) * C._SPAN

    def logits(m):
        sc, sm = m["sc"], m["sm"]
        return sc[0] * (x @ m["w"]) + sc[1], sm[0] * (m["prior"] + m["odds"][slots].sum(axis=1)) + sm[1]

    def step(m, yc, wc, ym, wm):
        ridge = np.diag([1e-6] + [C.RIDGE] * (d - 1))
        hess, grad = ridge.copy(), -ridge @ m["w"]
        for r, t, k in zip(x, yc, wc):
            if k:
                p = sig(r @ m["w"])
                hess += k * p * (1 - p) * np.outer(r, r)
                grad += k * (t - p) * r
        move = np.linalg.solve(hess, grad)
        count, total = np.zeros((2, meta)), np.zeros(2)
        for s, t, k in zip(slots, ym, wm):
            if k:
                total[int(t)] += k
                for j in s:
                    count[int(t), j] += k
        prior = np.log((total[1] + 1) / (total[0] + 1))
        smooth = 5 * (total + 1) / (total.sum() + 2)
        odds = np.log((count[1] + smooth[1]) / (count[0] + smooth[0])) - prior
        return {"w": m["w"] + move * min(1, 10 / max(np.abs(move).max(), 1e-9)), "odds": odds, "prior": prior, "sc": (1, 0), "sm": (1, 0), "mix": (1, 1, 0)}

    def calibrate(m):
        zc, zm = logits(m)
        c, s, t = np.array([middle(v) for v in zc[test]]), np.array([middle(v) for v in zm[test]]), y[test]
        one, ones = np.ones(len(test)), np.ones(len(test))
        a, b = newton(np.stack((c, one), 1), t, ones, [1.0, 0.0]), newton(np.stack((s, one), 1), t, ones, [1.0, 0.0])
        mix = newton(np.stack((a[0] * c + a[1], b[0] * s + b[1], one), 1), t, ones, [1.0, 0.0, 0.0])
        return m | {"sc": (a[0], a[1]), "sm": (b[0], b[1]), "mix": mix}

    m = {"w": np.zeros(d), "odds": np.zeros(meta), "prior": 0.0, "sc": (1, 0), "sm": (1, 0), "mix": (1, 1, 0)}
    base_y, base_w = np.where(known, y, 0), known.astype(float)
    for _ in range(C.WARM_UP):
        m = step(m, base_y, base_w, base_y, base_w)
    for _ in range(C.ROUNDS):
        m = calibrate(m)
        pc, pm = map(sig, logits(m))
        none = np.isnan(y)
        sure_c, sure_m = none & (np.abs(pc - 0.5) >= C.CONFIDENT - 0.5), none & (np.abs(pm - 0.5) >= C.CONFIDENT - 0.5)
        m = step(m, np.where(sure_m, pm > 0.5, base_y), np.where(sure_m, C.PSEUDO, base_w), np.where(sure_c, pc > 0.5, base_y), np.where(sure_c, C.PSEUDO, base_w))
    m = calibrate(m)
    zc, zm = logits(m)
    return sig(zc), sig(zm), sig(m["mix"][0] * zc + m["mix"][1] * zm + m["mix"][2])


def test_against_brute_force(spark):
    """Every score that the query gives equals that of the plain version."""
    from turnmill.llm.queries import op2_cotraining

    rows = corpus(300, seed=11) + [(300, None, None, None, None, 1), (301, "", "en", "web", 0, 0)]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3 == 0], "doc_id bigint, quality int")
    folder = spark.conf.get("spark.checkpoint.dir") + "/brute"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in op2_cotraining(spark, folder).collect()}
    fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {C.HOLD_OUT}) AS f").collect()}
    x = C.content_features(pa.array([r[1] for r in rows])).astype(float)
    slots = C.meta_slots(*[pa.array([r[k] for r in rows]) for k in (2, 3, 4)])
    y = np.array([float(r[5]) if r[0] % 3 == 0 else np.nan for r in rows])
    want = np.stack(brute_model(x, slots, y, np.array([fold[r[0]] == 0 for r in rows])), axis=1)
    have = np.array([[got[r[0]].p_content, got[r[0]].p_meta, got[r[0]].p_quality] for r in rows])
    assert np.allclose(have, want, atol=1e-6), np.abs(have - want).max()
    assert [got[r[0]].keep for r in rows] == (want[:, 2] >= C.KEEP).tolist()


def test_labels_other_than_0_and_1_are_none(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    good = [(r[0], r[5]) for r in rows if r[0] % 2 == 0 or r[0] % 3 == 0]
    kind = "doc_id bigint, quality int"
    a = C.quality_scores(docs, spark.createDataFrame(good, kind))
    b = C.quality_scores(docs, spark.createDataFrame(good + [(r[0], v) for r, v in zip(rows, [2, -1, 99] * 70) if r[0] % 2 and r[0] % 3], kind))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert all(r.keep for r in C.quality_scores(docs, spark.createDataFrame([(0, 5), (1, 6)], kind)).collect())
