import itertools
import random

import numpy as np
import pyarrow as pa

from turnmill.llm import toxicity as T

from .helpers import no_docs, odd_docs

CLEAN = "the garden was calm and every visitor brought bread and soup for their neighbours before evening prayers".split()
BAD = ["vilescum", "filthrat", "scumlord"]


def texts(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(CLEAN) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 6]
    first, e, move = np.array([0, 1, 5]), rng.normal(size=11), rng.normal(size=(2, 2))
    fwd, bwd = T.messages(e, first, move)
    got = 1 / (1 + np.exp(-(fwd + bwd)))
    pairs = np.zeros((2, 2))
    for start, n in zip(first, sizes):
        total, one = 0.0, np.zeros(n)
        trans = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[start + i] * s for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            one += w * np.array(path)
            for a, b in zip(path, path[1:]):
                trans[a, b] += w
        assert np.allclose(got[start : start + n], one / total)
        pairs += trans / total
    assert np.allclose(T.pair_marginals(e, fwd, bwd, first, move), pairs)


def test_held_out_documents_and_offsets(spark):
    train, test = texts(400, 1), texts(120, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train] + [(1000 + i, t) for i, t, _ in test], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    for i, t, y in test:
        r = got[1000 + i]
        assert r.is_toxic == bool(y)
        found = " ".join(t[s.start : s.end] for s in r.spans).split()
        assert sorted(found) == sorted(w.strip(".") for w in t.split() if w.strip(".") in BAD)


def test_offsets_count_characters():
    rows = texts(400, 1)
    field = T.fit(T.label_tokens(pa.array([t for _, t, _ in rows]), np.array([y > 0 for _, _, y in rows])))
    text = "été \U0001f600 calm vilescum bread"
    out = T.score_texts(field, pa.array([text, "", None, "..."])).to_pylist()
    assert [text[s["start"] : s["end"]] for s in out[0]["spans"]] == ["vilescum"]
    assert [(o["score"], o["spans"]) for o in out[1:]] == [(0.0, [])] * 3


def test_odd_rows(spark):
    rows = texts(200, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    base = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    field = T.train(base, labels)
    odd = odd_docs(spark)
    out = T.toxicity(odd, labels, field=field)
    got = out.collect()
    assert len(got) == odd.count() and not any(r.is_toxic for r in got)
    assert all(r.score is not None and r.spans is not None for r in got)
    assert T.toxicity(no_docs(spark), labels).count() == 0
    none = T.toxicity(odd, labels.limit(0)).collect()
    assert len(none) == len(got) and all(r.score == 0 for r in none)


def test_few_and_odd_labels(spark):
    rows = texts(60, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    toxic = [i for i, _, y in rows if y]
    kind = "doc_id bigint, toxic int"
    few = spark.createDataFrame([(i, 1) for i in toxic[:4]] + [(i, 0) for i, _, y in rows if not y][:20], kind)
    got = {r.doc_id: r for r in T.toxicity(docs, few).collect()}
    assert all(any(w in BAD for s in got[i].spans for w in rows[i][1][s.start : s.end].split()) for i in toxic[:4])
    assert not any(got[i].is_toxic for i, _, y in rows if not y)
    one = spark.createDataFrame([(toxic[0], 1)] + [(i, 0) for i, _, y in rows if not y], kind)
    assert T.train(docs, one) is None and all(r.score == 0 for r in T.toxicity(docs, one).collect())
    odd = spark.createDataFrame([(i, 7) for i in toxic] + [(i, -1) for i, _, y in rows if not y], kind)
    assert T.train(docs, odd) is None
