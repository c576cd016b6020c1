import hashlib
import math
import re
from collections import Counter

from turnmill.llm.mixing import ALPHA, SEED, mix_sources, repetition_rates

from .helpers import CLASH, no_docs, odd_docs, odd_rows


def brute(rows, weights=None, budget=None):
    tokens = Counter()
    for _, text, _, source, _ in rows:
        tokens[source] += len(re.findall(r"[^ \t\n\f\r]+", text or ""))
    total = sum(tokens.values())
    w = {s: (weights.get(s, 0.0) if weights else (n / total) ** ALPHA) if n else 0.0 for s, n in tokens.items()}
    rate = {s: round((budget or total) * w[s] / sum(w.values()) / n, 9) if n else 0.0 for s, n in tokens.items()}
    out = Counter()
    for r in rows:
        u = int(hashlib.md5(f"{SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        whole = math.floor(rate[r[3]])
        out[r] += whole + (u < rate[r[3]] - whole)
    return rate, +out


def test_against_brute_force(spark):
    odd = odd_docs(spark)
    for weights, budget in ((None, None), ({"web": 1.0, "books": 3.0, None: 1.0}, 400_000)):
        rate, want = brute(odd_rows(), weights, budget)
        rates = {r.source: r.rate for r in repetition_rates(odd, weights=weights, budget=budget).collect()}
        assert all(abs(rates[s] - v) < 1e-8 for s, v in rate.items()) and len(rates) == len(rate)
        got = mix_sources(odd, weights=weights, budget=budget)
        assert got.columns == odd.columns
        assert Counter(tuple(r)[:5] for r in got.collect()) == want
    copy = mix_sources(odd, weights={"books": 5.0}, copy_col="copy_no").groupBy("doc_id").agg({"copy_no": "max", "*": "count"}).collect()
    assert copy and all(r[1] == r[2] for r in copy)


def test_expected_tokens(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en", "s" if i % 4 else "t", 7) for i in range(4000)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter(r.source for r in mix_sources(docs, weights={"s": 1.0, "t": 1.0}).collect())
    assert abs(got["s"] - 2000) < 120 and abs(got["t"] - 2000) < 120


def test_empty(spark):
    assert mix_sources(no_docs(spark)).count() == 0
    assert len(CLASH) == len(set(CLASH))
