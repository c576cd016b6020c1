from collections import Counter

import pytest

from turnmill.llm._spark import materialize

from .helpers import no_docs, odd_docs


def test_stages_of_the_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, {"documents": docs}
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        frames[name] = docs
        assert docs.columns == columns or name == P.STAGES[-1][0]
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    rows = {k: [tuple(r) for r in v.collect()] for k, v in frames.items()}
    assert Counter(rows["quality"]) <= Counter(rows["documents"])
    texts = [r[1] for r in rows["exact_dedup"] if r[1] is not None]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] for r in rows["quality"] if r[1] is not None}
    assert set(rows["near_dedup"]) <= set(rows["exact_dedup"])
    assert set(rows["mix"]) <= set(rows["near_dedup"])
    copies = Counter(r[0] for r in rows["mix"])
    packed = Counter(d for b in frames["pack"].collect() for d, s in zip(b.doc_ids, b.starts) if s == 0)
    assert packed == Counter({d: n for d, n in copies.items() if any(r[0] == d and (r[1] or "").split() for r in rows["mix"])})
    again = sorted(tuple(map(str, r)) for r in P.run(spark, sf).collect())
    assert again == sorted(tuple(map(str, r)) for r in rows["pack"] and frames["pack"].collect())


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_tables(spark, sf, make):
    import corpus_pipeline as P

    docs = make(spark)
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf), f"odd-{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.count() == 0 or make is odd_docs
