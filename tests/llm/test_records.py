import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from turnmill.llm import records as R

from .helpers import no_docs, odd_docs


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(R.VOCABULARY, "rb") if x.strip())}
    return tiktoken.Encoding("plain", pat_str=R.PATTERN, mergeable_ranks=ranks, special_tokens={})


def slow_crc(data: bytes) -> int:
    reg = 0xFFFFFFFF
    for b in data:
        reg ^= b
        for _ in range(8):
            reg = (reg >> 1) ^ (0x82F63B78 if reg & 1 else 0)
    return reg ^ 0xFFFFFFFF


def test_checksums():
    assert R.crc32c_bytes(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    sizes = np.array([0, 1, 7, 255, 256, 257, 1024, 2000])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    assert R.crc32c(data, starts, sizes).tolist() == [slow_crc(data[s : s + n].tobytes()) for s, n in zip(starts, sizes)]


def test_tokens_equal_the_library(encoding):
    rng = random.Random(2)
    parts = ["word", " ", "  ", "\n", "\t", "don't", "été", " ", " ", "123", "!?", "\U0001f600", "中文", "\x85", "\x1c", "a'll", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", " ", "\n\n", " a", "a "]
    tok = R.Tokenizer(open(R.VOCABULARY, "rb").read())
    for _, b, off in R.chunks(pa.array(texts)):
        ids, counts = tok.encode(b, off)
        edge = np.concatenate(([0], np.cumsum(counts)))
        assert [ids[s:t].tolist() for s, t in zip(edge, edge[1:])] == [encoding.encode_ordinary(t) for t in texts]


def test_round_trip_over_files(spark, sf, encoding, tmp_path):
    """Written twice to one folder: the second write adds to the first."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for times in (1, 2):
        index = R.write_records(docs, f"file://{tmp_path}/out").collect()
        assert sorted(r.doc_id for r in index) == sorted([*texts] * times)
        random.Random(1).shuffle(index)
        for r in index:
            with open(tmp_path / "out" / r.file, "rb") as f:
                f.seek(r.offset)
                frame = f.read(r.length)
            assert encoding.decode(R.read_record(frame).tolist()) == texts[r.doc_id] and r.n_tokens == (r.length - 16) // 2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.bin")) == sum(r.length for r in index)
    assert R.write_records(docs.limit(0), f"file://{tmp_path}/none").count() == 0


def test_query_writes_and_reads_back(spark, sf):
    from turnmill.llm.queries import op5_token_records

    index = op5_token_records(spark, sf)
    assert index.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert index.columns == ["doc_id", "shard", "offset", "length", "n_tokens", "file"]


def test_damage_is_found():
    data, _ = R.frame(np.arange(10, dtype="<u2").view(np.uint8), np.array([20]))
    assert R.read_record(data).tolist() == list(range(10))
    for at in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.read_record(bytes(bad))


def test_odd_rows(spark, encoding):
    odd = odd_docs(spark)
    rows = R.token_records(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (200, 201, 202):
            assert r.n_tokens == 0 and len(r.record) == 16
        if r.doc_id == 301:
            assert R.read_record(bytes(r.record)).tolist() == encoding.encode_ordinary("\U0001f600 été 中文 naïve")
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append((r.offset, r.length))
    for spans in by_shard.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
    assert R.token_records(no_docs(spark)).count() == 0
    named = spark.createDataFrame([("7", "a"), ("x", "b")], "doc_id string, text string")
    assert [r.doc_id for r in R.token_records(named).collect()] == [7, None]
