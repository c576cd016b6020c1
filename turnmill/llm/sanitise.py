"""Information-theoretic sanitisation of protected entities.

Entities are e-mail addresses, telephone, card and IP numbers and secrets found by
pattern; they are always masked. A term t of a document tells of an entity e by
their pointwise mutual information over documents,

    PMI(e; t) = log2(N df(e, t) / (df(e) df(t))),

and discloses it where PMI reaches ``DISCLOSE`` of the entity's own information
log2(N / df(e)). Pairs seen together in fewer than ``SUPPORT`` documents are no
evidence. In the documents that hold e, a disclosing term is generalised to the
class of words that share its first letters (``abc*``), or removed if the class
discloses e as well.

All counts are over all documents. Rows without an entity pass unchanged and never
shuffle; of the rest only what the joins by entity need moves.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import BROADCAST_ROWS, col, free, materialize
from ._text import Words, chunks, doc_terms, mix64, per_text

DISCLOSE, SUPPORT, LETTERS = 0.5, 2, 3
#: Disclosing terms are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
REMOVED = "[REMOVED]"
_CLASS = np.uint64(0xA0761D6478BD642F)

#: Kinds in order of precedence; where two matches overlap, the earlier and then the longer one counts.
ENTITIES = re.compile(
    r"(?P<EMAIL>[A-Za-z0-9_.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<SECRET>\b(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token)\b[\"']?\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}))"
    r"|(?P<IP>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w.]*\d))"
    r"|(?P<PHONE>(?<![\w.])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)|(?<![\w.+])\+\d(?:[ .-]?\d){8,13}(?!\w))"
    r"|(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<CARD>(?<![\w.])(?:\d{4}(?P<sep>[ -])\d{4}(?:(?P=sep)\d{4}){2}|\d{13,19})(?!\w))"
)

KINDS = ("EMAIL", "SECRET", "IP", "PHONE", "SSN", "CARD")


#: First UTF-8 bytes of the non-ASCII digits that ``\d`` takes.
_DIGIT_LEADS = np.isin(np.arange(256), [0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, 0xF0])


def _holds(b: np.ndarray, word: bytes) -> np.ndarray:
    """Where ``word`` starts."""
    at = np.zeros(len(b), bool)
    n = max(0, len(b) - len(word) + 1)
    at[:n] = True
    for i, c in enumerate(word):
        at[:n] &= b[i : i + n] == c
    return at


def _candidates(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that can hold an entity at all, a superset of those that ENTITIES matches.

    An e-mail address has an at sign, numbers have four digits or one beyond
    ASCII, and secrets an assignment, ``_``, ``-``, ``AKIA`` or ``eyJ``.
    """
    digit = (b >= 48) & (b <= 57)
    some = per_text(b == 64, off) > 0
    some |= per_text(digit, off) >= 4
    some |= per_text((b == 61) | (b == 58) | (b == 95) | (b == 45) | _DIGIT_LEADS[b] | _holds(b, b"AKIA") | _holds(b, b"eyJ"), off) > 0
    return np.flatnonzero(some)


def _entity_key(kind: str, found: str) -> int:
    body = found.lower() if kind in ("EMAIL", "IP") else re.sub(r"\D", "", found) if kind in ("PHONE", "CARD", "SSN") else re.sub(r"^.*?[=:]\s*", "", found).strip("\"'")
    w = Words(np.frombuffer(f"{kind}".encode() + body.encode("utf-8").replace(b" ", b"_"), np.uint8), np.array([0, len(kind) + len(body.encode())]))
    h = mix64(np.bitwise_xor.reduce(mix64(w.hash + np.arange(len(w.hash), dtype=np.uint64))).reshape(1))
    return int(h.view(np.int64)[0])


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order."""
    return [(m.start(), m.end(), next(k for k in KINDS if m[k] is not None)) for m in ENTITIES.finditer(text)]


def _classes(w: Words) -> np.ndarray:
    """44-bit class of each word: its first LETTERS bytes, in another hash space than words."""
    pad = np.concatenate((w.folded, np.zeros(LETTERS, np.uint8)))
    v = np.zeros(len(w.starts), np.uint64)
    for i in range(LETTERS):
        v |= np.where(w.starts + i < w.ends, pad[w.starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    return mix64(v ^ _CLASS)


def _document_terms(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, term) of words and word classes."""
    w = Words(b, off)
    doc, term, _ = doc_terms(np.concatenate((w.doc, w.doc)), np.concatenate((w.hash, _classes(w))))
    return doc, term


_SCAN = "kind int, bucket int, entities array<bigint>, blob binary"


def _scan(buckets: int):
    """Rows of kind 0: the entities and terms of one document; kind 1: document counts of terms by bucket."""
    def run(batches):
        for batch in batches:
            kinds, bucket, ents, blobs, counts = [], [], [], [], []
            for first, b, off in chunks(batch.column(0)):
                doc, term = _document_terms(b, off)
                edge = np.searchsorted(doc, np.arange(len(off)))
                counts.append(term)
                for d in _candidates(b, off):
                    text = b[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
                    found = {_entity_key(k, text[s:e]) for s, e, k in find_entities(text)}
                    if found:
                        kinds.append(0), bucket.append(0), ents.append(sorted(found)), blobs.append(term[edge[d] : edge[d + 1]].tobytes())
            if counts:
                term, df = np.unique(np.concatenate(counts), return_counts=True)
                part = (term % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(buckets + 1))
                for p in np.flatnonzero(np.diff(at)):
                    k = order[at[p] : at[p + 1]]
                    # 44 bits of term over 20 of count; a batch has fewer than 2^20 texts
                    kinds.append(1), bucket.append(int(p)), ents.append([]), blobs.append(((term[k] << np.uint64(20)) | df[k].astype(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(bucket, pa.int32()), pa.array(ents, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], ["kind", "bucket", "entities", "blob"])

    return run


def disclosures(docs: DataFrame, *, text_col: str = "text", disclose: float = DISCLOSE, support: int = SUPPORT) -> DataFrame:
    """(entity BIGINT, terms BINARY): the disclosing terms and word classes of each entity, as sorted uint64 hashes."""
    text = docs.where(col(text_col).isNotNull()).select(col(text_col).alias("text"))
    n = docs.count()
    buckets = max(8, n // 16384)
    scan = materialize(text.mapInArrow(_scan(buckets), _SCAN), "terms", "kind")
    held = scan.where("kind = 0").select("entities", "blob")
    df = held.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("df")).where(F.col("df") >= support)
    by = held.select(F.explode("entities").alias("e"), "blob").join(df, "e")

    def pairs(batches):
        """The terms of each document of an entity, apart by bucket."""
        for batch in batches:
            es, dfs, ps, blobs = [], [], [], []
            for e, blob, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                term = np.frombuffer(blob, np.uint64)
                part = (term % np.uint64(buckets)).astype(np.int64)
                for p in np.unique(part):
                    es.append(e), dfs.append(k), ps.append(int(p)), blobs.append(term[part == p].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(dfs, pa.int64()), pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], ["e", "df", "bucket", "blob"])

    each = by.select("e", "blob", "df").mapInArrow(pairs, "e bigint, df bigint, bucket int, blob binary")

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, bytes]] = []
        if len(right):
            raw = np.concatenate([np.frombuffer(x, np.uint64) for x in left["blob"]])
            term, back = np.unique(raw >> np.uint64(20), return_inverse=True)
            count = np.bincount(back, (raw & np.uint64((1 << 20) - 1)).astype(float))
            for e, part in right.groupby("e"):
                t, both = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in part["blob"]]), return_counts=True)
                t, both = t[both >= support], both[both >= support]
                of = float(part["df"].iloc[0])
                if len(t):
                    pmi = np.log2(n * both / (of * count[np.searchsorted(term, t)]))
                    bad = t[pmi >= disclose * np.log2(n / of)] if n > of else t[:0]
                    if len(bad):
                        out.append((int(e), bad.tobytes()))
        return pd.DataFrame({"e": pd.Series([e for e, _ in out], dtype="int64"), "terms": [t for _, t in out]})

    told = scan.where("kind = 1").select("bucket", "blob").groupBy("bucket").cogroup(each.groupBy("bucket")).applyInPandas(judge, "e bigint, terms binary")
    return told.groupBy("e").agg(F.array_join(F.sort_array(F.collect_list(F.hex("terms"))), "").alias("terms")).select(F.col("e").alias("entity"), F.unhex("terms").alias("terms"))


def sanitise_text(text: str, told: np.ndarray) -> tuple[str, int, int, int]:
    """(sanitised, masked, generalised, removed): entities masked, then words among ``told`` (sorted term and class hashes)."""
    spans = [(s, e, f"[{k}]") for s, e, k in find_entities(text)]
    masked, general, removed = len(spans), 0, 0
    if len(told):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        w = Words(raw, np.array([0, len(raw)]))
        hit = np.isin(w.hash >> np.uint64(20), told)
        if hit.any():
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            whole = np.isin(_classes(w) >> np.uint64(20), told)
            taken = [(s, e) for s, e, _ in spans]
            k = 0
            for i in np.flatnonzero(hit):
                s, e = int(chars[w.starts[i]]), int(chars[w.ends[i]])
                while k < len(taken) and taken[k][1] <= s:
                    k += 1
                if k < len(taken) and taken[k][0] < e:
                    continue
                lead = raw[w.starts[i] : w.ends[i]][:LETTERS].tobytes().decode("utf-8", "ignore")
                if whole[i] or len(lead) == e - s:
                    spans.append((s, e, REMOVED))
                    removed += 1
                else:
                    spans.append((s, e, lead + "*"))
                    general += 1
            spans.sort()
    out, at = [], 0
    for s, e, by in spans:
        out += (text[at:s], by)
        at = e
    out.append(text[at:])
    return "".join(out), masked, general, removed


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", disclose: float = DISCLOSE, support: int = SUPPORT) -> DataFrame:
    """Every row with its text sanitised, and ``n_masked``, ``n_generalised``, ``n_removed``; other columns unchanged.

    The three counts are appended; input columns of those names are replaced.
    Null and empty texts stay as they are, counts 0. Repeated rows are separate
    documents in all counts and each is sanitised. Ids play no part. An empty table gives an empty
    table. The result doesn't depend on the order of rows.
    """
    counts = ["n_masked", "n_generalised", "n_removed"]
    columns = [c for c in docs.columns if c.lower() not in counts]
    told = materialize(disclosures(docs, text_col=text_col, disclose=disclose, support=support), "disclosures")
    ents, row, rid, e, told_e, terms = free(docs, "entities", "row", "rid", "entity", "told", "terms")

    def found(text: pa.Array) -> pa.Array:
        edge, flat = np.zeros(len(text) + 1, np.int32), []
        for first, b, off in chunks(text):
            for d in _candidates(b, off):
                s = b[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
                keys = sorted({_entity_key(k, s[i:j]) for i, j, k in find_entities(s)})
                edge[first + d + 1] = len(keys)
                flat += keys
        return pa.ListArray.from_arrays(np.cumsum(edge).astype(np.int32), pa.array(flat, pa.int64()))

    def clean(text: pa.Array, told: pa.Array) -> pa.Array:
        made = [sanitise_text(t, np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in k])) if k else np.zeros(0, np.uint64)) for t, k in zip(text.to_pylist(), told.to_pylist())]
        parts = list(zip(*made)) if made else [[], [], [], []]
        return pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), *[pa.array(p, pa.int32()) for p in parts[1:]]], ["text", *counts])

    marked = docs.select(*[col(c) for c in columns]).withColumn(ents, F.arrow_udf(found, "array<bigint>")(F.coalesce(col(text_col), F.lit(""))))
    zero = [F.lit(0).cast("int").alias(c) for c in counts]
    through = marked.where(F.size(ents) == 0).select(*[col(c) for c in columns], *zero)
    # the rows with entities are written once; only (row number, entity) meets the disclosures, and a text moves at most once
    hold = marked.where(F.size(ents) > 0).select(F.struct(*[col(c) for c in columns]).alias(row), F.col(ents))
    hold = materialize(hold.withColumn(rid, F.monotonically_increasing_id()), "held")
    pairs = hold.select(rid, F.explode(ents).alias(e)).join(told.select(F.col("entity").alias(told_e), F.col("terms").alias(terms)), F.col(e) == F.col(told_e))
    known = materialize(pairs.groupBy(rid).agg(F.collect_list(terms).alias(terms)), "told")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t))), F.lit(0))).first()
    back = hold.join(F.broadcast(known) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else known, rid, "left")
    done = back.withColumn(ents, F.arrow_udf(clean, "struct<text:string,n_masked:int,n_generalised:int,n_removed:int>")(F.col(row).getField(text_col), F.col(terms)))
    values = [F.col(ents).getField("text").alias(c) if c == text_col else F.col(row).getField(c).alias(c) for c in columns]
    return through.union(done.select(*values, *[F.col(ents).getField(c).alias(c) for c in counts]))
