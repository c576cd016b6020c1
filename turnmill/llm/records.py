"""Token ids as length-delimited binary records.

A record is framed as: length (8 bytes, little-endian), masked CRC-32C of those 8
bytes (4), payload, masked CRC-32C of the payload (4). The payload holds token ids
as little-endian uint16, or uint32 where the vocabulary needs it. Every input
partition makes one shard; each record's file, offset and length go to an index of its
own, so that records can be read in any order.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from ._spark import col
from ._text import _MUL, chunks, mix64

#: A rank file: one base64 token and its rank a line. Its path is a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MASK_DELTA = 0xA282EAD8
INDEX = "doc_id bigint, shard int, offset bigint, length bigint, n_tokens bigint"
_COLUMNS = ["doc_id", "shard", "offset", "length", "n_tokens"]
_BLOCK = 256
_CACHE = 400_000


def _crc_tables() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    tables = [t]
    for _ in range(7):
        p = tables[-1]
        tables.append((p >> 8) ^ t[p & 255])
    return np.array(tables)


_T = _crc_tables()


def _zeros_operator(length: int) -> np.ndarray:
    """(4, 256) tables: what ``length`` zero bytes make of a CRC register, by its four bytes."""
    reg = np.left_shift(np.arange(256, dtype=np.uint32)[None, :], np.arange(4, dtype=np.uint32)[:, None] * 8)
    for _ in range(length):
        reg = (reg >> 8) ^ _T[0][reg & 255]
    return reg


_SHIFT = _zeros_operator(_BLOCK)


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte ranges at once.

    Each range is taken as whole blocks after a head of its odd bytes; all blocks
    of all ranges advance together, eight bytes a step, and are then chained.
    """
    n = len(starts)
    reg = np.full(n, 0xFFFFFFFF, np.uint32)
    head = lengths % _BLOCK
    order = np.argsort(-head, kind="stable")
    sorted_head = -head[order]
    for k in range(int(head.max(initial=0))):  # heads: byte by byte, ranges that still have one
        live = order[: int(np.searchsorted(sorted_head, -k, "left"))]
        reg[live] = (reg[live] >> 8) ^ _T[0][(reg[live] ^ data[starts[live] + k]) & 255]
    blocks = lengths // _BLOCK
    total = int(blocks.sum())
    if total:
        first = np.concatenate(([0], np.cumsum(blocks)))
        at = np.repeat(starts + head - first[:-1] * _BLOCK, blocks) + np.arange(total) * _BLOCK
        part = np.zeros(total, np.uint32)
        for k in range(0, _BLOCK, 8):
            c = [data[at + k + i].astype(np.uint32) for i in range(8)]
            part = (
                _T[7][(part ^ c[0]) & 255] ^ _T[6][((part >> 8) ^ c[1]) & 255] ^ _T[5][((part >> 16) ^ c[2]) & 255]
                ^ _T[4][((part >> 24) ^ c[3]) & 255] ^ _T[3][c[4]] ^ _T[2][c[5]] ^ _T[1][c[6]] ^ _T[0][c[7]]
            )
        order = np.argsort(-blocks, kind="stable")
        sorted_blocks = -blocks[order]
        for k in range(int(blocks.max())):
            live = order[: int(np.searchsorted(sorted_blocks, -k, "left"))]
            r = reg[live]
            reg[live] = _SHIFT[0][r & 255] ^ _SHIFT[1][(r >> 8) & 255] ^ _SHIFT[2][(r >> 16) & 255] ^ _SHIFT[3][r >> 24] ^ part[first[live] + k]
    return reg ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that is safe to store beside the data it covers."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def crc32c_bytes(data: bytes) -> int:
    return int(crc32c(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


class Tokenizer:
    """Byte-level BPE that encodes each distinct piece between white spaces once a task.

    The pre-tokenizer's pieces never span a change from non-space to space, so a
    text is the concatenation of its pieces' encodings. Texts with white space
    beyond ASCII are encoded in one go.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.encoding = tiktoken.Encoding("records", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2") if max(ranks.values()) < 1 << 16 else np.dtype("<u4")
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.length = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of the texts of a chunk."""
        space = (b == 32) | ((b >= 9) & (b <= 13))
        odd = self._odd_texts(b, off)
        starts = self._starts(b, space, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        lens = np.diff(np.append(starts, len(b)))
        pos = np.arange(len(b)) - np.repeat(starts, lens)
        h = mix64(np.add.reduceat(_MUL[pos & 255] * (b.astype(np.uint64) + np.uint64(1)), starts) ^ lens.astype(np.uint64))
        self._learn(h, starts, lens, b)
        k = np.searchsorted(self.known, h)
        doc = np.searchsorted(off, starts, "right") - 1
        size = self.length[k]
        if odd.any():
            size = np.where(odd[doc], 0, size)
        first = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(self.first[k] - first[:-1], size) + np.arange(first[-1])]
        counts = np.bincount(doc, size, len(off) - 1).astype(np.int64)
        if odd.any():
            edge, parts = np.concatenate(([0], np.cumsum(counts))), []
            for d in range(len(off) - 1):
                if odd[d]:
                    one = np.array(self.encoding.encode_ordinary(b[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                    counts[d] = len(one)
                    parts.append(one)
                else:
                    parts.append(ids[edge[d] : edge[d + 1]])
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _odd_texts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts that may hold white space or separators beyond ASCII's six."""
        bad = (b >= 28) & (b <= 31)
        if len(b) > 1:
            bad[:-1] |= (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
        if len(b) > 2:
            x, y = b[:-2], b[1:-1]
            bad[:-2] |= ((x == 0xE1) & (y == 0x9A)) | ((x == 0xE2) & ((y == 0x80) | (y == 0x81))) | ((x == 0xE3) & (y == 0x80))
        total = np.concatenate(([0], np.cumsum(bad)))
        return total[off[1:]] > total[off[:-1]]

    @staticmethod
    def _starts(b: np.ndarray, space: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of pieces: a run of spaces but its last, that last (with the word after it if it is a blank), words."""
        n = len(b)
        if not n:
            return np.zeros(0, np.int64)
        begin, end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        begin[off[:-1]] = True
        end[off[1:]] = True
        before, after = np.ones(n, bool), np.ones(n, bool)  # is the neighbour a space; texts end in one
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        ends = end[1:]
        last = space & ~after & ~ends  # the last of a run that a word follows
        start = begin[:n] | (space & ~before) | last
        start |= ~space & before & ~np.concatenate(([False], (last & (b == 32))[:-1]))
        return np.flatnonzero(start)

    def _learn(self, h: np.ndarray, starts: np.ndarray, lens: np.ndarray, b: np.ndarray) -> None:
        new, at = np.unique(h, return_index=True)
        if len(self.known):
            k = np.minimum(np.searchsorted(self.known, new), len(self.known) - 1)
            fresh = self.known[k] != new
            if len(self.known) + fresh.sum() > _CACHE:
                self.clear()
            else:
                new, at = new[fresh], at[fresh]
        if not len(new):
            return
        raw = b.tobytes()
        enc = self.encoding.encode_ordinary
        got = [enc(raw[s : s + n].decode("utf-8", "replace")) for s, n in zip(starts[at].tolist(), lens[at].tolist())]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))
        first = len(self.ids) + np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.ids = np.concatenate((self.ids, flat))
        known = np.concatenate((self.known, new))
        order = np.argsort(known, kind="stable")
        self.known, self.length, self.first = known[order], np.concatenate((self.length, size))[order], np.concatenate((self.first, first))[order]


def frame(payload: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The framed records of consecutive payloads of ``sizes`` bytes, and each record's offset."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    n = len(sizes)
    head = sizes.astype("<u8").view(np.uint8)
    head_crc = masked(crc32c(head, np.arange(n) * 8, np.full(n, 8)))
    body_crc = masked(crc32c(payload, starts, sizes))
    at = starts + np.arange(n) * 16
    out = np.empty(len(payload) + 16 * n, np.uint8)
    eight, four = np.arange(8), np.arange(4)
    out[at[:, None] + eight] = head.reshape(n, 8)
    out[at[:, None] + 8 + four] = head_crc.astype("<u4").view(np.uint8).reshape(n, 4)
    out[(at + 12 + sizes)[:, None] + four] = body_crc.astype("<u4").view(np.uint8).reshape(n, 4)
    out[np.arange(len(payload)) + np.repeat(at + 12 - starts, sizes)] = payload
    return out.tobytes(), at


def token_records(docs: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One framed record a row: (doc_id, shard, offset, length, n_tokens, record).

    A shard is an input partition, ``offset`` the record's place in it, ``length``
    that of the whole frame. A null or empty text gives a record of no tokens;
    repeated rows give a record each; a null id stays null, and an id that is no
    BIGINT becomes null. An empty table gives no records. The driver reads the
    vocabulary and sends it to the tasks.
    """
    ranks = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for ids, counts, data, at in _framed(batches, ranks.value):
            edge = np.append(at, len(data)).astype(np.int32)
            record = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edge), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*_index(ids, counts, at, len(data), place), record], [*_COLUMNS, "record"])
            place += len(data)

    return _thin(docs, id_col, text_col).mapInArrow(run, f"{INDEX}, record binary")


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # a file of fixed size


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).try_cast("bigint").alias("doc_id"), col(text_col).alias("text"))


def _framed(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[tuple[pa.Array, np.ndarray, bytes, np.ndarray]]:
    """(ids, tokens a record, framed records, their offsets) of runs of rows."""
    tok = None
    for batch in batches:
        for first, b, off in chunks(batch.column(1)):
            tok = tok or Tokenizer(ranks)
            tokens, counts = tok.encode(b, off)
            data, at = frame(tokens.astype(tok.dtype).view(np.uint8), counts * tok.dtype.itemsize)
            yield batch.column(0).slice(first, len(counts)), counts, data, at


def _index(ids: pa.Array, counts: np.ndarray, at: np.ndarray, size: int, place: int) -> list[pa.Array]:
    shard = np.full(len(counts), TaskContext.get().partitionId(), np.int32)
    return [ids, pa.array(shard), pa.array(at + place), pa.array(np.diff(np.append(at, size))), pa.array(counts)]


def write_records(docs: DataFrame, path: str, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard files of records under ``path``, and apart from them the index ``path/index``, which is returned.

    Each task writes its shard to a file of its own name, so that tasks that are
    lost or run twice don't meet, and further writes to the same folder add to it.
    The index (doc_id, shard, offset, length, n_tokens, file) is committed once all
    tasks are done and names only files of tasks that counted; others are litter.
    Odd rows are as in ``token_records``; a shard without rows has no file.
    """
    spark = docs.sparkSession
    ranks = _vocabulary(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, name = None, 0, f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        try:
            for ids, counts, data, at in _framed(batches, ranks.value):
                out = out or _create(path, name)
                out.write(data)
                yield pa.RecordBatch.from_arrays([*_index(ids, counts, at, len(data), place), pa.array([name] * len(counts))], [*_COLUMNS, "file"])
                place += len(data)
        finally:
            if out:
                out.close()

    _thin(docs, id_col, text_col).mapInArrow(run, f"{INDEX}, file string").write.mode("append").parquet(f"{path}/index")
    return read_index(spark, path)


def _create(path: str, name: str):
    """A new file in a folder that all executors share."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    system.create_dir(root, recursive=True)
    return system.open_output_stream(f"{root}/{name}")


def read_record(data: bytes, wide: bool = False) -> np.ndarray:
    """The token ids of one frame; ValueError if a length or checksum is wrong."""
    (size,), (head_crc,) = struct.unpack("<Q", data[:8]), struct.unpack("<I", data[8:12])
    if head_crc != int(masked(np.array([crc32c_bytes(data[:8])], np.uint32))[0]) or len(data) != size + 16:
        raise ValueError("damaged length")
    body = data[12 : 12 + size]
    if struct.unpack("<I", data[12 + size :])[0] != int(masked(np.array([crc32c_bytes(body)], np.uint32))[0]):
        raise ValueError("damaged payload")
    return np.frombuffer(body, "<u4" if wide else "<u2")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{INDEX}, file string").parquet(f"{path}/index")
