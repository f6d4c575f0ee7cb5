"""Token-id files: one id array per shard, document boundaries as an Elias-Fano sequence.

Layout of a shard (little endian)::

    magic "EFT1" | u16 id bytes (2 or 4) | u16 zero | u64 documents | u64 ids | u64 null doc ids | i64 least doc id
    | sequence of boundaries | sequence of doc ids | ids

A sequence of n values below u keeps l = floor(log2(u / n)) low bits of each value packed side by side, and the
rest in unary in a bit set of n + (u >> l) + 1 bits: about 2 + log2(u / n) bits a value.  ``select`` samples, one
32-bit position for every 256th set bit, give any boundary with a scan of a few bytes; there is no 64-bit table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import table
from leadloom.llm.tokens import encoder, vocabulary
from leadloom.scratch import Scratch

MAGIC = b"EFT1"
_HEAD = struct.Struct("<4sHHQQQq")
_SEQ = struct.Struct("<QQBxxxI")
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers with random access."""

    def __init__(self, n: int, universe: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.samples, self.low, self.high = n, universe, low_bits, samples, low, high

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        high[ones] = 1
        return cls(n, universe, low_bits, ones[::SAMPLE].astype("<u4"), low, np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return _SEQ.pack(self.n, self.universe, self.low_bits, len(self.samples)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, m = _SEQ.unpack_from(data, at)
        at += _SEQ.size
        samples = np.frombuffer(data, "<u4", m, at)
        at += 4 * m
        low = np.frombuffer(data, np.uint8, (n * low_bits + 7) // 8, at)
        at += len(low)
        high = np.frombuffer(data, np.uint8, (n + (universe >> low_bits) + 1 + 7) // 8, at)
        return cls(n, universe, low_bits, samples, low, high), at + len(high)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """Value i by select: from the nearest sample, count set bits byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bits = start // 8, int(self.high[start // 8]) >> (start % 8) << (start % 8)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return upper
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return upper | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)


class Shard:
    """A shard read from bytes: document i has the ids ids[offset(i):offset(i + 1)]."""

    def __init__(self, data: bytes):
        magic, self.width, _, self.n_docs, self.n_ids, self.n_null, self.least = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        view = memoryview(data)
        self.bounds, at = EliasFano.read(view, _HEAD.size)
        self.docs, at = EliasFano.read(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)

    def offset(self, i: int) -> int:
        return self.bounds[i]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.docs.values() + self.least).tolist()


def shard_bytes(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    """parts: each document's ids as unsigned 32-bit integers; doc_ids ascend, nulls first."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])
    head = _HEAD.pack(MAGIC, width, 0, len(doc_ids), len(ids), len(doc_ids) - len(known), least)
    return head + EliasFano.build(bounds).to_bytes() + EliasFano.build(np.asarray(known, np.int64) - least).to_bytes() + ids.astype(f"<u{width}").tobytes()


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _writer(root: str, path: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _filesystem(root)
        code, end = encoder(path), np.array([end_id], "<u4").tobytes()
        docs, parts, held, k = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, held, k
            data = shard_bytes(docs, parts)
            name = f"{base}/{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}.eft"  # attempts never share a file
            with fs.open_output_stream(name) as out:
                out.write(data)
            row = {"part": [task.partitionId()], "shard": [k], "path": [name], "n_docs": [len(docs)], "n_ids": [held], "n_bytes": [len(data)]}
            docs, parts, held, k = [], [], 0, k + 1
            return pa.record_batch({c: pa.array(v, pa.string() if c == "path" else pa.int64()) for c, v in row.items()})

        fs.create_dir(base, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py()) + end
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield close()
        if docs:
            yield close()

    return write


def write_token_files(docs: DataFrame, root: str, path: str, end_id: int, scratch: Scratch, shard_ids: int = 1 << 21) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards in ascending doc_id order under root.

    Returns the manifest (part, shard, path, n_docs, n_ids, n_bytes, base): base is the number of ids in all
    shards before.  A null text is empty and still gets the end id; null doc ids come first; rows that repeat a
    doc id follow one another.  Only the manifest of tasks that succeeded is kept, so a shard that a lost or
    doubled attempt has left is never read.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    schema = "part long, shard long, path string, n_docs long, n_ids long, n_bytes long"
    manifest = scratch.save(ordered.mapInArrow(_writer(root, path, end_id, shard_ids), schema), "manifest")
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row for each task
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(before, "part").select(*manifest.columns, (F.col("first") + F.col("inside")).alias("base"))


def _reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(root)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as f:
                    shard = Shard(f.read())
                ids, bounds = memoryview(shard.ids.astype("<u4")), shard.bounds.values()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch({"doc_id": pa.array(shard.doc_ids(), pa.int64()), "start": pa.array(bounds[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return read


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' own bytes."""
    shards = max(1, manifest.count())
    dealt = manifest.select("path", "base").repartition(min(shards, 8 * manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return dealt.mapInArrow(_reader(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op10")
    root = scratch.path("shards")
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, root, vocabulary("byte_bpe_50k.json"), 2, scratch)
    return read_token_files(scratch.save(manifest, "based"), root)
