"""Best-fit packing of documents into token sequences, planned on the histogram of piece lengths.

The plan never sees documents, only how many pieces have each length.  Lengths are put into coarse classes;
patterns of one to four classes that fill a sequence are enumerated, and non-negative least squares finds how
often each is repeated so that the patterns use the histogram up.  Counts are rounded down, every pattern is
realised with exact lengths (its last document fills the sequence to the last token), and what is left is
packed best-fit decreasing into the open sequences and then into new ones, runs of equal sequences at a time.

Pieces then find their places without a global sort: a piece's rank among pieces of its length is its rank in
its task plus the counts of the tasks before, and the plan says which sequence takes that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.common import table
from leadloom.llm.tokens import encoder, vocabulary
from leadloom.scratch import Scratch

LENGTH, CLASSES, MEMBERS = 4096, 64, 4


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| for x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(rounds or 3 * n):
        w = target - gram @ x
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-10 * max(1e-30, float(np.abs(target).max())):
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-30)).min()
            x[at] += step * (s - x[at])
            drop = at[bad & (x[at] <= 1e-12)]
            if not len(drop):
                drop = at[bad][:1]
            x[drop] = 0
            passive[drop] = False
    return x


def patterns(classes: int = CLASSES, members: int = MEMBERS) -> list[tuple[int, ...]]:
    """Multisets of two to ``members`` classes whose middles add up to a sequence, largest first."""
    out = []
    for n in range(2, members + 1):
        for rest in combinations_with_replacement(range(classes, 0, -1), n - 1):
            last = classes + n // 2 - sum(rest)
            if 1 <= last <= rest[-1]:
                out.append((*rest, last))
    return out


class Plan:
    """Sequences as runs: ``runs[i] = (lengths of a sequence's pieces, how many such sequences)``."""

    def __init__(self, histogram: np.ndarray, length: int = LENGTH):
        self.length, self.left = length, np.asarray(histogram, np.int64).copy()
        self.open: list[list[list]] = [[] for _ in range(length + 1)]  # by room left: [lengths, count]
        self.room = np.zeros(length + 1, np.int64)
        self._fit_patterns()
        self._fit_rest()
        self.runs = [(tuple(sorted(t, reverse=True)), n) for entries in self.open for t, n in entries]
        self.runs.sort(key=lambda r: (-len(r[0]), r[0]))

    def _longest(self, lo: int, hi: int) -> int:
        """The longest remaining length in [lo, hi], or 0."""
        lo = max(1, lo)
        if hi < lo:
            return 0
        held = np.flatnonzero(self.left[lo : hi + 1])
        return lo + int(held[-1]) if len(held) else 0

    def _keep(self, lengths: tuple[int, ...], n: int) -> None:
        room = self.length - sum(lengths)
        self.open[room].append([lengths, n])
        self.room[room] += n

    def _fit_patterns(self) -> None:
        g = -(-self.length // CLASSES)
        if self.left[self.length]:
            self._keep((self.length,), int(self.left[self.length]))
            self.left[self.length] = 0
        by_class = np.zeros(CLASSES + 1)
        np.add.at(by_class, -(-np.arange(self.length + 1) // g), self.left)
        total = by_class[1:].sum()
        found = [p for p in patterns() if all(by_class[c] for c in p[:-1])]
        if not total or not found:
            return
        a = np.zeros((CLASSES, len(found)))
        for j, p in enumerate(found):
            for c in p:
                a[c - 1, j] += 1
        x = nnls(a, by_class[1:] / total) * total
        for p, n in sorted(zip(found, np.floor(x + 1e-9).astype(np.int64).tolist(), strict=True), key=lambda f: (-f[0][0], f[0])):
            if n:
                self._realise(p, n, g)

    def _realise(self, pattern: tuple[int, ...], n: int, g: int) -> None:
        segments: list[tuple[tuple[int, ...], int]] = [((), n)]
        for k, c in enumerate(pattern):
            last, longer = k == len(pattern) - 1, []
            for lengths, m in segments:
                room = self.length - sum(lengths)
                while m:
                    held = self._longest(room, room) if last else self._longest((c - 1) * g + 1, min(c * g, room))
                    if not held:
                        for part in lengths:  # nothing fits: these go to the rest
                            self.left[part] += m
                        break
                    take = min(m, int(self.left[held]))
                    self.left[held] -= take
                    m -= take
                    longer.append(((*lengths, held), take))
            segments = longer
        for lengths, m in segments:
            self._keep(lengths, m)

    def _fit_rest(self) -> None:
        for size in range(self.length, 0, -1):
            n, self.left[size] = int(self.left[size]), 0
            while n:
                rooms = np.flatnonzero(self.room[size:])
                if not len(rooms):
                    each = self.length // size
                    if n >= each:
                        self._keep((size,) * each, n // each)
                    if n % each:
                        self._keep((size,) * (n % each), 1)
                    break
                room = size + int(rooms[0])
                lengths, held = self.open[room].pop()
                take = min(n, held)
                if take < held:
                    self.open[room].append([lengths, held - take])
                self.room[room] -= take
                self._keep((*lengths, size), take)
                n -= take

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.runs)

    def places(self) -> dict[str, np.ndarray]:
        """For each run and length in it: length, first rank, first sequence, pieces of it a sequence, first offset; ordered."""
        used = np.zeros(self.length + 1, np.int64)
        rows, first = [], 0
        for lengths, n in self.runs:
            at, i = 0, 0
            while i < len(lengths):
                j = i
                while j < len(lengths) and lengths[j] == lengths[i]:
                    j += 1
                rows.append((lengths[i], used[lengths[i]], first, j - i, at))
                used[lengths[i]] += n * (j - i)
                at += lengths[i] * (j - i)
                i = j
            first += n
        rows.sort()
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        return dict(zip(("length", "rank", "sequence", "each", "offset"), columns, strict=True))


def locate(places: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank among pieces of that length."""
    key = places["length"] * (1 << 48) + places["rank"]
    i = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
    inside = rank - places["rank"][i]
    each = places["each"][i]
    return places["sequence"][i] + inside // each, places["offset"][i] + inside % each * length


def _cutter(path: str, end_id: int, length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, code, end = TaskContext.get().partitionId(), encoder(path), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py()) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[lo : lo + 4 * length]
                    size = len(part) // 4
                    rows.append((doc, piece, lo // 4, size, zlib.crc32(part), task, seen[size]))
                    seen[size] += 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank")
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))

    return cut


def _placer(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = locate(shared.value, length, rank)
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, end_id: int, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece of every row of ``docs(doc_id, text)``.

    A null or empty text is the end id alone.  A document longer than a sequence is cut; other documents stay
    whole.  Repeated rows are packed as often as they come.  No rows give no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, task_rank long"
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(_cutter(path, end_id, length), schema), "pieces")
    by_task = scratch.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "by-task")
    histogram = np.zeros(length + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[r.length] = r.n
    plan = Plan(histogram, length)
    shared = docs.sparkSession.sparkContext.broadcast(plan.places())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(by_task.select("length", "task", before.alias("before")).hint("merge"), ["length", "task"])  # grows with the tasks
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank"))
    return ranked.mapInArrow(_placer(shared), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "op4"))
