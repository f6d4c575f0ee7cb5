"""SimHash near-duplicates by multi-index hashing.

Distinct fingerprints are cut into two 32-bit segments.  Two fingerprints within two bits differ in at most one
bit of some segment, so each fingerprint looks up its segments' Hamming balls of radius one in the table of
segments.  Of two segments one bit apart only the one with the bit unset probes, which halves the probes and
finds each pair once a segment.  Whole distances are then verified inside the join.  Copies share a fingerprint
and never make pairs; pairs in a bucket are bounded by the distinct fingerprints that share 32 bits.

Texts of a wider similarity differ in too many of 64 bits for that.  For them ``wide_fingerprint`` has 12 or 24 words,
and ``wide_links`` cuts it into 24-bit segments, searched in Hamming balls of radius two: two values within two bits have
one of their three bytes in common, so a value goes to a bucket a byte, where all pairs are compared.  The distance of the
fingerprints is verified in the bucket over their first 128 bits.  Links by chance join many of the components that this
makes, the more the larger the table is, so ``whole_links`` compares the fingerprints of a component by all their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import table
from leadloom.operators.graph import connected_components
from leadloom.scratch import Scratch

SEED, RADIUS = 42, 2
#: Words of a wide fingerprint, and shingles up to which it has twice as many, as few shingles make unsteady bits.
WIDE, FEW = 12, 40
#: Bits in which wide fingerprints may differ, in one segment and in the first 128.  Sets of similarity 0.8 differ in 15 %
#: of the bits, so all segments miss a pair once in 20,000; unrelated ones differ in half the bits.
BALL, WHOLE = 2, 40
#: One in so many of all common bits may differ.  Pairs of similarity 0.8 differ in 12 of 64 at most on average (sizes 4 and 5;
#: over 40 shingles in 10), so that a quarter is 6 deviations (7) away.  Fingerprints in a chunk of a component.
QUARTER, CHUNK = 4, 32_768
_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, 2 * WIDE, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, 2 * WIDE, dtype=np.uint64) | np.uint64(1)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash of the k-word shingles of a text with A-Z lower-cased; 0 where there is no word.

    A bit is set where more than half of the shingles' XXH64 values, repeats included, have it set.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    n = max(1, len(words) - k + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 4096):
        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed integer."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments(fp: Column) -> Column:
    return F.array(F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def near_links(distinct: DataFrame) -> DataFrame:
    """(src, dst), src < dst or either order, for all pairs of ``distinct(fp)`` at 1 or 2 differing bits."""
    segs = distinct.select("fp", F.posexplode(_segments(F.col("fp"))).alias("seg", "part"))
    home = segs.select("seg", F.col("part").alias("key"), F.col("fp").alias("dst"))
    # -1 stands for the segment itself; bits 0 to 31 are flips of an unset bit
    ball = F.expr("transform(filter(sequence(-1, 31), b -> b < 0 OR (shiftright(part, b) & 1L) = 0), b -> struct(b AS flip, IF(b < 0, part, part | shiftleft(1L, b)) AS key))")
    probes = segs.select("seg", F.col("fp").alias("src"), F.inline(ball))
    near = (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= RADIUS) & F.when(F.col("flip") < 0, F.col("src") < F.col("dst")).otherwise(F.lit(True))
    return probes.join(home, (probes.seg == home.seg) & (probes.key == home.key) & near).select("src", "dst")


def wide_fingerprint(values: np.ndarray) -> np.ndarray:
    """SimHash over a set of distinct 64-bit shingle hashes: a bit is set where more than half of their mixes have it set."""
    words = WIDE if len(values) > FEW else 2 * WIDE
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(values), 1024):
        mixed = (values[lo : lo + 1024, None] ^ _XOR[:words]) * _TIMES[:words]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _TIMES[0]
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(values), bitorder="little").view("<u8")


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a byte of each segment: its bucket, the segment's other bytes, the name and the first 128 bits."""
    for batch in batches:
        names, size = batch.column(0).to_numpy(), np.array([len(x) for x in batch.column(1)])
        for words in np.unique(size).tolist():
            at = np.flatnonzero(size == words)
            for lo in range(0, len(at), 256):
                own = at[lo : lo + 256]
                fp = np.array(batch.column(1).take(pa.array(own)).to_pylist(), "<i8")
                seg = fp.view(np.uint8).reshape(len(own), -1, 3).astype(np.int32)
                places = np.arange(seg.shape[1], dtype=np.int32) * 3
                for k in range(3):
                    columns = {"bucket": (places + k) * 256 + seg[:, :, k], "rest": seg[:, :, k - 2] * 256 + seg[:, :, k - 1]}
                    columns |= {c: np.repeat(v, seg.shape[1]) for c, v in (("name", names[own]), ("a", fp[:, 0]), ("b", fp[:, 1]))}
                    yield pa.record_batch({c: pa.array(v.ravel()) for c, v in columns.items()})


def _forest(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star a component of the edges between 0 and n."""
    label = np.arange(n)
    while (label[src] != label[dst]).any():
        least = np.minimum(label[src], label[dst])
        for end in (src, dst):
            np.minimum.at(label, label[end], least)
        while (label != label[label]).any():
            label = label[label]
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


def bucket_links(rest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that connect all pairs of a bucket within BALL bits of the segment and WHOLE of the first 128."""
    n, step, found = len(rest), 256, []
    for lo in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(rest[lo : lo + step, None] ^ rest[None, lo:]) <= BALL)
        i, j = i[i < j] + lo, j[i < j] + lo
        near = np.bitwise_count(first[i] ^ first[j]).sum(1, dtype=np.int64) <= WHOLE
        found.append(np.stack(_forest(i[near], j[near], n)) if near.any() else np.zeros((2, 0), np.int64))
    return _forest(*np.concatenate(found, axis=1), n)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of rows in order of their buckets; a bucket that may go on in the next batch is kept back."""
    def links(bucket, rest, name, a, b):
        first, bounds = np.stack([a, b], axis=1).view(np.uint64), np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo > 1:
                src, dst = bucket_links(rest[lo:hi], first[lo:hi])
                if len(src):
                    out.append(np.stack([name[lo:hi][src], name[lo:hi][dst]]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    held: list[tuple] = []
    kinds = (np.int32, np.uint16, np.int64, np.int64, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        new = tuple(c.to_numpy().astype(t) for c, t in zip(batch.columns, kinds, strict=True))
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or (held and held[-1][0][-1] != new[0][0]):
            done = [np.concatenate([*(h[k] for h in held), new[k][:cut]]) for k in range(len(kinds))]
            src, dst = links(*done)
            yield pa.record_batch({"src": pa.array(np.minimum(src, dst)), "dst": pa.array(np.maximum(src, dst))})
            held = []
        held.append(tuple(c[cut:] for c in new))
    if held:
        src, dst = links(*(np.concatenate([h[k] for h in held]) for k in range(len(kinds))))
        yield pa.record_batch({"src": pa.array(np.minimum(src, dst)), "dst": pa.array(np.maximum(src, dst))})


def wide_links(sets: DataFrame) -> DataFrame:
    """(src, dst) that connect all rows of ``sets(name, fp)`` whose wide fingerprints are near, as ``bucket_links`` has it."""
    routed = sets.select("name", "fp").mapInArrow(_routed, "bucket int, rest int, name long, a long, b long")
    return routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_linked, "src long, dst long").distinct()


def whole_classes(fps: list[np.ndarray]) -> np.ndarray:
    """A label a wide fingerprint: near ones, by WHOLE and QUARTER, have the same, directly or over others."""
    n = len(fps)
    words = np.array([len(fp) for fp in fps])
    bits = np.zeros((n, 2 * WIDE), np.uint64)
    for size in np.unique(words).tolist():
        at = np.flatnonzero(words == size)
        bits[at, :size] = np.stack([fps[i] for i in at.tolist()])
    a, b = bits[:, 0].copy(), bits[:, 1].copy()
    label = np.arange(n)
    for i in range(n - 1):
        near = np.bitwise_count(a[i + 1 :] ^ a[i]) + np.bitwise_count(b[i + 1 :] ^ b[i]) <= WHOLE
        at = np.flatnonzero(near & (label[i + 1 :] != label[i])) + i + 1
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            common = np.minimum(words[some], words[i])
            differ = np.bitwise_count(bits[some] ^ bits[i]) * (np.arange(2 * WIDE) < common[:, None])
            found = np.unique(label[some[differ.sum(1, dtype=np.int64) * QUARTER <= 64 * common]])
            if len(found):
                label[np.isin(label, found)] = label[i]
    return label


def stars(names: list[int], label: list[int]) -> pa.Table:
    """(src, dst) from the least name of each label to its others."""
    least: dict[int, int] = {}
    for name, k in zip(names, label, strict=True):
        least[k] = min(name, least.get(k, name))
    tied = [(least[k], name) for name, k in zip(names, label, strict=True) if least[k] != name]
    return pa.table({"src": pa.array([a for a, _ in tied], pa.int64()), "dst": pa.array([b for _, b in tied], pa.int64())})


def _whole(part: pa.Table) -> pa.Table:
    fps = [np.array(fp, np.int64).view(np.uint64) for fp in part.column("fp").to_pylist()]
    return stars(part.column("name").to_pylist(), whole_classes(fps).tolist())


def pairs_of_chunks(members: DataFrame, blocks: DataFrame, chunk: int) -> DataFrame:
    """Rows of ``members(name, ...)`` that are in ``blocks(node, root)``, once for each two chunks (root, one, two) they are in.

    A block of more than ``chunk`` rows is cut into chunks of about that size; any two of its rows share a pair of chunks.
    """
    chunks = blocks.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = blocks.join(chunks, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    found = members.join(dealt, F.col("name") == F.col("node")).select("root", "mine", other, *members.columns)
    return found.select("root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), *members.columns)


def whole_links(sets: DataFrame, blocks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) that connect, inside each of ``blocks(node, root)``, all rows of ``sets(name, fp)`` that ``whole_classes`` finds near."""
    return pairs_of_chunks(sets, blocks, chunk).groupBy("root", "one", "two").applyInArrow(_whole, "src long, dst long").distinct()


def classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(class_fp, component_id) for every distinct fp of the written table ``rows(doc_id, fp)``."""
    distinct = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = scratch.save(connected_components(near_links(distinct.select("fp")), scratch), "labels")
    firsts = distinct.join(label, distinct.fp == label.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return scratch.save(firsts.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id"), "classes")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at most two bits, itself included.  Null and
    empty texts have fingerprint zero and link like any other; null doc ids are rows but never the smallest;
    repeated rows are returned as often as they are given.
    """
    rows = scratch.save(fingerprints(docs), "fingerprints")
    found = classes(rows, scratch)
    return rows.join(found, rows.fp == found.class_fp).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class, as ``near_duplicates`` gives them."""
    out = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one document of each near-duplicate class: the one with the smallest doc_id, once.

    Rows without a doc_id can't be told apart and all stay; rows that repeat a doc_id with different texts of one class
    stay once a fingerprint.  Columns are those of docs, whatever their names.  The texts are fingerprinted once and
    shuffled once.
    """

    @F.pandas_udf("long")
    def simhash(texts):
        return texts.map(lambda t: int(np.uint64(fingerprint(t)).astype(np.int64)))

    inner = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (inner[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = scratch.save(docs.toDF(*inner).withColumn("fp", simhash(text)), "documents", "zstd")
    found = classes(rows.select(F.col(doc_id).alias("doc_id"), "fp"), scratch)
    keep = found.where("component_id is not null").select(F.col("component_id").alias(doc_id), F.col("class_fp").alias("fp"))
    kept = rows.join(keep, [doc_id, "fp"], "left_semi").dropDuplicates([doc_id, "fp"])
    return kept.unionByName(rows.where(F.col(doc_id).isNull())).select(*inner).toDF(*docs.columns)
