"""Near-duplicates by exact similarity of five-word shingles.

SimHash fingerprints of the shingle sets propose links by multi-index hashing (``simhash.wide_links``), all bits of the
fingerprints confirm them (``simhash.whole_links``), and linked sets make a block.  Inside a block every pair that could be similar is compared exactly, by way of the prefixes of the
sets in order of rarity, unless it is linked already.  Texts of the same set are one node and never make pairs.

A block of more than CHUNK sets is cut into chunks of about that size, and each two of its chunks are one task, so that
no task holds more than two chunks however many near copies there are; classes that the tasks find are then joined.  The
work inside one block grows with the square of its distinct texts, as every two that could be similar are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.simhash import pairs_of_chunks, stars, whole_links, wide_fingerprint, wide_links
from leadloom.operators.graph import connected_components
from leadloom.scratch import Scratch

#: Words a shingle; similarity, SHARE[0] / SHARE[1], from which two texts are near copies.
WORDS, SHARE = 5, (4, 5)
SEED = 42
#: Sets in a chunk of a block.
CHUNK = 256


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the k-word shingles of a text with A-Z lower-cased; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def set_name(values: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).astype(np.int64))


def similar_classes(sets: list[np.ndarray]) -> np.ndarray:
    """A label a set: sets linked by pairs of similarity SHARE or more, directly or over others, have the same."""
    up, down = SHARE
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    if n < 2 or not sizes.any():
        return np.zeros(n, np.int64)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    tokens = [np.sort(t) for t in np.split(rank[ids], np.cumsum(sizes)[:-1])]  # rarest first
    seen: dict[int, list[int]] = {}
    has = np.zeros(len(often), bool)
    for i in np.argsort(sizes, kind="stable").tolist():
        mine = tokens[i]
        size = len(mine)
        prefix = mine[: size - -(-up * size // down) + 1].tolist()
        rivals = np.zeros(n, bool)
        for t in prefix:
            rivals[seen.get(t, [])] = True
        rivals &= sizes * down >= size * up
        has[mine] = True
        while (left := np.flatnonzero(rivals & (label != label[i]))).size:
            j = left[0]
            rivals[j] = False
            if int(has[tokens[j]].sum()) * (up + down) >= up * (size + sizes[j]):
                label[label == label[j]] = label[i]
        has[mine] = False
        for t in prefix:
            seen.setdefault(t, []).append(i)
    return label


def _settle(block: pa.Table) -> pa.Table:
    """Each set of a block, or of two of its chunks, with the least set of its class; sets alone in theirs are left out."""
    return stars(block.column("name").to_pylist(), similar_classes([shingle_set(x.as_py()) for x in block.column("text")]).tolist())


def _keyed(at: int):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(at)]
            columns = [*batch.columns, pa.array(map(set_name, sets), pa.int64()), pa.array([wide_fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "name", "fp"])

    return keyed


def similar_sets(sets: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(name, first, component_id) for every set of the written table ``sets(name, first, text, fp)`` that has a near copy.

    component_id is the smallest ``first`` of the sets linked to it, itself included.
    """
    fps = sets.select("name", "fp")
    links = scratch.save(wide_links(fps), "links")
    near = scratch.save(whole_links(fps, scratch.save(connected_components(links, scratch), "loose")), "near")
    blocks = scratch.save(connected_components(near, scratch), "blocks")
    pairs = pairs_of_chunks(sets.select("name", "text"), blocks, chunk)
    tied = scratch.save(pairs.groupBy("root", "one", "two").applyInArrow(_settle, "src long, dst long"), "tied")
    label = scratch.save(connected_components(tied.distinct(), scratch), "labels")
    named = sets.select("name", "first").join(label, F.col("name") == F.col("node")).select("name", "first", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return scratch.save(named.join(least, "root").select("name", "first", "component_id"), "classes")


def keep_one_similar(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """docs with one document of each class of near copies: the one with the smallest doc_id, once.

    Texts without a word, null ones included, are copies of one another.  Rows without a doc_id can't be told apart and
    all stay.  Rows that repeat a doc_id with different texts of one class stay once a text set.  Columns are those of
    docs, whatever their names; no rows give none.

    Whole rows are shuffled once, to the first row of each set; blocks and the result read the buckets that this is written in.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    doc_id, text = (F.col(inner[docs.columns.index(c)]) for c in ("doc_id", "text"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in plain.schema)}, name long, fp array<long>"
    rows = plain.mapInArrow(_keyed(docs.columns.index("text")), schema)
    first = F.min_by(F.struct(*inner), F.struct(doc_id.isNull(), doc_id)).alias("row")
    sets = scratch.save_by(rows.groupBy("name").agg(first, F.first("fp").alias("fp")).select("row.*", "name", "fp"), "name", "sets", "zstd")
    found = similar_sets(sets.select("name", doc_id.alias("first"), text.alias("text"), "fp"), scratch, chunk)
    later = found.where("not first <=> component_id").select("name")
    kept = sets.where(doc_id.isNotNull()).join(later, "name", "left_anti").select(*inner)
    return kept.unionByName(plain.where(doc_id.isNull())).toDF(*docs.columns)
