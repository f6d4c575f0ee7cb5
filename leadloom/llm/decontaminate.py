"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be off by k = floor(m * rate) edits.  It is cut into k + 1 pieces; k edits leave at
least one piece intact, so exact piece hits (found together by one automaton) miss nothing.  A hit is verified
up a binary tree over the pieces: of a node with p pieces and fewer than p edits one half again has fewer edits
than pieces, so most chance hits end at a pair of pieces.  Distances are Myers' bit-parallel ones, of the item
against its best substring of the text.

Texts and items are compared lower-cased with every run of other characters than letters and digits as one blank.
An item too short for an edit has to stand between word bounds, so that ``a`` is not found in ``alpha``.
Items are held by the workers in blocks of bounded size; a benchmark with more items takes more passes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import table

#: Edits per character of an item; characters of items in a block.
RATE, BLOCK_CHARS = 0.1, 4_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def myers_find(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(least distance, its first end in text) of pattern against any substring of text, if it is at most k."""
    m = len(pattern)
    if not m:
        return (0, 0)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0) if m <= k else None
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere: no carry into row 0
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j)
    return best


class Items:
    """Benchmark items cut into pieces, and an automaton over all pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items: list[tuple[int, str, int, list[int]]] = []  # id, text, edits, piece bounds
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            k = int(len(text) * rate)
            bounds = [len(text) * p // (k + 1) for p in range(k + 2)]
            for p in range(k + 1):
                places.setdefault(text[bounds[p] : bounds[p + 1]], []).append((len(self.items), p))
            self.items.append((item_id, text, k, bounds))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def _climbs(self, text: str, item: int, piece: int, at: int) -> bool:
        """Whether every node above a piece that is found at a place, short of the root, fits its share of edits."""
        _, pattern, _, bounds = self.items[item]
        lo, hi, path = 0, len(bounds) - 1, []
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        for lo, hi in reversed(path[1:]):
            edits = hi - lo - 1
            begin, end = at - (bounds[piece] - bounds[lo]), at + bounds[hi] - bounds[piece]
            if myers_find(pattern[bounds[lo] : bounds[hi]], text[max(0, begin - edits) : end + edits], edits) is None:
                return False
        return True

    def search(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item id, least distance, end in the normalised text) of every item that occurs within its edits."""
        if self.empty:
            return []
        text = normalise(raw)
        found: dict[int, tuple[int, int]] = {}
        done: dict[tuple[int, int], bool] = {}
        for last, (size, where) in self.automaton.iter(text):
            for item, piece in where:
                at = last + 1 - size
                item_id, pattern, k, bounds = self.items[item]
                if found.get(item, (k + 1,))[0] == 0:
                    continue
                begin = at - bounds[piece]
                if k == 0 and not (text[begin - 1 : begin] in ("", " ") and text[last + 1 : last + 2] in ("", " ")):
                    continue
                if text.startswith(pattern, max(0, begin)) and begin >= 0:
                    found[item] = (0, begin + len(pattern))
                    continue
                if (item, begin) in done or not self._climbs(text, item, piece, at):
                    continue
                done[item, begin] = True
                lo = max(0, begin - k)
                if hit := myers_find(pattern, text[lo : begin + len(pattern) + k], k):
                    found[item] = min(found.get(item, (k + 1, 0)), (hit[0], lo + hit[1]))
        return [(self.items[i][0], d, e) for i, (d, e) in sorted(found.items())]


@functools.lru_cache(maxsize=2)
def _built(items: tuple, rate: float) -> Items:
    return Items(list(items), rate)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[tuple]:
    """The distinct items with a text, nulls first, in blocks of about block_chars characters."""
    items = items.where("text is not null").select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield tuple(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def _matcher(shared, rate: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(shared.value, rate)
        for batch in batches:
            doc, item, distance, end = [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, dist, e in items.search(text.as_py()):
                    doc.append(d)
                    item.append(i)
                    distance.append(dist)
                    end.append(e)
            yield pa.record_batch({"key": pa.array(doc, batch.schema.field(0).type), "item_id": pa.array(item, pa.int64()), "distance": pa.array(distance, pa.int32()), "match_end": pa.array(end, pa.int64())})

    return match


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_id, distance, match_end) for every pair of a row of ``docs(key, text)`` and an item that it holds.

    Null and blank texts and items match nothing; repeated rows repeat their pairs; an item that repeats an id
    is searched once for each text; an item with a null id is searched like any other and gives a null item_id.
    Other columns, whatever their names, are not read.  ``match_end`` is a place in the normalised text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), "text")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item_id long, distance int, match_end long"
    out = None
    for held in _blocks(items, block_chars):
        found = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(held), rate), schema)
        out = found if out is None else out.unionByName(found)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance) for every document and benchmark item that it holds within its edits.

    Null, empty and blank texts and items give no row; repeated documents repeat theirs; an empty table gives none.
    """
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "item_id", "distance")


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds an item; decided row by row, so no key is needed.

    Null and blank texts stay, as do all columns; null and blank items match nothing; null item ids are allowed.
    Items in more than one block are searched one block after the other.
    """
    spark = docs.sparkSession
    for held in _blocks(items, BLOCK_CHARS):
        shared = spark.sparkContext.broadcast(held)

        @F.pandas_udf("boolean")
        def leaks(texts, shared=shared):
            found = _built(shared.value, rate)
            return texts.map(lambda t: bool(found.search(t)))

        docs = docs.where(~leaks("text"))
    return docs
