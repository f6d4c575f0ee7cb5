"""Language identification by nearest centroids.

A text becomes hashed counts of the 1-, 2- and 3-grams of bytes of its letters (runs of letters, lower-cased and
joined by blanks), dampened, weighted by inverse document frequency over all labelled texts and scaled to unit
length.  Each language has several centroids, found by spherical k-means on a bounded sample of labelled rows.
The language of the centroid with the largest cosine is predicted; a text whose cosine lies far below what
labelled texts of its length reach is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import table

#: Hashed dimensions, labelled rows a language that centroids are fitted on, centroids a language, languages that are
#: learned: those with the most labelled rows, so that a dirty label column costs neither the run nor the driver.
DIMENSIONS, SAMPLE, CENTROIDS, LANGUAGES = 8192, 400, 3, 200
#: A text is rejected below this share of the least cosine that sampled texts of its length class have had; short
#: texts, below 2 ** SHORT n-grams, vary much more and need to lie further off.
SLACK, SHORT_SLACK, SHORT = 0.6, 0.25, 10
#: Floors above this are cut to it: few sampled texts of a length class say little about how far others may lie.
HIGHEST_FLOOR = 0.5
_GAP = re.compile(r"[\W\d_]+")
_CLASSES = 24  # length classes: log2 of the number of n-grams, at most this


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of a whole text; both are empty where it has no letter."""
    joined = _GAP.sub(" ", (text or "").lower()).strip()
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(f" {joined} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    pair = b[:-1] << 8 | b[1:]
    triple = pair[:-1] << 8 | b[2:]
    hashed = [(code * np.uint32(mult)) >> np.uint32(19) for code, mult in ((b[1:-1] + np.uint32(7), 2654435761), (pair, 2246822519), (triple, 3266489917))]
    full = np.bincount(np.concatenate(hashed), minlength=DIMENSIONS)
    dims = np.flatnonzero(full)
    return dims, full[dims]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Model:
    """idf by dimension, unit centroids with their languages, and the least cosine by length class."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray

    def vector(self, text: str | None) -> np.ndarray:
        return weigh(*counts(text), self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; ``und``, 0 and true without a letter or without a model."""
        rows = [counts(t) if has_letter(t) else (np.zeros(0, np.int64),) * 2 for t in texts]
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        x = np.stack([weigh(d, c, self.idf) for d, c in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
        cosine = x @ self.centroids.T
        best = cosine.argmax(1) if len(rows) else []
        out = []
        for i, text in enumerate(texts):
            if not has_letter(text):
                out.append(("und", 0.0, True))
                continue
            score = float(min(1.0, max(0.0, cosine[i, best[i]])))
            size = length_class(rows[i][1])
            out.append((self.langs[best[i]], score, score < (SHORT_SLACK if size <= SHORT else SLACK) * self.floor[size]))
        return out


def length_class(n: np.ndarray) -> int:
    return min(_CLASSES, int(n.sum()).bit_length())


def weigh(dims: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.float32)
    out[dims] = (1 + np.log(n)) * idf[dims] if len(dims) else 0
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids, from a farthest-first start; fewer where rows coincide."""
    picked = [int((x @ x.mean(0)).argmax())]
    while len(picked) < min(k, len(x)):
        nearest = (x @ x[picked].T).max(1)
        if nearest.min() > 1 - 1e-6:
            break
        picked.append(int(nearest.argmin()))
    c = x[picked]
    for _ in range(rounds):
        side = (x @ c.T).argmax(1)
        c = np.stack([x[side == j].mean(0) if (side == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            dims, _ = counts(text.as_py())
            total[dims] += 1
            n += 1
    dims = np.flatnonzero(total)
    if n:
        yield pa.record_batch({"dim": pa.array(np.concatenate([[-1], dims]), pa.int64()), "n": pa.array(np.concatenate([[n], total[dims]]), pa.int64())})


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t.as_py()) for t in batch.column(1)]
        yield pa.record_batch({"lang": batch.column(0), "dims": pa.array([d.astype("<u2").tobytes() for d, _ in found], pa.binary()), "n": pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labelled(text, lang, key)``; rows with a null text or lang teach nothing.

    Frequencies cover every row.  Centroids and floors are fitted on about ``sample`` rows a language, whatever the
    table's size: those whose 63-bit hash of key and text lies below the share that so many rows are, each once.  The
    LANGUAGES languages with the most rows are learned, by name where equal; the driver holds no more.
    """
    labelled = labelled.where("text is not null and lang is not null")
    df = labelled.select("text").mapInArrow(_document_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    freq = {r.dim: r.n for r in df}
    total = freq.pop(-1, 0)
    idf = np.full(DIMENSIONS, np.log(1 + total), np.float32)
    for dim, n in freq.items():
        idf[dim] = np.log((1 + total) / (1 + n)) + 0.05
    share = F.create_map(*(F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, sample / n)))) if sizes else None
    rows: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    if sizes:
        place = F.shiftrightunsigned(F.xxhash64("key", "text"), 1)
        below = F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)) * float(1 << 63)
        chosen = labelled.select("lang", "text", place.alias("place")).where(F.col("place") < below).dropDuplicates(["lang", "place"])
        for r in chosen.select("lang", "text").mapInArrow(_sample_counts, "lang string, dims binary, n binary").collect():
            if r.dims:
                rows.setdefault(r.lang, []).append((np.frombuffer(r.dims, "<u2").astype(np.int64), np.frombuffer(r.n, "<u4").astype(np.int64)))
    centroids, langs, floor = [], [], np.ones(_CLASSES + 1)
    for lang, found in sorted(rows.items()):
        x = np.stack([weigh(d, n, idf) for d, n in sorted(found, key=lambda f: (len(f[0]), f[0].tobytes(), f[1].tobytes()))])
        c = spherical_kmeans(x, CENTROIDS)
        centroids.append(c)
        langs += [lang] * len(c)
        for d, n in found:
            k = length_class(n)
            floor[k] = min(floor[k], 1 - 1e-6, float((weigh(d, n, idf) @ c.T).max()))
    if langs:
        known = np.flatnonzero(floor < 1)
        floor[known[-1] :] = floor[known[-1]]  # longer than any sampled text: as the longest
        floor = np.minimum.accumulate(floor[::-1])[::-1].copy()  # shorter texts may lie as far away as longer ones
        floor[: known[0]] = 0  # shorter than any sampled text: not rejected
        floor = np.minimum(floor, HIGHEST_FLOOR)
    return Model(idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMENSIONS), np.float32), langs, floor)


def _predictor(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.predict(batch.column("text").to_pylist())
            columns = {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "rejected": pa.array([bool(g[2]) for g in got], pa.bool_())}
            kept = [batch.column(n) for n in batch.schema.names]
            yield pa.record_batch(kept + list(columns.values()), names=[*batch.schema.names, *columns])

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs and lang_pred, score and rejected, from ``text`` alone; docs has no columns of these names.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text where nothing could
    be learned.  Repeated rows are returned as often as they come; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES * CENTROIDS vectors
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, rejected boolean"
    return docs.mapInArrow(_predictor(shared), schema)


def teaching_rows(docs: DataFrame) -> DataFrame:
    """(text, lang, key) of the rows that may be learned from: crc32(doc_id) mod 4 is not 2."""
    return docs.where("crc32(cast(doc_id as string)) % 4 <> 2").select("text", "lang", F.col("doc_id").alias("key"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned and predicted as in ``fit`` and ``identify``; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(teaching_rows(docs))
    found = identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; columns are those of docs, whatever their names.

    Null texts and texts without a letter go; repeated rows stay or go together; no rows give none.
    """
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    model = fit(teaching_rows(docs))
    found = identify(docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns)), model)
    return found.where("not rejected").select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))
