"""Vendor slices: which may be searched, versions of a slice, a search over several, and the loads of a run."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom import vocab
from leadloom.functions import location
from leadloom.sources.registry import ats_slice
from leadloom.vocab import Settings


def resolve_slices(ats: str | list[str] | None, settings: Settings = Settings()) -> list[str | None]:
    """The slices to search; the whole snapshot only where the settings allow it."""
    if ats is None:
        if not settings.full_snapshot:
            raise ValueError("name a slice; the whole snapshot is searched only with full_snapshot")
        return [None]
    return [ats] if isinstance(ats, str) else list(ats)


def checked_slice(spark: SparkSession, base: str, name: str, manifest: dict) -> str:
    """The path of a slice's version, whose folder is named by its manifest's digest; refused if its row count is another."""
    path = f"{base}/{name}/{manifest['sha256'][:16]}"
    n = spark.read.parquet(path).count()  # from the files' footers
    if n != manifest["rows"]:
        raise ValueError(f"slice {name} has {n} rows, its manifest {manifest['rows']}")
    return path


def drop_old_versions(spark: SparkSession, base: str, name: str, manifest: dict) -> list[str]:
    """Delete a slice's other versions; their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for f in fs.listStatus(root) if fs.exists(root) else []:
        if f.getPath().getName() != manifest["sha256"][:16]:
            fs.delete(f.getPath(), True)
            gone.append(f.getPath().getName())
    return sorted(gone)


@dataclass
class SliceCache:
    """Frames of a run by key: each is loaded once, also when several threads ask at the same time, and persisted to disk."""

    loads: int = 0
    hits: int = 0
    _frames: dict[tuple, DataFrame] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def get(self, key: tuple, load: Callable[[], DataFrame]) -> DataFrame:
        from pyspark import StorageLevel

        with self._lock:
            if key in self._frames:
                self.hits += 1
            else:
                self._frames[key] = load().persist(StorageLevel.DISK_ONLY)
                self.loads += 1
            return self._frames[key]

    def clear(self) -> None:
        with self._lock:
            for frame in self._frames.values():
                frame.unpersist()
            self._frames.clear()


def state_filter(where: str | Column | None) -> Column:
    """The state that a place names, which is as fine as slices can be asked."""
    return location.us_state_of(where if isinstance(where, Column) else F.lit(where))


def search_slices(spark: SparkSession, paths: dict[str, str], now: Column, title: str | None = None, state: str | None = None, company: str | None = None, remote: bool | None = None, limit: int | None = 500, days: int = 14) -> DataFrame:
    """Open postings of each slice(name to path), ``slice`` named, up to ``limit`` each by identifier.

    A slice that holds nothing under a state's code is searched by the state's name; every row found is then checked
    to lie in the state, as a code is also part of other words.
    """
    out = None
    names = {c: n.title() for n, c in vocab.US_STATES.items() if c != "DC"}
    for name, path in paths.items():
        rows = ats_slice(spark, path, now, title, None, days)
        if company:
            rows = rows.where(F.lower("company") == company.lower())
        if remote is not None:
            rows = rows.where(F.coalesce("is_remote", F.lit(False)) == remote)
        if state:
            coded, named = rows.where(F.col("location").contains(state)), rows.where(F.col("location").contains(names.get(state, state)))
            some = coded.limit(1).agg((F.count("*") > 0).alias("some"))  # one row
            tagged = coded.withColumn("by_code", F.lit(True)).unionByName(named.withColumn("by_code", F.lit(False))).join(F.broadcast(some))
            rows = tagged.where(F.col("by_code") == F.col("some")).drop("by_code", "some")
        rows = rows.orderBy("global_id").limit(limit) if limit else rows
        if state:
            rows = rows.where(location.in_us_state(F.col("location"), F.lit(state)))
        one = rows.withColumn("slice", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
