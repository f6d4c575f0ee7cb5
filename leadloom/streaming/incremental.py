"""The incremental variant: admission of postings, repeat suppression and daily hiring counts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.tables import merge_non_null


def admit(stream: DataFrame, days: int = 14) -> DataFrame:
    """Each (site, external id) once within the event-time horizon of posted_at; later repeats and rows behind it go."""
    return stream.withWatermark("posted_at", f"{days} days").dropDuplicatesWithinWatermark(["source_site", "external_id"])


def late_or_admitted(stream: DataFrame, now, days: int = 14) -> DataFrame:
    """stream and admission: rows behind the horizon keep a reason instead of vanishing."""
    late = F.unix_micros(now) - F.unix_micros("posted_at") > days * 86_400_000_000
    return stream.withColumn("admission", F.when(F.col("posted_at").isNull(), F.lit("MISSING_POSTING_DATE")).when(late, F.lit("STALE")).otherwise(F.lit("ADMITTED")))


def daily_counts(stream: DataFrame, key: str, at: str, lateness: str = "2 days") -> DataFrame:
    """A row a key and day, in tumbling windows."""
    counted = stream.withWatermark(at, lateness).groupBy(F.window(at, "1 day"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.to_date(F.col("window.start")).alias("observed_on"), "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what there is and stop; the checkpoint makes a rerun continue where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def upsert_sink(spark: SparkSession, base: str, keys: list[str]):
    """A foreachBatch function that merges a batch into a table of versions: version n holds the state after batch n.

    A batch that runs again reads the version before it and writes its own once more, so it is not counted twice.
    """

    def version(n: int) -> str:
        return f"{base}/v={n}"

    def upsert(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(version(n - 1)) if n else batch.limit(0)
        merge_non_null(old.select(batch.columns) if n else old, batch, keys).write.mode("overwrite").parquet(version(n))

    return upsert


def partitioned_sink(spark: SparkSession, base: str, keys: list[str], buckets: int = 64):
    """A foreachBatch function that merges a batch into a table of key buckets, of which only those it touches are rewritten.

    A bucket's state after batch n is its newest version up to n.  A batch that runs again finds the versions before
    it and writes its own once more; ``read_partitioned`` reads the newest of each bucket.
    """

    def place(rows: DataFrame) -> DataFrame:
        return rows.withColumn("in_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def upsert(batch: DataFrame, n: int) -> None:
        rows = place(batch)
        known = _versions(spark, base)
        touched = {r.in_bucket for r in rows.select("in_bucket").distinct().collect()}  # at most ``buckets`` numbers
        paths = [f"{base}/in_bucket={b}/at_batch={v}" for b, v in _newest(known, n).items() if b in touched]
        new = rows.drop("in_bucket")
        merged = merge_non_null(spark.read.schema(new.schema).parquet(*paths), new, keys) if paths else merge_non_null(new.limit(0), new, keys)
        out = place(merged).withColumn("at_batch", F.lit(n)).repartition(F.col("in_bucket"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("in_bucket", "at_batch").parquet(base)

    return upsert


def _versions(spark: SparkSession, base: str) -> list[tuple[int, int]]:
    """(bucket, version) of every part of a table, from the names of its folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in_bucket=*/at_batch=*")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    parts = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found]
    return [(int(b.partition("=")[2]), int(v.partition("=")[2])) for b, v in parts]


def _newest(known: list[tuple[int, int]], before: int | None = None) -> dict[int, int]:
    out: dict[int, int] = {}
    for b, v in known:
        if before is None or v < before:
            out[b] = max(v, out.get(b, -1))
    return out


def read_partitioned(spark: SparkSession, base: str, schema) -> DataFrame:
    """The table as it is after the last batch."""
    newest = _newest(_versions(spark, base))
    paths = [f"{base}/in_bucket={b}/at_batch={v}" for b, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, base: str) -> int:
    """Delete versions that newer ones have replaced; the number that went."""
    known = _versions(spark, base)
    newest, gone = _newest(known), 0
    for b, v in known:
        if v < newest[b]:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/in_bucket={b}/at_batch={v}")
            gone += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return gone


def closed_daily_counts(closed: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """Every day's counts: closed days as the stream has written them, and the days that it still holds open from the batch table."""
    day = F.to_date(at)
    ended = closed.agg(F.max("observed_on").alias("last"))  # one row
    rest = batch.join(F.broadcast(ended)).where(F.col("last").isNull() | (day > F.col("last"))).groupBy(key, day.alias("observed_on")).agg(F.count("*").alias("n"))
    return closed.select(key, "observed_on", "n").unionByName(rest)


def remember(stream: DataFrame, key: str, at: str, days: int, known: str = "known") -> DataFrame:
    """A cache as a stream: each sighting(key, at) and whether a fact of the key, at most ``days`` old, was known before it.

    A key keeps one time and forgets it when the watermark has passed the fact's life, so the state holds no more keys
    than were seen within it.  Sightings of one trigger count in the order of their times.
    """
    kind = stream.schema[key].dataType.simpleString()
    life = pd.Timedelta(days=days)

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        last = pd.Timestamp(last, unit="us") if last is not None else None
        times = sorted(t for frame in frames for t in frame[at])
        flags = []
        for t in times:
            hit = last is not None and t - last <= life
            flags.append(hit)
            if not hit:
                last = t
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + life).value // 1_000_000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(times), at: times, known: flags})

    rows = stream.select(key, at).withWatermark(at, f"{days} days").groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, {known} boolean", "last long", "append", "EventTimeTimeout")


def spend(stream: DataFrame, key: str, budget: int) -> DataFrame:
    """A budget as a stream: each call(key, seq) and ``allowed``, true for the first ``budget`` calls of a key over all triggers."""
    kind = stream.schema[key].dataType.simpleString()

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        calls = sorted(int(s) for frame in frames for s in frame["seq"])
        yield pd.DataFrame({key: [group[0]] * len(calls), "seq": calls, "allowed": [used + i < budget for i in range(len(calls))]})
        state.update((min(budget, used + len(calls)),))

    return stream.select(key, "seq").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, allowed boolean", "used long", "append", "NoTimeout")
