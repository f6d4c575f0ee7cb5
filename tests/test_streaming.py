import datetime as dt

from pyspark.sql import functions as F

from leadloom.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def test_daily_counts_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("at", F.col("ts").cast("timestamp"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    inc.run_available(inc.daily_counts(stream, "user_id", "at", "0 seconds"), out, ck)
    got = {(r.user_id, r.observed_on): r.n for r in spark.read.parquet(out).collect()}
    want = {(r.user_id, r.d): r["count"] for r in events.groupBy("user_id", F.to_date("ts").alias("d")).count().collect()}
    last = max(d for _, d in want)
    assert {k: v for k, v in want.items() if k[1] < last} == {k: v for k, v in got.items() if k[1] < last}  # the open day is still to come


def test_repeats_are_admitted_once(spark, tmp_path):
    base = dt.datetime(2026, 6, 1)
    rows = [("a", "1", base), ("a", "1", base + dt.timedelta(hours=1)), ("a", "2", base), ("b", "1", None), ("b", "1", base)]
    spark.createDataFrame(rows, "source_site string, external_id string, posted_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_site string, external_id string, posted_at timestamp").parquet(str(tmp_path / "in"))
    inc.run_available(inc.admit(stream.where("posted_at is not null")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r.source_site, r.external_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("a", "2"), ("b", "1")]
    flagged = inc.late_or_admitted(spark.read.parquet(str(tmp_path / "in")), F.lit(base + dt.timedelta(days=20))).groupBy("admission").count().collect()
    assert {r.admission: r["count"] for r in flagged} == {"STALE": 4, "MISSING_POSTING_DATE": 1}


def test_upserts_survive_a_rerun(spark, tmp_path):
    upsert = inc.upsert_sink(spark, str(tmp_path / "t"), ["k"])
    one, two = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, None), (3, "c")]))
    upsert(one, 0)
    for _ in range(2):
        upsert(two, 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v=1")).collect())) == [(1, "a"), (2, "b"), (3, "c")]
