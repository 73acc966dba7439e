"""Streams drained against their batch forms, with several batches, late rows and duplicates."""

from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from figtrail.operators import operations
from figtrail.plans.registry import Tables
from figtrail.streaming import streams


def _files(df, folder, order, late):
    """Three files in time order; the last also brings a few early rows again in `late`."""
    df = df.withColumn("_n", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy(order)))
    for n in (1, 2, 3):
        part = df.filter(F.col("_n") == n).drop("_n")
        if n == 3 and late is not None:
            part = part.unionByName(late)
        part.coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/batch={n}")


@pytest.fixture
def stage(spark, tmp_path):
    def run(df, order, late=None):
        _files(df, str(tmp_path), order, late)
        schema = df.schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        return stream, f"{tmp_path}/out", f"{tmp_path}/state"
    return run


def test_limits_across_batches(spark, stage):
    rows = Tables(spark, SMALL)("fx_requests")
    rows = rows.withColumns({"user_id": F.col("user_id") % 2, "at_ts": F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, request_id * 70)")})
    stream, out, state = stage(rows, "request_id")
    streams.drain(streams.limited_requests(stream), out, state)
    got = {(r.request_id, r.refused) for r in spark.read.parquet(out).select("request_id", "refused").collect()}
    want = {(r.request_id, r.refused) for r in operations.rate_limited(rows).select("request_id", "refused").collect()}
    assert got == want and any(r for _, r in want)


def test_alerts_across_batches(spark, stage):
    rows = Tables(spark, SMALL)("fx_domains")
    stream, out, state = stage(rows, "seq")
    streams.drain(streams.alerts(stream), out, state)
    got = {(r.seq, r.alerted) for r in spark.read.parquet(out).select("seq", "alerted").collect()}
    assert got == {(r.seq, r.alerted) for r in operations.status_alerts(rows).select("seq", "alerted").collect()}


def test_late_hits_inside_the_watermark_count_and_older_ones_do_not(spark, stage):
    hits = Tables(spark, SMALL)("fx_hits")
    newest = hits.agg(F.max("at_ts").alias("m"))
    late = hits.limit(1).crossJoin(newest).withColumn("at_ts", F.col("m") - F.expr("INTERVAL '2' HOUR")).drop("m").withColumn("status", F.lit(200))
    old = late.withColumn("at_ts", F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00'"))
    stream, out, state = stage(hits, "at_ts", late.unionByName(old))
    streams.drain(streams.traffic_counts(stream), out, state, "update")
    got = streams.newest_counts(spark.read.option("basePath", out).parquet(out))
    assert got.agg(F.sum("visits")).first()[0] == hits.filter("status < 400").count() + 1
    assert got.filter(F.col("day") < F.lit("2024-01-01").cast("date")).count() == 0


def test_duplicate_jobs_across_batches(spark, stage):
    jobs = Tables(spark, SMALL)("fx_jobs")
    stream, out, state = stage(jobs, "created_at", jobs.limit(20))
    streams.drain(streams.deduped_jobs(stream, "60 days").select("tenant_id", "idempotency_key"), out, state)
    assert spark.read.parquet(out).count() == jobs.select("tenant_id", "idempotency_key").distinct().count()


def test_a_silent_worker_is_reported(spark):
    gone = operations.worker_liveness(spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "worker_id string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")), "2024-01-01 00:02:30")
    assert {(r.worker_id, r.gone) for r in gone.collect()} == {("a", True), ("b", False)}


def test_an_empty_stream_leaves_an_empty_table(spark, tmp_path):
    jobs = Tables(spark, SMALL)("fx_jobs")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/in")
    streams.drain(stream.select("job_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").select("job_id").count() == 0
