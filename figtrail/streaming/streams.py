"""Streaming forms. Each drains to the same rows as its batch form; state is keyed, bounded and checkpointed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from figtrail.operators.normalise import agent_class
from figtrail.operators.operations import ALERT_PAUSE, SIGN_IN_LIMIT, SIGN_IN_WINDOW, WORKER_ALIVE


def read_table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A driver table's files as a stream; new files in the folder become new batches."""
    where = f"{folder}/{table}.parquet"
    held = spark.read.parquet(where)
    source = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", files_per_batch)
    # a table of any size is a folder of part files; a small one is a single file beside others
    if any(f.rsplit("/", 1)[-1] == f"{table}.parquet" for f in held.inputFiles()):
        return source.option("pathGlobFilter", f"{table}*.parquet").parquet(folder)
    return source.parquet(where)


def drain(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Runs what is there and stops. Every batch overwrites its own folder, so a batch replayed after a lost
    executor leaves one copy. A stream that brings no batch leaves an empty one, so there is something to read."""
    written: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        written.append(epoch)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", state)
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    if not written:
        spark = stream.sparkSession
        spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/epoch=0")


def traffic_counts(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily visits by workspace and class; a late hit inside the watermark updates its day."""
    timed = hits.withColumn("at_time", F.col("at_ts").cast("timestamp")).withWatermark("at_time", late)
    kind = F.when(agent_class(F.col("user_agent")) == "human", "human").otherwise("crawler")
    return (timed.filter(F.col("status") < 400).groupBy(F.window("at_time", "1 day"), "tenant_id", kind.alias("kind"))
            .agg(F.count(F.lit(1)).alias("visits"))
            .select("tenant_id", F.to_date("window.start").alias("day"), "kind", "visits"))


def newest_counts(updates: DataFrame) -> DataFrame:
    """The last update of each key, from the folders ``drain`` wrote in update mode."""
    return updates.groupBy("tenant_id", "day", "kind").agg(F.max_by("visits", "epoch").alias("visits"))


def deduped_jobs(jobs: DataFrame, horizon: str) -> DataFrame:
    """One job per (workspace, idempotency key) within the horizon."""
    return (jobs.withColumn("created_time", F.col("created_at").cast("timestamp")).withWatermark("created_time", horizon)
            .dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"]))


def _sorted_times(frames: Iterator[pd.DataFrame], tie: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["at_time", tie], kind="stable")


def limited_requests(requests: DataFrame) -> DataFrame:
    """Sign-in requests judged as they come; the state is the accepted times still in the window (at most five)."""
    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted_times(frames, "request_id")
        accepted = list(state.get[0]) if state.exists else []
        refused = []
        for at in rows["at_time"].astype("int64") / 1e9:
            accepted = [a for a in accepted if a > at - SIGN_IN_WINDOW]
            refused.append(len(accepted) >= SIGN_IN_LIMIT)
            if not refused[-1]:
                accepted.append(float(at))
        state.update((accepted,))
        yield pd.DataFrame({"request_id": rows["request_id"], "user_id": key[0], "refused": refused})

    timed = requests.select("request_id", "user_id", F.col("at_ts").cast("timestamp").alias("at_time"))
    return timed.groupBy("user_id").applyInPandasWithState(
        judge, "request_id bigint, user_id bigint, refused boolean", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)


def alerts(observations: DataFrame) -> DataFrame:
    """Alerts as observations come; the state is the last status seen and the time of the last alert."""
    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _sorted_times(frames, "seq")
        status, last = state.get if state.exists else (None, None)
        out = []
        for seq, observed, at in zip(rows["seq"], rows["observed"], rows["at_time"].astype("int64") / 1e9):
            if status == "live" and observed == "failed":
                fire = last is None or at - last > ALERT_PAUSE
                last = float(at) if fire else last
                out.append((key[0], int(seq), fire))
            status = observed
        state.update((status, last))
        yield pd.DataFrame(out, columns=["domain", "seq", "alerted"])

    timed = observations.select("domain", "observed", "seq", F.col("at_ts").cast("timestamp").alias("at_time"))
    return timed.groupBy("domain").applyInPandasWithState(
        judge, "domain string, seq bigint, alerted boolean", "status string, last double", "append", GroupStateTimeout.NoTimeout)


def worker_losses(beats: DataFrame) -> DataFrame:
    """A worker is reported gone when no beat came for 90 seconds of processing time."""
    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield pd.DataFrame({"worker_id": [key[0]], "last_seen": [pd.Timestamp(seen, unit="s")], "gone": [True]})
            return
        newest = max(f["seen_time"].max() for f in frames).timestamp()
        state.update((max(newest, state.get[0]) if state.exists else newest,))
        state.setTimeoutDuration(WORKER_ALIVE * 1000)
        yield pd.DataFrame({"worker_id": [key[0]], "last_seen": [pd.Timestamp(state.get[0], unit="s")], "gone": [False]})

    timed = beats.select("worker_id", F.col("seen_at").cast("timestamp").alias("seen_time"))
    return timed.groupBy("worker_id").applyInPandasWithState(
        judge, "worker_id string, last_seen timestamp, gone boolean", "seen double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def check_stream(figures: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """New figures are checked per micro-batch; of a version that came twice in a batch only the newest content counts."""
    def run(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("version_id").agg(F.max_by("content_sha", "arrived").alias("content_sha"))
        current = batch.join(newest, ["version_id", "content_sha"], "left_semi")
        check(current).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    q = figures.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(run).start()
    q.awaitTermination()
