"""Queue, workers, sign-in limits and domains (R3–R9, batch forms)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.functions.ordered import last_seen, running_sum

# Limits and intervals, in seconds.
SIGN_IN_LIMIT, SIGN_IN_WINDOW = 5, 15 * 60
WORKER_ALIVE, QUEUE_STALL, LOCK_LOST, RETRY_BASE = 90, 120, 180, 5
ALERT_PAUSE = 6 * 3600


class AcceptedOnly:
    """State of the sign-in limit: the accepted times still inside the window, at most five."""

    def __init__(self) -> None:
        self.accepted: deque[float] = deque()

    def __call__(self, at: float) -> bool:
        while self.accepted and self.accepted[0] <= at - SIGN_IN_WINDOW:
            self.accepted.popleft()
        if len(self.accepted) >= SIGN_IN_LIMIT:
            return False
        self.accepted.append(at)
        return True


class OncePerPause:
    """State of the alert throttle: the time of the last alert."""

    def __init__(self) -> None:
        self.last: float | None = None

    def __call__(self, at: float) -> bool:
        if self.last is not None and at - self.last <= ALERT_PAUSE:
            return False
        self.last = at
        return True


def _fold_in_order(df: DataFrame, keys: list[str], seconds: str, tie: str, rule: Callable, out: str) -> DataFrame:
    """Feeds each key's rows to a fresh rule in time order. Rows stream through the task batch by batch and only the
    rule's few values are held, so a long group needs no more memory than a short one."""
    shuffled = df.repartition(*keys).sortWithinPartitions(*keys, seconds, tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            verdicts = []
            for key, at in zip(batch[keys].itertuples(index=False, name=None), batch[seconds]):
                if key != current:
                    current, state = key, rule()
                verdicts.append(state(at))
            yield batch.assign(**{out: pd.array(verdicts, dtype="bool")})

    return shuffled.mapInPandas(run, df.withColumn(out, F.lit(True)).schema)


def _epoch(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1000000.0


def _islands(df: DataFrame, keys: list[str], at: str, tie: str, gap_seconds: int) -> DataFrame:
    """Splits each key's events where they pause longer than the gap. A rule that forgets after the gap starts
    afresh at each island, so islands can be folded apart; the islands come from day blocks, not one task a key."""
    day, order = F.to_date(at), ["_t", tie]
    timed = df.withColumn("_t", _epoch(at))
    prev = last_seen(timed, keys, day, order, "_t", "_prev", inclusive=False)
    starts = prev.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap_seconds), 1).otherwise(0))
    return running_sum(starts, keys, day, order, "_start", "_island").drop("_prev", "_start")


def rate_limited(requests: DataFrame) -> DataFrame:
    """requests: request_id, user_id, at_ts. Five accepted requests in a quarter of an hour; refused ones do not count."""
    cut = _islands(requests.select("request_id", "user_id", "at_ts"), ["user_id"], "at_ts", "request_id", SIGN_IN_WINDOW)
    judged = _fold_in_order(cut, ["user_id", "_island"], "_t", "request_id", AcceptedOnly, "accepted")
    return judged.select("request_id", "user_id", "at_ts", (~F.col("accepted")).alias("refused"))


def status_alerts(observations: DataFrame) -> DataFrame:
    """observations: domain, observed, at_ts, seq. A live domain that turns failed alerts, at most once in six hours."""
    seen = observations.select("domain", "observed", "at_ts", "seq")
    prev = last_seen(seen, ["domain"], F.to_date("at_ts"), ["at_ts", "seq"], "observed", "_prev", inclusive=False)
    broke = prev.filter((F.col("_prev") == "live") & (F.col("observed") == "failed")).drop("_prev")
    cut = _islands(broke, ["domain"], "at_ts", "seq", ALERT_PAUSE)
    judged = _fold_in_order(cut, ["domain", "_island"], "_t", "seq", OncePerPause, "alerted")
    return judged.select("domain", "at_ts", "seq", "alerted")


def queue_health(jobs: DataFrame, heartbeats: DataFrame, now: str) -> DataFrame:
    """One row: two aggregates of one row each, stacked and folded into one."""
    t = F.lit(now).cast("timestamp_ntz")
    at = _now_epoch(now)
    waiting = (F.col("status") == "queued") & (F.col("run_after") <= t)
    q = jobs.filter(F.col("status").isin("queued", "running")).agg(
        F.count_if(waiting).alias("queued"), F.count_if(F.col("status") == "running").alias("running"),
        F.bround(at - F.min(F.when(waiting, _epoch("run_after")))).cast("bigint").alias("oldest_queued_seconds"))
    hb = heartbeats.agg(F.count_distinct(F.when(at - _epoch("seen_at") < WORKER_ALIVE, F.col("worker_id"))).alias("workers_alive"),
                        F.bround(at - F.max(_epoch("seen_at"))).cast("bigint").alias("worker_last_seen_seconds"))
    both = q.unionByName(hb, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.withColumn("stalled", (F.col("queued") > 0) & (F.col("workers_alive") == 0) & (F.coalesce("oldest_queued_seconds", F.lit(0)) > QUEUE_STALL))


def _now_epoch(now: str) -> Column:
    return F.unix_micros(F.lit(now).cast("timestamp")) / 1000000.0


def job_recovery(jobs: DataFrame, now: str) -> DataFrame:
    """Running jobs whose lock is lost: queued again, or failed when out of attempts."""
    t = F.lit(now).cast("timestamp_ntz")
    lost = jobs.filter((F.col("status") == "running") & (F.col("locked_at") < t - F.expr(f"INTERVAL '{LOCK_LOST}' SECOND")))
    out = F.col("attempts") >= F.col("max_attempts")
    return lost.withColumns({"status": F.when(out, "failed").otherwise("queued"), "finished_at": F.when(out, t),
                             "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit(None).cast("string")})


def failed_attempts(jobs: DataFrame, now: str) -> DataFrame:
    """Where an attempt that failed just now goes: again after 5 s doubled per attempt, or nowhere."""
    t = F.lit(now).cast("timestamp_ntz")
    again = F.col("attempts") < F.col("max_attempts")
    wait = F.pow(F.lit(2), F.col("attempts")) * RETRY_BASE
    return jobs.filter(F.col("status") == "running").withColumns({
        "status": F.when(again, "queued").otherwise("failed"),
        "run_after": F.when(again, t + F.make_interval(secs=wait.cast("decimal(18,6)"))).otherwise(F.col("run_after"))})


def failed_versions(recovered: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions a pipeline job that gave up leaves behind."""
    gave_up = recovered.filter((F.col("status") == "failed") & F.startswith("kind", F.lit("pipeline."))).select("version_id")
    return (versions.filter(F.col("published_at").isNull() & (F.col("status") == "processing"))
            .join(gave_up, "version_id", "left_semi").withColumn("status", F.lit("failed")))


def worker_liveness(beats: DataFrame, now: str) -> DataFrame:
    return beats.groupBy("worker_id").agg(F.max("seen_at").alias("last_seen")).withColumn(
        "gone", _now_epoch(now) - _epoch("last_seen") >= WORKER_ALIVE)


# Words in a CNAME that show a proxy in front of the site, the first failing rule's code wins.
PROXY_WORDS = "cloudflare|cdn|akamai|fastly"
WAITING_STATES = ["pending", "verified", "failed"]
FAST_STATES = ["pending", "verified", "ssl_issuing", "failed"]


def domain_status(observations: DataFrame, target: str, allowed_ca: list[str]) -> DataFrame:
    """observations: state, cname, cname_timeout, txt array, want_txt, caa_issuers array, tls_ok, cert_days.
    DNS facts first, then the certificate; the first rule that fails names the reason."""
    cname = F.col("cname")
    issuers = F.coalesce("caa_issuers", F.array().cast("array<string>"))
    reason = (F.when(F.col("cname_timeout"), "dns_timeout").when(cname.isNull(), "cname_missing")
              .when((cname != target) & cname.rlike(PROXY_WORDS), "cname_proxied").when(cname != target, "cname_elsewhere")
              .when(F.size(F.coalesce("txt", F.array().cast("array<string>"))) == 0, "txt_missing")
              .when(~F.array_contains("txt", F.col("want_txt")), "txt_mismatch")
              .when((F.size(issuers) > 0) & ~F.arrays_overlap(issuers, F.array(*[F.lit(c) for c in allowed_ca])), "caa_blocks")
              .when(F.col("tls_ok") & (F.col("cert_days") < 7), "cert_expiring")
              .when(~F.col("tls_ok") & ~F.col("state").isin("pending", "verified", "failed", "ssl_issuing"), "cert_failed"))
    nxt = (F.when(F.col("reason") == "dns_timeout", F.col("state")).when(F.col("reason").isNotNull(), "failed")
           .when(F.col("tls_ok"), "live").otherwise("ssl_issuing"))
    return observations.withColumn("reason", reason).withColumn("next_state", nxt)


def due_checks(domains: DataFrame, now: str) -> DataFrame:
    t = _now_epoch(now)
    young = F.col("created_at").isNull() | (t - _epoch("created_at") < 3600)
    every = F.when(F.col("state").isin(FAST_STATES), F.when(young, 60).otherwise(600)).otherwise(1800)
    return domains.filter((F.col("state") != "removed") & (F.col("checked_at").isNull() | (t - _epoch("checked_at") >= every))).withColumn("interval_seconds", every)
