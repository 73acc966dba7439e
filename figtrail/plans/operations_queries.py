"""Queue, limits, domains; streams are drained over the driver's event file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from figtrail.functions.numbers import garbled_number, with_number
from figtrail.operators import checks
from figtrail.operators import operations as op
from figtrail.plans import fixtures
from figtrail.plans.registry import Tables, query
from figtrail.session import checkpoint_folder
from figtrail.streaming import streams

NOW = "2024-01-31 00:00:00"
NOW_TS = "TIMESTAMP '2024-01-31 00:00:00'"


def _scratch(t) -> tuple[str, str]:
    """A fresh output and state folder under the shared checkpoint folder."""
    run = f"{checkpoint_folder(t.spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    return run + "/out", run + "/state"


def _event_stream(t: Tables, adapter: str):
    """An adapter over events as a stream: the same text, read from the streaming source."""
    name = f"events_stream_{id(t)}"
    streams.read_table_stream(t.spark, t.folder, "events").createOrReplaceTempView(name)
    return t.spark.sql(fixtures.FIXTURES[adapter].replace("{events}", name))


@query("r1_stream_traffic", """
    SELECT tenant_id, CAST(at_ts AS DATE) AS day, CASE WHEN regexp_matches(user_agent, '(?i)bot|crawler|curl') THEN 'crawler' ELSE 'human' END AS kind, count(*) AS visits FROM fx_hits WHERE status < 400 GROUP BY ALL""")
def r1(t):
    out, state = _scratch(t)
    streams.drain(streams.traffic_counts(_event_stream(t, "fx_hits")), out, state, "update")
    return streams.newest_counts(t.spark.read.option("basePath", out).parquet(out))


@query("r2_stream_dedupe_jobs", "SELECT DISTINCT tenant_id, idempotency_key FROM fx_jobs")
def r2(t):
    out, state = _scratch(t)
    streams.drain(streams.deduped_jobs(_event_stream(t, "fx_jobs"), "60 days").select("tenant_id", "idempotency_key"), out, state)
    return t.spark.read.parquet(out).select("tenant_id", "idempotency_key")


LIMITED = """
    WITH RECURSIVE q AS (SELECT request_id, user_id, at_ts, row_number() OVER (PARTITION BY user_id ORDER BY at_ts, request_id) AS rn FROM fx_requests),
    s AS (SELECT request_id, user_id, at_ts, rn, [at_ts] AS acc, FALSE AS refused FROM q WHERE rn = 1
      UNION ALL
      SELECT q.request_id, q.user_id, q.at_ts, q.rn, CASE WHEN len(list_filter(s.acc, lambda a: a > q.at_ts - INTERVAL 15 MINUTE)) >= 5 THEN s.acc ELSE list_append(list_filter(s.acc, lambda a: a > q.at_ts - INTERVAL 15 MINUTE), q.at_ts) END,
             len(list_filter(s.acc, lambda a: a > q.at_ts - INTERVAL 15 MINUTE)) >= 5 FROM s JOIN q ON q.user_id = s.user_id AND q.rn = s.rn + 1)
    SELECT request_id, user_id, refused FROM s"""


@query("r3_rate_limited", LIMITED)
def r3(t):
    return op.rate_limited(t("fx_requests")).select("request_id", "user_id", "refused")


@query("r3_stream_rate_limited", LIMITED)
def r3b(t):
    out, state = _scratch(t)
    streams.drain(streams.limited_requests(_event_stream(t, "fx_requests")), out, state)
    return t.spark.read.parquet(out).select("request_id", "user_id", "refused")


@query("r4_queue_health", f"""
    SELECT queued, running, oldest AS oldest_queued_seconds, live AS workers_alive, seen AS worker_last_seen_seconds, queued > 0 AND live = 0 AND COALESCE(oldest, 0) > 120 AS stalled
    FROM (SELECT count(*) FILTER (WHERE status = 'queued' AND run_after <= {NOW_TS}) AS queued, count(*) FILTER (WHERE status = 'running') AS running,
            CAST(round_even(epoch({NOW_TS}) - epoch(min(run_after) FILTER (WHERE status = 'queued' AND run_after <= {NOW_TS})), 0) AS BIGINT) AS oldest FROM fx_jobs WHERE status IN ('queued','running')),
         (SELECT count(DISTINCT worker_id) FILTER (WHERE seen_at > {NOW_TS} - INTERVAL 90 SECOND) AS live, CAST(round_even(epoch({NOW_TS}) - epoch(max(seen_at)), 0) AS BIGINT) AS seen FROM fx_beats)""")
def r4(t):
    return op.queue_health(t("fx_jobs"), t("fx_beats"), NOW)


@query("r5_job_recovery", f"""
    SELECT job_id, CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END AS status, CASE WHEN attempts >= max_attempts THEN '2024-01-31 00:00:00' END AS finished_at, locked_by
    FROM (SELECT * EXCLUDE (locked_by), CAST(NULL AS VARCHAR) AS locked_by FROM fx_jobs) WHERE status = 'running' AND locked_at < {NOW_TS} - INTERVAL 3 MINUTE""")
def r5(t):
    return op.job_recovery(t("fx_jobs"), NOW).select("job_id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "locked_by")


@query("r5_failed_attempts", f"""
    SELECT job_id, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS status, strftime(CASE WHEN attempts < max_attempts THEN {NOW_TS} + INTERVAL 5 SECOND * CAST(pow(2, attempts) AS INT) ELSE run_after END, '%Y-%m-%d %H:%M:%S') AS run_after
    FROM fx_jobs WHERE status = 'running'""")
def r5b(t):
    return op.failed_attempts(t("fx_jobs"), NOW).select("job_id", "status", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"))


@query("r5_failed_versions", f"""
    SELECT version_id, 'failed' AS status FROM fx_versions WHERE published_at IS NULL AND status = 'processing' AND version_id IN (
      SELECT version_id FROM fx_jobs WHERE status = 'running' AND attempts >= max_attempts AND kind LIKE 'pipeline.%' AND locked_at < {NOW_TS} - INTERVAL 3 MINUTE)""")
def r5c(t):
    return op.failed_versions(op.job_recovery(t("fx_jobs"), NOW), t("fx_versions")).select("version_id", "status")


@query("r6_worker_liveness", f"SELECT worker_id, strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen, epoch({NOW_TS}) - epoch(max(seen_at)) >= 90 AS gone FROM fx_beats GROUP BY ALL")
def r6(t):
    return op.worker_liveness(t("fx_beats"), NOW).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("r7_domain_status", """
    SELECT domain_id, reason, CASE WHEN reason = 'dns_timeout' THEN state WHEN reason IS NOT NULL THEN 'failed' WHEN tls_ok THEN 'live' ELSE 'ssl_issuing' END AS next_state FROM (
      SELECT *, CASE WHEN cname_timeout THEN 'dns_timeout' WHEN cname IS NULL THEN 'cname_missing' WHEN cname <> 'edge.example.net' THEN CASE WHEN regexp_matches(cname, 'cloudflare|cdn|akamai|fastly') THEN 'cname_proxied' ELSE 'cname_elsewhere' END
        WHEN txt_text = '' THEN 'txt_missing' WHEN txt_text <> want_txt THEN 'txt_mismatch' WHEN caa_text = 'otherca.example' THEN 'caa_blocks' WHEN tls_ok AND cert_days < 7 THEN 'cert_expiring'
        WHEN NOT tls_ok AND state NOT IN ('pending','verified','failed','ssl_issuing') THEN 'cert_failed' END AS reason FROM fx_domains)""")
def r7(t):
    facts = t("fx_domains").withColumns({"txt": F.filter(F.array("txt_text"), lambda x: x != ""), "caa_issuers": F.filter(F.array("caa_text"), lambda x: x != "")})
    return op.domain_status(facts, "edge.example.net", ["goodca.example"]).select("domain_id", "reason", "next_state")


@query("r8_due_checks", """
    SELECT domain_id, i AS interval_seconds FROM (SELECT *, CASE WHEN state IN ('pending','verified','ssl_issuing','failed') THEN CASE WHEN epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(created_at) < 3600 THEN 60 ELSE 600 END ELSE 1800 END AS i FROM fx_domains)
    WHERE epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(checked_at) >= i""")
def r8(t):
    return op.due_checks(t("fx_domains"), "2024-01-15 12:00:00").select("domain_id", "interval_seconds")


ALERTS = """
    WITH RECURSIVE b AS (SELECT domain, at_ts, seq, row_number() OVER (PARTITION BY domain ORDER BY at_ts, seq) AS rn FROM (
        SELECT *, lag(observed) OVER (PARTITION BY domain ORDER BY at_ts, seq) AS before FROM fx_domains) WHERE before = 'live' AND observed = 'failed'),
    s AS (SELECT domain, at_ts, seq, rn, at_ts AS last_alert, TRUE AS alerted FROM b WHERE rn = 1
      UNION ALL SELECT b.domain, b.at_ts, b.seq, b.rn, CASE WHEN b.at_ts - s.last_alert > INTERVAL 6 HOUR THEN b.at_ts ELSE s.last_alert END, b.at_ts - s.last_alert > INTERVAL 6 HOUR FROM s JOIN b ON b.domain = s.domain AND b.rn = s.rn + 1)
    SELECT domain, seq, alerted FROM s"""


@query("r9_status_alerts", ALERTS)
def r9(t):
    return op.status_alerts(t("fx_domains")).select("domain", "seq", "alerted")


@query("r9_stream_status_alerts", ALERTS)
def r9b(t):
    out, state = _scratch(t)
    streams.drain(streams.alerts(_event_stream(t, "fx_domains")), out, state)
    return t.spark.read.parquet(out).select("domain", "seq", "alerted")


@query("r10_stream_checks", """
    WITH v AS (SELECT user_id AS version_id, max(event_id) AS newest FROM events GROUP BY ALL)
    SELECT version_id, fid, severity FROM (SELECT e.user_id AS version_id, 'p1f' || e.event_id AS fid, CASE WHEN e.event_id % 5 = 0 THEN 'blocking' END AS severity FROM events e JOIN v ON v.version_id = e.user_id AND e.event_id % 3 = v.newest % 3) WHERE severity IS NOT NULL""")
def r10(t):
    """Every version arrives with three contents in one batch; the newest is checked for numerals that do not parse."""
    out, state = _scratch(t)
    events = streams.read_table_stream(t.spark, t.folder, "events")
    figures = events.select(F.col("user_id").alias("version_id"), (F.col("event_id") % 3).cast("string").alias("content_sha"), F.col("event_id").alias("arrived"), F.lit("src").alias("report_id"), F.lit(1).alias("page"),
                            F.concat(F.lit("p1f"), F.col("event_id").cast("string")).alias("fid"), F.when(F.col("event_id") % 5 == 0, "1,2,34").otherwise("1,234.50").alias("raw"))

    def check(batch):
        typed = with_number(batch, "raw", "n_").withColumns({"unparsed": garbled_number(F.col("raw")), "kind": F.coalesce("n_kind", F.lit("identifier")), "status": F.lit("active"), "method": F.lit("text_layer"),
                                                             "confidence": F.lit(1.0), "ambiguous": F.lit(False)})
        none = typed.select("report_id", "fid").limit(0)
        return checks.check_low_confidence(typed, none).join(typed.select("fid", "version_id"), "fid").select("version_id", "fid", "severity")

    streams.check_stream(figures, check, out, state)
    return t.spark.read.parquet(out).select("version_id", "fid", "severity")
