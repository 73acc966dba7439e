"""A1–A14 over findings, decisions and figures derived from events, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import review as op
from figtrail.plans import duck
from figtrail.plans.normalise_queries import USABLE, USABLE_FROM
from figtrail.plans.registry import query

CONF = "('traceability','second_parser','re_extraction','arithmetic','cross_table')"
ISSUE_COLS = ["issue_id", "version_id", "run_no", "check_name", "severity", "fid", "message", "expected", "actual", "status"]


@query("a1_fold_duplicates", """
    WITH rel AS (SELECT *, CASE check_name WHEN 're_extraction' THEN 1 WHEN 'low_confidence' THEN 2 ELSE 3 END AS rk FROM fx_issues
                 WHERE status = 'open' AND fid IS NOT NULL AND check_name IN ('re_extraction','low_confidence','traceability')),
    g AS (SELECT version_id, run_no, fid, arg_min(issue_id, o) AS keep, list_distinct(list(check_name)) AS checks,
                 arg_min(expected, o) FILTER (WHERE expected IS NOT NULL) AS e, arg_min(actual, o) FILTER (WHERE actual IS NOT NULL) AS a
          FROM (SELECT *, {'s': CASE WHEN severity = 'blocking' THEN 0 ELSE 1 END, 'r': rk, 'i': issue_id} AS o FROM rel) GROUP BY ALL)
    SELECT issue_id, version_id, run_no, check_name, severity, fid, message, expected, actual, status FROM fx_issues WHERE issue_id NOT IN (SELECT issue_id FROM rel)
    UNION ALL
    SELECT r.issue_id, r.version_id, r.run_no, r.check_name, r.severity, r.fid,
      r.message || CASE WHEN len(g.checks) > 1 THEN ' Also flagged by: ' || array_to_string(list_sort(list_transform(list_filter(g.checks, c -> c <> r.check_name),
        c -> CASE c WHEN 're_extraction' THEN 'independent re-reading' WHEN 'low_confidence' THEN 'low reading confidence' ELSE 'source trace' END)), ', ') || '.' ELSE '' END,
      COALESCE(r.expected, g.e), COALESCE(r.actual, g.a), r.status FROM g JOIN rel r ON r.issue_id = g.keep""".replace("c -> ", "lambda c: "))
def a1(t):
    return op.fold_duplicates(t("fx_issues")).select(*ISSUE_COLS)


def _figures(t):
    return op.apply_figure_actions(t("fx_run_figures"), t("fx_reviews"))


ACTIONS = f"""SELECT f.version_id, f.fid, f.method, COALESCE(e.raw, f.raw) AS raw, COALESCE(e.kind, f.kind) AS kind, e.value AS value, e.raw IS NOT NULL AS edited,
      CASE WHEN l.was_out THEN 'not_a_figure' ELSE f.status END AS status, CASE WHEN l.last_action = 'edit' THEN 'confirm' ELSE l.last_action END AS review_action
    FROM fx_run_figures f
    LEFT JOIN (SELECT version_id, fid, arg_max(action, at_no) AS last_action, bool_or(action = 'not_a_figure') AS was_out FROM fx_valid GROUP BY ALL) l USING (version_id, fid)
    LEFT JOIN (SELECT version_id, fid, arg_max(raw, at_no) AS raw, arg_max(n_kind, at_no) AS kind, arg_max(n_value_str, at_no) AS value FROM fx_valid WHERE action = 'edit' GROUP BY ALL) e USING (version_id, fid)"""
VALID = f"""fx_valid AS (SELECT * FROM ({duck.number("SELECT r.version_id, r.fid, r.at_no, r.action, trim(r.raw) AS raw FROM fx_reviews r JOIN fx_run_figures f USING (version_id, fid)", 'raw', 'n_')})
      WHERE action <> 'edit' OR n_kind IS NOT NULL)"""


@query("a14_apply_figure_actions", f"""
    WITH {VALID}, f AS ({ACTIONS})
    SELECT version_id, fid, raw, kind, value, edited, status, review_action, CASE WHEN review_action = 'confirm' THEN raw END AS review_raw FROM f""")
def a14(t):
    return _figures(t).select("version_id", "fid", "raw", "kind", "value", "edited", "status", "review_action", "review_raw")


@query("a2_apply_reviews", f"""
    WITH {VALID}, f AS ({ACTIONS}), c AS (SELECT version_id, fid FROM f WHERE review_action = 'confirm'),
    k AS (SELECT DISTINCT version_id, sha256('["' || cn || '", ' || p || ', null, "' || message || '"]')[1:24] AS key FROM fx_acks,
            (SELECT unnest(['completeness','rendered_page','period_unit','reviewer_flag']) AS cn), (SELECT unnest(range(1, 13)) AS p) WHERE quality = 1),
    i AS (SELECT *, CASE WHEN fid IS NULL THEN sha256('["' || check_name || '", ' || page || ', null, "' || message || '"]')[1:24] END AS key FROM fx_issues)
    SELECT issue_id, i.version_id, check_name, i.fid, CASE WHEN r IS NULL THEN status ELSE 'resolved' END AS status, r AS resolution
    FROM (SELECT i.*, CASE WHEN check_name IN ('rendered_page','schema') THEN NULL WHEN k.key IS NOT NULL THEN 'acknowledged' WHEN c.fid IS NOT NULL THEN 'confirmed' END AS r
          FROM i LEFT JOIN k ON k.version_id = i.version_id AND k.key = i.key LEFT JOIN c ON c.version_id = i.version_id AND c.fid = i.fid) i""")
def a2(t):
    acks = (t("fx_acks").filter("quality = 1")
            .withColumn("check_name", F.explode(F.array(*[F.lit(c) for c in ("completeness", "rendered_page", "period_unit", "reviewer_flag")])))
            .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .select("version_id", op.issue_key(F.col("check_name"), F.col("page"), F.lit(None).cast("string"), F.col("message")).alias("issue_key")))
    return op.apply_reviews(t("fx_issues"), _figures(t), acks).select("issue_id", "version_id", "check_name", "fid", "status", "resolution")


@query("a3_apply_second_opinion", """
    SELECT issue_id, fid, check_name, CASE WHEN hit AND agrees THEN 'warning' ELSE severity END AS severity,
      message || CASE WHEN hit AND agrees THEN ' A second opinion agrees.' WHEN hit AND COALESCE(reading, '') <> '' THEN ' A second opinion reads ' || reading || '.' ELSE '' END AS message
    FROM (SELECT i.*, o.agrees, o.reading, o.fid IS NOT NULL AND i.severity = 'blocking' AND i.check_name IN ('re_extraction','low_confidence') AS hit
          FROM fx_issues i LEFT JOIN (SELECT o.* FROM fx_opinions o JOIN fx_run_figures f ON o.version_id = f.version_id AND o.fid = f.fid AND o.seen_raw = f.raw) o
          ON i.version_id = o.version_id AND i.fid = o.fid)""")
def a3(t):
    return op.apply_second_opinion(t("fx_issues"), t("fx_opinions"), t("fx_run_figures")).select("issue_id", "fid", "check_name", "severity", "message")


SUMMARY = """
    SELECT version_id, figures_checked, passed, warnings, blocking, resolved, by_check FROM (
      SELECT f.version_id, count(*) AS figures_checked, count(*) FILTER (WHERE b.fid IS NULL) AS passed FROM fx_run_figures f
      LEFT JOIN (SELECT DISTINCT version_id, fid FROM fx_issues WHERE status = 'open') b USING (version_id, fid) WHERE f.status = 'active' GROUP BY ALL)
    JOIN (SELECT version_id, CAST(sum(w) AS BIGINT) AS warnings, CAST(sum(b) AS BIGINT) AS blocking, CAST(sum(r) AS BIGINT) AS resolved, string_agg(check_name || '=' || o, ',' ORDER BY check_name) AS by_check
      FROM (SELECT version_id, check_name, count(*) FILTER (WHERE status = 'open' AND severity = 'warning') AS w, count(*) FILTER (WHERE status = 'open' AND severity = 'blocking') AS b,
                   count(*) FILTER (WHERE status = 'resolved') AS r, count(*) FILTER (WHERE status = 'open') AS o FROM fx_issues GROUP BY ALL) GROUP BY ALL) USING (version_id)"""


def _by_check():
    return F.array_join(F.transform(F.array_sort(F.map_entries("by_check")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_check")


@query("a4_run_summary", SUMMARY)
def a4(t):
    return op.run_summary(t("fx_issues"), t("fx_run_figures")).select(
        "version_id", "figures_checked", "passed", "warnings", "blocking", "resolved", _by_check())


CHECKED = f"SELECT version_id, check_name, fid FROM fx_confirmed UNION SELECT version_id, check_name, fid FROM fx_issues WHERE fid IS NOT NULL"


@query("a5_check_cards", f"""
    WITH ck AS ({CHECKED}), v AS (SELECT version_id, bool_or(method = 'text_layer') AS has_text FROM fx_run_figures GROUP BY ALL)
    SELECT version_id, check_name, ran, possible, CASE WHEN ran THEN (SELECT count(*) FROM ck WHERE ck.version_id = s.version_id AND ck.check_name = s.check_name) ELSE 0 END AS checked,
      (SELECT count(*) FROM fx_confirmed c WHERE c.version_id = s.version_id AND c.check_name = s.check_name) AS confirmed,
      (SELECT count(*) FROM fx_issues i WHERE i.version_id = s.version_id AND i.check_name = s.check_name AND status = 'open' AND severity = 'blocking') AS blocking,
      (SELECT count(*) FROM fx_issues i WHERE i.version_id = s.version_id AND i.check_name = s.check_name AND status = 'open' AND severity = 'warning') AS warnings
    FROM (SELECT version_id, check_name, check_name <> 'second_parser' OR has_text AS ran, CASE WHEN has_text THEN 9 ELSE 8 END AS possible FROM v,
      (SELECT unnest({op.CHECKS!r}) AS check_name)) s""")
def a5(t):
    checked = t("fx_confirmed").select("version_id", "check_name", "fid").union(
        t("fx_issues").filter("fid IS NOT NULL").select("version_id", "check_name", "fid"))
    versions = t("fx_run_figures").groupBy("version_id").agg(F.bool_or(F.col("method") == "text_layer").alias("has_text_layer"),
                                                             F.bool_or(F.col("method") == "ocr").alias("has_scanned"))
    return op.check_cards(t("fx_issues"), checked, t("fx_confirmed"), versions)


VOTES = f"""SELECT f.version_id, f.fid, count(DISTINCT c.check_name) AS n FROM fx_run_figures f LEFT JOIN fx_confirmed c ON c.version_id = f.version_id AND c.fid = f.fid AND c.check_name IN {CONF}
    WHERE f.status = 'active' GROUP BY ALL"""


@query("a6_consensus", f"""
    SELECT version_id, count(*) FILTER (WHERE n >= 3) AS three_or_more, count(*) FILTER (WHERE n = 2) AS two, count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n = 0) AS none FROM ({VOTES}) GROUP BY ALL""")
def a6(t):
    return op.consensus(t("fx_run_figures"), t("fx_confirmed"))


@query("a6_unconfirmed_figures", f"SELECT version_id, fid FROM ({VOTES}) WHERE n = 0")
def a6b(t):
    return op.unconfirmed_figures(t("fx_run_figures"), t("fx_confirmed"))


@query("a7_figure_states", f"""
    WITH act AS (SELECT version_id, fid FROM fx_run_figures WHERE status = 'active'),
    o AS (SELECT i.version_id, a.fid IS NOT NULL AS is_fig, COALESCE('f' || i.fid, 'i' || issue_id) AS item, bool_or(severity = 'blocking') AS blk
          FROM fx_issues i LEFT JOIN act a ON a.version_id = i.version_id AND a.fid = i.fid WHERE i.status = 'open' GROUP BY ALL),
    s AS (SELECT version_id, count(*) FILTER (WHERE is_fig AND blk) AS need_attention, count(*) FILTER (WHERE is_fig AND NOT blk) AS notes,
                 count(*) FILTER (WHERE NOT is_fig AND blk) AS other_need_attention, count(*) FILTER (WHERE NOT is_fig AND NOT blk) AS other_notes FROM o GROUP BY ALL),
    p AS (SELECT DISTINCT version_id, fid FROM fx_reviews WHERE action = 'confirm')
    SELECT version_id, figures, figures - need_attention - notes AS passed, need_attention, notes, other_need_attention, other_notes, not_confirmed, need_attention + other_need_attention AS to_decide
    FROM (SELECT version_id, count(*) AS figures FROM act GROUP BY ALL) JOIN s USING (version_id)
    JOIN (SELECT v.version_id, count(*) FILTER (WHERE n = 0 AND p.fid IS NULL) AS not_confirmed FROM ({VOTES}) v LEFT JOIN p ON v.version_id = p.version_id AND v.fid = p.fid GROUP BY ALL) USING (version_id)""")
def a7(t):
    return op.figure_states(t("fx_run_figures"), t("fx_issues").filter("status = 'open'"), t("fx_confirmed"),
                            t("fx_reviews").filter("action = 'confirm'"))


_ROW = "CASE WHEN fid IS NOT NULL AND status = 'open' THEN 'fig:' || fid ELSE 'issue:' || issue_id END"


@query("a8_facet_counts", f"""
    WITH i AS (SELECT *, {_ROW} AS row_key, severity = 'blocking' AS f1, status = 'open' AS f2, page = 5 AS f4 FROM fx_issues)
    SELECT version_id, facet, value, CAST(sum(rows) AS BIGINT) AS rows FROM (
      SELECT version_id, 'severity' AS facet, severity AS value, count(DISTINCT row_key) AS rows FROM i WHERE f2 AND f4 GROUP BY ALL
      UNION ALL SELECT version_id, 'status', status, count(DISTINCT row_key) FROM i WHERE f1 AND f4 GROUP BY ALL
      UNION ALL SELECT version_id, 'check', check_name, count(DISTINCT row_key) FROM i WHERE f1 AND f2 AND f4 GROUP BY ALL
      UNION ALL SELECT version_id, 'page', CAST(page AS VARCHAR), count(DISTINCT row_key) FROM i WHERE f1 AND f2 GROUP BY ALL
      UNION ALL SELECT version_id, 'section', section_id, count(DISTINCT row_key) FROM i WHERE f1 AND f2 AND f4 GROUP BY ALL
      UNION ALL SELECT DISTINCT version_id, f.facet, f.value, 0 FROM i, (VALUES ('severity', 'blocking'), ('status', 'open'), ('page', '5')) AS f(facet, value)) GROUP BY ALL""")
def a8(t):
    return op.facet_counts(t("fx_issues"), {"severity": "blocking", "status": "open", "page": "5"})


@query("a8_review_totals", f"""
    SELECT version_id, count(*) FILTER (WHERE s) AS rows, count(*) FILTER (WHERE g) AS figures, count(*) FILTER (WHERE s AND NOT g) AS notes, count(*) AS all_rows FROM (
      SELECT version_id, {_ROW} AS row_key, bool_or(severity = 'blocking') AS s, bool_or(severity = 'blocking' AND status = 'open' AND issue_id % 6 <> 0 AND check_name NOT IN ('rendered_page','schema','reviewer_flag','completeness')) AS g FROM fx_issues GROUP BY ALL) GROUP BY ALL""")
def a8b(t):
    return op.review_totals(t("fx_issues").withColumn("x0", F.when(F.col("issue_id") % 6 != 0, 10.0)), {"severity": "blocking"})


@query("a9_section_labels", f"""
    WITH u AS (SELECT report_id, section_id, ord, page, {USABLE} AS h FROM {USABLE_FROM}),
    n AS (SELECT *, row_number() OVER (PARTITION BY report_id, page, h IS NULL ORDER BY ord) AS k FROM u)
    SELECT report_id, section_id, CASE WHEN h IS NOT NULL THEN 'p' || page || ' · ' || CASE WHEN length(h) > 60 THEN left(h, 57) || '…' ELSE h END ELSE 'Section on page ' || page || CASE WHEN k > 1 THEN ' · ' || k ELSE '' END END AS label FROM n""")
def a9(t):
    return op.section_labels(t("fx_sections")).select("report_id", "section_id", "label")


LATEST = "SELECT i.* FROM fx_issues i JOIN (SELECT version_id, max(run_no) AS run_no FROM fx_issues GROUP BY ALL) USING (version_id, run_no)"


@query("a10_issues_overview", f"""
    SELECT t.name AS tenant, v.version_id, v.version_no, 'FY' || r.fiscal_year || ' ' || upper(r.period) || ' ' || r.report_type AS report, v.status, count(*) FILTER (WHERE i.severity = 'blocking') AS blocking,
      count(*) FILTER (WHERE i.severity = 'warning') AS warning FROM ({LATEST}) i JOIN fx_versions v ON i.version_id = v.version_id JOIN fx_reports r ON r.report_id = v.report_id JOIN fx_tenants t ON t.tenant_id = r.tenant_id
    WHERE i.status = 'open' GROUP BY ALL""")
def a10(t):
    return op.issues_overview(t("fx_issues"), t("fx_versions"), t("fx_reports"), t("fx_tenants"))


@query("a10_issues_by_check", f"""
    SELECT check_name, count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'warning') AS warning FROM ({LATEST}) WHERE status = 'open' GROUP BY ALL""")
def a10b(t):
    return op.issues_by_check(t("fx_issues"))


def _reuse(t):
    v = t("fx_versions").join(t("fx_version_links"), "version_id").withColumnRenamed("schema_sha", "content_sha").withColumnRenamed("checked_schema_sha", "checked_content_sha")
    return op.reuse_findings(v, "v1")


REUSE = """SELECT version_id, CASE WHEN has_summary THEN version_id ELSE created_from END AS findings_from,
      CASE WHEN same AND has_summary AND checked_bundle_sha = bundle_sha THEN 'none' WHEN same AND b = 'v1' THEN 'page_only' ELSE 'full' END AS needs
    FROM (SELECT v.*, l.created_from, CASE WHEN v.has_summary THEN v.checked_schema_sha = v.schema_sha ELSE o.checked_schema_sha = v.schema_sha END AS same, CASE WHEN v.has_summary THEN v.build ELSE o.build END AS b
          FROM fx_versions v JOIN fx_version_links l USING (version_id) LEFT JOIN fx_versions o ON o.version_id = l.created_from AND o.has_summary)"""


@query("a11_reuse_findings", REUSE)
def a11(t):
    return _reuse(t)


@query("a11_kept_findings", f"""
    SELECT r.version_id, i.issue_id, i.check_name, 'open' AS status FROM ({LATEST}) i JOIN ({REUSE}) r ON r.findings_from = i.version_id AND r.needs = 'page_only'
    WHERE i.check_name NOT IN ('rendered_page','completeness','reviewer_flag')""")
def a11b(t):
    return op.kept_findings(t("fx_issues"), _reuse(t)).select("version_id", "issue_id", "check_name", "status")


@query("a12_carry_flags", """
    SELECT issue_id, i.version_id, check_name, status, CASE WHEN check_name = 'reviewer_flag' AND status = 'open' THEN m.run_no ELSE i.run_no END AS run_no
    FROM fx_issues i JOIN (SELECT version_id, max(run_no) AS run_no FROM fx_issues GROUP BY ALL) m ON m.version_id = i.version_id""")
def a12(t):
    return op.carry_flags(t("fx_issues")).select("issue_id", "version_id", "check_name", "status", "run_no")


@query("a13_propagate_decisions", """
    WITH d AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'confirm' ELSE 'not_a_figure' END AS action FROM fx_issues JOIN events ON event_id = issue_id WHERE CAST(floor(events.value) AS BIGINT) % 10 = 3),
    a AS (SELECT version_id, run_no, fid, arg_max(action, issue_id) AS action FROM d WHERE fid IS NOT NULL AND check_name <> 'reviewer_flag' GROUP BY ALL)
    SELECT issue_id, CASE WHEN r IS NULL THEN status ELSE 'resolved' END AS status, r AS resolution FROM (
      SELECT i.issue_id, i.status, COALESCE(d.action, CASE WHEN i.status = 'open' AND i.check_name NOT IN ('rendered_page','schema','reviewer_flag') THEN a.action END) AS r
      FROM fx_issues i LEFT JOIN d ON d.issue_id = i.issue_id LEFT JOIN a ON a.version_id = i.version_id AND a.run_no = i.run_no AND a.fid = i.fid)""")
def a13(t):
    decisions = t.sql("SELECT event_id AS issue_id, CASE WHEN event_id % 2 = 0 THEN 'confirm' ELSE 'not_a_figure' END AS action FROM {events} WHERE CAST(floor(value) AS BIGINT) % 10 = 3")
    return op.propagate_decisions(t("fx_issues"), decisions).select("issue_id", "status", "resolution")
