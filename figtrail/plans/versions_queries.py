"""V1–V14, U1–U11 and T1–T3 over versions, ledger and visits derived from orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import traffic, usage
from figtrail.operators import versions as op
from figtrail.operators.versions import Viewer
from figtrail.plans import duck
from figtrail.plans.registry import query
from figtrail.session import cut

MONTH, NOW = "2024-01-01", "2024-01-31 00:00:00"
RUNS = "SELECT version_id, arg_max(b, run_no) AS open_blocking, max(run_no) AS run_no FROM (SELECT version_id, run_no, count(*) FILTER (WHERE severity = 'blocking' AND status = 'open') AS b FROM fx_issues GROUP BY ALL) GROUP BY ALL"
DATE = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("v1_tenant_view", "SELECT issue_id FROM (SELECT issue_id, version_id % 5 AS tenant_id FROM fx_issues) WHERE tenant_id = 3")
def v1(t):
    return op.tenant_view(t("fx_issues").withColumn("tenant_id", F.col("version_id") % 5), Viewer(tenant_id=3)).select("issue_id")


@query("v1_tenant_view_nobody", "SELECT issue_id FROM fx_issues WHERE FALSE")
def v1b(t):
    return op.tenant_view(t("fx_issues"), Viewer()).select("issue_id")


@query("v2_latest_versions", "SELECT report_id, version_id, version_no, status FROM fx_versions QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY version_no DESC) = 1")
def v2(t):
    return op.latest_versions(t("fx_versions"), ["version_id", "version_no", "status"])


@query("v3_latest_runs", f"SELECT version_id, run_no, open_blocking FROM ({RUNS})")
def v3(t):
    return op.latest_runs(t("fx_issues"))


LIVE = """SELECT r.tenant_id, r.report_id, r.live_version_id, v.version_no, r.fiscal_year, r.period, CASE r.period WHEN 'q1' THEN 1 WHEN 'h1' THEN 2 WHEN 'q2' THEN 2 WHEN 'q3' THEN 3 WHEN '9m' THEN 3 WHEN 'q4' THEN 4 WHEN 'h2' THEN 4 ELSE 5 END AS period_rank,
    strftime(v.published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM fx_reports r JOIN fx_versions v ON v.version_id = r.live_version_id WHERE r.deleted_at IS NULL AND v.bundle_key IS NOT NULL AND v.schema_sha IS NOT NULL"""


@query("v4_live_archive", LIVE)
def v4(t):
    return op.live_archive(t("fx_reports"), t("fx_versions")).withColumn("published_at", ts("published_at"))


@query("v4_archive_beside", f"SELECT * FROM ({LIVE}) WHERE report_id <> 7 AND tenant_id = (SELECT tenant_id FROM fx_reports WHERE report_id = 7)")
def v4b(t):
    return op.archive_beside(7, t("fx_reports"), t("fx_versions")).withColumn("published_at", ts("published_at"))


@query("v5_report_status", """
    SELECT r.report_id, CASE WHEN l.version_id IS NULL THEN 'Processing' WHEN r.live_version_id IS NOT NULL AND l.version_id <> r.live_version_id AND l.status <> 'superseded' THEN 'Draft changes'
      WHEN r.live_version_id = l.version_id THEN 'Live' WHEN l.status = 'published' THEN 'Live' ELSE upper(l.status[1]) || replace(l.status[2:], '_', ' ') END AS status_label
    FROM fx_reports r LEFT JOIN (SELECT * FROM fx_versions QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY version_no DESC) = 1) l USING (report_id)""")
def v5(t):
    latest = op.latest_versions(t("fx_versions"), ["version_id", "version_no", "status"])
    return op.report_status(t("fx_reports"), latest).select("report_id", "status_label")


def _linked(t):
    return t("fx_versions").join(t("fx_version_links"), "version_id")


@query("v6_step_states", f"""
    WITH j AS (SELECT version_id, bool_or(st AND status IN ('queued','running')) AS active, bool_or(st AND status IN ('queued','running') AND NOT design_only) AS content,
        bool_or(status IN ('queued','running') AND kind IN ('pipeline.extract','pipeline.render')) AS building,
        arg_max(status = 'failed' AND design_only, (finished_at, job_id)) FILTER (WHERE st AND status IN ('succeeded','failed')) AS design_fail
      FROM (SELECT *, kind LIKE 'pipeline.%' AS st FROM fx_jobs) GROUP BY ALL)
    SELECT v.version_id,
      CASE WHEN status = 'failed' AND NOT COALESCE(design_fail, FALSE) THEN 'failed' WHEN COALESCE(content, FALSE) OR (status = 'processing' AND NOT COALESCE(active, FALSE)) THEN 'running'
        WHEN has_summary OR (created_from IS NOT NULL AND NOT COALESCE(content, FALSE)) THEN CASE WHEN COALESCE(open_blocking, 0) > 0 THEN 'blocked' ELSE 'done' END WHEN status = 'processing' THEN 'running' ELSE 'failed' END AS verify,
      CASE WHEN status = 'failed' THEN 'failed' WHEN COALESCE(building, FALSE) THEN 'building' WHEN status = 'processing' THEN CASE WHEN bundle_key IS NULL THEN 'building' ELSE 'checking' END WHEN bundle_key IS NULL THEN 'not_built' ELSE 'ready' END AS review
    FROM fx_versions v JOIN fx_version_links USING (version_id) LEFT JOIN j USING (version_id) LEFT JOIN ({RUNS}) r USING (version_id)""")
def v6(t):
    return op.step_states(_linked(t), t("fx_jobs"), op.latest_runs(t("fx_issues")))


_UNF = "(?i)\\b(?:placeholder|lorem\\s+ipsum|todo|tbd|replace\\s+this)\\b|\\[[A-Za-z][^\\]\\n]{0,60}\\]|\\{\\{[^}\\n]{0,60}\\}\\}"


@query("v7_publish_readiness", f"""
    SELECT version_id, array_to_string(list_filter([CASE WHEN published_at IS NOT NULL THEN 'already_published' END, CASE WHEN status = 'processing' THEN 'processing' END, CASE WHEN status = 'failed' THEN 'failed' END,
      CASE WHEN open_blocking > 0 THEN 'blocking_open' END, CASE WHEN NOT COALESCE(checked_schema_sha = schema_sha AND checked_bundle_sha = bundle_sha, FALSE) THEN 'changed_since_check' END,
      CASE WHEN d IS NOT NULL AND regexp_matches(d, '{_UNF}') THEN 'unfinished_disclaimer' WHEN d IS NOT NULL AND d IS DISTINCT FROM disclaimer THEN 'outdated_disclaimer' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT v.*, json_extract_string(theme_snapshot, '$.disclaimer') AS d, t.disclaimer, r.open_blocking FROM fx_versions v LEFT JOIN fx_tenants t USING (tenant_id) LEFT JOIN ({RUNS}) r USING (version_id))""")
def v7(t):
    return op.publish_readiness(t("fx_versions"), op.latest_runs(t("fx_issues")), t("fx_tenants")).withColumn("reasons", F.array_join("reasons", ","))


@query("v8_version_history", "SELECT v.report_id, v.version_id, v.version_no, v.status, lag(v.version_no) OVER (PARTITION BY v.report_id ORDER BY v.version_no) AS from_version_no FROM fx_versions v")
def v8(t):
    return op.version_history(_linked(t))


@query("v9_unfinished_footers", f"""
    SELECT t.name AS tenant, r.company_name, r.fiscal_year, r.period, v.version_id, v.version_no, regexp_extract(json_extract_string(theme_snapshot, '$.disclaimer'), '{_UNF}') AS unfinished
    FROM fx_versions v JOIN fx_reports r ON r.live_version_id = v.version_id JOIN fx_tenants t ON t.tenant_id = r.tenant_id WHERE r.deleted_at IS NULL AND regexp_matches(json_extract_string(theme_snapshot, '$.disclaimer'), '{_UNF}')""")
def v9(t):
    return op.unfinished_footers(t("fx_versions"), t("fx_reports"), t("fx_tenants"))


@query("v9_drafts_with_old_footer", """
    SELECT v.version_id, v.report_id, r.tenant_id AS owner FROM fx_versions v JOIN fx_reports r USING (report_id) JOIN fx_tenants t ON t.tenant_id = r.tenant_id
    WHERE r.deleted_at IS NULL AND v.published_at IS NULL AND v.bundle_key IS NOT NULL AND NOT (v.status = 'processing' AND split_part(v.stage, ':', 1) IN ('extract','queued'))
      AND json_extract_string(theme_snapshot, '$.disclaimer') IS NOT NULL AND json_extract_string(theme_snapshot, '$.disclaimer') IS DISTINCT FROM t.disclaimer""")
def v9b(t):
    return op.drafts_with_old_footer(t("fx_versions"), t("fx_reports"), t("fx_tenants"))


@query("v10_tenant_overview", """
    SELECT tenant_id, name, plan, COALESCE(m.n, 0) AS member_count, COALESCE(m.a, 0) AS admin_count, COALESCE(m.a, 0) = 0 AS admin_gap, COALESCE(c.used, 0) AS credits_month
    FROM fx_tenants t LEFT JOIN (SELECT tenant_id, count(*) AS n, count(*) FILTER (WHERE role = 'tenant_admin') AS a FROM fx_users GROUP BY ALL) m USING (tenant_id)
    LEFT JOIN (SELECT tenant_id, CAST(ceil(sum(credits)) AS BIGINT) AS used FROM fx_priced WHERE created_at >= DATE '2024-01-01' GROUP BY ALL) c USING (tenant_id)""")
def v10(t):
    return op.tenant_overview(t("fx_tenants"), t("fx_users"), usage.month_credits(t("fx_priced"), MONTH))


@query("v11_audit_page", "SELECT audit_id, action, detail, email AS actor FROM (SELECT * FROM fx_audit WHERE tenant_id = 2 AND audit_id < 800 ORDER BY audit_id DESC LIMIT 50) a LEFT JOIN fx_users u ON u.user_id = a.actor_id")
def v11(t):
    return op.audit_page(t("fx_audit"), t("fx_users"), Viewer(tenant_id=2), 800, 50)


@query("v12_review_trail", "SELECT version_id, at_no, fid, action, note, email AS by FROM fx_reviews JOIN fx_users USING (user_id)")
def v12(t):
    return op.review_trail(t("fx_reviews"), t("fx_users"))


@query("v12_comment_list", "SELECT version_id, 's' || (turn % 5) AS section_id, text AS body, email AS by, turn % 3 = 0 AS resolved, at_no AS created_no FROM (SELECT conv_id % 15 AS version_id, turn, text, conv_id % 6 AS user_id, conv_id * 100 + turn AS at_no FROM conversations) JOIN fx_users USING (user_id)")
def v12b(t):
    comments = t.sql("SELECT conv_id % 15 AS version_id, concat('s', CAST(turn % 5 AS STRING)) AS section_id, text AS body, conv_id % 6 AS user_id, CASE WHEN turn % 3 = 0 THEN turn END AS resolved_at, conv_id * 100 + turn AS created_no FROM {conversations}")
    return op.comment_list(comments, t("fx_users"))


UPLOADS = f"""SELECT *, CASE WHEN trim(company_name) = '' THEN 'company_name' WHEN report_type NOT IN ('quarterly_results','investor_presentation','annual_report','other') THEN 'report_type'
      WHEN fr IS NOT NULL THEN 'fiscal_year:' || fr WHEN lower(period) NOT IN ('q1','q2','q3','q4','h1','h2','9m','fy') THEN 'period' WHEN length(trim(currency)) <> 3 THEN 'currency' WHEN reporting_unit = '' THEN 'reporting_unit'
      WHEN period_end IS NOT NULL AND COALESCE(precision, '') <> 'day' THEN 'period_end' END AS reason
    FROM (SELECT *, CASE WHEN m.a = '' AND regexp_matches(s, '(?i)^(Q[1-4]|H[12]|9\\s?M|[1-4]Q)\\s?-?\\s?(.*)$') THEN 'has_period' WHEN m.a = '' THEN 'not_a_year'
        WHEN m.p = '' AND length(m.a) = 2 AND m.b = '' THEN 'two_digits' WHEN m.b <> '' AND length(m.a) = 2 THEN 'two_digit_start'
        WHEN m.b <> '' AND y <> TRY_CAST(m.a AS INT) + 1 THEN 'not_one_year' WHEN y NOT BETWEEN 1990 AND 2100 THEN 'out_of_range' END AS fr
    FROM (SELECT *, {duck.end_year('m.a', 'm.b')} AS y FROM (
      SELECT *, regexp_extract(s, '(?i)^(F\\.?\\s?Y\\.?|fiscal(?: year)?|financial year)?\\s?('')?(\\d{{4}}|\\d{{2}})(?:-(\\d{{4}}|\\d{{2}}))?$', ['p','q','a','b']) AS m FROM (
      SELECT *, regexp_replace(trim(regexp_replace(fiscal_year, '\\s+', ' ', 'g')), '\\s*[-–—‒−/]\\s*', '-', 'g') AS s FROM ({duck.date("SELECT * FROM fx_uploads", "period_end")})))))"""


@query("v13_validate_uploads", f"SELECT upload_id, trim(company_name) AS company_name, lower(period) AS period, trim(upper(currency)) AS currency, CASE WHEN fr IS NULL THEN y END AS fy_year, CASE WHEN precision = 'day' THEN iso END AS period_end_iso, reason FROM ({UPLOADS})")
def v13(t):
    return op.validate_uploads(t("fx_uploads")).select("upload_id", "company_name", "period", "currency", "fy_year", "period_end_iso", "reason")


@query("v14_next_versions", f"""
    WITH u AS (SELECT upload_id, tenant_key % 20 AS tenant_id, lower(period) AS period, report_type, y AS fy_year, at_ts FROM ({UPLOADS}) WHERE reason IS NULL),
    k AS (SELECT tenant_id, fiscal_year AS fy_year, period, report_type, min(report_id) AS report_id FROM fx_reports WHERE deleted_at IS NULL GROUP BY ALL)
    SELECT upload_id, report_id, COALESCE(mx, 0) + n AS version_no, report_id IS NULL AND n = 1 AS new_report FROM (
      SELECT u.*, k.report_id, row_number() OVER (PARTITION BY u.tenant_id, u.fy_year, u.period, u.report_type ORDER BY at_ts, upload_id) AS n FROM u LEFT JOIN k USING (tenant_id, fy_year, period, report_type))
    LEFT JOIN (SELECT report_id, max(version_no) AS mx FROM fx_versions GROUP BY ALL) USING (report_id)""")
def v14(t):
    accepted = op.validate_uploads(t("fx_uploads")).filter("reason IS NULL").select(
        "upload_id", (F.col("tenant_key") % 20).alias("tenant_id"), "period", "report_type", "fy_year", "at_ts")
    return op.next_versions(accepted, t("fx_reports"), t("fx_versions")).select("upload_id", "report_id", "version_no", "new_report")


# ------------------------------------------------------------------ ledger

@query("u1_price_usage", """
    SELECT usage_id, round_even(m / 100.0, 0) / 1e6 AS usd, round_even(m / 100.0, 0) / 1e4 AS credits
    FROM (SELECT usage_id, CASE provider WHEN 'gemini' THEN input_tokens * 30 + output_tokens * 250 ELSE input_tokens * 200 + output_tokens * 1000 END AS m FROM fx_usage)""")
def u1(t):
    return usage.price_usage(t("fx_usage"), usage.price_table(t.spark)).select(
        "usage_id", F.col("usd").cast("double").alias("usd"), F.col("credits").cast("double").alias("credits"))


@query("u2_month_allowance", """
    SELECT tenant_id, credit_limit AS "limit", COALESCE(used, 0) AS used, CASE WHEN credit_limit IS NOT NULL THEN greatest(0, credit_limit - COALESCE(used, 0)) END AS remaining, COALESCE(COALESCE(used, 0) >= credit_limit, FALSE) AS limit_reached
    FROM fx_tenants LEFT JOIN (SELECT tenant_id, CAST(ceil(sum(credits)) AS BIGINT) AS used FROM fx_priced WHERE created_at >= DATE '2024-01-01' GROUP BY ALL) USING (tenant_id)""")
def u2(t):
    return usage.month_allowance(t("fx_tenants"), t("fx_priced"), MONTH)


_LABEL = "CASE feature WHEN 'ai_check' THEN 'AI double-check of flagged figures' WHEN 'section_labels' THEN 'AI section labelling' WHEN 'page_layout' THEN 'AI layout of design pages' ELSE 'AI chapter detection for the sidebar' END"


@query("u3_usage_by_feature", f"""
    SELECT tenant_id, feature, CASE WHEN feature IS NULL THEN 'Total' ELSE {_LABEL} END AS label, requests, tin AS input_tokens, tout AS output_tokens, CAST(round_even(usd, 4) AS DOUBLE) AS usd, CAST(ceil(credits) AS BIGINT) AS credits FROM (
      SELECT tenant_id, feature, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS tin, CAST(sum(output_tokens) AS BIGINT) AS tout, sum(usd) AS usd, sum(credits) AS credits FROM fx_priced WHERE created_at >= DATE '2024-01-01' GROUP BY ROLLUP (tenant_id, feature)) WHERE tenant_id IS NOT NULL""")
def u3(t):
    return usage.usage_by_feature(t("fx_priced"), MONTH).withColumn("usd", F.col("usd").cast("double"))


_RLABEL = "CASE WHEN company_name IS NOT NULL THEN company_name || ' · ' || CASE WHEN period = 'fy' THEN 'FY' || fiscal_year ELSE upper(period) || ' FY' || fiscal_year END END"


@query("u4_recent_usage", f"""
    SELECT usage_id, feature, report_id, {_RLABEL} AS report FROM (SELECT * FROM fx_priced WHERE tenant_id = 1 ORDER BY created_at DESC, usage_id DESC LIMIT 20) LEFT JOIN (SELECT version_id, report_id FROM fx_versions) USING (version_id) LEFT JOIN fx_reports USING (report_id)""")
def u4(t):
    return usage.recent_usage(t("fx_priced"), t("fx_versions"), t("fx_reports"), 1, 20).select("usage_id", "feature", "report_id", "report")


@query("u5_usage_months", """
    SELECT tenant_id, strftime(created_at, '%Y-%m') AS month, count(*) AS requests, CAST(ceil(sum(credits)) AS BIGINT) AS credits, CAST(round_even(sum(usd), 4) AS DOUBLE) AS usd FROM fx_priced WHERE created_at >= DATE '2023-02-01' GROUP BY ALL""")
def u5(t):
    return usage.usage_months(t("fx_priced"), MONTH).withColumn("usd", F.col("usd").cast("double"))


@query("u6_usage_by_report", f"""
    SELECT tenant_id, report_id, {_RLABEL} AS report, CAST(sum(n) AS BIGINT) AS requests, CAST(ceil(sum(c)) AS BIGINT) AS credits, string_agg(feature || '=' || CAST(ceil(c) AS BIGINT), ',' ORDER BY feature) AS features,
      array_to_string(list_sort(list_distinct(flatten(list(vs)))), ',') AS versions
    FROM (SELECT p.tenant_id, v.report_id, r.company_name, r.period, r.fiscal_year, feature, count(*) AS n, sum(credits) AS c, list(DISTINCT version_no) FILTER (WHERE version_no IS NOT NULL) AS vs
      FROM fx_priced p LEFT JOIN fx_versions v USING (version_id) LEFT JOIN fx_reports r ON r.report_id = v.report_id WHERE p.created_at >= DATE '2024-01-01' AND p.created_at < DATE '2024-02-01' GROUP BY ALL) GROUP BY tenant_id, report_id, company_name, period, fiscal_year""")
def u6(t):
    df = usage.usage_by_report(t("fx_priced"), t("fx_versions"), t("fx_reports"), MONTH)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select("tenant_id", "report_id", "report", "requests", "credits", text.alias("features"), F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"))


@query("u7_usage_page", f"""
    SELECT usage_id, feature, provider, version_no, {_RLABEL} AS report FROM (SELECT * FROM fx_priced WHERE tenant_id = 1 AND created_at >= DATE '2024-01-01' AND created_at < DATE '2024-02-01' ORDER BY created_at DESC, usage_id DESC LIMIT 50 OFFSET 50)
    LEFT JOIN (SELECT version_id, report_id, version_no FROM fx_versions) USING (version_id) LEFT JOIN fx_reports USING (report_id)""")
def u7(t):
    return usage.usage_page(t("fx_priced"), t("fx_versions"), t("fx_reports"), 1, MONTH, 2, 50).select("usage_id", "feature", "provider", "version_no", "report")


@query("u8_plan_allowances", """
    SELECT tenant_id, COALESCE(plan, 'free') AS plan, CASE COALESCE(plan, 'free') WHEN 'free' THEN 50 WHEN 'starter' THEN 500 WHEN 'pro' THEN 2000 ELSE credit_limit END AS allowance FROM fx_tenants""")
def u8(t):
    return usage.plan_allowances(t("fx_tenants"), usage.plan_table(t.spark)).select("tenant_id", "plan", "allowance")


_PC = "CAST(greatest(0, page_count - 1) AS BIGINT)"


@query("u9_spend_estimates", f"""
    SELECT report_id, page_count, l AS layout_credits, b AS label_credits, 20 AS check_credits, l AS max_layout, l + b + 20 AS max_full, CAST(ceil(page_count / 12.0) AS BIGINT) AS check_requests,
      CAST(ceil((CAST(page_count * 266 + ceil(page_count / 12.0) * 160 AS DECIMAL(18,0)) * 0.30 + page_count * 18 * 2.50) / 10000) AS BIGINT) AS check_cost
    FROM (SELECT *, CAST(ceil(({_PC} * 6300 * 0.30 + {_PC} * 640 * 2.50) / 10000) AS BIGINT) AS l, CAST(ceil(((greatest(1, page_count) * 2 * 150 + 300) * 2.0 + 10240.0) / 10000) AS BIGINT) AS b FROM (SELECT c_custkey AS report_id, c_custkey % 600 AS page_count FROM customer))""")
def u9(t):
    df = usage.spend_estimates(t("customer").select(F.col("c_custkey").alias("report_id"), (F.col("c_custkey") % 600).alias("page_count")))
    n = usage.check_credits(F.col("page_count"))
    return df.withColumns({"check_requests": n["requests"], "check_cost": n["credits"]})


# figures with their page and, for most, a box; every answer given is one about a value
_SHOWN = "SELECT *, CAST(substr(fid, 4) AS INT) % 9 + 1 AS page, CASE WHEN CAST(substr(fid, 4) AS INT) % 17 <> 5 THEN CAST(10 AS DOUBLE) END AS x0 FROM fx_run_figures"


@query("u10_second_opinion_queue", f"""
    WITH q AS (SELECT DISTINCT version_id, fid FROM fx_issues WHERE status = 'open' AND severity = 'blocking' AND fid IS NOT NULL AND check_name IN ('re_extraction','low_confidence')),
    r AS (SELECT f.*, row_number() OVER (PARTITION BY version_id ORDER BY f.method <> 'ocr', page, fid) AS rank FROM q JOIN ({_SHOWN}) f USING (version_id, fid)
      WHERE x0 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_opinions o WHERE o.version_id = f.version_id AND o.fid = f.fid AND o.seen_raw = f.raw)),
    c AS (SELECT *, CAST(ceil((CAST(rank * 266 + ((rank + 11) // 12) * 160 AS DECIMAL(18,0)) * 0.30 + rank * 18 * 2.50) / 10000) AS BIGINT) AS cost FROM r)
    SELECT version_id, fid, rank, cost FROM c WHERE cost <= version_id % 3""")
def u10(t):
    budgets = t("fx_run_figures").select("version_id").distinct().withColumn("budget", F.col("version_id") % 3)
    answers = t("fx_opinions").withColumnRenamed("seen_raw", "raw")
    return usage.second_opinion_queue(t("fx_issues"), t.sql(_SHOWN), budgets, answers).select("version_id", "fid", "rank", "cost")


_SIG = "concat_ws('|', CAST(line_no AS VARCHAR), 'text', CAST(CAST(round_even(x0, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(y0, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(x1, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(y1, 0) AS BIGINT) AS VARCHAR), text)"
_ELS = "SELECT report_id, page, line_no AS element_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(text, word_no) AS text FROM fx_words GROUP BY report_id, page, line_no"


@query("u11_layout_queue", f"""
    WITH e AS (SELECT report_id, page, sha256('5' || chr(10) || string_agg({_SIG.replace('line_no', 'element_id')}, chr(10) ORDER BY element_id))[1:16] AS fingerprint, count(*) AS elements FROM ({_ELS}) GROUP BY report_id, page),
    t AS (SELECT * FROM e WHERE NOT (page % 5 = 0) AND NOT (page % 7 = 1)),
    s AS (SELECT *, sum(((elements * 45 + 1800) * 0.30 + (elements * 6 + 40) * 2.50) / 10000) OVER (PARTITION BY report_id ORDER BY page) AS spent FROM t)
    SELECT report_id, page, fingerprint, elements, CAST(round(spent * 1e6) AS BIGINT) AS spent FROM s WHERE spent <= 0.5""")
def u11(t):
    els = t("fx_words").groupBy("report_id", "page", F.col("line_no").alias("element_id")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("text", "word_no").alias("text"), F.lit("text").alias("kind"))
    pages = cut(usage.page_fingerprints(els))  # one row a page, read for the pages, the cache and the budgets
    failed = F.when(F.col("page") % 7 == 1, F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))
    cache = pages.filter((F.col("page") % 5 == 0) | (F.col("page") % 7 == 1)).select("report_id", "page", "fingerprint", (F.col("page") % 5 == 0).alias("has_layout"), failed.alias("failed_at"))
    budgets = pages.select("report_id").distinct().withColumn("budget", F.lit("0.5").cast("decimal(20,6)"))
    return usage.layout_queue(pages, cache, budgets, NOW).select("report_id", "page", "fingerprint", "elements", (F.col("spent") * 1000000).cast("bigint").alias("spent"))


# ------------------------------------------------------------------ traffic

_HITS = f"(SELECT *, {duck.agent('user_agent')} AS cls FROM fx_hits WHERE at_ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY AND status < 400)"


@query("t1_traffic_by_report", f"""
    SELECT p.tenant_id, p.report_id, views, crawlers, COALESCE(CASE WHEN r.period = 'fy' THEN '' ELSE upper(r.period) || ' ' END || 'FY' || r.fiscal_year || ' ' || CASE r.report_type WHEN 'quarterly_results' THEN 'results' WHEN 'annual_report' THEN 'annual report' ELSE 'investor presentation' END, 'Site pages') AS label
    FROM (SELECT tenant_id, report_id, CAST(COALESCE(sum(n) FILTER (WHERE cls = 'human'), 0) AS BIGINT) AS views, COALESCE(string_agg(cls[5:] || '=' || n, ',' ORDER BY cls[5:]) FILTER (WHERE cls <> 'human'), '') AS crawlers
      FROM (SELECT tenant_id, report_id, cls, count(*) AS n FROM {_HITS} GROUP BY ALL) GROUP BY ALL) p LEFT JOIN fx_reports r USING (report_id)""")
def t1(t):
    text = F.array_join(F.transform(F.map_entries("crawlers"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return traffic.traffic_by_report(t("fx_hits"), t("fx_reports"), NOW).select("tenant_id", "report_id", "views", text.alias("crawlers"), "label")


@query("t2_traffic_daily", f"SELECT tenant_id, CAST(at_ts AS DATE) AS day, count(*) FILTER (WHERE cls = 'human') AS views, count(*) FILTER (WHERE cls <> 'human') AS crawler_visits FROM {_HITS} GROUP BY ALL")
def t2(t):
    return traffic.traffic_daily(t("fx_hits"), NOW)


@query("t3_traffic_by_crawler", f"SELECT tenant_id, cls[5:] AS crawler, count(*) AS visits FROM {_HITS} WHERE cls <> 'human' GROUP BY ALL")
def t3(t):
    return traffic.traffic_by_crawler(t("fx_hits"), NOW)
