"""The driver tables seen in the shapes the library works on.

Every adapter is one SQL text that both Spark and DuckDB read, so an operator and its oracle start from the same
rows. Errors are planted by key modulus. Adapters only reshape whole tables; none takes a subset.
"""

from __future__ import annotations

import re

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
                 "labels conversations").split()

# Adapters that need an array function spelled differently by the two engines use {explode:…} marks, see `render`.
FIXTURES: dict[str, str] = {
    # ---- figures in tables
    "fx_cells": """
        SELECT report_id, 't1' AS table_id, row_no, label, c AS col_no,
               CASE c WHEN 1 THEN price WHEN 2 THEN qty ELSE tax END AS raw
        FROM (SELECT l_orderkey AS report_id,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax, l_discount, l_shipdate) AS row_no,
                     concat('Line ', CAST(l_linenumber AS STRING)) AS label,
                     CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price,
                     CAST(CAST(l_quantity AS DECIMAL(18,0)) AS STRING) AS qty,
                     CAST(CAST(l_tax AS DECIMAL(18,2)) AS STRING) AS tax
              FROM {lineitem}
              UNION ALL
              SELECT l_orderkey, 1 + count(*), CASE WHEN l_orderkey % 5 = 0 THEN 'Net total' ELSE 'Total' END,
                     CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) + CASE WHEN l_orderkey % 7 = 0 THEN CAST(1 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS STRING),
                     CAST(sum(CAST(l_quantity AS DECIMAL(18,0))) + CASE WHEN l_orderkey % 21 = 0 THEN 7 ELSE 0 END AS STRING),
                     CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS STRING)
              FROM {lineitem} GROUP BY l_orderkey) x
        CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    # the same tables with a column that states a change, whose figures neither add up nor balance
    "fx_stated_cells": """
        SELECT report_id, table_id, row_no, label, col_no, raw, CASE col_no WHEN 1 THEN 'Q2 FY25' WHEN 2 THEN 'Quantity' ELSE 'Tax' END AS col_label FROM fx_cells
        UNION ALL SELECT report_id, table_id, row_no, label, 4, concat(CAST(row_no + 3 AS STRING), '.5'), 'YoY' FROM fx_cells WHERE col_no = 1""",
    "fx_stated_balance": """
        SELECT report_id, table_id, row_no, label, col_no, raw, 'Amount' AS col_label FROM fx_balance
        UNION ALL SELECT report_id, table_id, row_no, label, 2, concat(CAST(row_no AS STRING), '.5'), '% Change' FROM fx_balance""",
    "fx_balance": """
        SELECT o_custkey AS report_id, 'b1' AS table_id, r AS row_no, 1 AS col_no,
               CASE r WHEN 1 THEN 'Total assets' WHEN 2 THEN 'Other income' ELSE 'Total equity and liabilities' END AS label,
               CAST(CASE WHEN r = 3 AND o_custkey % 11 = 0 THEN total + CAST(0.5 AS DECIMAL(18,2)) ELSE total END AS STRING) AS raw
        FROM (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM {orders} GROUP BY o_custkey) x
        CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "fx_sales": """
        SELECT c_mktsegment AS row_label, year(l_shipdate) AS y, quarter(l_shipdate) AS q,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        GROUP BY c_mktsegment, year(l_shipdate), quarter(l_shipdate)""",
    # columns of one table per year pair and quarter: 1 = this quarter, 2 = same quarter last year, 3 = stated change
    "fx_change_cells": """
        SELECT concat('r', CAST(a.y AS STRING)) AS report_id, concat('q', CAST(a.q AS STRING)) AS table_id, a.row_label AS label,
               c AS col_no,
               CASE c WHEN 1 THEN concat('Q', CAST(a.q AS STRING), ' FY', CAST(a.y AS STRING))
                      WHEN 2 THEN concat('Q', CAST(a.q AS STRING), ' FY', CAST(a.y - 1 AS STRING)) ELSE 'YoY growth' END AS col_label,
               CASE c WHEN 1 THEN CAST(a.amount AS STRING) WHEN 2 THEN CAST(b.amount AS STRING)
                      ELSE concat(CAST(CAST((CAST(a.amount AS DOUBLE) / CAST(b.amount AS DOUBLE) - 1) * 100
                           + CASE WHEN (a.y + a.q + length(a.row_label)) % 3 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,1)) AS STRING), '%') END AS raw
        FROM fx_sales a JOIN fx_sales b ON a.row_label = b.row_label AND a.q = b.q AND a.y = b.y + 1
        CROSS JOIN (SELECT 1 AS c UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    # the same line printed in a highlights table and in a statement; one of them off when planted
    "fx_table_figures": """
        SELECT concat(report_id, table_id) AS report_id, concat('p', CAST(t AS STRING), 'f', label, CAST(col_no AS STRING)) AS fid, t AS page,
               concat('t', CAST(t AS STRING)) AS table_id, CASE t WHEN 1 THEN label ELSE upper(label) END AS row_label,
               col_label, 'number' AS kind, 'crore' AS unit, 'INR' AS currency, 'cell' AS role, 'active' AS status,
               CASE WHEN t = 2 AND length(raw) % 3 = 0 THEN concat(raw, '1') ELSE raw END AS raw
        FROM fx_change_cells CROSS JOIN (SELECT 1 AS t UNION ALL SELECT 2) k WHERE col_no < 3""",
    "fx_printed": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
          CASE WHEN l_partkey % 13 = 0 THEN concat('(', whole, frac)
               WHEN l_partkey % 17 = 0 THEN concat('(-', whole, ')')
               WHEN l_partkey % 19 = 0 THEN concat('₹', whole, '%')
          ELSE CASE l_orderkey % 8
            WHEN 0 THEN concat(CASE WHEN length(whole) > 3 THEN concat(substr(whole, 1, length(whole) - 3), ',', substr(whole, length(whole) - 2, 3)) ELSE whole END, frac)
            WHEN 1 THEN concat(CASE WHEN length(whole) > 5 THEN concat(substr(whole, 1, length(whole) - 5), ',', substr(whole, length(whole) - 4, 2), ',', substr(whole, length(whole) - 2, 3))
                                    WHEN length(whole) > 3 THEN concat(substr(whole, 1, length(whole) - 3), ',', substr(whole, length(whole) - 2, 3)) ELSE whole END, frac)
            WHEN 2 THEN concat('(', whole, frac, ')') WHEN 3 THEN concat('₹ ', whole, frac)
            WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.5%') WHEN 5 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' bps')
            WHEN 6 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), '.25x') ELSE CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE 'nil' END END END AS raw
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                     CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS whole, concat('.', lpad(CAST(l_orderkey % 100 AS STRING), 2, '0')) AS frac FROM {lineitem}) p""",
    "fx_printed_dates": """
        SELECT o_orderkey, dd, mm, yy,
          CASE WHEN o_orderkey % 97 = 0 THEN '31.02.2025' ELSE CASE o_orderkey % 7
            WHEN 0 THEN concat(dd, '.', mm, '.', yy) WHEN 1 THEN concat(yy, '-', mm, '-', dd)
            WHEN 2 THEN concat(CAST(CAST(dd AS INT) AS STRING), 'th ', mon, ' ', yy) WHEN 3 THEN concat(mon, ' ', dd, ', ', yy)
            WHEN 4 THEN concat(mon, ' ', yy) WHEN 5 THEN concat(mm, '/', dd, '/', yy) ELSE concat(dd, '-', mon, '-', substr(yy, 3, 2)) END END AS raw,
          CASE o_orderkey % 9
            WHEN 0 THEN concat('Q', CAST(o_custkey % 4 + 1 AS STRING), ' FY', substr(yy, 3, 2)) WHEN 1 THEN concat('H', CAST(o_custkey % 2 + 1 AS STRING), ' FY', yy)
            WHEN 2 THEN concat('FY', yy, '-', lpad(CAST((CAST(yy AS INT) + 1) % 100 AS STRING), 2, '0')) WHEN 3 THEN concat('9M FY', yy)
            WHEN 4 THEN concat('Quarter ended ', dd, ' ', mon, ' ', yy) WHEN 5 THEN concat('As at ', dd, '.', mm, '.', yy)
            WHEN 6 THEN concat('Year ', yy) WHEN 7 THEN concat('six months  ended on ', mon, ' ', dd, ', ', yy) ELSE 'Particulars' END AS label,
          CASE o_orderkey % 10
            WHEN 0 THEN yy WHEN 1 THEN concat('FY', substr(yy, 3, 2)) WHEN 2 THEN concat('FY ', yy, '-', lpad(CAST((CAST(yy AS INT) + 1) % 100 AS STRING), 2, '0'))
            WHEN 3 THEN concat('fiscal year ', yy) WHEN 4 THEN concat('Q2 FY', substr(yy, 3, 2)) WHEN 5 THEN substr(yy, 3, 2)
            WHEN 6 THEN concat(yy, ' / ', lpad(CAST((CAST(yy AS INT) + 2) % 100 AS STRING), 2, '0')) WHEN 7 THEN 'FY''26' WHEN 8 THEN concat('FY', substr(yy, 3, 2), '-27') ELSE concat('1', substr(yy, 2, 3)) END AS fy_text
        FROM (SELECT o_orderkey, o_custkey, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, CAST(year(o_orderdate) AS STRING) AS yy,
                CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr.' WHEN 5 THEN 'May' WHEN 6 THEN 'june'
                  WHEN 7 THEN 'July' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov.' ELSE 'December' END AS mon FROM {orders}) d""",
    # ---- review and versions
    "fx_issues": """
        SELECT event_id AS issue_id, user_id AS version_id, CAST(floor(day(ts) / 8) AS INT) + 1 AS run_no,
          CASE event_type WHEN 'click' THEN 're_extraction' WHEN 'error' THEN 'low_confidence' WHEN 'purchase' THEN 'traceability' WHEN 'signup' THEN 'arithmetic'
            ELSE CASE event_id % 4 WHEN 0 THEN 'completeness' WHEN 1 THEN 'rendered_page' WHEN 2 THEN 'period_unit' ELSE 'reviewer_flag' END END AS check_name,
          CASE WHEN value >= 50 THEN 'blocking' ELSE 'warning' END AS severity,
          CASE WHEN event_type = 'view' THEN NULL ELSE concat('p1f', CAST(event_id % 40 AS STRING)) END AS fid,
          CAST(event_id % 12 + 1 AS INT) AS page, concat('s', CAST(event_id % 12 + 1 AS STRING)) AS section_id,
          concat('note ', CAST(event_id % 50 AS STRING)) AS message,
          CASE WHEN event_id % 3 = 0 THEN concat('e', CAST(event_id % 7 AS STRING)) END AS expected, CASE WHEN event_id % 4 = 0 THEN concat('a', CAST(event_id % 5 AS STRING)) END AS actual,
          CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'open' END AS status, ts AS at_ts
        FROM {events}""",
    "fx_run_figures": """
        SELECT DISTINCT version_id, concat('p1f', CAST(k AS STRING)) AS fid, CASE WHEN k % 13 = 0 THEN 'not_a_figure' ELSE 'active' END AS status,
               CASE WHEN k % 3 = 0 THEN 'percent' ELSE 'number' END AS kind, concat(CAST(k AS STRING), '.50') AS raw, CASE WHEN k % 2 = 0 THEN 'ocr' ELSE 'text_layer' END AS method
        FROM (SELECT user_id AS version_id, event_id % 44 AS k FROM {events}) x""",
    "fx_confirmed": """
        SELECT DISTINCT user_id AS version_id, concat('p1f', CAST(event_id % 44 AS STRING)) AS fid,
          CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'traceability' WHEN 1 THEN 'second_parser' WHEN 2 THEN 're_extraction' WHEN 3 THEN 'arithmetic' ELSE 'cross_table' END AS check_name
        FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "fx_reviews": """
        SELECT conv_id % 15 AS version_id, concat('p1f', CAST((conv_id * 7 + turn) % 40 AS STRING)) AS fid, conv_id * 100 + turn AS at_no,
          CASE role WHEN 'user' THEN 'confirm' WHEN 'assistant' THEN 'edit' ELSE 'not_a_figure' END AS action,
          CASE WHEN turn % 4 = 1 THEN concat(CAST(length(text) AS STRING), '.50') WHEN turn % 4 = 3 THEN '12,34' ELSE concat(CAST((conv_id * 7 + turn) % 40 AS STRING), '.50') END AS raw, conv_id % 6 AS user_id, text AS note
        FROM {conversations}""",
    "fx_acks": "SELECT doc_id % 15 AS version_id, concat('note ', CAST(doc_id % 50 AS STRING)) AS message, max(quality) AS quality FROM {labels} GROUP BY doc_id % 15, concat('note ', CAST(doc_id % 50 AS STRING))",
    "fx_versions": """
        SELECT o_orderkey AS version_id, o_custkey AS report_id, o_custkey % 20 AS tenant_id,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no, o_orderdate AS created_at,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate END AS published_at,
          CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'published' WHEN o_orderkey % 3 = 1 THEN 'needs_review' ELSE 'superseded' END
            WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'failed' END ELSE 'validation_issues' END AS status,
          CASE WHEN o_orderkey % 4 = 0 THEN 'render:pages' WHEN o_orderkey % 4 = 1 THEN 'extract' ELSE 'validate' END AS stage,
          CASE WHEN o_orderkey % 7 <> 0 THEN concat('bundle/', CAST(o_orderkey AS STRING)) END AS bundle_key,
          CASE WHEN o_orderkey % 5 <> 0 THEN concat('s', CAST(o_orderkey % 50 AS STRING)) END AS schema_sha, CASE WHEN o_orderkey % 7 <> 0 THEN concat('b', CAST(o_orderkey % 60 AS STRING)) END AS bundle_sha,
          CASE WHEN o_orderkey % 5 <> 0 THEN concat('s', CAST(CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_orderkey % 50 END AS STRING)) END AS checked_schema_sha,
          CASE WHEN o_orderkey % 7 <> 0 THEN concat('b', CAST(CASE WHEN o_orderkey % 13 = 0 THEN 99 ELSE o_orderkey % 60 END AS STRING)) END AS checked_bundle_sha,
          o_orderkey % 6 <> 0 AS has_summary, concat('v', CAST(o_orderkey % 3 AS STRING)) AS build,
          CASE WHEN o_orderkey % 9 = 0 THEN '{}' WHEN o_orderkey % 9 = 1 THEN '{"disclaimer": "PLACEHOLDER text"}' WHEN o_orderkey % 9 = 2 THEN '{"disclaimer": "Notice of [Company name]"}'
               WHEN o_orderkey % 9 < 6 THEN concat('{"disclaimer": "Notice ', CAST(o_custkey % 20 AS STRING), '"}') ELSE '{"disclaimer": "Old notice"}' END AS theme_snapshot
        FROM {orders}""",
    "fx_version_links": """
        SELECT version_id, lag(version_id) OVER (PARTITION BY report_id ORDER BY version_no) AS created_from FROM fx_versions""",
    "fx_reports": """
        SELECT c_custkey AS report_id, c_custkey % 20 AS tenant_id, c_name AS company_name, 2020 + c_custkey % 6 AS fiscal_year,
          CASE c_custkey % 8 WHEN 0 THEN 'q1' WHEN 1 THEN 'h1' WHEN 2 THEN 'q2' WHEN 3 THEN 'q3' WHEN 4 THEN '9m' WHEN 5 THEN 'q4' WHEN 6 THEN 'h2' ELSE 'fy' END AS period,
          CASE WHEN c_custkey % 3 = 0 THEN 'quarterly_results' WHEN c_custkey % 3 = 1 THEN 'annual_report' ELSE 'investor_presentation' END AS report_type,
          CASE WHEN c_custkey % 4 = 0 THEN concat('FY', substr(CAST(2020 + c_custkey % 6 AS STRING), 3, 2)) END AS fiscal_year_label,
          'INR' AS currency, '₹ crore' AS reporting_unit, CASE WHEN c_custkey % 23 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END AS deleted_at, live.version_id AS live_version_id
        FROM {customer} LEFT JOIN (SELECT report_id, max(version_id) AS version_id FROM fx_versions WHERE published_at IS NOT NULL GROUP BY report_id) live ON c_custkey = live.report_id""",
    "fx_tenants": """
        SELECT s_suppkey AS tenant_id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' ELSE NULL END AS plan,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 2000 + s_suppkey * 250 END AS credit_limit, concat('Notice ', CAST(s_suppkey AS STRING)) AS disclaimer
        FROM {supplier}""",
    "fx_users": "SELECT c_custkey AS user_id, c_name AS name, lower(concat(c_name, '@example.com')) AS email, c_custkey % 12 AS tenant_id, CASE WHEN c_custkey % 12 < 8 AND c_custkey % 5 = 0 THEN 'tenant_admin' ELSE 'reviewer' END AS role FROM {customer}",
    "fx_audit": "SELECT event_id AS audit_id, user_id % 5 AS tenant_id, user_id AS actor_id, concat('report.', event_type) AS action, props AS detail, ts AS at_ts FROM {events}",
    "fx_uploads": """
        SELECT o_orderkey AS upload_id, CASE WHEN o_orderkey % 31 = 0 THEN '  ' ELSE concat(' Company ', CAST(o_custkey AS STRING)) END AS company_name,
          CASE o_orderkey % 11 WHEN 0 THEN 'memo' WHEN 1 THEN 'annual_report' WHEN 2 THEN 'other' ELSE 'quarterly_results' END AS report_type, fy_text AS fiscal_year,
          CASE WHEN o_orderkey % 19 = 0 THEN 'q9' WHEN o_orderkey % 2 = 0 THEN 'Q2' ELSE 'fy' END AS period, CASE WHEN o_orderkey % 29 = 0 THEN 'RS' ELSE 'inr ' END AS currency,
          CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE '₹ crore' END AS reporting_unit, CASE WHEN o_orderkey % 3 = 0 THEN raw END AS period_end, o_custkey AS tenant_key, o_orderdate AS at_ts
        FROM fx_printed_dates JOIN {orders} USING (o_orderkey)""",
    # ---- ledger, traffic, operations
    "fx_usage": """
        SELECT event_id AS usage_id, user_id % 5 AS tenant_id, event_id AS version_id, ts AS created_at,
          CASE event_type WHEN 'click' THEN 'ai_check' WHEN 'error' THEN 'section_labels' WHEN 'purchase' THEN 'page_layout' WHEN 'signup' THEN 'chapters' ELSE 'ai_check' END AS feature,
          CASE WHEN event_id % 2 = 0 THEN 'gemini' ELSE 'anthropic' END AS provider, concat('model-', CAST(event_id % 3 AS STRING)) AS model,
          CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) AS input_tokens, CAST(floor(CAST(CAST(value AS DECIMAL(12,2)) * 100 AS BIGINT) / 10) AS BIGINT) AS output_tokens, event_id % 17 <> 0 AS ok
        FROM {events}""",
    "fx_priced": """
        SELECT usage_id, tenant_id, version_id, created_at, feature, provider, model, input_tokens, output_tokens, ok, CAST(micro_usd / CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(12,6)) AS usd,
               CAST(micro_usd / CAST(10000 AS DECIMAL(5,0)) AS DECIMAL(12,4)) AS credits
        FROM (SELECT *, CAST(CASE WHEN provider = 'gemini' THEN input_tokens + output_tokens * 6 ELSE input_tokens * 3 + output_tokens * 15 END AS DECIMAL(18,0)) AS micro_usd FROM fx_usage) u""",
    "fx_hits": """
        SELECT event_id AS hit_id, user_id % 5 AS tenant_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS report_id, ts AS at_ts, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status,
          CASE event_id % 8 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'GPTBot/1.0' WHEN 2 THEN 'ClaudeBot/1.0' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64)' WHEN 4 THEN 'SomeCrawler/2.0'
            WHEN 5 THEN '' WHEN 6 THEN 'curl/8.1' ELSE 'Mozilla/5.0 (Windows NT 10.0)' END AS user_agent
        FROM {events}""",
    "fx_jobs": """
        SELECT event_id AS job_id, user_id % 5 AS tenant_id, user_id AS version_id, CASE event_type WHEN 'click' THEN 'pipeline.extract' WHEN 'view' THEN 'pipeline.render' WHEN 'purchase' THEN 'pipeline.validate' ELSE 'domain.check' END AS kind,
          CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' ELSE 'queued' END AS status, CAST(event_id % 5 AS INT) AS attempts, 4 AS max_attempts,
          ts AS created_at, ts AS run_after, ts + INTERVAL '5' MINUTE AS locked_at, ts + INTERVAL '9' MINUTE AS finished_at, concat('w', CAST(event_id % 9 AS STRING)) AS locked_by, event_id % 3 = 0 AS design_only,
          concat('key', CAST(event_id % 700 AS STRING)) AS idempotency_key,
          concat('GET https://api.example.com/v1?key=AIza', CAST(event_id AS STRING), '&x=1 Authorization: Bearer tok', CAST(event_id AS STRING), ' failed') AS error
        FROM {events}""",
    "fx_beats": "SELECT concat('w', CAST(event_id % 9 AS STRING)) AS worker_id, ts AS seen_at FROM {events}",
    "fx_requests": "SELECT event_id AS request_id, user_id, ts AS at_ts FROM {events}",
    "fx_domains": """
        SELECT event_id AS domain_id, concat('d', CAST(user_id AS STRING), '.example.com') AS domain, ts AS checked_at, ts - INTERVAL '40' MINUTE AS created_at, ts AS at_ts, event_id AS seq,
          CASE event_id % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'ssl_issuing' END AS state, event_id % 12 AS k,
          CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 'x.cdn.example.org' WHEN 2 THEN 'other.example.org' ELSE 'edge.example.net' END AS cname, event_id % 12 = 3 AS cname_timeout,
          CASE event_id % 12 WHEN 4 THEN '' WHEN 5 THEN 'site=zzz' ELSE 'site=abc' END AS txt_text, 'site=abc' AS want_txt, CASE event_id % 12 WHEN 6 THEN 'otherca.example' WHEN 7 THEN 'goodca.example' ELSE '' END AS caa_text,
          event_id % 12 <> 8 AS tls_ok, CASE WHEN event_id % 12 = 9 THEN 3 ELSE 60 END AS cert_days, CASE WHEN value < 60 THEN 'live' ELSE 'failed' END AS observed
        FROM {events}""",
    "fx_sections": """
        SELECT source AS report_id, doc_id AS ord, concat('s', CAST(doc_id AS STRING)) AS section_id, CAST(floor(doc_id / 3) AS BIGINT) AS page,
          CASE doc_id % 14 WHEN 0 THEN 'Statement of profit and loss' WHEN 1 THEN 'Balance Sheet' WHEN 2 THEN 'Cash  flow statement' WHEN 3 THEN 'Segment results Q2 FY26' WHEN 4 THEN 'Financial highlights'
            WHEN 5 THEN 'Outlook' WHEN 6 THEN 'Message from the Chairman' WHEN 7 THEN 'Notes to the accounts' WHEN 8 THEN '• gtaaliyy' WHEN 9 THEN '(c) Mergers and acquisitions in 2025' WHEN 10 THEN 'MM ENA' WHEN 11 THEN '' ELSE substr(split_part(text, chr(10), 1), 1, 80) END AS heading,
          substr(text, 1, 400) AS sample, CASE WHEN doc_id % 4 = 0 THEN 'ocr' ELSE 'text_layer' END AS method, CASE WHEN doc_id % 5 = 0 THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS mean_conf,
          CASE WHEN doc_id % 6 = 0 THEN 'paragraph' ELSE 'heading' END AS kind
        FROM {documents}""",
    "fx_opinions": """
        SELECT doc_id % 15 AS version_id, concat('p1f', CAST(doc_id % 40 AS STRING)) AS fid, CASE WHEN max(doc_id) % 7 = 0 THEN 'other' ELSE concat(CAST(doc_id % 40 AS STRING), '.50') END AS seen_raw,
               max(quality) = 1 AS agrees, CASE WHEN max(toxic) = 0 THEN concat(CAST(max(doc_id) % 9 AS STRING), '.1') ELSE '' END AS reading
        FROM {labels} GROUP BY doc_id % 15, doc_id % 40""",
    "fx_suggestions": "SELECT source AS report_id, concat('s', CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id + 100000 ELSE doc_id END AS STRING)) AS section_id, CASE doc_id % 5 WHEN 0 THEN 'outlook' WHEN 1 THEN 'notes' WHEN 2 THEN 'balance sheet 2' WHEN 3 THEN 'highlights' ELSE 'unknown' END AS suggested, n_chars AS ord FROM {documents}",
    "fx_captions": """
        SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '(₹ in crore, except per share data)' WHEN 1 THEN 'US$ millions' WHEN 2 THEN 'in lakhs; some in crores' WHEN 3 THEN concat('Rs. Cr of ', p_name) WHEN 4 THEN 'EUR ''000'
             WHEN 5 THEN '$ bn' WHEN 6 THEN p_name WHEN 7 THEN 'figures in Thousands, GBP mn' WHEN 8 THEN 'INR in lacs' ELSE concat(p_type, ' units') END AS caption,
          CASE p_partkey % 8 WHEN 0 THEN 'EBITDA margin' WHEN 1 THEN 'Basic EPS (₹)' WHEN 2 THEN 'Dividend per share' WHEN 3 THEN 'Growth (%)' WHEN 4 THEN 'Book value (₹)' WHEN 5 THEN 'Margin (gross)' ELSE p_name END AS row_label,
          CASE p_partkey % 9 WHEN 0 THEN 'YoY' WHEN 1 THEN 'Q-o-Q growth' WHEN 2 THEN ' % chg ' WHEN 3 THEN 'Sequential' WHEN 4 THEN '% Change' WHEN 5 THEN 'Growth' WHEN 6 THEN 'change' WHEN 7 THEN 'Change in stock' ELSE p_brand END AS col_label
        FROM {part}""",
    "fx_figs": """
        SELECT report_id, page, line_no, word_no, concat('p', CAST(page AS STRING), 'f', CAST(row_number() OVER (PARTITION BY report_id, page ORDER BY line_no, word_no) AS STRING)) AS fid,
          CASE WHEN (page + word_no) % 11 = 0 THEN concat(text, '9') ELSE text END AS raw, x0, y0, x1, y1, conf AS confidence,
          CASE WHEN page % 3 = 0 THEN 'ocr' ELSE 'text_layer' END AS method, CASE WHEN (page + line_no) % 31 = 0 THEN 'not_a_figure' ELSE 'active' END AS status, word_no % 29 = 28 AS edited,
          concat('s', CAST(page AS STRING)) AS section_id
        FROM fx_words WHERE regexp_replace(text, '[0-9]', '') <> text""",
    "fx_words2": "SELECT report_id, page, line_no, word_no, CASE WHEN (page + word_no) % 23 = 0 THEN concat('#', text) ELSE text END AS text, x0 + CAST(1 AS DOUBLE) AS x0, y0, x1 + CAST(1 AS DOUBLE) AS x1, y1 FROM fx_words",
    "fx_readings": """
        SELECT report_id, fid, k AS reading_no, CASE WHEN k = 1 THEN raw WHEN k = 2 AND (page + word_no) % 11 = 0 THEN concat(substr(raw, 1, length(raw) - 1)) WHEN word_no % 2 = 0 THEN concat('7', raw) ELSE '' END AS reading
        FROM fx_figs CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) x WHERE k = 2 OR (page + word_no) % 11 <> 0""",
    "fx_excluded": "SELECT report_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fx_words WHERE line_no = 0 GROUP BY report_id, page",
    "fx_doc_pages": "SELECT source AS report_id, doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'text_layer' END AS method, CAST(612 AS DOUBLE) AS width, CAST(792 AS DOUBLE) AS height, CASE WHEN doc_id % 9 = 0 THEN doc_id % 5 ELSE 0 END AS hidden_numbers, doc_id % 8 = 0 AS has_picture, doc_id % 16 = 0 AS shown FROM {documents}",
    # ---- pages with tables: one page per order, its lines as rows, with a title, a unit caption and column heads
    "fx_grid": """
        SELECT page % 25 AS report_id, page, row_no, k AS word_no, text, x0, CAST(100 + 14 * row_no AS DOUBLE) AS y0, x1, CAST(110 + 14 * row_no AS DOUBLE) AS y1,
          CASE WHEN row_no = -4 THEN CAST(16 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS size, row_no = -4 AS bold, CASE WHEN (page + row_no) % 13 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS conf
        FROM (
          SELECT report_id AS page, row_no, j AS k, split_part(label, ' ', j) AS text, CAST(10 + 40 * j AS DOUBLE) AS x0, CAST(10 + 40 * j + 6 * length(split_part(label, ' ', j)) AS DOUBLE) AS x1
          FROM fx_cells CROSS JOIN (SELECT 1 AS j UNION ALL SELECT 2) n WHERE col_no = 1 AND split_part(label, ' ', j) <> ''
          UNION ALL SELECT report_id, row_no, 10 + col_no, raw, CAST(210 + 90 * col_no - 6 * length(raw) AS DOUBLE), CAST(210 + 90 * col_no AS DOUBLE) FROM fx_cells
          UNION ALL SELECT o_orderkey, r, w, t, CAST(a AS DOUBLE), CAST(a + 6 * length(t) AS DOUBLE) FROM {orders} CROSS JOIN (
            SELECT 0 AS r, 1 AS w, 'Particulars' AS t, 50 AS a UNION ALL SELECT 0, 2, 'Q2', 250 UNION ALL SELECT 0, 3, 'FY25', 270 UNION ALL SELECT 0, 4, 'Quantity', 345 UNION ALL SELECT 0, 5, 'Tax', 460
            UNION ALL SELECT -1, 1, '(₹', 50 UNION ALL SELECT -1, 2, 'in', 70 UNION ALL SELECT -1, 3, 'crore)', 90 UNION ALL SELECT -4, 1, 'Order', 50 UNION ALL SELECT -4, 2, 'statement', 110) h) x""",
    # the same pages with a row of dates, a row label that holds a year, and prose whose amounts and dates wrap
    "fx_statement": """
        SELECT report_id, page, row_no, word_no, text, x0, y0, x1, y1, size, bold, conf FROM fx_grid
        UNION ALL
        SELECT page % 25, page, row_no, w, t, CAST(a AS DOUBLE), CAST(100 + 14 * row_no AS DOUBLE), CAST(a + 6 * length(t) AS DOUBLE), CAST(110 + 14 * row_no AS DOUBLE), CAST(10 AS DOUBLE), FALSE, CASE WHEN (page + w) % 9 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END
        FROM (SELECT page, CASE WHEN k < 4 THEN n + 2 ELSE 40 + CAST(floor(k / 10) AS INT) END AS row_no, k AS w,
            CASE k WHEN 1 THEN 'Due' WHEN 2 THEN concat('FY', yy) WHEN 3 THEN concat(dd, '.', mm, '.', yy) WHEN 10 THEN 'Sales' WHEN 11 THEN 'of' WHEN 12 THEN '₹' WHEN 13 THEN concat(amount, ',') WHEN 14 THEN 'crore' WHEN 15 THEN 'until' WHEN 16 THEN dd
              WHEN 20 THEN mon WHEN 21 THEN yy WHEN 22 THEN concat('(up', '') WHEN 23 THEN '12.5%)' WHEN 24 THEN 'against' WHEN 25 THEN 'Q2' WHEN 30 THEN concat('FY', substr(yy, 3, 2)) WHEN 31 THEN 'and' WHEN 32 THEN '(1,234)' WHEN 33 THEN 'lakhs;' WHEN 34 THEN 'nil' WHEN 35 THEN concat('A', dd, '-', mm) ELSE '2,5,0' END AS t,
            CASE WHEN k = 3 THEN 240 WHEN k < 3 THEN 10 + 40 * k ELSE 50 + 70 * (k % 10) END AS a
          FROM (SELECT l_orderkey AS page, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) c
          JOIN (SELECT o_orderkey, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, CAST(year(o_orderdate) AS STRING) AS yy,
              CASE WHEN month(o_orderdate) < 7 THEN 'June' ELSE 'Dec.' END AS mon, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amount FROM {orders}) o ON c.page = o.o_orderkey
          CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 10 UNION ALL SELECT 11 UNION ALL SELECT 12 UNION ALL SELECT 13 UNION ALL SELECT 14 UNION ALL SELECT 15 UNION ALL SELECT 16 UNION ALL SELECT 20 UNION ALL SELECT 21
            UNION ALL SELECT 22 UNION ALL SELECT 23 UNION ALL SELECT 24 UNION ALL SELECT 25 UNION ALL SELECT 30 UNION ALL SELECT 31 UNION ALL SELECT 32 UNION ALL SELECT 33 UNION ALL SELECT 34 UNION ALL SELECT 35 UNION ALL SELECT 36) h) x""",
    "fx_grid_pages": "SELECT o_orderkey % 25 AS report_id, o_orderkey AS page, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM {orders}",
    # ---- furniture in page margins: running titles (some misread), page numbers and stray numbers
    "fx_margin": """
        SELECT page % 25 AS report_id, page, row_no, w AS word_no, text, x0, y0, x0 + CAST(6 * length(text) AS DOUBLE) AS x1, y0 + CAST(10 AS DOUBLE) AS y1, CAST(10 AS DOUBLE) AS size, FALSE AS bold, CAST(0.9 AS DOUBLE) AS conf
        FROM (SELECT o_orderkey AS page, 0 AS row_no, w, CASE WHEN w = 2 AND o_orderkey % 17 = 0 THEN 'Reporl' WHEN w = 3 AND o_orderkey % 5 = 0 THEN o_orderpriority ELSE t END AS text, CAST(a AS DOUBLE) AS x0, CAST(20 AS DOUBLE) AS y0
              FROM {orders} CROSS JOIN (SELECT 1 AS w, 'Annual' AS t, 50 AS a UNION ALL SELECT 2, 'Report', 100 UNION ALL SELECT 3, 'Consolidated', 150) h
              UNION ALL SELECT o_orderkey, 1, 1, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey AS STRING) ELSE CAST(CAST(floor(o_orderkey / 25) AS BIGINT) + 4 AS STRING) END, CAST(300 AS DOUBLE), CAST(770 AS DOUBLE) FROM {orders}
              UNION ALL SELECT o_orderkey, 2, 1, o_orderpriority, CAST(50 AS DOUBLE), CAST(400 AS DOUBLE) FROM {orders}) x WHERE text <> ''""",
    # ---- chart pages: a column of evenly spaced ticks beside other numbers
    "fx_ticks": """
        SELECT p_partkey % 10 AS report_id, p_partkey AS page, k AS word_no, CASE WHEN p_partkey % 6 = 0 AND k = 3 THEN '37' ELSE CAST((5 - k) * CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE p_size END AS STRING) END AS text, CAST(40 AS DOUBLE) AS x0, CAST(100 + 30 * k AS DOUBLE) AS y0, CAST(60 AS DOUBLE) AS x1, CAST(110 + 30 * k AS DOUBLE) AS y1, CAST(10 AS DOUBLE) AS size, FALSE AS bold, CAST(0.9 AS DOUBLE) AS conf
        FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) t
        UNION ALL SELECT p_partkey % 10, p_partkey, 20 + k, CASE k WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN '€8' WHEN 2 THEN '7777' ELSE '2024' END, CAST(100 + 60 * k AS DOUBLE), CAST(300 AS DOUBLE), CAST(140 + 60 * k AS DOUBLE), CAST(310 AS DOUBLE), CAST(10 AS DOUBLE), FALSE, CAST(0.3 AS DOUBLE)
        FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t WHERE p_partkey % 3 = 0""",
    "fx_html": """
        SELECT page_id, page_id % 8 AS report_id, concat('p', CAST(page_id AS STRING), '.html') AS name, concat(replace(html, '</article>', ''), '<p>Sales <span class="n" data-fig="p', CAST(page_id % 40 AS STRING), 'f1">', CASE WHEN page_id % 9 = 0 THEN '99.1' ELSE '12.5' END,
          '</span> for <b data-meta="period_label">', CASE WHEN page_id % 7 = 0 THEN 'Q3 FY26' ELSE 'Q2 FY26' END, '</b>', CASE WHEN page_id % 4 = 0 THEN ' about 1,234 units' ELSE ' units' END, '</p><img alt="Chart ', CASE WHEN page_id % 6 = 0 THEN '17' ELSE 'FY26' END,
          '" src="/r/pages/p', lpad(CAST(page_id % 30 AS STRING), 4, '0'), '-x1.webp"><p style="color:#12aBc', CAST(page_id % 10 AS STRING), ';font-family: ''Inter'', serif">See www.example.com/a-</p><style>body{background:#fff} h1{color:#0af;font-family:Roboto, sans-serif}</style><script type="application/ld+json">{"@type": "Report", "name": "Report ', CASE WHEN page_id % 5 = 0 THEN '2031' ELSE 'FY26' END, '", "url": "/fy2026/"',
          CASE WHEN page_id % 10 = 3 THEN '' ELSE '}' END, '</script></article>') AS html
        FROM {pages}""",
    "fx_site_figures": "SELECT DISTINCT page_id % 8 AS report_id, concat('p', CAST(page_id % 40 AS STRING), 'f1') AS fid, '12.5' AS raw, CASE WHEN page_id % 40 = 18 THEN 'not_a_figure' ELSE 'active' END AS status FROM {pages} WHERE page_id % 40 <> 39",
    "fx_site_meta": "SELECT DISTINCT page_id % 8 AS report_id, 'period_label' AS meta_key, 'Q2 FY26' AS meta_value FROM {pages}",
    # ---- report texts: names, listing codes, currencies, units, dates and periods spread over pages
    "fx_texts": """
        SELECT o_custkey % 50 AS report_id, o_orderkey AS page, o_orderkey % 3 = 0 AS is_cover,
          concat(CASE o_orderkey % 6 WHEN 0 THEN concat(nm, ' Limited announced results. ') WHEN 1 THEN concat('In the year ', nm, ' grew. ', one, '’s margin rose. ') WHEN 2 THEN concat('For ', upper(nm), ' LIMITED the board of National Stock Exchange of India Limited met. ')
              WHEN 3 THEN concat(nm, ' Quarterly Results. NSE: ', upper(replace(nm, ' ', '')), ' and focus on growth. ') WHEN 4 THEN concat('Our focus is steel. ', one, '’s plants and ', nm, ' Ltd sold more. ') ELSE concat('Focus and ', one, ' ', 'results matter. ') END,
            CASE o_orderkey % 5 WHEN 0 THEN concat('Revenue of ', cur, '1,234 ', unit, ' and ', cur, ' 56 ', unit, '. ') WHEN 1 THEN concat('(', cur, ' in ', unit, ') ') WHEN 2 THEN 'US$ 39.1 Billion abroad. ' WHEN 3 THEN concat('About ', cur, '2.5 ', unit, '. ') ELSE 'No amounts here. ' END,
            CASE o_orderkey % 7 WHEN 0 THEN concat('Q', CAST(o_custkey % 4 + 1 AS STRING), ' FY', substr(yy, 3, 2), ' ') WHEN 1 THEN concat('for the year ended March 31, ', yy, ' ') WHEN 2 THEN concat('Annual Report ', yy, '-', substr(CAST(CAST(yy AS INT) + 1 AS STRING), 3, 2), ' ') WHEN 3 THEN concat('fiscal year ', yy, ' ')
              WHEN 4 THEN concat('quarter ended 30 September ', yy, ' ') WHEN 5 THEN concat('12 December ', yy, ' ') ELSE concat('Outlook ', yy, ' ') END) AS text
        FROM (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) + 20 AS STRING) AS yy, CASE o_custkey % 5 WHEN 0 THEN 'Tata Motors' WHEN 1 THEN 'Infosys Digital' WHEN 2 THEN 'Nova Steel' WHEN 3 THEN 'Axis Bank' ELSE 'Hindalco Industries' END AS nm,
            CASE o_custkey % 5 WHEN 0 THEN 'Tata' WHEN 1 THEN 'Infosys' WHEN 2 THEN 'Nova' WHEN 3 THEN 'Axis' ELSE 'Hindalco' END AS one, CASE o_custkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '₹' ELSE 'Rs. ' END AS cur, CASE o_custkey % 3 WHEN 0 THEN 'million' WHEN 1 THEN 'crore' ELSE 'lakhs' END AS unit FROM {orders}) o""",
    "fx_sources": "SELECT doc_id AS upload_id, source AS tenant_id, text AS content, concat('report ', CAST(doc_id % 50 AS STRING), '.pdf') AS filename, doc_id AS at_no FROM {documents}",
}

# the two engines spell these differently: (Spark, DuckDB)
WORDS = ("""
    SELECT report_id, page, line_no, word_no, text, CAST(48 * word_no AS DOUBLE) AS x0, CAST(12 * line_no AS DOUBLE) AS y0,
           CAST(48 * word_no + 5 * length(text) AS DOUBLE) AS x1, CAST(12 * line_no + 10 AS DOUBLE) AS y1,
           CASE WHEN (page + word_no) % 17 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS conf
    FROM (SELECT report_id, page, line_no, word_no, text FROM (SELECT source AS report_id, doc_id AS page, posexplode(split(text, chr(10))) AS (line_no, line) FROM {documents}) l
          LATERAL VIEW posexplode(split(line, ' ')) w AS word_no, text) x WHERE text <> ''""",
         """
    SELECT report_id, page, line_no, word_no, text, CAST(48 * word_no AS DOUBLE) AS x0, CAST(12 * line_no AS DOUBLE) AS y0,
           CAST(48 * word_no + 5 * length(text) AS DOUBLE) AS x1, CAST(12 * line_no + 10 AS DOUBLE) AS y1,
           CASE WHEN (page + word_no) % 17 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS conf
    FROM (SELECT report_id, page, line_no, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_no, unnest(ws) AS text FROM (
            SELECT report_id, page, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, string_split(unnest(ls), ' ') AS ws FROM (
              SELECT source AS report_id, doc_id AS page, string_split(text, chr(10)) AS ls FROM {documents}))) WHERE text <> ''""")
ENGINE_FIXTURES: dict[str, tuple[str, str]] = {"fx_words": WORDS}


def known() -> set[str]:
    return set(FIXTURES) | set(ENGINE_FIXTURES)


def sql_of(name: str, engine: str) -> str:
    if name in ENGINE_FIXTURES:
        return ENGINE_FIXTURES[name][0 if engine == "spark" else 1]
    return FIXTURES[name]


def needed_by(text: str, engine: str) -> list[str]:
    """Adapters a text refers to, each after those it builds on."""
    order: list[str] = []

    def visit(t: str) -> None:
        for name in sorted(set(re.findall(r"\bfx_[a-z_0-9]+\b", t)) & known()):
            if name not in order:
                visit(sql_of(name, engine))
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def with_adapters(body: str, engine: str, location: dict[str, str] | None = None) -> str:
    """The body as a complete statement: adapters first, then the body's own WITH list or select."""
    names = needed_by(body, engine)
    ctes = [f"{n} AS ({sql_of(n, engine)})" for n in names]
    body = body.strip()
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    if body.upper().startswith(head):
        ctes.append(body[len(head):])
        text = head + ",\n".join(ctes)
    else:
        text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
    for t in DRIVER_TABLES:
        text = text.replace("{" + t + "}", (location or {}).get(t, t))
    return text
