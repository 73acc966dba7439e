"""N1–N14 over printed values derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.functions import dates
from figtrail.operators import normalise as op
from figtrail.operators.normalise import OCR_STARTS, SECTION_TYPES, TRIPLED, WORD_STARTS
from figtrail.plans import duck
from figtrail.plans.registry import query

PRINTED = "SELECT * FROM fx_printed"
DATES = "SELECT * FROM fx_printed_dates"


@query("n1_normalise_numbers", f"""
    SELECT l_orderkey, l_partkey, raw, kind, CAST(value AS VARCHAR) AS value, value_str, scale, grouping, currency_symbol, negative
    FROM ({duck.number(PRINTED)})""")
def n1(t):
    return op.normalise_numbers(t("fx_printed")).select(
        "l_orderkey", "l_partkey", "raw", "kind", F.col("value").cast("string").alias("value"), "value_str",
        "scale", "grouping", "currency_symbol", "negative")


@query("n2_digit_signature", f"SELECT l_orderkey, l_partkey, raw, signature FROM ({duck.signature(PRINTED)})")
def n2(t):
    return op.digit_signature(t("fx_printed")).select("l_orderkey", "l_partkey", "raw", "signature")


@query("n3_normalise_dates", f"""
    SELECT o_orderkey, raw, iso, precision, ambiguous FROM ({duck.date(DATES)})""")
def n3(t):
    return op.normalise_dates(t("fx_printed_dates")).select("o_orderkey", "raw", "iso", "precision", "ambiguous")


@query("n4_period_keys", f"""
    SELECT o_orderkey, label, period_type, period_number, period_fiscal_year, period_end_date, period_key FROM ({duck.period(DATES)})""")
def n4(t):
    return op.period_keys(t("fx_printed_dates")).select(
        "o_orderkey", "label", "period_type", "period_number", "period_fiscal_year", "period_end_date", "period_key")


@query("n5_fiscal_years", f"""
    SELECT o_orderkey, fy_text, CASE WHEN reason IS NULL THEN y END AS fy_year, CASE WHEN reason IS NULL THEN
             CASE WHEN m.b <> '' THEN CASE WHEN m.p <> '' THEN 'FY' ELSE '' END || m.a || '-' || right(m.b, 2) WHEN length(m.a) = 2 THEN 'FY' || m.q || m.a ELSE 'FY' || m.a END END AS fy_label,
           reason AS fy_reason, fiscal_year, quarter
    FROM (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN m.a = '' AND regexp_matches(s, '(?i)^(Q[1-4]|H[12]|9\\s?M|[1-4]Q)\\s?-?\\s?(.*)$') THEN 'has_period' WHEN m.a = '' THEN 'not_a_year'
        WHEN m.q <> '' AND NOT (m.p <> '' AND length(m.a) = 2 AND m.b = '') THEN 'not_a_year' WHEN m.p = '' AND length(m.a) = 2 AND m.b = '' THEN 'two_digits' WHEN m.b <> '' AND length(m.a) = 2 THEN 'two_digit_start'
        WHEN m.b <> '' AND y <> TRY_CAST(m.a AS INT) + 1 THEN 'not_one_year' WHEN y NOT BETWEEN 1990 AND 2100 THEN 'out_of_range' END AS reason
    FROM (SELECT *, {duck.end_year('m.a', 'm.b')} AS y FROM (
      SELECT *, regexp_extract(s, '(?i)^(F\\.?\\s?Y\\.?|fiscal(?: year)?|financial year)?\\s?('')?(\\d{{4}}|\\d{{2}})(?:-(\\d{{4}}|\\d{{2}}))?$', ['p','q','a','b']) AS m FROM (
      SELECT o_orderkey, fy_text, regexp_replace(trim(regexp_replace(fy_text, '\\s+', ' ', 'g')), '\\s*[-–—‒−/]\\s*', '-', 'g') AS s,
        CASE WHEN CAST(mm AS INT) >= 4 THEN CAST(yy AS INT) + 1 ELSE CAST(yy AS INT) END AS fiscal_year, CAST((CAST(mm AS INT) + 8) % 12 // 3 + 1 AS INT) AS quarter FROM fx_printed_dates))))""")
def n5(t):
    df = op.fiscal_years(t("fx_printed_dates"))
    day = F.concat_ws("-", "yy", "mm", "dd").cast("date")
    return df.withColumns(dates.fiscal_quarter(day, F.lit(4))).select(
        "o_orderkey", "fy_text", "fy_year", "fy_label", "fy_reason", "fiscal_year", "quarter")


def _canon(x: str) -> str:
    return (f"CASE WHEN lower({x}) IN ('crore','crores','cr','cr.') THEN 'crore' WHEN lower({x}) IN ('lakh','lakhs','lac','lacs') THEN 'lakh' WHEN lower({x}) IN ('million','millions','mn') THEN 'million' "
            f"WHEN lower({x}) IN ('billion','billions','bn') THEN 'billion' WHEN {x} <> '' THEN 'thousand' END")


@query("n6_detect_units", f"""
    SELECT p_partkey, caption, {_canon('m.u')} AS unit,
      CASE WHEN c IN ('₹','rs','rs.','inr') THEN 'INR' WHEN c IN ('us$','usd','$') THEN 'USD' WHEN c IN ('€','eur') THEN 'EUR' WHEN c IN ('£','gbp') THEN 'GBP' END AS currency,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(caption, '{duck.UNIT_RX}', 3), lambda x: {_canon('x')}))), ',') AS units_mentioned,
      CASE WHEN contains(l, '(%)') OR l LIKE '%\\%' ESCAPE '\\' OR (contains(l, 'margin') AND NOT contains(l, '(')) THEN 'percent' WHEN contains(l, 'eps') OR contains(l, 'per share') THEN 'per_share'
           WHEN contains(l, '(₹)') OR contains(l, '(rs') OR contains(l, '(inr)') OR contains(l, '($)') THEN 'absolute' ELSE 'crore' END AS row_unit
    FROM (SELECT *, lower(CASE WHEN m.a <> '' THEN m.a ELSE m.b END) AS c FROM (
      SELECT *, lower(row_label) AS l, regexp_extract(caption, '{duck.UNIT_RX}', ['a','b','u']) AS m FROM fx_captions))""")
def n6(t):
    df = op.detect_units(t("fx_captions"))
    return df.select("p_partkey", "caption", "unit", "currency", F.array_join("units_mentioned", ",").alias("units_mentioned"),
                     op.row_unit(F.col("row_label"), F.lit("crore")).alias("row_unit"))


@query("n7_change_columns", f"SELECT p_partkey, col_label, {duck.change('col_label')} AS change FROM fx_captions")
def n7(t):
    return op.change_columns(t("fx_captions")).select("p_partkey", "col_label", "change")


@query("n8_classify_sections", f"SELECT section_id, heading, {duck.section_type('heading')} AS section_type FROM fx_sections")
def n8(t):
    return op.classify_sections(t("fx_sections")).select("section_id", "heading", "section_type")


@query("n9_apply_label_suggestions", f"""
    SELECT s.report_id, s.section_id, CASE WHEN st = 'other' THEN COALESCE(g.suggested, 'other') ELSE st END AS section_type
    FROM (SELECT *, {duck.section_type('heading')} AS st FROM fx_sections) s
    LEFT JOIN (SELECT report_id, section_id, arg_max(suggested, ord) AS suggested FROM fx_suggestions
               WHERE suggested IN ({', '.join(f"'{x}'" for x in SECTION_TYPES)}) GROUP BY ALL) g USING (report_id, section_id)""")
def n9(t):
    return op.apply_label_suggestions(t("fx_sections"), t("fx_suggestions")).select("report_id", "section_id", "section_type")


@query("n9_labelling_request", f"""
    SELECT report_id, section_id, left(regexp_replace(heading, '\\d', '#', 'g'), 200) AS heading, left(regexp_replace(sample, '\\d', '#', 'g'), 300) AS sample
    FROM fx_sections WHERE {duck.section_type('heading')} = 'other'""")
def n9b(t):
    return op.labelling_request(t("fx_sections"))


@query("n10_section_slugs", f"""
    SELECT section_id, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS slug FROM (
      SELECT *, row_number() OVER (PARTITION BY report_id, base ORDER BY ord) AS n FROM (
        SELECT *, COALESCE(NULLIF(regexp_replace(left(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '^-+|-+$', '', 'g'), ''), replace({duck.section_type('heading')}, '_', '-')) AS base
        FROM fx_sections))""")
def n10(t):
    return op.section_slugs(t("fx_sections")).select("section_id", "slug")


@query("n11_classify_agents", f"SELECT hit_id, user_agent, {duck.agent('user_agent')} AS agent_class FROM fx_hits")
def n11(t):
    return op.classify_agents(t("fx_hits")).select("hit_id", "user_agent", "agent_class")


@query("n12_redact_secrets", """
    SELECT job_id, replace(regexp_replace(error, '(?i)\\b(key|api_key|token|access_token|secret|password)=([^&\\s''"]+)', '\\1=[redacted]', 'g'), 'Bearer tok', '[redacted]') AS error FROM fx_jobs""")
def n12(t):
    return op.redact_secrets(t("fx_jobs"), known=["Bearer tok"]).select("job_id", "error")


_OKWORD = f"""((w = upper(w) AND w <> lower(w)) OR length(regexp_replace(lower(w), '[^a-z]', '', 'g')) < 2 OR NOT (
    (length(regexp_replace(lower(w), '[^a-z]', '', 'g')) >= 4 AND NOT (length(regexp_replace(lower(w), '[^aeiou]', '', 'g'))::DOUBLE / length(regexp_replace(lower(w), '[^a-z]', '', 'g')) BETWEEN 0.1 AND 0.75))
    OR regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '({TRIPLED})|(yy|ii|uu|qq|jj|vv|ww|xx|hh)$') OR regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[bcdfghjklmnpqrstvwxz]{{5,}}')
    OR (regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '^[bcdfghjklmnpqrstvwxz]{{2}}') AND NOT regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '^({WORD_STARTS})'))))"""
_CASEOK = """(regexp_matches(w, '^([a-z]+|[A-Z]+|[A-Z][a-z]*)$') OR (length(regexp_replace(w, '[^A-Z]', '', 'g')) <= 2 AND length(regexp_replace(regexp_replace(w, '[A-Z]+', 'U', 'g'), '[a-z]+', 'l', 'g')) - 1 <= 2))"""
_WORDLIKE = f"""(length(w) >= 4 AND {_CASEOK} AND length(regexp_replace(lower(w), '[^aeiouy]', '', 'g'))::DOUBLE / length(w) BETWEEN 0.2 AND 0.8
    AND NOT regexp_matches(lower(w), '({TRIPLED})|(yy|hh|jj|qq|vv|ww|xx|kk|ii|uu|aa)$') AND NOT regexp_matches(lower(w), CASE WHEN length(w) >= 8 THEN '[^aeiouy]{{6,}}' ELSE '[^aeiouy]{{5,}}' END)
    AND regexp_matches(lower(w), '^(({OCR_STARTS})?[aeiouy])'))"""
_LEAD = "^[\\s•·▪►*‐‑‒–—―\\-‘’“”''\"…]+"


USABLE = f"""CASE WHEN regexp_matches(c, '^[\\p{{Lu}}0-9]') AND length(c) >= 4 AND length(regexp_replace(c, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(c), 1) >= 0.6 AND len(ws) > 0
        AND len(list_filter(ws, lambda w: length(w) > 3 OR w <> upper(w))) > 0 AND len(list_filter(ws, lambda w: {_OKWORD}))::DOUBLE / greatest(len(ws), 1) >= 0.75
        AND NOT (method = 'ocr' AND NOT contains(c, ' ') AND c = upper(c) AND c <> lower(c)) THEN shown END"""
USABLE_FROM = f"""(SELECT *, list_filter(string_split(c, ' '), lambda w: regexp_matches(w, '[A-Za-z]')) AS ws FROM (SELECT *, trim(regexp_replace(shown, '^\\(?(?:[0-9]{{1,3}}|[a-zA-Z]|[ivxIVX]{{1,4}})[.)]\\s+', '')) AS c
    FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(heading, '\\s+', ' ', 'g')), '{_LEAD}', '')) AS shown FROM fx_sections)))"""


@query("n13_heading_quality", f"""
    SELECT section_id, CASE WHEN regexp_matches(c, '^[\\p{{Lu}}0-9]') AND length(c) >= 4 AND length(regexp_replace(c, '[^A-Za-z]', '', 'g'))::DOUBLE / greatest(length(c), 1) >= 0.6 AND len(ws) > 0
        AND len(list_filter(ws, lambda w: length(w) > 3 OR w <> upper(w))) > 0 AND len(list_filter(ws, lambda w: {_OKWORD}))::DOUBLE / greatest(len(ws), 1) >= 0.75
        AND NOT (method = 'ocr' AND NOT contains(c, ' ') AND c = upper(c) AND c <> lower(c)) THEN shown END AS usable, plausible,
      method = 'ocr' AND CASE WHEN kind = 'heading' THEN NOT plausible ELSE n_words <= 4 AND mean_conf < 0.6 AND NOT plausible END AS garbage
    FROM (SELECT *, list_filter(string_split(c, ' '), lambda w: regexp_matches(w, '[A-Za-z]')) AS ws,
       length(array_to_string(toks, '')) >= 3 AND CASE WHEN len(lng) > 0 THEN len(list_filter(lng, lambda w: {_WORDLIKE})) >= 1 AND len(list_filter(lng, lambda w: {_WORDLIKE})) * 2 >= len(lng) AND mean_conf >= 0.4
          ELSE mean_conf >= 0.85 AND len(list_filter(toks, lambda w: NOT {_CASEOK})) = 0 AND len(list_filter(toks, lambda w: replace(lower(w), lower(w)[1:1], '') <> '')) > 0 END AS plausible
    FROM (SELECT *, list_filter(toks, lambda w: length(w) >= 4) AS lng, trim(regexp_replace(shown, '^\\(?(?:[0-9]{{1,3}}|[a-zA-Z]|[ivxIVX]{{1,4}})[.)]\\s+', '')) AS c
    FROM (SELECT *, list_filter(list_transform(list_filter(string_split(t, ' '), lambda w: NOT regexp_matches(w, '[0-9]')), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS toks,
            len(string_split(t, ' ')) AS n_words, trim(regexp_replace(t, '{_LEAD}', '')) AS shown
    FROM (SELECT *, trim(regexp_replace(heading, '\\s+', ' ', 'g')) AS t FROM fx_sections))))""")
def n13(t):
    h = t("fx_sections").withColumns({"text": F.col("heading")})
    h = h.withColumn("n_words", F.size(F.split(op.squeezed(F.col("heading")), " ")))
    return op.heading_quality(h).select("section_id", "usable", "plausible", "garbage")


@query("n14_report_labels", """
    SELECT report_id, trim(CASE WHEN period = 'fy' THEN '' ELSE upper(period) END || ' ' || COALESCE(fiscal_year_label, 'FY' || fiscal_year)) AS period_label,
      '/fy' || fiscal_year || '/' || CASE WHEN period = 'fy' THEN '' ELSE period || '/' END || CASE report_type WHEN 'quarterly_results' THEN 'results' WHEN 'annual_report' THEN 'annual-report' ELSE 'investor-presentation' END || '/' AS base_path
    FROM fx_reports""")
def n14(t):
    return op.report_labels(t("fx_reports")).select("report_id", "period_label", "base_path")
