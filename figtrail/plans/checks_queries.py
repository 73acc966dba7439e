"""C1–C10, C13 and C17 over figures, words and table cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.functions.dates import with_date, with_period
from figtrail.functions.numbers import garbled_number, with_number
from figtrail.functions.text import core_of
from figtrail.operators import checks as op
from figtrail.operators import review
from figtrail.operators.normalise import change_kind, section_slugs, unit_fields
from figtrail.plans import duck
from figtrail.plans.registry import query
from figtrail.session import cut


def _found(words: str, pad: str, figs: str, text: str = "w.text", raw: str = "raw") -> str:
    return f"""SELECT f.*, COALESCE(j.joined, '') AS joined FROM ({figs}) f LEFT JOIN (
      SELECT f.report_id, f.page, f.fid, string_agg({text}, ' ' ORDER BY round_even(w.y0 / 4, 0), w.x0) AS joined FROM ({figs}) f JOIN {words} w ON w.report_id = f.report_id AND w.page = f.page
        AND (w.x0 + w.x1) / 2 BETWEEN f.x0 - {pad} AND f.x1 + {pad} AND (w.y0 + w.y1) / 2 BETWEEN f.y0 - {pad} AND f.y1 + {pad} GROUP BY ALL) j
      ON j.report_id = f.report_id AND j.page = f.page AND j.fid = f.fid"""


LIVE = "SELECT * FROM fx_figs WHERE status = 'active' AND NOT edited"
TRACE = _found("fx_words", "1.5", LIVE)
SECOND = _found("fx_words2", "2.5", LIVE + " AND method = 'text_layer'")


@query("c1_check_traceability", f"SELECT report_id, fid, page, 'traceability' AS check_name, 'blocking' AS severity, raw AS expected, joined AS actual FROM ({TRACE}) WHERE NOT contains(joined, raw)")
def c1(t):
    return op.check_traceability(t("fx_figs"), t("fx_words"))


@query("c1_confirmed_by_trace", f"SELECT report_id, fid FROM ({TRACE}) WHERE contains(joined, raw)")
def c1b(t):
    return op.confirmed_by_trace(t("fx_figs"), t("fx_words"))


@query("c2_check_second_reading", f"SELECT report_id, fid, page, 'second_parser' AS check_name, 'blocking' AS severity, raw AS expected, joined AS actual FROM ({SECOND}) WHERE NOT contains(joined, raw)")
def c2(t):
    return op.check_second_reading(t("fx_figs"), t("fx_words2"), t("fx_doc_pages"))


def _kinds(df):
    """Kind of a figure as the extractor sets it: a date, a number, else an identifier."""
    df = with_date(with_number(df.withColumn("core", core_of(F.col("raw"))), "core", "n_"), "core", "d_")
    kind = F.when(F.col("d_iso").isNotNull() & ~(F.col("n_kind").isNotNull() & (F.col("d_precision") == "month")), "date").otherwise(F.coalesce("n_kind", F.lit("identifier")))
    return df.withColumn("kind", kind)


def kinds_sql(source: str) -> str:
    inner = duck.number(f"SELECT *, {duck.core('raw')} AS core FROM ({source})", "core", "n_")
    inner = duck.date(inner, "core", "d_")
    return f"SELECT *, CASE WHEN d_iso IS NOT NULL AND NOT (n_kind IS NOT NULL AND d_precision = 'month') THEN 'date' ELSE COALESCE(n_kind, 'identifier') END AS kind FROM ({inner})"


_C = "regexp_replace(regexp_replace({}, '[^0-9.]', '', 'g'), '^\\.+|\\.+$', '', 'g')"
FIGK = f"SELECT * FROM ({kinds_sql('SELECT * FROM fx_figs')}) WHERE status = 'active' AND kind IN ('number','percent','bps','multiple','nil','date')"
READS = f"""WITH fk AS MATERIALIZED ({FIGK}),
    rd AS (SELECT fk.report_id, fk.fid, fk.raw, fk.kind, r.reading_no, r.reading, regexp_replace(trim(r.reading), '^[°"''`]+|[°"''`]+$', '', 'g') AS read, CASE WHEN fk.raw LIKE '(%' THEN fk.raw ELSE {duck.core('fk.raw')} END AS rc
           FROM fk JOIN fx_readings r ON r.report_id = fk.report_id AND r.fid = fk.fid),
    rn AS ({duck.number('SELECT * FROM rd', 'rc', 'r_')}),
    bs AS (SELECT *, CASE WHEN contains(rc, '.') THEN [read, regexp_replace(regexp_replace(read, '([0-9])[-–]([0-9])', '\\1.\\2', 'g'), '([0-9])[-–]([0-9])', '\\1.\\2', 'g')] ELSE [read] END AS base FROM rn),
    cd AS (SELECT * EXCLUDE (base), regexp_replace(unnest(CASE WHEN r_currency_symbol IS NOT NULL THEN list_concat(base, list_transform(base, lambda x: CASE WHEN regexp_matches(x, '^[0-9(].') THEN x[2:] ELSE regexp_extract(x, '^[^0-9(]+([0-9(].*)$', 1) END)) ELSE base END), '[ –-]+$', '') AS cand FROM bs),
    cn AS ({duck.number('SELECT * FROM cd', 'cand', 'c_')}),
    jd AS (SELECT report_id, fid, reading_no, max(reading) AS reading, bool_or(CASE WHEN kind = 'nil' THEN read = '' OR regexp_matches(read, '^[-–—_ ]*$') OR lower(read) = 'nil'
        WHEN kind = 'date' THEN regexp_replace(raw, '[^0-9]', '', 'g') = regexp_replace(read, '[^0-9]', '', 'g')
        ELSE {_C.format('rc')} = {_C.format('cand')} AND CASE WHEN r_kind IS NOT NULL AND c_kind IS NOT NULL THEN r_negative = c_negative AND (r_kind = c_kind OR (r_kind IN ('multiple','percent') AND c_kind IN ('multiple','percent')))
             ELSE NOT (COALESCE(r_negative, FALSE) AND NOT regexp_matches(cand, '[(\\-−–]')) AND NOT (COALESCE(r_kind = 'percent', FALSE) AND NOT contains(cand, '%')) END END) AS agrees,
        bool_or(regexp_replace(reading, '[^0-9]', '', 'g') <> '' AND NOT regexp_replace(reading, '[^0-9]', '', 'g') LIKE '%' || array_to_string(regexp_extract_all(raw, '[0-9]+'), '%') || '%') AS contradicts,
        bool_or(regexp_matches(reading, '[0-9]')) AS shows FROM cn GROUP BY ALL)"""


@query("c3_check_rereads", f"""{READS},
    p AS (SELECT report_id, fid, bool_or(agrees) AS ok, count(*) FILTER (WHERE shows) AS dr, count(*) FILTER (WHERE shows AND contradicts) AS ag, arg_max(reading, reading_no) FILTER (WHERE reading <> '') AS last_read FROM jd GROUP BY ALL),
    tc AS (SELECT report_id, fid FROM ({TRACE}) WHERE contains(joined, raw) INTERSECT SELECT report_id, fid FROM ({SECOND}) WHERE contains(joined, raw))
    SELECT fk.report_id, fk.fid, fk.page, 're_extraction' AS check_name, CASE WHEN fk.method = 'text_layer' AND tc.fid IS NOT NULL AND COALESCE(ag, 0) * 2 < greatest(1, COALESCE(dr, 0)) THEN 'warning' ELSE 'blocking' END AS severity,
      fk.raw AS expected, COALESCE(last_read, '(unreadable)') AS actual
    FROM fk LEFT JOIN p ON p.report_id = fk.report_id AND p.fid = fk.fid LEFT JOIN tc ON tc.report_id = fk.report_id AND tc.fid = fk.fid WHERE NOT COALESCE(ok, FALSE)""")
def c3(t):
    figs = t("fx_figs")
    both = op.confirmed_by_trace(figs, t("fx_words")).join(
        op.confirmed_by_second_reading(figs, t("fx_words2"), t("fx_doc_pages")), ["report_id", "fid"], "left_semi")
    return op.check_rereads(_kinds(figs), t("fx_readings"), both)


@query("c3_confirmed_by_reread", f"{READS} SELECT DISTINCT report_id, fid FROM jd WHERE agrees")
def c3b(t):
    return op.confirmed_by_reread(_kinds(t("fx_figs")), t("fx_readings"))


VALUES = f"""v AS (SELECT *, CASE kind WHEN 'number' THEN value WHEN 'nil' THEN 0 END AS val FROM ({duck.number('SELECT * FROM fx_cells')})),
    s AS (SELECT *, regexp_matches(label, '(?i)\\btotal\\b') AS tot FROM v),
    g AS (SELECT *, count(*) FILTER (WHERE tot) OVER (PARTITION BY report_id, table_id, col_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS segment FROM s),
    n AS (SELECT report_id, table_id, segment, count(DISTINCT row_no) FILTER (WHERE NOT tot AND val IS NOT NULL) AS rows FROM g GROUP BY ALL),
    c AS (SELECT report_id, table_id, segment, col_no, CAST(sum(val) FILTER (WHERE NOT tot) AS DECIMAL(38,4)) AS s, count(val) FILTER (WHERE NOT tot) AS k, max(row_no) FILTER (WHERE tot) AS row_no,
            max(label) FILTER (WHERE tot) AS label, max(raw) FILTER (WHERE tot) AS raw, CAST(max(val) FILTER (WHERE tot) AS DECIMAL(38,4)) AS total FROM g GROUP BY ALL),
    j AS (SELECT c.*, abs(s - total) <= 5 * pow(10, -length(regexp_extract(raw, '\\.(\\d+)', 1)) - 1) * k AS ok FROM c JOIN n USING (report_id, table_id, segment) WHERE total IS NOT NULL AND k = rows AND rows >= 2),
    w AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY report_id, table_id, segment) AS n_ok, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY report_id, table_id, segment) AS n_bad FROM j)"""
TOTALS = f"WITH {VALUES} SELECT report_id, table_id, row_no, col_no, 'arithmetic' AS check_name, CASE WHEN n_ok >= n_bad THEN 'blocking' ELSE 'warning' END AS severity, label, CAST(s AS VARCHAR) AS expected, raw AS actual FROM w WHERE NOT ok AND n_ok > 0"


@query("c4_check_totals", TOTALS)
def c4(t):
    return op.check_totals(t("fx_stated_cells"))


@query("c4_cells_in_totals", f"WITH {VALUES} SELECT g.report_id, g.table_id, g.row_no, g.col_no, w.ok AS confirmed FROM g JOIN w USING (report_id, table_id, segment, col_no) WHERE w.n_ok > 0 AND g.val IS NOT NULL")
def c4b(t):
    return op.cells_in_totals(t("fx_stated_cells"))


@query("a4_run_summary_of_totals", f"""
    WITH i AS ({TOTALS}) SELECT report_id, figures_checked, figures_checked - COALESCE(bad, 0) AS passed, COALESCE(warnings, 0) AS warnings, COALESCE(blocking, 0) AS blocking
    FROM (SELECT report_id, count(*) AS figures_checked FROM fx_cells GROUP BY ALL) LEFT JOIN (SELECT report_id, count(*) AS bad, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'blocking') AS blocking FROM i GROUP BY ALL) USING (report_id)""")
def a4t(t):
    cells = cut(t("fx_cells"))  # checked and counted
    fid = F.concat_ws(":", "row_no", "col_no")
    issues = cut(op.check_totals(cells).withColumns({"fid": fid, "status": F.lit("open")}))
    figures = cells.select("report_id", fid.alias("fid"), F.lit("active").alias("status"))
    return review.run_summary(issues, figures, ("report_id",)).select("report_id", "figures_checked", "passed", "warnings", "blocking")


@query("c5_check_balance", """
    SELECT a.report_id, a.table_id, a.col_no, 'arithmetic' AS check_name, 'blocking' AS severity, a.raw AS expected, l.raw AS actual FROM fx_balance a JOIN fx_balance l USING (report_id, table_id, col_no)
    WHERE a.label = 'Total assets' AND l.label = 'Total equity and liabilities' AND a.raw <> l.raw""")
def c5(t):
    return op.check_balance(t("fx_stated_balance"))


def _change_columns(t):
    heads = t("fx_change_cells").select("report_id", "table_id", "col_no", "col_label").distinct()
    return with_period(heads, "col_label").withColumn("change", change_kind(F.col("col_label")))


@query("c6_check_stated_changes", f"""
    SELECT s.report_id, s.table_id, 3 AS col_no, s.label, 'arithmetic' AS check_name, 'warning' AS severity, round_even((u - p) / abs(p) * 100, 1) AS expected_change, s.raw AS actual
    FROM (SELECT *, CAST(replace(raw, '%', '') AS DOUBLE) AS st FROM fx_change_cells WHERE col_no = 3) s JOIN (SELECT report_id, table_id, label, TRY_CAST(raw AS DOUBLE) AS u FROM fx_change_cells WHERE col_no = 1) USING (report_id, table_id, label)
    JOIN (SELECT report_id, table_id, label, TRY_CAST(raw AS DOUBLE) AS p FROM fx_change_cells WHERE col_no = 2) USING (report_id, table_id, label)
    WHERE p <> 0 AND abs((u - p) / abs(p) * 100 - st) > 0.05 + 0.005 * 2 / abs(p) * 100""")
def c6(t):
    return op.check_stated_changes(t("fx_change_cells"), _change_columns(t))


LINES = duck.period(duck.number("SELECT * EXCLUDE (kind) FROM fx_table_figures"), "col_label")
SAME = f"""WITH l AS (SELECT *, regexp_replace(lower(row_label), '[^a-z]', '', 'g') AS nl FROM ({LINES})),
    k AS (SELECT report_id, nl, period_key, count(DISTINCT table_id) AS nt, count(DISTINCT value) AS nv, arg_min(value_str, (page, fid)) AS fv, arg_min(raw, (page, fid)) AS fr, arg_min(fid, (page, fid)) AS ff FROM l GROUP BY ALL)"""


def _lines(t):
    return with_period(with_number(t("fx_table_figures"), "raw", "n_"), "col_label").withColumns({"value": F.col("n_value"), "value_str": F.col("n_value_str")})


@query("c7_check_cross_tables", f"""{SAME} SELECT l.report_id, l.fid, l.page, 'cross_table' AS check_name, 'warning' AS severity, k.fr AS expected, l.raw AS actual FROM l JOIN k USING (report_id, nl, period_key) WHERE nt > 1 AND nv > 1 AND fid <> ff AND value_str <> fv""")
def c7(t):
    return op.check_cross_tables(_lines(t))


@query("c7_confirmed_across_tables", f"{SAME} SELECT l.report_id, l.fid FROM l JOIN k USING (report_id, nl, period_key) WHERE nt > 1 AND nv = 1")
def c7b(t):
    return op.confirmed_across_tables(_lines(t))


@query("c8_check_units", f"""
    WITH c AS (SELECT p_partkey % 40 AS report_id, p_partkey AS table_id, p_partkey % 7 AS page, p_partkey % 11 <> 0 AS has_numbers, CASE WHEN lower(u) IN ('crore','crores','cr','cr.') THEN 'crore' WHEN lower(u) IN ('lakh','lakhs','lac','lacs') THEN 'lakh' WHEN lower(u) IN ('million','millions','mn') THEN 'million'
        WHEN lower(u) IN ('billion','billions','bn') THEN 'billion' WHEN u <> '' THEN 'thousand' END AS unit, regexp_matches(lower(caption), '(crores?|cr\\.?)\\b') AS cr, regexp_matches(lower(caption), '(lakhs?|lacs?)\\b') AS lk
      FROM (SELECT *, regexp_extract(caption, '{duck.UNIT_RX}', 3) AS u FROM fx_captions)),
    m AS (SELECT report_id, bool_or(cr) AND bool_or(lk) AS mixed FROM c GROUP BY ALL)
    SELECT report_id, table_id, page, 'period_unit' AS check_name, CASE WHEN unit IS NULL AND mixed THEN 'blocking' ELSE 'warning' END AS severity, CASE WHEN unit IS NULL THEN 'no unit label' ELSE 'other unit' END AS problem, unit AS actual
    FROM c JOIN m USING (report_id) WHERE has_numbers AND (unit IS NULL OR unit <> 'crore')""")
def c8(t):
    caps = t("fx_captions")
    u = unit_fields(F.col("caption"))
    tables = caps.select((F.col("p_partkey") % 40).alias("report_id"), F.col("p_partkey").alias("table_id"), (F.col("p_partkey") % 7).alias("page"), ((F.col("p_partkey") % 11) != 0).alias("has_numbers"),
                         u["unit"].alias("unit"), u["units_mentioned"].alias("units_mentioned")).withColumn("unit_source", F.when(F.col("unit").isNotNull(), "caption").otherwise("report_metadata"))
    meta = tables.select("report_id").distinct().withColumn("report_unit", F.lit("crore"))
    return op.check_units(tables, meta)


_PCELLS = "SELECT report_id, 't1' AS table_id, row_no, col_no, raw, CASE WHEN row_no % 2 = 0 THEN 'year:FY2025' WHEN row_no % 3 = 0 THEN 'year:FY2024' END AS cell_period_key FROM fx_cells"


@query("c9_check_periods", f"""
    WITH pc AS ({_PCELLS}) SELECT DISTINCT report_id, table_id, col_no, CAST(NULL AS BIGINT) AS row_no, 'warning' AS severity, NULL AS expected, NULL AS actual, 'period_unit' AS check_name FROM pc WHERE col_no = 3
    UNION ALL SELECT report_id, table_id, col_no, row_no, 'blocking', 'year:FY2025', cell_period_key, 'period_unit' FROM pc WHERE col_no = 1 AND cell_period_key <> 'year:FY2025'""")
def c9(t):
    cells = t.sql(_PCELLS)
    columns = cells.select("report_id", "table_id", "col_no").distinct().withColumns({
        "period_key": F.when(F.col("col_no") == 1, "year:FY2025"), "change": F.when(F.col("col_no") == 2, "yoy")})
    return op.check_periods(cells, columns)


@query("c10_check_completeness", """
    WITH d AS (SELECT w.report_id, w.page, count(*) AS total FROM fx_words w JOIN fx_excluded e USING (report_id, page) WHERE regexp_matches(w.text, '[0-9]')
        AND NOT ((w.x0 + w.x1) / 2 BETWEEN e.x0 - 2 AND e.x1 + 2 AND (w.y0 + w.y1) / 2 BETWEEN e.y0 - 2 AND e.y1 + 2) GROUP BY ALL),
    c AS (SELECT report_id, page, CAST(sum(len(list_filter(string_split(raw, ' '), lambda x: regexp_matches(x, '[0-9]')))) AS BIGINT) AS captured FROM fx_figs WHERE word_no % 3 = 0 GROUP BY ALL)
    SELECT report_id, page, 'missed numbers' AS problem, total AS expected, COALESCE(captured, 0) AS actual, 'completeness' AS check_name, 'warning' AS severity FROM d LEFT JOIN c USING (report_id, page) WHERE total > COALESCE(captured, 0)
    UNION ALL SELECT report_id, page, 'hidden numbers', hidden_numbers, 0, 'completeness', 'warning' FROM fx_doc_pages WHERE hidden_numbers > 0
    UNION ALL SELECT report_id, page, 'picture', 1, 0, 'completeness', 'warning' FROM fx_doc_pages WHERE has_picture AND NOT shown""")
def c10(t):
    pages = t("fx_doc_pages")
    pictures = pages.filter("has_picture").withColumn("extracted", F.lit(False))
    return op.check_completeness(t("fx_words"), t("fx_figs").filter("word_no % 3 = 0"), t("fx_excluded"), pages, pictures)


GARBLED = "(NOT regexp_matches(trim(raw), '^(19|20)\\d{2}\\s?[-–]\\s?(((19|20)?\\d{2}))$') AND regexp_matches(raw, '^[(\\-−–]?\\d[\\d,.\\-–]*\\)?%?$') AND g_kind IS NULL)"


@query("c13_check_low_confidence", f"""{READS}, a AS (SELECT * FROM ({duck.number(kinds_sql('SELECT * FROM fx_figs'), 'raw', 'g_')}) WHERE status = 'active'), o AS (SELECT DISTINCT report_id, fid FROM jd WHERE agrees),
    p AS (SELECT a.*, CASE WHEN {GARBLED} THEN 'unreadable number' WHEN low AND o.fid IS NOT NULL AND confidence >= 0.5 THEN 'low but agreed' WHEN low THEN 'low confidence' WHEN kind = 'date' AND d_ambiguous THEN 'ambiguous date' END AS problem
      FROM (SELECT *, method = 'ocr' AND confidence < 0.95 AND kind IN ('number','percent','bps','multiple','nil','date') AS low FROM a) a LEFT JOIN o ON o.report_id = a.report_id AND o.fid = a.fid)
    SELECT report_id, fid, page, 'low_confidence' AS check_name, CASE WHEN problem IN ('unreadable number','low confidence') THEN 'blocking' ELSE 'warning' END AS severity, problem FROM p WHERE problem IS NOT NULL""")
def c13(t):
    figs = _kinds(t("fx_figs"))
    agreed = op.confirmed_by_reread(figs, t("fx_readings"))
    return op.check_low_confidence(figs.withColumns({"unparsed": garbled_number(F.col("raw")), "ambiguous": F.col("d_ambiguous")}), agreed)


@query("c17_check_schema", """
    SELECT part, row_key, unnest(list_filter(p, lambda x: x IS NOT NULL)) AS problem, 'schema' AS check_name, 'blocking' AS severity FROM (
      SELECT 'metadata' AS part, CAST(upload_id AS VARCHAR) AS row_key, [CASE WHEN company_name = '' THEN 'company is empty' END, CASE WHEN report_type = 'memo' THEN 'report_type' END, CASE WHEN period = 'q9' THEN 'period' END, CASE WHEN currency <> 'INR' THEN 'currency' END] AS p
        FROM (SELECT upload_id, trim(company_name) AS company_name, report_type, lower(period) AS period, upper(trim(currency)) AS currency FROM fx_uploads)
      UNION ALL SELECT 'pages', report_id || '/' || page, [CASE WHEN page < 1 THEN 'page' END] FROM fx_doc_pages
      UNION ALL SELECT 'figures', report_id || '/' || fid, [CASE WHEN page < 1 THEN 'page' END, CASE WHEN confidence > 1 THEN 'confidence' END] FROM fx_figs
      UNION ALL SELECT 'runs', report_id || '/' || page || '/' || line_no || '/' || word_no, [CASE WHEN regexp_matches(text, '[0-9]') THEN 'text run holds a digit' END] FROM fx_words)""")
def c17(t):
    meta = t("fx_uploads").select("upload_id", F.trim("company_name").alias("company"), "report_type", F.lit(2025).alias("fiscal_year"), F.lower("period").alias("period"), F.upper(F.trim("currency")).alias("currency"), "reporting_unit")
    figures = with_number(t("fx_figs"), "raw", "n_").withColumns({"kind": F.coalesce("n_kind", F.lit("identifier")), "value_str": F.col("n_value_str"), "role": F.lit("text")})
    runs = t("fx_words").withColumn("run_fid", F.lit(None).cast("string"))
    sections = section_slugs(t("fx_sections"))
    return op.check_schema({"metadata": meta, "pages": t("fx_doc_pages"), "sections": sections, "figures": figures, "runs": runs},
                           {"metadata": ["upload_id"], "pages": ["report_id", "page"], "sections": ["section_id"], "figures": ["report_id", "fid"], "runs": ["report_id", "page", "line_no", "word_no"]})


