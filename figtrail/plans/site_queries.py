"""S1–S9, C11, C12 and C14–C16 over stored words, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import checks, site
from figtrail.operators.normalise import report_labels
from figtrail.plans import duck
from figtrail.plans.operations_queries import _scratch
from figtrail.plans.registry import query
from figtrail.sources import readers


def _box(f):
    return F.array(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias(f)


# the DuckDB text's own patterns; the fixtures put no element inside a figure
FLAT_FIGURE_ELEMENT = r'(?is)<[a-z0-9]+[^>]*\bdata-fig="([^"]*)"[^>]*>(.*?)</[a-z0-9]+>'
FLAT_META_ELEMENT = r'(?is)<[a-z0-9]+[^>]*\bdata-meta="([^"]*)"[^>]*>(.*?)</[a-z0-9]+>'
FLAT_UNCHECKED = r'(?is)<[a-z0-9]+[^>]*\bdata-nocheck\b[^>]*>.*?</[a-z0-9]+>'


@query("s1_read_words", "SELECT report_id, page, word_no, text, x0, y0, x1, y1, conf FROM (SELECT *EXCLUDE (word_no), row_number() OVER (PARTITION BY report_id, page ORDER BY line_no, word_no) - 1 AS word_no FROM fx_words)")
def s1(t):
    path = _scratch(t)[0]
    word = F.struct("line_no", "word_no", F.col("text").alias("t"), _box("b"), F.col("conf").alias("c"))
    page = t("fx_words").groupBy("report_id", "page").agg(F.transform(F.array_sort(F.collect_list(word)), lambda w: F.struct(w["t"].alias("t"), w["b"].alias("b"), w["c"].alias("c"))).alias("words"))
    page.select("report_id", F.array(F.struct("page", F.lit("text_layer").alias("method"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), "words")).alias("pages")).write.option("compression", "gzip").json(path)
    return readers.read_words(t.spark, path).select("report_id", "page", "word_no", "text", "x0", "y0", "x1", "y1", "conf")


@query("s3_read_truth", "SELECT 'doc' || page AS file, raw, page, x0, y0, x1, y1, CASE WHEN word_no % 2 = 0 THEN 'cell' ELSE 'text' END AS role FROM fx_figs")
def s3(t):
    path = _scratch(t)[0]
    fig = F.struct("fid", "page", "raw", _box("bbox"), F.when(F.col("word_no") % 2 == 0, "cell").alias("role"))
    t("fx_figs").groupBy("report_id", "page").agg(F.array_sort(F.collect_list(fig)).alias("figures")).select(F.concat(F.lit("doc"), F.col("page").cast("string")).alias("file"), "figures").write.json(path)
    return readers.read_truth(t.spark, path).select("file", "raw", "page", "x0", "y0", "x1", "y1", "role")


def _docs(t):
    """One JSON document per page of the figures adapter: a section, a paragraph of runs and the figure registry."""
    source = F.struct("page", _box("bbox"))
    fig = F.struct(F.col("fid").alias("id"), F.lit("number").alias("kind"), "raw", source.alias("source"), "method", "confidence", "status", "section_id", F.lit("text").alias("role"))
    per = t("fx_figs").groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fid", fig)))).alias("figures"),
                                           F.array_sort(F.collect_list(F.struct("line_no", "word_no", "fid"))).alias("fids"), F.min("section_id").alias("sid"))
    runs = F.flatten(F.transform("fids", lambda x: F.array(F.struct(F.lit("text ").alias("t"), F.lit(None).cast("string").alias("f")), F.struct(F.lit(None).cast("string").alias("t"), x["fid"].alias("f")))))
    block = F.struct(F.lit("b1").alias("id"), F.lit("paragraph").alias("type"), F.struct(F.col("page").alias("page")).alias("source"), runs.alias("runs"))
    sec = F.struct(F.col("sid").alias("id"), F.lit("other").alias("type"), F.lit("Notes").alias("heading_text"), F.lit("notes").alias("slug"), F.array(block).alias("blocks"))
    doc = F.struct(F.lit("1.0").alias("schema_version"), F.array(F.struct("page", F.lit("ocr").alias("method"))).alias("pages"), F.array(sec).alias("sections"), "figures")
    return per.select(F.col("page").alias("version_id"), F.to_json(doc).alias("doc"))


@query("s2_flatten_figures", "SELECT page AS version_id, fid, raw, page, x0, y1, method, confidence, status, section_id FROM fx_figs")
def s2(t):
    return readers.flatten_document(_docs(t))["figures"].select("version_id", "fid", "raw", "page", "x0", "y1", "method", "confidence", "status", "section_id")


@query("s2_flatten_runs", """
    SELECT page AS version_id, section_id, 'b1' AS block_id, 2 * (n - 1) + k AS run_no, CASE WHEN k = 0 THEN 'text ' END AS text, CASE WHEN k = 1 THEN fid END AS run_fid
    FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no, word_no) AS n FROM fx_figs), (SELECT unnest([0, 1]) AS k)""")
def s2b(t):
    return readers.flatten_document(_docs(t))["runs"].select("version_id", "section_id", "block_id", "run_no", "text", "run_fid")


_LIVE = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_BARE = f"regexp_replace({_LIVE}, '{readers.SCRIPTS}', ' ', 'g')"
_UN = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&#39;', ''''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
_STRIP = "regexp_replace({}, '(?s)<[^>]+>', '', 'g')"


def _un(x):
    return _UN.replace("{}", x)


PIECES = f"""b AS (SELECT page_id, report_id, name, {_LIVE} AS live, {_BARE} AS bare FROM fx_html),
    pc AS (
      SELECT page_id, report_id, name, 'text' AS kind, NULL AS ref, {_un('x')} AS text FROM (SELECT page_id, report_id, name, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '{FLAT_UNCHECKED}', ' ', 'g'), '{FLAT_FIGURE_ELEMENT}', ' ', 'g'),
          '{FLAT_META_ELEMENT}', ' ', 'g'), '{readers.TITLE}', ' ', 'g'), '(?s)<[^>]+>', chr(1), 'g'), chr(1))) AS x FROM b) WHERE trim({_un('x')}) <> ''
      UNION ALL SELECT page_id, report_id, name, 'attribute', NULL, {_un('x')} FROM (SELECT page_id, report_id, name, unnest(list_concat(list_concat(regexp_extract_all(bare, '{readers.TITLE}', 1), regexp_extract_all(bare, '{readers.SHOWN_ATTRIBUTE}', 1)), regexp_extract_all(bare, '{readers.DESCRIPTION}', 1))) AS x FROM b)
      UNION ALL SELECT page_id, report_id, name, 'json_ld', NULL, unnest(regexp_extract_all(live, '{readers.JSON_LD}', 1)) FROM b
      UNION ALL SELECT page_id, report_id, name, 'figure', r, {_un(_STRIP.replace('{}', 'x'))} FROM (SELECT page_id, report_id, name, unnest(regexp_extract_all(bare, '{FLAT_FIGURE_ELEMENT}', 1)) AS r, unnest(regexp_extract_all(bare, '{FLAT_FIGURE_ELEMENT}', 2)) AS x FROM b)
      UNION ALL SELECT page_id, report_id, name, 'label', r, {_un(_STRIP.replace('{}', 'x'))} FROM (SELECT page_id, report_id, name, unnest(regexp_extract_all(bare, '{FLAT_META_ELEMENT}', 1)) AS r, unnest(regexp_extract_all(bare, '{FLAT_META_ELEMENT}', 2)) AS x FROM b))"""


@query("s4_scan_html", f"WITH {PIECES} SELECT page_id, kind, ref, text FROM pc")
def s4(t):
    return readers.scan_html(t("fx_html")).select("page_id", "kind", "ref", "text")


EXPORT = """SELECT report_id, fid, section_id, CASE WHEN word_no % 3 = 0 THEN 'date' WHEN word_no % 3 = 1 THEN 'number' ELSE 'identifier' END AS kind, raw, concat('v', raw) AS value, concat('i', raw) AS iso, page, x0, y0, x1, y1, method, confidence, status,
    CASE WHEN line_no % 4 = 0 THEN 'heading' ELSE 'cell' END AS role, 't1' AS table_id, 'r' AS row_label, 'c' AS col_label, 'p' AS period, 'crore' AS unit, 'INR' AS currency FROM fx_figs"""


@query("s5_export_rows", f"""SELECT e.report_id, fid AS id, CAST(x.n AS VARCHAR) AS section, CASE WHEN kind = 'date' THEN iso ELSE value END AS value, kind, page AS source_page FROM ({EXPORT}) e LEFT JOIN (SELECT report_id, section_id, ord AS n FROM fx_sections WHERE ord % 2 = 0) x USING (report_id, section_id)
    WHERE status = 'active' AND kind <> 'identifier' AND role = 'cell'""")
def s5(t):
    sections = t("fx_sections").filter("ord % 2 = 0").select("report_id", "section_id", F.col("ord").cast("string").alias("slug"))
    return site.export_rows(t.sql(EXPORT), sections).select("report_id", "id", "section", "value", "kind", "source_page")


def _blocks(t):
    words = F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda e: e["text"])
    per = t("fx_words").groupBy("report_id", "page", F.col("line_no").alias("ord")).agg(words.alias("texts"))
    return per.withColumn("kind", F.when(F.col("ord") == 0, "heading").when(F.col("ord") % 3 == 1, "table_row").otherwise("paragraph"))


MD = """SELECT report_id, page, line_no AS ord, CASE WHEN line_no = 0 THEN '## ' || string_agg(replace(text, '|', '\\|'), '' ORDER BY word_no) WHEN line_no % 3 = 1 THEN '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY word_no) || ' |'
    ELSE string_agg(replace(text, '|', '\\|'), '' ORDER BY word_no) END AS line FROM fx_words GROUP BY report_id, page, line_no"""


@query("s6_assemble_markdown", f"SELECT report_id, page, string_agg(line, chr(10) ORDER BY ord) AS markdown FROM ({MD}) GROUP BY ALL")
def s6(t):
    return site.assemble_markdown(_blocks(t))


@query("s7_dedupe_sources", "SELECT tenant_id, sha256(content) AS sha256, arg_max(filename, at_no) AS filename, count(*) AS uploads, max(length(content)) AS size FROM fx_sources GROUP BY ALL")
def s7(t):
    return site.dedupe_sources(t("fx_sources"))


FILES = "SELECT version_id, concat(r, CASE k WHEN 0 THEN 'index.html' WHEN 1 THEN 'notes/index.html' ELSE 'figures.csv' END) AS rel, concat(bundle_key, CAST(k AS STRING)) AS content FROM (SELECT version_id, bundle_key, 'fy2025/q2/results/' AS r FROM fx_versions WHERE bundle_key IS NOT NULL) v CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x"


def _live(t):
    v = t("fx_versions").filter("bundle_key IS NOT NULL").select(F.col("version_id").alias("live_version_id"), "bundle_key", "published_at")
    return report_labels(t("fx_reports").filter("deleted_at IS NULL")).join(v, "live_version_id").withColumn("version_id", F.col("live_version_id"))


@query("s8_site_manifest", f"""
    WITH l AS (SELECT r.report_id, v.version_id, v.bundle_key FROM fx_reports r JOIN fx_versions v ON v.version_id = r.live_version_id WHERE r.deleted_at IS NULL AND v.bundle_key IS NOT NULL), f AS ({FILES}),
    p AS (SELECT report_id, version_id, '/' || rel AS path, bundle_key || '/' || rel AS key FROM l JOIN f USING (version_id)) SELECT * FROM p UNION ALL SELECT report_id, version_id, left(path, length(path) - 10), key FROM p WHERE path LIKE '%/index.html'""")
def s8(t):
    return site.site_manifest(_live(t), t.sql(FILES))


@query("s8_sitemap", f"""
    WITH l AS (SELECT r.report_id, v.version_id, CAST(v.published_at AS DATE) AS lastmod, '/fy' || fiscal_year || '/' || CASE WHEN period = 'fy' THEN '' ELSE period || '/' END || CASE report_type WHEN 'quarterly_results' THEN 'results' WHEN 'annual_report' THEN 'annual-report' ELSE 'investor-presentation' END || '/' AS base
        FROM fx_reports r JOIN fx_versions v ON v.version_id = r.live_version_id WHERE r.deleted_at IS NULL AND v.bundle_key IS NOT NULL)
    SELECT report_id, base AS loc, lastmod FROM l UNION ALL SELECT report_id, base || 'report.md', lastmod FROM l
    UNION ALL SELECT report_id, '/' || left(rel, length(rel) - 10), lastmod FROM l JOIN ({FILES}) f USING (version_id) WHERE rel LIKE '%/index.html' AND '/' || rel <> base || 'index.html'""")
def s8b(t):
    return site.sitemap(_live(t), t.sql(FILES))


@query("s9_bundle_identity", f"SELECT version_id, sha256(string_agg(rel || chr(9) || sha256(content), chr(10) ORDER BY rel)) AS bundle_sha FROM ({FILES}) GROUP BY ALL")
def s9(t):
    return site.bundle_identity(t.sql(FILES))


@query("s9_content_identity", """
    WITH h AS (SELECT report_id, page, sha256('{"fid":"' || fid || '","status":"' || status || '"}') AS h FROM fx_figs)
    SELECT report_id, page, sha256(concat_ws('|', count(*), sum(CAST('0x' || h[1:15] AS UBIGINT)), sum(CAST('0x' || h[16:30] AS UBIGINT)), sum(CAST('0x' || h[31:45] AS UBIGINT)), sum(CAST('0x' || h[46:60] AS UBIGINT)))) AS content_sha FROM h GROUP BY ALL""")
def s9b(t):
    return site.content_identity(t("fx_figs"), ["report_id", "page"], ["fid", "status"])


# ------------------------------------------------------------------ checks over the built pages

PW = "pw AS (SELECT DISTINCT source AS report_id, doc_id AS page, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM documents), sh AS (SELECT report_id, word, count(*) AS on_pages FROM pw GROUP BY ALL)"


def _page_words(t):
    return checks.page_words(t("documents").select(F.col("source").alias("report_id"), F.col("doc_id").alias("page"), "text"))


@query("c11_check_text_on_site", f"""
    WITH {PW}, st AS (SELECT DISTINCT report_id, word FROM pw WHERE page % 3 = 0), dr AS (SELECT DISTINCT report_id, page FROM pw WHERE page % 7 = 0),
    a AS (SELECT pw.report_id, pw.page, count(*) AS n, count(st.word) AS ns, count(*) FILTER (WHERE on_pages <= 2) AS own, count(st.word) FILTER (WHERE on_pages <= 2) AS os FROM pw JOIN sh USING (report_id, word) LEFT JOIN st ON st.report_id = pw.report_id AND st.word = pw.word GROUP BY ALL),
    j AS (SELECT *, CASE WHEN own >= 3 THEN own ELSE n END AS pool, CASE WHEN own >= 3 THEN os ELSE ns END AS hits FROM a)
    SELECT report_id, page, 'completeness' AS check_name, 'warning' AS severity, pool AS judged, hits AS found FROM j WHERE pool >= 3 AND hits < 0.5 * pool AND ns < 0.7 * n AND (report_id, page) NOT IN (SELECT (report_id, page) FROM dr)""")
def c11(t):
    words = _page_words(t)
    return site.check_text_on_site(words, words.filter("page % 3 = 0"), words.filter("page % 7 = 0").select("report_id", "page").distinct())


@query("c11_pages_drawn", "SELECT DISTINCT page_id % 8 AS report_id, page_id % 30 AS page FROM pages")
def c11b(t):
    return site.pages_drawn(t("fx_html"))


PMAP = "SELECT source AS report_id, doc_id AS page, CASE doc_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'cover' WHEN 2 THEN 'picture' ELSE 'text' END AS shown, doc_id % 4 = 0 AS own_section, CASE WHEN doc_id % 3 <> 0 THEN concat('T', CAST(doc_id AS STRING)) END AS title, doc_id % 5 AS pictures FROM {documents}"


@query("c12_check_page_coverage", f"""
    WITH {PW}, m AS ({PMAP}), a AS (SELECT report_id, page, count(*) AS n, bool_and(on_pages >= 2) AS rep FROM pw JOIN sh USING (report_id, word) GROUP BY ALL),
    j AS (SELECT m.*, CASE WHEN COALESCE(rep, FALSE) AND title IS NULL THEN NULL WHEN title IS NOT NULL AND shown <> 'none' AND NOT own_section THEN 'no section of its own' WHEN shown = 'none' AND pictures > 0 AND COALESCE(n, 0) < 3 THEN 'picture page missing' END AS problem FROM m LEFT JOIN a USING (report_id, page) WHERE shown <> 'cover')
    SELECT report_id, page, problem, 'completeness' AS check_name, 'warning' AS severity FROM j WHERE problem IS NOT NULL""")
def c12(t):
    pmap = t.sql(PMAP)
    return site.check_page_coverage(pmap.drop("pictures"), _page_words(t), pmap.select("report_id", "page", "pictures"))


_TRIM = "regexp_replace({}, '^[,.;:()]+|[,.;:()]+$', '', 'g')"
TOKENS = "tk AS (SELECT DISTINCT report_id, unnest(string_split(meta_value, ' ')) AS token FROM fx_site_meta)"


@query("c14_check_rendered", f"""
    WITH {PIECES}, {TOKENS}, x AS (
      SELECT p.report_id, name, ref, CASE WHEN f.raw IS NULL AND regexp_matches(p.text, '[0-9]') THEN 'unknown figure' WHEN f.status <> 'active' AND trim(p.text) <> f.raw THEN 'excluded value shown differently' WHEN f.status = 'active' AND trim(p.text) <> f.raw THEN 'differs from the document' END AS problem, trim(p.text) AS actual
        FROM pc p LEFT JOIN fx_site_figures f ON f.report_id = p.report_id AND f.fid = p.ref WHERE kind = 'figure'
      UNION ALL SELECT p.report_id, name, ref, CASE WHEN trim(text) IS DISTINCT FROM meta_value THEN 'label differs' END, trim(text) FROM pc p LEFT JOIN fx_site_meta m ON m.report_id = p.report_id AND m.meta_key = p.ref WHERE kind = 'label' AND regexp_matches(text, '[0-9]')
      UNION ALL SELECT report_id, name, ref, 'number is no figure', unnest(regexp_extract_all(text, '\\S*[0-9]\\S*')) FROM pc WHERE kind = 'text'
      UNION ALL SELECT report_id, name, ref, 'number in attributes is no label', a FROM (SELECT *, unnest(regexp_extract_all(text, '\\S*[0-9]\\S*')) AS a FROM pc WHERE kind = 'attribute') q WHERE (report_id, {_TRIM.format('a')}) NOT IN (SELECT (report_id, token) FROM tk))
    SELECT report_id, name, ref, problem, actual FROM x WHERE problem IS NOT NULL""")
def c14(t):
    return site.check_rendered(readers.scan_html(t("fx_html")), t("fx_site_figures"), t("fx_site_meta")).select("report_id", "name", "ref", "problem", "actual")


@query("c15_check_jsonld", """
    SELECT page_id % 8 AS report_id, 'p' || page_id || '.html' AS name, CASE WHEN page_id % 10 = 3 THEN 'not valid JSON' ELSE 'number is no label' END AS problem, CASE WHEN page_id % 10 <> 3 THEN '2031' END AS actual FROM pages WHERE page_id % 10 = 3 OR page_id % 5 = 0""")
def c15(t):
    return site.check_jsonld(readers.scan_html(t("fx_html")), t("fx_site_meta")).select("report_id", "name", "problem", "actual")


@query("c16_check_markdown", f"""
    WITH l AS ({MD}), k AS (SELECT DISTINCT report_id, unnest(list_append(string_split(raw, ' '), raw)) AS token FROM fx_figs WHERE page % 2 = 0),
    t AS (SELECT DISTINCT report_id, page, ord AS line_no, a AS actual FROM (SELECT *, unnest(regexp_extract_all(regexp_replace(line, '\\]\\([^)]*\\)', ']', 'g'), '[^\\s|]*[0-9][^\\s|]*')) AS a FROM l)),
    c AS (SELECT *, regexp_replace(actual, '^[*_`,;:]+|[*_`,;:]+$', '', 'g') AS c FROM t)
    SELECT report_id, page, line_no, actual FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.report_id = c.report_id AND k.token IN (actual, regexp_replace(actual, '[,;:]+$', ''), c.c, {duck.core('c.c')}))""")
def c16(t):
    lines = site.markdown_lines(_blocks(t)).withColumnRenamed("ord", "line_no")
    meta = t("fx_site_meta").select(F.lit("none").alias("report_id"), "meta_key", "meta_value")
    return site.check_markdown(lines, t("fx_figs").filter("page % 2 = 0"), meta).select("report_id", "page", "line_no", "actual").distinct()
