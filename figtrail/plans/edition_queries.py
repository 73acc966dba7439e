"""E1–E12, M1–M13 and Q1–Q3 over documents, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import accuracy as acc
from figtrail.operators import edition as op
from figtrail.operators import metadata as m
from figtrail.operators.normalise import classify_sections
from figtrail.plans import duck
from figtrail.plans.registry import query
from figtrail.session import cut

BLOCKS = """SELECT source AS report_id, CAST(floor(doc_id / 4) AS BIGINT) AS page, doc_id AS ord, concat('s', CAST(doc_id AS STRING)) AS section_id, CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' WHEN 2 THEN 'stat' WHEN 3 THEN 'chart' ELSE 'paragraph' END AS kind, doc_id % 21 = 1 AS from_table, n_chars % 60 AS n_words,
    CAST(50 AS DOUBLE) AS x0, CAST(50 AS DOUBLE) AS y0, CAST(50 + n_chars % 500 AS DOUBLE) AS x1, CAST(400 AS DOUBLE) AS y1, substr(text, 1, 60) AS text FROM {documents}"""


@query("e1_page_roles", f"""
    WITH p AS (SELECT report_id, page, bool_or(kind = 'table' OR from_table) AS tb, bool_or(kind = 'table') AS t, COALESCE(sum((x1 - x0) * (y1 - y0)) FILTER (WHERE kind = 'chart'), 0) AS area, count(*) FILTER (WHERE kind = 'chart') AS c, COALESCE(sum(n_words) FILTER (WHERE kind = 'paragraph'), 0) AS w, count(*) FILTER (WHERE kind = 'paragraph') AS np FROM ({BLOCKS}) GROUP BY ALL),
    r AS (SELECT *, NOT tb AND w < 300 AND (area / (600 * 800) >= 0.4 OR (c >= 5 AND area / (600 * 800) >= 0.2) OR (c >= 3 AND CASE WHEN np > 0 THEN w / np ELSE 0 END < 14)) AS led, w < 40 AND NOT t AND c = 0 AS sparse FROM p)
    SELECT report_id, page, led AS design_led, sparse, led OR sparse AS shown_whole, page = 1 AND w < 40 AND NOT tb AS cover FROM r""")
def e1(t):
    blocks = t.sql(BLOCKS)
    return op.page_roles(blocks, blocks.select("report_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)}))


CONTENTS = """SELECT report_id, concat('t', CAST(page AS STRING)) AS table_id, row_number() OVER (PARTITION BY report_id, page ORDER BY row_no) AS row_no, heading AS label, CASE WHEN page % 5 = 0 THEN 100 - row_no ELSE page END AS page_no, 1 AS n_cols, 100000 AS page_count
    FROM (SELECT 'r1' AS report_id, CAST(floor(ord / 6) AS BIGINT) AS page, ord AS row_no, heading FROM fx_sections) x"""


@query("e2_contents_tables", None)
def e2(t):
    sections = t("fx_sections").select(F.lit("r1").alias("report_id"), F.floor(F.col("ord") / 6).alias("page"), "ord", "heading", F.col("section_id").alias("slug"))
    return op.contents_tables(t.sql(CONTENTS), sections)


OUTLINE = "SELECT o_custkey % 20 AS report_id, o_orderkey AS bookmark_no, concat('Part ', CAST(o_orderkey AS STRING)) AS title, CAST(floor(o_orderkey / 20) AS BIGINT) AS page FROM {orders} WHERE o_orderkey % 3 = 0"
OSECT = "SELECT o_custkey % 20 AS report_id, o_orderkey AS ord, concat('s', CAST(o_orderkey AS STRING)) AS section_id, concat('s', CAST(o_orderkey AS STRING)) AS slug, CAST(floor(o_orderkey / 15) AS BIGINT) AS page FROM {orders} WHERE o_orderkey % 2 = 0"


@query("e3_outline_sections", f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY bookmark_no) AS i FROM ({OUTLINE})), s AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page, ord) AS place FROM ({OSECT})),
    f AS (SELECT o.report_id, o.bookmark_no, o.title, o.i, min(s.place) AS p FROM o JOIN s ON s.report_id = o.report_id AND s.page >= o.page GROUP BY ALL),
    r AS (SELECT report_id, bookmark_no, title, i, p AS place FROM f WHERE i = 1 UNION ALL SELECT f.report_id, f.bookmark_no, f.title, f.i, greatest(f.p, r.place + 1) FROM r JOIN f ON f.report_id = r.report_id AND f.i = r.i + 1)
    SELECT r.report_id, r.bookmark_no, r.title, s.section_id, s.ord FROM r JOIN s ON s.report_id = r.report_id AND s.place = r.place""")
def e3(t):
    return op.outline_sections(t.sql(OUTLINE), t.sql(OSECT))


def _starts(t):
    sections = t("fx_sections").withColumn("size", F.when(F.col("ord") % 3 == 0, 20.0).otherwise(12.0))
    heads = op.heading_starts(sections)
    outline = sections.filter("report_id = 'src1' AND ord % 2 = 0").select("report_id", "section_id", F.lit("Chapter 001 Overview").alias("title"))
    return sections, op.chapter_starts(sections, {"outline": outline, "headings": heads})


@query("e4_chapter_starts", None)
def e4(t):
    return _starts(t)[1]


CSEC = "SELECT source AS report_id, doc_id AS ord, concat('s', CAST(doc_id AS STRING)) AS section_id, n_chars % 3 = 0 AS shows, n_chars % 4 = 0 AS starts FROM {documents}"


@query("e5_assign_chapters", f"""
    WITH s AS ({CSEC}), f AS (SELECT report_id, min(ord) AS f0 FROM s WHERE starts GROUP BY ALL),
    c AS (SELECT s.*, COALESCE(last_value(CASE WHEN starts THEN ord END IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY ord), f.f0) AS ch FROM s JOIN f USING (report_id)),
    k AS (SELECT report_id, ch, CASE WHEN bool_or(shows) THEN ch END AS me FROM c GROUP BY report_id, ch),
    h AS (SELECT report_id, ch, COALESCE(first_value(me IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY ch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(me IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY ch)) AS home FROM k)
    SELECT report_id, section_id, ord, home AS chapter_start FROM c JOIN h USING (report_id, ch) WHERE home IS NOT NULL""")
def e5(t):
    sections = t.sql(CSEC)
    return op.assign_chapters(sections.drop("starts"), sections.filter("starts").select("report_id", "section_id", "ord"))


@query("e6_page_map", f"""
    WITH h AS (SELECT report_id, page, arg_min(section_id, ord) AS own, arg_min(heading, ord) AS oh, arg_max(section_id, ord) AS ls, arg_max(heading, ord) AS lh FROM fx_sections WHERE heading <> '' GROUP BY ALL),
    p AS (SELECT DISTINCT report_id, page FROM fx_sections),
    j AS (SELECT p.report_id, p.page, own, oh, CASE WHEN p.page % 9 = 0 THEN 'left_out' WHEN p.page = 1 THEN 'cover' WHEN p.page % 7 = 0 THEN 'picture' WHEN p.page % 4 <> 3 THEN 'text' ELSE 'none' END AS shown,
        last_value({{'s': ls, 'h': lh, 'p': h.page}} IGNORE NULLS) OVER (PARTITION BY p.report_id ORDER BY p.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM p LEFT JOIN (SELECT * FROM h) h ON h.report_id = p.report_id AND h.page = p.page)
    SELECT report_id, page, shown, own IS NOT NULL AND shown NOT IN ('left_out', 'none') AS own_section, COALESCE(own, u.s) AS section_id, COALESCE(oh, u.h) AS heading FROM j""".replace("last_value({'s': ls, 'h': lh, 'p': h.page} IGNORE NULLS)", "last_value(CASE WHEN ls IS NOT NULL THEN {'s': ls, 'h': lh, 'p': h.page} END IGNORE NULLS)"))
def e6(t):
    sections = t("fx_sections")
    pages = sections.select("report_id", "page").distinct().withColumn("title", F.lit(None).cast("string"))
    facts = pages.select("report_id", "page", (F.col("page") % 9 == 0).alias("left_out"), (F.col("page") == 1).alias("cover"), F.lit(False).alias("rearranged"), (F.col("page") % 7 == 0).alias("drawn"), (F.col("page") % 4 != 3).alias("has_text"))
    chapters = sections.select("report_id", "section_id", F.lit(0).alias("chapter_start"))
    return op.page_map(pages, sections, facts, chapters).select("report_id", "page", "shown", "own_section", "section_id", "heading")


@query("e7_table_bars", """
    WITH v AS (SELECT report_id, table_id, label, col_no, CAST(raw AS DOUBLE) AS v, dense_rank() OVER (PARTITION BY report_id, table_id ORDER BY label) AS row_no FROM fx_change_cells WHERE col_no < 3), n AS (SELECT report_id, table_id, max(row_no) AS n, max(abs(v)) AS top FROM v GROUP BY ALL)
    SELECT report_id, table_id, label, col_no AS series, round_even(100 * abs(v) / top, 2) AS width, v < 0 AS negative FROM v JOIN n USING (report_id, table_id) WHERE n >= 3""")
def e7(t):
    cells = t("fx_change_cells").filter("col_no < 3").withColumns({"value": F.col("raw").cast("decimal(18,2)"), "unit": F.lit("crore"), "row_no": F.ascii("label") * 100000 + F.ascii(F.substring("label", 2, 1)) * 300 + F.length("label")})
    columns = cells.select("report_id", "table_id", "col_no").distinct().withColumns({"period_type": F.lit("quarter"), "fiscal_year": F.substring("report_id", 2, 4).cast("int") + 1 - F.col("col_no"), "change": F.lit(None).cast("string")})
    return op.table_bars(cells, columns).select("report_id", "table_id", "label", "series", "width", "negative")


@query("e8_landing_parts", f"""
    WITH b AS ({BLOCKS}), s AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY page, ord) AS n FROM b WHERE kind = 'stat'),
    h AS (SELECT b.*, row_number() OVER (PARTITION BY b.report_id ORDER BY b.page, b.ord) AS n FROM b JOIN fx_sections x ON x.report_id = b.report_id AND x.section_id = b.section_id WHERE b.kind = 'paragraph' AND {duck.section_type('x.heading')} = 'highlights' AND trim(b.text) <> '')
    SELECT report_id, 'stat' AS part, n AS pos, text FROM s WHERE n <= 8 UNION ALL SELECT report_id, 'highlight', n, text FROM h WHERE n <= 8 UNION ALL SELECT report_id, 'toc', ord, heading FROM fx_sections WHERE heading <> ''""")
def e8(t):
    return op.landing_parts(t.sql(BLOCKS), classify_sections(t("fx_sections")))


RUNS = "SELECT report_id, page AS section_id, line_no AS block_ord, word_no AS run_no, CASE WHEN regexp_replace(text, '[0-9]', '') <> text THEN NULL ELSE concat(text, ' ') END AS text, CASE WHEN regexp_replace(text, '[0-9]', '') <> text THEN 'f' END AS run_fid FROM fx_words"


@query("e9_section_excerpts", f"""
    WITH r AS ({RUNS}), c AS (SELECT *, min(CASE WHEN run_fid IS NOT NULL THEN run_no END) OVER (PARTITION BY report_id, section_id, block_ord) AS cut FROM r),
    b AS (SELECT report_id, section_id, block_ord, regexp_replace(trim(regexp_replace(string_agg(text, '' ORDER BY run_no), '\\s+', ' ', 'g')), '^[ ,;:]+|[ ,;:]+$', '', 'g') AS x FROM c WHERE run_fid IS NULL AND (cut IS NULL OR run_no < cut) GROUP BY ALL),
    k AS (SELECT report_id, section_id, arg_min(x, block_ord) AS x FROM (SELECT * REPLACE (regexp_replace(x, '([a-z])- ([a-z])', '\\1-\\2', 'g') AS x) FROM b) WHERE length(x) >= 40 AND NOT regexp_matches(x, '[0-9]') GROUP BY ALL)
    SELECT report_id, section_id, CASE WHEN length(x) <= 155 THEN x ELSE regexp_replace(left(x, 155), ' [^ ]*$', '') || '…' END AS excerpt FROM k""")
def e9(t):
    return op.section_excerpts(t.sql(RUNS))


FAQ = "SELECT source AS report_id, concat('s', CAST(doc_id AS STRING)) AS section_id, CASE WHEN doc_id % 3 = 0 THEN concat('Q', CAST(doc_id % 90 AS STRING), '. What changed ', lang) WHEN doc_id % 7 = 0 THEN '(b) And now' ELSE 'Plain' END AS heading FROM {documents}"


@query("e10_faq_reports", f"""
    WITH q AS (SELECT *, regexp_extract(heading, '^\\s*(Q\\s?[0-9]{{1,3}}|\\([a-z]\\))[ .:)–-]*(.*)$', ['m', 'q']) AS z FROM ({FAQ})), p AS (SELECT report_id, section_id, z.m AS marker, trim(z.q) AS question FROM q WHERE z.m <> '' AND trim(z.q) <> '')
    SELECT p.*, count(*) OVER (PARTITION BY report_id) AS questions FROM p QUALIFY count(*) OVER (PARTITION BY report_id) >= 3""")
def e10(t):
    return op.faq_reports(t.sql(FAQ))


LINKS = "SELECT o_orderkey AS block_id, concat('See https://www.example.com/q', CASE WHEN o_orderkey % 3 = 0 THEN '- 2026/results.html, now' WHEN o_orderkey % 3 = 1 THEN '_a).' ELSE '/x- and more' END, ' or www.site', CAST(o_custkey AS STRING), '.org.') AS text FROM {orders}"


@query("e11_printed_links", """
    SELECT o_orderkey AS block_id, 'https://www.example.com/q' || CASE WHEN o_orderkey % 3 = 0 THEN '-2026/results.html' WHEN o_orderkey % 3 = 1 THEN '_a' ELSE '/x-' END AS shown, 'https://www.example.com/q' || CASE WHEN o_orderkey % 3 = 0 THEN '-2026/results.html' WHEN o_orderkey % 3 = 1 THEN '_a' ELSE '/x-' END AS href FROM orders
    UNION ALL SELECT o_orderkey, 'www.site' || o_custkey || '.org', 'https://www.site' || o_custkey || '.org' FROM orders""")
def e11(t):
    return op.printed_links(t.sql(LINKS)).select("block_id", "shown", "href")


@query("e12_style_census", None)
def e12(t):
    return op.style_census(t("fx_html").withColumnRenamed("html", "css"))


@query("e12_colour_counts", """
    SELECT report_id, '#' || upper(CASE WHEN length(h) = 3 THEN h[1] || h[1] || h[2] || h[2] || h[3] || h[3] ELSE h END) AS colour, count(*) AS uses FROM (SELECT report_id, unnest(regexp_extract_all(html, '#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\\b', 1)) AS h FROM fx_html) GROUP BY ALL""")
def e12b(t):
    return op.colour_counts(t("fx_html").withColumnRenamed("html", "css")).select("report_id", "colour", "uses")


@query("e12_font_census", None)
def e12c(t):
    return op.font_census(t("fx_html").withColumnRenamed("html", "css"))


# ------------------------------------------------------------------ metadata votes

TOK = "tk AS (SELECT * FROM (SELECT report_id, page, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS pos, regexp_replace(regexp_replace(unnest(ws), '^[^\\p{L}\\p{N}&]+|[^\\p{L}\\p{N}&]+$', '', 'g'), '[''’]s$', '') AS token FROM (SELECT report_id, page, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM fx_texts)) WHERE token <> '')"
NOUNS = f"""{TOK}, nn AS (SELECT report_id, lower(token) AS word, count(*) FILTER (WHERE token <> lower(token) AND token <> upper(token)) AS title, count(*) FILTER (WHERE token = upper(token) AND token <> lower(token)) AS caps, count(*) FILTER (WHERE token = lower(token)) AS low, count(DISTINCT page) AS pages FROM tk GROUP BY ALL),
    nv AS (SELECT *, title > 0 AND low <= greatest(CASE WHEN title + caps >= 5 THEN 1 ELSE 0 END, 0.05 * (title + caps)) AS as_title, length(word) <= 5 AND caps > 0 AND low = 0 AS as_acronym FROM nn)"""


def _tokens(t):
    return cut(m.page_tokens(t("fx_texts")))


@query("m1_proper_nouns", f"WITH {NOUNS} SELECT * FROM nv")
def m1(t):
    return m.proper_nouns(m.page_tokens(t("fx_texts")))


@query("m2_legal_names", None)
def m2(t):
    return m.legal_names(t("fx_texts"))


# one step of the walk as a table of phrases, taken three times
@query("m3_name_extension", f"""
    WITH {NOUNS}, tl AS (SELECT report_id, page, pos, token, lead(token, 1) OVER w AS a1, lead(token, 2) OVER w AS a2, lead(token, 3) OVER w AS a3 FROM tk WINDOW w AS (PARTITION BY report_id, page ORDER BY pos)),
    gr AS (SELECT report_id, token AS phrase, a1 AS nx FROM tl UNION ALL SELECT report_id, token || ' ' || a1, a2 FROM tl WHERE a1 IS NOT NULL UNION ALL SELECT report_id, token || ' ' || a1 || ' ' || a2, a3 FROM tl WHERE a2 IS NOT NULL),
    us AS (SELECT report_id, phrase, CASE WHEN regexp_matches(nx, '^[A-Z][A-Za-z&-]+$') AND nx <> upper(nx) THEN nx END AS nx, count(*) AS k FROM gr GROUP BY ALL),
    st AS (SELECT report_id, phrase, phrase || ' ' || nx AS longer FROM (SELECT *, sum(k) OVER (PARTITION BY report_id, phrase) AS uses, row_number() OVER (PARTITION BY report_id, phrase ORDER BY nx IS NULL, k DESC, nx DESC) AS r FROM us) WHERE r = 1 AND nx IS NOT NULL AND k >= 0.6 * uses
        AND (report_id, lower(nx)) IN (SELECT (report_id, word) FROM nv WHERE as_title)),
    p AS (SELECT report_id, name, count(*) AS uses FROM (SELECT report_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][A-Za-z&]+)[''’]s\\b', 1)) AS name FROM fx_texts) GROUP BY ALL),
    n0 AS (SELECT p.report_id, name FROM p JOIN nv ON nv.report_id = p.report_id AND nv.word = lower(name) WHERE (as_title OR as_acronym) AND pages >= 2 AND (uses >= 2 OR pages >= 3)),
    n1 AS (SELECT n0.report_id, COALESCE(longer, name) AS name FROM n0 LEFT JOIN st ON st.report_id = n0.report_id AND st.phrase = name), n2 AS (SELECT n1.report_id, COALESCE(longer, name) AS name FROM n1 LEFT JOIN st ON st.report_id = n1.report_id AND st.phrase = name)
    SELECT n2.report_id, COALESCE(longer, name) AS name FROM n2 LEFT JOIN st ON st.report_id = n2.report_id AND st.phrase = name""")
def m3(t):
    tokens = _tokens(t)
    nouns = cut(m.proper_nouns(tokens))
    return m.name_extension(tokens, m.possessive_names(t("fx_texts"), nouns).select("report_id", "name"), nouns)


EDGE = "SELECT report_id, page, concat(CASE report_id % 5 WHEN 0 THEN 'Tata Motors' WHEN 1 THEN 'Infosys Digital' WHEN 2 THEN 'Nova Steel' WHEN 3 THEN 'Axis Bank' ELSE 'Hindalco Industries' END, ' | ', CAST(page AS STRING)) AS text FROM fx_texts"


@query("m4_running_names", None)
def m4(t):
    return m.running_names(t.sql(EDGE), m.proper_nouns(_tokens(t)), t("fx_texts").select("report_id", "page"))


@query("m5_ticker_names", None)
def m5(t):
    tokens = _tokens(t)
    return m.ticker_names(t("fx_texts"), tokens, m.proper_nouns(tokens))


@query("m6_possessive_names", f"""WITH {NOUNS}, p AS (SELECT report_id, name, count(*) AS uses FROM (SELECT report_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][A-Za-z&]+)[''’]s\\b', 1)) AS name FROM fx_texts) GROUP BY ALL)
    SELECT p.report_id, name, uses, pages FROM p JOIN nv ON nv.report_id = p.report_id AND nv.word = lower(name) WHERE (as_title OR as_acronym) AND pages >= 2 AND (uses >= 2 OR pages >= 3)""")
def m6(t):
    return m.possessive_names(t("fx_texts"), m.proper_nouns(_tokens(t)))


CANDS = "SELECT o_custkey % 300 AS report_id, CASE o_orderkey % 6 WHEN 0 THEN 'Tata Motors' WHEN 1 THEN 'Motors' WHEN 2 THEN 'Tata' WHEN 3 THEN 'Nova Steel' WHEN 4 THEN 'Quarterly Results' ELSE 'Axis' END AS name, CASE o_custkey % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'cover' WHEN 2 THEN 'possessive' ELSE 'ticker' END AS source, o_orderkey % 9 AS pages FROM {orders}"


@query("m7_pick_company", f"""
    WITH c AS (SELECT *, string_split(name, ' ')[1] AS f FROM ({CANDS}) WHERE name <> 'Quarterly Results'), n AS (SELECT report_id, name, f, max(pages) AS pages FROM c GROUP BY ALL),
    k AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.report_id = a.report_id AND b.name <> a.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ') AND NOT b.name LIKE a.name || ' %')),
    v AS (SELECT report_id, f, CAST(sum(w) AS BIGINT) AS score, max(w) AS st FROM (SELECT DISTINCT report_id, f, source, CASE source WHEN 'header' THEN 3 WHEN 'ticker' THEN 3 WHEN 'cover' THEN 2 ELSE 1 END AS w FROM c) GROUP BY ALL)
    SELECT report_id, name, score, pages FROM k JOIN v USING (report_id, f) QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY score DESC, st DESC, pages DESC, name DESC) = 1""")
def m7(t):
    return m.pick_company(t.sql(CANDS))


@query("m8_filename_names", None)
def m8(t):
    files = t("fx_texts").select("report_id").distinct().withColumn("filename", F.element_at(F.array(*[F.lit(x) for x in ("TataMotors_Q2.pdf", "Infosys_Digital_2025.pdf", "nova-steel.pdf", "draft.pdf", "Hindalco_v2.pdf")]), (F.col("report_id") % 5 + 1).cast("int")))
    tokens = _tokens(t)
    return m.filename_names(files, tokens, m.proper_nouns(tokens))


_CURS = [("INR", "₹|\\bRs\\.?\\s|\\bINR\\b|(?i:\\b(?:crores?|lakhs?|lacs?)\\b)"), ("USD", "US\\$|\\bUSD\\b|\\$\\s?[0-9]"), ("EUR", "€|\\bEUR\\b"), ("GBP", "£|\\bGBP\\b")]
CURV = f"""cv AS (SELECT report_id, currency, n, ru, CASE WHEN n >= 3 AND n >= 2 * ru THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, lead(n) OVER w AS ru, row_number() OVER w AS k FROM (
      {' UNION ALL '.join(f"SELECT report_id, '{c}' AS currency, {i} AS i, CAST(sum(len(regexp_extract_all(text, '{rx}'))) AS BIGINT) AS n FROM fx_texts GROUP BY report_id" for i, (c, rx) in enumerate(_CURS))}) WINDOW w AS (PARTITION BY report_id ORDER BY n DESC, i)) WHERE k = 1 AND n > 0)"""


@query("m9_vote_currency", f"WITH {CURV} SELECT report_id, currency, n, confidence FROM cv")
def m9(t):
    return m.vote_currency(t("fx_texts"))


@query("m10_vote_unit", f"""
    WITH {CURV}, t AS (SELECT f.report_id, CASE WHEN lower(u) IN ('crore') THEN 'crore' WHEN lower(u) = 'lakhs' THEN 'lakh' WHEN lower(u) = 'million' THEN 'million' ELSE 'billion' END AS unit, CASE WHEN mk IN ('₹', 'Rs.', 'Rs') THEN 'INR' ELSE 'USD' END AS cur
        FROM (SELECT report_id, unnest(list_concat(regexp_extract_all(text, '(₹|Rs\\.?|US\\$|\\$)\\s*(?:in\\s+)?(crore|lakhs|million|Billion)\\b', 1), regexp_extract_all(text, '(₹|Rs\\.?|US\\$|\\$)\\s?[0-9][0-9,.]*\\s?(crore|lakhs|million|Billion)\\b', 1))) AS mk,
                     unnest(list_concat(regexp_extract_all(text, '(₹|Rs\\.?|US\\$|\\$)\\s*(?:in\\s+)?(crore|lakhs|million|Billion)\\b', 2), regexp_extract_all(text, '(₹|Rs\\.?|US\\$|\\$)\\s?[0-9][0-9,.]*\\s?(crore|lakhs|million|Billion)\\b', 2))) AS u FROM fx_texts) f),
    n AS (SELECT t.report_id, unit, count(*) AS n FROM t JOIN cv ON cv.report_id = t.report_id AND cv.currency = t.cur GROUP BY ALL),
    r AS (SELECT *, lead(n) OVER w AS ru, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY report_id ORDER BY n DESC, unit DESC))
    SELECT report_id, unit, CASE WHEN n >= 2 AND n >= 2 * COALESCE(ru, 0) THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE k = 1""")
def m10(t):
    return m.vote_unit(t("fx_texts"), m.vote_currency(t("fx_texts")))


@query("m11_vote_fiscal_start", f"""WITH {CURV} SELECT r.report_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM fx_texts x WHERE x.report_id = r.report_id AND contains(x.text, 'year ended March 31')) THEN 4 WHEN cv.currency = 'INR' THEN 4 ELSE 1 END AS INT) AS start_month
    FROM (SELECT DISTINCT report_id FROM fx_texts) r LEFT JOIN cv USING (report_id)""")
def m11(t):
    return m.vote_fiscal_start(t("fx_texts"), m.vote_currency(t("fx_texts")))


@query("m12_vote_period", None)
def m12(t):
    texts = cut(t("fx_texts"))
    ended = cut(m.ended_spans(texts))
    return m.vote_period(texts, cut(m.vote_fiscal_start(texts, m.vote_currency(texts), ended)), ended)


@query("m13_report_type", """
    SELECT page, CASE WHEN contains(text, 'Annual Report') THEN 'annual_report' WHEN contains(text, 'Quarterly Results') THEN 'quarterly_results' WHEN page % 4 = 0 THEN 'investor_presentation' WHEN regexp_matches(text, '(?i)\\bQ[1-4] FY[0-9]{2}') THEN 'quarterly_results' WHEN regexp_matches(lower(text), 'results|quarter ended') THEN 'quarterly_results' END AS report_type FROM fx_texts""")
def m13(t):
    r = t("fx_texts").select("page", F.col("text").alias("first_page"), "text", F.col("text").alias("title"), F.lit("").alias("furniture"), (F.col("page") % 4 == 0).alias("landscape"))
    return m.report_type(r).select("page", "report_type")


# ------------------------------------------------------------------ scoring

TRUTH = "SELECT report_id AS file, page * 100000 + line_no * 1000 + word_no AS truth_no, page, CASE WHEN word_no % 7 = 0 THEN concat('x', raw, 'y') ELSE raw END AS raw, CASE WHEN word_no % 2 = 0 THEN 'cell' ELSE 'text' END AS role, 'Sales' AS row_label, 'FY25' AS col_label, x0 + CAST(1 AS DOUBLE) AS x0, y0, x1, y1 FROM fx_figs"
FOUND = "SELECT report_id AS file, page, fid, CASE WHEN word_no % 5 = 0 THEN concat(raw, '0') ELSE raw END AS raw, CASE WHEN word_no % 3 = 0 THEN 'sales' ELSE 'Other' END AS row_label, 'fy25' AS col_label, x0, y0, x1, y1 FROM fx_figs WHERE word_no % 11 <> 3"
MATCH = f"""tr AS ({TRUTH}), fo AS ({FOUND}), tc AS (SELECT *, {duck.core('raw')} AS t_raw FROM tr),
    mt AS (SELECT tc.file, tc.truth_no, tc.page, tc.t_raw, tc.role, arg_min(fo.fid, (abs(length(fo.raw) - length(t_raw)), fo.fid)) AS fid, arg_min(fo.raw, (abs(length(fo.raw) - length(t_raw)), fo.fid)) AS f_raw, arg_min(fo.row_label, (abs(length(fo.raw) - length(t_raw)), fo.fid)) AS row_label
      FROM tc LEFT JOIN fo ON fo.file = tc.file AND fo.page = tc.page AND (contains(fo.raw, t_raw) OR contains(t_raw, fo.raw)) AND (((fo.x0 + fo.x1) / 2 BETWEEN tc.x0 - 3 AND tc.x1 + 3 AND (fo.y0 + fo.y1) / 2 BETWEEN tc.y0 - 3 AND tc.y1 + 3) OR ((tc.x0 + tc.x1) / 2 BETWEEN fo.x0 - 3 AND fo.x1 + 3 AND (tc.y0 + tc.y1) / 2 BETWEEN fo.y0 - 3 AND fo.y1 + 3)) GROUP BY ALL)"""


def _match(t):
    return acc.match_truth(t.sql(TRUTH), t.sql(FOUND))


@query("q1_match_truth", f"WITH {MATCH} SELECT file, truth_no, page, t_raw, fid, f_raw FROM mt")
def q1(t):
    return _match(t).select("file", "truth_no", "page", "t_raw", "fid", "f_raw")


@query("q2_accuracy_scores", f"""WITH {MATCH}, p AS (SELECT file, count(*) AS truth, count(fid) AS found, count(*) FILTER (WHERE t_raw = f_raw OR list_contains(string_split(f_raw, ' '), t_raw)) AS ex, count(*) FILTER (WHERE fid IS NOT NULL AND role = 'cell') AS cells, count(*) FILTER (WHERE fid IS NOT NULL AND role = 'cell' AND row_label = 'sales') AS ok FROM mt GROUP BY ALL),
    x AS (SELECT file, count(*) AS extracted, count(*) FILTER (WHERE (file, fid) IN (SELECT (file, fid) FROM mt WHERE fid IS NOT NULL)) AS hits FROM fo GROUP BY ALL)
    SELECT file, truth, extracted, round_even(found / truth, 6) AS recall, CASE WHEN found > 0 THEN round_even(ex / found, 6) END AS exact, CASE WHEN cells > 0 THEN round_even(ok / cells, 6) END AS labels, CASE WHEN extracted > 0 THEN round_even(hits / extracted, 6) END AS precision FROM p LEFT JOIN x USING (file)""")
def q2(t):
    return acc.accuracy_scores(_match(t), t.sql(FOUND))


@query("q2_missed", f"WITH {MATCH} SELECT file, truth_no, page, t_raw, role FROM mt WHERE fid IS NULL")
def q2b(t):
    return acc.missed(_match(t))


DETECTED = "SELECT c_custkey AS file, CASE WHEN c_custkey % 3 = 0 THEN 'Acme  Ltd.' ELSE c_name END AS company, CAST(2020 + c_custkey % 3 AS STRING) AS year, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'q2' END AS period, 'quarterly_results' AS type, CASE WHEN c_custkey % 5 = 0 THEN 'USD' ELSE 'INR' END AS currency, 'crore' AS unit FROM {customer}"


@query("q3_metadata_accuracy", f"""
    WITH d AS ({DETECTED}) SELECT file, f.field, CASE f.field WHEN 'company' THEN company WHEN 'year' THEN year WHEN 'period' THEN period ELSE currency END AS got,
      CASE f.field WHEN 'company' THEN company = 'Acme  Ltd.' WHEN 'year' THEN year IN ('2020','2021') WHEN 'period' THEN TRUE ELSE currency = 'INR' END AS ok FROM d, (VALUES ('company'), ('year'), ('period'), ('currency')) AS f(field)""")
def q3(t):
    d = t.sql(DETECTED)
    want = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(x) for x in v]).alias("accepted")) for f, v in (("company", ["ACME Limited"]), ("year", ["2020", "2021"]), ("period", ["*"]), ("currency", ["INR"]))])
    return acc.metadata_accuracy(d, d.select("file", F.explode(want).alias("w")).select("file", "w.*"))
