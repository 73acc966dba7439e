"""W1–W26 over word boxes laid out from documents, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import figures as fig
from figtrail.operators import layout as lay
from figtrail.operators import sections as sec
from figtrail.operators import tables as tab
from figtrail.plans import duck
from figtrail.plans.registry import query
from figtrail.session import cut

P = "PARTITION BY report_id, page"


def lines_sql(src: str) -> str:
    return f"""SELECT * EXCLUDE (nw), sum(nw) OVER ({P} ORDER BY yc, x0, word_no) AS line FROM (
      SELECT *, CASE WHEN COALESCE(yc - lag(yc) OVER w > 0.45 * least(h, lag(h) OVER w), TRUE) THEN 1 ELSE 0 END AS nw FROM (SELECT *, (y0 + y1) / 2 AS yc, y1 - y0 AS h FROM {src}) WINDOW w AS ({P} ORDER BY yc, x0, word_no))"""


def cellish(source: str, col: str = "text", out: str = "is_numeric") -> str:
    inner = duck.number(f"SELECT *, regexp_replace({duck.trim(col)}, '[*#^]+$', '') AS cb FROM ({source})", col, "q_")
    inner = duck.number(inner, "cb", "r_")
    drop = ", ".join(f"{p}{f}" for p in ("q_", "r_") for f in ("kind", "value", "value_str", "scale", "grouping", "currency_symbol", "negative"))
    return f"""SELECT * EXCLUDE ({drop}, cb), (q_kind IS NOT NULL OR (cb <> {duck.trim(col)} AND r_kind IS NOT NULL)
      OR (regexp_matches({duck.trim(col)}, '^[(\\-−–]?[₹$€£]?\\d[\\d,.\\-–]*\\)?\\s?%?[*#^]?$') AND length(regexp_replace({col}, '\\D', '', 'g')) >= 2)) AS {out} FROM ({inner})"""


def segmented_sql(src: str) -> str:
    return f"""SELECT * EXCLUDE (ct), sum(ct) OVER (PARTITION BY report_id, page, line ORDER BY x0, word_no) AS segment FROM (
      SELECT *, CASE WHEN COALESCE(x0 - lag(x1) OVER w > greatest(14, 2.2 * med_h) OR (x0 - lag(x1) OVER w > 4 AND nu AND lag(nu) OVER w), TRUE) THEN 1 ELSE 0 END AS ct
      FROM (SELECT *, median(y1 - y0) OVER ({P}) AS med_h FROM ({cellish(lines_sql(src), 'text', 'nu')})) WINDOW w AS (PARTITION BY report_id, page, line ORDER BY x0, word_no))"""


def segs_sql(src: str) -> str:
    return cellish(f"""SELECT report_id, page, line, segment, string_agg(text, ' ' ORDER BY x0, word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words, min(conf) AS conf, max(med_h) AS med_h
      FROM ({segmented_sql(src)}) GROUP BY report_id, page, line, segment""")


def _segs(t, src="fx_grid"):
    return lay.segments_of(t(src))


def tokens_sql(source: str, run: str, order: str, cell: str = "FALSE") -> str:
    """CTEs ending in ``tok``: spans of up to four words read one by one, then a walk from start to start."""
    part = f"PARTITION BY report_id, page, {run}"
    words = " UNION ALL ".join(f"SELECT report_id, page, run, ord, {n} AS span, cell, prev, n{n} AS nxt, {' || '.join(chr(39) + ' ' + chr(39) + f' || w{i}' if i else 'w0' for i in range(n))} AS rw FROM od WHERE ord + {n - 1} <= words" for n in (1, 2, 3, 4))
    read = duck.period(duck.date(duck.number("SELECT * FROM sp", "raw", "n_"), "raw", "d_"), "raw", "p_", columns_too=False)
    return f"""od AS (SELECT report_id, page, {run} AS run, {cell} AS cell, row_number() OVER w AS ord, count(*) OVER ({part}) AS words, lag(text) OVER w AS prev, text AS w0,
        {', '.join(f'lead(text, {i}) OVER w AS w{i}, lead(text, {i}) OVER w AS n{i}' for i in (1, 2, 3, 4))} FROM ({source}) WINDOW w AS ({part} ORDER BY {order})),
    sp AS MATERIALIZED (SELECT *, {duck.core('rw')} AS raw FROM ({words}) WHERE regexp_matches(rw, '[0-9]') OR (cell AND span = 1)),
    rd AS (SELECT *, CASE WHEN span > 1 THEN CASE WHEN n_kind IS NULL AND p_type IS NOT NULL THEN 'period' WHEN n_kind IS NULL AND d_iso IS NOT NULL THEN 'date' WHEN n_kind <> 'nil' AND contains(raw, ' ') THEN n_kind END
        ELSE CASE WHEN d_iso IS NOT NULL AND (n_kind IS NULL OR d_precision = 'day') THEN 'date' WHEN n_kind IS NOT NULL THEN CASE WHEN n_kind <> 'nil' OR cell THEN n_kind END
             WHEN p_type IS NOT NULL THEN 'period' WHEN regexp_matches(raw, '[0-9]') THEN 'identifier' END END AS kind FROM ({read})),
    bs AS MATERIALIZED (SELECT * FROM rd WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, page, run, ord ORDER BY span DESC) = 1),
    jp AS MATERIALIZED (SELECT a.report_id, a.page, a.run, a.ord, min(b.ord) AS nx, row_number() OVER (PARTITION BY a.report_id, a.page, a.run ORDER BY a.ord) AS k
        FROM bs a LEFT JOIN bs b ON a.report_id = b.report_id AND a.page = b.page AND a.run = b.run AND b.ord >= a.ord + a.span AND b.ord < a.ord + a.span + 400 GROUP BY a.report_id, a.page, a.run, a.ord),
    wk AS (SELECT report_id, page, run, ord, nx FROM jp WHERE k = 1 UNION ALL SELECT jp.report_id, jp.page, jp.run, jp.ord, jp.nx FROM wk JOIN jp ON jp.report_id = wk.report_id AND jp.page = wk.page AND jp.run = wk.run AND jp.ord = wk.nx),
    tok AS MATERIALIZED (SELECT bs.report_id, bs.page, bs.run, bs.ord, span, raw, kind, n_value_str AS value_str, CASE kind WHEN 'date' THEN d_iso WHEN 'period' THEN p_end_date END AS iso, CASE WHEN kind = 'date' THEN d_precision END AS precision, CASE WHEN kind = 'date' THEN d_ambiguous END AS ambiguous,
        CASE WHEN kind = 'period' THEN p_key END AS period_key, n_currency_symbol AS currency_symbol, CASE WHEN kind = 'number' AND trim(prev, '()') IN ('₹', 'Rs', 'Rs.', 'INR', 'USD', 'US$', '$', '€', '£', 'EUR', 'GBP') THEN ltrim(rtrim(prev, '('), '(') END AS currency_hint,
        CASE WHEN kind = 'number' THEN CASE trim(lower(nxt), ',.;:)') WHEN 'crore' THEN 'crore' WHEN 'crores' THEN 'crore' WHEN 'cr' THEN 'crore' WHEN 'lakh' THEN 'lakh' WHEN 'lakhs' THEN 'lakh' WHEN 'lac' THEN 'lakh' WHEN 'lacs' THEN 'lakh' WHEN 'million' THEN 'million' WHEN 'mn' THEN 'million'
          WHEN 'billion' THEN 'billion' WHEN 'bn' THEN 'billion' WHEN 'thousand' THEN 'thousand' END END AS unit_hint
        FROM bs JOIN wk ON bs.report_id = wk.report_id AND bs.page = wk.page AND bs.run = wk.run AND bs.ord = wk.ord)"""


TOKEN_COLS = "ord, span, raw, kind, value_str, iso, precision, ambiguous, period_key, currency_symbol, currency_hint, unit_hint"


@query("w1_figure_tokens", f"WITH RECURSIVE ln AS ({lines_sql('fx_words')}), {tokens_sql('SELECT * FROM ln', 'line', 'x0, word_no')} SELECT report_id, page, run AS line, {TOKEN_COLS} FROM tok")
def w1(t):
    return lay.figure_tokens(lay.visual_lines(t("fx_words")))


@query("w2_visual_lines", f"SELECT report_id, page, row_no, word_no, CAST(line AS BIGINT) AS line FROM ({lines_sql('fx_grid')})")
def w2(t):
    return lay.visual_lines(t("fx_grid")).select("report_id", "page", "row_no", "word_no", "line")


@query("w3_line_segments", f"SELECT report_id, page, CAST(line AS BIGINT) AS line, CAST(segment AS BIGINT) AS segment, text, x0, x1, n_words, is_numeric FROM ({segs_sql('fx_grid')})")
def w3(t):
    return _segs(t).select("report_id", "page", "line", "segment", "text", "x0", "x1", "n_words", "is_numeric")


@query("w4_running_lines", f"""
    WITH b AS (SELECT m.* FROM fx_margin m JOIN fx_grid_pages p USING (report_id, page) WHERE y1 < height * 0.075 OR y0 > height * 0.925), l AS ({lines_sql('b')}),
    t AS (SELECT report_id, page, line, string_agg(text, ' ' ORDER BY x0, word_no) AS text, regexp_replace(lower(string_agg(text, ' ' ORDER BY x0, word_no)), '[^a-z]', '', 'g') AS sig FROM l GROUP BY ALL),
    c AS (SELECT report_id, sig, count(DISTINCT page) AS n FROM t GROUP BY ALL), n AS (SELECT report_id, greatest(2, count(*) // 2) AS need, count(*) AS pages FROM fx_grid_pages GROUP BY ALL),
    s AS (SELECT a.report_id, a.sig, sum(b.n) AS support FROM c a JOIN c b ON a.report_id = b.report_id AND abs(length(a.sig) - length(b.sig)) <= 3 AND length(b.sig) >= 4 AND 1 - levenshtein(a.sig, b.sig)::DOUBLE / greatest(length(a.sig), length(b.sig)) >= 0.88 WHERE length(a.sig) >= 4 GROUP BY ALL)
    SELECT l.report_id, l.page, l.row_no, l.word_no, l.text FROM l JOIN t ON l.report_id = t.report_id AND l.page = t.page AND l.line = t.line
    WHERE regexp_matches(trim(t.text), '(?i)^(page\\s*)?[0-9]{{1,4}}(\\s*(of|/)\\s*[0-9]{{1,4}})?$') OR (t.report_id, t.sig) IN (SELECT (s.report_id, s.sig) FROM s JOIN n USING (report_id) WHERE pages >= 2 AND support >= need)""")
def w4(t):
    return lay.running_lines(t("fx_margin"), t("fx_grid_pages")).select("report_id", "page", "row_no", "word_no", "text")


@query("w5_page_number_words", """
    WITH c AS (SELECT m.report_id, m.page, m.row_no, m.word_no, CAST(text AS BIGINT) AS v FROM fx_margin m JOIN fx_grid_pages p USING (report_id, page) WHERE regexp_matches(text, '^\\d{1,4}$') AND CAST(text AS BIGINT) BETWEEN 1 AND 3000
        AND (y1 <= height * 0.12 OR y0 >= height * 0.88 OR x1 <= width * 0.1 OR x0 >= width * 0.9)),
    k AS (SELECT *, 1 AS slope, v - page // 25 AS off FROM c UNION ALL SELECT *, 2, v - 2 * (page // 25) FROM c UNION ALL SELECT *, 2, v - 2 * (page // 25) - 1 FROM c),
    g AS (SELECT report_id, slope, off, count(DISTINCT page) AS n FROM k GROUP BY ALL), t AS (SELECT report_id, count(*) AS total FROM fx_grid_pages GROUP BY ALL)
    SELECT DISTINCT k.report_id, k.page, k.row_no, k.word_no, k.v FROM k JOIN g USING (report_id, slope, off) JOIN t USING (report_id)
    WHERE total >= 2 AND n >= CASE WHEN slope = 1 THEN CASE WHEN total <= 3 THEN total ELSE greatest(3, ceil(total * 3 / 10)) END ELSE greatest(3, CASE WHEN total <= 3 THEN total ELSE ceil(total * 3 / 10) END) END""")
def w5(t):
    pages = t("fx_grid_pages").withColumn("index", F.floor(F.col("page") / 25))
    return lay.page_number_words(t("fx_margin"), pages).select("report_id", "page", "row_no", "word_no", F.col("text").cast("bigint").alias("v"))


def _ticks(t):
    regions = t("fx_ticks").filter("page % 2 = 0").groupBy("report_id", "page").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    return lay.axis_tick_words(cut(t("fx_ticks")), regions)


@query("w6_axis_tick_words", None)
def w6(t):
    return _ticks(t).select("report_id", "page", "word_no")


def _logos(t):
    return t("fx_ticks").filter("word_no >= 20 AND page % 12 = 0").select("report_id", "page", "x0", "y0", "x1", "y1")


@query("w7_junk_words", None)
def w7(t):
    return lay.junk_words(t("fx_ticks"), _logos(t)).select("report_id", "page", "word_no", "text")


@query("w7_icon_font_words", "SELECT report_id, page, word_no, text FROM fx_ticks WHERE page % 7 = 0 AND regexp_matches(text, '[0-9]')")
def w7b(t):
    fonts = t("fx_ticks").withColumn("font", F.when(F.col("page") % 7 == 0, "ABCDEF+Wingdings-Regular").otherwise("Helvetica"))
    return lay.icon_font_words(fonts).select("report_id", "page", "word_no", "text")


@query("w8_noise_words", None)
def w8(t):
    return lay.noise_words({"axis_tick": _ticks(t), "ocr_noise": lay.junk_words(t("fx_ticks"), _logos(t))}, ["report_id", "page", "word_no"])


@query("w9_body_type_size", """
    SELECT report_id, median(size) FILTER (WHERE page % 3 <> 0 AND size > 0) AS body_size, median(round_even(y1 - y0, 2)) FILTER (WHERE page % 3 = 0) AS scan_height,
      COALESCE(median(size) FILTER (WHERE page % 3 <> 0 AND size > 0), median(round_even(y1 - y0, 2)) FILTER (WHERE page % 3 = 0), 0) AS title_size FROM fx_grid GROUP BY ALL""")
def w9(t):
    return lay.body_type_size(t("fx_grid").withColumn("method", F.when(F.col("page") % 3 == 0, "ocr").otherwise("text_layer")))


REGIONS = f"""sg AS MATERIALIZED ({segs_sql('fx_grid')}),
    hd AS ({duck.date(duck.period('SELECT * FROM sg', 'text', 'p_', columns_too=False), 'text', 'd_')}),
    rw AS (SELECT report_id, page, line, min(y0) AS y0, max(y1) AS y1, max(med_h) AS med_h, count(*) AS n_seg, count(*) FILTER (WHERE is_numeric) AS n_num, min(segment) FILTER (WHERE is_numeric) AS fn,
        max(segment) FILTER (WHERE NOT is_numeric AND n_words > 3) AS lw, bool_and(p_type IS NOT NULL OR d_iso IS NOT NULL OR regexp_matches(trim(text), '^(19|20)\\d\\d$')) AS oh FROM hd GROUP BY ALL),
    tr AS (SELECT *, n_num > 0 AND fn <= 2 AND COALESCE(lw, 0) < fn AS tb FROM rw),
    mb AS (SELECT *, COALESCE(y0 - lag(y1) OVER w <= 2.8 * med_h, FALSE) AS cl, COALESCE(tb, FALSE) OR COALESCE(n_seg = 1 AND n_num = 0 AND lag(tb) OVER w AND y0 - lag(y1) OVER w <= 2.8 * med_h AND lead(tb) OVER w AND lead(y0) OVER w - y1 < 2.8 * med_h, FALSE) AS mem
           FROM tr WINDOW w AS ({P} ORDER BY line)),
    st AS (SELECT *, CASE WHEN mem AND NOT (COALESCE(lag(mem) OVER w, FALSE) AND cl) THEN 1 ELSE 0 END AS s FROM mb WINDOW w AS ({P} ORDER BY line)),
    tn AS (SELECT *, sum(s) OVER ({P} ORDER BY line) AS table_no FROM st),
    bd AS (SELECT *, max(CASE WHEN oh THEN 0 ELSE 1 END) OVER (PARTITION BY report_id, page, table_no ORDER BY line) AS body FROM tn WHERE mem),
    rg AS MATERIALIZED (SELECT report_id, page, CAST(table_no AS BIGINT) AS table_no, line, y0, y1, n_num, med_h FROM bd WHERE body = 1 QUALIFY sum(CASE WHEN n_num > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY report_id, page, table_no) >= 2),
    ac AS (SELECT sg.*, rg.table_no FROM sg JOIN rg ON sg.report_id = rg.report_id AND sg.page = rg.page AND sg.line = rg.line WHERE is_numeric),
    ax AS (SELECT *, sum(nw) OVER (PARTITION BY report_id, page, table_no ORDER BY x1, line, segment) AS cu, count(*) OVER (PARTITION BY report_id, page, table_no) AS cells FROM (
        SELECT *, CASE WHEN COALESCE(x1 - lag(x1) OVER (PARTITION BY report_id, page, table_no ORDER BY x1, line, segment) > 7, TRUE) THEN 1 ELSE 0 END AS nw FROM ac)),
    an AS MATERIALIZED (SELECT *, COALESCE(min(gap) OVER (PARTITION BY report_id, page, table_no), 60) AS col_width FROM (SELECT *, row_number() OVER w AS col_no, anchor - lag(anchor) OVER w AS gap FROM (
        SELECT report_id, page, table_no, median(x1) AS anchor FROM ax GROUP BY report_id, page, table_no, cu, cells HAVING count(*) >= 2 OR cells < 6) WINDOW w AS (PARTITION BY report_id, page, table_no ORDER BY anchor))),
    ed AS (SELECT report_id, page, table_no, min(anchor) - 0.6 * max(col_width) AS le FROM an GROUP BY ALL),
    ht AS (SELECT s.report_id, s.page, a.table_no, s.line, s.segment, arg_min(col_no, (abs(s.x1 - anchor), col_no)) AS c FROM sg s JOIN rg ON s.report_id = rg.report_id AND s.page = rg.page AND s.line = rg.line JOIN an a ON a.report_id = rg.report_id AND a.page = rg.page AND a.table_no = rg.table_no
        WHERE s.x1 BETWEEN anchor - col_width - 4 AND anchor + 8 GROUP BY ALL),
    a1 AS (SELECT s.*, rg.table_no, CASE WHEN s.is_numeric OR s.x1 >= ed.le THEN ht.c END AS c FROM sg s JOIN rg ON s.report_id = rg.report_id AND s.page = rg.page AND s.line = rg.line JOIN ed ON ed.report_id = rg.report_id AND ed.page = rg.page AND ed.table_no = rg.table_no
        LEFT JOIN ht ON ht.report_id = s.report_id AND ht.page = s.page AND ht.table_no = rg.table_no AND ht.line = s.line AND ht.segment = s.segment),
    sc AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY report_id, page, table_no, line, c ORDER BY is_numeric DESC, segment) = 1 THEN c END AS col_no FROM a1)"""


@query("w10_column_anchors", f"WITH {REGIONS} SELECT report_id, page, table_no, CAST(col_no AS INT) AS col_no, anchor, col_width FROM an")
def w10(t):
    return tab.anchor_rows(tab.anchored_tables(_segs(t)))


@query("w11_assign_columns", f"WITH {REGIONS} SELECT report_id, page, table_no, CAST(line AS BIGINT) AS line, CAST(segment AS BIGINT) AS segment, text, CAST(col_no AS INT) AS col_no FROM sc")
def w11(t):
    return tab.segments_of_tables(tab.anchored_tables(_segs(t), "text")).select("report_id", "page", "table_no", "line", "segment", "text", "col_no")


@query("w12_table_regions", f"WITH {REGIONS} SELECT report_id, page, table_no, CAST(line AS BIGINT) AS line, n_num FROM rg")
def w12(t):
    return tab.table_regions(_segs(t)).select("report_id", "page", "table_no", "line", "n_num")


@query("w13_table_headers", None)
def w13(t):
    return tab.table_headers(_segs(t))


@query("w14_table_problems", f"""WITH {REGIONS},
    cn AS (SELECT report_id, page, table_no, count(*) AS ncols FROM an GROUP BY ALL),
    rr AS (SELECT report_id, page, table_no, line, count(col_no) AS filled, count(*) FILTER (WHERE is_numeric AND col_no IS NULL) AS loose FROM sc GROUP BY ALL),
    tt AS (SELECT report_id, page, table_no, max(ncols) AS ncols, count(*) AS nrows, CAST(sum(filled) AS BIGINT) AS filled, CAST(sum(loose) AS BIGINT) AS unplaced, count(*) FILTER (WHERE filled > 0) AS used, count(*) FILTER (WHERE filled > 0 AND filled <= greatest(1, ncols // 3)) AS thin FROM rr JOIN cn USING (report_id, page, table_no) GROUP BY ALL)
    SELECT report_id, page, table_no, ncols, nrows, filled, unplaced, array_to_string(list_filter([CASE WHEN unplaced > filled * 0.25 THEN 'unplaced' END, CASE WHEN ncols >= 2 AND nrows >= 2 AND 1 - filled::DOUBLE / (ncols * nrows) > 0.5 THEN 'empty' END,
      CASE WHEN ncols >= 3 AND used >= 3 AND thin >= 0.6 * used THEN 'scattered' END], lambda x: x IS NOT NULL), ',') AS problems FROM tt""")
def w14(t):
    df = tab.problems_of_tables(tab.segments_of_tables(tab.anchored_tables(_segs(t))))
    return df.select("report_id", "page", "table_no", "ncols", "nrows", "filled", "unplaced", F.array_join("problems", ",").alias("problems"))


@query("w15_kpi_pairs", """
    SELECT report_id, page, 'Tax' AS label, raw AS value FROM (SELECT o_orderkey % 25 AS report_id, o_orderkey AS page, c.raw FROM orders JOIN fx_cells c ON c.report_id = o_orderkey WHERE c.row_no = 1 AND c.col_no = 3)""")
def w15(t):
    return lay.kpi_pairs(_segs(t)).select("report_id", "page", "label", "value")


def _segs_and_body(t):
    words = cut(t("fx_grid"))
    # a row per report: stored, so that the planner knows how small it is and does not shuffle segments by report
    return lay.segments_of(words), cut(lay.body_type_size(words.withColumn("method", F.lit("text_layer"))))


@query("w16_headings", None)
def w16(t):
    return sec.headings(*_segs_and_body(t)).select("report_id", "page", "line", "segment", "text", "is_heading")


@query("w17_page_titles", None)
def w17(t):
    segs, body = _segs_and_body(t)
    text = F.when(F.col("line") == 1, F.concat("text", F.lit(" of "), F.translate(F.col("page").cast("string"), "0123456789", "abcdefghij"))).otherwise(F.col("text"))
    els = segs.withColumns({"element_id": F.col("line") * 100 + F.col("segment"), "n_lines": F.lit(1), "on_picture": F.lit(False), "text": text})
    return sec.page_titles(els, t("fx_grid_pages"), body)


ELS = """SELECT source AS report_id, CAST(floor(doc_id / 3) AS BIGINT) AS page, doc_id AS ord, CASE WHEN doc_id % 4 = 1 AND doc_id % 8 <> 1 THEN concat('Q', CAST(doc_id % 90 AS STRING), '. why') ELSE substr(text, 1, 20) END AS text, doc_id % 5 <> 0 AND n_chars % 2 = 0 AS is_heading FROM {documents}"""


@query("w18_assign_sections", f"""
    WITH e AS ({ELS}), f AS (SELECT *, CASE WHEN is_heading AND (NOT COALESCE(lag(is_heading) OVER w, FALSE) OR regexp_matches(text, '^(Q\\s?[0-9]{{1,3}}[.:)]|\\([a-z]\\)(\\s|$))')) THEN 1 ELSE 0 END AS fr FROM e WINDOW w AS ({P} ORDER BY ord)),
    g AS (SELECT *, sum(fr) OVER ({P} ORDER BY ord) AS run FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY report_id, page, run, is_heading ORDER BY ord) AS at_no FROM g),
    r AS (SELECT *, CASE WHEN is_heading THEN CASE WHEN at_no % 2 = 0 THEN 'subheading' ELSE 'heading' END ELSE 'content' END AS role FROM k)
    SELECT report_id, page, ord, role, last_value(CASE WHEN role = 'heading' THEN 's' || page || '_' || ord END IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY page, ord) AS section_id FROM r""")
def w18(t):
    return sec.assign_sections(t.sql(ELS)).select("report_id", "page", "ord", "role", "section_id")


@query("w19_reading_order", f"""
    SELECT report_id, page, row_no, word_no, CAST(row_number() OVER ({P} ORDER BY round_even(y0 / 6, 0), x0, row_no * 100 + word_no) AS INT) AS ord FROM fx_grid""")
def w19(t):
    return lay.reading_order(t("fx_grid").withColumn("element_id", F.col("row_no") * 100 + F.col("word_no"))).select("report_id", "page", "row_no", "word_no", "ord")


BOXES = "SELECT report_id, page, line_no AS region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) + 14 AS y1 FROM fx_words WHERE line_no % 3 = 0 GROUP BY report_id, page, line_no"


@query("w20_points_in_regions", f"""
    SELECT w.report_id, w.page, w.line_no, w.word_no, r.region_id FROM fx_words w JOIN ({BOXES}) r ON w.report_id = r.report_id AND w.page = r.page AND (w.x0 + w.x1) / 2 BETWEEN r.x0 - 2 AND r.x1 + 2 AND (w.y0 + w.y1) / 2 BETWEEN r.y0 - 2 AND r.y1 + 2""")
def w20(t):
    return lay.points_in_regions(t("fx_words"), t.sql(BOXES), 2.0).select("report_id", "page", "line_no", "word_no", "region_id")


CHART_WORDS = """SELECT CAST(floor(p_partkey / 3) AS BIGINT) % 10 AS report_id, CAST(floor(p_partkey / 3) AS BIGINT) AS page, (p_partkey % 3) * 100 + 10 * r + k AS word_no, p_partkey % 3 AS region_id, CASE r WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN CAST(p_size + 10 * k AS STRING) ELSE CAST(2020 + 5 * k AS STRING) END AS text,
    CAST(20 + 60 * k AS DOUBLE) AS x0, CAST(200 * (p_partkey % 3) + 20 + 40 * r AS DOUBLE) AS y0, CAST(40 + 60 * k AS DOUBLE) AS x1, CAST(200 * (p_partkey % 3) + 30 + 40 * r AS DOUBLE) AS y1
    FROM {part} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) a CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) b WHERE r > 0 OR k = 0"""


def _points(t):
    words = t.sql(CHART_WORDS)
    charts = words.groupBy("report_id", "page", "region_id").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    return tab.chart_points(words.drop("region_id"), charts)


@query("w21_chart_points", f"""
    WITH c AS ({CHART_WORDS}) SELECT v.report_id, v.page, v.region_id, v.word_no, v.text AS raw, a.text AS axis_label, n.text AS title FROM c v JOIN c a ON a.report_id = v.report_id AND a.page = v.page AND a.region_id = v.region_id AND a.x0 = v.x0 AND a.y0 = v.y0 + 40
    JOIN c n ON n.report_id = v.report_id AND n.page = v.page AND n.region_id = v.region_id AND n.word_no % 100 = 0 WHERE (v.word_no % 100) // 10 = 1""")
def w21(t):
    return _points(t).select("report_id", "page", "region_id", "word_no", "raw", "axis_label", "title")


@query("w22_combine_small_charts", f"""
    WITH c AS ({CHART_WORDS}), g AS (SELECT report_id, page, count(DISTINCT region_id) AS n, min(region_id) AS table_id FROM c GROUP BY ALL)
    SELECT v.report_id, v.page, g.table_id, v.region_id, n.text AS row_label, a.text AS col_label, v.text AS raw FROM c v JOIN c a ON a.report_id = v.report_id AND a.page = v.page AND a.region_id = v.region_id AND a.x0 = v.x0 AND a.y0 = v.y0 + 40
    JOIN c n ON n.report_id = v.report_id AND n.page = v.page AND n.region_id = v.region_id AND n.word_no % 100 = 0 JOIN g ON g.report_id = v.report_id AND g.page = v.page WHERE (v.word_no % 100) // 10 = 1 AND g.n >= 2""")
def w22(t):
    return tab.combine_small_charts(_points(t))


@query("w23_region_roles", None)
def w23(t):
    words = t("fx_grid")
    rows = cut(tab.table_regions(lay.segments_of(words)))
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    shapes = words.groupBy("report_id", "page", (F.col("row_no") < 3).alias("_part")).agg(*box).select("report_id", "page", F.col("_part").cast("int").alias("region_id"), (F.col("page") % 2 == 0).alias("is_image"), "x0", "y0", "x1", "y1")
    return tab.region_roles(shapes, rows, words).select("report_id", "page", "region_id", "is_image", "role")


@query("w24_repeated_artwork", """
    WITH a AS (SELECT m.report_id, m.page, text, round_even(x0, 0) AS sx0, round_even(x1, 0) AS sx1, CASE WHEN y1 <= 96 THEN 'top' WHEN y0 >= 704 THEN 'bottom' END AS band FROM fx_margin m)
    SELECT a.report_id, a.page, a.text AS digest, a.band, g.n AS on_pages, EXISTS (SELECT 1 FROM a b WHERE b.report_id = a.report_id AND b.text = a.text AND b.sx0 = a.sx0 AND b.sx1 = a.sx1 AND b.band = a.band AND b.page = a.page - 25) AS on_previous_page
    FROM a JOIN (SELECT report_id, text, sx0, sx1, band, count(DISTINCT page) AS n FROM a WHERE band IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) >= 3) g USING (report_id, text, sx0, sx1, band)""".replace("a.page - 25", "a.page - 1"))
def w24(t):
    return sec.repeated_artwork(t("fx_margin").withColumn("digest", F.col("text")), t("fx_grid_pages")).select("report_id", "page", "digest", "band", "on_pages", "on_previous_page")


@query("w25_join_paragraphs", None)
def w25(t):
    blocks = t("fx_words").groupBy("report_id", "page", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda e: e["text"]), " ").alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    blocks = blocks.withColumns({"section_id": F.floor(F.col("page") / 50), "ord": F.col("page") * 100 + F.col("line_no"), "kind": F.lit("paragraph")})
    return sec.join_paragraphs(blocks.drop("line_no"))


_STATEMENT = REGIONS.replace("fx_grid", "fx_statement")

# cells, labels and paragraphs as runs; tokens by the walk; boxes and parts by lines
FIGURES = f"""WITH RECURSIVE {_STATEMENT},
    sw AS MATERIALIZED (SELECT g.*, sc.table_no, sc.col_no FROM ({segmented_sql('fx_statement')}) g LEFT JOIN sc ON g.report_id = sc.report_id AND g.page = sc.page AND g.line = sc.line AND g.segment = sc.segment),
    pl AS (SELECT report_id, page, line, min(y0) AS top, max(y1) AS bottom, max(med_h) AS med, bool_or(table_no IS NOT NULL) AS tab FROM sw GROUP BY ALL),
    pg AS (SELECT report_id, page, line, sum(CASE WHEN COALESCE(NOT lag_tab AND top - lag_bottom <= 0.8 * med, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY report_id, page ORDER BY line) AS par
        FROM (SELECT *, lag(tab) OVER (PARTITION BY report_id, page ORDER BY line) AS lag_tab, lag(bottom) OVER (PARTITION BY report_id, page ORDER BY line) AS lag_bottom FROM pl)),
    rw2 AS MATERIALIZED (SELECT sw.*, col_no IS NOT NULL AS is_cell, CASE WHEN table_no IS NULL THEN 'b' || par ELSE 's' || sw.line || '_' || segment END AS runid FROM sw JOIN pg ON sw.report_id = pg.report_id AND sw.page = pg.page AND sw.line = pg.line),
    {tokens_sql('SELECT * FROM rw2', 'runid', 'line, x0, word_no', 'is_cell')},
    wd AS (SELECT *, row_number() OVER (PARTITION BY report_id, page, runid ORDER BY line, x0, word_no) AS o FROM rw2),
    tl AS (SELECT tok.report_id, tok.page, tok.run, tok.ord, wd.line, round_even(min(x0), 2) AS x0, round_even(min(y0), 2) AS y0, round_even(max(x1), 2) AS x1, round_even(max(y1), 2) AS y1, min(conf) AS conf, arg_min(segment, o) AS segment, max(table_no) AS table_no, max(col_no) AS col_no
        FROM tok JOIN wd ON tok.report_id = wd.report_id AND tok.page = wd.page AND tok.run = wd.runid AND wd.o BETWEEN tok.ord AND tok.ord + tok.span - 1 GROUP BY tok.report_id, tok.page, tok.run, tok.ord, wd.line),
    tb AS (SELECT report_id, page, run, ord, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(conf) AS conf, min(line) AS line, arg_min(segment, line) AS segment, max(table_no) AS table_no, max(col_no) AS col_no, count(*) AS n_lines,
        string_agg(x0 || ' ' || y0 || ' ' || x1 || ' ' || y1, '; ' ORDER BY line) AS boxes FROM tl GROUP BY ALL),
    rl AS (SELECT report_id, page, table_no, line, string_agg(text, ' ' ORDER BY x0, segment) FILTER (WHERE col_no IS NULL) AS row_label FROM sc GROUP BY ALL),
    fg AS (SELECT tok.*, tb.* EXCLUDE (report_id, page, run, ord), COALESCE(row_label, '') AS row_label, tb.col_no IS NOT NULL AS in_cell FROM tok JOIN tb ON tok.report_id = tb.report_id AND tok.page = tb.page AND tok.run = tb.run AND tok.ord = tb.ord
        LEFT JOIN rl ON rl.report_id = tok.report_id AND rl.page = tok.page AND rl.table_no = tb.table_no AND rl.line = tb.line)
    SELECT report_id, page, 'p' || page || 'f' || row_number() OVER (PARTITION BY report_id, page ORDER BY line, segment, ord) AS fid, kind, raw, value_str AS value, iso, precision, ambiguous,
      CASE WHEN kind IN ('number', 'nil') THEN COALESCE(unit_hint, CASE WHEN in_cell THEN 'crore' END) WHEN kind = 'percent' THEN 'percent' WHEN kind = 'bps' THEN 'bps' WHEN kind = 'multiple' THEN 'x' END AS unit,
      CASE WHEN kind IN ('number', 'nil') THEN CASE WHEN COALESCE(currency_hint, currency_symbol) = '₹' OR in_cell THEN 'INR' END END AS currency,
      COALESCE(period_key, CASE WHEN col_no = 1 THEN 'quarter2:FY2025' END) AS period_key, CASE WHEN in_cell THEN row_label END AS row_label, CASE col_no WHEN 1 THEN 'Q2 FY25' WHEN 2 THEN 'Quantity' WHEN 3 THEN 'Tax' END AS col_label,
      table_no, CAST(line AS BIGINT) AS line, CAST(col_no AS INT) AS col_no, NULL::VARCHAR AS change, CASE WHEN in_cell THEN 'cell' WHEN table_no IS NOT NULL THEN 'row_label' ELSE 'text' END AS role,
      x0, y0, x1, y1, CASE WHEN n_lines > 1 THEN boxes END AS parts, CASE WHEN page % 3 = 0 THEN 'ocr' ELSE 'text_layer' END AS method, round_even(conf, 3) AS confidence, 'active' AS status,
      in_cell AND kind = 'identifier' AND regexp_matches(raw, '^[(\\-−–]?[0-9][0-9,.\\-–]*\\)?%?$') AS unparsed FROM fg"""


@query("w26_build_figures", FIGURES)
def w26(t):
    segmented = cut(lay.line_segments(lay.visual_lines(t("fx_statement"))))
    segs = lay.segment_rows(segmented)
    pages = t("fx_grid_pages").withColumn("method", F.when(F.col("page") % 3 == 0, "ocr").otherwise("text_layer"))
    meta = pages.select("report_id").distinct().withColumns({"report_unit": F.lit("lakh"), "report_currency": F.lit("USD")})
    found = fig.build_figures(segmented, cut(tab.segments_of_tables(tab.anchored_tables(segs, "text", "x0"))), cut(tab.table_headers(segs)), meta, pages)
    one = lambda b: F.concat_ws(" ", *[b[c].cast("string") for c in ("x0", "y0", "x1", "y1")])
    return found.withColumn("parts", F.array_join(F.transform("parts", one), "; "))
