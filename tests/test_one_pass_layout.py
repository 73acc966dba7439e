"""Steps within a page shuffle its words once and store or join nothing."""

from __future__ import annotations

from figtrail.operators import layout, sections, tables
from figtrail.session import cut

WORDS = "report_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, conf double"
LINES = [[("Annual", 50), ("statement", 92)], [("(₹", 50), ("crore)", 68)], [("Particulars", 50), ("FY25", 276), ("Tax", 382)], [("Sales", 50), ("1,234", 270), ("12", 388)],
         [("Costs", 50), ("234", 282), ("7", 394)], [("Profit", 50), ("1,000", 270), ("5", 394)], [("Staff", 300)], [("450", 300)]]


def _words(spark):
    rows = [("r", p, 10 * i + k, t, float(x), 100.0 + 14 * i, float(x + 6 * len(t)), 110.0 + 14 * i, 16.0 if i == 0 else 10.0, i == 0, 0.9)
            for p in (1, 2) for i, line in enumerate(LINES) for k, (t, x) in enumerate(line)]
    return spark.createDataFrame(rows, WORDS)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def test_words_of_a_page_are_shuffled_once(spark):
    segments = layout.segments_of(_words(spark))
    found = tables.anchored_tables(segments)
    for df in (tables.table_regions(segments), tables.anchor_rows(found), tables.problems_of_tables(tables.segments_of_tables(found)), layout.kpi_pairs(segments)):
        assert _exchanges(df) == (1, 0)


def test_headings_shuffle_once_and_join_the_body_size_alone(spark):
    body = cut(spark.createDataFrame([("r", 10.0)], "report_id string, title_size double"))
    found = sections.headings(layout.segments_of(_words(spark)), body)
    assert _exchanges(found) == (1, 1)
    assert [(r.page, r.text) for r in found.filter("is_heading").orderBy("page").collect()] == [(1, "Annual statement"), (2, "Annual statement")]


def test_tables_in_one_pass(spark):
    segments = layout.segments_of(_words(spark))
    found = tables.anchored_tables(segments, "text")
    assert sorted((r.page, r.col_no, r.anchor, r.col_width) for r in tables.anchor_rows(found).collect()) == [(p, i, a, 100.0) for p in (1, 2) for i, a in ((1, 300.0), (2, 400.0))]
    cells = {(r.line, r.text): r.col_no for r in tables.segments_of_tables(found).filter("page = 1").collect()}
    assert cells[(4, "1,234")] == 1 and cells[(4, "12")] == 2 and cells[(4, "Sales")] is None
    regions = tables.table_regions(segments)
    stored = tables.assign_columns(segments, regions, tables.column_anchors(segments, regions)).filter("page = 1")
    assert {(r.line, r.text): r.col_no for r in stored.collect()} == cells
    heads = {r.col_no: r.label for r in tables.table_headers(segments).filter("page = 2").collect()}
    assert heads[0] == "Particulars" and heads[1] == "FY25" and heads[2] == "Tax" and heads[-1] == "(₹ crore)"


def test_pairs_in_one_pass(spark):
    assert [(r.label, r.value) for r in layout.kpi_pairs(layout.segments_of(_words(spark))).filter("page = 1 AND label = 'Staff'").collect()] == [("Staff", "450")]
