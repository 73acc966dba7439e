"""Seeded errors in clean tables, wrapped figures, readings, and the identities of the counts."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from figtrail.operators import usage, checks, layout, review
from figtrail.operators.sections import assign_sections

CELL = "report_id string, table_id string, row_no int, label string, col_no int, raw string"


def _table(rows):
    return [("r", "t", i, label, c, raw) for i, (label, *values) in enumerate(rows) for c, raw in enumerate(values, 1)]


def test_a_broken_total_is_found_and_rounding_is_not(spark):
    ok = _table([("A", "1.3", "10"), ("B", "2.4", "20"), ("Total", "3.8", "30")])                # 3.7 printed 3.8: within rounding
    assert checks.check_totals(spark.createDataFrame(ok, CELL)).collect() == []
    bad = _table([("A", "1.30", "10", "5"), ("B", "2.40", "20", "5"), ("Total", "9.70", "30", "10"), ("C", "1", "1", "1"), ("D", "2", "2", "2"), ("Grand total", "3", "3", "3")])
    found = checks.check_totals(spark.createDataFrame(bad, CELL)).collect()
    assert [(r.row_no, r.col_no, r.severity, r.actual) for r in found] == [(2, 1, "blocking", "9.70")]


def test_no_column_adds_up_means_it_is_no_sum(spark):
    rows = _table([("A", "1"), ("B", "2"), ("Total", "99")])
    assert checks.check_totals(spark.createDataFrame(rows, CELL)).collect() == []
    assert checks.cells_in_totals(spark.createDataFrame(rows, CELL)).collect() == []


def test_balance_and_nil(spark):
    rows = _table([("Total assets", "100", "-"), ("Total equity and liabilities", "100.5", "0")])
    assert [(r.col_no, r.expected, r.actual) for r in checks.check_balance(spark.createDataFrame(rows, CELL)).collect()] == [(1, "100", "100.5")]


def test_stated_change_takes_the_nearest_column_with_its_comparison(spark):
    rows = _table([("Sales", "110", "100", "80", "10.0%", "37.5%"), ("Cost", "55", "50", "44", "15.0%", "25.0%")])
    columns = spark.createDataFrame([("r", "t", 1, "quarter2:FY2026", None), ("r", "t", 2, "quarter2:FY2025", None), ("r", "t", 3, "quarter1:FY2026", None), ("r", "t", 4, None, "yoy"), ("r", "t", 5, None, "qoq")],
                                    "report_id string, table_id string, col_no int, period_key string, change string")
    found = checks.check_stated_changes(spark.createDataFrame(rows, CELL), columns).collect()
    assert [(r.label, r.col_no, r.expected_change) for r in found] == [("Cost", 4, 10.0)]


WORD = "report_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


def test_a_figure_wrapped_over_two_lines_is_traced(spark):
    words = spark.createDataFrame([("r", 1, 1, "30th", 10.0, 100.0, 30.0, 110.0), ("r", 1, 2, "2026,", 10.0, 114.0, 40.0, 124.0), ("r", 1, 3, "Other", 200.0, 100.0, 230.0, 110.0)], WORD)
    box = lambda a, b, c, d: Row(x0=a, y0=b, x1=c, y1=d)
    parts = [box(9.0, 99.0, 31.0, 111.0), box(9.0, 113.0, 41.0, 125.0)]
    schema = "report_id string, page int, fid string, raw string, status string, edited boolean, x0 double, y0 double, x1 double, y1 double, parts array<struct<x0:double,y0:double,x1:double,y1:double>>"
    figs = spark.createDataFrame([("r", 1, "p1f1", "30th 2026", "active", False, 9.0, 99.0, 41.0, 125.0, parts), ("r", 1, "p1f2", "2026 30th", "active", False, 9.0, 99.0, 41.0, 125.0, parts)], schema)
    assert [r.fid for r in checks.confirmed_by_trace(figs, words).collect()] == ["p1f1"]


def test_readings_agree_on_digits_sign_and_kind(spark):
    cases = [("45.55", "45-55", "number", True), ("(12)", "12", "number", False), ("12%", "12x", "percent", True), ("12%", "12", "percent", False), ("₹3.50", "23.50", "number", True), ("1,234", "1234", "number", True),
             ("30.09.2025", "30/09/2025", "date", True), ("-", "", "nil", True), ("5", "9", "number", False)]
    figs = spark.createDataFrame([("r", f"f{i}", raw, kind, "active") for i, (raw, _, kind, _) in enumerate(cases)], "report_id string, fid string, raw string, kind string, status string")
    reads = spark.createDataFrame([("r", f"f{i}", 1, read) for i, (_, read, _, _) in enumerate(cases)], "report_id string, fid string, reading_no int, reading string")
    got = {r.fid: r.agrees for r in checks.judged_readings(figs, reads).collect()}
    assert [got[f"f{i}"] for i in range(len(cases))] == [ok for *_, ok in cases]


def test_figure_counts_add_up_before_and_after_decisions(spark):
    figs = spark.createDataFrame([(1, f"f{i}", "active") for i in range(5)] + [(1, "gone", "not_a_figure")], "version_id int, fid string, status string")
    issues = spark.createDataFrame([(1, 1, "f0", "traceability", "blocking", "open"), (2, 1, "f0", "arithmetic", "warning", "open"), (3, 1, "f1", "arithmetic", "warning", "open"), (4, 1, None, "period_unit", "warning", "open"),
                                    (5, 1, "gone", "reviewer_flag", "blocking", "open")], "issue_id int, version_id int, fid string, check_name string, severity string, status string")
    confirmed = spark.createDataFrame([(1, "f2", "traceability"), (1, "f2", "arithmetic")], "version_id int, fid string, check_name string")
    people = spark.createDataFrame([(1, "f3")], "version_id int, fid string")
    for df in (issues, issues.filter("issue_id > 2"), issues.limit(0)):
        rows = review.figure_states(figs, df, confirmed, people).collect()
        for r in rows:
            assert r.passed + r.need_attention + r.notes == r.figures == 5
            assert r.to_decide == r.need_attention + r.other_need_attention
    first = review.figure_states(figs, issues, confirmed, people).first()
    assert (first.need_attention, first.notes, first.other_need_attention, first.other_notes, first.not_confirmed) == (1, 1, 1, 1, 3)


def test_facets_show_as_many_rows_as_they_say(spark):
    rows = [(i, 1, f"f{i % 7}" if i % 3 else None, ["arithmetic", "completeness"][i % 2], ["blocking", "warning"][i % 5 == 0], "open" if i % 4 else "resolved", i % 6 + 1, f"s{i % 3}") for i in range(60)]
    issues = spark.createDataFrame(rows, "issue_id int, version_id int, fid string, check_name string, severity string, status string, page int, section_id string").withColumn("x0", F.lit(1.0))
    base = {"severity": "blocking"}
    for r in review.facet_counts(issues, base).collect():
        chosen = {**base, r.facet: r.value}
        total = review.review_totals(issues, chosen).first()
        assert total.rows == r.rows, r


def test_an_item_without_a_box_is_not_decided_beside_the_page(spark):
    rows = [(1, 1, "f1", "arithmetic", "blocking", "open", 1, "s", 5.0), (2, 1, "f2", "arithmetic", "blocking", "open", 1, "s", None)]
    issues = spark.createDataFrame(rows, "issue_id int, version_id int, fid string, check_name string, severity string, status string, page int, section_id string, x0 double")
    total = review.review_totals(issues, {}).first()
    assert (total.rows, total.figures, total.notes) == (2, 1, 1)


def test_an_answered_figure_is_not_paid_for_again(spark):
    issues = spark.createDataFrame([(1, f"f{i}", "open", "blocking", "re_extraction", 9) for i in range(4)], "version_id int, fid string, status string, severity string, check_name string, page int")
    figures = spark.createDataFrame([(1, "f0", "1", "ocr", 3, 1.0), (1, "f1", "2", "ocr", 2, 1.0), (1, "f2", "3", "text_layer", 1, 1.0), (1, "f3", "4", "ocr", 1, None)], "version_id int, fid string, raw string, method string, page int, x0 double")
    answers = spark.createDataFrame([(1, "f0", "1"), (1, "f1", "old")], "version_id int, fid string, raw string")
    budgets = spark.createDataFrame([(1, 100)], "version_id int, budget int")
    got = usage.second_opinion_queue(issues, figures, budgets, answers).orderBy("rank").collect()
    assert [(r.fid, r["rank"]) for r in got] == [("f1", 1), ("f2", 2)]


def test_columns_that_state_a_change_do_not_add_up(spark):
    rows = [("r", "t", n, label, c, raw, "YoY growth" if c == 2 else "2025") for n, label, a, b in ((1, "A", "11", "4"), (2, "B", "19", "8"), (3, "Total", "30", "6")) for c, raw in ((1, a), (2, b))]
    cells = spark.createDataFrame(rows, "report_id string, table_id string, row_no int, label string, col_no int, raw string, col_label string")
    assert checks.check_totals(cells).count() == 0
    assert checks.check_totals(cells.drop("col_label")).count() == 1


def test_a_confirmation_holds_only_at_the_confirmed_value(spark):
    issues = spark.createDataFrame([(1, 1, "f1", "traceability", "blocking", "m", 1, "open"), (2, 1, "f2", "traceability", "blocking", "m", 1, "open"), (3, 1, "f1", "rendered_page", "blocking", "m", 1, "open")],
                                   "issue_id int, version_id int, fid string, check_name string, severity string, message string, page int, status string")
    figs = spark.createDataFrame([(1, "f1", "5", "confirm", "5"), (1, "f2", "6", "confirm", "5")], "version_id int, fid string, raw string, review_action string, review_raw string")
    acks = spark.createDataFrame([], "version_id int, issue_key string")
    got = {r.issue_id: r.status for r in review.apply_reviews(issues, figs, acks).collect()}
    assert got == {1: "resolved", 2: "open", 3: "open"}


def test_longest_token_from_the_left(spark):
    text = "In Q2 FY26 revenue was ₹ 1,234 crore on 30 September 2025, up 12.5% (2024)."
    words = spark.createDataFrame([("r", 1, i, w, 40.0 * i, 10.0, 40.0 * i + 30, 20.0) for i, w in enumerate(text.split())], WORD)
    got = layout.figure_tokens(layout.visual_lines(words)).orderBy("ord").collect()
    assert [(r.raw, r.kind) for r in got] == [("Q2 FY26", "period"), ("₹ 1,234", "number"), ("30 September 2025", "date"), ("12.5%", "percent"), ("(2024)", "number")]
    assert (got[1].unit_hint, got[1].value_str) == ("crore", "1234")


def test_headings_fold_one_level_deep_and_questions_do_not(spark):
    rows = [("A", True), ("B", True), ("C", True), ("text", False), ("D", True), ("Q5. Why", True), ("answer", False)]
    df = spark.createDataFrame([("r", 1, i, t, h) for i, (t, h) in enumerate(rows)], "report_id string, page int, ord int, text string, is_heading boolean")
    got = assign_sections(df).orderBy("ord").collect()
    assert [r.role for r in got] == ["heading", "subheading", "heading", "content", "heading", "heading", "content"]
    assert got[3].section_id == "s1_2" and got[6].section_id == "s1_5"


def test_a_common_start_brings_no_candidates(spark):
    import random
    rng = random.Random(4)
    titles = ["consolidatedannualreportandaccounts" + "".join(rng.choice("abcdefghijklmnop") for _ in range(20)) for _ in range(1500)]
    titles += [t[:-1] + "z" for t in titles[:50]]
    df = spark.createDataFrame([("r", t) for t in titles], "report_id string, sig string")
    candidates = layout.candidate_signatures(df).count()
    assert candidates < 1500 * 1500 / 50
    pairs = layout.similar_signatures(df).filter("sig < other").count()
    assert pairs == 50


def test_similar_signatures_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    base = ["annualreportfortheyear", "consolidatedfinancialstatements", "acme", "quarterlyresults"]
    sigs = set()
    for _ in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
            if rng.random() < 0.3:
                s.insert(rng.randrange(len(s)), "x")
        sigs.add("".join(s))
    df = spark.createDataFrame([("r", s) for s in sorted(sigs)], "report_id string, sig string")
    got = {(r.sig, r.other) for r in layout.similar_signatures(df).collect()}
    a, b = df.alias("a"), df.select(F.col("sig").alias("other")).alias("b")
    near = (F.abs(F.length("sig") - F.length("other")) <= 3) & (1 - F.levenshtein("sig", "other") / F.greatest(F.length("sig"), F.length("other")) >= 0.88)
    want = {(r.sig, r.other) for r in a.crossJoin(b).filter(near).collect()}
    assert got == want
