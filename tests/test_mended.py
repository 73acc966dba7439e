"""Cases that were once read wrongly: printed blanks, repeated labels, change columns, nested tags, long values, folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from figtrail.functions.dates import with_period
from figtrail.functions.numbers import with_number
from figtrail.operators import checks, metadata, sections, traffic, usage, versions
from figtrail.sources import readers
from figtrail.streaming import streams

CELL = "report_id string, table_id string, row_no int, label string, col_no int, raw string"
COLUMN = "report_id string, table_id string, col_no int, period_key string, change string"


def _cells(spark, rows):
    return spark.createDataFrame([("r", "t", i, label, c, raw) for i, (label, *values) in enumerate(rows) for c, raw in enumerate(values, 1)], CELL)


def test_no_break_blanks_are_blanks(spark):
    printed = spark.createDataFrame([("₹ 7,350",), ("12.5 %",), (" 640",)], "raw string")
    assert [str(r.n_value_str) for r in with_number(printed, "raw", "n_").collect()] == ["7350", "12.5", "640"]
    label = spark.createDataFrame([("Q3 FY27",)], "raw string")
    assert with_period(label, "raw").first()["period_key"] == "quarter3:FY2027"


def test_change_columns_are_no_amounts(spark):
    columns = spark.createDataFrame([("r", "t", 1, None, None), ("r", "t", 2, None, "yoy")], COLUMN)
    assert checks.check_totals(_cells(spark, [("A", "11", "4.0"), ("B", "19", "8.0"), ("Total", "30", "6.1")]), columns).collect() == []
    assert checks.check_balance(_cells(spark, [("Total assets", "90", "2.0"), ("Total equity and liabilities", "90", "3.0")]), columns).collect() == []


def test_repeated_labels_are_judged_row_by_row(spark):
    columns = spark.createDataFrame([("r", "t", 1, "year:FY2026", None), ("r", "t", 2, "year:FY2025", None), ("r", "t", 3, None, "yoy")], COLUMN)
    found = checks.check_stated_changes(_cells(spark, [("Others", "90", "60", "50.0%"), ("Others", "33", "22", "71.0%")]), columns).collect()
    assert [(r.row_no, r.actual, r.expected_change) for r in found] == [(1, "71.0%", 50.0)]


def test_a_figure_may_hold_other_elements(spark):
    page = spark.createDataFrame([(1, '<p>Sales <span data-fig="p3f2"><b>8</b>,412</span> up</p>')], "page_id int, html string")
    assert [(r.ref, r.text) for r in readers.scan_html(page).where("kind = 'figure'").collect()] == [("p3f2", "8,412")]


def test_a_change_late_in_a_long_text_changes_the_fingerprint(spark):
    rows = [("r", p, 1, "text", 0.0, 0.0, 1.0, 1.0, "x" * 200 + end) for p, end in ((1, "a"), (2, "b"))]
    prints = usage.page_fingerprints(spark.createDataFrame(rows, "report_id string, page int, element_id int, kind string, x0 double, y0 double, x1 double, y1 double, text string"))
    assert prints.select("fingerprint").distinct().count() == 2


def test_names_with_inner_marks_are_found(spark):
    pages = spark.createDataFrame([("r", p, "Results of Dr. Mehra's Pharma Limited for the year") for p in (1, 2)], "report_id string, page int, text string")
    uses = metadata.phrase_pages(metadata.page_tokens(pages), spark.createDataFrame([("r", "Dr. Mehra's Pharma")], "report_id string, phrase string"))
    assert [r.pages for r in uses.collect()] == [2]


def test_more_than_a_thousand_bullets_stay_in_their_block(spark):
    text = "• one " * 1200
    blocks = spark.createDataFrame([("r", "s", 1, 1, "paragraph", text + "end.", 0.0, 1.0), ("r", "s", 2, 1, "paragraph", "After.", 2.0, 3.0)], "report_id string, section_id string, ord int, page int, kind string, text string, y0 double, y1 double")
    joined = sections.join_paragraphs(blocks)
    assert joined.agg(F.max_by("text", "paragraph_no")).first()[0].strip() == "After."


def test_long_fields_and_windows_are_refused_not_cut(spark):
    upload = spark.createDataFrame([("u", "N" * 201, "annual_report", "FY2026", "fy", "INR", "crore", None)], "upload_id string, company_name string, report_type string, fiscal_year string, period string, currency string, reporting_unit string, period_end string")
    assert versions.validate_uploads(upload).first()["reason"] == "company_name:too_long"
    hits = spark.createDataFrame([], "tenant_id int, report_id int, at_ts timestamp_ntz, status int, user_agent string")
    with pytest.raises(ValueError):
        traffic.traffic_daily(hits, "2024-01-31 00:00:00", 0)
    assert traffic.traffic_daily(hits, "2024-01-31 00:00:00", 3000).count() == 0


def test_a_table_of_part_files_streams_like_one_file(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "event_id").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    stream = streams.read_table_stream(spark, str(tmp_path), "events")
    streams.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_phrases_of_more_than_eight_words_are_compared_whole(spark):
    long = "the northern light and power and water company of upper mehra"
    pages = spark.createDataFrame([("r", 1, f"By {long} today"), ("r", 2, f"At {long.replace('upper', 'lower')}"), ("r", 3, long)], "report_id string, page int, text string")
    uses = metadata.phrase_pages(metadata.page_tokens(pages), spark.createDataFrame([("r", long), ("r", "the northern light and power and water company")], "report_id string, phrase string"))
    assert {r.phrase: r.pages for r in uses.collect()} == {long: 2, "the northern light and power and water company": 3}


def test_spans_that_end_on_a_day(spark):
    text = "For the quarter and nine months ended\nDecember 31, 2025, and the year ended on 31.03.2025. Half-year ended 30th September 2025; it ended well."
    found = metadata._ended(spark.createDataFrame([("r", 1, text)], "report_id string, page int, text string")).collect()
    assert sorted((r.what, r.d_iso) for r in found) == [("half", "2025-09-30"), ("quarter", "2025-12-31"), ("year", "2025-03-31")]


@pytest.mark.parametrize(("text", "year", "period", "evidence"), [
    ("Outcome Q3 FY27", 2027, "q3", 1), ("Q4-FY2031-32 update", 2032, "q4", 1), ("9M 2019", 2019, "9m", 1), ("H2 FY 28", 2028, "h2", 1),
    ("Annual Report 2017-18", 2018, "fy", 4), ("Annual accounts for FY 2016", 2016, "fy", 4), ("Report & Accounts 2019/20", 2020, "fy", 4),
    ("for the year ended June 30, 2018", 2019, "fy", 3), ("Fiscal year ended 2014", 2014, "fy", 5), ("7th May 2015", 2016, "q1", 8),
    ("FY’29 aims", 2029, None, 9), ("plan 2021", 2021, None, 10), ("31st February 2025", 2025, None, 10), ("Q3 24", None, None, None),
    ("2021%", None, None, None), ("", None, None, None), (None, None, None, None)])
def test_periods_are_read_word_by_word(spark, text, year, period, evidence):
    pages = spark.createDataFrame([("r", 1, True, text)], "report_id string, page int, is_cover boolean, text string")
    got = metadata.vote_period(pages, pages.select("report_id", F.lit(4).alias("start_month"))).select("fiscal_year", "period", "evidence").collect()
    assert [tuple(r) for r in got] == ([] if evidence is None else [(year, period, evidence)])


def test_units_beside_their_currency(spark):
    texts = {"₹ in crore": "crore", "(₹8,400 crore)": "crore", "US$2.7 million": "million", "$ 6bn": "billion", "Rs.45 lakhs": "lakh", "€ in '000": "thousand",
             "₹ 45   crore": "crore", "16 crore shares": None, "₹ 9 per share": None, "": None}
    pages = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "report_id string, page int, text string")
    got = {r.report_id: r.unit for r in metadata.vote_unit(pages, metadata.vote_currency(pages)).collect()}
    assert {t: got.get(str(i)) for i, t in enumerate(texts)} == {**texts, "₹ 45   crore": None}


def _report(spark, texts):
    return spark.createDataFrame([("r", i + 1, t) for i, t in enumerate(texts)], "report_id string, page int, text string")


def test_a_legal_form_may_follow_another(spark):
    pages = _report(spark, ["Indian Oil Corporation Limited sells fuel.", "Shares of Indian Oil Corporation Limited rose. Indian Oil Corporation was founded early.", "Indian Oil Corporation Ltd and others. Indian Oil is big.", "More of Indian Oil."])
    got = {r.name: r.mentions for r in metadata.legal_names(pages).collect()}
    assert list(got) == ["Indian Oil Corporation Limited"] and got["Indian Oil Corporation Limited"] == 4


def test_a_name_grows_to_four_words_in_one_call(spark):
    pages = _report(spark, ["We at Nova Steel Works Group grew and Nova Steel Works Group sold", "Later Nova Steel Works Group Holding rose", "Nova Steel Works Group again"])
    tokens = metadata.page_tokens(pages)
    names = spark.createDataFrame([("r", "Nova"), ("r", "Unknown")], "report_id string, name string")
    got = {r.name for r in metadata.name_extension(tokens, names, metadata.proper_nouns(tokens)).collect()}
    assert got == {"Nova Steel Works Group", "Unknown"}


def test_short_marks_behind_dollar_amounts_are_units(spark):
    money = spark.createDataFrame([("a", "USD"), ("b", "USD"), ("c", "INR")], "report_id string, currency string")
    pages = spark.createDataFrame([("a", 1, "Revenue of $1.3B and $ 27.2 B, costs US$2.5B"), ("b", 1, "Backlog $450MM, cash $12M."), ("c", 1, "(₹ cr.) Sales 12, in dollars $3B")], "report_id string, page int, text string")
    got = {r.report_id: (r.unit, r.confidence) for r in metadata.vote_unit(pages, money).collect()}
    assert got == {"a": ("billion", "high"), "b": ("million", "high"), "c": ("crore", "medium")}
