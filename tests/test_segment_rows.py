"""Segments read off windows, and lines told to be heads only where a date can be."""

import re

from figtrail.functions.dates import may_be_dated, with_date, with_ended_span, with_label_parts, with_period
from figtrail.operators import layout
from pyspark.sql import functions as F

SCHEMA = "report_id int, page int, line long, segment long, word_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, conf double, page_height_med double"


def _word(page, segment, no, text, size=10.0):
    return (1, page, 1, segment, no, text, 5.0 * no, 1.0, 5.0 * no + 4, 11.0 + no % 3, size, no % 2 == 0, 0.5 + no % 2 / 10, 10.0)


def test_segments_of_any_length(spark):
    rows = [_word(1, 1, n, f"w{n}", float(n % 7)) for n in range(200)] + [_word(1, 2, 300, "1,234")] + [_word(2, 1, 5, None, None), _word(2, 1, 4, "Total"), _word(2, 1, 6, "due", 8.0)] + [_word(3, 1, 1, None)]
    rows += [_word(4, 1, n, f"v{n}") for n in range(layout.TEXT_WORDS)] + [_word(5, 1, n, f"u{n}") for n in range(layout.TEXT_WORDS + 1)]
    got = layout.segment_rows(spark.createDataFrame(list(reversed(rows)), SCHEMA))
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().sparkPlan().toString()
    seen = {(r.page, r.segment): r for r in got.collect()}
    assert len(seen) == 6
    assert seen[1, 1].text == " ".join(f"w{n}" for n in range(200)) and seen[1, 1].n_words == 200 and seen[1, 1]["size"] == 3.0
    assert (seen[1, 1].x0, seen[1, 1].x1, seen[1, 1].y1, seen[1, 1].bold, seen[1, 1].conf, seen[1, 1].is_numeric) == (0.0, 999.0, 13.0, False, 0.5, False)
    assert (seen[1, 2].text, seen[1, 2].is_numeric, seen[1, 2].bold) == ("1,234", True, True)
    assert (seen[2, 1].text, seen[2, 1].n_words, seen[2, 1]["size"]) == ("Total due", 3, 9.0) and seen[3, 1].text == ""
    assert seen[4, 1].text == " ".join(f"v{n}" for n in range(layout.TEXT_WORDS)) and seen[5, 1].text == " ".join(f"u{n}" for n in range(layout.TEXT_WORDS + 1))


def test_no_date_or_label_is_passed_over(spark):
    months = ["Jan", "february", "MAR.", "April", "may", "June", "jul", "Aug.", "Sept", "October", "Nov", "december"]
    texts = [f.format(m=m) for m in months for f in ("{m} 2024", "5 {m} 24", "5th-{m}-2024", "{m} 5, 2024", "{m}'24")]
    texts += ["1.2.24", "01/02/2024", "2024-01-31", " 1-2-2024,", "Q2 FY'26", "f.y. 2025", "9M FY 2025-26", "H1-FY26", "F' Y 25", "Q1 F Y24", "Six months ended on 30 September 2025", "year ENDED 1.2.2024"]
    df = spark.createDataFrame([(t,) for t in texts + ["Line 1", "1,234.50", "(12)", "2024", "5.5%", "A12-04", "nil"]], "text string")
    read = with_date(with_ended_span(with_label_parts(df, "text", "l_"), "text", "l_"), "text", "d_").withColumn("may", may_be_dated(F.col("text")))
    rows = read.collect()
    assert [r.text for r in rows if not r.may and (r.l_mark is not None or r.d_iso or r.l_on)] == []
    assert sum(r.l_mark is not None or r.d_iso is not None or r.l_on is not None for r in rows) >= len(texts) - 2
    assert {r.text for r in rows if not r.may} == {"Line 1", "1,234.50", "(12)", "2024", "5.5%", "A12-04", "nil"}


def test_reading_a_period_stays_compilable(spark, capsys):
    """The JVM never compiles methods over 8,000 bytes."""
    labels = spark.range(3).select(F.concat(F.lit("Q2 FY"), F.col("id").cast("string"), F.lit("5")).alias("label"))
    with_period(labels, "label", columns_too=False).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000
