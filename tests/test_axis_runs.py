"""Axis ticks: words are parted by page once, and what follows keeps them there."""

from figtrail.operators import layout

WORDS = "report_id int, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"


def _column(page, values, x=40.0, first=0):
    return [(1, page, first + i, v, x, 100.0 + 30 * i, x + 20, 110.0 + 30 * i) for i, v in enumerate(values)]


def test_runs_are_found_with_one_shuffle(spark):
    rows = _column(1, ["50", "40", "30", "20", "10", "0"]) + _column(2, ["50", "40", "37", "20", "10"]) + _column(3, ["2025", "2024", "2023", "2022", "2021"])
    rows += _column(4, ["9", "7", "5"]) + _column(5, ["8", "6", "4", "2", "0", "-10", "-20", "-30"])
    runs = layout.axis_runs(spark.createDataFrame(rows, WORDS))
    assert runs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {}
    for r in runs.filter("axis = 'right'").collect():
        found.setdefault(r.page, []).append((r.word_no, r.len, r.zero, r.size))
    assert sorted(found) == [1, 4]  # an uneven value, years, and two steps on one axis make no run
    assert sorted(found[1]) == [(i, 6, True, 10.0) for i in range(6)]
    assert sorted(found[4]) == [(i, 3, False, 2.0) for i in range(3)]


def test_parts_of_pages_stay_apart(spark):
    """Adaptive execution joins shuffled parts by their compressed bytes, of which words take up few."""
    rows = [row for page in range(400) for row in _column(page, ["4", "3", "2", "1", "0"])]
    runs = layout.axis_runs(spark.createDataFrame(rows, WORDS))
    assert runs.filter("axis = 'right'").count() == 2000
    assert runs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_margin_words_stay_apart_by_page(spark):
    words = spark.createDataFrame([(1, p, 1, "Title", 50.0, 20.0, 80.0, 30.0) for p in range(300)], WORDS)
    pages = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(300)], "report_id int, page int, width double, height double")
    margin = layout._band_words(words, pages)
    assert margin.count() == 300
    assert margin.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
