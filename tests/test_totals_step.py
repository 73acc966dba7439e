"""Totals (C4): cells are scanned once, segments run over blocks of rows, any column may be a table's first."""

from __future__ import annotations

from pyspark.sql import functions as F

from figtrail.operators import checks

CELL = "report_id string, table_id string, row_no int, label string, col_no int, raw string"


def _long_table(spark, first_col):
    """Three totals, the second of which closes a segment that reaches over three blocks; one column is off there."""
    rows = spark.range(10000).select(F.lit("r").alias("report_id"), F.lit("t").alias("table_id"), F.col("id").cast("int").alias("row_no"))
    total = F.col("row_no").isin(9, 9000, 9999)
    n = F.when(F.col("row_no") == 9, 9).when(F.col("row_no") == 9000, 8990).when(F.col("row_no") == 9999, 998)
    cells = rows.withColumn("label", F.when(total, "Total").otherwise("Line")).withColumn("col_no", F.explode(F.array(F.lit(first_col), F.lit(first_col + 1))))
    off = F.when((F.col("row_no") == 9000) & (F.col("col_no") > first_col), 7000).otherwise(0)
    raw = F.when(total, (n + off).cast("string")).when(F.col("row_no") % 3 == 0, "1").when(F.col("row_no") % 3 == 1, "1.0").otherwise(" 01 ")
    return cells.withColumn("raw", raw)


def test_segments_over_blocks_and_a_column_numbered_zero(spark):
    for first in (0, 1):
        cells = _long_table(spark, first)
        bad = checks.check_totals(cells).collect()
        assert [(r.row_no, r.col_no, r.severity, r.expected, r.actual) for r in bad] == [(9000, first + 1, "blocking", "8990.0000", "15990")]
        seen = checks.cells_in_totals(cells).groupBy("col_no", "confirmed").count().collect()
        assert {(r.col_no, r.confirmed): r["count"] for r in seen} == {(first, True): 10000, (first + 1, True): 1009, (first + 1, False): 8991}


def test_cells_in_totals_reads_the_cells_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(raw):
        reads.add(1)
        return raw

    cells = spark.createDataFrame([("r", "t", i, label, 1, raw) for i, (label, raw) in enumerate([("a", "1"), ("b", "2"), ("Total", "3")])], CELL)
    assert checks.cells_in_totals(cells.withColumn("raw", seen.asNondeterministic()("raw"))).count() == 3
    assert reads.value == 3
