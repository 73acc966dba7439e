"""Block scans against plain windows, on groups that span many blocks, whatever the partition count."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.functions import ordered
from figtrail.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("pos"), F.when(F.col("id") % 37 < 2, F.col("id")).alias("v"), (F.col("id") % 5).alias("x"))
    return df.withColumn("g", F.when(F.col("pos") % 2 == 0, 0).otherwise(F.col("g")))      # one hot group


@pytest.mark.parametrize("parts", ["1", "4", "200"])
def test_same_as_a_window(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        w, block = W.partitionBy("g").orderBy("pos"), F.floor(F.col("pos") / 64)
        up = w.rowsBetween(W.unboundedPreceding, 0)
        want = rows.select("pos", F.row_number().over(w).cast("bigint").alias("n"), F.sum("x").over(up).alias("s"), F.last("v", True).over(up).alias("l"), F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("b"),
                           F.first("v", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("a"))
        df = ordered.numbered(rows, ["g"], block, ["pos"], "n")
        df = ordered.running_sum(df, ["g"], block, ["pos"], "x", "s")
        df = ordered.last_seen(df, ["g"], block, ["pos"], "v", "l")
        df = ordered.last_seen(df, ["g"], block, ["pos"], "v", "b", inclusive=False)
        df = ordered.first_seen_after(df, ["g"], block, ["pos"], "v", "a")
        got = df.select("pos", "n", "s", "l", "b", "a")
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name, exchanges", [("c4_check_totals", 4), ("e3_outline_sections", 6), ("e5_assign_chapters", 6), ("w18_assign_sections", 4), ("v14_next_versions", 4)])
def test_what_follows_a_scan_does_not_repeat_its_input(spark, name, exchanges):
    """Behind the last ordered scan only tables that scans have written are read, at most one of the inputs with them."""
    plan = catalog.load()[0][name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    inputs = [line for line in plan.splitlines() if "FileScan" in line and "/figtrail/cut-" not in line]
    assert len(inputs) <= 1 and len(re.findall(r"Exchange (?:hash|range|single)", plan)) <= exchanges, plan
