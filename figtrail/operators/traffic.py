"""Visits (T1–T3). Every rollup starts from one aggregate over (tenant, report, day, class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.operators.normalise import agent_class

TYPE_WORDS = {"quarterly_results": "results", "investor_presentation": "investor presentation", "annual_report": "annual report", "other": "report"}


def _window(hits: DataFrame, now: str, days: int) -> DataFrame:
    if days < 1:
        raise ValueError("days is 1 or more")
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    return hits.filter((F.col("at_ts") >= since) & (F.col("status") < 400)).withColumn("agent_class", agent_class(F.col("user_agent")))


def _crawler() -> Column:
    return F.regexp_replace("agent_class", "^bot:", "")


def traffic_by_report(hits: DataFrame, reports: DataFrame, now: str, days: int = 30) -> DataFrame:
    per_class = _window(hits, now, days).groupBy("tenant_id", "report_id", "agent_class").agg(F.count(F.lit(1)).alias("n"))
    human = F.col("agent_class") == "human"
    per = per_class.groupBy("tenant_id", "report_id").agg(
        F.coalesce(F.sum(F.when(human, F.col("n"))), F.lit(0)).alias("views"),
        F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(~human, F.struct(_crawler().alias("crawler"), "n")))))).alias("crawlers"))
    words = F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv])
    label = F.concat(F.when(F.col("period") == "fy", "").otherwise(F.concat(F.upper("period"), F.lit(" "))), F.lit("FY"),
                     F.col("fiscal_year").cast("string"), F.lit(" "), F.element_at(words, F.col("report_type")))
    named = reports.select("report_id", label.alias("label"))
    return per.join(named, "report_id", "left").withColumn("label", F.coalesce("label", F.lit("Site pages")))


def traffic_daily(hits: DataFrame, now: str, days: int = 30) -> DataFrame:
    human = F.col("agent_class") == "human"
    return (_window(hits, now, days).groupBy("tenant_id", F.to_date("at_ts").alias("day"))
            .agg(F.count_if(human).alias("views"), F.count_if(~human).alias("crawler_visits")))


def traffic_by_crawler(hits: DataFrame, now: str, days: int = 30) -> DataFrame:
    return (_window(hits, now, days).filter(F.col("agent_class") != "human").groupBy("tenant_id", _crawler().alias("crawler"))
            .agg(F.count(F.lit(1)).alias("visits")))
