"""Scoring extraction and detected metadata against what was expected (Q1–Q3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.functions.boxes import bands, centre
from figtrail.functions.text import core_of

PAD = 3.0


def match_truth(truth: DataFrame, figures: DataFrame) -> DataFrame:
    """truth: file, truth_no, page, raw, role, row_label, col_label, x0..y1; figures: file, page, fid, raw, row_label, col_label, x0..y1. Centre of
    either in the other's box, text contained, closest in length. Boxes meet through bands of the page; a pair that meets
    in two bands is kept once by the final aggregate."""
    t = truth.select("file", "truth_no", "page", core_of(F.col("raw")).alias("t_raw"), "role", F.col("row_label").alias("t_row"), F.col("col_label").alias("t_col"), *[F.col(c).alias("t" + c) for c in ("x0", "y0", "x1", "y1")]).withColumn("_b", bands(F.col("ty0") - PAD, F.col("ty1") + PAD))
    f = figures.select("file", "page", "fid", F.col("raw").alias("f_raw"), "row_label", "col_label", "x0", "y0", "x1", "y1").withColumn("_b", bands(F.col("y0") - PAD, F.col("y1") + PAD))

    def inside(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1):
        cx, cy = centre(ax0, ax1), centre(ay0, ay1)
        return (cx >= F.col(bx0) - PAD) & (cx <= F.col(bx1) + PAD) & (cy >= F.col(by0) - PAD) & (cy <= F.col(by1) + PAD)

    near = inside("x0", "y0", "x1", "y1", "tx0", "ty0", "tx1", "ty1") | inside("tx0", "ty0", "tx1", "ty1", "x0", "y0", "x1", "y1")
    same = F.contains("f_raw", "t_raw") | F.contains("t_raw", "f_raw")
    pairs = t.join(f, ["file", "page", "_b"]).filter(near & same)
    best = pairs.groupBy("file", "truth_no").agg(F.min_by(F.struct("fid", "f_raw", "row_label", "col_label"), F.struct(F.abs(F.length("f_raw") - F.length("t_raw")), F.col("fid"))).alias("m"))
    return t.drop("_b", "tx0", "ty0", "tx1", "ty1").distinct().join(best, ["file", "truth_no"], "left").select("file", "truth_no", "page", "t_raw", "role", "t_row", "t_col", F.col("m.fid").alias("fid"), F.col("m.f_raw").alias("f_raw"), F.col("m.row_label").alias("row_label"), F.col("m.col_label").alias("col_label"))


def _norm(c: str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\s]+", "")


def accuracy_scores(matches: DataFrame, figures: DataFrame) -> DataFrame:
    found = F.col("fid").isNotNull()
    exact = (F.col("t_raw") == F.col("f_raw")) | F.array_contains(F.split("f_raw", " "), F.col("t_raw"))
    cell = found & (F.col("role") == "cell")
    labels = (_norm("row_label") == _norm("t_row")) & (_norm("col_label") == _norm("t_col"))
    per = matches.groupBy("file").agg(F.count(F.lit(1)).alias("truth"), F.count_if(found).alias("found"), F.count_if(found & exact).alias("exact_n"), F.count_if(cell).alias("cells"), F.count_if(cell & labels).alias("cells_ok"))
    hit = figures.select("file", "fid").join(matches.filter(found).select("file", "fid").distinct(), ["file", "fid"], "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("hits"))
    total = figures.groupBy("file").agg(F.count(F.lit(1)).alias("extracted"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.bround(F.coalesce(a, F.lit(0)) / F.col(b), 6))
    return per.join(total, "file", "left").join(hit, "file", "left").select("file", "truth", "extracted", ratio(F.col("found"), "truth").alias("recall"), ratio(F.col("exact_n"), "found").alias("exact"), ratio(F.col("cells_ok"), "cells").alias("labels"), ratio(F.col("hits"), "extracted").alias("precision"))


def missed(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("fid").isNull()).select("file", "truth_no", "page", "t_raw", "role")


FIELDS = ["company", "year", "period", "type", "currency", "unit"]


def company_form(c: Column) -> Column:
    s = F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")), r"\bltd\b\.?", "limited")
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}_&']+", " "))


def metadata_accuracy(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """detected: file and one text column per field. expected: file, field, accepted array; "*" accepts all."""
    long = detected.select("file", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("got")) for f in FIELDS])).alias("x")).select("file", "x.field", "x.got")
    df = expected.join(long, ["file", "field"], "left")
    plain = F.coalesce(F.array_contains("accepted", F.col("got")), F.lit(False))
    named = F.array_contains(F.transform("accepted", company_form), company_form(F.col("got")))
    return df.withColumn("ok", F.array_contains("accepted", "*") | F.when(F.col("field") == "company", named).otherwise(plain)).select("file", "field", "got", "ok")


