"""Joins between words and boxes on a page.

A range join needs equality keys to be spread: report and page are given, and a horizontal band of the page is
added, so a dense page is several small joins. A word belongs to exactly one band (that of its centre); a box is
repeated once per band it reaches into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 36.0


def centre(lo: str, hi: str) -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def band_of(y: Column) -> Column:
    return F.floor(y / BAND)


def bands(y0: Column, y1: Column) -> Column:
    return F.explode(F.sequence(band_of(y0), band_of(y1)))


def words_in_boxes(words: DataFrame, boxes: DataFrame, pad: float, how: str = "inner", keys: tuple[str, ...] = ("report_id", "page")) -> DataFrame:
    """Words whose centre lies in a box, with padding. ``boxes`` carries x0..y1 as bx0..by1. ``how`` is inner, left_semi or left_anti."""
    k = list(keys)
    w = words.withColumns({"_xc": centre("x0", "x1"), "_yc": centre("y0", "y1")}).withColumn("_band", band_of(F.col("_yc")))
    b = boxes.withColumn("_band", bands(F.col("by0") - pad, F.col("by1") + pad))
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in [*k, "_band"]})
    cond = (F.col("_band") == F.col("_r__band"))
    for c in k:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    cond = (cond & (F.col("_xc") >= F.col("bx0") - pad) & (F.col("_xc") <= F.col("bx1") + pad)
            & (F.col("_yc") >= F.col("by0") - pad) & (F.col("_yc") <= F.col("by1") + pad))
    return w.join(right, cond, how).drop("_xc", "_yc", "_band", *[f"_r_{c}" for c in [*k, "_band"]])


def as_boxes(df: DataFrame, *carried: str) -> DataFrame:
    return df.select("report_id", "page", *carried, *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])


def in_reading_order(row: Column, x: Column, text: Column) -> Column:
    """Aggregate: the texts of a small group, by row then left to right."""
    return F.transform(F.array_sort(F.collect_list(F.struct(row.alias("r"), x.alias("x"), text.alias("t")))), lambda w: w["t"])
