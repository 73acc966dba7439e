"""Ordered scans that do not need one task per group, in one pass over their input.

A running count, sum or last value over a group is normally a window over that group, which puts a hot group
into one task. Here the group is cut into blocks of its own order (a page range, a day, a row range): the scan
runs inside each block and is written once, one small row per block is read off it and scanned over the group, and
blocks that have something before them are given what that is. Exact; the input is read once, scans that follow
one another do not repeat those before, and the largest task is one block or one group's block list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figtrail.session import cut

_NO_ROWS_BEFORE = W.unboundedPreceding, -1
_NO_ROWS_AFTER = 1, W.unboundedFollowing


def _in_blocks(df: DataFrame, keys: list[str], block: str | Column, order: list, local: Column, frame: tuple[int, int] | None) -> DataFrame:
    df = df.withColumn("_block", block if isinstance(block, Column) else F.col(block))
    w = W.partitionBy(*keys, "_block").orderBy(*order)
    return cut(df.withColumn("_local", local.over(w.rowsBetween(*frame) if frame else w)))


def _carried(local: DataFrame, keys: list[str], top: Column, scan: Column, frame: tuple[int, int], combine: Column, out: str) -> DataFrame:
    """Blocks that inherit something, given to their rows. Groups of one block, the usual case, meet an empty side."""
    w = W.partitionBy(*keys).orderBy("_block").rowsBetween(*frame)
    tops = local.groupBy(*keys, "_block").agg(top.alias("_top"))
    inherited = tops.withColumn("_carry", scan.over(w)).filter(F.col("_carry").isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k__block"), "_carry")
    on = F.lit(True)
    for k in [*keys, "_block"]:
        on = on & local[k].eqNullSafe(inherited[f"_k_{k}"])
    return local.join(inherited, on, "left").withColumn(out, combine).drop("_block", "_local", "_carry", *[f"_k_{k}" for k in [*keys, "_block"]])


def numbered(df: DataFrame, keys: list[str], block: str | Column, order: list, out: str = "n") -> DataFrame:
    """row_number within keys, where ``block`` never decreases along ``order``."""
    local = _in_blocks(df, keys, block, order, F.row_number(), None)
    whole = (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("bigint")
    return _carried(local, keys, F.max("_local"), F.sum("_top"), _NO_ROWS_BEFORE, whole, out)


def running_sum(df: DataFrame, keys: list[str], block: str | Column, order: list, value: str, out: str,
                inclusive: bool = True) -> DataFrame:
    local = _in_blocks(df, keys, block, order, F.sum(value), (W.unboundedPreceding, 0 if inclusive else -1))
    zero = F.lit(0)
    return _carried(local, keys, F.sum(value), F.sum("_top"), _NO_ROWS_BEFORE, F.coalesce("_local", zero) + F.coalesce("_carry", zero), out)


def carried_sum(local: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """For rows that were scanned and added up per block by the caller, and cut (``_block``, and ``_local``, the sum before a row
    inside its block): ``out`` is that sum over the whole group. ``value`` adds up to what a block brings."""
    return _carried(local, keys, F.sum(value), F.sum("_top"), _NO_ROWS_BEFORE, F.col("_local") + F.coalesce("_carry", F.lit(0)), out)


def running_max(df: DataFrame, keys: list[str], block: str | Column, order: list, value: str, out: str) -> DataFrame:
    local = _in_blocks(df, keys, block, order, F.max(value), (W.unboundedPreceding, 0))
    return _carried(local, keys, F.max("_local"), F.max("_top"), _NO_ROWS_BEFORE, F.greatest("_local", "_carry"), out)


def last_seen(df: DataFrame, keys: list[str], block: str | Column, order: list[str], value: str, out: str,
              inclusive: bool = True) -> DataFrame:
    """The last non-null ``value`` at (or, exclusive, before) each row, along ascending ``order``."""
    local = _in_blocks(df, keys, block, order, F.last(value, ignorenulls=True), (W.unboundedPreceding, 0 if inclusive else -1))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _carried(local, keys, newest, F.last("_top", ignorenulls=True), _NO_ROWS_BEFORE, F.coalesce("_local", "_carry"), out)


def first_seen_after(df: DataFrame, keys: list[str], block: str | Column, order: list[str], value: str, out: str,
                     inclusive: bool = False) -> DataFrame:
    """The first non-null ``value`` after (or at) each row, along ascending ``order``."""
    local = _in_blocks(df, keys, block, order, F.first(value, ignorenulls=True), (0 if inclusive else 1, W.unboundedFollowing))
    oldest = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return _carried(local, keys, oldest, F.first("_top", ignorenulls=True), _NO_ROWS_AFTER, F.coalesce("_local", "_carry"), out)
