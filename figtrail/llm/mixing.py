"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import numbered, stored

MAX_SOURCES = 10_000


def pfair_slots(weights: list[int]) -> list[tuple[int, int, int, int]]:
    """One period of the schedule, sum(weights) slots long: (slot, source, j, deadline) for the j-th block (from 0) of
    each source. Block j of a source with weight w of W is released at floor(j*W/w) and due by ceil((j+1)*W/w); each
    slot goes to the released block with the earliest deadline, of equal ones to the smaller source number. One slot at
    a time and weights that sum to W: no deadline is missed, so each source stays within one block of its share."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((slot, i, j, due))
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
    return out


def tempered_weights(counts: dict, power: float = 0.5, period: int = 1000) -> dict:
    """Whole-number weights proportional to count**power that sum to about `period`, at least 1 each."""
    total = sum(c ** power for c in counts.values())
    return {s: max(1, round(period * c ** power / total)) for s, c in counts.items()}


def mix_sources(docs: DataFrame, weights: dict | None = None, block_rows: int = 1, id_col: str = "doc_id", source_col: str = "source", power: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, the columns of `keep`, block (of its source, from 0), period, slot, deadline,
    position (from 0, without gaps). Ordered by position, the sources interleave at their target weights.

    Blocks are `block_rows` documents of a source in ascending id. The schedule of one period is laid out once (its
    length is the sum of the weights, whatever the data) and repeats; within it each source is less than one block away
    from its share. A source that is used up leaves its slots empty, so the others go on at their mutual weights and
    every document is placed once. Weights default to count**power of each source; a source missing from `weights` gets 1.

    Null sources are a source of their own, null ids come first in it, repeated rows take one place each. An empty table
    gives an empty result. The driver holds one row per source, at most MAX_SOURCES. Rows are numbered by range
    partitions, so a source of any size is spread over many tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *keep)
    spark = docs.sparkSession
    counted = rows.groupBy("source").count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts = {r["source"]: r["count"] for r in counted}
    own = tempered_weights(counts, power) if weights is None else {s: int(weights.get(s, 1)) for s in counts}
    if any(w < 1 for w in own.values()):
        raise ValueError("weights are whole numbers of 1 or more")
    names = sorted(own, key=lambda s: (s is None, s))
    slots = pfair_slots([own[s] for s in names]) if names else []
    plan = spark.createDataFrame([(names[i], j, slot, d) for slot, i, j, d in slots], "_p string, _k long, slot long, deadline long")
    starts = [sum(counts[s] for s in names[:k]) for k in range(len(names))]
    shares = spark.createDataFrame([(s, own[s], at) for s, at in zip(names, starts, strict=True)], "_s string, _w long, _first long")
    # both small tables hold one row per source or slot of a period, which MAX_SOURCES and the weights bound
    ranked = numbered(rows, [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first()], "mix-ranks")
    timed = ranked.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_no", F.col("row_no") - F.col("_first"))
    timed = timed.withColumn("block", F.floor(F.col("_no") / block_rows).cast("long"))
    timed = timed.withColumn("period", F.floor(F.col("block") / F.col("_w")).cast("long")).withColumn("_j", F.pmod("block", "_w"))
    timed = timed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_p")) & (F.col("_j") == F.col("_k")))
    timed = timed.select("doc_id", "source", *keep, "block", "period", "slot", "deadline", "_no")
    placed = numbered(timed, [F.col("period"), F.col("slot"), F.col("_no")], "mix-places")
    return placed.withColumnRenamed("row_no", "position").drop("_no")


def in_mixed_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, all columns kept, range partitioned and sorted by position, so that files written from it hold
    the mixture in order. Rows with a repeated id take the first position of that id; rows with a null id stand last."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain, key = docs.toDF(*inner), inner[docs.columns.index(id_col)]
    first = mixed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("position").alias("_position"))
    placed = plain.join(first, F.col(key).cast("long") == F.col("doc_id"), "left")
    order = F.col("_position").asc_nulls_last()
    return placed.repartitionByRange(order).sortWithinPartitions(order).select(*inner).toDF(*docs.columns)
