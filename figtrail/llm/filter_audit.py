"""Filter interaction audit: what each filter of a chain removes, in every order the filters can be applied in.

A document is a mask of the filters it fails. Masks are counted per part, each cell (part, mask) is folded across all
orders by higher-order functions, and the cells of a part, 2**filters at most, are added element by element."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.functions.text import once
from figtrail.llm.common import stored

FILTERS = "ABCDE"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
_STEP = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def words_of(text: Column) -> Column:
    """Runs without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions that a text and its words decide."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def failing_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Cells of the audit: part, mask (bit i: fails filter i of FILTERS), n, good, toxic.

    A null text counts as empty, a null part as the empty string. Filter E fails a document whose whole text stands
    under a smaller id, wherever in the table; texts are compared by SHA-256. Rows that repeat an id and its text are
    counted each, and none of them is the smaller one; rows without an id never fail E and make no other row fail. A
    document is good (toxic) when any of its labels says so; repeated and unknown labels change nothing else.

    Only (id, part, digest, mask) is shuffled: by id to meet the labels, by digest to find the smallest id of each text
    (combined before the shuffle, so a text that a third of all rows share is one row per task), and by (digest, id) to
    find the rows that hold it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = text_failures(F.col("_text"), F.col("_words"))
    bits = sum((F.when(failed[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS) if f in failed), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = once(rows, {"_words": words_of(F.col("_text"))}).select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), bits.alias("_mask"))
    # repeated rows are one row with a count, so that no id is a hot key below
    rows = stored(rows.groupBy("_id", "part", "_digest", "_mask").agg(F.count("*").alias("n")), "audit-rows")
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_lid")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int").alias("_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int").alias("_toxic"))
    first = rows.where("_id IS NOT NULL").groupBy(F.col("_digest").alias("_d")).agg(F.min("_id").alias("_first"))
    joined = rows.where("_id IS NOT NULL").join(first, (F.col("_digest") == F.col("_d")) & (F.col("_id") == F.col("_first")), "left")
    repeated = F.when(F.col("_first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    known = joined.select("_id", "part", (F.col("_mask") + repeated).alias("mask"), "n")
    known = known.join(marked, F.col("_id") == F.col("_lid"), "left").select("part", "mask", "n", F.coalesce("_good", F.lit(0)).alias("_g"), F.coalesce("_toxic", F.lit(0)).alias("_t"))
    nameless = rows.where("_id IS NULL").select("part", F.col("_mask").alias("mask"), "n", F.lit(0).alias("_g"), F.lit(0).alias("_t"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_g")).alias("good"), F.sum(F.col("n") * F.col("_t")).alias("toxic"))


def _folded(cell: Column, orders: Column) -> Column:
    """What one cell adds to every step of every order: its rows walk through the order and leave at the first filter
    that they fail."""
    nothing = F.array().cast(f"array<{_STEP}>")
    weight = lambda condition, value: F.when(condition, value).otherwise(F.lit(0)).cast("bigint")

    def walk(order: Column) -> Column:
        def step(state: Column, filter_bit: Column) -> Column:
            bit = cell["mask"].bitwiseAND(filter_bit) != 0
            leaves = state["inside"] & bit
            values = {"kept": weight(state["inside"] & ~bit, cell["n"]), "removed": weight(leaves, cell["n"]), "redundant": weight(~state["inside"] & bit, cell["n"]),
                      "unique_fails": weight(bit & (F.bit_count(cell["mask"]) == 1), cell["n"]), "good_lost": weight(leaves, cell["good"]), "toxic_lost": weight(leaves, cell["toxic"])}
            return F.struct((state["inside"] & ~bit).alias("inside"), F.concat(state["steps"], F.array(F.struct(*[values[m].alias(m) for m in MEASURES]))).alias("steps"))

        return F.aggregate(order, F.struct(F.lit(True).alias("inside"), nothing.alias("steps")), step, lambda s: s["steps"])

    return F.flatten(F.transform(orders, walk))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step (from 1): the measures of that step and the Shapley total of its filter, the
    rows it removes summed over all orders. `cells` holds part, mask, n, good, toxic; a part has 2**filters cells at
    most, which are added in one row. Steps at which nothing happens are there with zeros; an empty table has no part."""
    k = len(filters)
    names = F.split(F.lit(",".join("".join(p) for p in permutations(filters))), ",")
    letter_no = lambda name, step: F.instr(F.lit(filters), F.substring(name, step, F.lit(1)))
    steps = F.sequence(F.lit(1), F.lit(k))
    bits = F.array(*[F.lit(1 << i) for i in range(k)])
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("bigint").alias(m) for m in MEASURES]), factorial(k) * k)
    add = lambda a, b: F.struct(*[(a[m] + b[m]).alias(m) for m in MEASURES])
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_cells"))
    # each stage is worked out once per part: a plain column would be merged into, and repeated by, what reads it
    rows = once(parts, {"_places": F.flatten(F.transform(names, lambda name: F.transform(steps, lambda s: F.struct(name.alias("filter_order"), s.alias("step"), letter_no(name, s).alias("no"))))),
                        "_orders": F.transform(names, lambda name: F.transform(steps, lambda s: F.element_at(bits, letter_no(name, s))))})
    rows = once(rows, {"_steps": F.aggregate("_cells", zeros, lambda acc, c: F.zip_with(acc, _folded(c, F.col("_orders")), add))})
    rows = once(rows, {"_rows": F.arrays_zip(F.col("_places").alias("place"), F.col("_steps").alias("at"))})
    none = F.lit(0).cast("bigint")
    share = F.transform(steps, lambda i: F.aggregate("_rows", none, lambda s, r: s + F.when(r["place"]["no"] == i, r["at"]["removed"]).otherwise(none)))
    rows = once(rows.select("part", "_rows"), {"_shapley": share})
    flat = F.transform("_rows", lambda r: F.struct(r["place"]["filter_order"].alias("filter_order"), r["place"]["step"].alias("step"), *[r["at"][m].alias(m) for m in MEASURES],
                                                   F.element_at("_shapley", r["place"]["no"]).alias("shapley")))
    return rows.select("part", F.inline(flat))


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of the five filters over whole documents: interactions() of failing_documents(), where the cases of
    null, empty, repeated and very long rows are stated. Other columns are ignored; an empty table gives an empty result."""
    return interactions(failing_documents(docs, labels, id_col, text_col, part_col))
