"""Exact duplicates by sorting content: texts are range partitioned by their normalised bytes with sampled splitters
(which need no more than a text's start and digest), sorted inside each partition, and each row is compared in full with
its neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figtrail.llm.common import as_bytes, ascii_lower, stored

FIRST, LAST, ONLY = 0, 1, 2


def _sorted(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The order is the text's first characters, its SHA-256 and the id: splitters that the driver samples stay short, and
    a group of copies may fill several partitions."""
    text = docs.select(F.col(id_col).cast("long").alias("_id"), ascii_lower(F.col(text_col)).alias("_text"), F.monotonically_increasing_id().alias("_tie"), *([F.struct(*carry).alias("_row")] if carry else []))
    keyed = text.withColumn("_start", F.substring("_text", 1, 32)).withColumn("_sha", F.sha2("_text", 256))
    order = [F.col("_start"), F.col("_sha"), F.col("_id").desc_nulls_last(), F.col("_tie")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text", "_sha", *(["_row"] if carry else []))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its run in this partition, the run's first id and size. Runs that touch an end of the
    partition are marked and carry their text once, so that they can be compared with the neighbour partition's."""
    part, ids, text, sha, first = TaskContext.get().partitionId(), [], None, None, True
    rows: list[tuple] = []

    def close(edge: int | None) -> None:
        for i, one in enumerate(ids):
            rows.append((one, ids[0], len(ids), i == 0, sha, part, edge, text if edge is not None and i == 0 else None))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)
        rows.clear()
        return out

    for b in batches:
        for one, now, digest in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
            if text is not None and now == text:
                ids.append(one)
                continue
            if text is not None:
                close(FIRST if first else None)
                first = False
            text, sha, ids = now, digest, [one]
        if rows:
            yield flush()
    if text is not None:
        close(ONLY if first else LAST)
        yield flush()


_NAMES = ["doc_id", "keep_id", "group_size", "head", "text_sha256", "part", "edge", "text"]
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
_RUNS = T.StructType([T.StructField(n, t) for n, t in zip(_NAMES, [T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.BinaryType()], strict=True)])


def _chained(edges: DataFrame) -> DataFrame:
    """Joins the runs at partition ends into chains of equal texts: (part, edge, chain, opens). The two windows hold at
    most two rows of three integers per partition; texts are compared in a join of neighbours."""
    ends = edges.select("part", "edge", F.row_number().over(Window.orderBy("part", "edge")).alias("seq"))
    texts = edges.join(ends, ["part", "edge"])
    before = texts.select((F.col("seq") + 1).alias("seq"), F.col("text").alias("_before"))
    opens = texts.join(before, "seq", "left").select("part", "edge", "seq", F.coalesce(F.col("text") != F.col("_before"), F.lit(True)).alias("opens"))
    return opens.select("part", "edge", "opens", F.sum(F.col("opens").cast("long")).over(Window.orderBy("seq")).alias("chain"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after
    lower-casing A-Z; the largest id of a group stays.

    Null texts count as empty, so all empty texts are one group. A null id is smaller than any other; a group without
    any id keeps one row with keep_id null. Of repeated rows with the same id and text one stays. Other columns are
    ignored. An empty table gives an empty result. A task holds one partition's ids of one run: the order by (text,
    id) lets a group of any size fill as many partitions as it needs."""
    rows = stored(_sorted(docs, id_col, text_col, []).mapInArrow(_runs, _RUNS), "exact-runs")
    inner = rows.where("edge IS NULL").select("doc_id", "keep_id", "group_size", F.col("head").alias("kept"), "text_sha256")
    edges = rows.where("text IS NOT NULL").select("part", "edge", "text", "keep_id", "group_size")
    chains = stored(_chained(edges.select("part", "edge", "text")).join(edges.drop("text"), ["part", "edge"]), "exact-chains")
    whole = chains.groupBy("chain").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    ends = chains.select("part", "edge", "chain", "opens").join(whole, "chain")
    outer = (rows.where("edge IS NOT NULL").select("doc_id", "head", "text_sha256", "part", "edge").join(ends, ["part", "edge"])
             .select("doc_id", "keep_id", "group_size", (F.col("head") & F.col("opens")).alias("kept"), "text_sha256"))
    return inner.unionByName(outer)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_duplicates keeps, with all their columns whatever their names. The rows travel with the sort
    and are not joined back by id."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    ids, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    rows = _sorted(plain, ids, text, inner)
    schema = T.StructType([T.StructField("row", rows.schema["_row"].dataType), T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("text", T.BinaryType())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text, first, pending = TaskContext.get().partitionId(), None, True, None

        def out(row: pa.Array, edge: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([row, pa.array([part] * len(row), pa.int32()), pa.array(edge, pa.int32()), pa.array(texts, pa.binary())], names=["row", "part", "edge", "text"])

        for b in batches:
            texts, at = as_bytes(b.column(1)), []
            for i, now in enumerate(texts):
                if text is None or now != text:
                    at.append(i)
                    text = now
            if not at:
                continue
            if pending is not None:
                yield out(pending[0], [FIRST if first else None], [pending[1] if first else None])
                first = False
            row, done = b.column(3), at[:-1]
            if done:
                yield out(row.take(pa.array(done)), [FIRST if first and i == 0 else None for i in range(len(done))], [texts[x] if first and i == 0 else None for i, x in enumerate(done)])
                first = False
            pending = (row.take(pa.array(at[-1:])), texts[at[-1]])
        if pending is not None:
            yield out(pending[0], [ONLY if first else LAST], [pending[1]])

    found = stored(rows.mapInArrow(heads, schema), "exact-heads")
    opens = _chained(found.where("edge IS NOT NULL").select("part", "edge", "text")).where("opens").select("part", "edge")
    kept = found.where("edge IS NULL").select("row").unionByName(found.where("edge IS NOT NULL").join(opens, ["part", "edge"], "left_semi").select("row"))
    return kept.select("row.*").toDF(*docs.columns)
