"""Helpers shared by the operators: stored intermediate tables, row numbers over an order, text as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figtrail.session import checkpoint_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, under the shared folder that spark.checkpoint.dir names."""
    return f"{checkpoint_folder(spark).rstrip('/')}/figtrail/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet and read back: what follows does not compute it again, and a lost executor
    costs a read. Columns that a later step does not need are not read."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def part_of(key: Column, n: int) -> Column:
    """Remainder of the crc32 of the id's decimal text; null counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


#: Entries of a word cache of one Python worker; a full cache is emptied. A bound on memory, not on texts.
CACHED = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, one cache for all operators of a worker."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 0 over an order, as a column `row_no`. Rows are range partitioned by the order (repeated keys may
    fill several partitions), and each partition starts at the count of those before it, so no key has to fit in one
    task. The table is stored on the way; keep it narrow. One task sees one row per partition."""
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=schema.names)
            at += n

    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    rows = stored(ranged.mapInArrow(local, schema), name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part").withColumn("row_no", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
