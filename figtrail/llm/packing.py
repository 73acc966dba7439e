"""Best-fit packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import CACHED, as_bytes, numbered, stored
from figtrail.llm.encode import encoder

SHARD_BITS = 32
#: Words and pieces in each half of the caches: workers that pack have run the stages before and hold their caches too.
HELD = CACHED // 2


class BestFit:
    """Bounded-space online best fit. Open bins hang on lists by free space, and a bitset (one Python integer) marks the
    free spaces that have a bin: the tightest fit is the lowest set bit at or above the piece's length. When a new bin
    would be one too many, the fullest open bin (the lowest set bit) closes."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return one

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the place in it."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            one, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(one)
            self.n_open += 1
        return one, self.capacity - free


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and row_key, which tells rows with one id apart; with a
    `source_col` also source, of the document. A
    document is its ids with the end id behind; only one longer than `capacity` is cut. Null texts count as empty and
    hold the end id alone; null and repeated ids are kept as they are."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, HELD)
        for b in batches:
            out: list[tuple] = []
            for doc, key, text, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    out.append((doc, key, no, at // 4, len(own) // 4, zlib.crc32(own), source))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "source"])

    keyed = docs.select(F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_key"), F.col(text_col).alias("_text"), (F.col(source_col) if source_col else F.lit(None)).cast("string").alias("_source"))
    pieces = keyed.mapInArrow(cut, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, source string")
    return pieces if source_col else pieces.drop("source")


def _packed(items: DataFrame, n: int, shards: int, capacity: int, open_bins: int, ordered: bool = False) -> DataFrame:
    """items: item, length, and position where they are ordered by it, else they are dealt by hash. Returns item, bin,
    place, length and, of ordered ones, position."""
    n_shards, extra = max(1, shards), ["position"] if ordered else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, fit = TaskContext.get().partitionId() << SHARD_BITS, BestFit(capacity, open_bins)
        names = ["item", "bin", "place", "length", *extra]
        for b in batches:
            lengths = b.column("length").to_pylist()
            got = [fit.place(x) for x in lengths]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array([base + x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64()), b.column("length"), *[b.column(c) for c in extra]], names=names)

    kind = items.schema["item"].dataType.simpleString()
    out = f"item {kind}, bin long, place long, length long"
    if ordered:
        return items.repartitionByRange(n_shards, "position", "item").sortWithinPartitions("position", "item").mapInArrow(pack, f"{out}, position long")
    mixed = F.xxhash64("item")
    return items.repartition(n_shards, mixed).sortWithinPartitions(mixed, "item").mapInArrow(pack, out)


def pack(pieces: DataFrame, capacity: int, open_bins: int = 4096, shard_items: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to pieces. Pieces are dealt by hash over shards of about `shard_items` (a third of all
    rows from one source spreads like any other), each packed in one pass with at most `open_bins` open bins. Bins of
    the first pass that are not full are packed again as items of their own length in a second pass, so the number of
    shards costs little. Every piece is placed; a piece is never longer than `capacity`. An empty table gives none."""
    pieces = stored(pieces, "pieces")
    item = F.struct("row_key", "piece").alias("item")
    n = pieces.count()
    first = stored(_packed(pieces.select(item, "length"), n, -(-n // shard_items), capacity, open_bins), "packed")
    fill = first.groupBy("bin").agg(F.sum("length").alias("length")).where(F.col("length") < capacity).withColumnRenamed("bin", "item")
    fill = stored(fill, "open-bins")
    left = fill.count()
    second = _packed(fill, left, -(-left // shard_items), capacity, open_bins).select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("place").alias("_at"))
    placed = first.join(second, "bin", "left")
    # ids of the second pass stand above those of the first
    placed = placed.select("item.row_key", "item.piece", F.coalesce(F.col("_to") + F.lit(1 << 62), F.col("bin")).alias("sequence_id"), (F.col("place") + F.coalesce(F.col("_at"), F.lit(0))).alias("offset"))
    return pieces.join(placed, ["row_key", "piece"]).drop("row_key")


def pack_in_order(pieces: DataFrame, capacity: int, open_bins: int = 512, shard_items: int = 250_000) -> DataFrame:
    """As pack, of pieces with a `position`: sequences are filled in ascending position and numbered without gaps from 0 by
    the first position in them, so what holds of prefixes of the order holds of prefixes of sequence_id.

    Shards are ranges of positions, and the second pass takes the bins left open in the order of their first positions. A
    piece is at most the open bins away from its place in the order, hence fewer of them than in pack."""
    pieces = stored(pieces, "pieces")
    n = pieces.count()
    items = pieces.select(F.struct("row_key", "piece").alias("item"), "length", "position")
    first = stored(_packed(items, n, -(-n // shard_items), capacity, open_bins, ordered=True), "packed")
    bins = stored(first.groupBy(F.col("bin").alias("item")).agg(F.sum("length").alias("length"), F.min("position").alias("position")), "bins")
    fill = bins.where(F.col("length") < capacity)
    left = fill.count()
    second = _packed(fill, left, -(-left // shard_items), capacity, open_bins, ordered=True).select("item", (F.col("bin") + F.lit(1 << 62)).alias("_to"), F.col("place").alias("_at"))
    merged = bins.join(second, "item", "left").select(F.col("item").alias("bin"), F.coalesce("_to", "item").alias("_bin"), F.coalesce("_at", F.lit(0)).alias("_at"), "position")
    merged = stored(merged, "merged-bins")
    named = numbered(merged.groupBy("_bin").agg(F.min("position").alias("position")), [F.col("position"), F.col("_bin")], "sequences")
    homes = merged.select("bin", "_bin", "_at").join(named.select("_bin", F.col("row_no").alias("sequence_id")), "_bin").drop("_bin")
    placed = first.select("item.row_key", "item.piece", "bin", "place").join(homes, "bin")
    placed = placed.select("row_key", "piece", "sequence_id", (F.col("place") + F.col("_at")).alias("offset"))
    return pieces.join(placed, ["row_key", "piece"]).drop("row_key", "position")
