"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes, part_of, word_hashes

DIMENSIONS = 1 << 18
#: At most about this many labelled documents train the model: a bound on the fit, not on what is scored.
SAMPLE = 20_000
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.5


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: hashed words and word pairs, square roots of counts, scaled to length 1. Words are the
    text lower-cased for A-Z and split at white space; whether they were upper case is kept by hashing the raw words
    too. A text without words has the bias alone (slot 0)."""
    raw = word_hashes(text.split())
    low = word_hashes(text.lower().split())
    pairs = low[:-1] * np.uint64(0x85EBCA6B) + low[1:] * np.uint64(0xC2B2AE35)
    keys = np.concatenate([low, pairs ^ (pairs >> np.uint64(29)), raw + np.uint64(0x51ED2701)])
    keys = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
    slots, n = np.unique(keys.astype(np.int64), return_counts=True)
    values = np.sqrt(n)
    norm = np.sqrt((values * values).sum())
    return np.append(slots, DIMENSIONS), np.append(values / norm if norm else values, 1.0)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_shard(rows: list[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    """One pass per epoch in the order given. Each class carries half of the loss, so a rare class counts."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    ones = sum(y for _, y in rows)
    weight = {1: len(rows) / (2 * max(ones, 1)), 0: len(rows) / (2 * max(len(rows) - ones, 1))}
    cached = [(*features(t), y) for t, y in rows]
    for _ in range(epochs):
        for slots, x, y in cached:
            w = _weights(z[slots], n[slots])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight[y] * (p - y) * x
            s = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - s * w
            n[slots] += g * g
    return _weights(z, n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights by slot. Learns from labelled rows whose crc32(id) mod 3 is not 1, from at most about `sample` of them
    (taken by a hash of the id; the one table that is broadcast), dealt over SHARDS tasks by hash; the shards' weights are averaged in Spark. The driver
    receives DIMENSIONS numbers at most. Rows without a label, text or id teach nothing; of repeated labels of one id
    the largest counts. Without any labelled row all weights are 0 and every score is 0.5."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1) AND _id IS NOT NULL")
    known = known.where(part_of(F.col("_id"), 3) != 1).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    n = known.count()
    mixed = F.xxhash64("_id", F.lit(7))
    chosen = known.where(F.pmod(mixed, F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(n, 1)))))
    rows = texts.join(F.broadcast(chosen), "_id").withColumn("_mixed", mixed).withColumn("_shard", F.pmod(F.shiftrightunsigned("_mixed", 20), F.lit(SHARDS)))

    def train(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(m, i, t, y) for b in batches for m, i, t, y in zip(b.column("_mixed").to_pylist(), b.column("_id").to_pylist(), as_bytes(b.column("_text")), b.column("_y").to_pylist(), strict=True)]
        data.sort()
        w = fit_shard([(t, y) for *_, t, y in data])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64())})

    shards = rows.groupBy("_shard").applyInArrow(train, "slot long, w double")
    total = shards.groupBy("slot").agg((F.sum("w") / SHARDS).alias("w")).toArrow()
    w = np.zeros(DIMENSIONS + 1)
    w[total["slot"].to_numpy()] = total["w"].to_numpy()
    return w


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score (a sparse dot product through the logistic function), predicted; with `keep`, those
    columns and the score instead. Texts are read whole; a null text is scored like an empty one, by the bias alone.
    Null and repeated ids are scored row by row (a null id is never held out)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS + 1 numbers, whatever the data

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            raw = np.array([w[s] @ x for s, x in map(features, as_bytes(b.column("_text")))], float)
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*b.schema.names[:-1], "score"])

    if keep is not None:
        inner = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
        return inner.mapInArrow(dot, f"_row {inner.schema['_row'].dataType.simpleString()}, score double")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (part_of(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("_text"))
    scored = rows.mapInArrow(dot, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
