"""A training corpus in five stages: quality, exact duplicates, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from figtrail.llm import exact_dedup, mixing, near_dedup, packing, quality
from figtrail.llm.common import stored, table
from figtrail.llm.queries import SEQUENCE, TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.5 or more, every column kept. An empty text is judged by the bias alone."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, keep=docs.columns).where("score >= 0.5").select("_row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order that interleaves the sources at their target weights. Files are no order to
    build on: packing derives the positions again from the same documents."""
    return mixing.in_mixed_order(docs, mixing.mix_sources(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its sequence and place. Sequences are filled and numbered in mixed order, so each
    range of sequence_id holds the sources at their target weights for as long as they last."""
    pieces = stored(packing.token_pieces(docs, TOKENIZER, end_id=0, capacity=SEQUENCE, source_col="source"), "corpus-pieces")
    mixed = mixing.mix_sources(pieces.where("piece = 0"), keep=("row_key",))
    return packing.pack_in_order(pieces.drop("source").join(mixed.select("row_key", "position"), "row_key"), SEQUENCE)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_content),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Trained scores and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
