"""Near-duplicate texts: ProbMinHash signatures of the sets of word shingles, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes, stored, word_hashes
from figtrail.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 6: two texts of similarity 0.8 share no band once in 17,000, of 0.85 once in 4 million.
BANDS, ROWS = 32, 6
ROUNDS = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of `words` words, repeats included; a shorter text is one shingle of all its words, a
    text without words has none. Words: A-Z lower-cased, split at white space."""
    h = word_hashes(text.lower().split())
    n = min(words, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
    return _mix(out + np.uint64(n))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of n weighted sets at once. Each element is a Poisson process whose rate is its weight: its
    arrivals, exponential gaps apart, fall on random slots, and a slot keeps the element that came first. All elements
    advance by one arrival per round; an element whose arrival is later than every slot of its set can change nothing
    more and stops, which ends a large set after one or two rounds. Two sets agree in a slot with the probability of
    their probability Jaccard similarity."""
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, step = np.zeros(len(elements)), 0
    while len(elements):
        step += 1
        draw = _mix(elements + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((draw >> np.uint64(12)).astype(float) + 1) * 2.0 ** -52)
        time = time + gap / weights
        slot = owner * m + (_mix(draw + np.uint64(1)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        kept[slot[won]] = elements[won]
        alive = time < first.reshape(n, m).max(1)[owner]
        elements, weights, owner, time = elements[alive], weights[alive], owner[alive], time[alive]
    return kept.reshape(n, m)


def band_keys(texts: list[bytes], bands: int, rows: int, words: int = WORDS) -> np.ndarray:
    """(texts, bands) 64-bit keys; texts without words get none of their own and are all 0. Each distinct shingle weighs 1:
    slots then agree with the probability of the set Jaccard similarity that links are verified by, however often a text
    repeats a line."""
    owners, elements, weights = [], [], []
    for i, t in enumerate(texts):
        e = np.unique(shingles(t, words))
        owners.append(np.full(len(e), i))
        elements.append(e)
        weights.append(np.ones(len(e)))
    m = bands * rows
    got = prob_minhash(np.concatenate(elements), np.concatenate(weights), np.concatenate(owners), len(texts), m) if texts else np.zeros((0, m), np.uint64)
    keys = np.zeros((len(texts), bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + got[:, r::rows])
    return _mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return 0.0
    joint = np.concatenate([a, b])
    joint.sort(kind="stable")
    common = int(np.count_nonzero(joint[1:] == joint[:-1]))
    return common / (both - common)


def _content(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """Per row: id, node (128-bit hash of the words), keys of the bands, n_words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), as_bytes(batch.column(1))
            lo = 0
            while lo < len(column):
                hi, size = lo, 0
                while hi < len(column) and (hi == lo or size < 1 << 20):
                    size += len(column[hi])
                    hi += 1
                texts = column[lo:hi]
                split = [t.lower().split() for t in texts]
                keys = band_keys(texts, bands, rows)
                node = [xxhash.xxh3_128_digest(b" ".join(w)) for w in split]
                lists = pa.ListArray.from_arrays(np.arange(0, (len(texts) + 1) * bands, bands, dtype="i4"), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(node, pa.binary()), pa.array([len(w) for w in split], pa.int64()), lists], names=["doc_id", "node", "n_words", "bands"])
                lo = hi

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows_in.mapInArrow(sign, "doc_id long, node binary, n_words long, bands array<long>")


def _verified(pairs: DataFrame, docs_text: DataFrame, similarity: float, name: str) -> DataFrame:
    """pairs (a, b) of nodes with both texts read whole: those whose shingle sets have the similarity, exactly."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for x, y, s, t in zip(a, b, as_bytes(batch.column("ta")), as_bytes(batch.column("tb")), strict=True):
                if len(recent) > 64:
                    recent.clear()
                if y not in recent:
                    recent[y] = np.unique(shingles(t))
                ok.append(jaccard(np.unique(shingles(s)), recent[y]) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(docs_text.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a")
    both = left.join(docs_text.select(F.col("node").alias("b"), F.col("_text").alias("tb")), "b")
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(judge, "a binary, b binary"), name)


def _compared(members: DataFrame, texts: DataFrame, similarity: float, block: int, name: str) -> DataFrame:
    """Exact rest: members (key, node, comp) of bands that still hold several components. Members of a band are dealt over
    blocks; each pair of blocks meets in one task, which compares what is not yet in one component and returns one link
    per join. A band of any size is spread over tasks of at most two blocks."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("second"), "node", "comp")
    rows = dealt.join(texts, "node")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, comps, sets, second = [], [], [], []
        for b in batches:
            nodes += b.column("node").to_pylist()
            comps += b.column("comp").to_pylist()
            second += b.column("second").to_pylist()
            sets += [np.unique(shingles(t)) for t in as_bytes(b.column("_text"))]
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        label = np.array([number[c] for c in comps], int)
        side, same, found = np.array(second, bool), key[1].as_py() == key[2].as_py(), []
        for i in range(len(nodes)):
            others = np.arange(i + 1, len(nodes)) if same else np.flatnonzero(side != side[i])
            if not same and side[i]:
                continue
            for j in others:
                if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                    found.append((nodes[i], nodes[j]))
                    label[label == label[j]] = label[i]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    kept = rows.select("key", "one", "two", "second", "node", "comp", "_text").groupBy("key", "one", "two")
    return stored(kept.applyInArrow(compare, "a binary, b binary"), name)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of the texts reachable by links), kept. Two texts are linked
    when the sets of their five-word shingles have a Jaccard similarity of `similarity` or more and they share a band.

    Texts of the same words are one node, so copies are not compared. In each band with several nodes every node is first
    compared with the band's anchor, the node that shares most with others; that settles a group of near copies in as
    many comparisons as it has members. Bands that then still hold more than one component go through a second anchor,
    and what is left is compared pair by pair inside the band, in blocks. No link inside a band is lost.

    Null and empty texts have no shingle: each is a class of its own. Texts shorter than five words are one shingle. A
    null id never names a class that has another id. Repeated rows of one id share its decision. Other columns are
    ignored; an empty table gives an empty result."""
    content = stored(_content(docs, id_col, text_col, bands, rows), "near-content")
    worded = content.where("n_words > 0")
    nodes = worded.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    keyed = worded.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(keyed.join(several, "key"), "near-bands")
    popular = shared.groupBy("node").agg(F.sum("size").alias("pop"))
    shared = stored(shared.join(popular, "node").select("key", "node", "pop", "size"), "near-popular")

    needed = popular.select("node").join(nodes, "node").select("node", "id")
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("_text"))
            yield b.filter(pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) == n for t, n in zip(texts, b.column("node").to_pylist(), strict=True)], pa.bool_()))

    fetched = plain.join(needed.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id"))).select("node", "_text")
    texts = stored(fetched.mapInArrow(own, "node binary, _text string"), "near-texts")

    links = None
    members = shared.withColumn("comp", F.col("node")).withColumn("last", F.lit(None).cast("binary"))
    for step in range(ROUNDS):
        # the anchor of each round stands outside the component of the one before
        ranked = members.where("last IS NULL OR comp != last").groupBy("key").agg(F.max(F.struct("pop", "node", "comp")).alias("top"))
        anchors = ranked.select("key", F.col("top.node").alias("anchor"), F.col("top.comp").alias("anchor_comp"))
        met = members.join(anchors, "key")
        pairs = met.where("node != anchor AND comp != anchor_comp").select(F.col("node").alias("a"), F.col("anchor").alias("b")).distinct()
        new = _verified(pairs, texts, similarity, f"near-links-{step}")
        links = new if links is None else links.unionByName(new)
        labels = stored(components(links, f"near-groups-{step}"), f"near-labels-{step}")
        relabelled = met.select("key", "node", "pop", "size", "anchor").join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        at = labels.select(F.col("node").alias("anchor"), F.col("component").alias("_a"))
        relabelled = relabelled.join(at, "anchor", "left").withColumn("last", F.coalesce("_a", "anchor"))
        # a band of two is settled by its anchor; so is one whose members are all in one component
        open_keys = relabelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_n")).where("_lo != _hi AND _n > 2").select("key")
        members = stored(relabelled.join(open_keys, "key").select("key", "node", "pop", "size", "comp", "last"), f"near-open-{step}")
        if members.isEmpty():
            break

    # bands with the same members are compared once
    alike = members.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum(F.xxhash64(F.lit(1), F.col("node")).cast("decimal(38,0)")).alias("_y")).groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    rest = links.limit(0) if members.isEmpty() else _compared(members.join(alike, "key").select("key", "node", "comp"), texts, similarity, block, "near-rest")
    labels = components(links.unionByName(rest), "near-groups")
    named = labels.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("_least"))
    classes = nodes.join(labels, "node", "left").join(named, "component", "left").select("node", F.coalesce("_least", "id").alias("class_id"))
    out = content.select("doc_id", "node", (F.col("n_words") > 0).alias("_worded")).join(classes, "node", "left")
    out = out.select("doc_id", F.when(F.col("_worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows that near_duplicates keeps, with all their columns."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain, key = docs.toDF(*inner), inner[docs.columns.index(id_col)]
    kept = near_duplicates(docs, similarity, id_col=id_col, text_col=text_col).where("kept").select("doc_id").distinct()
    return plain.join(kept.hint("shuffle_hash"), F.col(key).cast("long").eqNullSafe(F.col("doc_id")), "left_semi").toDF(*docs.columns)
