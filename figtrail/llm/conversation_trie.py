"""Prefix trie of conversations: which openings are shared, by how many, and what storing each once would save.

A node is a distinct sequence of first turns. Its digest is 128 bits, the exclusive or of one value per (turn, depth), so
that digests are running sums that can be cut anywhere. Nodes are counted and their subtrees added up shard by shard: a
shard numbers its distinct digests by a minimal perfect hash, scatters counts into flat arrays by slot and adds
children to parents through an array of parent slots, deepest first. What shards find of one node is summed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figtrail.llm.common import stored

#: Turns of one conversation that one task has to see together.
BLOCK = 4096
#: Rows after which a shard is closed, at the next end of a block.
SHARD = 1 << 17
#: Members of one node listed in one row of text.
LISTED = 1 << 16


# ---------------------------------------------------------------- slots

def _mixed(k0: np.ndarray, k1: np.ndarray, salt: int) -> np.ndarray:
    x = k0 ^ (k1 * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((salt * 0xD1B54A32D192ED03 + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: each of n keys has a slot of its own in 0..n-1. Level by level,
    keys that fall on a bit alone take it, the others go on; a slot is the rank of its bit. The key is kept at its slot
    and compared at each lookup, so a key that is not in the table is known as such (-1)."""

    def __init__(self, k0: np.ndarray, k1: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(k0)), 0
        while len(left):
            place = (_mixed(k0[left], k1[left], len(self.levels)) % np.uint64(2 * len(left))).astype(np.int64)
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[place]]
        self.k0, self.k1 = np.zeros(len(k0), np.uint64), np.zeros(len(k0), np.uint64)
        at = self._at(k0, k1)
        self.k0[at], self.k1[at] = k0, k1

    def __len__(self) -> int:
        return len(self.k0)

    def _at(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        out, left = np.full(len(k0), -1, np.int64), np.arange(len(k0))
        for salt, (alone, rank) in enumerate(self.levels):
            place = (_mixed(k0[left], k1[left], salt) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return out

    def slots(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        at = self._at(k0, k1)
        return np.where((at >= 0) & (self.k0[at] == k0) & (self.k1[at] == k1), at, -1) if len(self) else at


def distinct(k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((k1, k0))
    a, b = k0[order], k1[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


# ---------------------------------------------------------------- turns

def turn_rows(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0 along the turns, null first), i0, i1 (the turn's identity: half of the SHA-256 of role and
    text), bytes (of the text in UTF-8). Turns with one number stand in the order of that SHA-256.

    One range exchange: each partition counts along its own rows, and the only conversation of it that may have begun
    before is its first, for which the count of the partitions before is carried in. The driver holds one row per
    partition. Rows without a conv_id belong to no conversation and are left out; texts are not shuffled."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("_turn"), F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("_sha"),
                                F.octet_length(text).cast("long").alias("bytes")).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_sha")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "_sha", "bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy()
            halves = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, 4)
            first = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
            pos = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                pos[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], pos[-1] + 1
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(conv), part, np.int32)), "conv_id": b.column(0), "pos": pa.array(pos, pa.int64()), "i0": pa.array(halves[:, 0]), "i1": pa.array(halves[:, 1]), "bytes": b.column(2)})

    local = stored(ranged.mapInArrow(count, "part int, conv_id long, pos long, i0 long, i1 long, bytes long"), "trie-turns")
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("pos", F.struct("conv_id", "pos")).alias("pos")).orderBy("part").collect()
    carried, before, count_before = [], None, 0
    for e in ends:
        inherits = e["first"] == before
        if inherits:
            carried.append((e["part"], e["first"], count_before))
        count_before = e["pos"] + 1 + (count_before if inherits and e["first"] == e["last"] else 0)
        before = e["last"]
    if not carried:
        return local.drop("part")
    carry = conversations.sparkSession.createDataFrame(carried, "part int, conv_id long, _carry long")
    return local.join(F.broadcast(carry), ["part", "conv_id"], "left").withColumn("pos", F.col("pos") + F.coalesce("_carry", F.lit(0))).drop("part", "_carry")


def _sizes(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def _by_block(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns beside a row of their conversation, joined block by block, so that a conversation of any length is many keys."""
    blocks = convs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK).cast("long"))))
    return turns.withColumn("_block", F.floor(F.col("pos") / BLOCK).cast("long")).join(blocks, ["conv_id", "_block"]).drop("_block")


def rows_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: rows (conv_id, depth from 1, i0, i1, bytes, n_turns) and conversations (conv_id, n_turns)."""
    convs = _sizes(turns)
    rows = _by_block(turns, convs).select("conv_id", (F.col("pos") + 1).alias("depth"), "i0", "i1", "bytes", F.col("n").alias("n_turns"))
    return rows, convs.select("conv_id", F.col("n").alias("n_turns"))


def rebuilt_rows(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As rows_of, for conversations rebuilt with a shared opening: conversation c takes the first h turns of
    conversation c - c % 5 (all it has, none where there is no such) and then its own behind its first h, where h is
    the crc32 of c's decimal text modulo 9. An opening of 8 turns at most meets 9 conversations at most."""
    own = stored(_sizes(turns), "trie-sizes")
    base = own.select(F.col("conv_id").alias("_base"), F.col("n").alias("_held"))
    convs = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 9).join(base, "_base", "left")
    convs = convs.withColumn("_taken", F.least(F.col("h"), F.coalesce("_held", F.lit(0)))).drop("_held")
    convs = convs.withColumn("n_turns", F.col("_taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    opening = turns.where("pos < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "_base")
    heads = opening.join(convs.select("_base", "conv_id", "_taken", "n_turns"), "_base").where("pos < _taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "i0", "i1", "bytes", "n_turns")
    tails = _by_block(turns, convs.where("n > h").select("conv_id", "n", "h", "_taken", "n_turns")).where("pos >= h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("_taken") + 1).alias("depth"), "i0", "i1", "bytes", "n_turns")
    return heads.unionByName(tails), convs.select("conv_id", "n_turns")


def prefix_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The rows with the digests of their prefixes and a row of depth 0 per conversation: conv_id, block, depth, n_turns,
    i0, i1, bytes, k0, k1 (digest), l0, l1 (what the last turn adds to it). Digests run inside blocks; conversations of
    more than one block, and only these, are joined with the digest of their blocks before."""
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("i0", "i1", "bytes")], "n_turns")
    turned = F.col("depth") > 0
    every = rows.unionByName(roots).withColumn("block", F.floor(F.col("depth") / BLOCK).cast("long"))
    every = every.withColumn("l0", F.when(turned, F.xxhash64("i0", "i1", "depth")).otherwise(F.lit(0))).withColumn("l1", F.when(turned, F.xxhash64("depth", "i1", F.lit(1), "i0")).otherwise(F.lit(0)))
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = stored(every.withColumn("k0", F.bit_xor("l0").over(along)).withColumn("k1", F.bit_xor("l1").over(along)), "trie-digests")
    long = local.where(F.col("n_turns") >= BLOCK)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = long.groupBy("conv_id", "block").agg(F.bit_xor("l0").alias("b0"), F.bit_xor("l1").alias("b1"))
    carry = carry.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (0, 1)])
    joined = long.join(carry, ["conv_id", "block"])
    for i in (0, 1):
        joined = joined.withColumn(f"k{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"c{i}"))).drop(f"c{i}")
    return local.where(F.col("n_turns") < BLOCK).unionByName(joined)


# ---------------------------------------------------------------- shards

def _shards(batches: Iterator[pa.RecordBatch], rows: int, same: tuple[str, ...] = ()) -> Iterator[dict[str, np.ndarray]]:
    """Arrow batches as columns of about so many rows, cut only where the columns `same` change."""
    held: list[pa.RecordBatch] = []
    size = 0

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        return {n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in t.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        cut = t.num_rows
        if same:
            keys = [t.column(n).combine_chunks().to_numpy() for n in same]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield columns(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        size = t.num_rows - cut
    if size:
        yield columns(pa.Table.from_batches(held))


def _unsigned(shard: dict[str, np.ndarray], *names: str) -> list[np.ndarray]:
    return [shard[n].view(np.uint64) for n in names]


def count_nodes(shard: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The nodes of a shard of rows: members, smallest member, whether any goes on, and a turn that stands for them. Rows
    of one digest must hold one turn at one depth and have one parent digest; by induction their prefixes are then equal."""
    k0, k1 = _unsigned(shard, "k0", "k1")
    table = SlotTable(*distinct(k0, k1))
    at, n = table.slots(k0, k1), len(table)
    one = np.zeros(n, np.int64)
    one[at] = np.arange(len(at))
    for name in ("i0", "i1", "depth", "l0", "l1"):
        if not np.array_equal(shard[name][one[at]], shard[name]):
            raise ValueError("two prefixes share a digest")
    least, goes_on = np.full(n, np.iinfo(np.int64).max), np.zeros(n, bool)
    np.minimum.at(least, at, shard["conv_id"])
    np.logical_or.at(goes_on, at, shard["depth"] < shard["n_turns"])
    out = {"k0": table.k0.view(np.int64), "k1": table.k1.view(np.int64), "n": np.bincount(at, minlength=n).astype(np.int64), "conv_id": least, "goes_on": goes_on}
    return out | {name: shard[name][one] for name in ("i0", "i1", "depth", "l0", "l1", "bytes")}


def nodes_of(rows: DataFrame) -> DataFrame:
    """k0, k1, conv_id (smallest member), depth, n_convs, bytes (of the last text), leaf, l0, l1: one row per node. Shards
    count first, so a node that many share leaves each of them as one row; their counts are summed and compared again."""
    names, size = ("k0", "k1", "n", "conv_id", "goes_on", "i0", "i1", "depth", "l0", "l1", "bytes"), SHARD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, size):
            found = count_nodes(shard)
            yield pa.RecordBatch.from_pydict({c: pa.array(found[c]) for c in names})

    part = rows.select("k0", "k1", "conv_id", "depth", "n_turns", "i0", "i1", "l0", "l1", "bytes").mapInArrow(count, ", ".join(f"{c} {'boolean' if c == 'goes_on' else 'long'}" for c in names))
    alike = [F.min(c) == F.max(c) for c in ("i0", "i1", "depth")]
    agreed = F.when(alike[0] & alike[1] & alike[2], F.min("depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = part.groupBy("k0", "k1").agg(F.min("conv_id").alias("conv_id"), agreed.alias("depth"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), (~F.max("goes_on")).alias("leaf"), F.max("l0").alias("l0"), F.max("l1").alias("l1"))
    return stored(nodes, "trie-nodes")


def add_up(shard: dict[str, np.ndarray], block: int = BLOCK) -> dict[str, np.ndarray]:
    """Subtree sums of a shard: rows of whole (conversation, block) groups along the depth, of which some are the node's
    own row (owned: it brings the node's values) and some bring in what the blocks behind found (no digest: depth -1
    and last of their group). Values are scattered by slot and added to the parent's slot, deepest level first."""
    group = np.zeros(len(shard["conv_id"]), np.int64)
    group[1:] = np.cumsum((shard["conv_id"][1:] != shard["conv_id"][:-1]) | (shard["block"][1:] != shard["block"][:-1]))
    matters = np.bincount(group, (shard["owned"] > 0) | (shard["depth"] < 0)) > 0
    shard = {n: v[matters[group]] for n, v in shard.items()}
    if not len(shard["depth"]):
        return {n: np.zeros(0, np.int64) for n in ("k0", "k1", "n_children", "n_leaves", "saved_tokens")}
    real = shard["depth"] >= 0
    k0, k1, l0, l1 = _unsigned(shard, "k0", "k1", "l0", "l1")
    level = shard["depth"] - shard["block"] * block
    owned = real & (shard["owned"] > 0) & (shard["depth"] > 0)
    keys = [np.concatenate([k[real], (k ^ x)[owned]]) for k, x in ((k0, l0), (k1, l1))]
    table = SlotTable(*distinct(*keys))
    at = table.slots(k0, k1)
    # what comes from behind is added where the group ends, at the row before it
    at[~real] = at[np.maximum.accumulate(np.where(real, np.arange(len(real)), 0))[~real]]
    up = table.slots(k0 ^ l0, k1 ^ l1)
    n = len(table)
    children, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
    np.add.at(children, up[owned], 1)
    np.add.at(leaves, at, shard["leaf"])
    np.add.at(saved, at, shard["saved"])
    parent, depth = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    inside = real & (level > 0)
    parent[at[inside]], depth[at[inside]] = up[inside], level[inside]
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(int(depth.max()), 0, -1):
        here = order[cuts[d]:cuts[d + 1]]
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])
    return {"k0": table.k0.view(np.int64), "k1": table.k1.view(np.int64), "n_children": children, "n_leaves": leaves, "saved_tokens": saved}


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """k0, k1, n_children, n_leaves, saved_tokens per node. A node's own values stand once, on the path of its smallest
    member; a shard holds whole paths (block by block) and adds them up to all of their prefixes, so the sums that
    shards find for one node add up to its subtree. Blocks behind are carried in as one row per block."""
    own = nodes.select("conv_id", F.floor(F.col("depth") / BLOCK).cast("long").alias("block"), "depth", "k0", "k1", "l0", "l1", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.col("leaf").cast("long").alias("leaf"), F.lit(1).cast("long").alias("owned"))
    none = F.lit(0).cast("long")
    paths = rows.select("conv_id", "block", "depth", "k0", "k1", "l0", "l1", none.alias("saved"), none.alias("leaf"), none.alias("owned"))
    long = rows.where((F.col("depth") == 0) & (F.col("n_turns") >= BLOCK)).select("conv_id", F.explode(F.sequence(none, F.floor(F.col("n_turns") / BLOCK).cast("long"))).alias("block"))
    sums = own.where("block > 0").groupBy("conv_id", "block").agg(F.sum("saved").alias("_s"), F.sum("leaf").alias("_l"))
    behind = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = long.join(sums, ["conv_id", "block"], "left").select("conv_id", "block", *[F.coalesce(F.sum(c).over(behind), none).alias(t) for c, t in (("_s", "saved"), ("_l", "leaf"))]).where("saved <> 0 OR leaf <> 0")
    carry = carry.select("conv_id", "block", F.lit(-1).cast("long").alias("depth"), *[none.alias(c) for c in ("k0", "k1", "l0", "l1")], "saved", "leaf", none.alias("owned"))
    every = paths.unionByName(own).unionByName(carry).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("depth") < 0, "depth")
    names, block, size = ("k0", "k1", "n_children", "n_leaves", "saved_tokens"), BLOCK, SHARD

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, size, ("conv_id", "block")):
            found = add_up(shard, block)
            yield pa.RecordBatch.from_pydict({c: pa.array(found[c]) for c in names})

    part = every.mapInArrow(add, ", ".join(f"{c} long" for c in names))
    return part.groupBy("k0", "k1").agg(*[F.sum(c).alias(c) for c in names[2:]])


# ---------------------------------------------------------------- members that end

def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def end_digests(rows: DataFrame, digest: Callable = hashlib.sha256) -> DataFrame:
    """k0, k1, ends_sha256 of the nodes at which a conversation ends: the digest of their numbers in ascending order,
    joined by commas. Members are range partitioned by node and number. A node whose members lie inside one partition is
    digested there; of others the numbers travel as texts of up to LISTED numbers and are digested as they stream by."""
    ends, most = rows.where("depth = n_turns").select("k0", "k1", "conv_id"), LISTED
    ranged = ends.repartitionByRange("k0", "k1", "conv_id").sortWithinPartitions("k0", "k1", "conv_id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, ids, whole = None, [], False

        def flush(done: bool) -> None:
            text = _joined(np.concatenate(ids))
            out.append((*key, int(ids[0][0]), None if done else text, digest(text.encode()).hexdigest() if done else None))

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["k0", "k1", "first", "text", "ends_sha256"])
            out.clear()
            return b

        for b in batches:
            if not b.num_rows:
                continue
            k0, k1, conv = (b.column(i).to_numpy() for i in range(3))
            first = np.concatenate([[0], np.flatnonzero((np.diff(k0) != 0) | (np.diff(k1) != 0)) + 1, [len(k0)]])
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                this = (int(k0[lo]), int(k1[lo]))
                if this != key:
                    if key is not None and ids:
                        flush(whole)
                    whole, key, ids = key is not None, this, []
                ids.append(conv[lo:hi])
                if sum(map(len, ids)) > most:
                    for at in range(0, len(every := np.concatenate(ids)), most):
                        ids = [every[at:at + most]]
                        flush(False)
                    whole, ids = False, []
            if out:
                yield batch()
        if key is not None and ids:
            flush(False)
        if out:
            yield batch()

    found = stored(ranged.mapInArrow(listed, "k0 long, k1 long, first long, text string, ends_sha256 string"), "trie-ends")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []
        for b in batches:
            for *this, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if this != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = this, digest()
                    state.update(text.encode())
                else:
                    state.update(b"," + text.encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_pydict(dict(zip(("k0", "k1", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))

    parts = found.where("ends_sha256 IS NULL").select("k0", "k1", "first", "text").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first")
    return found.where("ends_sha256 IS NOT NULL").select("k0", "k1", "ends_sha256").unionByName(parts.mapInArrow(streamed, "k0 long, k1 long, ends_sha256 string"))


# ---------------------------------------------------------------- the trie

def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes that storing each node once saves in its subtree), ends_sha256. `rows` and `convs` as rows_of gives them.

    Conversations without turns are members of the root alone; repeated conversations add to the counts; no
    conversation, no row. A parent with so many children that its key would be hot is looked up in a broadcast table of
    such parents: children are at most as many as nodes, so at most 10,000 parents hold a ten-thousandth of them each."""
    rows = prefix_digests(rows, convs)
    nodes = nodes_of(rows)
    sums = stored(nodes.join(subtree_sums(rows, nodes), ["k0", "k1"]).select("k0", "k1", "l0", "l1", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-sums")
    found = sums.join(end_digests(rows), ["k0", "k1"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    found = found.withColumn("p0", F.col("k0").bitwiseXOR(F.col("l0"))).withColumn("p1", F.col("k1").bitwiseXOR(F.col("l1")))
    busy = max(1000, nodes.count() // 10_000)
    parents = sums.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") >= busy).select("p0", "p1", F.col("parent_conv_id").alias("_hot"))
    below = found.where("depth > 0").join(F.broadcast(hot), ["p0", "p1"], "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = below.where("_hot IS NULL").join(parents.where(F.col("n_children") < busy).drop("n_children"), ["p0", "p1"]).select(out)
    return (found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(out)
            .unionByName(below.where("_hot IS NOT NULL").withColumnRenamed("_hot", "parent_conv_id").select(out)).unionByName(rest))


def conversation_trie(conversations: DataFrame, rebuilt: bool = False, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """prefix_trie of a table of turns, as they stand or rebuilt with shared openings (rebuilt_rows). Null roles and
    texts count as empty, a null turn number stands first, turns with one number stand in a fixed order, rows without a
    conv_id are left out, other columns are ignored."""
    turns = turn_rows(conversations, id_col, order_col, role_col, text_col)
    return prefix_trie(*(rebuilt_rows(turns) if rebuilt else rows_of(turns)))
