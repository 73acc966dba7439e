"""Near-duplicate embeddings: exact pairs over a cosine threshold by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import stored
from figtrail.llm.components import components

#: Radii of the levels below the root on the unit sphere. Wider ones would gather unrelated points of many dimensions, whose
#: covering radii then prune nothing.
RADII = (0.5, 0.25, 0.125)
PIVOTS, PIVOT_SAMPLE, BLOCK = 8, 2048, 8192
SLACK = 1e-9
#: Pairs of points that two nodes are compared in at once rather than through their children.
DIRECT = 1 << 16


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cos, 0))


def _net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of its centre: a point joins the nearest earlier centre within the radius or becomes one.
    The first point is a centre, so a node is the first of its own children."""
    least, n = 1 - radius * radius / 2, len(points)
    own, centres = np.zeros(n, int), np.zeros(0, int)
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        best, at = np.full(hi - lo, -2.0), np.zeros(hi - lo, int)
        if len(centres):
            cos = points[lo:hi] @ points[centres].T
            pick = cos.argmax(1)
            best, at = cos[np.arange(hi - lo), pick], centres[pick]
        within = points[lo:hi] @ points[lo:hi].T
        fresh: list[int] = []
        for i in np.flatnonzero(best < least):
            near = within[i, fresh] if fresh else np.zeros(0)
            if len(near) and near.max() >= least:
                at[i] = lo + fresh[int(near.argmax())]
            else:
                at[i] = lo + i
                fresh.append(int(i))
        own[lo:hi] = at
        centres = np.append(centres, [lo + i for i in fresh]).astype(int)
    return own


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which every node of every level is a run, and for each level the place (in that order)
    of each point's centre."""
    n = len(points)
    order, levels = np.arange(n), []
    starts = [(0, n)] if n else []
    for radius in RADII:
        centre, runs = np.zeros(n, int), []
        for lo, hi in starts:
            if hi - lo == 1:
                centre[lo] = lo
                runs.append((lo, hi))
                continue
            own = _net(points[order[lo:hi]], radius)
            by = np.argsort(own, kind="stable")
            order[lo:hi] = order[lo:hi][by]
            # a centre precedes the points that joined it, and stands first of its run
            cuts = np.flatnonzero(np.diff(own[by], prepend=-1))
            ends = np.append(cuts[1:], hi - lo)
            for c, e in zip(cuts, ends, strict=True):
                centre[lo + c:lo + e] = lo + c
                runs.append((lo + int(c), lo + int(e)))
        levels.append(centre)
        starts = runs
    return order, np.array(levels).reshape(len(RADII), n)


class _Tree:
    def __init__(self, points: np.ndarray, levels: np.ndarray) -> None:
        self.points, self.runs, self.radius, self.children = points, [], [], []
        for centre in levels:
            start = np.unique(centre)
            end = np.append(start[1:], len(points))
            far = _distance(np.einsum("ij,ij->i", points, points[centre]))
            radius = np.maximum.reduceat(far, start) if len(start) else np.zeros(0)
            self.runs.append(np.stack([start, end], 1))
            self.radius.append(radius + SLACK)


class _Links:
    """Link counts and labels of the points of one task; points of the second block follow those of the first."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.count, self.label = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def join(self, points: np.ndarray) -> None:
        labels = np.unique(self.label[points])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def block(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        """hit: which of a and b are linked."""
        self.count[a] += hit @ self.weights[b]
        self.count[b] += hit.T @ self.weights[a]
        for i in np.flatnonzero(hit.any(1)):
            self.join(np.append(b[hit[i]], a[i]))


def dual(a: _Tree, b: _Tree, same: bool, links: _Links, shift: int, threshold: float) -> None:
    """Adds every pair of a and b (of a alone when same) with cosine at or above the threshold. Node pairs that lie
    further apart than both covering radii and the threshold's distance are dropped whole; pairs that lie near enough
    for all their points to be linked are counted whole; the rest are split, at the end compared point by point."""
    reach = sqrt(2 - 2 * threshold)

    def compare(i: tuple[int, int], j: tuple[int, int]) -> None:
        mine = same and i == j
        for lo in range(i[0], i[1], 512):
            hi = min(lo + 512, i[1])
            left = lo if mine else j[0]
            cos = a.points[lo:hi] @ b.points[left:j[1]].T
            hit = cos >= threshold
            for x, y in np.argwhere(np.abs(cos - threshold) < 1e-12):
                p, q = a.points[lo + x], b.points[left + y]
                hit[x, y] = float(np.dot(p, q)) >= threshold
            if mine:
                hit &= np.arange(left, j[1])[None, :] > np.arange(lo, hi)[:, None]
            if hit.any():
                links.block(np.arange(lo, hi), np.arange(left, j[1]) + shift, hit)

    def whole(i: tuple[int, int], j: tuple[int, int]) -> None:
        p, q = np.arange(*i), np.arange(*j) + shift
        if same and i == j:
            links.count[p] += links.weights[p].sum() - links.weights[p]
            links.join(p)
        else:
            links.count[p] += links.weights[q].sum()
            links.count[q] += links.weights[p].sum()
            links.join(np.concatenate([p, q]))

    def settle(level: int, x: int, y: int, far: float) -> None:
        """A node pair that may hold links."""
        i, j = tuple(a.runs[level][x].tolist()), tuple(b.runs[level][y].tolist())
        pairs = (i[1] - i[0]) * (j[1] - j[0])
        if same and i == j and pairs == 1:
            return
        if far + a.radius[level][x] + b.radius[level][y] <= reach - SLACK:
            whole(i, j)
            return
        if pairs <= DIRECT or level + 1 == len(RADII):
            compare(i, j)
            return
        below = [np.flatnonzero((t.runs[level + 1][:, 0] >= r[0]) & (t.runs[level + 1][:, 1] <= r[1])) for t, r in ((a, i), (b, j))]
        if len(below[0]) * len(below[1]) * 16 > pairs:
            compare(i, j)
        elif same and i == j:
            visit(level + 1, below[0], below[0])
        else:
            visit(level + 1, below[0], below[1])

    def meet(level: int, ni: np.ndarray, nj: np.ndarray, mine: bool) -> None:
        if not len(ni) or not len(nj):
            return
        ri, rj = a.radius[level][ni], b.radius[level][nj]
        cj = b.points[b.runs[level][nj, 0]]
        for lo in range(0, len(ni), 512):
            cos = a.points[a.runs[level][ni[lo:lo + 512], 0]] @ cj.T
            # first one bound for all of these pairs, then each pair's own
            widest = min(2.0, ri[lo:lo + 512].max() + rj.max() + reach + SLACK)
            x, y = np.nonzero(cos >= 1 - widest * widest / 2 - SLACK)
            far = _distance(cos[x, y])
            near = far <= ri[lo + x] + rj[y] + reach + SLACK
            if mine:
                near &= y >= lo + x
            for p, q, d in zip(x[near], y[near], far[near], strict=True):
                settle(level, ni[lo + p], nj[q], float(d))

    def visit(level: int, ni: np.ndarray, nj: np.ndarray) -> None:
        """All pairs of these nodes of one level; when they are the same nodes of one tree, each pair once. Nodes of one
        place, which are most where points lie scattered, meet apart from wide ones, whose radii would loosen their bound."""
        mine = same and ni is nj
        wide_i, wide_j = a.radius[level][ni] > 2 * SLACK, b.radius[level][nj] > 2 * SLACK
        meet(level, ni[~wide_i], nj[~wide_j], mine)
        meet(level, ni[wide_i], nj[wide_j], mine)
        meet(level, ni[~wide_i], nj[wide_j], False)
        if not mine:
            meet(level, ni[wide_i], nj[~wide_j], False)

    if len(a.points) and len(b.points):
        top = np.arange(len(a.runs[0]))
        visit(0, top, top if same else np.arange(len(b.runs[0])))


def _pivots(reps: DataFrame) -> dict[int, np.ndarray]:
    """The top of the tree: far-apart points of a bounded sample, by dimension. Any choice gives the same pairs."""
    rows = reps.select("unit", F.xxhash64("node").alias("_h")).orderBy("_h").limit(PIVOT_SAMPLE).collect()
    groups: dict[int, list[np.ndarray]] = {}
    for r in rows:
        groups.setdefault(len(r["unit"]) // 8, []).append(np.frombuffer(r["unit"], "<f8"))
    out = {}
    for dim, vectors in groups.items():
        x = np.stack(vectors)
        pick, best = [0], x @ x[0]
        while len(pick) < min(PIVOTS, len(x)):
            pick.append(int(best.argmin()))
            best = np.maximum(best, x @ x[pick[-1]])
        out[dim] = x[pick]
    return out


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at cosine `threshold` or more, in double precision),
    component_id (smallest id reachable by links), kept.

    Vectors that are null, empty, zero or hold a null or a non-finite number link with nothing, nor do vectors of
    different lengths; they keep their own id as component. Equal vectors are compared once and counted as often as they
    come, so a vector that fills a third of the table is one point. Rows with a null id are compared like others and
    never name a component while another id is there. An empty table gives an empty result.

    Points hang on the nearest of a few pivots; a pivot's points are dealt over blocks of about `block`, each with its
    own tree; two blocks meet in a task when their pivots' covering radii leave a pair possible. Tasks return link
    counts and one link per point to its group, never the pairs."""
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    good = F.coalesce((F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    plain = plain.withColumn("x", F.when(good, F.transform("x", lambda v: v + F.lit(0.0))))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("x").to_pylist():
                v = np.array(x, float)
                v = v / np.abs(v).max()
                out.append((v / np.sqrt((v * v).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("id"), b.column("n"), b.column("node"), pa.array(out, pa.binary())], names=["x", "id", "n", "node", "unit"])

    grouped = plain.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    reps = stored(grouped.mapInArrow(unit, "x array<double>, id long, n long, node long, unit binary"), "vectors")
    pivots = _pivots(reps)

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, dims, far = [], [], []
            for u in b.column("unit").to_pylist():
                v = np.frombuffer(u, "<f8")
                p = pivots.get(len(v))
                cos = p @ v if p is not None else np.zeros(1)
                cells.append(int(cos.argmax()))
                dims.append(len(v))
                far.append(float(_distance(cos.max())) if p is not None else 2.0)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), b.column("unit"), pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(far, pa.float64())], names=["node", "n", "unit", "dim", "cell", "far"])

    hung = stored(reps.select("node", "n", "unit").mapInArrow(hang, "node long, n long, unit binary, dim int, cell int, far double"), "vector-cells")
    cells = hung.groupBy("dim", "cell").agg(F.count("*").alias("size"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    sized = {(r["dim"], r["cell"]): r for r in cells.collect()}  # at most PIVOTS rows per length of vector
    reach, near = sqrt(2 - 2 * threshold), []
    for (dim, c), r in sized.items():
        for (dim2, c2), r2 in sized.items():
            if dim == dim2:
                p = pivots.get(dim)
                apart = float(_distance(p[c] @ p[c2])) if p is not None else 0.0
                if apart <= r["radius"] + r2["radius"] + reach + SLACK:
                    near.append((dim, c, r["blocks"], c2, r2["blocks"]))
    spark = vectors.sparkSession
    partners = spark.createDataFrame(near, "dim int, cell int, blocks int, cell2 int, blocks2 int")

    def plant(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("node").combine_chunks()
        points = np.stack([np.frombuffer(u, "<f8") for u in t["unit"].to_pylist()])
        order, levels = build(points)
        out = t.take(pa.array(order))
        places = pa.array([x.astype("<i4").tobytes() for x in levels.T], pa.binary())
        yield from out.select(["node", "n", "unit", "dim", "cell", "block"]).append_column("place", pa.array(np.arange(len(order)), pa.int32())).append_column("path", places).to_batches()

    # few rows, much work: as many tasks as there are trees and meetings, up to a limit
    planted = min(2000, max(1, sum(r["blocks"] for r in sized.values())))
    meetings = min(2000, max(1, sum(a * b for _, _, a, _, b in near)))
    counts = partners.select("dim", "cell", "blocks").distinct()
    dealt = hung.join(F.broadcast(counts), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    trees = stored(dealt.select("node", "n", "unit", "dim", "cell", "block").repartition(planted, "dim", "cell", "block").groupBy("dim", "cell", "block").applyInArrow(plant, "node long, n long, unit binary, dim int, cell int, block int, place int, path binary"), "vector-trees")
    meets = trees.join(F.broadcast(partners.drop("blocks")), ["dim", "cell"]).withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    mine, other = F.struct("cell", "block"), F.struct(F.col("cell2").alias("cell"), F.col("block2").alias("block"))
    meets = meets.select("dim", F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two"), (mine > other).alias("second"), "node", "n", "unit", "place", "path")

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("second", "ascending"), ("place", "ascending")]).combine_chunks()
        points = np.frombuffer(b"".join(t["unit"].to_pylist()), "<f8").reshape(t.num_rows, -1)
        paths = np.frombuffer(b"".join(t["path"].to_pylist()), "<i4").reshape(t.num_rows, -1).T
        nodes, cut = t["node"].to_numpy(), int(np.count_nonzero(~np.array(t["second"].to_pylist(), bool)))
        same, links = key[1].as_py() == key[2].as_py(), _Links(t["n"].to_numpy())
        a = _Tree(points[:cut], paths[:, :cut])
        if same:
            dual(a, a, True, links, 0, threshold)
        elif cut < t.num_rows:
            dual(a, _Tree(points[cut:], paths[:, cut:]), False, links, cut, threshold)
        at = np.flatnonzero(links.count)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[at]), "links": pa.array(links.count[at]), "to": pa.array(nodes[links.label[at]])})

    found = stored(meets.repartition(meetings, "dim", "one", "two").groupBy("dim", "one", "two").applyInArrow(meet, "node long, links long, to long"), "vector-links")
    grouped = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "vector-groups")
    ids = reps.select("node", "id")
    named = grouped.join(ids, "node").groupBy("component").agg(F.min("id").alias("_least"))
    known = ids.join(grouped, "node", "left").join(named, "component", "left").select("node", F.coalesce("_least", "id").alias("component_id"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = reps.select("x", "node", "n").join(known, "node").join(counted, "node", "left").select(F.col("x").alias("_x"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = plain.join(nodes, F.col("x") == F.col("_x"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("x").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
