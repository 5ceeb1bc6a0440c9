"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Distance is that of unit vectors, so cosine >= t means distance <= sqrt(2 - 2 t). The top level of the tree is a
net of pivots from a bounded sample; every vector goes to its nearest pivot, and a pivot's vectors, in blocks of at most about
``BLOCK``, get a tree of nested levels with halving radii. Few points that only the widest level gathers are split at once: that
node would be near everything. A pair of nodes is pruned when the
distance of their centres exceeds the threshold by more than both covering radii, and taken as a whole when even the
farthest members are within it; only what lies between is descended into. Pairs of pivots are pruned
the same way before any vector is moved. Trees move in bundles: a task gets two of them and compares each tree of one with each of the other, so that
a pair of trees moves a small part of a tree.

Links are never listed: each pair of blocks yields for its vectors the number of links and one
edge to the root of their local component. Equal vectors are one content with a weight.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, records_per_batch
from .graph import connected_components
from .vectors import matrix, unit, usable_vectors

THRESHOLD = 0.9
BLOCK = 2048
#: Vectors that pivots are chosen from, and pivots, at most.
SAMPLE, PIVOTS = 4096, 1024
RADII = (1.0, 0.5, 0.25, 0.125)
#: Points that a top node wider than the second radius covers, at least.
FEW = 64
#: Components that a first bound looks at; rows of a strip of pairs.
HEAD, STRIP = 32, 256
#: Bundles that trees are dealt into, about; trees in a bundle, at most (1.6 MB each, in a task); trees in an Arrow batch.
BUNDLES, BUNDLE, TREES = 24, 32, 8
_SLACK = 1e-5  # single precision is only used to prune; what it leaves within this is judged in double


class Tree:
    """A cover tree in arrays. Node i covers points ``order[lo[i]:hi[i]]`` from ``center[i]`` within ``radius[i]``; its children are ``kids[i]`` to ``kids_end[i]``."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        self.ids, self.weight, self.vectors = ids, weight, vectors
        n = len(ids)
        self.order = np.arange(n)
        self.single = vectors.astype(np.float32)
        gram = self.single @ self.single.T
        nodes: list[list] = []  # center, radius, lo, hi, first child, end of children
        todo, ranges = [], [(0, n, 0)]
        while ranges:
            *bounds, level = ranges.pop()
            for node in self._split(gram, *bounds, level):
                _, radius, lo, hi, *_ = node
                if radius > RADII[1] + 1e-3 and hi - lo < FEW:
                    ranges.append((lo, hi, level + 1))
                else:
                    nodes.append(node)
                    todo.append((len(nodes) - 1, level + 1))
        self.top = len(nodes)
        k = 0
        while k < len(todo):
            node, level = todo[k]
            _, radius, lo, hi, *_ = nodes[node]
            if hi - lo > 1 and level < len(RADII) and radius > 0:
                nodes[node][4] = len(nodes)
                for child in self._split(gram, lo, hi, level):
                    nodes.append(child)
                    todo.append((len(nodes) - 1, level + 1))
                nodes[node][5] = len(nodes)
            k += 1
        a = np.array(nodes, dtype=float).reshape(-1, 6)
        self.center, self.lo, self.hi, self.kids, self.kids_end = (a[:, c].astype(np.int64) for c in (0, 2, 3, 4, 5))
        self.radius = a[:, 1] + 2e-4 * (a[:, 1] > 0)  # single precision errs by less
        total = np.append(0, np.cumsum(weight[self.order]))
        self.mass = total[self.hi] - total[self.lo]

    def _split(self, gram: np.ndarray, lo: int, hi: int, level: int) -> list[list]:
        """Nodes of the level's radius that cover the points of a range, each around its first point; keeps them contiguous."""
        points, made, parts = self.order[lo:hi], [], []
        least = 1 - RADII[level] ** 2 / 2
        while len(points):
            c = points[0]
            g = gram[c, points]
            near = g >= least
            near[0] = True
            parts.append(points[near])
            far = float(np.sqrt(max(0.0, 2 - 2 * float(g[near].min())))) if near.sum() > 1 else 0.0
            made.append([c, far, lo, lo + len(parts[-1]), 0, 0])
            lo += len(parts[-1])
            points = points[~near]
        self.order[hi - sum(map(len, parts)) : hi] = np.concatenate(parts)
        return made


def _heads(x: np.ndarray) -> np.ndarray:
    """Rows whose inner products are no less than those of ``x``: the first ``HEAD`` components, and the length of the rest."""
    if x.shape[1] <= HEAD + HEAD // 2:
        return x
    return np.column_stack([x[:, :HEAD], np.sqrt(np.einsum("ij,ij->i", x[:, HEAD:], x[:, HEAD:]))])


def _expand(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All combinations of two ranges for each pair of ranges."""
    na, nb = a_hi - a_lo, b_hi - b_lo
    n = na * nb
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    return np.repeat(a_lo, n) + at // wide, np.repeat(b_lo, n) + at % wide


def dual_traversal(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weights of links of each point of ``a`` and of ``b``, and edges (points of a, points of b) that connect what is linked.

    With ``a is b`` each unordered pair counts once for either end, and a point is not compared with itself.
    """
    reach = math.sqrt(2 - 2 * threshold)
    same = a is b
    links_a, links_b = np.zeros(len(a.ids) + 1), np.zeros(len(b.ids) + 1)  # differences over the order
    point_a, point_b = np.zeros(len(a.ids)), np.zeros(len(b.ids))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def between(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.single[a.center[i]], b.single[b.center[j]], dtype=np.float64)))

    heads_a, heads_b = _heads(a.single[a.center[: a.top]]), _heads(b.single[b.center[: b.top]])
    wide_a, wide_b = a.radius[: a.top] > 0, b.radius[: b.top] > 0
    plain_a, plain_b = np.flatnonzero(~wide_a), np.flatnonzero(~wide_b)
    wide_a, wide_b = np.flatnonzero(wide_a), np.flatnonzero(wide_b)
    # most top nodes are single points in scattered data: one bound serves all pairs of them; strips stay in the processor's cache
    across, found = heads_b[plain_b].T.copy(), []
    for s in range(0, len(plain_a), STRIP):
        strip = heads_a[plain_a[s : s + STRIP]] @ across
        x, y = np.divmod(np.flatnonzero(strip >= np.float32(1 - reach**2 / 2 - _SLACK)), max(1, len(plain_b)))  # much faster than nonzero on two axes
        found.append((plain_a[s + x], plain_b[y]))
    for rows, columns in ((wide_a, np.arange(b.top)), (plain_a, wide_b)):
        if len(rows) and len(columns):
            least = 1 - np.minimum(2, reach + a.radius[rows, None] + b.radius[None, columns]) ** 2 / 2 - _SLACK
            x, y = np.nonzero(heads_a[rows] @ heads_b[columns].T >= least)
            found.append((rows[x], columns[y]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2
    if same:
        i, j = i[i <= j], j[i <= j]
    d = None
    while len(i):
        if d is None:
            d = between(i, j)
        keep = d <= reach + a.radius[i] + b.radius[j] + _SLACK
        i, j, d = i[keep], j[keep], d[keep]
        own = (i == j) if same else np.zeros(len(i), dtype=bool)
        # a node with itself: all within reach of each other if twice its radius is
        whole = np.where(own, 2 * a.radius[i], d + a.radius[i] + b.radius[j]) <= reach - 1e-3
        leaf = (a.kids[i] == 0) & (b.kids[j] == 0)
        single = leaf & (a.hi[i] - a.lo[i] == 1) & (b.hi[j] - b.lo[j] == 1)
        whole &= ~single
        for x, y in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            links_a[[a.lo[x], a.hi[x]]] += b.mass[y], -b.mass[y]
            if not (same and x == y):
                links_b[[b.lo[y], b.hi[y]]] += a.mass[x], -a.mass[x]
            pa_, pb_ = a.order[a.lo[x] : a.hi[x]], b.order[b.lo[y] : b.hi[y]]
            edges.append((pa_, np.full(len(pa_), pb_[0])))
            edges.append((np.full(len(pb_), pa_[0]), pb_))
            if same and x == y:
                point_a[pa_] -= a.weight[pa_]  # not with itself
        test = leaf & ~whole
        p, q = _expand(a.lo[i[test]], a.hi[i[test]], b.lo[j[test]], b.hi[j[test]])
        p, q = a.order[p], b.order[q]
        if same:
            distinct = np.repeat(own[test], ((a.hi - a.lo)[i[test]] * (b.hi - b.lo)[j[test]]))
            take = ~distinct | (p < q)
            p, q = p[take], q[take]
        for s in range(0, len(p), 1 << 18):
            x, y = p[s : s + (1 << 18)], q[s : s + (1 << 18)]
            linked = np.einsum("ij,ij->i", a.vectors[x], b.vectors[y]) >= threshold
            x, y = x[linked], y[linked]
            point_a += np.bincount(x, weights=b.weight[y], minlength=len(point_a))
            point_b += np.bincount(y, weights=a.weight[x], minlength=len(point_b))
            if len(x):
                edges.append((x, y))
        # descend where a node has children; one without stays as it is
        i, j, own = i[~leaf & ~whole], j[~leaf & ~whole], own[~leaf & ~whole]
        alo, ahi = np.where(a.kids[i] > 0, a.kids[i], i), np.where(a.kids[i] > 0, a.kids_end[i], i + 1)
        blo, bhi = np.where(b.kids[j] > 0, b.kids[j], j), np.where(b.kids[j] > 0, b.kids_end[j], j + 1)
        size = (ahi - alo) * (bhi - blo)
        i, j = _expand(alo, ahi, blo, bhi)
        if same:
            own = np.repeat(own, size)
            keep = ~own | (i <= j)
            i, j = i[keep], j[keep]
        d = None
    point_a[a.order] += np.cumsum(links_a)[:-1]
    point_b[b.order] += np.cumsum(links_b)[:-1]
    if same:
        return point_a + point_b, point_b, edges
    return point_a, point_b, edges


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weight of links, local root) of the points of two blocks that have links."""
    same = a is b
    ca, cb, edges = dual_traversal(a, b, threshold)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    count = ca if same else np.concatenate([ca, cb])
    shift = 0 if same else len(a.ids)
    x = np.concatenate([e[0] for e in edges]) if edges else np.empty(0, dtype=np.int64)
    y = np.concatenate([e[1] for e in edges]) + shift if edges else x
    some = np.flatnonzero(count > 0)
    root = _roots(len(ids), x, y)
    return ids[some], count[some], ids[root[some]]


# --- Spark stages ------------------------------------------------------------------------------


def _assigned(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            cell, far = np.empty(len(x), dtype=np.int64), np.empty(len(x))
            for s in range(0, len(x), 4096):
                g = x[s : s + 4096] @ p.T
                cell[s : s + 4096] = g.argmax(axis=1)
                far[s : s + 4096] = np.sqrt(np.maximum(0, 2 - 2 * g.max(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), batch.column("v"), pa.array(cell), pa.array(far)], names=["id", "w", "v", "cell", "far"])

    return run


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grows each block's tree."""
    for batch in batches:
        for bundle, cell, members in zip(batch.column("bundle").to_pylist(), batch.column("cell").to_pylist(), batch.column("m"), strict=True):
            m = members.values
            ids = m.field("id").to_numpy(zero_copy_only=False)
            by = np.argsort(ids)
            raw = matrix(m.field("v"))[by]
            tree = Tree(ids[by], m.field("w").to_numpy(zero_copy_only=False)[by].astype(float), unit(raw))
            yield pa.RecordBatch.from_arrays([pa.array([bundle]), pa.array([cell]), pa.array([_packed(tree, raw)], pa.binary())], names=["bundle", "cell", "tree"])


def _packed(tree: Tree, raw: np.ndarray) -> bytes:
    """A tree with its original vectors, in single precision where that loses nothing; the rest is made again."""
    small = raw.astype(np.float32)
    tree.single, tree.vectors = None, small if (small == raw).all() else raw
    for name in ("order", "center", "lo", "hi", "kids", "kids_end"):
        setattr(tree, name, getattr(tree, name).astype(np.int32))
    return pickle.dumps(tree, protocol=5)


def _tree(data: bytes) -> Tree:
    tree = pickle.loads(data)
    tree.vectors = unit(tree.vectors.astype(float))
    tree.single = tree.vectors.astype(np.float32)
    for name in ("order", "center", "lo", "hi", "kids", "kids_end"):
        setattr(tree, name, getattr(tree, name).astype(np.int64))
    return tree


def _compared(threshold: float, near):
    """Compares the trees of two bundles, or those of one, where their cells are near. Rows of a pair of bundles follow each other."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        last, left, right = None, [], []
        for batch in batches:
            for i, j, own, cell, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "bundle", "cell", "tree")), strict=True):
                if (i, j) != last:
                    yield left, right
                    last, left, right = (i, j), [], []
                (left if own == i else right).append((cell, _tree(data)))
        yield left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = near.value
        for left, right in bundles(batches):
            for k, (cell, a) in enumerate(left):
                for other, b in right or left[k:]:
                    if close[cell, other]:
                        ids, count, root = compare(a, b, threshold)
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.rint(count).astype(np.int64)), pa.array(root)], names=["id", "n", "root"])

    return run


def _net(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` pivots from the sample, in its order, each at least the second radius from those before it."""
    chosen: list[int] = []
    least = 1 - RADII[1] ** 2 / 2
    open_ = np.ones(len(sample), dtype=bool)
    for k in range(len(sample)):
        if open_[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            open_ &= sample @ sample[k] < least
    return sample[chosen]


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row per vector: ``vec_id, n_links, component_id, kept``; compared are all vectors, by cosine in double precision.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are kept. Vectors
    compare with those of their own dimension only. Rows that repeat a vec_id are vectors of their own that share a name: each is
    returned, with the links of all of them. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "vectors")
    rows = usable_vectors(vectors)
    contents = scratch.write(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "contents")
    found = None
    for size in [r.size for r in contents.select(F.size("v").alias("size")).distinct().collect()]:
        part = contents.where(F.size("v") == size).select("id", "w", "v")
        one = _one_dimension(spark, scratch, part, threshold, block)
        found = one if found is None else found.unionByName(one)
    base = vectors.select("vec_id")
    if found is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comps = connected_components(spark, found.where("id <> root").select("id", "root").distinct(), scratch)
    named = contents.join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    named = rows.join(named, "v").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "id").alias("component_id"))
    per = named.groupBy("vec_id").agg(F.max("n").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.join(per, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _one_dimension(spark: SparkSession, scratch: Scratch, part: DataFrame, threshold: float, block: int) -> DataFrame:
    n = part.count()
    sample = part.select("v", F.xxhash64("v").alias("o")).orderBy("o", "v").limit(SAMPLE).select("v").toPandas()["v"]
    pivots = _net(unit(np.array(sample.tolist(), dtype=float)), min(PIVOTS, max(1, math.ceil(n / block))))
    cells = scratch.write(part.mapInArrow(_assigned(spark.sparkContext.broadcast(pivots)), "id long, w long, v array<double>, cell long, far double"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # one row a pivot
    parts = {r.cell: math.ceil(r.n / block) for r in sizes}
    far = np.full(len(pivots), -np.inf)
    for r in sizes:
        far[r.cell] = r.far + 1e-6
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    near = apart <= math.sqrt(2 - 2 * threshold) + far[:, None] + far[None] + _SLACK
    trees = sum(parts.values())
    size = min(BUNDLE, math.ceil(trees / BUNDLES))
    starts = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    of = spark.createDataFrame([(c, k, starts[c]) for c, k in parts.items()], "cell long, parts int, start long")
    dealt = cells.join(F.broadcast(of), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long")).withColumn("bundle", F.floor((F.col("start") + F.col("part")) / size))
    grouped = dealt.groupBy("bundle", "cell", "part").agg(F.collect_list(F.struct("id", "w", "v")).alias("m"))
    holds = np.zeros((math.ceil(trees / size), len(pivots)))
    for c, k in parts.items():
        holds[starts[c] // size : (starts[c] + k - 1) // size + 1, c] = 1
    pairs = np.argwhere(np.triu(holds @ near @ holds.T > 0)).tolist()
    wanted = spark.createDataFrame([(b, i, j) for i, j in pairs for b in {i, j}], "bundle long, i long, j long")
    with records_per_batch(spark, TREES):
        grown = scratch.write(grouped.mapInArrow(_planted, "bundle long, cell long, tree binary"), "trees")
        met = grown.join(F.broadcast(wanted), "bundle").repartition(len(pairs), "i", "j").sortWithinPartitions("i", "j")
        found = scratch.write(met.mapInArrow(_compared(threshold, spark.sparkContext.broadcast(near)), "id long, n long, root long"), "found")
    scratch.drop(cells, grown)
    return found
