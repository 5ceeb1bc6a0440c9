"""Approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct vector is a node of a neighbour graph. Lists start from blocks of random-projection cells and improve by rounds of Spark
joins: each node gathers its neighbours and a sample of those that list it, and introduces them to each
other; a node takes up whoever is nearer than the worst on its list. Queries then walk the graph greedily: a beam
of the best nodes so far is expanded, its unseen neighbours are scored, and the beam is renewed until it
holds nothing new. The walk starts from a bounded set of entry nodes and, as queries are indexed rows, from the query's own list.

Graph and walk use single-precision unit vectors. The best nodes of a walk, and whoever it saw that rounding alone
may have put behind the last answer, are scored again in double precision on the originals.
Equal vectors are one node, whatever their number; answers name the smallest ids among them.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch
from .vectors import matrix, unit, usable_vectors

#: Neighbours of a node, random-projection trees for the start, vectors in a cell, rounds of descent.
K, TREES, CELL, ROUNDS = 20, 3, 500, 4
#: Proposals of one meeting to a node, at most. A list takes K of them all anyway.
PROPOSALS = 10
#: Width of the beam, nodes expanded in a step, entry nodes.
BEAM, STEP, ENTRIES = 192, 48, 256
#: Steps after which a walk that still has open nodes is an error.
STEPS = 10_000
#: Nodes of the beam that are scored on the original vectors, at least.
RESCORED = 32
SALTS = 16


def rounding(size: int) -> float:
    """By how much the scores of two nodes of so many components can be out of order in single precision."""
    return 2 * (size + 4) * 2.0**-24


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = unit(matrix(batch.column("v"))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "h"])


def _rows(values: pa.Array) -> np.ndarray:
    """Single-precision rows of a binary column."""
    data = values.to_pylist()
    return np.frombuffer(b"".join(data), dtype=np.float32).reshape(len(data), -1)


def _coded(planes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes.value
        for batch in batches:
            x = _rows(batch.column("h"))
            for t in range(len(p)):
                code = ((x @ p[t].T > 0) @ (1 << np.arange(p[t].shape[0]))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(code)], names=["id", "h", "tree", "code"])

    return run


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, similarity) of the k best of each row of a similarity matrix, those at -2 left out."""
    k = min(k, sims.shape[1])
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(sims)), k)
    s = np.take_along_axis(sims, best, axis=1).ravel()
    ok = s > -2
    return row[ok], ids[best.ravel()[ok]], s[ok]


def _met_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.column("m"):
            ids, x = m.values.field("id").to_numpy(zero_copy_only=False), _rows(m.values.field("h"))
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            row, other, s = _top(ids, sims, K)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(other), pa.array(s.astype(np.float32))], names=["v", "u", "s"])


def _introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node meet: each is offered the best of the others that beat the worst on its list."""
    for batch in batches:
        out: list[tuple] = []
        for m in batch.column("m"):
            ids = m.values.field("id").to_numpy(zero_copy_only=False)
            x, worst = _rows(m.values.field("h")), m.values.field("worst").to_numpy(zero_copy_only=False)
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            sims[sims <= worst[:, None]] = -2
            row, other, s = _top(ids, sims, PROPOSALS)
            out.append((ids[row], other, s))
        if out:
            v, u, s = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(s.astype(np.float32))], names=["v", "u", "s"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar of each node, each once."""
    once = edges.groupBy("v", "u").agg(F.max("s").alias("s"))
    salted = once.withColumn("r", F.row_number().over(Window.partitionBy("v", F.pmod(F.xxhash64("u"), F.lit(SALTS))).orderBy(F.desc("s"), "u"))).where(F.col("r") <= k)
    return salted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where(F.col("r") <= k).select("v", "u", "s")


def _listed_by(graph: DataFrame, k: int, seed: int) -> DataFrame:
    """Up to k of those that list a node, drawn by hash; a hub's are thinned in parts first."""
    order = F.xxhash64("v", F.lit(seed))
    thin = graph.withColumn("r", F.row_number().over(Window.partitionBy("u", F.pmod(F.xxhash64("v"), F.lit(SALTS))).orderBy(order, "v"))).where(F.col("r") <= k)
    thin = thin.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(order, "v"))).where(F.col("r") <= k)
    return thin.select(F.col("u").alias("v"), F.col("v").alias("u"))


def neighbour_graph(spark: SparkSession, scratch: Scratch, singles: DataFrame, n: int, rounds: int = ROUNDS) -> DataFrame:
    """``v, u, s``: up to K approximate nearest neighbours u of each node v. ``singles``: ``id, h``."""
    size = len(singles.first().h) // 4
    bits = max(0, math.ceil(math.log2(max(1, n / CELL))))
    planes = spark.sparkContext.broadcast(np.random.default_rng(5).normal(size=(TREES, bits, size)).astype(np.float32))
    coded = singles.mapInArrow(_coded(planes), "id long, h binary, tree int, code long")
    cells = coded.select("tree", "code").groupBy("tree", "code").count().withColumn("parts", F.ceil(F.col("count") / (2 * CELL))).drop("count")
    part = F.pmod(F.xxhash64("id", "tree"), F.col("parts")).alias("part")
    blocks = coded.join(cells, ["tree", "code"]).select("tree", "code", part, "id", "h").groupBy("tree", "code", "part").agg(F.collect_list(F.struct("id", "h")).alias("m"))
    graph = scratch.write(_best(blocks.select("m").mapInArrow(_met_in_cells, "v long, u long, s float"), K), "start")
    for k in range(rounds):
        near = graph.select("v", "u").union(_listed_by(graph, K, k)).union(singles.select(F.col("id").alias("v"), F.col("id").alias("u"))).distinct()
        worst = graph.groupBy("v").agg(F.min("s").alias("s"), F.count("*").alias("n")).select(F.col("v").alias("u"), F.when(F.col("n") < K, F.lit(-2.0)).otherwise(F.col("s")).cast("float").alias("worst"))
        nodes = singles.withColumnRenamed("id", "u").join(worst, "u", "left").select("u", "h", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        meetings = near.join(nodes, "u").groupBy("v").agg(F.collect_list(F.struct(F.col("u").alias("id"), "h", "worst")).alias("m"))
        offered = meetings.select("m").mapInArrow(_introduced, "v long, u long, s float")
        renewed = scratch.write(_best(graph.unionByName(offered), K), f"round{k}")
        scratch.drop(graph)
        graph = renewed
    return graph


_STATE = "query long, h binary, seen array<long>, beam array<struct<id: long, s: float, open: boolean>>"
_BEAM = pa.list_(pa.struct([("id", pa.int64()), ("s", pa.float32()), ("open", pa.bool_())]))


def _entered(entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = entries.value
        for batch in batches:
            q = _rows(batch.column("h"))
            sims = q @ x.T
            seen, beams = [], []
            for k, own in enumerate(batch.column("query").to_pylist()):
                best = np.argsort(-sims[k], kind="stable")[:BEAM]
                beams.append([{"id": int(ids[j]), "s": float(sims[k, j]), "open": True} for j in best if ids[j] != own] + [{"id": own, "s": 2.0, "open": True}])
                seen.append([*ids.tolist(), own])
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("h"), pa.array(seen, pa.list_(pa.int64())), pa.array(beams, _BEAM)], names=["query", "h", "seen", "beam"])

    return run


def _width(beam: list[dict], h: bytes, k: int, least: int) -> int:
    """How many of a sorted beam (the query itself first) stay: ``least``, and all that rounding alone may have put behind the k-th."""
    if len(beam) <= least:
        return len(beam)
    low = beam[k]["s"] - rounding(len(h) // 4)
    return max(least, bisect_right(beam, -low, key=lambda b: -b["s"]))


def _stepped(k: int):
    """Closes the nodes that were expanded, scores what they led to and renews the beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, beams = [], []
            for h, old, beam, met in zip(batch.column("h").to_pylist(), batch.column("seen").to_pylist(), batch.column("beam").to_pylist(), batch.column("met"), strict=True):
                beam.sort(key=lambda b: (-b["s"], b["id"]))
                left = STEP
                for b in beam:
                    if b["open"] and left:
                        b["open"], left = False, left - 1
                if met.is_valid and len(met.values):
                    ids = met.values.field("id").to_numpy(zero_copy_only=False)
                    s = _rows(met.values.field("h")) @ np.frombuffer(h, dtype=np.float32)
                    beam += [{"id": int(i), "s": float(x), "open": True} for i, x in zip(ids, s, strict=True)]
                    old = old + ids.tolist()
                    beam.sort(key=lambda b: (-b["s"], b["id"]))
                beams.append(beam[: _width(beam, h, k, BEAM + 1)])
                seen.append(old if any(b["open"] for b in beams[-1]) else [])  # a walk that has ended asks no more
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("h"), pa.array(seen, pa.list_(pa.int64())), pa.array(beams, _BEAM)], names=["query", "h", "seen", "beam"])

    return run


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, ids = [], []
            for query, h, beam in zip(batch.column("query").to_pylist(), batch.column("h").to_pylist(), batch.column("beam").to_pylist(), strict=True):
                beam.sort(key=lambda b: (-b["s"], b["id"]))
                best = beam[: _width(beam, h, k, max(RESCORED, k + 1))]
                queries += [query] * len(best)
                ids += [b["id"] for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64())], names=["query", "id"])

    return run


def greedy_search(spark: SparkSession, scratch: Scratch, singles: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 5, steps: int = STEPS) -> DataFrame:
    """``query, id``: for each query (a node) the best nodes that its walk found, which ends when no node of the beam is open, itself among them: RESCORED, and all that may be among the k best but for rounding."""
    edges = graph.select("v", "u").union(_listed_by(graph, K, 99)).distinct()
    lists = scratch.write(edges.groupBy("v").agg(F.collect_list("u").alias("near")), "lists")
    first = singles.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).toPandas()
    entries = spark.sparkContext.broadcast((first["id"].to_numpy(), np.frombuffer(b"".join(first["h"]), dtype=np.float32).reshape(len(first), -1)))
    state = scratch.write(queries.join(singles.withColumnRenamed("id", "query"), "query").select("query", "h").mapInArrow(_entered(entries), _STATE), "state")
    for _ in range(steps):
        ordered = F.expr("slice(array_sort(filter(beam, b -> b.open), (x, y) -> case when x.s > y.s then -1 when x.s < y.s then 1 when x.id < y.id then -1 else 1 end), 1, %d)" % STEP)
        front = state.select("query", F.explode(ordered).alias("b")).select("query", F.col("b.id").alias("v"))
        # a step leads to STEP lists at most; what was seen is left out as a set, inside the row of its walk
        led = front.join(lists, "v").select("query", F.explode("near").alias("id")).groupBy("query").agg(F.collect_set("id").alias("ids"))
        new = led.join(state.select("query", "seen"), "query").select("query", F.explode(F.array_except("ids", "seen")).alias("id"))
        met = new.join(singles, "id").groupBy("query").agg(F.collect_list(F.struct("id", "h")).alias("met"))
        renewed = scratch.write(state.join(met, "query", "left").mapInArrow(_stepped(k), _STATE), "state")
        scratch.drop(state)
        state = renewed
        if not state.where(F.exists("beam", lambda b: b["open"])).limit(1).count():
            break
    else:
        raise RuntimeError("walks did not end")
    return state.select("query", "h", "beam").mapInArrow(_answers(k), "query long, id long")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = matrix(batch.column("a")), matrix(batch.column("b"))
        a, b = (x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x for x in (a, b))
        score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) if len(a) else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(score)], names=["query", "id", "score"])


def _few_of_each(rows: DataFrame, k: int) -> DataFrame:
    """``id, vec_id``: the k smallest vec_ids of each node; hot ones are thinned in parts first."""
    r = F.row_number().over(Window.partitionBy("id", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id"))
    some = rows.withColumn("r", r).where(F.col("r") <= k)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k).select("id", "vec_id")


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` the k nearest other rows by cosine, nearest first, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part; vectors meet those of their own dimension only;
    a query with fewer than k candidates gets them all; an empty table gives no rows; other columns are ignored. Rows that repeat a vec_id count as one.
    """
    scratch = Scratch(spark, "neighbours")
    rows = scratch.write(usable_vectors(vectors).where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    contents = scratch.write(rows.groupBy("v").agg(F.min("vec_id").alias("id")), "contents")
    out = None
    for size in [r.size for r in contents.select(F.size("v").alias("size")).distinct().collect()]:
        nodes = contents.where(F.size("v") == size)
        n = nodes.count()
        singles = scratch.write(nodes.mapInArrow(_singles, "id long, h binary"), "singles")
        named = rows.where(F.size("v") == size).join(nodes, "v").select("vec_id", "id")
        asked = named.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
        graph = neighbour_graph(spark, scratch, singles, n)
        found = greedy_search(spark, scratch, singles, graph, asked.select("query").distinct(), k)
        pairs = found.join(nodes.select("id", F.col("v").alias("b")), "id").join(nodes.select(F.col("id").alias("query"), F.col("v").alias("a")), "query")
        scored = pairs.select("query", "id", "a", "b").mapInArrow(_scored, "query long, id long, score double")
        answers = scored.join(_few_of_each(named, k + 1), "id").join(asked, "query").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        one = answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out
