"""Nearest neighbours through one navigable small-world graph per shard.

A shard's graph is stored as flat neighbour arrays, one row a node. Queries search every shard and
the shards' results are merged by distance and id.
"""

from __future__ import annotations

import heapq
import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresight.llm.vectors import matrix, of_main_length, usable
from foresight.llm.workspace import Workspace

#: Different vectors in a shard, about; queries that search a shard together, about.
SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Links of a new node in each layer; layer 0 keeps twice as many, and a few more until it is pruned.
LINKS = 12
SLACK = 8
BUILD_BEAM = 48
SEARCH_BEAM = 120


class Graph:
    """Layers of neighbour rows, -1 where a slot is empty; layer 0 holds all nodes."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int = LINKS) -> None:
        self.vectors, self.levels, self.links = vectors, levels, links
        n, top = len(vectors), int(levels.max(initial=0))
        self.width = [2 * links + SLACK] + [links + SLACK] * top
        self.layers = [np.full((n, w), -1, dtype=np.int32) for w in self.width]
        self.degree = [np.zeros(n, dtype=np.int32) for _ in self.width]
        self.entry, self.top = -1, -1
        self.mark, self.turn = np.zeros(n, dtype=np.int64), 0

    def distances(self, nodes, point: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - point
        return np.einsum("nd,nd->n", gap, gap)

    def beam(self, point: np.ndarray, starts: list[tuple[float, int]], size: int, layer: int) -> list:
        """The ``size`` nearest nodes that a best-first walk from ``starts`` meets, nearest first."""
        rows, degree, mark = self.layers[layer], self.degree[layer], self.mark
        self.turn += 1
        turn = self.turn
        for _, node in starts:
            mark[node] = turn
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, node) for d, node in starts]
        heapq.heapify(best)
        while open_:
            distance, node = heapq.heappop(open_)
            if len(best) >= size and distance > -best[0][0]:
                break
            near = rows[node, : degree[node]]
            near = near[mark[near] != turn]
            if not len(near):
                continue
            mark[near] = turn
            far = self.distances(near, point)
            if len(best) >= size:
                closer = far < -best[0][0]
                near, far = near[closer], far[closer]
            for d, other in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < size:
                    heapq.heappush(best, (-d, other))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, other))
                else:
                    continue
                heapq.heappush(open_, (d, other))
        return sorted((-d, node) for d, node in best)

    def descend(self, point: np.ndarray, layer: int) -> list[tuple[float, int]]:
        """The nearest node that greedy walks above ``layer`` reach."""
        at = [(float(self.distances([self.entry], point)[0]), self.entry)]
        for upper in range(self.top, layer, -1):
            at = self.beam(point, at, 1, upper)
        return at

    def spread(self, found: list[tuple[float, int]], size: int) -> list[int]:
        """Near nodes that are nearer to the point than to each other, then the nearest of the rest."""
        nodes = [node for _, node in found]
        if len(nodes) <= size:
            return nodes
        rows = self.vectors[nodes]
        square = np.einsum("nd,nd->n", rows, rows)
        apart = square[:, None] + square[None, :] - 2 * rows @ rows.T
        own = np.array([d for d, _ in found])
        covered = apart < own[:, None]
        kept: list[int] = []
        for i in range(len(nodes)):
            if not covered[i, kept].any():
                kept.append(i)
                if len(kept) == size:
                    break
        taken = set(kept)
        kept += [i for i in range(len(nodes)) if i not in taken][: size - len(kept)]
        return [nodes[i] for i in kept]

    def insert(self, node: int) -> None:
        point, level = self.vectors[node], int(self.levels[node])
        if self.entry >= 0:
            at = self.descend(point, min(level, self.top))
            for layer in range(min(level, self.top), -1, -1):
                at = self.beam(point, at, BUILD_BEAM, layer)
                chosen = self.spread(at, self.links)
                self.layers[layer][node, : len(chosen)] = chosen
                self.degree[layer][node] = len(chosen)
                for other in chosen:
                    self._add(layer, other, node)
        if level > self.top:
            self.entry, self.top = node, level

    def _add(self, layer: int, node: int, other: int) -> None:
        rows, degree = self.layers[layer], self.degree[layer]
        if degree[node] == self.width[layer]:
            near = rows[node]
            found = sorted(zip(self.distances(near, self.vectors[node]).tolist(), near.tolist(), strict=True))
            chosen = self.spread(found, self.width[layer] - SLACK)
            rows[node, : len(chosen)] = chosen
            rows[node, len(chosen) :] = -1
            degree[node] = len(chosen)
        rows[node, degree[node]] = other
        degree[node] += 1

    def flat(self, node: int) -> np.ndarray:
        """The node's neighbour rows of layer 0 to its own level, one after the other."""
        return np.concatenate([self.layers[k][node] for k in range(int(self.levels[node]) + 1)])

    @classmethod
    def load(cls, vectors: np.ndarray, levels: np.ndarray, flat: list[np.ndarray], links: int = LINKS) -> Graph:
        graph = cls(vectors, levels, links)
        edges = np.concatenate(([0], np.cumsum(graph.width)))
        for node, row in enumerate(flat):
            for layer, (a, b) in enumerate(pairwise(edges[: int(levels[node]) + 2])):
                graph.layers[layer][node] = row[a:b]
        for layer, rows in enumerate(graph.layers):
            graph.degree[layer] = (rows >= 0).sum(axis=1).astype(np.int32)
        graph.top = int(levels.max())
        graph.entry = int(np.flatnonzero(levels == graph.top)[0])
        return graph

    def search(self, point: np.ndarray, count: int, beam: int = SEARCH_BEAM) -> list[tuple[float, int]]:
        return self.beam(point, self.descend(point, 0), max(beam, count), 0)[:count]


def build(vectors: np.ndarray, links: int = LINKS) -> Graph:
    """Insert all rows in order; levels are drawn from a fixed seed."""
    levels = (-np.log(1 - np.random.default_rng(11).random(len(vectors))) / math.log(links)).astype(np.int64)
    graph = Graph(vectors, levels, links)
    for node in range(len(vectors)):
        graph.insert(node)
    return graph


def _index_shard(shard: pa.Table) -> pa.Table:
    vectors = matrix(shard.column("vector"))
    order = np.lexsort(vectors.T[::-1])  # placement must not decide the graph
    shard = shard.take(pa.array(order))
    graph = build(vectors[order])
    nodes = range(shard.num_rows)
    return pa.table(
        {
            "shard": shard.column("shard"),
            "node": pa.array(list(nodes), pa.int32()),
            "level": pa.array(graph.levels.astype(np.int32)),
            "links": pa.array([graph.flat(i) for i in nodes], pa.list_(pa.int32())),
            "ids": shard.column("ids"),
            "vector": shard.column("vector"),
        }
    )


def index(rows: DataFrame, space: Workspace, keep_ids: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The stored graphs of ``rows`` (id, vector): one row for each different vector.

    ``ids`` are the ``keep_ids`` smallest ids that carry the vector, all that a search can return.
    """
    by_id = Window.partitionBy("vector").orderBy("id")
    classes = space.put(
        rows.withColumn("_place", F.row_number().over(by_id))
        .filter(F.col("_place") <= keep_ids)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids")),
        "classes",
    )
    shards = max(1, math.ceil(classes.count() / shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    vector = classes.schema["vector"].dataType.simpleString()
    ids = classes.schema["ids"].dataType.simpleString()
    schema = f"shard int, node int, level int, links array<int>, ids {ids}, vector {vector}"
    return space.put(dealt.groupBy("shard").applyInArrow(_index_shard, schema), "graphs")


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _TYPES, strict=True)})
        nodes = left.sort_by("node")
        vectors = matrix(nodes.column("vector"))
        flat = nodes.column("links").combine_chunks()
        offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        graph = Graph.load(
            vectors, nodes.column("level").to_numpy(), [values[a:b] for a, b in pairwise(offsets)]
        )
        ids = nodes.column("ids").to_pylist()
        out = []
        for own, point in zip(right.column("id").to_pylist(), matrix(right.column("vector")), strict=True):
            near = sorted(
                (math.sqrt(d), i) for d, node in graph.search(point, k + 1) for i in ids[node] if i != own
            )
            out += [(own, i, d) for d, i in near[:k]]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, _TYPES, strict=True)})

    return run


_TYPES = (pa.int64(), pa.int64(), pa.float64())


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score (Euclidean distance, double) of the ``k`` nearest.

    Ids are integers. A query's own id is no candidate; ties go to the smaller id. Null or zero
    vectors, those with null or non-finite components or another length than most, and rows without
    an id take no part, neither as query nor as candidate. Repeated rows count once; of several
    vectors with one id the smallest counts. Equal vectors are one node, so copies cannot cut a graph
    apart, and each keeps the ``k + 1`` smallest ids. A table without a usable row gives no result;
    other columns are ignored.

    Shards are built in one task each, of bounded size, and every block of queries visits each shard
    once; what is merged is ``k`` rows a query and shard.
    """
    space = Workspace(rows.sparkSession, "hnsw")

    def clean(frame: DataFrame) -> DataFrame:
        picked = frame.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
        good = picked.filter(F.col("id").isNotNull() & usable(F.col("vector")))
        return good.groupBy("id").agg(F.min("vector").alias("vector"))

    candidates = of_main_length(space.put(clean(rows), "candidates"), "vector")
    graphs = index(candidates, space, k + 1, shard_rows)
    asked = space.put(
        clean(queries).join(candidates.select("id"), "id", "left_semi"), "queries"
    )  # left out: queries whose vector has another length
    shards = graphs.agg(F.max("shard")).first()[0]
    blocks = max(1, math.ceil(asked.count() / query_rows))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards if shards is not None else 0)))
    )
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
    )
