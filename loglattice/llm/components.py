"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared

#: Links that a task thins out at once, about.
FOREST_LINKS = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of ``u, v``: each node to the least of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("u", "v")])
        size += batch.num_rows
        if size > FOREST_LINKS:
            held = [forest(*map(np.concatenate, zip(*held)))]
            if len(held[0][0]) > FOREST_LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held = []
            size = len(held[0][0]) if held else 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``), ``root`` the smallest node reachable.

    Each step takes the least neighbour of every node by a partial aggregate and
    joins it back, so a node with very many links is neither collected nor
    windowed; its join partition can be split.  Steps are written to the shared
    folder.  Before the first, each task replaces its own links by one for each
    node, to the least it reaches by these.  Null ends and loops are left out; no link gives no row.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = write_shared(edges, "star")
    # Of a group with many links a task keeps one for each node.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // FOREST_LINKS)
    edges = write_shared(edges.coalesce(tasks).mapInArrow(_thinned, "u long, v long"), "star")
    state = _state(edges)
    while state[0]:
        edges = write_shared(_small_star(_large_star(edges)), "star")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour, or to itself if it is smaller."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
