"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from introngrid.storage import materialize, release

#: Edges that one task contracts at most; tasks that share the work at least.
BLOCK, LEAST_BLOCKS = 500_000, 6


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least node of its component: what the given edges link, with fewer of them."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    low = np.arange(len(nodes))
    x, y = index[: len(a)], index[len(a) :]
    while True:  # hook to the smaller label, then shorten the paths
        lx, ly = low[x], low[y]
        open_ = lx != ly
        if not open_.any():
            break
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(low, np.maximum(lx, ly), np.minimum(lx, ly))
        while (low[low] != low).any():
            low = low[low]
    other = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[other], nodes[low[other]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars of the edges of one task, kept to about BLOCK edges at a time."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for frame in frames:
        a, b = forest(np.concatenate((a, frame["a"].to_numpy())), np.concatenate((b, frame["b"].to_numpy())))
        if len(a) > 2 * BLOCK:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = a[:0], b[:0]
    yield pd.DataFrame({"a": a, "b": b})


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges as a written table, and a signature of them taken on the way."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
    return table, (seen.get["n"], seen.get["s"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of edges (longs); component is the smallest node reachable.

    Blocks of edges are contracted to stars where they lie. Large-star and small-star
    rounds then join what is left with the minima of its end points, so a node with very
    many edges is split by the skew join and never gathered. Every round's edges are
    written to the shared folder. Self loops and null ends are ignored; an empty input
    gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    plain = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    blocks = max(LEAST_BLOCKS, -(-plain.count() // BLOCK))
    current, before = _written(plain.coalesce(blocks).mapInPandas(_contract, "a long, b long"))
    for _ in range(max_rounds if before[0] else 0):
        both = current.union(current.select(F.col("b"), F.col("a")))
        minima = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima")
        large = both.join(minima, "a").where((F.col("b") > F.col("a")) & (F.col("b") > F.col("m")))
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small, after = _written(lowest.select("a", F.col("m").alias("b")).union(moved).distinct())
        release(current, minima, large)
        current = small
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
