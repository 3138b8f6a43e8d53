"""Connected components of an edge table.

Each task first joins the edges it has by union-find and passes on a star for each tree. Then
large-star and small-star steps, two grouped minima and joins each, contract what is left until all
edges point at the least node of their component. Every round is a written table, so a lost
executor costs at most a round; no node's neighbours are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


class UnionFind:
    """Disjoint sets of numbers; a set's root is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.join(a, b)
    if sets.up:
        nodes = list(sets.up)
        yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "b": pa.array([sets.root(x) for x in nodes], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (the least node it reaches) for each node of an edge (a, b), a != b."""
    e = edges.select("a", "b").mapInArrow(_forest, "a long, b long").filter("a <> b").distinct()
    e = scratch.save(e, f"{name}-0")
    k = 0
    while True:
        if e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e1 = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        k += 1
        e1 = scratch.save(e1, f"{name}-{k}")
        least = e1.groupBy("a").agg(F.min("b").alias("m"))
        e2 = e1.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        e = scratch.save(e2, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 2}", f"{name}-{k - 1}")
