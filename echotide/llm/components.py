"""Connected components of an edge table.

Tasks first connect what lies in their own chunk of at most CHUNK edges and return one edge per node, so a graph of one chunk
is done. Larger ones alternate that with large-star and small-star steps until nothing changes. Every step is a minimum per
node (combined before the shuffle) and a join with the edges; both sides of the join are stored tables, so adaptive execution
can split a node with very many edges. Only counts and a checksum per round reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echotide.llm.common import store

CHUNK = 500_000


class Forest:
    """Disjoint sets of a task; each is named by its smallest member."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while top in self.above:
            top = self.above[top]
        while x != top:
            self.above[x], x = top, self.above[x]
        return top

    def joined(self, x: int, y: int) -> bool:
        return self.root(x) == self.root(y)

    def join(self, x: int, y: int) -> bool:
        """True unless both were in one set."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _connected_chunks(edges: DataFrame, chunks: int) -> DataFrame:
    """The edges of each chunk as stars around the smallest node."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = np.array(list(forest.above), dtype=np.int64)
        tops = np.array([forest.root(x) for x in nodes.tolist()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    return store(edges.repartition(chunks).mapInArrow(run, "a long, b long"), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbours and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")), "least")
    hung = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
    return store(hung.distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges are (a, b) with a < b."""
    least = store(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    others = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return store(others.union(least.select(F.col("m").alias("a"), "b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b), component the smallest node reachable, itself included."""
    now = store(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "edges")
    before = None
    while True:
        n, check = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        chunks = -(-n // CHUNK)
        if not n or (n, check) == before:
            break
        before = (n, check)
        now = _connected_chunks(now, chunks)
        if chunks == 1:
            break
        now = _small_star(_large_star(now))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
