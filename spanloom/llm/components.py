"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import discard, materialize, slices


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        path, parent = [], self.parent
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def pairs(self) -> Iterator[tuple[int, int]]:
        return ((x, self.find(x)) for x in list(self.parent))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch of a partition as links to the smallest member of their trees."""
    for batch in slices(batches, 1 << 16):
        forest = Forest()
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            forest.join(a, b)
        if forest.parent:
            u, v = zip(*forest.pairs())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node that has a link to another; ``root`` is the component's smallest node.

    ``rows`` is a bound on the number of links, if one is known.

    ``links`` has two bigint columns of nodes, in any order and direction,
    repeats allowed; rows with a null or with equal ends are ignored. Each step is
    a group-by and a join on the link table; nothing is gathered.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges", rows)
    seen = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        before, edges = edges, materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "edges", 2 * state[0])
        discard(before)
    raise RuntimeError("components did not settle")
