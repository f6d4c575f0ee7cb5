"""Connected components of an edge table by randomised contraction.

Each round every vertex moves to the neighbour (or itself) of least random rank, the edge table is rewritten
between representatives, and self loops and repeats vanish.  The expected number of vertices falls by a
constant factor a round, so rounds grow with the logarithm of the vertex count and not with the diameter.
Before each round a union-find inside every partition replaces that partition's edges by a spanning forest,
which loses no connection.  No adjacency list is ever gathered: a hub only meets partial minima and joins
that the adaptive planner can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.scratch import Scratch

#: So many edges, a few MB, fit into one task's union-find whatever they connect; more take another round.
FINISH = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if schema is not None:
        tied = [(x, find(x)) for x in list(parent) if parent[x] != x]
        for lo in range(0, len(tied), 50_000):
            part = tied[lo : lo + 50_000]
            yield pa.record_batch([pa.array([p[i] for p in part], schema.field(i).type) for i in (0, 1)], schema=schema)


def _thin(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, edges.schema)


def connected_components(edges: DataFrame, scratch: Scratch, finish: int = FINISH) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``; root is one node of the component.

    Nulls, self loops and repeated edges are ignored; an empty table gives an empty result.  Nodes may be of
    any orderable type.  Rows are whole at every size: nothing is collected or capped.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    kind = edges.schema["src"].dataType
    live = scratch.save(_thin(edges), "edges")
    steps: list[DataFrame] = []
    for k in count():
        left = live.count()
        if not left:
            break
        if left <= finish:
            steps.append(scratch.save(_thin(live.coalesce(1)).select(F.col("src").alias("node"), F.col("dst").alias("rep")), "step"))
            break
        both = live.union(live.select("dst", "src"))
        rank = lambda c: F.xxhash64(F.lit(k), c)  # noqa: E731, B023
        least = both.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(rank(F.col("dst")).alias("r"), F.col("dst").alias("v"))).alias("m"))
        own = F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("v"))
        step = scratch.save(least.select("node", F.least(F.col("m"), own)["v"].alias("rep")), "step")
        steps.append(step)
        moved = live.join(step.select(F.col("node").alias("src"), F.col("rep").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("rep").alias("b")), "dst")
        moved = moved.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct()
        done, live = live, scratch.save(_thin(moved), "edges")
        scratch.drop(done)
    scratch.drop(live)
    if not steps:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    out = None
    for step in reversed(steps):
        if out is None:
            out = step.select("node", F.col("rep").alias("root"))
        else:
            later = out.select(F.col("node").alias("rep"), "root")
            out = step.join(later, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return out.union(out.select("root", "root")).distinct()  # a root that its last round has left out is its own
