"""Connected components: contraction inside tasks, then alternating large-star
and small-star rounds.

Edges are dealt to as many tasks as their number asks for.  Each task turns its
own into stars, which is all there is to do for one task's worth of edges; what
several tasks have is put together by rounds of joins and aggregations, each
written to the shared folder, so lineage stays short and a lost executor costs
one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges that one task contracts.
TASK_EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return tuple(row)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(u, v)`` to the stars of the components that these edges make."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while x != root:
            above[x], x = root, above[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    stars = [(x, top(x)) for x in list(above)]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["u", "v"])


def connected_components(links: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``links (a, b)`` of long nodes to ``(node, root)``, root being the
    smallest node of the component.  Nodes without links do not appear."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialize(edges, "edges")
    tasks = -(-edges.count() // task_edges)
    if tasks:
        edges = edges.coalesce(tasks) if tasks == 1 else edges.repartition(tasks, "v")
        edges = materialize(edges.mapInArrow(_contract, "u long, v long"), "edges")
    before = _state(edges) if tasks > 1 else (0,)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = (
            joined.where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = materialize(small, "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
