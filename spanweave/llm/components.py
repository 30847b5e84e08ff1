"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

MAX_ROUNDS = 60
#: Edges that one task contracts: 16 MB of them.
TASK_EDGES = 1_000_000


def contract(batches):
    """The edges (u, v) that a task reads, as edges from each node to the smallest that these edges connect it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    rows = [(x, root) for x in up if (root := find(x)) != x]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["u", "v"])


def contracted(edges: DataFrame) -> DataFrame:
    return durable(edges.mapInArrow(contract, "u long, v long"), "cc-edges")


def are_stars(now: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has one."""
    parents = now.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
    return parents.where("m <> x").isEmpty() and now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has an edge: rows (node, component).

    edges: columns a and b (long); loops, repeats and both directions are allowed, null ends are left out. Each task first contracts the edges it reads to stars, at most TASK_EDGES at once; a smaller
    graph is then done. Others go on in rounds of large-star and small-star: each node's neighbours are joined to the smallest of them, first the larger ones, then the smaller
    ones, and tasks contract again, until all is stars. Hubs are only ever met by a minimum, which combines before the shuffle, and by a join, which adaptive execution splits. Every round is written to the shared folder, and no row is
    collected.
    """
    now = contracted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    for _ in range(MAX_ROUNDS):
        tasks = -(-now.count() // TASK_EDGES)
        now = contracted(now.coalesce(max(1, tasks)))
        if tasks <= 1 or are_stars(now):
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = durable(small.where("u <> v").distinct(), "cc-small")
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
