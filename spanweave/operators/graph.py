"""Sequence graphs out of interval leaves: segments, links, paths; and components over pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import last_path, settled
from .intervals import cells_of


def segments(leaves: DataFrame, source: str, most: int, *, start: str = "s", end: str = "e") -> DataFrame:
    """Segments of each source: covered cells between leaf boundaries, chopped to at most `most`: source, s, e."""
    cells = cells_of(leaves, [source], start, end)
    cut = cells.select(source, "ce", F.explode(F.sequence(F.col("cs"), F.col("ce") - 1, F.lit(most).cast("long"))).alias("s"))
    return cut.select(source, "s", F.least(F.col("s") + most, "ce").alias("e"))


def path_steps(paths: DataFrame, pieces: DataFrame, source: str, *, start: str = "s", end: str = "e") -> DataFrame:
    """Each path interval as the segments it runs over, in order: the path's columns, ordinal, segment ends (ss, se)."""
    inside = paths.join(pieces.select(F.col(source), F.col("s").alias("ss"), F.col("e").alias("se")), source).where((F.col("ss") >= F.col(start)) & (F.col("se") <= F.col(end)))
    return inside.withColumn("ordinal", F.row_number().over(Window.partitionBy(*paths.columns).orderBy("ss")))


def links(steps: DataFrame, path: Sequence[str], node: str, order: str, rank: str) -> DataFrame:
    """Distinct links between consecutive nodes of paths, in canonical direction, with their smallest rank: a, b, rank."""
    following = F.lead(node).over(Window.partitionBy(*path).orderBy(order))
    pairs = steps.select(F.col(node).alias("x"), following.alias("y"), F.col(rank).alias("rank")).where("y IS NOT NULL")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("rank").alias("rank"))


def path_text(steps: DataFrame, path: Sequence[str], node: str, order: str) -> DataFrame:
    """The oriented walk of each path as text: >1>2>3. A path's text is one value, so its steps come together."""
    parts = F.sort_array(F.collect_list(F.struct(order, F.concat(F.lit(">"), F.col(node).cast("string")).alias("t"))))
    return steps.groupBy(*path).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("walk"))


def preblocks(df: DataFrame, keys: Sequence[str], gap: int, *, start: str = "s", end: str = "e") -> DataFrame:
    """Blocks of rows that follow one another with gaps of at most `gap`: column block, from 1 in each key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    past = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col(start) - past > gap).cast("int"), F.lit(1))
    return df.withColumn("_cut", cut).withColumn("block", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def components(pairs: DataFrame, most: int = 64) -> DataFrame:
    """The smallest id each node of the pairs (a, b) reaches: node, component. Each round takes the least label among neighbours and then that label's own label; it ends when the sum of labels stands still."""
    both = settled(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    mark, old = None, []
    for _ in range(most):
        met = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("lb"))
        hooked = labels.join(met, "node").select("node", F.least("component", "lb").alias("component"))
        jumped = hooked.join(hooked.select(F.col("node").alias("component"), F.col("component").alias("c2")), "component", "left").select("node", F.least("component", "c2").alias("component"))
        labels = settled(jumped, old)
        old = [last_path()]
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            return labels
        mark = now
    raise RuntimeError("components did not settle")
