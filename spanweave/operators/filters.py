"""Filters by place, cuts of spans, and operators on walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import hull, islands, overlap_join, tidy, union


def away_from_edges(df: DataFrame, keys: Sequence[str], margin: int, start: str = "s", end: str = "e") -> DataFrame:
    """Rows that keep `margin` from both ends of their key's hull."""
    ends = hull(df, keys, start, end).withColumnsRenamed({start: "_lo", end: "_hi"})
    return df.join(ends, list(keys)).where((F.col(start) >= F.col("_lo") + margin) & (F.col(end) <= F.col("_hi") - margin)).drop("_lo", "_hi")


def without_overlaps(df: DataFrame, masks: DataFrame, keys: Sequence[str], row_id: Sequence[str], *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """Rows that overlap no mask of their key. Masks are united first, so that a row meets each stretch once."""
    united = union(masks, keys, start, end).withColumnsRenamed({start: "_ms", end: "_me"})
    met = overlap_join(df.select(*keys, start, end, *[c for c in row_id if c not in keys]), united, keys, bin_width=bin_width, a_ends=(start, end), b_ends=("_ms", "_me")).select(*row_id)
    return df.join(met, list(row_id), "left_anti")


def within(df: DataFrame, regions: DataFrame, keys: Sequence[str], row_id: Sequence[str], *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """Rows that lie whole inside one stretch of the united regions of their key."""
    united = union(regions, keys, start, end).withColumnsRenamed({start: "_ms", end: "_me"})
    held = overlap_join(df.select(*keys, start, end, *[c for c in row_id if c not in keys]), united, keys, bin_width=bin_width, a_ends=(start, end), b_ends=("_ms", "_me"), extra=(F.col("_ms") <= F.col(start)) & (F.col(end) <= F.col("_me")))
    return df.join(held.select(*row_id), list(row_id), "left_semi")


def grid_cut(df: DataFrame, most: int, start: str = "s", end: str = "e") -> DataFrame:
    """Spans cut into the fewest consecutive pieces of at most `most`, near equal in length: columns piece, ps, pe."""
    size = F.col(end) - F.col(start)
    n = F.ceil(size / most).cast("long")
    cut = df.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    edge = lambda i: F.col(start) + F.floor(size * i / F.col("_n")).cast("long")
    return cut.withColumns({"ps": edge(F.col("piece")), "pe": edge(F.col("piece") + 1)}).drop("_n")


def covered_groups(df: DataFrame, keys: Sequence[str], gap: int, least: int, start: str = "s", end: str = "e") -> DataFrame:
    """Groups of rows less than `gap` apart whose union covers at least `least`, or half of the group's span: keys, s, e, covered, n."""
    rows = tidy(df, start, end).select(*keys, start, end)
    counted = rows.groupBy(*keys, start, end).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = counted.withColumn("_past", F.max(end).over(order)).withColumn("_new", F.greatest(F.lit(0).cast("long"), F.col(end) - F.greatest(F.coalesce("_past", F.col(start)), F.col(start))))
    groups = islands(fresh, keys, start, end, F.col(start) - F.col("_pm") >= gap, [F.sum("_new").alias("covered"), F.sum("_c").alias("n")])
    return groups.where(F.col("covered") >= F.least(F.lit(least), F.expr(f"(`{end}` - `{start}`) div 2")))


def two_axis_join(events: DataFrame, runs: DataFrame, keys: Sequence[str], *, bin_width: int, event: tuple[str, str], other: str, run: tuple[str, str], run_other: tuple[str, str]) -> DataFrame:
    """Events with the runs that contain them on the first axis, end to end, and hold their position on the other."""
    inside = (F.col(run[0]) <= F.col(event[0])) & (F.col(event[1]) <= F.col(run[1])) & (F.col(run_other[0]) <= F.col(other)) & (F.col(other) < F.col(run_other[1]))
    return overlap_join(events, runs, keys, bin_width=bin_width, a_ends=event, b_ends=run, extra=inside)


def walk_slice(steps: DataFrame, path: Sequence[str], order: Sequence[Column], length: str, low: int, high: int) -> DataFrame:
    """The part [low, high) of each walk, whose steps follow one another: the steps it touches with from and to inside them."""
    running = Window.partitionBy(*path).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("_end", F.sum(length).over(running)).withColumn("_at", F.col("_end") - F.col(length))
    touched = placed.where((F.col("_at") < high) & (F.col("_end") > low))
    return touched.withColumns({"from": F.greatest(F.lit(low).cast("long"), "_at") - F.col("_at"), "to": F.least(F.lit(high).cast("long"), "_end") - F.col("_at")}).drop("_at", "_end")


def broken_walks(steps: DataFrame, path: Sequence[str], order: Sequence[Column], dropped: Column) -> DataFrame:
    """Walks without the dropped steps, broken where they were: column run, from 0 in each walk."""
    running = Window.partitionBy(*path).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("_d", dropped).withColumn("run", F.sum(F.col("_d").cast("int")).over(running)).where("NOT _d").drop("_d")


def missing_links(steps: DataFrame, links: DataFrame, path: Sequence[str], node: str, order: str) -> DataFrame:
    """Consecutive pairs of walks for which no link (a, b), in either direction, exists: a, b, n."""
    following = F.lead(node).over(Window.partitionBy(*path).orderBy(order))
    pairs = steps.select(F.col(node).alias("x"), following.alias("y")).where("y IS NOT NULL").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))
    return pairs.join(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")


def conflicting_names(df: DataFrame, name: str, content: str) -> DataFrame:
    """Names that stand for more than one content: name, kinds."""
    return df.groupBy(name).agg(F.count_distinct(content).alias("kinds")).where("kinds > 1")


def packed_trees(levels_with_root: DataFrame, root: str, most: int) -> DataFrame:
    """Whole trees in order of their roots, packed into bins of about `most` nodes: root, size, bin. Sizes are one row a tree; their running sum goes by blocks of roots, so no task holds all trees."""
    sizes = levels_with_root.groupBy(root).agg(F.count("*").alias("size")).withColumn("_b", F.expr(f"`{root}` div 100000"))
    blocks = sizes.groupBy("_b").agg(F.sum("size").alias("_s"))
    before = blocks.withColumn("_before", F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).select("_b", "_before")  # one row a block of roots
    inner = Window.partitionBy("_b").orderBy(root).rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.join(before, "_b").withColumn("_at", F.col("_before") + F.sum("size").over(inner) - F.col("size"))
    return placed.select(root, "size", F.expr(f"_at div {most}").alias("bin"))
