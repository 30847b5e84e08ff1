"""Elections: every position of a key gets one owner among the intervals that cover it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import cell_members, coalesce_runs


def elect(df: DataFrame, keys: Sequence[str], owner: str, order: Sequence[Column], columns: Sequence[str] = (), *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """The first interval by `order` owns each elementary cell; touching cells of one owner are joined: keys, s, e, owner.

    The winner of a cell is a minimum over (order, owner), which combines before the shuffle. End `order` with a unique column, or `owner` decides.
    """
    members = cell_members(df, keys, list(dict.fromkeys([owner, *columns])), bin_width=bin_width, start=start, end=end)
    window = Window.partitionBy(*keys, "cs").orderBy(*order, owner)
    winners = members.withColumn("_r", F.row_number().over(window)).where("_r = 1").select(*keys, F.col("cs").alias("s"), F.col("ce").alias("e"), owner)
    return coalesce_runs(winners, keys, [owner])


def longest_owned(owned: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Of an owner's fragments the longest, the leftmost among equals."""
    window = Window.partitionBy(*keys, owner).orderBy((F.col("e") - F.col("s")).desc(), "s")
    return owned.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def near_best(df: DataFrame, keys: Sequence[str], owner: str, score: str, share: float, *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """Cells with every interval whose score reaches `share` of the cell's best, joined where they touch: keys, s, e, owner."""
    members = cell_members(df, keys, [owner, score], bin_width=bin_width, start=start, end=end)
    best = F.max(score).over(Window.partitionBy(*keys, "cs"))
    kept = members.withColumn("_best", best).where(F.col(score) >= F.col("_best") * share).select(*keys, F.col("cs").alias("s"), F.col("ce").alias("e"), owner)
    return coalesce_runs(kept, [*keys, owner], [])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def weighted_vote(df: DataFrame, keys: Sequence[str], choice: Sequence[str], weight: Column) -> DataFrame:
    """The choice with the largest total weight of each key, ties to the smaller choice: keys, choice, weight, total."""
    votes = df.groupBy(*keys, *choice).agg(F.sum(weight).alias("weight"))
    totals = votes.withColumn("total", F.sum("weight").over(Window.partitionBy(*keys)))
    return first_by(totals, keys, [F.col("weight").desc(), *[F.col(c) for c in choice]])
