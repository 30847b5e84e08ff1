"""Joins by position, proximity and shared keys, beside overlap_join() of the intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def containment(points: DataFrame, records: DataFrame, keys: Sequence[str], order: Sequence[Column], *, bin_width: int, point: tuple[str, str], record: tuple[str, str], point_id: str) -> DataFrame:
    """The best record by `order` that contains each interval, end to end."""
    inside = overlap_join(points, records, keys, bin_width=bin_width, a_ends=point, b_ends=record, extra=(F.col(record[0]) <= F.col(point[0])) & (F.col(point[1]) <= F.col(record[1])))
    window = Window.partitionBy(*keys, point_id).orderBy(*order)
    return inside.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def neighbours(df: DataFrame, keys: Sequence[str], at: str, is_anchor: Column, *tie: str) -> DataFrame:
    """Each row with the positions of the last anchor at or before it and the next after it: columns before and after (null: none). An as-of join both ways, in one window."""
    order = Window.partitionBy(*keys).orderBy(at, *tie)
    here = F.when(is_anchor, F.col(at))
    return df.withColumns(
        {
            "before": F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first(here, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    )


def nearest_distance(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, *, start: str = "s", end: str = "e") -> DataFrame:
    """Distance of each point to the nearest of disjoint, sorted spans of its key, 0 inside, null without any: the points with distance.

    Points and spans are swept together, so each row meets only its neighbours.
    """
    p = points.select(F.struct(*points.columns).alias("_p"), *keys, F.col(at).alias("_x"), F.lit(None).cast("long").alias("_e"))
    q = spans.select(F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), *keys, F.col(start).alias("_x"), F.col(end).alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_x", F.col("_p").isNotNull())
    past = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(F.col("_p").isNull(), F.col("_x"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = p.unionAll(q).withColumns({"_past": past, "_next": coming}).where("_p IS NOT NULL")
    left = F.when(F.col("_past").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("_x") - F.col("_past") + 1))
    return both.select("_p.*", F.least(left, F.col("_next") - F.col("_x")).alias("distance"))


def proximity(a: DataFrame, b: DataFrame, keys: Sequence[str], at: str, at2: str, slop: int, extra: Column | None = None) -> DataFrame:
    """Pairs of rows of a key whose positions differ by `slop` at most: b is put into its bin and both neighbours, a into its own."""
    left = a.withColumn("_bin", F.floor(F.col(at) / slop).cast("long"))
    right = b.withColumn("_bin", F.explode(F.array(*[(F.floor(F.col(at2) / slop) + d).cast("long") for d in (-1, 0, 1)])))
    near = left.join(right, [*keys, "_bin"]).where(F.abs(F.col(at) - F.col(at2)) <= slop)
    return (near.where(extra) if extra is not None else near).drop("_bin")


def shared_key_pairs(df: DataFrame, item: str, group: str, most_groups: int, cap: int = 65535) -> DataFrame:
    """Pairs of groups with the number of distinct items they share, saturating at `cap`; items that occur in more than `most_groups` groups count for none: g1 < g2, shared.

    The limit is part of the operator's meaning, and bounds the pairs an item can make.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    counts = rows.groupBy("i").agg(F.count("*").alias("n")).where(f"n BETWEEN 2 AND {most_groups}")
    kept = rows.join(counts, "i").select("i", "g")
    pairs = kept.select("i", F.col("g").alias("g1")).join(kept.select("i", F.col("g").alias("g2")), "i").where("g1 < g2")
    return pairs.groupBy("g1", "g2").agg(F.least(F.count("*"), F.lit(cap)).alias("shared"))


def parent_flags(child: DataFrame, mother: DataFrame, father: DataFrame, on: Sequence[str]) -> DataFrame:
    """The child's rows with whether each parent has their key: in_mother, in_father."""
    m, f = mother.select(*on).distinct().withColumn("_m", F.lit(True)), father.select(*on).distinct().withColumn("_f", F.lit(True))
    joined = child.join(m, list(on), "left").join(f, list(on), "left")
    return joined.withColumns({"in_mother": F.coalesce("_m", F.lit(False)), "in_father": F.coalesce("_f", F.lit(False))}).drop("_m", "_f")
