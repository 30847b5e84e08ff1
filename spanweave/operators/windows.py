"""Computations over neighbours in a sorted sequence of positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BIN, union


def hotspots(df: DataFrame, keys: Sequence[str], at: str, hits: int, window: int, *, width: int = 1, bin_width: int = BIN) -> DataFrame:
    """Spans where `hits` consecutive hits lie within less than `window`, joined if less than `window` apart: keys, s, e.

    A hit also goes into the bin that begins less than `window` behind it, so every bin holds all hits that can be the first of a dense run ending there; a hot key is spread over its bins.
    """
    bins = F.sequence(F.expr(f"`{at}` div {max(bin_width, window)}"), F.expr(f"(`{at}` + {window - 1}) div {max(bin_width, window)}"))
    order = Window.partitionBy(*keys, "_bin").orderBy(at)
    seen = df.select(*keys, at, F.explode(bins).alias("_bin")).withColumn("_first", F.lag(at, hits - 1).over(order))
    dense = seen.where((F.col("_bin") == F.expr(f"`{at}` div {max(bin_width, window)}")) & (F.col(at) - F.col("_first") < window))
    return union(dense.select(*keys, F.col("_first").alias("s"), (F.col(at) + width).alias("e")), keys, gap=window, strict=True)


def qualified_components(df: DataFrame, keys: Sequence[str], at: str, near: int, hits: int, span: int) -> DataFrame:
    """Chains of hits less than `near` apart that somewhere hold `hits` consecutive hits within `span`: keys, s (first), e (last), n."""
    order = Window.partitionBy(*keys).orderBy(at)
    breaks = F.coalesce((F.col(at) - F.lag(at).over(order) >= near).cast("int"), F.lit(1))
    chained = df.withColumn("_new", breaks).withColumn("_c", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_c").orderBy(at)
    tested = chained.withColumn("_ok", F.coalesce(F.col(at) - F.lag(at, hits - 1).over(inner) <= span, F.lit(False)))
    return tested.groupBy(*keys, "_c").agg(F.min(at).alias("s"), F.max(at).alias("e"), F.count("*").alias("n"), F.bool_or("_ok").alias("_ok")).where("_ok").drop("_c", "_ok")


def gaps_between(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Gaps inside each key between neighbours of its union: keys, s, e."""
    merged = union(df, keys, start, end)
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return merged.select(*keys, F.col(end).alias("s"), after.alias("e")).where("e IS NOT NULL")


def numbered_names(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """Names with _2, _3 ... on the second and later occurrence: column numbered."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", n).withColumn("numbered", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_n")))).drop("_n")


def offsets(df: DataFrame, keys: Sequence[str], length: str, order: Sequence[Column]) -> DataFrame:
    """Where each row starts if the rows of a key follow one another: column at."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("at", F.sum(length).over(before) - F.col(length))


def n50(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """The largest size such that sizes from it on hold half of the total: keys, n50, longest, total. Equal sizes are summed before the window."""
    sizes = df.groupBy(*keys, size).agg(F.sum(size).alias("_w"))
    down = Window.partitionBy(*keys).orderBy(F.col(size).desc())
    summed = sizes.withColumn("_c", F.sum("_w").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("_w").over(Window.partitionBy(*keys)))
    return summed.groupBy(*keys).agg(F.max(F.when(F.col("_c") * 2 >= F.col("total"), F.col(size))).alias("n50"), F.max(size).alias("longest"), F.max("total").alias("total"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key by `order`: column rank, from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
