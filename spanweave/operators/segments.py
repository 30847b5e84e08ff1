"""Segmentations whose state is reset along the way, so that no window function expresses them.

Rows are first parted where a reset is certain, by window functions; each part is then walked by one grouped function. Parts are bounded by the data's own gaps, not by the size of a
key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parted(df: DataFrame, keys: Sequence[str], start: str, end: str, beyond: int) -> DataFrame:
    """Column part: rows of a key are in different parts if a gap of more than `beyond` lies between them."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    past = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col(start) - past > beyond).cast("int"), F.lit(1))
    return df.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def grouped(df: DataFrame, keys: Sequence[str], columns: dict[str, str], function, together: int = 256) -> DataFrame:
    """Apply a function of a pandas frame to each part of each key; it returns the frame with the new columns, given with their types. Up to `together` parts of a key share one call's overhead."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])
    names = schema.fieldNames()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([function(g) for _, g in pdf.groupby("part", sort=False)])[names]

    return df.withColumn("_g", F.expr(f"part div {together}")).groupBy(*keys, "_g").applyInPandas(run, schema)


def walked(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], step) -> DataFrame:
    """Walk rows in order, as parted() made them: step(state, start of a part?, values of `order`) gives the new state and the values of the new columns, given with their types.

    The window of parted() has brought a key's rows together in order, so one pass a task does it: no call a group, and only the state is held, however long a part is.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])
    first = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order)) == 1

    def run(batches):
        state = None
        for pdf in batches:
            found = []
            for new, *values in zip(pdf["_first"].tolist(), *[pdf[c].tolist() for c in order]):
                state, made = step(state, new, *values)
                found.append(made)
            pdf = pdf.drop(columns="_first")
            for i, c in enumerate(columns):
                pdf[c] = np.array([f[i] for f in found], "int64")
            yield pdf

    return df.withColumn("_first", first).mapInPandas(run, schema)


def score_breaks(df: DataFrame, keys: Sequence[str], hard_gap: int, start: str = "s", end: str = "e") -> DataFrame:
    """Segments of disjoint intervals: a gap breaks if the covered length less the gaps falls below zero at it, walking from the left or from the right and anew behind each break, or if it exceeds hard_gap. Column
    segment, from 0 in each part.

    A balance that starts anew when it falls below zero does so just where the plain running sum reaches a new minimum below zero, so each way is one running sum and one running minimum inside a part.
    """
    rows = parted(df, keys, start, end, hard_gap)
    order = Window.partitionBy(*keys, "part").orderBy(start)
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    gain = F.col(end) - F.col(start)
    sums = rows.withColumns({"_gap": F.lead(start).over(order) - F.col(end), "_back": F.col(start) - F.lag(end).over(order)})
    sums = sums.withColumns({"_l": F.sum(gain - F.coalesce("_gap", F.lit(0))).over(past), "_r": F.sum(gain - F.coalesce("_back", F.lit(0))).over(ahead)})
    lows = sums.withColumns({"_lm": F.min("_l").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_rm": F.min("_r").over(order.rowsBetween(1, Window.unboundedFollowing))})
    zero = F.lit(0).cast("long")
    behind = F.col("_gap").isNotNull() & (F.col("_l") < F.least(zero, F.coalesce("_lm", zero)))
    before = F.col("_back").isNotNull() & (F.col("_r") < F.least(zero, F.coalesce("_rm", zero)))
    cut = lows.withColumn("_b", behind).withColumn("_cut", (before | F.coalesce(F.lag("_b").over(order), F.lit(False))).cast("long"))
    return cut.withColumn("segment", F.sum("_cut").over(past)).drop("_gap", "_back", "_l", "_r", "_lm", "_rm", "_b", "_cut")


def capped_groups(df: DataFrame, keys: Sequence[str], gap: int, cap: int, start: str = "s", end: str = "e") -> DataFrame:
    """Neighbours at most `gap` apart form a group as long as it spans at most `cap`: column member_of, from 0 in each part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end])
        groups, group, first = [], -1, 0
        for s, e in zip(pdf[start], pdf[end]):
            if group < 0 or e - first > cap:
                group, first = group + 1, s
            groups.append(group)
        return pdf.assign(member_of=np.array(groups, "int64"))

    return grouped(parted(df, keys, start, end, gap), keys, {"member_of": "bigint"}, run)


def uniform_breakpoints(df: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """Breakpoints less than `gap` from their neighbour form a chain and all take its middle element (the upper of two): column uniform."""
    order = Window.partitionBy(*keys).orderBy(at)
    cut = F.coalesce((F.col(at) - F.lag(at).over(order) >= gap).cast("int"), F.lit(1))
    chained = df.withColumn("_cut", cut).withColumn("_c", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*keys, "_c")
    placed = chained.withColumn("_r", F.row_number().over(group.orderBy(at))).withColumn("_n", F.count("*").over(group))
    return placed.withColumn("uniform", F.max(F.when(F.col("_r") == F.expr("_n div 2") + 1, F.col(at))).over(group)).drop("_cut", "_c", "_r", "_n")


def main_chain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chain of paired blocks (q0, q1, t0, t1) with the most matched positions (q1 - q0), increasing without overlap on both axes: the chosen rows. Ties go to the chain that ends first on the target."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q0", "t0", "q1", "t1"]).reset_index(drop=True)
        ends = np.unique(pdf["t1"])
        best = [(0, -1)] * (len(ends) + 1)  # a Fenwick tree of prefix maxima over target ends
        score, back = np.zeros(len(pdf), "int64"), np.full(len(pdf), -1)
        by_end = pdf.sort_values(["q1"]).index.tolist()
        done = 0

        def put(i: int) -> None:
            p = int(np.searchsorted(ends, pdf.at[i, "t1"])) + 1
            while p <= len(ends):
                best[p] = max(best[p], (int(score[i]), -i))
                p += p & -p

        def get(t: int) -> tuple[int, int]:
            p, found = int(np.searchsorted(ends, t, side="right")), (0, 1)
            while p > 0:
                found = max(found, best[p]) if best[p][0] > 0 else found
                p -= p & -p
            return found

        for i in range(len(pdf)):
            while done < len(by_end) and pdf.at[by_end[done], "q1"] <= pdf.at[i, "q0"]:
                put(by_end[done])
                done += 1
            s, j = get(pdf.at[i, "t0"])
            score[i] = s + pdf.at[i, "q1"] - pdf.at[i, "q0"]
            back[i] = -j if s > 0 else -1
        chosen, i = [], int(score.argmax())
        while i >= 0:
            chosen.append(i)
            i = int(back[i])
        return pdf.loc[sorted(chosen)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)
