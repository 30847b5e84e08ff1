"""Alignments: projection through them, left normal form of gaps, and dynamic programming for pairs of short texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.cigar import positions


def project(cigar: Column, at: Column) -> Column:
    """The reference position (from 0) of a query position, null where the query base has none."""
    hit = F.filter(positions(cigar), lambda o: o["op"].isin("=", "M", "X") & (o["q0"] <= at) & (at < o["q0"] + o["n"]))
    return F.get(F.transform(hit, lambda o: o["r0"] + at - o["q0"]), F.lit(0))


def sliced(cigar: Column, low: Column, high: Column) -> Column:
    """The part of an alignment that lies over query positions [low, high): array of (n, op), with gaps in the query kept strictly inside."""
    inner = F.filter(positions(cigar), lambda o: F.when(o["op"].isin("D", "N"), (o["q0"] > low) & (o["q0"] < high)).otherwise((o["q0"] < high) & (o["q0"] + o["n"] > low)))
    return F.transform(inner, lambda o: F.struct(F.when(o["op"].isin("D", "N"), o["n"]).otherwise(F.least(o["q0"] + o["n"], high) - F.greatest(o["q0"], low)).alias("n"), o["op"].alias("op")))


def leftmost(sequence: str, at: int, size: int) -> int:
    """The leftmost place of a gap of `size` bases at `at` that leaves the same sequence behind: it slides while the base before it equals its last base."""
    while at > 0 and sequence[at - 1] == sequence[at + size - 1]:
        at -= 1
    return at


def align_score(a: str, b: str, match: int = 2, mismatch: int = -4, opening: int = -4, extension: int = -1) -> int:
    """The best global score with affine gaps, a row at a time: a gap of n costs opening + n x extension. Gaps along a row are found by a running maximum, so each row is a few vector operations."""
    n = len(b)
    y = np.frombuffer(b.encode("utf-32-le"), "<u4")
    steps = np.arange(n + 1) * extension
    row = np.where(np.arange(n + 1) == 0, 0, opening + steps).astype(np.int64)
    up = np.full(n + 1, -(10**9), dtype=np.int64)
    for i, c in enumerate(a, 1):
        up = np.maximum(up, row + opening) + extension
        best = up.copy()
        best[0] = opening + i * extension
        best[1:] = np.maximum(best[1:], row[:-1] + np.where(y == ord(c), match, mismatch))
        runs = np.maximum.accumulate(best - steps)
        best[1:] = np.maximum(best[1:], opening + steps[1:] + runs[:-1])
        row = best
    return int(row[-1])


def common_weight(a: list, b: list, weights: dict) -> float:
    """The weight of the heaviest common subsequence of two lists of ids, each id with its weight (1 if it has none)."""
    row = [0.0] * (len(b) + 1)
    for x in a:
        before = 0.0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = max(row[j], row[j - 1], before + weights.get(x, 1.0) if x == y else 0.0)
            before = here
    return row[-1]


@F.pandas_udf(LongType())
def global_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else align_score(x, y) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(LongType())
def gap_position(sequence: pd.Series, at: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([leftmost(s, int(p), int(n)) for s, p, n in zip(sequence, at, size)])
