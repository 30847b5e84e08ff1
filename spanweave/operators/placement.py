"""Names, tiers and placement of intervals on other axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The column's values by a table (old, new); values that it lacks stay."""
    table = names.select(F.col("old").alias(column), F.col("new").alias("_new")).dropDuplicates([column])
    return df.join(table, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def prefixed(name: Column, sample: Column, haplotype: Column) -> Column:
    """A contig name with exactly one SAMPLE#N# in front, whether it had one or not."""
    front = F.concat(sample, F.lit("#"), haplotype.cast("string"), F.lit("#"))
    return F.when(F.startswith(name, front), name).otherwise(F.concat(front, name))


def allele_value(values: Column, allele: Column) -> Column:
    """The value of an allele, from 1, in a comma list with one value an allele; null beyond it or for a point."""
    return F.nullif(F.get(F.split(values, ","), allele.cast("int") - 1), F.lit("."))


def first_tier(df: DataFrame, keys: Sequence[str], tier: str) -> DataFrame:
    """Rows of the lowest tier that a key has."""
    return df.withColumn("_t", F.min(tier).over(Window.partitionBy(*keys))).where(F.col("_t") == F.col(tier)).drop("_t")


def best_regions(df: DataFrame, keys: Sequence[str], raw: str, length: str, share: float) -> DataFrame:
    """Rows whose raw score by length exceeds `share` of the key's best, with their rank; equal rates go by the raw score."""
    rated = df.withColumn("rate", F.col(raw) / F.col(length))
    window = Window.partitionBy(*keys)
    ranked = rated.withColumn("rank", F.row_number().over(window.orderBy(F.col("rate").desc(), F.col(raw).desc(), length)))
    return ranked.withColumn("_b", F.max("rate").over(window)).where(F.col("rate") > share * F.col("_b")).drop("_b")


def within_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], distance: int, *, bin_width: int, a_ends: tuple[str, str] = ("s", "e"), b_ends: tuple[str, str] = ("s2", "e2")) -> DataFrame:
    """Pairs of a key's intervals with at most `distance` positions between them."""
    (s, e), (s2, e2) = a_ends, b_ends
    wide = a.withColumns({"_lo": F.col(s) - distance - 1, "_hi": F.col(e) + distance + 1})
    return overlap_join(wide, b, keys, bin_width=bin_width, a_ends=("_lo", "_hi"), b_ends=b_ends).drop("_lo", "_hi")


def most_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str, *, bin_width: int, a_ends: tuple[str, str] = ("s", "e"), b_ends: tuple[str, str] = ("s2", "e2")) -> DataFrame:
    """For each interval of a the one of b with the largest overlap, the smaller id among equals: keys, a_id, b_id, overlap."""
    size = F.least(a_ends[1], b_ends[1]) - F.greatest(a_ends[0], b_ends[0])
    pairs = overlap_join(a, b, keys, bin_width=bin_width, a_ends=a_ends, b_ends=b_ends).withColumn("overlap", size)
    best = pairs.groupBy(*keys, a_id).agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.col(b_id).alias("i"))).alias("_x"))
    return best.select(*keys, a_id, F.col("_x.i").alias(b_id), (-F.col("_x.o")).alias("overlap"))


def rebased(events: DataFrame, pieces: DataFrame, keys: Sequence[str], *, bin_width: int) -> DataFrame:
    """Events (s, e) that lie in one piece (ts, te, locus, ls) of their key, in the piece's coordinates: the events' columns, locus, locus_s, locus_e."""
    held = overlap_join(events, pieces, keys, bin_width=bin_width, a_ends=("s", "e"), b_ends=("ts", "te"), extra=(F.col("ts") <= F.col("s")) & (F.col("e") <= F.col("te")))
    moved = F.col("ls") - F.col("ts")
    return held.withColumns({"locus_s": F.col("s") + moved, "locus_e": F.col("e") + moved}).drop("ts", "te", "ls")


def joined_pieces(df: DataFrame, keys: Sequence[str], text: str, start: str = "s", end: str = "e") -> DataFrame:
    """Pieces that touch, as one, with their texts in order: keys, s, e, text."""
    order = Window.partitionBy(*keys).orderBy(start)
    cut = F.when(F.lag(end).over(order) == F.col(start), 0).otherwise(1)
    placed = df.withColumn("_cut", cut).withColumn("_i", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(start, text))), lambda p: p[text])  # the text of one joined piece
    return placed.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.array_join(parts, "").alias(text)).drop("_i")


def edited(reference: Column, edits: Column) -> Column:
    """The reference with edits, an array of (s, e, alt) that don't overlap, applied from left to right."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substr(reference, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.struct(x["e"].cast("long").alias("at"), F.concat(acc["out"], kept, x["alt"]).alias("out"))

    done = F.aggregate(F.sort_array(edits), start, step)
    return F.concat(done["out"], F.substr(reference, (done["at"] + 1).cast("int"), F.length(reference)))


def total_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Totals of both tables by key and what they differ by; keys that only one has count as zero in the other."""
    left = a.groupBy(*keys).agg(*[F.sum(c).alias(f"a_{c}") for c in columns])
    right = b.groupBy(*keys).agg(*[F.sum(c).alias(f"b_{c}") for c in columns])
    both = left.join(right, list(keys), "full").fillna(0, [*(f"a_{c}" for c in columns), *(f"b_{c}" for c in columns)])
    return both.withColumns({f"d_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in columns})
