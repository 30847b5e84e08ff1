"""Set algebra over half-open integer intervals, per key.

Every operator takes the names of its key, start and end columns. Coordinates are 0-based, half-open, BIGINT. Intervals with reversed ends are turned round and empty ones
dropped. Unions, sweeps and run joining work in two levels: first inside (key, bin of the position), which many tasks share however hot a key is, then over what a bin leaves: its islands, its sums, its first and last run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def tidy(df: DataFrame, start: str = "s", end: str = "e") -> DataFrame:
    """Ends in order, as BIGINT, empty intervals dropped."""
    low, high = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    return df.withColumns({start: low, end: high}).where(F.col(start) < F.col(end))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, breaks: Column, aggregates: Sequence[Column] = ()) -> DataFrame:
    """Merge sorted neighbours; `breaks` is true where a row starts a new island, and may use _pm, the largest end before it."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = df.withColumn("_pm", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = before.withColumn("_i", F.sum((F.col("_pm").isNull() | breaks).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), *aggregates).drop("_i")


def union(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", *, gap: int = 0, strict: bool = False, bin_width: int = BIN) -> DataFrame:
    """Union per key. Inclusive: rows merge if the gap is at most `gap` (0: touching rows merge). Strict: if the gap is below `gap` (0: touching rows stay apart)."""
    gap_now = F.col(start) - F.col("_pm")
    breaks = gap_now >= gap if strict else gap_now > gap
    rows = tidy(df, start, end).select(*keys, start, end)
    local = islands(rows.withColumn("_bin", F.expr(f"`{start}` div {bin_width}")), [*keys, "_bin"], start, end, breaks).drop("_bin")
    return islands(local, keys, start, end, breaks)


def sweep(df: DataFrame, keys: Sequence[str], deltas: Sequence[str], at: str = "x", *, bin_width: int = BIN) -> DataFrame:
    """Cells between consecutive event positions: keys, s, e and the running sum of each delta. Events at one position are summed before the windows.

    The running sums are made inside (key, bin); what the bins before hold comes from one row a bin, so a hot key is spread over its bins. Null keys are a key of their own.
    """
    events = df.groupBy(*keys, at).agg(*[F.sum(d).alias(d) for d in deltas]).withColumn("_k", F.struct(*keys, F.expr(f"`{at}` div {bin_width}").alias("_bin")))
    bins = events.groupBy("_k").agg(F.min(at).alias("_first"), *[F.sum(d).alias(f"_t{i}") for i, d in enumerate(deltas)])
    by_bin = Window.partitionBy(*[F.col(f"_k.`{k}`") for k in keys]).orderBy("_k._bin")
    before = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select("_k", F.lead("_first").over(by_bin).alias("_next"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_c{i}") for i in range(len(deltas))])
    inside = Window.partitionBy("_k").orderBy(at)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    cells = events.select("_k", *keys, F.col(at).alias("s"), F.lead(at).over(inside).alias("_e"), *[F.sum(d).over(running).alias(d) for d in deltas]).join(carried, "_k")
    return cells.select(*keys, "s", F.coalesce("_e", "_next").alias("e"), *[(F.col(d) + F.col(f"_c{i}")).alias(d) for i, d in enumerate(deltas)]).where("e IS NOT NULL")


def events_of(df: DataFrame, keys: Sequence[str], start: str, end: str, deltas: dict[str, int]) -> DataFrame:
    up = df.select(*keys, F.col(start).alias("x"), *[F.lit(v).cast("long").alias(d) for d, v in deltas.items()])
    down = df.select(*keys, F.col(end).alias("x"), *[F.lit(-v).cast("long").alias(d) for d, v in deltas.items()])
    return up.unionAll(down)


def joined_runs(df: DataFrame, keys: Sequence[str], same: Sequence[str], start: str, end: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start)
    unchanged = F.lag(end).over(order) == F.col(start)
    for c in same:
        unchanged = unchanged & F.lag(c).over(order).eqNullSafe(F.col(c))
    marked = df.withColumn("_new", F.when(unchanged, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_i", *same).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def coalesce_runs(df: DataFrame, keys: Sequence[str], same: Sequence[str], start: str = "s", end: str = "e", *, bin_width: int = BIN) -> DataFrame:
    """Join touching rows that agree on the `same` columns. The rows of a key must be disjoint.

    Rows are joined inside (key, bin of the start); after that only the first and the last run of a bin can touch a run of another bin, so only these meet in one window a key.
    """
    here = [*keys, "_bin"]
    local = joined_runs(df.select(*keys, *same, start, end, F.expr(f"`{start}` div {bin_width}").alias("_bin")), here, same, start, end)
    order = Window.partitionBy(*here).orderBy(start)
    local = local.withColumn("_edge", F.lag(start).over(order).isNull() | F.lead(start).over(order).isNull())
    columns = [*keys, *same, start, end]
    return local.where("NOT _edge").select(*columns).unionAll(joined_runs(local.where("_edge"), keys, same, start, end).select(*columns))


def two_sides(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    left = events_of(union(a, keys, start, end), keys, start, end, {"a": 1, "b": 0})
    return sweep(left.unionAll(events_of(union(b, keys, start, end), keys, start, end, {"a": 0, "b": 1})), keys, ["a", "b"])


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """The union of a without the union of b."""
    cells = two_sides(a, b, keys, start, end).where("a > 0 AND b = 0")
    return coalesce_runs(cells, keys, []).withColumnsRenamed({"s": start, "e": end})


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Where the unions of a and b overlap."""
    return two_sides(a, b, keys, start, end).where("a > 0 AND b > 0").select(*keys, F.col("s").alias(start), F.col("e").alias(end))


def complement(df: DataFrame, bounds: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """The gaps of df's union inside each key's bounds, of which there may be several."""
    return subtract(bounds, df, keys, start, end)


def coverage(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Positions that any interval covers: keys, covered."""
    return union(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def overlap_length(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Positions that both unions cover: keys, overlap."""
    return intersect(a, b, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("overlap"))


def trim_then_merge(df: DataFrame, keys: Sequence[str], trim: int, start: str = "s", end: str = "e") -> DataFrame:
    """Both ends of every interval are trimmed before the union, so intervals that only touch there come apart."""
    trimmed = tidy(df, start, end).withColumns({start: F.col(start) + trim, end: F.col(end) - trim}).where(F.col(start) < F.col(end))
    return union(trimmed, keys, start, end)


def extend_clip_merge(df: DataFrame, keys: Sequence[str], flank: int, length: Column, start: str = "s", end: str = "e") -> DataFrame:
    """Intervals with flanks, clipped to [0, length), merged where they overlap or touch."""
    wide = tidy(df, start, end).withColumns({start: F.greatest(F.col(start) - flank, F.lit(0).cast("long")), end: F.least(F.col(end) + flank, length)}).where(F.col(start) < F.col(end))
    return union(wide, keys, start, end)


def depth_runs(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Runs of constant depth between each key's first start and last end, depth 0 included: keys, s, e, depth."""
    cells = sweep(events_of(tidy(df, start, end), keys, start, end, {"depth": 1}), keys, ["depth"])
    return coalesce_runs(cells, keys, ["depth"])


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], *, bin_width: int, a_ends: tuple[str, str] = ("s", "e"), b_ends: tuple[str, str] = ("s2", "e2"), extra: Column | None = None) -> DataFrame:
    """All pairs of rows of a key that overlap, each once. Columns of a and b other than the keys must differ in name.

    Both sides are put into every bin they touch and joined on (keys, bin); a pair is kept in the bin where its overlap starts. With bins about as wide as the intervals, work follows the number of pairs, and a hot
    key is spread over its bins.
    """
    (s, e), (s2, e2) = a_ends, b_ends
    left = a.where(F.col(s) < F.col(e)).withColumn("_bin", F.explode(F.sequence(F.expr(f"`{s}` div {bin_width}"), F.expr(f"(`{e}` - 1) div {bin_width}"))))
    right = b.where(F.col(s2) < F.col(e2)).withColumn("_bin", F.explode(F.sequence(F.expr(f"`{s2}` div {bin_width}"), F.expr(f"(`{e2}` - 1) div {bin_width}"))))
    joined = left.join(right, [*keys, "_bin"]).where((F.col(s) < F.col(e2)) & (F.col(s2) < F.col(e)) & (F.col("_bin") == F.expr(f"greatest(`{s}`, `{s2}`) div {bin_width}")))
    return (joined.where(extra) if extra is not None else joined).drop("_bin")


def cells_of(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Elementary cells between consecutive boundaries of a key that at least one interval covers: keys, cs, ce."""
    covered = sweep(events_of(tidy(df, start, end), keys, start, end, {"_d": 1}), keys, ["_d"]).where("_d > 0")
    return covered.select(*keys, F.col("s").alias("cs"), F.col("e").alias("ce"))


def cell_members(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """Each elementary cell with each interval that covers it: keys, cs, ce, the interval's ends and `columns`."""
    rows = tidy(df, start, end).select(*keys, start, end, *columns)
    return overlap_join(cells_of(rows, keys, start, end), rows, keys, bin_width=bin_width, a_ends=("cs", "ce"), b_ends=(start, end))


def active_sets(df: DataFrame, keys: Sequence[str], member: str, *, bin_width: int, start: str = "s", end: str = "e") -> DataFrame:
    """Disjoint spans with the constant, non-empty, sorted set of members that cover them: keys, s, e, members (joined by commas)."""
    per_cell = cell_members(df, keys, [member], bin_width=bin_width, start=start, end=end).groupBy(*keys, "cs", "ce").agg(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), ",").alias("members"))
    return coalesce_runs(per_cell.withColumnsRenamed({"cs": "s", "ce": "e"}), keys, ["members"])


def hull(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """The span from first start to last end of each key."""
    return tidy(df, start, end).groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end))
