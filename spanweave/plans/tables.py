"""The interval tables that the queries run on, out of the ordinary test tables; each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """lineitem as intervals of days: k (part), s, e, flag, supp, prio, id (unique in k). With `parts` (k), only of these."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem")
    if parts is not None:
        lines = lines.join(parts.select(F.col("k").alias("l_partkey")), "l_partkey", "left_semi")
    return lines.select(
        F.col("l_partkey").alias("k"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("prio"), F.row_number().over(order).cast("long").alias("id")
    )


def spans_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shipments without an id, for operators that need none: no window, so no shuffle."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supp"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals of seconds: k (user), s, e, id, kind."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), at.alias("s"), (at + 1 + F.floor("value")).cast("long").alias("e"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))


DAY = "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))"
L = f"""L AS (SELECT l_partkey AS k, {DAY} AS s, {DAY} + CAST(l_quantity AS BIGINT) AS e, l_returnflag AS flag, l_suppkey AS supp, l_extendedprice AS prio,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS id FROM lineitem)"""
E = "E AS (SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 1 + CAST(floor(value) AS BIGINT) AS e, event_id AS id, event_type AS kind FROM events)"
D = "D AS (SELECT doc_id, lang, source, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents)"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as strings over a to z: doc_id, lang, source, t."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("t"))


def union_sql(name: str, source: str, keys: str, breaks: str = "s > pm") -> str:
    """The union of a relation's intervals as CTEs, the last of them called `name`."""
    by = f"PARTITION BY {keys} " if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""{name}_o AS (SELECT *, max(e) OVER ({by}ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {source} WHERE e > s),
  {name}_i AS (SELECT *, sum(CASE WHEN pm IS NULL OR {breaks} THEN 1 ELSE 0 END) OVER ({by}ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {name}_o),
  {name} AS (SELECT {group}min(s) AS s, max(e) AS e FROM {name}_i GROUP BY {group}g)"""


def cells_sql(name: str, source: str, keys: str) -> str:
    """Elementary cells (keys, cs, ce) of a relation's intervals."""
    return f"""{name}_p AS (SELECT DISTINCT {keys}, x FROM (SELECT {keys}, s AS x FROM {source} UNION ALL SELECT {keys}, e AS x FROM {source}) z),
  {name} AS (SELECT * FROM (SELECT {keys}, x AS cs, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS ce FROM {name}_p) z WHERE ce IS NOT NULL)"""


def coalesce_sql(source: str, keys: str, same: str = "") -> str:
    """Touching rows of a relation (keys, s, e) that agree on one more column, joined."""
    extra = f" AND lag({same}) OVER w IS NOT DISTINCT FROM {same}" if same else ""
    more = f", {same}" if same else ""
    return f"""SELECT {keys}{more}, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(b) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM (
    SELECT *, CASE WHEN lag(e) OVER w = s{extra} THEN 0 ELSE 1 END AS b FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY s)) z) y GROUP BY {keys}{more}, r"""
