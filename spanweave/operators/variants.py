"""Variant rows and observations of them: unions over samples, calls, pedigrees, filters over variant trees."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settled
from .segments import grouped


def exact_union(observations: DataFrame, key: Sequence[str], sample: str) -> DataFrame:
    """One row a variant key, with the number of distinct samples that carry it (nsup) and of observations (nobs).

    Distinct (key, sample) rows come first, so a variant that all samples carry is spread over them until its last count.
    """
    per_sample = observations.groupBy(*key, sample).agg(F.count("*").alias("_n"))
    return per_sample.groupBy(*key).agg(F.count(sample).alias("nsup"), F.sum("_n").alias("nobs"))


def fill_calls(sites: DataFrame, samples: DataFrame, observed: DataFrame, covered: DataFrame, site: Sequence[str], sample: str) -> DataFrame:
    """The call of every sample at every site: '1' observed, else '0' covered, else '.': sites' key, sample, call. The result itself has a row for each site and sample."""
    grid = sites.select(*site).distinct().crossJoin(F.broadcast(samples.select(sample).distinct()))  # the samples of one cohort
    seen = observed.select(*site, sample).distinct().withColumn("_o", F.lit(True))
    there = covered.select(*site, sample).distinct().withColumn("_c", F.lit(True))
    joined = grid.join(seen, [*site, sample], "left").join(there, [*site, sample], "left")
    return joined.select(*site, sample, F.when(F.col("_o"), "1").when(F.col("_c"), "0").otherwise(".").alias("call"))


def leader_groups(df: DataFrame, keys: Sequence[str], at: str, near: int, tie: Sequence[str]) -> DataFrame:
    """Rows within less than `near` of a leader, the first row that is in no group, join it: column leader (its position). Distances are to the leader and never chain.

    Keys are parted where neighbours lie `near` or more apart, since no group crosses there.
    """
    order = Window.partitionBy(*keys).orderBy(at, *tie)
    cut = F.coalesce((F.col(at) - F.lag(at).over(order) >= near).cast("int"), F.lit(1))
    parted = df.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, *tie])
        leaders, now = [], None
        for x in pdf[at]:
            if now is None or x - now >= near:
                now = x
            leaders.append(now)
        return pdf.assign(leader=leaders)

    return grouped(parted, keys, {"leader": "bigint"}, run).drop("part")


def trio_counts(flags: DataFrame, group: Sequence[str]) -> DataFrame:
    """Totals of a child's calls by parental support, from in_mother and in_father."""
    m, f = F.col("in_mother"), F.col("in_father")
    counts = flags.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(m).alias("mother"), F.count_if(f).alias("father"), F.count_if(m & f).alias("both"), F.count_if(m | f).alias("either"), F.count_if(~m & ~f).alias("neither")
    )
    return counts.withColumn("fraction", F.round(F.col("either") / F.nullif(F.col("total"), F.lit(0)), 6))


def levels(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """The level of every node whose chain of parents ends at a root (a null parent, or one that is no node): node, level from 0.

    Pointers double each round, so rounds follow the logarithm of the depth. While a chain is open, a round ends some; when none ends, only nodes on or below a cycle are left, which have no level.
    """
    nodes = tree.select(F.col(node).alias("node"), F.col(parent).alias("up")).dropDuplicates(["node"])
    known = nodes.select(F.col("node").alias("up")).withColumn("_k", F.lit(1))
    now = settled(nodes.join(known, "up", "left").select("node", F.when(F.col("_k").isNotNull(), F.col("up")).alias("up")).withColumn("level", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")))
    before, open_ = None, now.where("up IS NOT NULL").count()
    while open_ and open_ != before:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("level").alias("l2"))
        now = settled(now.join(above, "up", "left").select("node", F.col("up2").alias("up"), (F.col("level") + F.coalesce("l2", F.lit(0))).alias("level")))
        before, open_ = open_, now.where("up IS NOT NULL").count()
    return now.where("up IS NULL").select("node", "level")


def with_descendants(tree: DataFrame, node: str, parent: str, chosen: DataFrame) -> DataFrame:
    """The chosen nodes and all below them: node. Steps double each round, so rounds follow the logarithm of the depth; they end when nothing is added, cycles or not."""
    steps = settled(tree.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("up IS NOT NULL").distinct())
    found = settled(chosen.select(F.col(node).alias("node")).distinct())
    before, n = None, found.count()
    while n != before:
        below = steps.join(found.select(F.col("node").alias("up")), "up", "left_semi").select("node")
        found = settled(found.unionAll(below).distinct())
        steps = settled(steps.join(steps.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")).distinct())
        before, n = n, found.count()
    return found


def size_class(ref: Column, alt: Column, cutoff: int) -> Column:
    """SNP, INDEL or SV by the lengths of the alleles."""
    size = F.abs(F.length(ref) - F.length(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").when(size >= cutoff, "SV").otherwise("INDEL")


def cluster_events(df: DataFrame, block: Sequence[str], at: str, size: str, sample: str, event_id: str, *, radius: int, ratio: float = 0.3) -> DataFrame:
    """Clusters of events of a block, swept by position: an event joins the nearest open cluster whose representative lies within `radius` and differs in size by less than `ratio` of the larger, and that
    holds no event of its sample; else it opens one. Column cluster: the smallest event id in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, event_id])
        open_: list[dict] = []
        chosen = []
        for x, n, who in zip(pdf[at], pdf[size], pdf[sample]):
            open_ = [c for c in open_ if x - c["last"] <= radius] if len(open_) > 64 else open_
            fits = [c for c in open_ if x - c["at"] <= radius and abs(n - c["size"]) < ratio * max(n, c["size"], 1) and who not in c["samples"]]
            c = min(fits, key=lambda c: (x - c["at"], c["no"])) if fits else {"at": x, "size": n, "samples": set(), "no": len(chosen), "members": []}
            if not fits:
                open_.append(c)
            c["samples"].add(who)
            c["last"] = x
            chosen.append(c)
        ids: dict[int, int] = {}
        for c, i in zip(chosen, pdf[event_id]):
            ids[id(c)] = min(ids.get(id(c), i), i)
        return pdf.assign(cluster=[ids[id(c)] for c in chosen])

    schema = T.StructType([*df.schema.fields, T.StructField("cluster", T.LongType())])
    return df.groupBy(*block).applyInPandas(run, schema)
