"""Mixing sources to target weights by temperature.

Each source's share of tokens is raised to an exponent between 0 (all sources equal) and 1 (as found). The exponent is bisected until
the weights meet a target: an entropy, as a fraction of the largest possible, or a limit on repetition. The
weights become budgets of tokens. A source's documents fall into hash blocks; whole epochs take every block, and the last epoch takes the
first blocks of that epoch's permutation, until the budget is met to the nearest block.

Everything is DataFrame expressions. Aggregates shrink to one row a (source, block); documents themselves, texts included, are
never shuffled: whether a document is drawn, how often and where in the mixture follows from its own columns and its source's row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, scoped, whole_row

BLOCKS = 4096
#: Exponents tried in one pass over the sources; with the ends they cut the interval into 16.
PROBES = 15
PASSES = 7
#: Sources whose plan is sent to all tasks, 64 bytes each; of more, the join shuffles.
SENT_SOURCES = 200_000
WORD = "[^ \\t\\r\\n]+"


def n_words(text):
    """Words between white space: the token measure that needs no Python. A null or empty text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_slot(key, seed: str):
    """28 bits of the MD5 of seed and key: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 7), 16, 10).cast("long")


def permuted(block, epoch, n_blocks: int = BLOCKS):
    """The rank of a block in an epoch's permutation: an affine map, with an odd factor modulo a power of two."""
    return F.pmod(block * (2 * (epoch * 40503 % 1009) + 1237) + epoch * 2654 + 97, F.lit(n_blocks))


def bisect_exponent(totals: DataFrame, *, max_repeat: float | None = None, entropy: float | None = None, budget_tokens: int | None = None) -> float:
    """The largest exponent whose weights meet the target.

    totals: a row for each source with n_tokens > 0. Each pass is one aggregate over the sources that tries PROBES exponents and keeps the sixteenth of the interval
    where the target is first missed. Only sums come to the driver. Rounded to 6 digits.
    """
    lo, hi = 0.0, 1.0
    most = totals.agg(F.max("n_tokens").alias("m"), F.count("*").alias("k")).first()
    if not most["k"] or most["k"] == 1:
        return 1.0
    share = F.col("n_tokens") / F.lit(float(most["m"]))

    def meets(row, i: int) -> bool:
        if max_repeat is not None:
            return row[f"r{i}"] * (1 if budget_tokens is None else budget_tokens / (row[f"z{i}"] * most["m"])) <= max_repeat
        h = math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"]
        return h >= entropy * math.log(most["k"])

    for _ in range(PASSES):
        tried = [lo + (hi - lo) * i / (PROBES + 1) for i in range(PROBES + 2)]
        exprs = []
        for i, a in enumerate(tried):
            w = F.pow(share, F.lit(a))
            exprs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.lit(a) * F.log(share)).alias(f"s{i}"), F.max(F.pow(share, F.lit(a - 1.0))).alias(f"r{i}")]
        row = totals.agg(*exprs).first()
        # repetition shrinks as the exponent grows to 1, entropy grows as it falls to 0
        ok = [meets(row, i) for i in range(len(tried))]
        if max_repeat is not None:
            if ok[0]:
                return 0.0
            j = next((i for i in range(1, len(tried)) if ok[i]), len(tried) - 1)
        else:
            if ok[-1]:
                return 1.0
            j = next((i + 1 for i in range(len(tried) - 2, -1, -1) if ok[i]), 1)
        lo, hi = tried[j - 1], tried[j]
    return round(hi if max_repeat is not None else lo, 6)


@scoped
def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_repeat: float | None = 2.0,
    entropy: float | None = None,
    budget_tokens: int | None = None,
    seed: str = "mix:",
) -> DataFrame:
    """Draw documents so that sources have the tempered weights.

    Returns one row a drawn copy: r (the whole row of docs), source, n_tokens, weight, copy (from 0), block and mix_rank; reading in order of mix_rank
    gives the target weights in every stretch. Without budget_tokens the budget is the smallest that draws every source once in full, so no
    document is lost and none is drawn more than ceil(max_repeat) times. With it, sources get weight x budget
    tokens, to the nearest block, and may be cut. The exponent is the smallest that keeps to max_repeat, or the largest that
    reaches `entropy` (a fraction of log of the number of sources).

    A null source is a source of its own. A null or empty text has no tokens; it follows its block. A source without any token has weight 0 and is drawn once.
    Repeated rows are separate documents with one fate. An empty table gives no rows.
    """
    base = docs.select(whole_row(docs).alias("r"))
    measured = base.select(
        "r",
        F.coalesce(F.concat(F.lit("="), F.col("r").getField(source).cast("string")), F.lit("null")).alias("sk"),
        n_words(F.col("r").getField(text)).alias("n_tokens"),
        F.pmod(hash_slot(F.col("r").getField(key), seed), F.lit(BLOCKS)).alias("block"),
        hash_slot(F.col("r").getField(key), seed + "in:").alias("inner"),
    )
    blocks = durable(measured.groupBy("sk", "block").agg(F.sum("n_tokens").alias("in_block")), "mix-blocks")
    totals = durable(blocks.groupBy("sk").agg(F.sum("in_block").alias("n_tokens")), "mix-totals")
    counted = totals.where("n_tokens > 0")
    alpha = bisect_exponent(counted, max_repeat=max_repeat, entropy=entropy, budget_tokens=budget_tokens)
    sums = counted.agg(F.max("n_tokens").alias("m"), F.sum(F.pow(F.col("n_tokens"), F.lit(alpha))).alias("z")).first()
    most, z = float(sums["m"] or 1), float(sums["z"] or 1)
    tempered = F.pow(F.col("n_tokens"), F.lit(alpha))
    if budget_tokens is None:
        repeat = F.pow(F.lit(most) / F.col("n_tokens"), F.lit(1.0 - alpha))
    else:
        repeat = F.lit(float(budget_tokens)) * tempered / F.lit(z) / F.col("n_tokens")
    has = F.col("n_tokens") > 0
    budgets = (
        totals.withColumn("weight", F.when(has, F.round(tempered / F.lit(z), 9)).otherwise(0.0))
        .withColumn("quota", F.when(has, F.round(repeat * F.col("n_tokens")).cast("long")).otherwise(0))
        .withColumn("epochs", F.when(has, F.expr("quota div n_tokens")).otherwise(1))
        .withColumn("rest", F.when(has, F.expr("quota % n_tokens")).otherwise(0))
    )
    order = Window.partitionBy("sk").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = blocks.join(budgets, "sk").select("sk", "in_block", "rest", permuted(F.col("block"), F.col("epochs")).alias("rank")).withColumn("before", F.sum("in_block").over(order) - F.col("in_block"))
    fits = (F.col("rest") > 0) & (F.col("before") * 2 + F.col("in_block") <= F.col("rest") * 2)
    cut = ranked.groupBy("sk").agg(F.coalesce(F.max(F.when(fits, F.col("rank"))), F.lit(-1)).alias("last"))
    passes = F.when(F.col("quota") > 0, F.col("quota") / F.col("n_tokens")).otherwise(1.0)
    plan = durable(budgets.join(cut, "sk").select("sk", "weight", "epochs", "last", passes.alias("passes")), "mix-plan", keep=True)
    once_more = (permuted(F.col("block"), F.col("epochs")) <= F.col("last")).cast("int")
    small = plan.count() <= SENT_SOURCES
    drawn = measured.join(F.broadcast(plan) if small else plan, "sk").withColumn("copies", F.col("epochs") + once_more)
    copies = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    place = (permuted(F.col("block"), F.col("copy")) + F.col("inner") / F.lit(float(1 << 28))) / F.lit(float(BLOCKS))
    return copies.select("r", F.col("r").getField(source).alias("source"), "n_tokens", "weight", F.col("block").cast("int"), "copy", F.floor((F.col("copy") + place) / F.col("passes") * F.lit(1e12)).cast("long").alias("mix_rank"))
