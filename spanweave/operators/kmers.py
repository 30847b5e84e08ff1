"""k-mers of sequences or texts: extraction, counts, filters, similarity and minimizers. All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement

CHUNK = 4096


def kmers(df: DataFrame, sequence: str, k: int, keys: list[str], *, valid: str | None = None) -> DataFrame:
    """Every k-mer with its 0-based position: keys, pos, kmer. With `valid`, a character class, k-mers that hold another character are left out.

    A sequence is first cut into chunks that overlap by k - 1, so that no row holds more than CHUNK k-mers; a lookahead then reads all k-mers of a chunk in one pass, and the chunk itself goes no further.
    """
    n = F.length(sequence)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - k) / CHUNK).cast("int"), F.lit(0))), lambda i: F.struct(i.alias("i"), F.substr(F.col(sequence), i * CHUNK + 1, F.lit(CHUNK + k - 1)).alias("c")))
    rows = df.where(n >= k).select(*keys, F.explode(chunks).alias("_x")).select(*keys, "_x.i", "_x.c")
    found = rows.select(*keys, "i", F.posexplode(F.regexp_extract_all("c", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("_p", "kmer"))
    out = found.select(*keys, (F.col("i") * CHUNK + F.col("_p")).cast("long").alias("pos"), "kmer")
    return out.where(F.col("kmer").rlike(f"^[{valid}]{{{k}}}$")) if valid else out


def packed(kmer: Column, k: int) -> Column:
    """A k-mer over ACGT, in either case, as a number of two bits a base, the first base highest; null if it holds another character. k is at most 31."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    low = digits if k <= 15 else F.right(digits, F.lit(15))
    value = F.conv(low, 4, 10).cast("long")
    for lo in range(k - 15, -15, -15) if k > 15 else ():
        if lo > 0:
            part = F.substring(digits, max(1, lo - 14), min(15, lo))
            value = value + F.shiftleft(F.conv(part, 4, 10).cast("long"), 2 * (k - lo))
    return F.when(F.upper(kmer).rlike(f"^[ACGT]{{{k}}}$"), value)


def both_strands(kmer: Column, k: int) -> Column:
    """The larger code of a k-mer and of its reverse complement."""
    return F.greatest(packed(kmer, k), packed(reverse_complement(F.upper(kmer)), k))


def occurrences(df: DataFrame, keys: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """How often each k-mer occurs (per key), saturating at `cap`: keys, kmer, n."""
    n = F.count("*")
    return df.groupBy(*(keys or []), "kmer").agg((F.least(n, F.lit(cap)) if cap else n).alias("n"))


def frequent_filter(df: DataFrame, most: int, *, contig: str | None = None, span: int | None = None, flank: int = 10_000, length: str = "length") -> DataFrame:
    """Occurrences of k-mers that occur at most `most` times. The counts of a hot k-mer combine before the shuffle; its rows meet only a join, which splits.

    With `span`, k-mers go as well whose neighbourhoods, `flank` to either side inside their `contig` (whose length is a column), cover more than that together. Only k-mers with enough occurrences to reach it are looked at.
    """
    counts = df.groupBy("kmer").agg(F.count("*").alias("_n"))
    rare = counts.where(F.col("_n") <= most).select("kmer")
    kept = df.join(rare, "kmer", "left_semi")
    return kept if span is None else kept.join(spread_kmers(df, counts.where((F.col("_n") <= most) & (F.col("_n") * (2 * flank) > span)), contig, span, flank, length), "kmer", "left_anti")


def spread_kmers(df: DataFrame, among: DataFrame, contig: str, span: int, flank: int, length: str) -> DataFrame:
    """Those k-mers of `among` whose neighbourhoods cover more than `span`: kmer. Both ends of a neighbourhood grow with its position, so each adds what lies beyond the one before it."""
    low, high = F.greatest(F.col("pos") - flank, F.lit(0).cast("long")), F.least(F.col("pos") + flank, F.col(length).cast("long"))
    places = df.join(among.select("kmer"), "kmer", "left_semi").select("kmer", F.col(contig).alias("_c"), low.alias("_s"), high.alias("_e"))
    order = Window.partitionBy("kmer").orderBy("_c", "_s", "_e")
    before = F.when(F.lag("_c").over(order).eqNullSafe(F.col("_c")), F.lag("_e").over(order))
    return places.withColumn("_new", F.col("_e") - F.greatest("_s", before)).groupBy("kmer").agg(F.sum("_new").alias("_t")).where(F.col("_t") > span).select("kmer")


def unique_per_block(df: DataFrame, block: Column) -> DataFrame:
    """k-mers that occur once in all, counted by the block their position lies in: block, n."""
    single = df.groupBy("kmer").agg(F.count("*").alias("_n"), F.min("pos").alias("pos")).where("_n = 1")
    return single.groupBy(block.alias("block")).agg(F.count("*").alias("n"))


def similarity(counts: DataFrame, group: str, pairs: DataFrame, *, repeats: bool = False) -> DataFrame:
    """Weighted overlap of the k-mer counts of two groups, for each pair (q, r): common, only_q, only_r, var_q, var_r and distance.

    counts: group, kmer, n. A shared k-mer weighs 1/n^2 of the reference's count, or 1/n with `repeats`; one that only one side has adds its own n^2 weighted so. Sums that only one side needs are made once a
    group, so that a pair costs its shared k-mers. Distance is 1 - common / sqrt(max(1, var_q) max(1, var_r)).
    """
    power = 1 if repeats else 2
    weight = lambda n: 1.0 / F.pow(n.cast("double"), F.lit(float(power)))
    square = lambda n: n.cast("double") * n
    own = counts.groupBy(F.col(group).alias("_g")).agg(F.sum(square(F.col("n")) * weight(F.col("n"))).alias("own"))
    q, r = counts.select(F.col(group).alias("q"), "kmer", F.col("n").alias("nq")), counts.select(F.col(group).alias("r"), "kmer", F.col("n").alias("nr"))
    met = pairs.select("q", "r").join(q, "q").join(r, ["r", "kmer"])
    shared = met.groupBy("q", "r").agg(
        F.sum(F.col("nq") * F.col("nr") * weight(F.col("nr"))).alias("common"),
        F.sum(square(F.col("nq")) * weight(F.col("nr"))).alias("shared_q"),
        F.sum(square(F.col("nr")) * weight(F.col("nr"))).alias("shared_r"),
        F.sum(square(F.col("nq")) * weight(F.col("nq"))).alias("out_q"),
    )
    both = pairs.select("q", "r").join(shared, ["q", "r"], "left").join(own.withColumnsRenamed({"_g": "q", "own": "own_q"}), "q").join(own.withColumnsRenamed({"_g": "r", "own": "own_r"}), "r").fillna(0.0)
    sums = both.select("q", "r", "common", (F.col("own_q") - F.col("out_q")).alias("only_q"), (F.col("own_r") - F.col("shared_r")).alias("only_r"), (F.col("own_q") - F.col("out_q") + F.col("shared_q")).alias("var_q"), F.col("own_r").alias("var_r"))
    return sums.withColumn("distance", 1 - F.col("common") / F.sqrt(F.greatest(F.lit(1.0), "var_q") * F.greatest(F.lit(1.0), "var_r")))


def minimizers(df: DataFrame, keys: list[str], w: int, hashed: Column) -> DataFrame:
    """Positions whose hash is the least of some window of w consecutive k-mers, ties included: keys, pos, h. Rows: keys, pos, kmer.

    A position is one if it is no larger than all of a window that holds it: with `near` neighbours on the left, w - 1 - near on the right.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    rows = df.withColumn("h", hashed)
    minima = rows.withColumn("_m", F.min("h").over(order.rowsBetween(0, w - 1))).withColumn("_k", F.count("*").over(order.rowsBetween(0, w - 1)))
    total = F.count("*").over(Window.partitionBy(*keys))
    whole = minima.withColumn("_m", F.when((F.col("_k") == w) | (total < w), F.col("_m")))
    best = F.max("_m").over(order.rowsBetween(-(w - 1), 0))
    return whole.withColumn("_best", best).where(F.col("h") <= F.col("_best")).select(*keys, "pos", "h")


def match_matrix(counts: DataFrame, block: str, cap: int = 65535, *, single: float | None = None) -> DataFrame:
    """Sum over shared k-mers of the product of two blocks' counts, saturating: b1 <= b2, score. With `single`, k-mers that occur once in all weigh that much in their block's own sum, rounded half up over the block."""
    a, b = counts.select("kmer", F.col(block).alias("b1"), F.col("n").alias("n1")), counts.select("kmer", F.col(block).alias("b2"), F.col("n").alias("n2"))
    sums = a.join(b, "kmer").where("b1 <= b2").groupBy("b1", "b2").agg(F.sum(F.col("n1") * F.col("n2")).alias("score"))
    if single is not None:  # each of them has counted as one above
        alone = counts.groupBy("kmer").agg(F.sum("n").alias("_t"), F.min(block).alias("b1")).where("_t = 1").groupBy("b1").agg(F.count("*").alias("_c"))
        less = F.when(F.col("b1") == F.col("b2"), F.col("_c") - F.floor(F.col("_c") * F.lit(float(single)) + 0.5))
        sums = sums.join(alone, "b1", "left").withColumn("score", F.col("score") - F.coalesce(less, F.lit(0).cast("long")))
    return sums.select("b1", "b2", F.least("score", F.lit(cap)).alias("score"))
