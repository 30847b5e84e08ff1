"""Alignment strings: runs of a count, an operation of =MXIDHSNP and, behind some, bases."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"(\d+)([=MXIDHSNP])([A-Za-z*]*)"
# Which operations use up query and reference.
QUERY_OPS, REFERENCE_OPS = "=MXIS", "=MXDN"
BASES = r"[ACGTNacgtn*]*"


def operations(cigar: Column) -> Column:
    """Array of (n, op, payload). Bases behind an operation are its payload."""
    parts = F.regexp_extract_all(cigar, F.lit(rf"\d+[=MXIDHSNP]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("long").alias("n"), F.regexp_extract(p, r"([=MXIDHSNP])", 1).alias("op")))


def span(cigar: Column, ops: str) -> Column:
    return F.aggregate(operations(cigar), F.lit(0).cast("long"), lambda acc, o: acc + F.when(F.instr(F.lit(ops), o["op"]) > 0, o["n"]).otherwise(0))


def query_span(cigar: Column) -> Column:
    return span(cigar, QUERY_OPS)


def reference_span(cigar: Column) -> Column:
    return span(cigar, REFERENCE_OPS)


def is_valid(cigar: Column) -> Column:
    """Whether the whole text is operations with optional bases."""
    return cigar.rlike(rf"^(\d+[=MXIDHSNP]{BASES})+$")


def strip_payload(cigar: Column) -> Column:
    """Lengths and operations without bases."""
    return F.array_join(F.regexp_extract_all(cigar, F.lit(r"\d+[=MXIDHSNP]"), F.lit(0)), "")


def positions(cigar: Column) -> Column:
    """Array of (ix, n, op, q0, r0): each operation with where it starts on query and reference, from 0."""
    start = F.struct(F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("r"), F.array().cast("array<struct<ix:int,n:bigint,op:string,q0:bigint,r0:bigint>>").alias("out"))

    def step(acc: Column, o: Column) -> Column:
        q = F.when(F.instr(F.lit(QUERY_OPS), o["op"]) > 0, o["n"]).otherwise(0)
        r = F.when(F.instr(F.lit(REFERENCE_OPS), o["op"]) > 0, o["n"]).otherwise(0)
        item = F.struct(F.size(acc["out"]).alias("ix"), o["n"].alias("n"), o["op"].alias("op"), acc["q"].alias("q0"), acc["r"].alias("r0"))
        return F.struct((acc["q"] + q).alias("q"), (acc["r"] + r).alias("r"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(operations(cigar), start, step, lambda acc: acc["out"])


def log_gap_score(cigar: Column, match: float = 4, mismatch: float = 8, opening: float = 12, per_log2: float = 100) -> Column:
    """match a matched base, -mismatch a mismatched one, and for each gap of n bases -(opening + per_log2 x log2 n)."""

    def worth(o: Column) -> Column:
        gap = F.lit(float(opening)) + F.lit(float(per_log2)) * F.log(o["n"].cast("double")) / F.lit(math.log(2))
        return F.when(o["op"].isin("=", "M"), o["n"] * float(match)).when(o["op"] == "X", o["n"] * float(-mismatch)).when(o["op"].isin("I", "D", "N"), -gap).otherwise(0.0)

    return F.aggregate(operations(cigar), F.lit(0.0), lambda acc, o: acc + worth(o))


def scored_runs(cigar: Column) -> Column:
    """Array of (n, op): neighbouring operations of one kind joined, M as =, without H and empty operations, which do not part their neighbours."""
    counted = F.regexp_replace(F.regexp_replace(strip_payload(cigar), r"\d+H", ""), r"(?<!\d)0+[=MXIDSNP]", "")
    runs = F.regexp_extract_all(F.translate(counted, "M", "="), F.lit("|".join(rf"(?:\d+{op})+" for op in "=XIDSNP")), F.lit(0))
    total = lambda run: F.aggregate(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)), F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))
    return F.transform(runs, lambda run: F.struct(total(run).alias("n"), F.right(run, F.lit(1)).alias("op")))


def summed(runs: Column, match: float, mismatch: float, opening: float, each: float) -> Column:
    """`match` and `mismatch` a base; a gap of n bases costs `opening` + `each` x n."""
    worth = lambda o: F.when(o["op"] == "=", o["n"] * match).when(o["op"] == "X", o["n"] * mismatch).when(o["op"].isin("I", "D"), -(o["n"] * each + opening)).otherwise(0)
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, o: acc + worth(o).cast("long"))


def pair_score(cigar: Column) -> Column:
    """Score of a whole pair: +4 a match, -8 a mismatch, -(24 + 8 n) a gap of n bases."""
    return summed(scored_runs(cigar), 4, -8, 24, 8)


def repair_score(cigar: Column) -> Column:
    """Score of a repaired pair of deletion and insertion: +1 a match, -4 a mismatch, -4 the first base of a gap and -1 each other."""
    return summed(scored_runs(cigar), 1, -4, 3, 1)


def masked_gap_score(cigar: Column, reference: Column, query: Column) -> Column:
    """+4 a match, -8 a mismatch, -(24 + 8 n + 160 log2(m + 1)) a gap of n bases, m of them lower-case in the sequence that holds them. Null for other operations, a gap beyond its sequence, or null sequences."""
    lower = lambda bases: F.length(bases) - F.length(F.regexp_replace(bases, "[a-z]", ""))

    def cost(bases: Column, at: Column, n: Column) -> Column:
        part = F.substr(bases, (at + 1).cast("int"), n.cast("int"))
        return F.when(at + n <= F.length(bases), n * 8.0 + 24.0 + F.log2(lower(part).cast("double") + 1.0) * 160.0)

    def step(acc: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        worth = F.when(op == "=", n * 4.0).when(op == "X", n * -8.0).when(op == "I", -cost(query, acc["q"], n)).when(op == "D", -cost(reference, acc["r"], n))
        return F.struct((acc["r"] + F.when(op == "I", 0).otherwise(n)).alias("r"), (acc["q"] + F.when(op == "D", 0).otherwise(n)).alias("q"), (acc["score"] + worth).alias("score"))

    start = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(0.0).alias("score"))
    inside = lambda acc: (acc["r"] <= F.length(reference)) & (acc["q"] <= F.length(query))
    return F.aggregate(scored_runs(cigar), start, step, lambda acc: F.when(inside(acc), acc["score"]))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row: Spark computes what higher-order functions hold anew wherever it is written."""
    return F.transform(F.array(value), then)[0]


def confident_part(cigar: Column, least: float = 100, match: float = 4, mismatch: float = 8, opening: float = 12, per_log2: float = 100) -> Column:
    """(q0, q1, r0, r1, cigar) of the alignment without its weak edges; null if nothing is left.

    From each side the score of the runs between the first and the last match is summed; where it falls below 0 the edge moves behind that run and the sum starts again, and it stays once the sum exceeds `least`. No gap is cut.
    """
    gap = lambda n: F.lit(float(opening)) + F.log2(n.cast("double")) * float(per_log2)
    worth = lambda o: F.when(o["op"] == "=", o["n"] * float(match)).when(o["op"] == "X", o["n"] * float(-mismatch)).when(o["op"].isin("I", "D"), -gap(o["n"])).otherwise(0.0)

    def weak(ordered: Column) -> Column:
        """How many leading runs go."""
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("cut"), F.lit(0.0).alias("sum"), F.lit(False).alias("done"))

        def step(acc: Column, o: Column) -> Column:
            now = acc["sum"] + worth(o)
            falls = ~acc["done"] & (now < 0)
            return F.struct((acc["i"] + 1).alias("i"), F.when(falls, acc["i"] + 1).otherwise(acc["cut"]).alias("cut"), F.when(falls, 0.0).otherwise(now).alias("sum"), (acc["done"] | (now > float(least))).alias("done"))

        return F.aggregate(ordered, start, step, lambda acc: acc["cut"])

    def used(part: Column, ops: str) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, o: acc + F.when(F.instr(F.lit(ops), o["op"]) > 0, o["n"]).otherwise(0))

    def kept(runs: Column, first: Column, inner: Column, cuts: Column) -> Column:
        left, right = cuts["left"], F.size(inner) - cuts["right"]
        head, rest = F.slice(runs, F.lit(1), first - 1 + left), F.slice(inner, left + 1, right - left)
        text = F.array_join(F.transform(rest, lambda o: F.concat(o["n"].cast("string"), o["op"])), "")
        made = lambda at, use: F.struct(at["q"].alias("q0"), (at["q"] + use["q"]).alias("q1"), at["r"].alias("r0"), (at["r"] + use["r"]).alias("r1"), text.alias("cigar"))
        return F.when(right > left, bound(both(head), lambda at: bound(both(rest), lambda use: made(at, use))))

    def part(runs: Column, kinds: Column) -> Column:
        first, last = F.array_position(kinds, "=").cast("int"), (F.size(runs) + 1 - F.array_position(F.reverse(kinds), "=")).cast("int")
        cuts = lambda inner: F.struct(weak(inner).alias("left"), weak(F.reverse(inner)).alias("right"))
        return bound(F.slice(runs, first, last - first + 1), lambda inner: bound(cuts(inner), lambda c: kept(runs, first, inner, c)))

    both = lambda runs: F.struct(used(runs, QUERY_OPS).alias("q"), used(runs, REFERENCE_OPS).alias("r"))
    return bound(scored_runs(cigar), lambda runs: bound(F.transform(runs, lambda o: o["op"]), lambda kinds: F.when(F.array_contains(kinds, "="), part(runs, kinds))))
