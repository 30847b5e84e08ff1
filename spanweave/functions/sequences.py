"""Scalar functions on sequences, as column expressions. Case is a soft mask: capitals are unmasked, small letters masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes and their complements.
IUPAC = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENT = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, IUPAC, COMPLEMENT))


def count_of(sequence: Column, letters: str) -> Column:
    """How many characters of the sequence are among `letters`."""
    return (F.length(sequence) - F.length(F.translate(sequence, letters, ""))).cast("long")


def unmasked(sequence: Column) -> Column:
    return count_of(sequence, "ACGT")


def masked(sequence: Column) -> Column:
    return count_of(sequence, "acgt")


def novelty_score(sequence: Column, masked_weight: float) -> Column:
    return unmasked(sequence) + F.lit(masked_weight) * masked(sequence)


def canonical(kmer: Column, largest: bool = True) -> Column:
    """The larger (or smaller) of a k-mer and its reverse complement."""
    other = reverse_complement(kmer)
    return F.greatest(kmer, other) if largest else F.least(kmer, other)


def runs_of(sequence: Column, letters: str) -> Column:
    """Maximal runs of the letters: array of (s, e), 0-based and half-open. The characters are bound once and read by place, so a sequence costs its length."""

    def runs(chars: Column) -> Column:
        n = F.size(chars)
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        good = lambda i: F.coalesce(F.instr(F.lit(letters), F.get(chars, i)) > 0, F.lit(False)) & (i >= 0) & (i < n) & (F.get(chars, i) != "")
        starts = F.filter(at, lambda i: good(i) & ~F.coalesce(good(i - 1), F.lit(False)))
        ends = F.filter(at, lambda i: good(i) & ~F.coalesce(good(i + 1), F.lit(False)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("long").alias("s"), (e + 1).cast("long").alias("e")))

    return F.element_at(F.transform(F.array(F.split(sequence, "")), runs), 1)


def windows_of(length: Column, width: int) -> Column:
    """Consecutive windows of at most `width` over [0, length): array of (s, e)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(length.cast("long") - 1, F.lit(0).cast("long")), F.lit(width).cast("long"))
    return F.filter(F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + width, length.cast("long")).alias("e"))), lambda w: w["s"] < w["e"])
