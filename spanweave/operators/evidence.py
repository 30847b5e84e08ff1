"""Evidence of placements: which calls, rows and anchors count, who owns a stretch, and what is left of it."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import masked, unmasked
from .election import elect
from .intervals import cell_members, coalesce_runs, overlap_join, subtract, tidy, union
from .segments import score_breaks

# The samples whose contigs are restricted, the prefix their names may carry, and the score of a valid region, which no candidate reaches.
RESTRICTED, PREFIX = "HG38_h1", "HG38#1#"
VALID_SCORE = 1e12


def accepted_contig(sample: Column, contig: Column) -> Column:
    """Whether a sample's contig takes part: of the restricted sample, the chromosomes 1 to 22, X and Y alone, with or without its prefix."""
    bare = F.regexp_replace(F.coalesce(contig, F.lit("")), f"^{PREFIX}", "")
    return F.coalesce(sample != RESTRICTED, F.lit(True)) | bare.rlike(r"^chr([1-9]|1[0-9]|2[0-2]|X|Y)$")


def qualifies(length: Column, bare: Column, *, longer: int | None = None, at_least: int | None = None, least: int = 0, share: float = 0.0) -> Column:
    """Whether a piece is long (longer than `longer`) or bare (at least `at_least` unmasked) enough, with at least `least` unmasked bases and `share` of its length."""
    enough = bare >= F.greatest(F.lit(float(least)), length * share)
    enough &= length > longer if longer is not None else F.lit(True)
    return enough & (bare >= at_least if at_least is not None else F.lit(True))


def content_of(spans: DataFrame, chunks: DataFrame, keys: Sequence[str], size: int, weight: float) -> DataFrame:
    """The score (unmasked + weight x masked bases) that each key's disjoint spans (name, s, e) hold. chunks: name, chunk, at, bases, of `size` without overlap; a span meets only the chunks it touches."""
    wanted = spans.withColumn("chunk", F.explode(F.sequence(F.expr(f"int(s div {size})"), F.expr(f"int((e - 1) div {size})"))))
    low = F.greatest(F.col("s") - F.col("at"), F.lit(0).cast("long"))
    part = F.substr("bases", (low + 1).cast("int"), F.greatest(F.col("e") - F.col("at") - low, F.lit(0).cast("long")).cast("int"))
    met = wanted.join(chunks, ["name", "chunk"]).select(*keys, part.alias("_b"))
    return met.groupBy(*keys).agg(F.sum(unmasked(F.col("_b")) + F.lit(weight) * masked(F.col("_b"))).alias("score"))


def novel_hits(hits: DataFrame, chunks: DataFrame, size: int, least: float, weight: float = 0.0, limits: DataFrame | None = None) -> DataFrame:
    """Hits (name, hit, s, e: several intervals each) whose united query intervals hold at least `least`, or their query's own `least` in limits: name, hit, score."""
    scored = content_of(union(hits, ["name", "hit"]), chunks, ["name", "hit"], size, weight)
    if limits is not None:
        scored = scored.join(limits.select("name", F.col("least").alias("_own")), "name", "left")
    return scored.where(F.col("score") >= (F.coalesce("_own", F.lit(float(least))) if limits is not None else F.lit(float(least)))).select("name", "hit", "score")


def query_core(records: DataFrame, loci: DataFrame, bounds: DataFrame, record: Sequence[str], contig: Sequence[str], trim: int) -> DataFrame:
    """Each record with why it goes: `missing` (no locus, or one on a contig without bounds), `edge` (a locus within `trim` of its contig's end), or null if it stays. loci: record, contig, s, e; bounds: contig, lo, hi."""
    near = (F.col("s") < F.col("lo") + trim) | (F.col("e") > F.col("hi") - trim)
    held = loci.join(bounds, list(contig), "left").groupBy(*record).agg(F.bool_or(F.col("lo").isNull()).alias("_missing"), F.bool_or(near).alias("_edge"))
    return records.join(held, list(record), "left").withColumn("reason", F.when(F.coalesce("_missing", F.lit(True)), "missing").when(F.col("_edge"), "edge")).drop("_missing", "_edge")


def reference_core(records: DataFrame, anchors: DataFrame, coverage: DataFrame, record: Sequence[str], place: Sequence[str], *, bin_width: int) -> DataFrame:
    """Each record with why it goes: `missing` (its place has no coverage), `edge` (no anchor, or one outside the covered spans), or null. anchors: record, place, at; coverage: place, s, e, trimmed already; records hold place."""
    spans = union(coverage, place)
    points = anchors.select(*record, *place, F.col("at").alias("_s"), (F.col("at") + 1).alias("_e"))
    inside = overlap_join(points, spans, place, bin_width=bin_width, a_ends=("_s", "_e"), b_ends=("s", "e")).select(*record, *place, "_s").distinct().withColumn("_in", F.lit(True))
    kept = points.join(inside, [*record, *place, "_s"], "left").groupBy(*record).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("_all"))
    known = spans.select(*place).distinct().withColumn("_known", F.lit(True))
    out = records.join(known, list(place), "left").join(kept, list(record), "left")
    return out.withColumn("reason", F.when(F.col("_known").isNull(), "missing").when(~F.coalesce("_all", F.lit(False)), "edge")).drop("_known", "_all")


def near_own_edge(records: DataFrame, blocks: DataFrame, bounds: DataFrame, record: Sequence[str], contig: Sequence[str], distance: int) -> DataFrame:
    """Each record with reason `edge` if one of its blocks reaches closer than `distance` to its contig's end, `unknown` if it has no block or one on a contig without bounds; unknown ones stay."""
    found = query_core(records, blocks, bounds, record, contig, distance)
    return found.withColumn("reason", F.when(F.col("reason") == "missing", "unknown").otherwise(F.col("reason"))).withColumn("kept", F.coalesce(F.col("reason") != "edge", F.lit(True)))


def soft_masked(chunks: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """Sequences in capitals, with small letters inside the spans (name, s, e): name, sequence. chunks: name, chunk, at, bases, of `size` without overlap. Each chunk meets its own part of the spans alone."""
    cut = union(spans, ["name"]).withColumn("chunk", F.explode(F.sequence(F.expr(f"int(s div {size})"), F.expr(f"int((e - 1) div {size})"))))
    inside = cut.select("name", "chunk", F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0)).cast("int").alias("lo"), F.least(F.col("e") - F.col("chunk") * size, F.lit(size)).cast("int").alias("hi"))
    per_chunk = inside.groupBy("name", "chunk").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("m"))  # at most size / 2 disjoint spans
    upper = F.upper("bases")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        plain, small = F.substr(upper, acc["at"] + 1, x["lo"] - acc["at"]), F.lower(F.substr(upper, x["lo"] + 1, x["hi"] - x["lo"]))
        return F.struct(x["hi"].alias("at"), F.concat(acc["t"], plain, small).alias("t"))

    done = F.aggregate(F.coalesce("m", F.array().cast("array<struct<lo:int,hi:int>>")), start, step, lambda acc: F.concat(acc["t"], F.substr(upper, acc["at"] + 1, F.length(upper))))
    parts = chunks.join(per_chunk, ["name", "chunk"], "left").select("name", "chunk", done.alias("t"))
    return parts.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "t"))), lambda x: x["t"]), "").alias("sequence"))


def locate_row(loci: DataFrame, rows: DataFrame, keys: Sequence[str], locus: str, row: str, *, bin_width: int) -> DataFrame:
    """The row (keys, rs, re, rstrand, has_path, score, `row`) that contains each locus (keys, s, e, strand, `locus`): of the same strand first, then the shortest, the leftmost, with a path, the best score, the first: locus, row."""
    inside = (F.col("rs") <= F.col("s")) & (F.col("e") <= F.col("re"))
    met = overlap_join(loci, rows, keys, bin_width=bin_width, a_ends=("s", "e"), b_ends=("rs", "re"), extra=inside)
    order = [F.col("strand") != F.col("rstrand"), F.col("re") - F.col("rs"), F.col("rs"), ~F.col("has_path"), F.col("score").desc(), F.col(row)]
    return met.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, locus).orderBy(*order))).where("_r = 1").select(*keys, locus, row)


def one_to_one(rows: DataFrame, references: DataFrame, similar: DataFrame, exact: Sequence[str], row: str, reference: str, group: str, cutoff: float) -> DataFrame:
    """Anchors row -> reference that only each other claim: row, reference, tag.

    Rows and references with equal `exact` columns come first, where the reference is the only one there and one row of a group claims it. Other rows take the only reference that lies closer than
    `cutoff` to them (similar: row, reference, distance), unless it is used or several rows of the group want it.
    """
    lone = lambda df, *by: df.groupBy(*by).agg(F.min(reference).alias(reference), F.max(reference).alias("_m")).where(F.col(reference) == F.col("_m")).drop("_m")
    single = lone(references, *exact)
    alone = lambda df: df.withColumn("_c", F.count("*").over(Window.partitionBy(group, reference))).where("_c = 1").drop("_c")
    first = alone(rows.join(single, list(exact)).select(group, row, reference))
    near = similar.where(F.col("distance") < cutoff).join(references.select(reference).distinct(), reference, "left_semi").select(row, reference)
    wanted = rows.select(group, row).distinct().join(first.select(row), row, "left_anti").join(lone(near, row), row)
    second = alone(wanted).join(first.select(group, reference), [group, reference], "left_anti")
    return first.select(row, reference, F.lit("exact").alias("tag")).unionAll(second.select(row, reference, F.lit("similar").alias("tag")))


def overlapping_names(places: DataFrame, references: DataFrame, keys: Sequence[str], place: str, name: str, *, bin_width: int) -> DataFrame:
    """All references (keys, rs, re, name) that each place (keys, s, e) overlaps, in order of name: keys, place, names."""
    met = overlap_join(tidy(places), tidy(references, "rs", "re"), keys, bin_width=bin_width, a_ends=("s", "e"), b_ends=("rs", "re"))
    return met.groupBy(*keys, place).agg(F.array_join(F.sort_array(F.collect_set(F.col(name).cast("string"))), ",").alias("names"))


def owned_edges(df: DataFrame, allele: Sequence[str]) -> DataFrame:
    """The deletions at an allele's ends that it owns: allele, key, side.

    Rows are of a kind: `kept` (path interval that another row replaces), `start` or `end` (a deletion at the first or last query point), with first, last and key, and hold the allele's length with its rows applied
    (`current`), its query span (`span`) and its path's length (`length`). From the path's start on, and then from its end back, a deletion is owned if it continues the chain, overlaps nothing taken, and leaves at least the span.
    An allele's rows are one small group.
    """

    def owned(rows: list[tuple]) -> list[tuple]:
        """rows: kind, first, last, key, current, span, length, in order of first, last and key."""
        taken = [(a, b) for kind, a, b, *_ in rows if kind == "kept" and a < b]
        size, span, length = (int(x) for x in rows[0][4:])
        starts, ends = [r for r in rows if r[0] == "start"], [r for r in rows if r[0] == "end"]
        out = []
        for side, reach, found in (("start", 0, starts), ("end", length, sorted(ends, key=lambda r: (r[2], r[1]), reverse=True))):
            for _, a, b, key, *_ in found:
                joins = a == reach if side == "start" else b == reach
                if joins and size - (b - a) >= span and not any(x < b and a < y for x, y in taken):
                    out.append((key, side))
                    if a < b:
                        taken.append((a, b))
                    size, reach = size - (b - a), b if side == "start" else a
        return out

    def run(batches):
        """Alleles come one after the other; the last of a batch waits for its rest."""
        held = None
        for pdf in itertools.chain(batches, [None]):
            last = pdf is None
            rest = held if last else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rest is None or rest.empty:
                continue
            bounds = [*np.flatnonzero(rest["_first"].to_numpy()).tolist(), *([len(rest)] if last else [])]
            rows = list(zip(*[rest[c].tolist() for c in ("kind", "first", "last", "key", "current", "span", "length")]))
            found = [(at, *edge) for at, to in itertools.pairwise(bounds) for edge in owned(rows[at:to])]
            held = None if last else rest.iloc[bounds[-1] :].reset_index(drop=True)
            at = [f[0] for f in found]
            if found:
                yield rest[list(allele)].iloc[at].reset_index(drop=True).assign(key=[f[1] for f in found], side=[f[2] for f in found])

    schema = T.StructType([*[df.schema[c] for c in allele], df.schema["key"], T.StructField("side", T.StringType())])
    first = F.row_number().over(Window.partitionBy(*allele).orderBy("first", "last", "key")) == 1
    return df.select(*allele, "kind", "first", "last", "key", "current", "span", "length", first.alias("_first")).mapInPandas(run, schema)


def fallback_owners(candidates: DataFrame, valid: DataFrame, keys: Sequence[str], label: str, line: str, score: str, least: float, *, bin_width: int) -> DataFrame:
    """Who owns what no valid region covers, among candidates that score at least `least`: keys, label, s, e, in runs of one label, and whether several labels compete there.

    Valid regions outscore every candidate and mask what they cover; candidates go by score, label and line.
    """
    open_ = candidates.where((F.col(score) >= least) & (F.col(score) < VALID_SCORE)).select(*keys, "s", "e", F.col(score).cast("double").alias("_p"), F.col(label).alias("_l"), F.col(line).cast("long").alias("_i"))
    masks = union(valid, keys).select(*keys, "s", "e", F.lit(VALID_SCORE).alias("_p"), F.lit(None).cast(candidates.schema[label].dataType).alias("_l"), F.lit(-1).cast("long").alias("_i"))
    cells = cell_members(open_.unionAll(masks), keys, ["_p", "_l", "_i"], bin_width=bin_width)
    best = cells.groupBy(*keys, "cs", "ce").agg(F.min(F.struct((-F.col("_p")).alias("p"), F.col("_l").alias("l"), F.col("_i").alias("i"))).alias("b"), (F.count_distinct("_l") > 1).alias("contested"))
    won = best.where(F.col("b.p") > -VALID_SCORE).select(*keys, F.col("b.l").alias(label), F.col("cs").alias("s"), F.col("ce").alias("e"), "contested")
    return coalesce_runs(won, keys, [label, "contested"])


def two_layers(df: DataFrame, keys: Sequence[str], owner: str, order: Sequence[Column], columns: Sequence[str], second: Column, *, bin_width: int) -> DataFrame:
    """Owners elected apart among rows of the first and of the second layer; the second keeps only what the first leaves: keys, s, e, owner, layer (pri, alt)."""
    first = elect(df.where(~second), keys, owner, order, columns, bin_width=bin_width)
    other = elect(df.where(second), keys, owner, order, columns, bin_width=bin_width)
    ends = other.select(*keys, F.col("s").alias("_s"), F.col("e").alias("_e"), owner)
    free = subtract(other, first, keys)
    parts = overlap_join(free, ends, keys, bin_width=bin_width, a_ends=("s", "e"), b_ends=("_s", "_e")).select(*keys, F.greatest("s", "_s").alias("s"), F.least("e", "_e").alias("e"), owner)
    return first.select(*keys, "s", "e", owner, F.lit("pri").alias("layer")).unionAll(parts.select(*keys, "s", "e", owner, F.lit("alt").alias("layer")))


def ownership_runs(df: DataFrame, keys: Sequence[str], tier: str, score: str, owner: str, line: str, same: Sequence[str], *, bin_width: int) -> DataFrame:
    """One owner a position: the highest tier, then score, then the longest, then by name and line; touching positions that agree on owner and the `same` columns are one run: keys, s, e, owner, same."""
    rows = tidy(df)
    members = cell_members(rows, keys, list(dict.fromkeys([tier, score, owner, line, *same])), bin_width=bin_width)
    order = [F.col(tier).desc(), F.col(score).desc(), (F.col("e") - F.col("s")).desc(), F.col(owner), F.col(line)]
    won = members.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "cs").orderBy(*order))).where("_r = 1")
    return coalesce_runs(won.select(*keys, F.col("cs").alias("s"), F.col("ce").alias("e"), owner, *same), keys, [owner, *same])


def covered_by_words(words: DataFrame, known: DataFrame, key: str, k: int) -> DataFrame:
    """Unions of the k-mers (key, pos, kmer) that `known` (kmer) holds: key, s, e. Known k-mers are distinct, so no k-mer multiplies rows."""
    found = words.join(known.select("kmer").distinct(), "kmer", "left_semi")
    return union(found.select(key, F.col("pos").alias("s"), (F.col("pos") + k).alias("e")), [key])


def deletions(hits: DataFrame, keys: Sequence[str], hard_gap: int, least: int) -> DataFrame:
    """What cleaning removes: covered spans merged between their score breaks, if their bases less twice the gaps between them reach `least`: keys, s, e."""
    groups = score_breaks(hits, keys, hard_gap).groupBy(*keys, "part", "segment").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("_b"))
    return groups.where(F.col("_b") - 2 * (F.col("e") - F.col("s") - F.col("_b")) >= least).select(*keys, "s", "e")


def residuals(lengths: DataFrame, removed: DataFrame, key: str, least: int, breaks: DataFrame | None = None) -> DataFrame:
    """What is left of sequences (key, length) without the removed spans and breaks (key, s, e), in fragments of at least `least`: key, s, e."""
    whole = lengths.where("length > 0").select(key, F.lit(0).cast("long").alias("s"), F.col("length").cast("long").alias("e"))
    gone = removed if breaks is None else removed.unionByName(breaks)
    return subtract(whole, gone, [key]).where(F.col("e") - F.col("s") >= least)


def exact_groups(members: DataFrame, group: Sequence[str], sequence: str, order: Sequence[Column], member: str) -> DataFrame:
    """Members of a group with the same sequence, whatever its case, stand for one: the first by `order` is their representative: the rows with column representative."""
    return members.withColumn("_h", F.upper(sequence)).withColumn("representative", F.first(member).over(Window.partitionBy(*group, "_h").orderBy(*order))).drop("_h")


def lone_giants(members: DataFrame, group: Sequence[str], size: str, tie: str, least: int, ratio: float) -> DataFrame:
    """Large members that no other of their group comes near: a member of at least `least` whose next smaller one is below `ratio` of it stands alone, and so on down the group. Column lone. The rest stays together."""
    order = Window.partitionBy(*group).orderBy(F.col(size).desc(), tie)
    following = F.lead(size).over(order)
    alone = (F.col(size) >= least) & (following < ratio * F.col(size))
    marked = members.withColumn("_a", F.coalesce(alone, F.lit(False)).cast("int"))
    return marked.withColumn("lone", F.min("_a").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_a")


def abutting(df: DataFrame, parent: Sequence[str], row: str, start: str = "s", end: str = "e") -> DataFrame:
    """Rows that begin where a sibling ends, or end where one begins: parent, row. A zero-length row alone at its place meets only itself. Places are met by counts, so no pairs are made however many rows share one."""
    at = lambda c, kind: df.select(*parent, F.col(c).alias("_x"), F.lit(kind).alias("_k"), F.col(row).alias("_id"))
    ends = at(start, "s").unionAll(at(end, "e"))
    is_start, is_end = F.col("_k") == "s", F.col("_k") == "e"
    places = ends.groupBy(*parent, "_x").agg(F.count_if(is_start).alias("_a"), F.count_if(is_end).alias("_b"), F.min(F.when(is_start, F.col("_id"))).alias("_i"), F.min(F.when(is_end, F.col("_id"))).alias("_j"))
    joints = places.where("_a > 0 AND _b > 0 AND NOT (_a = 1 AND _b = 1 AND _i = _j)").select(*parent, "_x")
    return ends.join(joints, [*parent, "_x"], "left_semi").select(*parent, F.col("_id").alias(row)).distinct()


def skipping_numbers(df: DataFrame, part: str, order: Sequence[str], forbidden: Sequence[int]) -> DataFrame:
    """Rows numbered from 1 in order of part and `order`, passing over the forbidden numbers: column number. Counts of the parts, one row each, give each part its offset, so no task numbers all rows."""
    sizes = df.groupBy(part).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    plain = df.join(offsets, part).withColumn("_p", F.col("_o") + F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    steps = F.array(*[F.lit(f - i).cast("long") for i, f in enumerate(sorted(set(forbidden)))]) if forbidden else F.array().cast("array<bigint>")
    return plain.withColumn("number", F.col("_p") + F.size(F.filter(steps, lambda f: f <= F.col("_p")))).drop("_o", "_p")


def duplication_groups(df: DataFrame, contig: Sequence[str], most_unmapped: int, most_span: int) -> DataFrame:
    """Runs of duplicated rows between two anchors: contig, s, e, n, low, high (the anchors on the reference).

    Rows: contig, s, e, kind (DUP, UNMAPPED, PRIMARY, other), path, left and right (reference positions at the row's two query ends). Touching duplicated rows form a run, which takes in touching unmapped stretches shorter than
    `most_unmapped` that lie between two of them. A run counts if the rows beside it are primary, on one path, and their facing ends lie less than `most_span` apart.
    """
    order = Window.partitionBy(*contig).orderBy("s", "e")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    touch = F.coalesce(F.lag("e").over(order) == F.col("s"), F.lit(False))
    rows = df.where("s < e").withColumn("_t", touch).withColumn("_new", (~touch | (F.col("kind") != F.lag("kind").over(order)) | ~F.col("kind").isin("DUP", "UNMAPPED")).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(running))
    # kinds and ends of the rows beside a run, and its own first and last, in one row a run
    beside = rows.withColumns({f"_p{c}": F.lag(c).over(order) for c in ("kind", "path", "right")} | {f"_n{c}": F.lead(c).over(order) for c in ("kind", "path", "left")} | {"_nt": F.coalesce(F.lead("s").over(order) == F.col("e"), F.lit(False))})
    first, last = (lambda c: F.min_by(c, F.struct("s", "e"))), (lambda c: F.max_by(c, F.struct("s", "e")))
    runs = beside.groupBy(*contig, "_run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), first("kind").alias("kind"), first("_t").alias("_t"), last("_nt").alias("_nt"),
        first("_pkind").alias("_pk"), first("_ppath").alias("_pp"), first("_pright").alias("_pr"), last("_nkind").alias("_nk"), last("_npath").alias("_np"), last("_nleft").alias("_nl"),
    )
    link = (F.col("kind") == "UNMAPPED") & (F.col("e") - F.col("s") < most_unmapped) & F.col("_t") & F.col("_nt") & (F.col("_pk") == "DUP") & (F.col("_nk") == "DUP")
    by_run = Window.partitionBy(*contig).orderBy("_run")
    linked = runs.withColumn("_link", F.coalesce(link, F.lit(False))).where("kind = 'DUP' OR _link")
    groups = linked.withColumn("_cut", (~F.col("_link") & ~F.coalesce(F.lag("_link").over(by_run), F.lit(False))).cast("int")).withColumn("_g", F.sum("_cut").over(by_run.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = (lambda c: F.min_by(c, "_run")), (lambda c: F.max_by(c, "_run"))
    made = groups.groupBy(*contig, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"), first("_pk").alias("pk"), first("_pp").alias("pp"), first("_pr").alias("pr"), last("_nk").alias("nk"), last("_np").alias("np"), last("_nl").alias("nl"))
    valid = made.where(f"pk = 'PRIMARY' AND nk = 'PRIMARY' AND pp = np AND abs(nl - pr) < {most_span}")
    return valid.select(*contig, "s", "e", "n", F.least("pr", "nl").alias("low"), F.greatest("pr", "nl").alias("high"))


def localized(insertions: DataFrame, blocks: DataFrame, keys: Sequence[str], insertion: str, flank: int, *, bin_width: int) -> DataFrame:
    """Where insertions (keys, s, e) lie on the target, by the forward paired blocks (keys, q0, q1, target, t0, identity) in their flanks: insertion, status, target, s, e, other, at.

    Each side's target is the one whose blocks, clipped to the flank, match most; its anchor is the block nearest to the insertion. Sides on one target make `mapped` (s to e), on two `both` (s on target, `at` on other), one side alone
    `one_sided`, none `unmapped`.
    """
    sides = insertions.select(*keys, insertion, F.explode(F.array(F.struct(F.lit("up").alias("side"), (F.col("s") - flank).alias("lo"), F.col("s").alias("hi")), F.struct(F.lit("down").alias("side"), F.col("e").alias("lo"), (F.col("e") + flank).alias("hi")))).alias("x")).select(*keys, insertion, "x.*")
    met = overlap_join(sides, blocks, keys, bin_width=bin_width, a_ends=("lo", "hi"), b_ends=("q0", "q1"))
    clipped = met.withColumns({"a": F.greatest("lo", "q0"), "b": F.least("hi", "q1")})
    up = F.col("side") == "up"
    place = F.when(up, F.col("t0") + F.col("b") - F.col("q0")).otherwise(F.col("t0") + F.col("a") - F.col("q0"))
    gap = F.when(up, F.col("hi") - F.col("b")).otherwise(F.col("a") - F.col("lo"))
    per_target = clipped.groupBy(*keys, insertion, "side", "target").agg(F.sum((F.col("b") - F.col("a")) * F.col("identity")).alias("w"), F.min(F.struct(gap.alias("g"), (F.col("a") - F.col("b")).alias("l"), place.alias("p"))).alias("n"))
    best = per_target.groupBy(*keys, insertion, "side").agg(F.min(F.struct((-F.col("w")).alias("w"), "target", F.col("n.p").alias("p"))).alias("m"))
    ends = best.groupBy(*keys, insertion).agg(*[F.max(F.when(F.col("side") == side, F.col(f"m.{c}"))).alias(f"{side}_{c}") for side in ("up", "down") for c in ("target", "p")])
    out = insertions.select(*keys, insertion).join(ends, [*keys, insertion], "left")
    one, two = F.col("up_target"), F.col("down_target")
    status = F.when(one.isNull() & two.isNull(), "unmapped").when(one.isNull() | two.isNull(), "one_sided").when(one == two, "mapped").otherwise("both")
    low, high = F.least("up_p", "down_p"), F.greatest("up_p", "down_p")
    same, both = F.col("status") == "mapped", F.col("status") == "both"
    return out.withColumn("status", status).select(
        *keys, insertion, "status", F.coalesce(one, two).alias("target"), F.when(same, low).otherwise(F.coalesce("up_p", "down_p")).alias("s"), F.when(same, high).otherwise(F.coalesce("up_p", "down_p")).alias("e"),
        F.when(both, two).alias("other"), F.when(both, F.col("down_p")).alias("at"),
    )


def spread_tags(df: DataFrame, keys: Sequence[str], at: str, tag: str, tie: str, near: int) -> DataFrame:
    """Points without a tag take that of the nearest tagged point of their key, the left one of two equally near; beyond `near` the distance is written behind it: column spread. One window each way, no rounds."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    held = F.when(F.col(tag).isNotNull(), F.struct(F.col(at).alias("x"), F.col(tag).alias("t")))
    found = df.withColumns({"_l": F.last(held, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.first(held, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    left, right = F.col(at) - F.col("_l.x"), F.col("_r.x") - F.col(at)
    use_left = F.col("_r").isNull() | (left <= right)
    distance, name = F.when(use_left, left).otherwise(right), F.when(use_left, F.col("_l.t")).otherwise(F.col("_r.t"))
    return found.withColumn("spread", F.when(distance <= near, name).otherwise(F.concat(name, F.lit("_distance"), distance.cast("string")))).drop("_l", "_r")


def hours_by_phase(jobs: DataFrame, phase: str, seconds: str, waited: str, cpus: str) -> DataFrame:
    """Job accounting: jobs, run, CPU and queue hours of each phase, to 3 digits."""
    hours = lambda c: F.round(F.sum(c) / 3600, 3)
    return jobs.groupBy(phase).agg(F.count("*").alias("jobs"), hours(F.col(seconds)).alias("run_hours"), hours(F.col(seconds) * F.col(cpus)).alias("cpu_hours"), hours(F.col(waited)).alias("queue_hours"))


def valid_segments(segments: DataFrame, regions: DataFrame, keys: Sequence[str], least: int, *, bin_width: int) -> DataFrame:
    """Segments clipped to each valid region of their key, those of at least `least`: the segment's columns with q0, q1 and, in proportion, g0, g1 replaced, equal rows once. segments: q0, q1, g0, g1, strand; regions: s, e.

    Graph ends are rounded outwards; on the minus strand they are counted from the segment's graph end.
    """
    met = overlap_join(segments.where("g0 < g1"), tidy(regions).select(*keys, "s", "e"), keys, bin_width=bin_width, a_ends=("q0", "q1"), b_ends=("s", "e"))
    cut = met.withColumns({"_a": F.greatest("q0", "s"), "_b": F.least("q1", "e")}).where(F.col("_b") - F.col("_a") >= least)
    low, high = F.expr("((_a - q0) * (g1 - g0)) div (q1 - q0)"), F.expr("((_b - q0) * (g1 - g0) + q1 - q0 - 1) div (q1 - q0)")
    plus = F.col("strand") == "+"
    placed = cut.withColumns({"_c": F.when(plus, F.col("g0") + low).otherwise(F.col("g1") - high), "_d": F.when(plus, F.col("g0") + high).otherwise(F.col("g1") - low)}).where("_c < _d")
    replaced = {"q0": "_a", "q1": "_b", "g0": "_c", "g1": "_d"}
    return placed.select(*[F.col(replaced.get(c, c)).alias(c) for c in segments.columns]).distinct()


def best_representatives(hits: DataFrame, piece: str, hit: str) -> DataFrame:
    """Of each piece the hit that covers most of it, ties to higher identity, target, place and strand: piece, target, s, e (the hull on the target), strand. hits: piece, hit, identity, target, strand, q0, q1, t0, t1, one row an interval."""
    covered = union(hits, [piece, hit], "q0", "q1").groupBy(piece, hit).agg(F.sum(F.col("q1") - F.col("q0")).alias("_n"))
    spans = hits.groupBy(piece, hit, "identity", "target", "strand").agg(F.min("t0").alias("s"), F.max("t1").alias("e"))
    best = spans.join(covered, [piece, hit]).groupBy(piece).agg(F.max(F.struct("_n", "identity", "target", "s", "e", "strand")).alias("_b"))
    return best.select(piece, "_b.target", "_b.s", "_b.e", "_b.strand")


def ordered_catalog(pieces: DataFrame, priority: str, tie: Sequence[str], prefix: str) -> DataFrame:
    """Pieces (s, e) named by their place in the order of falling priority, falling length, then `tie`: columns number, from 1, and name. Counts of each priority and length give the offsets, so no task numbers all rows."""
    parted = pieces.withColumn("_part", F.struct((-F.coalesce(priority, F.lit(0))).alias("p"), (F.col("s") - F.col("e")).alias("n")))
    return skipping_numbers(parted, "_part", tie, []).drop("_part").withColumn("name", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), 12, "0")))


def hardness(copies: DataFrame, gaps: DataFrame, tracts: DataFrame, lengths: DataFrame, key: str, *, scale: float = 1000, seed_weight: float = 0.5, local_weight: float = 0.7, peak_weight: float = 0.75) -> DataFrame:
    """How hard each key is to align: key, ambiguity, extent, seed_score, local_risk, hardness; null where there are no seeds or no callable bases.

    copies: key, n (of each seed occurrence, over all keys); gaps: key, size (between unique seeds); tracts: key, size, severity; lengths: key, callable. A gap of size g weighs g²/(g + scale), a tract of size t with severity v
    weighs v t/(v t + scale); half of the seed score is the mean of 1 - 1/n, half the weight of the gaps.
    """
    seeds = copies.groupBy(key).agg(F.avg(1 - 1 / F.col("n")).alias("ambiguity"))
    open_ = gaps.groupBy(key).agg(F.sum(F.col("size") * F.col("size") / (F.col("size") + F.lit(float(scale)))).alias("_g"))
    heavy = F.col("severity") * F.col("size")
    risks = tracts.withColumn("_r", heavy / (heavy + F.lit(float(scale)))).groupBy(key).agg(F.sum(F.col("_r") * F.col("size")).alias("_m"), F.max("_r").alias("_p"))
    rows = lengths.select(key, F.when(F.col("callable") > 0, F.col("callable")).alias("_n")).join(seeds, key, "left").join(open_, key, "left").join(risks, key, "left")
    known = F.col("_n").isNotNull()
    mean, peak = F.coalesce("_m", F.lit(0.0)) / F.col("_n"), F.when(known, F.coalesce("_p", F.lit(0.0)))
    scored = rows.withColumn("extent", F.coalesce("_g", F.lit(0.0)) / F.col("_n")).withColumn("seed_score", 100 * (seed_weight * F.col("ambiguity") + (1 - seed_weight) * F.col("extent")))
    scored = scored.withColumn("local_risk", (1 - peak_weight) * mean + peak_weight * peak)
    return scored.withColumn("hardness", (1 - local_weight) * F.col("seed_score") + 100 * local_weight * F.col("local_risk")).select(key, "ambiguity", "extent", "seed_score", "local_risk", "hardness")


def bracketed_gaps(df: DataFrame, contig: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Reference gaps between neighbouring primary anchors of a contig: contig, `same` (path and strands, equal on both sides), s, e.

    df: q0, q1, r0, r1, kind, source, trimmed, anchored, forward, and the context of the row's alignment c0, c1 (query) and d0, d1 (reference). Two anchors bracket a gap if the query has nothing open between them: the second
    begins where the first ends, or insertions of the same source, untrimmed and anchored, lead from one to the other; their contexts must overlap on both axes.
    """
    order = Window.partitionBy(*contig).orderBy("q0", "q1", "kind")
    primary = F.col("kind") == "PRIMARY"
    linked = (F.col("kind") == "INSERTION") & (F.lag("q1").over(order) == F.col("q0")) & (F.lag("source").over(order) == F.col("source")) & ~F.col("trimmed") & F.col("anchored")
    rows = df.withColumn("_ok", F.coalesce(primary | linked, F.lit(False))).withColumn("_p", F.sum(primary.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_p > 0")
    fields = [*same, "q0", "q1", "r0", "r1", "source", "forward", "c0", "c1", "d0", "d1"]
    anchors = rows.groupBy(*contig, "_p").agg(F.max(F.when(primary, F.struct(*fields))).alias("a"), F.bool_and("_ok").alias("_ok"), F.max("q1").alias("_reach"))
    following = F.lead("a").over(Window.partitionBy(*contig).orderBy("_p"))
    pairs = anchors.withColumn("b", following).where(F.col("_ok") & (F.col("b.q0") == F.col("_reach")) & ((F.col("_reach") == F.col("a.q1")) | (F.col("a.source") == F.col("b.source"))))
    for c in same:
        pairs = pairs.where(F.col(f"a.{c}") == F.col(f"b.{c}"))
    meet = (F.greatest("a.c0", "b.c0") < F.least("a.c1", "b.c1")) & (F.greatest("a.d0", "b.d0") < F.least("a.d1", "b.d1"))
    s = F.when(F.col("a.forward"), F.col("a.r1")).otherwise(F.when(F.col("b.forward"), F.col("b.r0")).otherwise(F.col("b.r1")))
    e = F.when(F.col("a.forward"), F.when(F.col("b.forward"), F.col("b.r0")).otherwise(F.col("b.r1"))).otherwise(F.col("a.r0"))
    return pairs.where(meet).select(*contig, *[F.col(f"a.{c}").alias(c) for c in same], s.alias("s"), e.alias("e")).where("s < e")
