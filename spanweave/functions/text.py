"""Scalar functions on text fields of interval and variant files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that variant files write as @ and their two hex digits. The @ itself comes first when escaping and last when reading.
RESERVED = {"@": "@40", ":": "@3A", ";": "@3B", ",": "@2C", "\t": "@09", "\n": "@0A"}


def escape(text: Column) -> Column:
    """A field's text with reserved characters coded; an empty or null text is a point."""
    coded = text
    for plain, code in RESERVED.items():
        coded = F.replace(coded, F.lit(plain), F.lit(code))
    return F.when(text.isNull() | (text == ""), F.lit(".")).otherwise(coded)


def unescape(text: Column) -> Column:
    """The text behind an escaped field; a point is empty."""
    plain_text = F.when(text == ".", F.lit("")).otherwise(text)
    for plain, code in reversed(RESERVED.items()):
        plain_text = F.replace(plain_text, F.lit(code), F.lit(plain))
    return plain_text


def info_map(info: Column) -> Column:
    """key=value;flag;... as a map; a flag's value is null, '.' is an empty map, the first of repeated keys counts."""
    fields = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    first = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(first)


def locus(text: Column) -> Column:
    """contig:start-end with an optional strand behind, as (contig, s, e, strand); ends in order. Null fields where the text isn't one."""
    pattern = r"^(.+):(\d+)-(\d+)([+-]?)$"
    a, b = F.try_to_number(F.regexp_extract(text, pattern, 2), F.lit("9" * 18)).cast("long"), F.try_to_number(F.regexp_extract(text, pattern, 3), F.lit("9" * 18)).cast("long")
    strand = F.nullif(F.regexp_extract(text, pattern, 4), F.lit(""))
    return F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("contig"), F.least(a, b).alias("s"), F.greatest(a, b).alias("e"), strand.alias("strand"))


def haplotype_name(name: Column) -> Column:
    """gN_SAMPLE_HAP_CONTIG_START_END as fields; a contig may hold underscores of its own."""
    pattern = r"^g(\d+)_([^_]+)_([^_]+)_(.+)_(\d+)_(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return F.struct(part(1).cast("long").alias("graph"), part(2).alias("sample"), part(3).alias("hap"), part(4).alias("contig"), part(5).cast("long").alias("s"), part(6).cast("long").alias("e"))


def safe_token(text: Column) -> Column:
    """Letters, digits, point, underscore and hyphen stay; any run of others becomes one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def signed_code(number: Column) -> Column:
    """Signed integers as unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    return F.when(number >= 0, number * 2).otherwise(-number * 2 - 1)


def signed_value(code: Column) -> Column:
    half = F.shiftright(code, 1)
    return F.when(code % 2 == 0, half).otherwise(-(half + 1))


def trimmed_alleles(pos: Column, ref: Column, alt: Column) -> Column:
    """Alleles without what they share, behind first and then in front, at least one base left of each: (pos, ref, alt)."""
    least = F.least(F.length(ref), F.length(alt))
    shared = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.greatest(least, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct(
            (acc["n"] + (acc["on"] & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).cast("int")).alias("n"), (acc["on"] & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).alias("on")
        ),
        lambda acc: acc["n"],
    )
    behind = F.least(shared(F.reverse(ref), F.reverse(alt)), least - 1)
    ref1, alt1 = F.substr(ref, F.lit(1), F.length(ref) - behind), F.substr(alt, F.lit(1), F.length(alt) - behind)
    front = F.least(shared(ref, alt), least - behind - 1)
    return F.struct((pos + front).cast("long").alias("pos"), F.substr(ref1, front + 1, F.length(ref1)).alias("ref"), F.substr(alt1, front + 1, F.length(alt1)).alias("alt"))


def size_ratio(a: Column, b: Column) -> Column:
    """The smaller size over the larger one; 1 for two zeros."""
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def interval_distance(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Positions between two half-open intervals, 0 if they touch or overlap."""
    return F.greatest(F.lit(0).cast("long"), s2 - e, s - e2)


def flipped(s: Column, e: Column, length: Column) -> Column:
    """An interval's coordinates on the reverse strand."""
    return F.struct((length - e).alias("s"), (length - s).alias("e"))


def composed_strand(*signs: Column) -> Column:
    """The strand that orientations (+ or >, - or <) one after another make."""
    backward = F.lit(0)
    for s in signs:
        backward = backward + F.when(s.isin("+", ">"), 0).otherwise(1)
    return F.when(backward % 2 == 0, "+").otherwise("-")


def interval_json(spans: Column) -> Column:
    """An array of (s, e) as JSON, [[s,e],...]."""
    return F.to_json(F.transform(spans, lambda x: F.array(x["s"], x["e"])))


def interval_list(json: Column) -> Column:
    """[[s,e],...] as an array of (s, e); a null, empty text or point is an empty array. An entry of other than two numbers in order fails."""
    pairs = F.from_json(json, "array<array<bigint>>")
    bad = F.exists(pairs, lambda p: (F.size(p) != 2) | (p[0] >= p[1]))
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("invalid interval list: "), json))).otherwise(F.transform(pairs, lambda p: F.struct(p[0].alias("s"), p[1].alias("e"))))
    return F.when(json.isNull() | json.isin("", "."), F.array().cast("array<struct<s:bigint,e:bigint>>")).otherwise(checked)


def literal_sequence(raw: Column) -> Column:
    """The bases that an inserted sequence states: itself if it is plain, else the literal bases of its chunks' operations (I, X, S). Null if a chunk copies bases from a path (=, M), or if it states none."""
    body = F.regexp_replace(unescape(raw), r"[<>](?:[^<>:]*:)?", " ")
    coded = raw.rlike(r"^[<>]")
    copies = body.rlike(r"(^|\D)0*[1-9]\d*[=M]")
    bases = F.array_join(F.regexp_extract_all(body, F.lit(r"\d+[IXS]([A-Za-z]+?)(?=\d|\s|$)"), F.lit(1)), "")
    return F.when(raw.isNull() | raw.isin("", "."), F.lit(None)).when(~coded, unescape(raw)).when(copies, F.lit(None)).otherwise(bases)


def meta_map(line: Column) -> Column:
    """The key="value" pairs of a header line as a map; a backslash takes the next character as it is, the last of equal keys counts."""
    pattern = r'(\w+)="((?:[^"\\]|\\.)*)"'
    names, values = F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names) + 1), x["k"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: F.regexp_replace(x["v"], r"\\(.)", "$1")))


def scaled_memory(amount: Column, factor: Column) -> Column:
    """An amount of memory (digits and a unit of K, M, G or T in either case, or none) times a factor in its own unit; null for other texts."""
    bare = F.trim(amount)
    times = F.regexp_extract(bare, r"^(\d+)", 1).try_cast("long") * factor
    return F.when(bare.rlike(r"^\d+[KMGTkmgt]?$"), F.concat(times.cast("string"), F.upper(F.regexp_extract(bare, r"([KMGTkmgt]?)$", 1))))
