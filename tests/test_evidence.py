"""Evidence operators that SQL does not express, against plain versions, and the queries on their hand-made cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanweave.functions import sequences, text
from spanweave.operators import evidence
from spanweave.sources import files


def owned_plainly(rows):
    kept = [(r[2], r[3]) for r in rows if r[1] == "kept" and r[2] < r[3]]
    current, span, length = rows[0][5], rows[0][6], rows[0][7]
    out, taken = [], list(kept)
    reach = 0
    for r in sorted((r for r in rows if r[1] == "start"), key=lambda r: (r[2], r[3])):
        if r[2] == reach and current - (r[3] - r[2]) >= span and all(r[3] <= a or b <= r[2] for a, b in taken):
            out.append(r[4])
            current -= r[3] - r[2]
            reach = r[3]
            if r[2] < r[3]:
                taken.append((r[2], r[3]))
    reach = length
    for r in sorted((r for r in rows if r[1] == "end"), key=lambda r: (-r[3], -r[2])):
        if r[3] == reach and current - (r[3] - r[2]) >= span and all(r[3] <= a or b <= r[2] for a, b in taken):
            out.append(r[4])
            current -= r[3] - r[2]
            reach = r[2]
            if r[2] < r[3]:
                taken.append((r[2], r[3]))
    return out


def test_owned_edges(spark):
    rng, rows = random.Random(4), []
    for allele in range(60):
        key = 0
        for kind, n in (("kept", rng.randrange(3)), ("start", rng.randrange(5)), ("end", rng.randrange(5))):
            for _ in range(n):
                a = rng.randrange(0, 8)
                b = a + rng.randrange(1, 4)
                first, last = (a, b) if kind != "end" else (20 - b, 20 - a)
                rows.append((allele, kind, first, last, key, 20, 10, 20))
                key += 1
    df = spark.createDataFrame(rows, "allele long, kind string, first long, last long, key long, current long, span long, length long")
    got = {}
    for r in evidence.owned_edges(df, ["allele"]).collect():
        got.setdefault(r["allele"], set()).add(r["key"])
    want = {a: set(o) for a in {r[0] for r in rows} if (o := owned_plainly([r for r in rows if r[0] == a]))}
    assert got == want and len(want) > 10


def duplications_plainly(rows, most_unmapped, most_span):
    rows, out, i = sorted(rows), [], 0
    while i < len(rows):
        if rows[i][2] != "DUP":
            i += 1
            continue
        last = j = i
        while j + 1 < len(rows) and rows[j + 1][0] == rows[j][1]:
            if rows[j + 1][2] == "DUP":
                j += 1
                last = j
                continue
            k = j
            while k + 1 < len(rows) and rows[k + 1][0] == rows[k][1] and rows[k + 1][2] == "UNMAPPED":
                k += 1
            if k == j or rows[k][1] - rows[j + 1][0] >= most_unmapped or k + 1 >= len(rows) or rows[k + 1][0] != rows[k][1] or rows[k + 1][2] != "DUP":
                break
            last = j = k + 1
        if i > 0 and last + 1 < len(rows):
            a, b = rows[i - 1], rows[last + 1]
            if a[2] == b[2] == "PRIMARY" and a[3] == b[3] and abs(b[4] - a[5]) < most_span:
                out.append((rows[i][0], rows[last][1], last - i + 1, min(a[5], b[4]), max(a[5], b[4])))
        i = last + 1
    return out


def test_duplication_groups(spark):
    rng, rows = random.Random(9), []
    at = 0
    for _ in range(4000):
        at += rng.choice([0, 0, 0, 0, 3])
        n = rng.randrange(1, 5)
        kind = rng.choice(["DUP", "DUP", "UNMAPPED", "PRIMARY", "OTHER"])
        rows.append((at, at + n, kind, rng.choice("ab"), at * 2, (at + n) * 2))
        at += n
    df = spark.createDataFrame([("c", *r) for r in rows], "c string, s long, e long, kind string, path string, left long, right long")
    got = sorted(tuple(r[x] for x in ("s", "e", "n", "low", "high")) for r in evidence.duplication_groups(df, ["c"], 4, 40).collect())
    want = duplications_plainly(rows, 4, 40)
    assert got == want and len(want) > 10 and any(n > 2 for *_, n, _, _ in want)


def test_localized_insertions(spark):
    blocks = [("c", 0, 100, "m", 1000, 99), ("c", 120, 200, "m", 1150, 99), ("c", 300, 380, "n", 10, 99), ("c", 90, 100, "x", 5, 99)]
    asked = [("c", 100, 120, 1), ("c", 200, 300, 2), ("c", 500, 510, 3), ("c", 380, 420, 4)]
    got = evidence.localized(spark.createDataFrame(asked, "k string, s long, e long, id long"), spark.createDataFrame(blocks, "k string, q0 long, q1 long, target string, t0 long, identity long"), ["k"], "id", 60, bin_width=64)
    rows = {r["id"]: (r["status"], r["target"], r["s"], r["e"], r["other"], r["at"]) for r in got.collect()}
    assert rows == {1: ("mapped", "m", 1100, 1150, None, None), 2: ("both", "m", 1230, 1230, "n", 10), 3: ("unmapped", None, None, None, None, None), 4: ("one_sided", "n", 90, 90, None, None)}


def test_core_filters_of_hand_made_calls(spark):
    records = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "q")], "rec long, place string")
    loci = spark.createDataFrame([(1, "c", 20, 30), (2, "c", 5, 30), (3, "c", 20, 30), (3, "d", 1, 2)], "rec long, contig string, s long, e long")
    bounds = spark.createDataFrame([("c", 0, 100)], "contig string, lo long, hi long")
    why = {r["rec"]: r["reason"] for r in evidence.query_core(records, loci, bounds, ["rec"], ["contig"], 10).collect()}
    assert why == {1: None, 2: "edge", 3: "missing", 4: "missing"}
    kept = {r["rec"]: (r["reason"], r["kept"]) for r in evidence.near_own_edge(records, loci, bounds, ["rec"], ["contig"], 10).collect()}
    assert kept == {1: (None, True), 2: ("edge", False), 3: ("unknown", True), 4: ("unknown", True)}
    anchors = spark.createDataFrame([(1, "p", 5), (1, "p", 9), (2, "p", 10), (4, "q", 5)], "rec long, place string, at long")
    coverage = spark.createDataFrame([("p", 0, 6), ("p", 6, 10)], "place string, s long, e long")
    why = {r["rec"]: r["reason"] for r in evidence.reference_core(records, anchors, coverage, ["rec"], ["place"], bin_width=8).collect()}
    assert why == {1: None, 2: "edge", 3: "edge", 4: "missing"}


def test_scalars_of_evidence(spark):
    row = spark.range(1).select(
        evidence.accepted_contig(F.lit("HG38_h1"), F.lit("HG38#1#chr7")).alias("a"), evidence.accepted_contig(F.lit("HG38_h1"), F.lit("chr7_alt")).alias("b"), evidence.accepted_contig(F.lit("HG2_h1"), F.lit("x")).alias("c"),
        text.literal_sequence(F.lit("<12=3IACG")).alias("d"), text.literal_sequence(F.lit(">t:2XAC0=1IT")).alias("e"), text.literal_sequence(F.lit("ACGT")).alias("f"),
        text.interval_list(F.lit(".")).alias("g"), text.unescape(text.escape(F.lit("a@b:c;d,e"))).alias("h"), text.escape(F.lit("")).alias("i"), sequences.runs_of(F.lit("NNACNNNG"), "N").alias("j"), sequences.runs_of(F.lit(""), "N").alias("k"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, True)
    assert (row["d"], row["e"], row["f"]) == (None, "ACT", "ACGT") and row["g"] == [] and row["h"] == "a@b:c;d,e" and row["i"] == "."
    assert [tuple(x) for x in row["j"]] == [(0, 2), (4, 7)] and row["k"] == []


def test_scans_reject_bad_rows(spark, tmp_path):
    def save(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    with pytest.raises(Exception, match="mapping row"):
        files.read_mapper_bed(spark, save("m.bed", "c\t5\t5\tt\t1\t+\ts\t0\t3\n")).collect()
    with pytest.raises(Exception, match="unknown form"):
        files.read_hotspots(spark, save("h.tsv", "c\tx\t5\n")).collect()
    with pytest.raises(Exception, match="comes twice"):
        files.read_assembly_list(spark, save("a.txt", "s1 a.fa\ns1 b.fa\n")).collect()
    index = files.fai_of(spark.createDataFrame([("a", "ACGTACGT"), ("b", "AC")], "name string, sequence string"), 5).orderBy("name").collect()
    content = ">a\nACGTA\nCGT\n>b\nAC\n"
    assert [content[r["offset"]] for r in index] == ["A", "A"] and content[index[1]["offset"] :] == "AC\n"


def test_owned_edges_walk_alleles_across_batches(spark):
    rows = [(k, "start", 0, 5, 1, 100, 50, 100) for k in range(60)] + [(k, "start", 5, 10, 2, 100, 50, 100) for k in range(60)] + [(k, "end", 90, 100, 3, 100, 50, 100) for k in range(0, 60, 2)] + [(None, "kept", 0, 3, 4, 100, 50, 100), (None, "start", 0, 5, 5, 100, 50, 100)]
    df = spark.createDataFrame(rows, "allele int, kind string, first long, last long, key long, current long, span long, length long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = evidence.owned_edges(df, ["allele"])
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r["allele"], r["key"], r["side"]) for r in made.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted([(k, 1, "start") for k in range(60)] + [(k, 2, "start") for k in range(60)] + [(k, 3, "end") for k in range(0, 60, 2)])
