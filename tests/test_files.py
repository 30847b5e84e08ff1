"""Text formats: scans, round trips and what they refuse."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanweave.functions import cigar, sequences, text
from spanweave.sources import files


def save(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_fasta_round_trip_and_fetch(spark, tmp_path):
    path = save(tmp_path, "a.fa", ">c1 first one\nACGTNN\nacgt\n>c2\n\n>c3 x\r\nGG\r\nTT\n")
    got = {r["name"]: r["sequence"] for r in files.read_fasta(spark, path).collect()}
    assert got == {"c1": "ACGTNNacgt", "c2": "", "c3": "GGTT"}
    files.write_fasta(files.read_fasta(spark, path), str(tmp_path / "out"), 4)
    assert {r["name"]: r["sequence"] for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == got
    chunks = files.chunked(files.read_fasta(spark, path), 3)
    asked = spark.createDataFrame([(1, "c1", 0, 10), (2, "c1", 2, 7), (3, "c3", 3, 4), (4, "c1", 4, 4)], "id long, name string, s long, e long")
    assert {r["id"]: r["bases"] for r in files.fetch(chunks, asked, 3).collect()} == {1: "ACGTNNacgt", 2: "GTNNa", 3: "T", 4: ""}


def test_fastq(spark, tmp_path):
    path = save(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert [(r["name"], r["sequence"], r["quality"].strip()) for r in files.read_fastq(spark, path).collect()] == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]
    rows = [(f"r{i}", "ACGTA"[: 1 + i % 5], "@@I@+"[: 1 + i % 5]) for i in range(40)] + [("last", "A", "@")]
    path = save(tmp_path, "b.fq", "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rows))
    assert sorted((r["name"], r["sequence"], r["quality"]) for r in files.read_fastq(spark, path).collect()) == sorted(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert sorted((r["name"], r["sequence"], r["quality"]) for r in files.read_fastq(spark, path).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bed_and_its_errors(spark, tmp_path):
    path = save(tmp_path, "a.bed", "# note\ntrack x\nc1\t0\t5\nc1\t7\t9\tn\t12\t-\n")
    rows = files.read_bed(spark, path)
    assert [tuple(r) for r in rows.orderBy("s").collect()] == [("c1", 0, 5, None, None, None), ("c1", 7, 9, "n", 12.0, "-")]
    files.write_bed(rows, str(tmp_path / "out"), ["contig", "s", "e", "name"])
    assert files.read_bed(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception, match="start is not below"):
        files.read_bed(spark, save(tmp_path, "b.bed", "c1\t5\t5\n")).collect()


def test_paf_sam_fai(spark, tmp_path):
    path = save(tmp_path, "a.paf", "q\t10\t0\t8\t+\tt\t20\t2\t10\t6\t8\t60\tNM:i:2\tcg:Z:8=\nq\t10\t0\t2\t+\tt\t20\t2\t4\t1\t2\t60\n")
    rows = files.read_paf(spark, path, least_identity=0.7).collect()
    assert [(r["query"], r["t0"], r["identity"], r["cigar"]) for r in rows] == [("q", 2, 0.75, "8=")]
    sam = files.read_sam(spark, save(tmp_path, "a.sam", "@HD\tVN:1\nr\t16\tt\t5\t60\t4=\t*\t0\t0\tACGT\t*\n")).collect()
    assert [(r["s"], r["reverse"], r["bases"]) for r in sam] == [(4, True, "ACGT")]
    assert files.read_fai(spark, save(tmp_path, "a.fai", "c1\t10\t3\t6\t7\n")).first()["length"] == 10


def test_vcf(spark, tmp_path):
    body = '##contig=<ID=c1,length=10>\n##map=<A=1,B="x, y">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc1\t3\t.\tA\t<INS>\t.\tPASS\tSEQ=GG;FLAG;SEQ=later\tGT:N\t1:4\t.\n'
    path = save(tmp_path, "a.vcf", body)
    rows = files.read_vcf(spark, path)
    r = rows.first()
    assert (r["s"], r["id"], r["info"]) == (2, None, {"SEQ": "GG", "FLAG": None})
    assert files.plain_variants(rows).first()["alt"] == "AGG"
    assert files.vcf_samples(spark, path) == ["s1", "s2"]
    assert {x["sample"]: x["values"] for x in files.sample_calls(rows, ["s1", "s2"]).collect()} == {"s1": {"GT": "1", "N": "4"}, "s2": {"GT": "."}}
    assert files.vcf_meta(spark, path, "map").first()["fields"] == {"A": "1", "B": "x, y"}


def test_gfa_round_trip_and_gaf(spark, tmp_path):
    path = save(tmp_path, "a.gfa", "H\tVN:Z:1.0\nS\t1\tACG\tSR:i:0\nS\t2\tT\nL\t1\t+\t2\t-\t0M\nP\tp\t1+,2-\t*\n")
    s, k, p = files.read_gfa(spark, path)
    assert [tuple(r) for r in p.orderBy("ordinal").collect()] == [("p", 0, "1", "+"), ("p", 1, "2", "-")]
    steps = p.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "segment", "strand"))), lambda x: F.concat(x["segment"], x["strand"])), ",").alias("steps"))
    files.write_gfa(s, k, steps, str(tmp_path / "out"))
    again = files.read_gfa(spark, str(tmp_path / "out"))
    assert again[0].count() == 2 and again[1].first()["b_strand"] == "-" and again[2].count() == 2
    gaf = files.read_gaf(spark, save(tmp_path, "a.gaf", "q\t9\t0\t9\t+\t>1<2\t9\t0\t9\t9\t9\t60\n")).first()
    assert gaf["steps"] == [">1", "<2"]


def test_scalars(spark):
    row = spark.range(1).select(
        sequences.reverse_complement(F.lit("ACGTNryk")).alias("rc"),
        sequences.runs_of(F.lit("NNACNNNG"), "N").alias("runs"),
        sequences.windows_of(F.lit(10), 4).alias("w"),
        sequences.canonical(F.lit("AAC")).alias("canon"),
        cigar.positions(F.lit("3=2I1D4=")).alias("pos"),
        cigar.is_valid(F.lit("3=2Q")).alias("bad"),
        text.locus(F.lit("chr1:90-20-")).alias("locus"),
        text.haplotype_name(F.lit("g7_HG2_h1_chr_un_5_900")).alias("name"),
        text.trimmed_alleles(F.lit(10), F.lit("CAGT"), F.lit("CGT")).alias("alleles"),
        text.trimmed_alleles(F.lit(10), F.lit("A"), F.lit("A")).alias("same"),
        text.safe_token(F.lit("a b/c")).alias("token"),
        text.interval_distance(F.lit(0), F.lit(5), F.lit(5), F.lit(7)).alias("touch"),
        text.flipped(F.lit(2), F.lit(5), F.lit(20)).alias("flip"),
    ).first()
    assert row["rc"] == "mryNACGT"
    assert [tuple(x) for x in row["runs"]] == [(0, 2), (4, 7)] and [tuple(x) for x in row["w"]] == [(0, 4), (4, 8), (8, 10)]
    assert row["canon"] == "GTT" and [tuple(x) for x in row["pos"]] == [(0, 3, "=", 0, 0), (1, 2, "I", 3, 3), (2, 1, "D", 5, 3), (3, 4, "=", 5, 4)] and not row["bad"]
    assert tuple(row["locus"]) == ("chr1", 20, 90, "-") and tuple(row["name"]) == (7, "HG2", "h1", "chr_un", 5, 900)
    assert tuple(row["alleles"]) == (10, "CA", "C") and tuple(row["same"]) == (10, "A", "A") and row["token"] == "a_b_c" and row["touch"] == 0 and tuple(row["flip"]) == (15, 18)


def test_sessions_equal_unions(spark, tmp_path):
    from spanweave.streaming.windows import dense_windows, sessions

    rows = spark.createDataFrame([("a", x) for x in (0, 10, 19, 30, 300)], "k string, x long").withColumn("t", F.timestamp_seconds("x"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, "t", ["k"], "10 seconds", "0 seconds").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((int(r["s"].timestamp()) % 1000, int(r["e"].timestamp()) % 1000, r["n"]) for r in spark.sql("SELECT * FROM sessions").collect())
    assert [x[2] for x in got] == [3, 1, 1]
    q = dense_windows(stream, "t", ["k"], "20 seconds", "10 seconds", 2, "0 seconds").writeStream.format("memory").queryName("dense").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM dense").collect()) == [2, 3]
