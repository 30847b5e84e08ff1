"""Queries of scans and writers: rows of the test tables written as files in the shared folder and read again, and the DuckDB SQL of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..sources import files, scratch
from .queries import query
from .tables import D, L, letters, shipments, table


def lines(df, *columns):
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def saved(spark, name: str, df) -> str:
    path = scratch.fresh_path(spark, name)
    files.write_lines(df, path)
    return path


def bases(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.translate(F.repeat("p_name", 8), " ", "").alias("sequence"))


BASES = "S AS (SELECT 'p' || p_partkey AS name, replace(repeat(p_name, 8), ' ', '') AS sequence FROM part)"


@query(f"WITH {BASES} SELECT name, sequence, name AS header FROM S")
def scan_fasta(spark, d):
    path = scratch.fresh_path(spark, "fasta")
    files.write_fasta(bases(spark, d), path, 50)
    return files.read_fasta(spark, path).select("name", "sequence", "header")


@query(f"WITH {BASES} SELECT name AS id, substring(sequence, 11, 30) AS bases FROM S WHERE length(sequence) > 10")
def fetch_intervals(spark, d):
    chunks = files.chunked(bases(spark, d), 16)
    asked = bases(spark, d).where("length(sequence) > 10").select(F.col("name").alias("id"), "name", F.lit(10).cast("long").alias("s"), F.least(F.lit(40).cast("long"), F.length("sequence").cast("long")).alias("e"))
    return files.fetch(chunks, asked, 16)


@query("SELECT p_partkey, 'p' || p_partkey AS name, repeat(chr(64 + CAST(p_size % 3 AS INTEGER)), CAST(p_size % 7 + 1 AS INTEGER)) AS quality FROM part")
def scan_fastq(spark, d):
    """Quality lines of one sign, a third of them of the sign that begins a record."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") % 7 + 1).alias("n"), F.expr("chr(64 + p_size % 3)").alias("c"))
    text = rows.select(F.concat(F.lit("@p"), "k", F.lit("\n"), F.expr("repeat('A', n)"), F.lit("\n+\n"), F.expr("repeat(c, n)")).alias("value"))
    found = files.read_fastq(spark, saved(spark, "fastq", text))
    return found.select(F.expr("cast(substr(name, 2) as bigint)").alias("p_partkey"), "name", "quality")


@query(f"WITH {BASES} SELECT name, CAST(length(sequence) AS BIGINT) AS length, CAST(sum(length(sequence)) OVER (ORDER BY name) - length(sequence) AS BIGINT) AS begins FROM S")
def scan_fai(spark, d):
    index = files.fai_of(bases(spark, d), 50)
    read = files.read_fai(spark, saved(spark, "fai", lines(index, "name", "length", "offset", "linebases", "linewidth")))
    return files.with_offsets(read).select("name", "length", "begins")


@query(f"WITH {L} SELECT CAST(k AS VARCHAR) AS contig, s, e, CAST(id AS VARCHAR) AS name, CAST(supp AS DOUBLE) AS score, CASE WHEN supp % 2 = 0 THEN '+' END AS strand FROM L")
def scan_bed(spark, d):
    path = scratch.fresh_path(spark, "bed")
    rows = shipments(spark, d).select(F.col("k").cast("string").alias("contig"), "s", "e", "id", "supp", F.when(F.col("supp") % 2 == 0, "+").alias("strand"))
    files.write_bed(rows, path, ["contig", "s", "e", "id", "supp", "strand"])
    return files.read_bed(spark, path)


@query(f"WITH {L} SELECT CAST(k AS VARCHAR) AS contig, s, e, CASE WHEN id % 2 = 0 THEN 'n' || id END AS name FROM L WHERE flag = 'R'")
def scan_blacklist(spark, d):
    rows = shipments(spark, d).where("flag = 'R'").select("k", "s", "e", F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(".").alias("name"))
    return files.read_blacklist(spark, saved(spark, "blacklist", lines(rows, "k", "s", "e", "name")))


@query(f"WITH {L} SELECT CAST(k AS VARCHAR) AS contig, s, e, 't' || supp AS target, CAST(id % 1000 AS INTEGER) AS score, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand, flag AS sample, s + 5 AS t0, e + 5 AS t1, CASE WHEN id % 3 = 0 THEN 'x' || supp ELSE 't' || supp END AS source_target FROM L")
def scan_mapper_bed(spark, d):
    rows = shipments(spark, d).select("k", "s", "e", F.concat(F.lit("t"), F.col("supp").cast("string")).alias("t"), (F.col("id") % 1000).alias("score"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), "flag", (F.col("s") + 5).alias("t0"), (F.col("e") + 5).alias("t1"), *[F.lit(1).alias(f"c{i}") for i in range(7)], F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("supp").cast("string"))).alias("other"))
    return files.read_mapper_bed(spark, saved(spark, "mapper", lines(rows, *rows.columns)))


@query(f"WITH {L} SELECT CAST(id AS INTEGER) AS hotspot, s, e, CAST(k AS VARCHAR) AS contig, '+' AS strand, 'q' || supp AS query, '>a<b' AS path, (e - s) || '=' AS cigar, NULL AS reference_positions, CAST(s AS VARCHAR) AS query_positions FROM L")
def scan_graph_alignments(spark, d):
    rows = shipments(spark, d).select("id", "k", "s", "e", F.lit("+").alias("st"), F.concat(F.lit("q"), F.col("supp").cast("string")).alias("q"), F.lit(">a<b").alias("p"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit("=")).alias("c"), F.lit(".").alias("r"), F.col("s").alias("qp"))
    head = spark.createDataFrame([("hotspot_index\tcontig\tstart\tend\tstrand\tqueryname\tgraph_path\tgraphcigar\trefpositions\tqpositions",)], "value string")
    return files.read_graph_alignments(spark, saved(spark, "align", head.unionAll(lines(rows, *rows.columns))))


@query(f"WITH {L} SELECT CAST(id AS INTEGER) AS target, 'c' || k AS contig, s, e, flag = 'N' AS raw FROM L")
def scan_hotspots(spark, d):
    rows = shipments(spark, d).select("id", F.concat(F.lit("c"), F.col("k").cast("string")).alias("c"), "s", "e", "flag", F.lit("+").alias("st"))
    four, six = lines(rows.where("flag = 'N'"), "c", "id", "e", "s"), lines(rows.where("flag <> 'N'"), "id", "flag", "c", "st", "s", "e")
    return files.read_hotspots(spark, saved(spark, "hotspots", four.unionAll(six)))


@query("SELECT 's' || s_suppkey || '_h1' AS name, CASE WHEN s_suppkey % 2 = 0 THEN '/data/' || s_suppkey || '.fa' ELSE 'beside/' || s_suppkey || '.fa' END AS fasta FROM supplier")
def scan_assembly_list(spark, d):
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, d, "supplier").select(F.concat_ws("  ", F.concat(F.lit("s"), k, F.lit("_h1")), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "/data/").otherwise(""), k, F.lit(".fa"))).alias("value"))
    path = saved(spark, "assemblies", rows)
    read = files.read_assembly_list(spark, path)
    return read.withColumn("fasta", F.replace("fasta", F.lit(path.rsplit("/", 1)[0] + "/"), F.lit("beside/")))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS common, CAST(count(*) AS DOUBLE) AS only_a FROM lineitem GROUP BY l_suppkey, l_partkey")
def scan_kmer_report(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("c"), F.count("*").alias("n")).withColumns({x: F.lit(0.5) for x in ("o", "v", "w")})
    head = spark.createDataFrame([("seqA\tseqB\tcommon\tonlyA\tonlyB\tvarA\tvarB",)], "value string")
    return files.read_kmer_report(spark, saved(spark, "report", head.unionAll(lines(rows, *rows.columns)))).select("a", "b", "common", "only_a")


@query(f"WITH {L} SELECT 'q' || k AS query, s AS q0, e AS q1, 't' || supp AS target, e - s - 1 AS matches, CAST((e - s - 1) AS DOUBLE) / (e - s) AS identity, (e - s) || '=' AS cigar FROM L WHERE e - s >= 5 AND (e - s - 1) / (e - s) >= 0.9")
def scan_paf(spark, d):
    n = F.col("e") - F.col("s")
    rows = shipments(spark, d).select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("q"), F.lit(5000).alias("ql"), "s", "e", F.lit("+").alias("st"), F.concat(F.lit("t"), F.col("supp").cast("string")).alias("t"), F.lit(5000).alias("tl"), F.col("s").alias("t0"), F.col("e").alias("t1"), (n - 1).alias("m"), n.alias("n"), F.lit(60).alias("mq"), F.concat(F.lit("cg:Z:"), n.cast("string"), F.lit("=")).alias("cg"))
    found = files.read_paf(spark, saved(spark, "paf", lines(rows, *rows.columns)), least_identity=0.9, least_aligned=5)
    return found.select("query", "q0", "q1", "target", "matches", "identity", "cigar")


@query(f"WITH {L} SELECT 'q' || k AS query, CAST(supp % 2 * 16 AS INTEGER) AS flag, 't' || supp AS target, s, (e - s) || 'M' AS cigar, supp % 2 = 1 AS reverse FROM L")
def scan_sam(spark, d):
    rows = shipments(spark, d).select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("q"), (F.col("supp") % 2 * 16).alias("f"), F.concat(F.lit("t"), F.col("supp").cast("string")).alias("t"), (F.col("s") + 1).alias("p"), F.lit(60).alias("mq"), F.concat((F.col("e") - F.col("s")).cast("string"), F.lit("M")).alias("c"), F.lit("*").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("l"), F.lit("ACG").alias("seq"), F.lit("*").alias("qual"))
    head = spark.createDataFrame([("@SQ\tSN:t1\tLN:5000",)], "value string")
    return files.read_sam(spark, saved(spark, "sam", head.unionAll(lines(rows, *rows.columns)))).select("query", "flag", "target", "s", "cigar", "reverse")


CALLED = "V AS (SELECT o_orderkey, 'chr' || o_custkey % 5 AS chrom, o_custkey AS s, 'v' || o_orderkey AS id, o_orderstatus AS st FROM orders), C AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)"


def called(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")).alias("chrom"), F.col("o_custkey").alias("s"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("A").alias("ref"), F.lit("<INS>").alias("alt"), F.lit(None).cast("string").alias("filter"), F.concat(F.lit("SVTYPE=INS;SEQ=ACGT;ST="), "o_orderstatus").alias("info"))
    seen = table(spark, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_returnflag").alias("sample")).distinct().withColumn("call", F.lit("1"))
    contigs = rows.select(F.col("chrom").alias("name")).distinct().withColumn("length", F.lit(200000))
    path = scratch.fresh_path(spark, "vcf")
    files.write_vcf(rows, seen, ["A", "N", "R"], contigs, path, ["##source=spanweave"])
    return path


@query(f"WITH {CALLED} SELECT chrom, s, id, st AS status, sample, CASE WHEN EXISTS (SELECT 1 FROM C WHERE l_orderkey = o_orderkey AND l_returnflag = sample) THEN '1' ELSE '.' END AS call FROM V, (VALUES ('A'), ('N'), ('R')) t(sample)")
def written_calls(spark, d):
    """Variants with a genotype column a sample, written with their header, read with the names that it states."""
    path = called(spark, d)
    names = files.vcf_samples(spark, path)
    rows = files.read_vcf(spark, path)
    cells = rows.select("chrom", "s", "id", F.col("info").getItem("ST").alias("status"), F.posexplode("samples").alias("i", "call"))
    return cells.select("chrom", "s", "id", "status", F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("sample"), "call")


@query("SELECT 'chr' || i AS contig, '200000' AS length FROM range(5) t(i)")
def vcf_contigs(spark, d):
    return files.vcf_meta(spark, called(spark, d), "contig").select(F.col("fields").getItem("ID").alias("contig"), F.col("fields").getItem("length").alias("length"))


@query(f"WITH {CALLED} SELECT chrom, s, id, 'AACGT' AS alt FROM V")
def plain_variants(spark, d):
    return files.plain_variants(files.read_vcf(spark, called(spark, d))).select("chrom", "s", "id", "alt")


@query("SELECT l_returnflag AS sample, 'o' || l_orderkey AS query, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS steps FROM lineitem GROUP BY l_returnflag, l_orderkey")
def written_walks(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sample"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("query"))
    walks = rows.agg(F.sum(F.col("l_quantity").cast("long")).alias("length"), F.sort_array(F.collect_list(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "<").otherwise(">"), F.lit("s"), F.col("l_partkey").cast("string")))).alias("steps"))
    path = scratch.fresh_path(spark, "gaf")
    files.write_gaf(walks.select("sample", "query", "length", F.lit(0).alias("q0"), F.col("length").alias("q1"), F.lit("+").alias("strand"), "steps", F.col("length").alias("size")), path)
    read = None
    for flag in ("A", "N", "R"):  # the samples of the table, a folder each
        one = files.read_gaf(spark, f"{path}/sample={flag}").select(F.lit(flag).alias("sample"), "query", "length", F.size("steps").cast("long").alias("steps"))
        read = one if read is None else read.unionAll(one)
    return read


@query("SELECT 'p' || p_partkey AS id, p_brand AS sequence, CAST((SELECT count(*) FROM part) AS BIGINT) AS links FROM part")
def written_graph(spark, d):
    """Segments, links and paths written and read again; every segment links to the next."""
    rows = table(spark, d, "part")
    name = lambda k: F.concat(F.lit("p"), k.cast("string"))
    segments = rows.select(name(F.col("p_partkey")).alias("id"), F.col("p_brand").alias("sequence"))
    links = rows.select(name(F.col("p_partkey")).alias("a"), F.lit("+").alias("a_strand"), name(F.col("p_partkey") + 1).alias("b"), F.lit("-").alias("b_strand"))
    paths = spark.createDataFrame([("x", "p1+,p2-")], "path string, steps string")
    path = scratch.fresh_path(spark, "gfa")
    files.write_gfa(segments, links, paths, path)
    s, k, _ = files.read_gfa(spark, path)
    return s.select("id", "sequence").withColumn("links", F.lit(k.count()))


@query("WITH RECURSIVE T AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey // 7 END AS up, o_orderstatus AS st FROM orders), R AS (SELECT node FROM T WHERE st = 'P' AND node % 5 = 0 UNION SELECT T.node FROM T JOIN R ON T.up = R.node) SELECT node, node IN (SELECT node FROM R) AS routed FROM T")
def routed_publish(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("node"), F.when(k % 7 > 0, F.expr("o_orderkey div 7")).alias("up"), F.col("o_orderstatus").alias("st"))
    path = scratch.fresh_path(spark, "publish")
    files.write_routed(rows, rows.where("st = 'P' AND node % 5 = 0"), "node", "up", path)
    return spark.read.parquet(f"{path}/routed").select("node", F.lit(True).alias("routed")).unionAll(spark.read.parquet(f"{path}/kept").select("node", F.lit(False)))


@query(f"WITH {D}, p AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM D WHERE t <> ''), v AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - i AS g FROM p WHERE c IN ('a', 'e', 'i', 'o', 'u')) SELECT doc_id, CAST(min(i) - 1 AS BIGINT) AS s, CAST(max(i) AS BIGINT) AS e FROM v GROUP BY doc_id, g")
def letter_runs(spark, d):
    """Maximal runs of vowels in the letters of texts."""
    return letters(spark, d).select("doc_id", F.inline(seq.runs_of(F.col("t"), "aeiou")))
