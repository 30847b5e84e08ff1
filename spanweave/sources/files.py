"""Scans and writers of the text formats around sequences, intervals, alignments, variants and graphs.

All are ordinary Spark text scans with a projection, so files split, columns are pruned and compressed input is read as Spark reads it. Coordinates leave every scan 0-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import info_map


def _fields(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith(comment))
    return lines.select(F.split("value", "\t").alias("f"))


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _must(df: DataFrame, ok: Column, what: str) -> DataFrame:
    """Fail the scan on a row that breaks a rule."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, header, sequence. Case is kept, line breaks are dropped. A record is one row; cut long ones with chunked()."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    header = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    body = F.when(F.instr("v", "\n") > 0, F.expr("substr(v, instr(v, '\n') + 1)")).otherwise("")
    return records.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), header.alias("header"), F.translate(body, "\n\r \t", "").alias("sequence"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence, quality of four-line records, a record a row.

    Files are parted at line breaks before an @. A quality line that begins with @ is parted from its record so; the record then has three lines, and takes the first line of the piece that follows, which is the next
    of its block of the file or the first of the next block.
    """
    where = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    pieces = spark.read.option("lineSep", "\n@").text(path).select("value", *[c.alias(n) for n, c in where.items()], F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("file", "block").orderBy("at")
    placed = pieces.withColumn("behind", F.lead("value").over(order)).withColumn("first", F.row_number().over(order) == 1)
    heads = placed.where("first").select("file", "block", F.col("value").alias("head"))  # a row a block
    follows = heads.withColumn("next_head", F.lead("head").over(Window.partitionBy("file").orderBy("block"))).select("file", "block", "next_head")
    whole = placed.join(follows, ["file", "block"]).select(F.split(F.regexp_replace("value", "^@", ""), "\r?\n").alias("f"), F.coalesce("behind", "next_head").alias("rest"))
    lines = whole.where((F.size("f") >= 3) & F.get("f", F.lit(2)).startswith("+"))
    quality = F.when(F.size("f") == 3, F.concat(F.lit("@"), F.regexp_extract("rest", r"^([^\r\n]*)", 1))).otherwise(_at(3))
    return lines.select(F.regexp_extract(_at(0), r"^(\S*)", 1).alias("name"), _at(1).alias("sequence"), quality.alias("quality"))


def chunked(sequences: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Sequences as rows of at most size + overlap characters: name, chunk, at, bases."""
    n = F.greatest(F.length("sequence") - 1, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda i: F.struct(i.alias("chunk"), (i * size).cast("long").alias("at"), F.substr("sequence", i * size + 1, F.lit(size + overlap)).alias("bases")))
    return sequences.select("name", F.inline(pieces))


def fetch(chunks: DataFrame, requests: DataFrame, size: int) -> DataFrame:
    """The bases [s, e) of each request (id, name, s, e), from chunks without overlap: id, bases. Requests meet only the chunks they touch."""
    wanted = requests.select("id", "name", "s", "e", F.explode(F.sequence(F.expr(f"int(s div {size})"), F.expr(f"int(greatest(s, e - 1) div {size})"))).alias("chunk"))
    part = wanted.join(chunks, ["name", "chunk"])
    low = F.greatest(F.col("s") - F.col("at"), F.lit(0).cast("long"))
    cut = F.substr("bases", (low + 1).cast("int"), F.greatest(F.col("e") - F.col("at") - low, F.lit(0).cast("long")).cast("int"))
    parts = part.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("chunk", cut.alias("b")))).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["b"]), "").alias("bases"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """name, length, offset, linebases, linewidth of a sequence index."""
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, linebases int, linewidth int")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, s, e, name, score, strand of three to six columns (absent ones null). A row whose start is not below its end fails the scan."""
    rows = _fields(spark, path, "#").where(~_at(0).startswith("track") & ~_at(0).startswith("browser"))
    out = rows.select(_at(0).alias("contig"), _at(1).cast("long").alias("s"), _at(2).cast("long").alias("e"), _at(3).alias("name"), F.try_to_number(_at(4), F.lit("S999999999D999")).cast("double").alias("score"), F.nullif(_at(5), F.lit(".")).alias("strand"))
    return _must(out, (F.col("s") >= 0) & (F.col("s") < F.col("e")), "a BED row whose start is not below its end")


def read_paf(spark: SparkSession, path: str, *, least_identity: float = 0.0, least_aligned: int = 0) -> DataFrame:
    """Alignments: twelve columns and the cg:Z tag, with identity = matches / aligned; rows under the limits are left out in the scan."""
    names = ("query", "query_length", "q0", "q1", "strand", "target", "target_length", "t0", "t1", "matches", "aligned", "quality")
    texts = {"query", "strand", "target"}
    rows = _fields(spark, path).select(*[(_at(i) if n in texts else _at(i).cast("long")).alias(n) for i, n in enumerate(names)], F.regexp_extract(F.array_join("f", "\t"), r"\tcg:Z:(\S+)", 1).alias("cigar"))
    out = rows.withColumn("identity", F.when(F.col("aligned") > 0, F.col("matches") / F.col("aligned")).otherwise(0.0)).withColumn("cigar", F.nullif("cigar", F.lit("")))
    return out.where((F.col("identity") >= least_identity) & (F.col("aligned") >= least_aligned))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records: query, flag, target, s (0-based), quality, cigar, bases, reverse."""
    rows = _fields(spark, path, "@")
    flag = _at(1).cast("int")
    return rows.select(_at(0).alias("query"), flag.alias("flag"), _at(2).alias("target"), (_at(3).cast("long") - 1).alias("s"), _at(4).cast("int").alias("quality"), _at(5).alias("cigar"), _at(9).alias("bases"), (flag.bitwiseAND(16) != 0).alias("reverse"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant rows: chrom, s (0-based), id, ref, alt, filter, info (map), format and samples (arrays), in columns that prune."""
    rows = _fields(spark, path)
    return rows.select(
        _at(0).alias("chrom"), (_at(1).cast("long") - 1).alias("s"), F.nullif(_at(2), F.lit(".")).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), _at(6).alias("filter"), info_map(_at(7)).alias("info"),
        F.split(_at(8), ":").alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"),
    )


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line: one row."""
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return head[0]["value"].split("\t")[9:] if head else []


def vcf_meta(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Structured header lines ##key=<a=b,c="d, e"> as maps: fields."""
    body = F.regexp_extract("value", rf"^##{key}=<(.*)>$", 1)
    lines = spark.read.text(path).where(F.col("value").startswith(f"##{key}=<"))
    pairs = F.regexp_extract_all(body, F.lit(r'([^,=]+=(?:"(?:[^"\\]|\\.)*"|[^,]*))'), F.lit(1))
    return lines.select(F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, "^[^=]*=", ""), '^"|"$', "").alias("v")))).alias("fields"))


def sample_calls(variants: DataFrame, names: list[str]) -> DataFrame:
    """One row a variant and sample: chrom, s, ref, alt, sample, values (format name -> text)."""
    return variants.select("chrom", "s", "ref", "alt", "format", F.posexplode("samples").alias("_i", "cell")).select(
        "chrom", "s", "ref", "alt", F.get(F.array(*[F.lit(n) for n in names]), F.col("_i")).alias("sample"), F.map_from_arrays(F.slice("format", 1, F.least(F.size("format"), F.size(F.split("cell", ":")))), F.slice(F.split("cell", ":"), 1, F.least(F.size("format"), F.size(F.split("cell", ":"))))).alias("values")
    )


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (id, sequence, tags), links (a, a_strand, b, b_strand, cigar, tags) and paths (path, ordinal, segment, strand)."""
    rows = _fields(spark, path)
    tags = lambda n: F.slice("f", n, F.greatest(F.size("f") - n + 1, F.lit(0)))
    segments = rows.where(_at(0) == "S").select(_at(1).alias("id"), _at(2).alias("sequence"), tags(4).alias("tags"))
    links = rows.where(_at(0) == "L").select(_at(1).alias("a"), _at(2).alias("a_strand"), _at(3).alias("b"), _at(4).alias("b_strand"), _at(5).alias("cigar"), tags(7).alias("tags"))
    steps = rows.where(_at(0) == "P").select(_at(1).alias("path"), F.posexplode(F.split(_at(2), ",")).alias("ordinal", "step"))
    return segments, links, steps.select("path", "ordinal", F.expr("substr(step, 1, length(step) - 1)").alias("segment"), F.right("step", F.lit(1)).alias("strand"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Walks: query, length, q0, q1, strand and steps (array of oriented segments such as >s1)."""
    rows = _fields(spark, path)
    return rows.select(_at(0).alias("query"), _at(1).cast("long").alias("length"), _at(2).cast("long").alias("q0"), _at(3).cast("long").alias("q1"), _at(4).alias("strand"), F.regexp_extract_all(_at(5), F.lit(r"[><][^><]+"), F.lit(0)).alias("steps"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text column as text files, in as many parts as it has partitions."""
    lines.write.mode("errorifexists").text(path)


def write_bed(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated rows in order of contig and start: the columns must begin with contig, start, end."""
    write_lines(df.orderBy(*columns[:3]).select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value")), path)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """name and sequence as records wrapped to `width`."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    write_lines(df.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")), path)


def write_gfa(segments: DataFrame, links: DataFrame, paths: DataFrame, path: str) -> None:
    """segments (id, sequence), links (a, a_strand, b, b_strand) and paths (path, steps as text) as one set of files."""
    s = segments.select(F.concat_ws("\t", F.lit("S"), "id", "sequence").alias("value"))
    k = links.select(F.concat_ws("\t", F.lit("L"), "a", "a_strand", "b", "b_strand", F.lit("0M")).alias("value"))
    p = paths.select(F.concat_ws("\t", F.lit("P"), "path", "steps", F.lit("*")).alias("value"))
    write_lines(s.unionAll(k).unionAll(p), path)


def plain_variants(df: DataFrame) -> DataFrame:
    """Rows on roots only: nested rows and rows at position 0 of the file's own counting go; symbolic insertions take their bases from the info's SEQ."""
    kept = df.where((F.col("s") >= 0) & ~F.col("info").getItem("PARENT").isNotNull())
    return kept.withColumn("alt", F.when((F.col("alt") == "<INS>") & F.col("info").getItem("SEQ").isNotNull(), F.concat(F.col("ref"), F.col("info").getItem("SEQ"))).otherwise(F.col("alt")))


def read_mapper_bed(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rows of sixteen columns or more: contig, s, e, target, score, strand, sample, t0, t1 and source_target (the 17th column, else the target). A row with another strand or an empty interval fails the scan."""
    rows = _fields(spark, path).select(
        _at(0).alias("contig"), _at(1).cast("long").alias("s"), _at(2).cast("long").alias("e"), _at(3).alias("target"), _at(4).cast("int").alias("score"), _at(5).alias("strand"), _at(6).alias("sample"),
        _at(7).cast("long").alias("t0"), _at(8).cast("long").alias("t1"), F.coalesce(_at(16), _at(3)).alias("source_target"),
    )
    sound = F.col("strand").isin("+", "-") & (F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("t0") >= 0) & (F.col("t0") < F.col("t1"))
    return _must(rows, F.coalesce(sound, F.lit(False)), "a mapping row with a bad strand or interval")


def read_graph_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Ten columns of graph alignments, with or without a header line: hotspot, contig, s, e, strand, query, path, cigar, reference_positions, query_positions. Points are null."""
    texts = {"contig": 1, "strand": 4, "query": 5, "path": 6, "cigar": 7, "reference_positions": 8, "query_positions": 9}
    rows = _fields(spark, path).where(_at(0).rlike(r"^\d+$"))
    return rows.select(_at(0).cast("int").alias("hotspot"), _at(2).cast("long").alias("s"), _at(3).cast("long").alias("e"), *[F.nullif(_at(i), F.lit(".")).alias(n) for n, i in texts.items()])


def read_hotspots(spark: SparkSession, path: str) -> DataFrame:
    """Hotspot rows of four or six columns: target (from 1), contig, s, e (in order) and raw (whether they are raw k-mer ends, as in the four-column form). A row of neither form, or an empty one, fails the scan."""
    rows = _fields(spark, path)
    six = (F.size("f") >= 6) & _at(0).rlike(r"^\d+$") & _at(3).isin("+", "-")
    four = (F.size("f") >= 4) & _at(1).rlike(r"^\d+$")
    n = F.size("f")
    a, b = F.when(six, _at(4)).otherwise(F.get("f", n - 2)), F.when(six, _at(5)).otherwise(F.get("f", n - 1))
    low, high = F.least(a.cast("long"), b.cast("long")), F.greatest(a.cast("long"), b.cast("long"))
    known = _must(rows, six | four, "a hotspot row of an unknown form")
    out = known.select(F.when(six, _at(0)).otherwise(_at(1)).cast("int").alias("target"), F.when(six, _at(2)).otherwise(_at(0)).alias("contig"), low.alias("s"), high.alias("e"), (~six).alias("raw"))
    return _must(out, (F.col("target") >= 1) & (F.col("s") >= 0) & (F.col("s") < F.col("e")), "a hotspot row without a positive index or interval")


def read_assembly_list(spark: SparkSession, path: str) -> DataFrame:
    """name and fasta of an assembly list, relative paths under the list's own folder. A name that comes twice fails the scan."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where((_at(0) != "") & ~_at(0).startswith("#"))
    rows = _must(lines, F.size("f").isin(2, 3), "an assembly list row of other than two or three fields").select(_at(0).alias("name"), _at(1).alias("file"))
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("name")))
    folder = path.rsplit("/", 1)[0]
    return _must(counted, F.col("_n") == 1, "an assembly name that comes twice").select("name", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(F.lit(folder + "/"), "file")).alias("fasta"))


def read_kmer_report(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a k-mer comparison: a, b, common, only_a, only_b, var_a, var_b, as a long table."""
    numbers = ("common", "only_a", "only_b", "var_a", "var_b")
    return _fields(spark, path).where(F.try_to_number(_at(2), F.lit("S999999999999999999D999999999999")).isNotNull()).select(_at(0).alias("a"), _at(1).alias("b"), *[_at(i + 2).cast("double").alias(n) for i, n in enumerate(numbers)])


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """contig, s, e and name of excluded regions; a region without a name, or with a point, has none."""
    return read_bed(spark, path).select("contig", "s", "e", F.nullif("name", F.lit(".")).alias("name"))


def with_offsets(index: DataFrame, name: str = "name", length: str = "length") -> DataFrame:
    """Contigs of an index with where they begin in their running total, in order of name: column begins. One row a contig."""
    order = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    return index.withColumn("begins", F.sum(length).over(order) - F.col(length))


def fai_of(sequences: DataFrame, width: int = 60) -> DataFrame:
    """The index of a FASTA file that write_fasta() makes in one part, records in order of name: name, length, offset, linebases, linewidth."""
    n, head = F.length("sequence").cast("long"), F.octet_length("name").cast("long") + 2
    size = head + n + F.greatest(F.ceil(n / width), F.lit(1))
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    return sequences.select("name", n.alias("length"), (F.sum(size).over(order) - size + head).alias("offset"), F.lit(width).alias("linebases"), F.lit(width + 1).alias("linewidth"))


def write_vcf(variants: DataFrame, calls: DataFrame, names: list[str], contigs: DataFrame, path: str, meta: list[str] = ()) -> None:
    """Variant rows with a genotype column a sample, behind their header, in order of contig, position and id; part files in order of their names are the file.

    variants: chrom, s (from 0), id, ref, alt, filter, info (text); calls: id, sample, call; contigs: name, length. A sample without a call has a point. Only here are calls brought side by side, a row at a time.
    """
    wide = calls.groupBy("id").pivot("sample", list(names)).agg(F.max("call"))
    body = variants.join(wide, "id", "left")
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit(".")) for n in names]
    line = F.concat_ws("\t", "chrom", (F.col("s") + 1).cast("string"), "id", "ref", "alt", F.lit("."), F.coalesce("filter", F.lit("PASS")), F.coalesce("info", F.lit(".")), F.lit("GT"), *cells)
    spark = variants.sparkSession
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    head = spark.createDataFrame([(0, "##fileformat=VCFv4.2"), *[(1, m) for m in meta], (3, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (4, columns)], "o int, line string")
    lines = head.select("o", F.lit("").alias("c"), F.lit(0).cast("long").alias("p"), "line")
    lines = lines.unionAll(contigs.select(F.lit(2), F.col("name"), F.lit(0).cast("long"), F.concat(F.lit("##contig=<ID="), "name", F.lit(",length="), F.col("length").cast("string"), F.lit(">"))))
    lines = lines.unionAll(body.select(F.lit(5), F.col("chrom"), F.col("s"), line))
    write_lines(lines.orderBy("o", "c", "p", "line").select(F.col("line").alias("value")), path)


def write_gaf(walks: DataFrame, path: str) -> None:
    """Walks (sample, query, length, q0, q1, strand, steps: array of oriented segments, size: of the path) as GAF lines, in a folder a sample."""
    covered = (F.col("q1") - F.col("q0")).cast("string")
    text = [F.col(c).cast("string") for c in ("query", "length", "q0", "q1", "strand")]
    line = F.concat_ws("\t", *text, F.array_join("steps", ""), F.col("size").cast("string"), F.lit("0"), F.col("size").cast("string"), covered, covered, F.lit("255"))
    walks.select("sample", line.alias("value")).write.mode("errorifexists").partitionBy("sample").text(path)


def write_routed(rows: DataFrame, chosen: DataFrame, node: str, parent: str, path: str) -> None:
    """Rows of a tree in two tables: those of the chosen nodes and all below them under path/routed, the others under path/kept."""
    from ..operators.variants import with_descendants

    below = with_descendants(rows, node, parent, chosen).withColumnRenamed("node", node)
    rows.join(below, node, "left_semi").write.mode("errorifexists").parquet(f"{path}/routed")
    rows.join(below, node, "left_anti").write.mode("errorifexists").parquet(f"{path}/kept")
