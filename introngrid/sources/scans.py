"""Scans of annotation, quantification and count files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from introngrid.schema import assert_none, assert_unique, require_columns

GTF = "chrom string, source string, feature string, start long, stop long, score string, strand string, frame string, attributes string"


def attribute(name: str, column: str = "attributes") -> Column:
    """The value of an attribute name "value"; null if it has none."""
    return F.nullif(F.regexp_extract(column, rf'{name} "([^"]+)"', 1), F.lit(""))


def file_stem(pattern: str = r"([^/]+?)(?:\.[^/]*)?$") -> Column:
    return F.regexp_extract(F.input_file_name(), pattern, 1)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GTF rows as 0-based half-open features with their ids, types and exon number."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="").where("attributes IS NOT NULL")
    return rows.select(
        "chrom", "source", "feature", (F.col("start") - 1).alias("start"), "stop", "strand",
        *[attribute(n).alias(n) for n in ("gene_id", "gene_name", "gene_type")], attribute("transcript_id").alias("tx_id"), attribute("transcript_type").alias("transcript_type"), attribute("ref_gene_id").alias("ref_gene_id"),
        F.expr("try_cast(regexp_extract(attributes, 'exon_number \"?([0-9]+)', 1) AS INT)").alias("exon_number"),
    )


def read_quant(spark: SparkSession, paths, sample: str | None = None) -> DataFrame:
    """Rows (sample, tx_id, length, effective_length, tpm, num_reads); the sample is the file's base name, or the first group of the pattern `sample` in its path."""
    schema = "Name string, Length double, EffectiveLength double, TPM double, NumReads double"
    rows = spark.read.csv(paths, sep="\t", header=True, schema=schema)
    return rows.select((file_stem(sample) if sample else file_stem()).alias("sample"), F.col("Name").alias("tx_id"), F.col("Length").alias("length"), F.col("EffectiveLength").alias("effective_length"), F.col("TPM").alias("tpm"), F.col("NumReads").alias("num_reads"))


def read_ec_membership(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ec_id, pos, tx_index): lines of transcript numbers with the class id last; the two header lines have one field."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 1)
    return rows.select(F.element_at("p", -1).cast("long").alias("ec_id"), F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("pos", "tx_index")).withColumn("tx_index", F.col("tx_index").cast("long"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (index, value): lines of a label file, or of a folder's files in order of name, with their place from 0.

    Places come from counts by file and input partition, so no task reads a whole file.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("__f"), F.monotonically_increasing_id().alias("__id"))
    lines = lines.withColumn("__p", F.shiftright("__id", 33))
    sizes = lines.groupBy("__f", "__p").agg(F.count("*").alias("n"), F.min("__id").alias("__lo"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__f", "__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = F.broadcast(sizes.select("__f", "__p", "__lo", before.alias("b")))  # a row for each file and split
    return lines.join(placed, ["__f", "__p"]).select((F.col("__id") - F.col("__lo") + F.col("b")).alias("index"), F.trim("value").alias("value"))


def read_matrix_market(spark: SparkSession, path: str, rows: str | None = None, columns: str | None = None) -> DataFrame:
    """Rows (row, col, value) with places from 0, or with the labels of the files rows and columns."""
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    part = F.split(F.trim("value"), r"\s+")
    # The dimensions are the first line that is no comment; it holds the number of entries, which no entry line can.
    # A folder's files follow each other by name.
    first = lines.withColumn("__id", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    head = first.agg(F.min("__id").alias("__first"))
    out = first.crossJoin(F.broadcast(head)).where("__id <> __first").select((part[0].cast("long") - 1).alias("row"), (part[1].cast("long") - 1).alias("col"), F.coalesce(part[2].cast("double"), F.lit(1.0)).alias("value"))
    for name, labels in (("row", rows), ("col", columns)):
        if labels:
            out = out.join(numbered_lines(spark, labels).select(F.col("index").alias(name), F.col("value").alias(f"{name}_label")), name).drop(name).withColumnRenamed(f"{name}_label", name)
    return out.select("row", "col", "value")


def read_ec_probabilities(spark: SparkSession, path: str, membership: DataFrame | None = None) -> DataFrame:
    """Rows (cell_id, ec_id, pos, prob) of a tab file (cell, ec, comma-joined probabilities); lists must have the class's size."""
    rows = spark.read.csv(path, sep="\t", header=True)
    require_columns(rows, ["cell_id", "ec_id", "probs"])
    lists = rows.select("cell_id", F.col("ec_id").cast("long").alias("ec_id"), F.split("probs", ",").alias("p"))
    if membership is not None:
        sizes = membership.groupBy("ec_id").agg(F.count("*").alias("n"))
        assert_none(lists.join(sizes, "ec_id", "left").where("n IS NULL OR size(p) <> n"), "a probability list has not the size of its class")
    return lists.select("cell_id", "ec_id", F.posexplode("p").alias("pos", "prob")).withColumn("prob", F.col("prob").cast("double"))


def read_weighted_ec(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, tx_id, weight, count): class lines `k id.. weight.. count`, re-keyed by transcript set; repeated sets are joined by count.

    The file starts with the number of transcripts and of classes, then the transcripts' names.
    """
    lines = numbered_lines(spark, path)
    n = int(lines.where("index = 0").first()["value"])
    names = lines.where((F.col("index") >= 2) & (F.col("index") < 2 + n)).select((F.col("index") - 2).alias("i"), F.col("value").alias("tx_id"))
    part = F.split("value", r"\s+")
    k = F.element_at("p", 1).cast("int")
    rows = lines.where(F.col("index") >= 2 + n).where("value <> ''").select("index", part.alias("p")).withColumn("k", k)
    pairs = rows.select("index", F.element_at("p", -1).cast("double").alias("count"), F.explode(F.arrays_zip(F.slice("p", 2, F.col("k")).alias("i"), F.slice("p", 2 + F.col("k"), F.col("k")).alias("w"))).alias("x"))
    named = pairs.select("index", "count", F.col("x.i").cast("long").alias("i"), F.col("x.w").cast("double").alias("weight")).join(names, "i")
    keys = named.groupBy("index").agg(F.array_join(F.array_sort(F.collect_set("tx_id")), ",").alias("key"))
    return named.join(keys, "index").groupBy("key", "tx_id").agg((F.sum(F.col("weight") * F.col("count")) / F.sum("count")).alias("weight"), F.sum("count").alias("count"))


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, length): the first word of each header and the number of letters that follow it."""
    parts = F.split("value", "\n")
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    body = F.regexp_replace(F.array_join(F.slice(parts, 2, F.size(parts)), ""), r"\s", "")
    return rows.select(F.regexp_extract(parts[0], r"^(\S+)", 1).alias("name"), F.length(body).cast("long").alias("length"))


def read_junction_matrix(spark: SparkSession, matrix: str, barcodes: str, features: str, junctions: str | None = None) -> DataFrame:
    """Rows (barcode, chrom, start, stop, strand, n); features of one column are numbers of lines of the junction file. Strand codes 0, 1, 2 are . + -."""
    cells = numbered_lines(spark, barcodes).select(F.col("index").alias("col"), F.col("value").alias("barcode"))
    lines = numbered_lines(spark, features)
    if junctions:
        lines = lines.select("index", F.col("value").cast("long").alias("j")).join(numbered_lines(spark, junctions).select(F.col("index").alias("j"), "value"), "j").select("index", "value")
    p = F.split("value", "\t")
    strand = F.element_at(F.create_map(*[F.lit(x) for x in ("0", ".", "1", "+", "2", "-")]), p[3])
    places = lines.select(F.col("index").alias("row"), p[0].alias("chrom"), p[1].cast("long").alias("start"), p[2].cast("long").alias("stop"), strand.alias("strand"))
    return read_matrix_market(spark, matrix).join(places, "row").join(cells, "col").select("barcode", "chrom", "start", "stop", "strand", F.col("value").cast("long").alias("n"))


ESTIMATE = "block_id string, sample string, subject string, cell_type string, condition string, umis double, proportions array<double>, covariance array<array<double>>, converged boolean, reliable boolean"


def read_estimates(spark: SparkSession, path: str, schema: str = ESTIMATE) -> DataFrame:
    """Estimates of a JSON-lines file that converged and are reliable."""
    return spark.read.schema(schema).json(path).where("converged AND reliable")


def read_shards(spark: SparkSession, paths, keys: list[str]) -> DataFrame:
    """Rows of tab shards with headers; blank files add none, and of a key the row of the last shard by name stays."""
    rows = spark.read.csv(paths, sep="\t", header=True, enforceSchema=False).withColumn("__file", F.input_file_name())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__file")))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r", "__file")


def last_of_shards(rows: DataFrame, keys: list[str], shard: str, ties=()) -> DataFrame:
    """Of a key the row of the last shard."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(shard), *ties))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def normalize_manifest(report: DataFrame, paired: bool = True) -> DataFrame:
    """Rows (run, read, url, md5, bytes): the parallel ;-joined lists of a sequencing report, one row per file; a run without two reads is an error."""
    lists = F.arrays_zip(F.split("fastq_ftp", ";").alias("url"), F.split("fastq_md5", ";").alias("md5"), F.split("fastq_bytes", ";").alias("bytes"))
    files = report.select(F.col("run_accession").alias("run"), F.explode(lists).alias("f")).select("run", F.regexp_extract("f.url", r"_([12])\.fastq", 1).alias("read"), "f.url", "f.md5", F.expr("try_cast(f.bytes AS BIGINT)").alias("bytes"))
    if paired:
        files = files.where("read <> ''")
        bad = files.groupBy("run").agg(F.countDistinct("read").alias("r"), F.count("*").alias("n")).where("r <> 2 OR n <> 2")
        assert_none(bad, "a run has not one file of each read")
        assert_none(report.join(files, report["run_accession"] == files["run"], "left_anti"), "a run has no paired files")
    return files


def read_wide_counts(spark: SparkSession, path: str, lead: int = 4) -> DataFrame:
    """Rows (leading columns, sample, value) of a space-separated wide table."""
    return unpivot_counts(spark.read.csv(path, sep=" ", header=True), lead)


def unpivot_counts(wide: DataFrame, lead: int = 4) -> DataFrame:
    ids, samples = wide.columns[:lead], wide.columns[lead:]
    wide = wide.select(*ids, *[F.col(f"`{s}`").cast("double").alias(s) for s in samples])
    return wide.unpivot(ids, samples, "sample", "value")


def read_factors(spark: SparkSession, cells: str, transcripts: str) -> tuple[DataFrame, DataFrame]:
    """Factor tables (cell_id, right) and (tx_id, left) in Parquet; ids must be unique and all of one rank."""
    right, left = spark.read.parquet(cells), spark.read.parquet(transcripts)
    assert_unique(require_columns(right, ["cell_id", "right"]), "cell_id")
    assert_unique(require_columns(left, ["tx_id", "left"]), "tx_id")
    ranks = right.select(F.size("right").alias("k")).union(left.select(F.size("left"))).agg(F.countDistinct("k").alias("n")).where("n > 1")
    assert_none(ranks, "factors have several ranks")
    return right, left
