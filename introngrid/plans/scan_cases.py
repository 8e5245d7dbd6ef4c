"""Queries over scans and sinks: each writes a table's rows in a file format and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from introngrid.operators import annotation as A
from introngrid.plans.adapters import view
from introngrid.plans.annotation_cases import LIMITED
from introngrid.sources import scans as SC
from introngrid.sources import sinks as SK
from introngrid.storage import gather, materialize, work_folder


def _path(s, name):
    return f"{work_folder(s)}/scan-{name}-{uuid.uuid4().hex}"


def _text(s, df, name):
    df.write.text(path := _path(s, name))
    return path


def _tab(*names):
    return F.concat_ws("\t", *[F.col(n).cast("string") if isinstance(n, str) else n for n in names]).alias("value")


def s01(s, d):
    f = view(s, d, "tx_exon")
    attrs = F.format_string('gene_id "%s"; transcript_id "%s"; exon_number %d;', F.col("gene_id"), F.col("tx_id"), F.col("exon_number"))
    path = _text(s, f.select(_tab("chrom", F.lit("x"), F.lit("exon"), (F.col("start") + 1).cast("string"), "stop", F.lit("."), "strand", F.lit("."), attrs)), "gtf")
    return SC.read_features(s, path).select("chrom", "start", "stop", "strand", "gene_id", "tx_id", "exon_number")


def s02(s, d):
    q = view(s, d, "quant")
    named = q.select(F.col("sample").alias("run"), F.col("tx_id").alias("Name"), (F.col("effective_length") + F.col("tpm") % 9).alias("Length"), F.col("effective_length").alias("EffectiveLength"), F.col("tpm").alias("TPM"), F.col("num_reads").alias("NumReads"))
    named.write.partitionBy("run").csv(path := _path(s, "quant"), sep="\t", header=True)
    return SC.read_quant(s, path, "/run=([^/]+)/")


def s03(s, d):
    lines = view(s, d, "ec_tx").groupBy("ec_id").agg(F.array_sort(F.collect_list("tx_id")).alias("t")).select(F.concat_ws(" ", F.transform("t", lambda x: x.cast("string")), F.col("ec_id").cast("string")).alias("value"))
    return SC.read_ec_membership(s, _text(s, lines, "ec"))


def s04(s, d):
    e = view(s, d, "cell_ec").select((F.col("cell_id") + 1).alias("r"), (F.col("ec_id") + 1).alias("c"), "n")
    rows = s.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), ("1000 40 1",)], "value string").coalesce(1).union(e.select(F.concat_ws(" ", *[F.col(x).cast("string") for x in ("r", "c", "n")]).alias("value")))
    return SC.read_matrix_market(s, _text(s, rows, "mtx"))


def s05(s, d):
    members = view(s, d, "ec_tx")
    sizes = members.groupBy("ec_id").agg(F.count("*").alias("k"))
    rows = view(s, d, "cell_ec").join(sizes, "ec_id").select("cell_id", "ec_id", F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("k")), lambda i: ((F.col("cell_id") + i) % 8 / 8).cast("string")), ",").alias("probs"))
    rows.write.csv(path := _path(s, "probs"), sep="\t", header=True, compression="gzip")
    return SC.read_ec_probabilities(s, path, members)


def s06(s, d):
    rows = view(s, d, "ec_tx").groupBy("ec_id").agg(F.array_sort(F.collect_list("tx_id")).alias("t"))
    text = lambda a: F.array_join(a, " ")
    lines = rows.select(F.concat_ws(" ", F.size("t").cast("string"), text(F.transform("t", lambda x: x.cast("string"))), text(F.transform("t", lambda x: ((x % 4 + 1) / 8).cast("string"))), (F.col("ec_id") + 1).cast("string")).alias("value"))
    names = s.range(40).select(F.concat(F.lit("tx"), F.col("id").cast("string")).alias("value"))
    head = s.createDataFrame([("40",), ("40",)], "value string").coalesce(1)
    return SC.read_weighted_ec(s, _text(s, head.union(names).union(lines), "rich")).select("key", "tx_id", F.round("weight", 6).alias("weight"), "count")


def s07(s, d):
    rows = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" x\n"), F.expr("repeat('ACGT', cast(p_partkey % 50 + 1 AS INT))"), F.lit("\nAC")).alias("value"))
    return SC.read_fasta_lengths(s, _text(s, rows, "fasta"))


def s08(s, d):
    j = A.introns_from_exons(view(s, d, "tx_exon")).select(F.struct("chrom", "start", "stop", "strand").alias("j")).distinct()
    lines = j.orderBy("j").select("j.*").select(_tab("chrom", "start", "stop", F.when(F.col("strand") == "+", "1").otherwise("2")))
    features = _text(s, lines, "features")
    barcodes = _text(s, s.range(10).select(F.concat(F.lit("BC"), F.col("id").cast("string")).alias("value")), "barcodes")
    i = F.col("i")
    n = A.dense_ids(j, "j", "i").select((i + 1).alias("r"), (i % 10 + 1).alias("c"), (i % 7 + 1).alias("n"))
    head = s.createDataFrame([("% junctions",), ("1 1 1",)], "value string").coalesce(1)
    matrix = _text(s, head.union(n.select(F.concat_ws(" ", *[F.col(x).cast("string") for x in ("r", "c", "n")]).alias("value"))), "jmtx")
    return SC.read_junction_matrix(s, matrix, barcodes, features)


def s09(s, d):
    p = view(s, d, "pvals").select(F.col("k3").cast("string").alias("block_id"), "method", F.col("k1").cast("string").alias("sample"), F.array("p_value").alias("proportions"), "converged", (F.col("k1") % 3 > 0).alias("reliable"))
    p.write.json(path := _path(s, "json"), compression="gzip")
    return SC.read_estimates(s, path).select("block_id", "sample", F.round(F.col("proportions")[0], 6).alias("p"))


def s10(s, d):
    rows = view(s, d, "pvals").groupBy(F.col("k3").alias("key"), (F.col("k1") % 6).alias("part")).agg(F.count("*").alias("n"), F.min("k1").alias("least"))
    rows.withColumn("shard", F.col("part")).write.partitionBy("shard").csv(path := _path(s, "shards"), sep="\t", header=True)
    return SC.read_shards(s, path, ["key"]).select(*[F.col(c).cast("long").alias(c) for c in ("key", "part", "n", "least")])


def s10_last(s, d):
    rows = view(s, d, "pvals").select(F.col("k3").alias("key"), (F.col("k1") % 6).alias("shard"), "k1", "k2", "k4")
    return SC.last_of_shards(rows, ["key"], "shard", ["k1", "k2", "k4"])


def s11(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey").distinct()
    url = lambda r: F.concat(F.lit("ftp/R"), F.col("o_orderkey").cast("string"), F.lit(f"_{r}.fastq.gz"))
    both = lambda a, b: F.concat_ws(";", a, b)
    report = o.select(F.col("o_orderkey").cast("string").alias("run_accession"), both(url(1), url(2)).alias("fastq_ftp"), both(F.lit("a"), F.lit("b")).alias("fastq_md5"), both((F.col("o_orderkey") * 2).cast("string"), (F.col("o_orderkey") * 3).cast("string")).alias("fastq_bytes"))
    return SC.normalize_manifest(report)


def s12(s, d):
    q = view(s, d, "quant").select(F.expr("substr(tx_id, 1, 4)").alias("name"), "sample", F.col("num_reads").alias("value"))
    wide = SK.wide_counts(q, ["name"], ["AF", "NF", "NO", "RF"])
    return wide


def s13(s, d):
    q = s12(s, d)
    SK.write_wide_counts(SC.unpivot_counts(q, 1), path := _path(s, "wide"), ["name"], ["AF", "NF", "NO", "RF"])
    return SC.read_wide_counts(s, path, 1)


def _bundle(s, d):
    introns = A.introns_from_exons(view(s, d, "tx_exon")).select("tx_id", F.col("intron").alias("junction_id"), "chrom", "start", "stop", "strand")
    met = gather(view(s, d, "quant").join(introns.select("tx_id", "junction_id"), "tx_id").select("sample", "junction_id", "num_reads"), "junction_id")
    counts = materialize(met.groupBy(F.col("sample").alias("sample_id"), "junction_id").agg(F.sum("num_reads").alias("value")), "bundle-counts")
    junctions = introns.groupBy("junction_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.min("stop").alias("stop"), F.min("strand").alias("strand"))
    return counts, junctions, counts.select("sample_id").distinct()


def s14(s, d):
    SK.write_bundle(path := _path(s, "bundle"), *_bundle(s, d))
    counts, junctions, samples = SK.read_bundle(s, path)
    return SK.bundle_totals(counts, junctions, samples, check=False)


def s15(s, d):
    introns = A.introns_from_exons(view(s, d, "tx_exon")).select("tx_id", "chrom", "start", "stop", "strand")
    counts = introns.join(view(s, d, "quant").select("tx_id", F.col("sample").alias("sample_id"), F.col("num_reads").alias("value")), "tx_id", "left")
    SK.write_counted_bed(counts, path := _path(s, "bed"))
    return s.read.text(path).select("sample_id", "value")


def s16(s, d):
    rows = view(s, d, "pvals").select("k1", "k2", "k3", "k4", "p_value")
    SK.write_sparse(rows, path := _path(s, "sparse"), "p_value", 0.5, "k1")
    return s.read.parquet(path).withColumn("p_value", F.round("p_value", 6))


def s17(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    e.select(F.col("vec_id").alias("cell_id"), F.col("x").alias("right")).write.parquet(a := _path(s, "right"))
    e.select(F.col("vec_id").alias("tx_id"), F.col("x").alias("left")).write.parquet(b := _path(s, "left"))
    right, left = SC.read_factors(s, a, b)
    return right.select("cell_id", F.size("right").alias("k")).unionByName(left.select((-F.col("tx_id") - 1).alias("cell_id"), F.size("left").alias("k")))


BUNDLE = LIMITED + ", bc AS (SELECT sample AS sample_id, intron AS junction_id, CAST(sum(num_reads) AS BIGINT) AS value FROM {quant} JOIN kept USING (tx_id) GROUP BY ALL), bj AS (SELECT intron AS junction_id, min(chrom) AS chrom, min(start) AS start, min(stop) AS stop, min(strand) AS strand FROM kept GROUP BY intron)"
WIDE = "w AS (SELECT substr(tx_id, 1, 4) AS name, CAST(coalesce(sum(num_reads) FILTER (sample = 'AF'), 0) AS BIGINT) AS AF, CAST(coalesce(sum(num_reads) FILTER (sample = 'NF'), 0) AS BIGINT) AS NF, CAST(coalesce(sum(num_reads) FILTER (sample = 'NO'), 0) AS BIGINT) AS NO, CAST(coalesce(sum(num_reads) FILTER (sample = 'RF'), 0) AS BIGINT) AS RF FROM {quant} GROUP BY 1)"

CASES = {
    "s01_read_features": (s01, "SELECT chrom, start, stop, strand, gene_id, tx_id, exon_number FROM {tx_exon}"),
    "s02_read_quant": (s02, "SELECT sample, tx_id, CAST(effective_length + tpm % 9 AS DOUBLE) AS length, CAST(effective_length AS DOUBLE) AS effective_length, CAST(tpm AS DOUBLE) AS tpm, CAST(num_reads AS DOUBLE) AS num_reads FROM {quant}"),
    "s03_read_ec_membership": (s03, "SELECT ec_id, row_number() OVER (PARTITION BY ec_id ORDER BY tx_id) - 1 AS pos, tx_id AS tx_index FROM {ec_tx}"),
    "s04_read_matrix_market": (s04, "SELECT cell_id AS row, ec_id AS col, CAST(n AS DOUBLE) AS value FROM {cell_ec}"),
    "s05_read_ec_probabilities": (s05, "SELECT CAST(cell_id AS VARCHAR) AS cell_id, c.ec_id, pos, (cell_id + pos + 1) % 8 / 8.0 AS prob FROM {cell_ec} c JOIN (SELECT ec_id, row_number() OVER (PARTITION BY ec_id ORDER BY tx_id) - 1 AS pos FROM {ec_tx}) m ON m.ec_id = c.ec_id"),
    "s06_read_weighted_ec": (s06, """WITH k AS (SELECT ec_id, string_agg('tx' || tx_id, ',' ORDER BY 'tx' || tx_id) AS key FROM {ec_tx} GROUP BY ec_id)
        SELECT key, 'tx' || tx_id AS tx_id, round(sum((tx_id % 4 + 1) / 8.0 * (ec_id + 1)) / sum(ec_id + 1), 6) AS weight, CAST(sum(ec_id + 1) AS DOUBLE) AS count FROM {ec_tx} JOIN k USING (ec_id) GROUP BY 1, 2"""),
    "s07_read_fasta_lengths": (s07, "SELECT 'p' || p_partkey AS name, (p_partkey % 50 + 1) * 4 + 2 AS length FROM part"),
    "s08_read_junction_matrix": (s08, f"""WITH {LIMITED}, j AS (SELECT *, row_number() OVER (ORDER BY chrom, start, stop, strand) - 1 AS i FROM (SELECT DISTINCT chrom, start, stop, strand FROM kept) x)
        SELECT 'BC' || (i % 10) AS barcode, chrom, start, stop, strand, i % 7 + 1 AS n FROM j"""),
    "s09_read_estimates": (s09, "SELECT CAST(k3 AS VARCHAR) AS block_id, CAST(k1 AS VARCHAR) AS sample, round(p_value, 6) AS p FROM {pvals} WHERE converged AND k1 % 3 > 0"),
    "s10_read_shards": (s10, "WITH x AS (SELECT k3 AS key, k1 % 6 AS part, count(*) AS n, min(k1) AS least FROM {pvals} GROUP BY ALL) SELECT key, max(part) AS part, arg_max(n, part) AS n, arg_max(least, part) AS least FROM x GROUP BY key"),
    "s10_last_of_shards": (s10_last, "SELECT key, shard, k1, k2, k4 FROM (SELECT k3 AS key, k1 % 6 AS shard, k1, k2, k4, row_number() OVER (PARTITION BY k3 ORDER BY k1 % 6 DESC, k1, k2, k4) AS r FROM {pvals}) x WHERE r = 1"),
    "s11_normalize_manifest": (s11, "WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT CAST(k AS VARCHAR) AS run, '1' AS read, 'ftp/R' || k || '_1.fastq.gz' AS url, 'a' AS md5, k * 2 AS bytes FROM o UNION ALL SELECT CAST(k AS VARCHAR), '2', 'ftp/R' || k || '_2.fastq.gz', 'b', k * 3 FROM o"),
    "s12_write_wide_counts": (s12, f"WITH {WIDE} SELECT * FROM w"),
    "s13_read_wide_counts": (s13, f"WITH {WIDE} SELECT name, 'AF' AS sample, CAST(AF AS DOUBLE) AS value FROM w UNION ALL SELECT name, 'NF', CAST(NF AS DOUBLE) FROM w UNION ALL SELECT name, 'NO', CAST(NO AS DOUBLE) FROM w UNION ALL SELECT name, 'RF', CAST(RF AS DOUBLE) FROM w"),
    "s14_bundle": (s14, f"WITH {BUNDLE} SELECT (SELECT count(*) FROM bj) AS n_junctions, (SELECT count(DISTINCT sample_id) FROM bc) AS n_samples, count(*) AS n_entries, CAST(sum(value) AS BIGINT) AS total FROM bc"),
    "s15_junction_bed": (s15, f"""WITH {BUNDLE} SELECT sample_id, chrom || chr(9) || (start - 1) || chr(9) || stop || chr(9) || junction_id || chr(9) || value || chr(9) || strand || chr(9) || (start - 1) || chr(9) || stop || chr(9) || '255,0,0' || chr(9) || '2' || chr(9) || '1,1' || chr(9) || '0,' || (stop - start) AS value FROM bc JOIN bj USING (junction_id)"""),
    "s16_write_sparse": (s16, "SELECT k1, k2, k3, k4, round(p_value, 6) AS p_value FROM {pvals} WHERE p_value >= 0.5"),
    "s17_read_factors": (s17, "SELECT vec_id AS cell_id, len(embedding) AS k FROM embeddings UNION ALL SELECT -vec_id - 1, len(embedding) FROM embeddings"),
}
