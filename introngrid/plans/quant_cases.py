"""Queries over quantification operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from introngrid.operators import annotation as A
from introngrid.operators import quant as Q
from introngrid.plans.adapters import view
from introngrid.plans.annotation_cases import BLOCKS, LIMITED

GENES = "genes AS (SELECT DISTINCT tx_id, gene_id FROM {tx_exon})"
#: Class members with their gene (every fourth class number shares one), positions, weights and halves of cells.
EC = """g AS (SELECT ec_id, tx_id, 'G' || CAST(floor(tx_id / 20) AS BIGINT) AS gene_id, row_number() OVER (PARTITION BY ec_id ORDER BY tx_id) - 1 AS pos, count(*) OVER (PARTITION BY ec_id) AS k FROM {ec_tx}),
eg AS (SELECT ec_id, min(gene_id) AS gene_id FROM g GROUP BY ec_id HAVING count(DISTINCT gene_id) = 1)"""
PROBS = """p AS (SELECT CASE WHEN cell_id % 2 = 0 THEN 'A' ELSE 'B' END AS cell_type, ec_id, pos, CAST((cell_id * 13 + ec_id * 7 + pos * 5) % 10 + 1 AS DOUBLE) / 10 AS prob FROM (
    SELECT cell_id, c.ec_id, pos FROM {cell_ec} c JOIN g ON g.ec_id = c.ec_id) x)"""


def quant(s, d):
    return view(s, d, "quant")


def genes(s, d):
    return A.tx_gene_map(view(s, d, "tx_exon"), check=False)


def cell_ec(s, d):
    return view(s, d, "cell_ec")


def members(s, d):
    return view(s, d, "ec_tx").withColumn("gene_id", F.concat(F.lit("G"), F.floor(F.col("tx_id") / 20).cast("string")))


def tx_genes(s, d):
    return members(s, d).select("tx_id", "gene_id").distinct()


def placed(s, d):
    return view(s, d, "ec_tx").withColumn("pos", (F.row_number().over(Window.partitionBy("ec_id").orderBy("tx_id")) - 1).cast("long"))


def probabilities(s, d):
    joined = cell_ec(s, d).join(placed(s, d), "ec_id")
    prob = ((F.col("cell_id") * 13 + F.col("ec_id") * 7 + F.col("pos") * 5) % 10 + 1).cast("double") / 10
    return joined.select(F.when(F.col("cell_id") % 2 == 0, "A").otherwise("B").alias("cell_type"), "ec_id", "pos", prob.alias("prob"))


def support(s, d):
    return A.introns_from_exons(view(s, d, "tx_exon")).select("tx_id", F.col("intron").alias("feature"))


def r6(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def q01(s, d):
    return r6(Q.normalize_junction(quant(s, d)), "value")


def q02(s, d):
    return r6(Q.normalize_global(quant(s, d)), "value")


def q03(s, d):
    return r6(Q.normalize_local(quant(s, d), genes(s, d)), "value")


def q04(s, d):
    return r6(Q.count_features(Q.normalize_junction(quant(s, d)), support(s, d), 5.0), "value")


def q05(s, d):
    return Q.unmapped_transcripts(Q.normalize_junction(quant(s, d)), support(s, d))


def q06(s, d):
    values = Q.normalize_junction(quant(s, d)).withColumn("tx_id", F.concat("tx_id", F.lit(".2")))
    return r6(Q.project_counts(values, support(s, d), 20.0), "value")


def q07(s, d):
    return Q.clean_labels(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("label")), "label")


def q08(s, d):
    return Q.metacells(view(s, d, "cell_meta"), 5, order=(F.col("cell_id") * 7919) % 10007)


def q09(s, d):
    return Q.bootstrap_groups(view(s, d, "cell_meta"), 10, 3, pick=F.col("round") * 7919 + F.col("draw") * 104729 + F.expr("CAST(substr(cell_type, 2) AS INT)") * 31)


def _grouped(s, d):
    return view(s, d, "cell_meta").select("cell_id", F.concat_ws("_", "subject", "cell_type").alias("grp"))


def q10(s, d):
    return Q.check_barcodes(_grouped(s, d), cell_ec(s, d).where("cell_id % 3 > 0"))


def q10_lost(s, d):
    return Q.eliminated_barcodes(_grouped(s, d), cell_ec(s, d).where("cell_id % 3 > 0"))


def q11(s, d):
    return Q.aggregate_groups(cell_ec(s, d), _grouped(s, d).union(_grouped(s, d)))


def _halves(s, d):
    cells = view(s, d, "cell_meta").select("cell_id")
    return cells.where("cell_id % 2 = 0").select("cell_id", F.col("cell_id").alias("first"), (F.col("cell_id") + 1).alias("second"))


def _totals(s, d):
    return cell_ec(s, d).groupBy(F.col("cell_id").alias("half")).agg(F.sum("n").alias("umis"))


def q12(s, d):
    pairs = _halves(s, d).select("cell_id", F.explode(F.array("first", "second")).alias("half"))
    return Q.eligible_groups(_grouped(s, d), _totals(s, d).withColumnRenamed("half", "cell_id"), pairs, 2, 60)


def q13(s, d):
    return Q.filter_support(cell_ec(s, d), view(s, d, "ec_tx"), 100, 500)


def _lengths(s, d):
    return view(s, d, "ec_tx").select("tx_id").distinct().withColumn("length", (F.lit(250) + F.col("tx_id") * 5).cast("double"))


def q14(s, d):
    return Q.feature_weights(_lengths(s, d)).withColumn("w", F.round("w", 9))


def _samples(s, d):
    return cell_ec(s, d).groupBy((F.col("cell_id") % 3).alias("sample"), "ec_id").agg(F.sum("n").alias("n"))


def q15(s, d):
    return r6(Q.em_abundance(_samples(s, d), view(s, d, "ec_tx"), Q.feature_weights(_lengths(s, d)), iterations=3), "alpha")


def q16(s, d):
    alpha = _lengths(s, d).crossJoin(s.range(2).select(F.col("id").alias("sample"))).select("sample", "tx_id", ((F.col("tx_id") * 3 + F.col("sample") + 1).cast("double") / 1000).alias("alpha"))
    return r6(Q.abundance_to_counts(alpha, _samples(s, d).groupBy("sample").agg(F.sum("n").alias("total")), _lengths(s, d), "junction"), "tpm", "count")


def q17(s, d):
    values = quant(s, d).select("sample", F.when(F.col("effective_length") % 5 == 0, F.concat("tx_id", F.lit("-I"))).otherwise(F.col("tx_id")).alias("tx_id"), (F.col("num_reads") / 100).alias("count"))
    return Q.drop_small(values, least=0.5)


def _usage(s, d):
    return _lengths(s, d).select("tx_id", ((F.col("tx_id") % 9 + 1).cast("double") / 10).alias("u"))


def q18(s, d):
    return Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d), _lengths(s, d)).withColumn("a", F.round("a", 9))


def q19(s, d):
    return r6(Q.normalize_columns(Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d), _lengths(s, d)).withColumn("a", F.col("a") * (F.col("ec_id") + 1))), "a")


def q20(s, d):
    return r6(Q.normalize_rows(cell_ec(s, d)), "n")


def q21(s, d):
    return r6(Q.ec_design_weighted(placed(s, d), probabilities(s, d)), "a")


def q22(s, d):
    return r6(Q.ec_design_grouped(placed(s, d), probabilities(s, d)), "a")


def q23(s, d):
    keys = view(s, d, "ec_tx").groupBy("ec_id").agg(Q.key_of("tx_id").alias("key")).where("ec_id % 3 = 0")
    rich = keys.join(view(s, d, "ec_tx"), "ec_id").crossJoin(s.range(2).select(F.col("id").alias("run")))
    rich = rich.select("run", "key", "tx_id", ((F.col("tx_id") % 4 + 1 + F.col("run")).cast("double") / 10).alias("weight"), (F.col("run") * 2 + 1).alias("count"))
    return r6(Q.ec_design_positional(view(s, d, "ec_tx"), rich, _lengths(s, d)), "a")


def q24(s, d):
    return r6(Q.effective_lengths(quant(s, d).select("tx_id", F.col("num_reads").alias("reads"), "effective_length")), "length")


def q25(s, d):
    return Q.ec_gene(view(s, d, "ec_tx"), tx_genes(s, d))


def q26(s, d):
    return Q.gene_counts(cell_ec(s, d), q25(s, d))


def q27(s, d):
    return Q.modeled_gene_umis(cell_ec(s, d), q25(s, d), members(s, d).where("tx_id % 4 = 0").select("ec_id", "gene_id"))


def q28(s, d):
    barcodes = view(s, d, "cell_meta").select(F.concat(F.lit("CELL"), F.lpad(F.col("cell_id").cast("string"), 6, "0")).alias("cell_id"))
    rt = s.range(10).select(F.lpad((F.col("id") * 2).cast("string"), 2, "0").alias("first"), F.lpad((F.col("id") * 2 + 1).cast("string"), 2, "0").alias("second"))
    return Q.primer_pairs(barcodes, rt)


def q29(s, d):
    return Q.validate_pairs(_halves(s, d).union(_halves(s, d)))


def q30(s, d):
    return Q.complete_pairs(_halves(s, d), _totals(s, d), 40)


def _response(s, d):
    return cell_ec(s, d).select("cell_id", (F.col("ec_id") % 2).alias("primer"), F.col("ec_id").alias("col"), "n")


def q31(s, d):
    return r6(Q.paired_response(_response(s, d)), "value")


def q32(s, d):
    out = Q.paired_response_gene_aux(_response(s, d).withColumn("primer", F.col("primer").cast("string")), q26(s, d), 4.0)
    return r6(out, "value")


def q33(s, d):
    return Q.sample_cells(_totals(s, d).select(F.col("half").alias("cell_id"), F.col("umis").alias("n")), 50)


def q33_subsample(s, d):
    return Q.sample_cells(_totals(s, d).select(F.col("half").alias("cell_id"), F.col("umis").alias("n")), 10, n=25, order=F.col("cell_id") * 7919 % 1009)


def q34(s, d):
    """What the folds add back to."""
    return Q.count_folds(cell_ec(s, d), 3).groupBy("cell_id", "ec_id").agg(F.sum("n").alias("n"))


def q35(s, d):
    run = (F.col("cell_id") % 2).cast("string")
    counts = cell_ec(s, d).withColumn("run", run)
    membership = view(s, d, "ec_tx").crossJoin(s.range(2).select(F.col("id").cast("string").alias("run")))
    return Q.merge_runs(counts, membership)


def q36(s, d):
    return Q.validate_quantification(cell_ec(s, d), _halves(s, d), 40)


def _two_runs(s, d):
    """Run b lists its transcripts from the last, run a from the first and without every fifth: classes and probabilities must be put in one order."""
    runs = s.range(2).select(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") + 1).cast("int")).alias("run"), F.col("id").alias("ord"))
    tx = view(s, d, "ec_tx").select("tx_id").distinct()
    order = lambda t, run, by: A.dense_ids(t.select(by.alias("k")), "k", "idx").select(F.lit(run).alias("run"), "idx", F.concat(F.lit("t"), F.abs("k").cast("string")).alias("feature"), F.abs("k").alias("tx_id"))
    features = order(tx.where("tx_id % 5 > 0"), "a", F.col("tx_id")).unionByName(order(tx, "b", -F.col("tx_id")))
    inside = Window.partitionBy("run", "ec_id").orderBy("idx")
    members = view(s, d, "ec_tx").join(features, "tx_id").withColumn("pos", F.row_number().over(inside) - 1)
    whole = members.withColumn("size", F.count("*").over(Window.partitionBy("run", "ec_id")))
    at = F.when(F.col("cell_id") % 2 == 0, "a").otherwise("b")
    ec = cell_ec(s, d).withColumn("run", at)
    cells = ec.select("run", F.col("cell_id").alias("idx"), F.concat(F.lit("c"), F.col("cell_id").cast("string")).alias("barcode")).distinct()
    counts = ec.join(members.select("run", "ec_id").distinct(), ["run", "ec_id"]).select("run", F.col("cell_id").alias("cell"), "ec_id", "n")
    sized = whole.select("run", "ec_id", "size").distinct()
    probs = counts.join(sized, ["run", "ec_id"]).select("run", "cell", "ec_id", F.lit(0).alias("umi_rank"), F.transform(F.sequence(F.lit(0), (F.col("size") - 1).cast("int")), lambda i: ((F.col("cell") * 13 + F.col("ec_id") * 7 + i * 5) % 10 + 1) / 10.0).alias("probs"))
    return Q.merge_quantifications(runs, features.select("run", "idx", "feature"), members.select("run", "ec_id", "pos", "idx"), cells, counts, probs)


def q35_counts(s, d):
    out = _two_runs(s, d)
    return out.counts.join(out.cells, "cell").join(out.classes, "ec").select("cell", "name", "ec", "n", F.array_join("txs", ",").alias("txs"))


def q35_probabilities(s, d):
    return _two_runs(s, d).probabilities.select("cell", "ec", F.array_join(F.transform("probs", lambda p: F.round(p * 10).cast("int").cast("string")), ",").alias("tenths"))


def q35_features(s, d):
    return _two_runs(s, d).features


def q36_report(s, d):
    cells = cell_ec(s, d).select("cell_id").distinct()
    name = lambda c: F.when(F.col(c) % 3 > 0, F.concat_ws(":", F.concat(F.lit("r"), (F.col(c) % 3).cast("string")), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
    counts = cell_ec(s, d).withColumn("cell_id", name("cell_id"))
    members = view(s, d, "ec_tx")
    reference = view(s, d, "cell_meta").where("cell_id % 4 > 0").select(name("cell_id").alias("cell_id"))
    pairs = _halves(s, d).select(name("first").alias("first"), name("second").alias("second"))
    return Q.quantification_report(cells.select(name("cell_id").alias("cell_id")), members.select(F.col("tx_id").alias("feature")).distinct(), counts, members, reference, pairs, ["r1", "r2"], 40, 10)


def q37(s, d):
    runs = quant(s, d).groupBy("sample").agg(F.sum("num_reads").alias("mapped"), (F.sum("num_reads") + F.sum("tpm")).alias("processed"))
    return r6(Q.summarize_runs(runs), "min_rate", "max_rate")


def _sequence(name, mul):
    """A base-4 number as eight letters."""
    value = (F.col(name) * mul) % 65536
    parts = [F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.floor(value / 4**i) % 4 + 1).cast("int")) for i in range(8)]
    return F.concat(*parts)


def q38(s, d):
    """Barcodes near a primer list, from the digits of order keys."""
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    first = orders.select(F.col("o_orderkey").alias("name"), F.lit("x").alias("seq"))
    second = orders.select(F.col("o_orderkey").alias("name"), F.concat(F.lit("TT"), _sequence("o_orderkey", 7919)).alias("seq"))
    primers = s.range(400).select(F.col("id").alias("primer"), _sequence("id", 163).alias("barcode"))
    return Q.demultiplex_reads(first.distinct(), second.distinct(), primers, 2, 8)


def q39(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    rows = e.select(F.col("user_id").alias("barcode"), (F.col("event_id") % 16).alias("umi"), F.lit("chr1").alias("ref"), (F.col("event_id") % 5).alias("pos"), F.when(F.col("event_id") % 3 == 0, "50M").otherwise("20M100N30M").alias("cigar"), (F.col("event_id") % 4 > 0).alias("primary"), (F.col("event_id") % 6 + 1).alias("nh"))
    samples = view(s, d, "cell_meta").where("cell_id % 5 > 0").select(F.col("cell_id").alias("barcode"), F.concat_ws("__", "subject", "cell_type").alias("sample"))
    return Q.tag_spliced_alignments(rows.withColumn("nh", F.when(F.col("nh") > 1, F.col("nh") % 2 + 1).otherwise(F.col("nh"))), samples).select("barcode", "umi", "pos", "cigar", "sample")


def q40(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey").distinct()
    return Q.segment_whitelists(orders.select(F.concat(F.lit(" "), _sequence("o_orderkey", 1), _sequence("o_orderkey", 31), _sequence("o_orderkey", 101)).alias("barcode")))


def q41(s, d):
    a = Q.normalize_columns(Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d)))
    b = Q.ec_design_weighted(placed(s, d), probabilities(s, d)).where("ec_id < 35")
    return r6(Q.compare_sparse(a, b), "cosine", "frobenius", "mean_delta", "median_delta", "max_delta", "over_tenth")


def q42(s, d):
    b = view(s, d, "ec_tx").where("ec_id % 3 > 0").unionByName(view(s, d, "ec_tx").where("ec_id % 5 = 1").withColumn("ec_id", F.col("ec_id") + 100))
    return Q.ec_compatibility(view(s, d, "ec_tx"), b)


def q42_conflicts(s, d):
    """b repeats a third of the classes, half of these with the same weights, and lacks another third."""
    weight = (F.col("tx_id") % 7 + 1) / 8.0
    a = view(s, d, "ec_tx").withColumn("weight", F.when(F.col("ec_id") % 4 > 0, weight))
    again = a.where("ec_id % 3 = 1").withColumn("weight", F.when(F.col("ec_id") % 5 < 3, weight).otherwise(weight + F.when(F.col("tx_id") % 2 == 0, 0.25).otherwise(0.0))).withColumn("ec_id", F.col("ec_id") + 100)
    return Q.ec_weight_conflicts(view(s, d, "ec_tx"), a.where("ec_id % 3 > 0").unionByName(again))


def _theta(s, d):
    return _samples(s, d).select(F.col("sample").alias("grp"), "ec_id", "n"), _lengths(s, d).select("tx_id", ((F.col("tx_id") % 5 + 1).cast("double") / 50).alias("theta"))


def q43(s, d):
    totals, theta = _theta(s, d)
    theta = theta.crossJoin(totals.select("grp").distinct())
    design = Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d))
    return Q.fisher_information(design, theta, totals).withColumn("info", F.round("info", 8))


def q44(s, d):
    blocks = A.splice_blocks(view(s, d, "tx_exon")).select("tx_id", "block_id", F.col("path_index").alias("path"))
    return r6(Q.path_proportions(Q.normalize_junction(quant(s, d)), blocks), "p")


def q45(s, d):
    cells = view(s, d, "cell_meta").select("cell_id", F.col("cell_type").alias("grp"), F.array((F.col("cell_id") % 7 / 7.0).cast("double"), (F.col("cell_id") % 5 / 5.0).cast("double")).alias("right"))
    left = lambda c: F.array((F.col(c) % 3).cast("double"), (F.col(c) % 4 / 2.0).cast("double"))
    gene = tx_genes(s, d).groupBy("gene_id").agg(F.min("tx_id").alias("t")).select("gene_id", left("t").alias("left"))
    tx = tx_genes(s, d).select("tx_id", "gene_id", left("tx_id").alias("left"))
    return r6(Q.decode_theta(cells, gene, tx, _totals(s, d).withColumnRenamed("half", "cell_id")), "theta")


def q46(s, d):
    paths = _lengths(s, d).where("tx_id % 4 > 0").select("tx_id", F.concat(F.lit("p"), F.floor(F.col("tx_id") / 10).cast("string")).alias("path"))
    return r6(Q.collapse_to_paths(Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d)), paths, _usage(s, d).withColumnRenamed("u", "w")), "a")


def q47(s, d):
    return Q.overlap_report(cell_ec(s, d), view(s, d, "cell_meta").where("cell_id % 4 > 0"))


def q48(s, d):
    design = Q.ec_design_legacy(view(s, d, "ec_tx"), _usage(s, d)).where("tx_id % 6 > 0")
    return Q.gene_slices(_samples(s, d), design, q25(s, d))


SEQ = lambda name, mul: " || ".join(f"substr('ACGT', CAST(floor(({name} * {mul}) % 65536 / {4**i}) AS BIGINT) % 4 + 1, 1)" for i in range(8))
SAMPLES = "sm AS (SELECT cell_id % 3 AS sample, ec_id, CAST(sum(n) AS BIGINT) AS n FROM {cell_ec} GROUP BY ALL)"
LEN = "ln AS (SELECT DISTINCT tx_id, CAST(250 + tx_id * 5 AS DOUBLE) AS length, CAST(tx_id % 9 + 1 AS DOUBLE) / 10 AS u FROM {ec_tx})"
TOTALS = "ct AS (SELECT cell_id, CAST(sum(n) AS BIGINT) AS umis FROM {cell_ec} GROUP BY cell_id)"
PAIRS = "pr AS (SELECT cell_id, cell_id AS first, cell_id + 1 AS second FROM {cell_meta} WHERE cell_id % 2 = 0)"
GRP = "gr AS (SELECT cell_id, subject || '_' || cell_type AS grp FROM {cell_meta})"
JV = "v AS (SELECT sample, tx_id, CAST(num_reads AS DOUBLE) * 196 / effective_length AS value FROM {quant} WHERE tpm > 0)"
_EM = """e{i} AS (SELECT sample, tx_id, x / sum(x) OVER (PARTITION BY sample) AS alpha FROM (
    SELECT sample, tx_id, sum(x) AS x FROM (SELECT g.sample, d.tx_id, alpha * w / sum(alpha * w) OVER (PARTITION BY g.sample, g.ec_id) * n AS x
        FROM grid g JOIN dsg d USING (ec_id) JOIN e{j} e ON e.sample = g.sample AND e.tx_id = d.tx_id) y GROUP BY sample, tx_id) z)"""
EM = f"""{SAMPLES}, {LEN}, dsg AS (SELECT ec_id, tx_id, CASE WHEN length > 300 THEN 1 / (length - 300) ELSE 1 / length END AS w FROM {{ec_tx}} JOIN ln USING (tx_id)),
    grid AS (SELECT s.sample, e.ec_id, coalesce(sm.n, 0) + 1e-7 AS n FROM (SELECT DISTINCT ec_id FROM dsg) e CROSS JOIN (SELECT DISTINCT sample FROM sm) s LEFT JOIN sm ON sm.sample = s.sample AND sm.ec_id = e.ec_id),
    e0 AS (SELECT s.sample, ln.tx_id, 1.0 / (SELECT count(*) FROM ln) AS alpha FROM ln CROSS JOIN (SELECT DISTINCT sample FROM sm) s), {_EM.format(i=1, j=0)}, {_EM.format(i=2, j=1)}, {_EM.format(i=3, j=2)}"""

#: Both runs' transcripts, classes and cells in one numbering, in order of first appearance.
MERGED = """f AS (SELECT 0 AS ord, tx_id, row_number() OVER (ORDER BY tx_id) - 1 AS idx FROM (SELECT DISTINCT tx_id FROM {ec_tx} WHERE tx_id % 5 > 0) x UNION ALL SELECT 1, tx_id, row_number() OVER (ORDER BY tx_id DESC) - 1 FROM (SELECT DISTINCT tx_id FROM {ec_tx}) x),
gf AS (SELECT tx_id, row_number() OVER (ORDER BY o, i) - 1 AS gid FROM (SELECT tx_id, min(ord) AS o, arg_min(idx, ord) AS i FROM f GROUP BY tx_id) x),
mb AS (SELECT ord, ec_id, gid, row_number() OVER (PARTITION BY ord, ec_id ORDER BY idx) - 1 AS pos FROM {ec_tx} JOIN f USING (tx_id) JOIN gf USING (tx_id)),
cl AS (SELECT ord, ec_id, list(gid ORDER BY gid) AS key, list(pos ORDER BY gid) AS perm FROM mb GROUP BY ALL),
ge AS (SELECT key, row_number() OVER (ORDER BY o, e) - 1 AS ec FROM (SELECT key, min(ord) AS o, min(ec_id) FILTER (ord = lo) AS e FROM (SELECT *, min(ord) OVER (PARTITION BY key) AS lo FROM cl) x GROUP BY key) y),
cl2 AS (SELECT cl.*, ec FROM cl JOIN ge USING (key)),
ce AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id % 2, cell_id) - 1 AS cell, CASE WHEN cell_id % 2 = 0 THEN 'a' ELSE 'b' END || ':c' || cell_id AS name FROM (SELECT DISTINCT cell_id FROM {cell_ec}) x)"""
CASES = {
    "q01_normalize_junction": (q01, "SELECT sample, tx_id, round(CAST(num_reads AS DOUBLE) * 196 / effective_length, 6) AS value FROM {quant} WHERE tpm > 0"),
    "q02_normalize_global": (q02, "SELECT sample, tx_id, round(tpm * CAST(sum(num_reads) OVER (PARTITION BY sample) AS DOUBLE) / sum(tpm) OVER (PARTITION BY sample), 6) AS value FROM {quant}"),
    "q03_normalize_local": (q03, f"WITH {GENES} SELECT sample, tx_id, gene_id, round(coalesce(tpm / CAST(nullif(sum(tpm) OVER w, 0) AS DOUBLE) * sum(num_reads) OVER w, 0), 6) AS value FROM {{quant}} JOIN genes USING (tx_id) WINDOW w AS (PARTITION BY sample, gene_id)"),
    "q04_count_features": (q04, f"WITH {LIMITED}, {JV} SELECT intron AS feature, sample, round(sum(value), 6) AS value FROM v JOIN kept USING (tx_id) WHERE value > 5 GROUP BY ALL"),
    "q05_unmapped_transcripts": (q05, f"WITH {LIMITED} SELECT DISTINCT tx_id FROM {{quant}} WHERE tx_id NOT IN (SELECT tx_id FROM kept)"),
    "q06_project_counts": (q06, f"WITH {LIMITED}, {JV}, x AS (SELECT intron AS feature, sample, sum(value) AS value FROM v JOIN (SELECT DISTINCT tx_id, intron FROM kept) k USING (tx_id) GROUP BY ALL) SELECT feature, sample, round(value, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY feature) AS t FROM x) y WHERE t > 20"),
    "q07_clean_labels": (q07, "SELECT p_partkey, replace(p_name, ' ', '_') AS label FROM part"),
    "q08_metacells": (q08, "SELECT cell_id, cell_type, cell_type || '_' || b AS metacell FROM (SELECT cell_id, cell_type, CAST(floor((row_number() OVER (PARTITION BY cell_type ORDER BY cell_id * 7919 % 10007, cell_id) - 1) / 5) AS BIGINT) AS b, count(*) OVER (PARTITION BY cell_type) AS n FROM {cell_meta}) x WHERE b < floor(n / 5)"),
    "q09_bootstrap_groups": (q09, """WITH r AS (SELECT cell_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) - 1 AS i, count(*) OVER (PARTITION BY cell_type) AS n FROM {cell_meta}),
        d AS (SELECT cell_type, n, round, draw FROM (SELECT DISTINCT cell_type, n FROM r WHERE n >= 10) g CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INT) AS round) x CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INT) AS draw) y)
        SELECT cell_type, round, draw, cell_id FROM d JOIN r USING (cell_type) WHERE i = (round * 7919 + draw * 104729 + CAST(substr(cell_type, 2) AS INT) * 31) % d.n"""),
    "q10_check_barcodes": (q10, f"WITH {GRP} SELECT grp, count(k) AS n_valid, count(*) - count(k) AS n_lost FROM gr LEFT JOIN (SELECT DISTINCT cell_id, 1 AS k FROM {{cell_ec}} WHERE cell_id % 3 > 0) c USING (cell_id) GROUP BY grp"),
    "q10_eliminated_barcodes": (q10_lost, "SELECT DISTINCT cell_id FROM {cell_meta} WHERE cell_id % 3 = 0"),
    "q11_aggregate_groups": (q11, f"WITH {GRP} SELECT grp, ec_id, CAST(sum(n) AS BIGINT) AS n FROM {{cell_ec}} JOIN gr USING (cell_id) GROUP BY ALL"),
    "q12_eligible_groups": (q12, f"""WITH {GRP}, {TOTALS}, {PAIRS}, h AS (SELECT cell_id, first AS half FROM pr UNION ALL SELECT cell_id, second FROM pr),
        c AS (SELECT h.cell_id, sum(umis) AS umis FROM h JOIN ct ON ct.cell_id = half GROUP BY h.cell_id) SELECT grp, count(*) AS cells, CAST(sum(umis) AS BIGINT) AS umis FROM gr JOIN c USING (cell_id) GROUP BY grp HAVING count(*) >= 2 AND sum(umis) >= 60"""),
    "q13_filter_support": (q13, "WITH e AS (SELECT ec_id, sum(n) AS t FROM {cell_ec} GROUP BY ec_id HAVING sum(n) >= 100), k AS (SELECT ec_id, tx_id, t FROM {ec_tx} JOIN e USING (ec_id)) SELECT ec_id, tx_id FROM k WHERE tx_id IN (SELECT tx_id FROM k GROUP BY tx_id HAVING sum(t) > 500)"),
    "q14_feature_weights": (q14, f"WITH {LEN} SELECT tx_id, round(CASE WHEN length > 300 THEN 1 / (length - 300) ELSE 1 / length END, 9) AS w FROM ln"),
    "q15_em_abundance": (q15, f"WITH {EM} SELECT sample, tx_id, round(alpha, 6) AS alpha FROM e3"),
    "q16_abundance_to_counts": (q16, f"""WITH {SAMPLES}, {LEN}, a AS (SELECT s AS sample, tx_id, length, CAST(tx_id * 3 + s + 1 AS DOUBLE) / 1000 AS alpha FROM ln CROSS JOIN (SELECT unnest([0, 1]) AS s) q),
        t AS (SELECT sample, sum(n) AS total FROM sm GROUP BY sample) SELECT CAST(a.sample AS BIGINT) AS sample, tx_id, round(alpha / sum(alpha) OVER w * 1e6, 6) AS tpm, round(alpha / sum(alpha) OVER w * total * 98 / length, 6) AS count FROM a JOIN t USING (sample) WINDOW w AS (PARTITION BY a.sample)"""),
    "q17_drop_small": (q17, "SELECT sample, tx_id, num_reads / 100 AS count FROM {quant} WHERE effective_length % 5 <> 0 AND num_reads / 100 >= 0.5"),
    "q18_ec_design_legacy": (q18, f"WITH {LEN} SELECT ec_id, tx_id, round(u / length, 9) AS a FROM {{ec_tx}} JOIN ln USING (tx_id)"),
    "q19_normalize_columns": (q19, f"WITH {LEN} SELECT ec_id, tx_id, round(u / length * (ec_id + 1) / sum(u / length * (ec_id + 1)) OVER (PARTITION BY tx_id), 6) AS a FROM {{ec_tx}} JOIN ln USING (tx_id)"),
    "q20_normalize_rows": (q20, "SELECT cell_id, ec_id, round(n / CAST(sum(n) OVER (PARTITION BY cell_id) AS DOUBLE), 6) AS n FROM {cell_ec}"),
    "q21_ec_design_weighted": (q21, f"WITH {EC}, {PROBS}, m AS (SELECT ec_id, pos, avg(prob) AS p FROM p GROUP BY ALL), x AS (SELECT ec_id, tx_id, coalesce(m.p, 1.0 / k) AS a FROM g LEFT JOIN m USING (ec_id, pos)) SELECT ec_id, tx_id, round(a / sum(a) OVER (PARTITION BY tx_id), 6) AS a FROM x"),
    "q22_ec_design_grouped": (q22, f"""WITH {EC}, {PROBS}, m AS (SELECT cell_type, ec_id, pos, avg(prob) AS p FROM p GROUP BY ALL UNION ALL SELECT NULL, ec_id, pos, avg(prob) FROM p GROUP BY ALL),
        x AS (SELECT t.ct AS cell_type, g.ec_id, tx_id, coalesce(m.p, 1.0 / k) AS a FROM g CROSS JOIN (SELECT 'A' AS ct UNION ALL SELECT 'B' UNION ALL SELECT NULL) t LEFT JOIN m ON m.ec_id = g.ec_id AND m.pos = g.pos AND m.cell_type IS NOT DISTINCT FROM t.ct)
        SELECT cell_type, ec_id, tx_id, round(a / sum(a) OVER (PARTITION BY cell_type, tx_id), 6) AS a FROM x"""),
    "q23_ec_design_positional": (q23, f"""WITH {LEN}, ky AS (SELECT ec_id, string_agg(CAST(tx_id AS VARCHAR), ',' ORDER BY tx_id) AS k FROM {{ec_tx}} GROUP BY ec_id),
        r AS (SELECT k, tx_id, CAST(tx_id % 4 + 1 + run AS DOUBLE) / 10 AS w, run * 2 + 1 AS c FROM ky JOIN {{ec_tx}} USING (ec_id) CROSS JOIN (SELECT unnest([0, 1]) AS run) q WHERE ec_id % 3 = 0),
        m AS (SELECT k, tx_id, sum(w * c) / sum(c) AS w FROM r GROUP BY ALL),
        x AS (SELECT ec_id, t.tx_id, coalesce(m.w, 1 / length) AS a, m.w IS NOT NULL AS matched FROM {{ec_tx}} t JOIN ky USING (ec_id) JOIN ln ON ln.tx_id = t.tx_id LEFT JOIN m ON m.k = ky.k AND m.tx_id = t.tx_id)
        SELECT ec_id, tx_id, round(a / sum(a) OVER (PARTITION BY tx_id), 6) AS a, matched FROM x"""),
    "q24_effective_lengths": (q24, "SELECT tx_id, round(greatest(sum(num_reads * effective_length) / CAST(nullif(sum(num_reads), 0) AS DOUBLE), 1), 6) AS length FROM {quant} GROUP BY tx_id"),
    "q25_ec_gene": (q25, f"WITH {EC} SELECT * FROM eg"),
    "q26_gene_counts": (q26, f"WITH {EC} SELECT cell_id, gene_id, CAST(sum(n) AS BIGINT) AS n FROM {{cell_ec}} JOIN eg USING (ec_id) GROUP BY ALL"),
    "q27_modeled_gene_umis": (q27, f"WITH {EC} SELECT cell_id, gene_id, CAST(sum(n) AS BIGINT) AS umis FROM {{cell_ec}} JOIN eg USING (ec_id) WHERE ec_id IN (SELECT ec_id FROM g WHERE tx_id % 4 = 0) GROUP BY ALL"),
    "q28_primer_pairs": (q28, "WITH b AS (SELECT 'CELL' || lpad(CAST(cell_id AS VARCHAR), 6, '0') AS c, cell_id FROM {cell_meta}) SELECT c AS cell_id, c AS first, substr(c, 1, 8) || lpad(CAST(cell_id % 100 + 1 AS VARCHAR), 2, '0') AS second FROM b WHERE cell_id % 100 < 20 AND cell_id % 2 = 0"),
    "q29_validate_pairs": (q29, f"WITH {PAIRS} SELECT * FROM pr"),
    "q30_complete_pairs": (q30, f"WITH {PAIRS}, {TOTALS} SELECT pr.cell_id, first, second, a.umis AS first_umis, b.umis AS second_umis FROM pr JOIN ct a ON a.cell_id = first JOIN ct b ON b.cell_id = second WHERE a.umis >= 40 AND b.umis >= 40"),
    "q31_paired_response": (q31, "SELECT cell_id, ec_id % 2 AS primer, ec_id AS col, n, round(0.5 * n / sum(n) OVER (PARTITION BY cell_id, ec_id % 2), 6) AS value FROM {cell_ec}"),
    "q32_paired_response_gene_aux": (q32, f"""WITH {EC}, gc AS (SELECT cell_id, gene_id, sum(n) AS n FROM {{cell_ec}} JOIN eg USING (ec_id) GROUP BY ALL)
        SELECT cell_id, CAST(ec_id % 2 AS VARCHAR) AS primer, CAST(ec_id AS VARCHAR) AS col, round(0.5 * n / sum(n) OVER (PARTITION BY cell_id, ec_id % 2), 6) AS value FROM {{cell_ec}}
        UNION ALL SELECT cell_id, 'gene', gene_id, round(1.0 * n / sum(n) OVER (PARTITION BY cell_id), 6) FROM gc"""),
    "q33_sample_cells": (q33, f"WITH {TOTALS} SELECT cell_id, umis AS n FROM ct WHERE umis >= 50"),
    "q33_sample_cells_subsample": (q33_subsample, f"WITH {TOTALS} SELECT cell_id, umis AS n FROM ct WHERE umis >= 10 ORDER BY cell_id * 7919 % 1009, cell_id LIMIT 25"),
    "q34_count_folds": (q34, "SELECT cell_id, ec_id, n FROM {cell_ec}"),
    "q35_merge_runs": (q35, "WITH ky AS (SELECT ec_id, string_agg(CAST(tx_id AS VARCHAR), ',' ORDER BY tx_id) AS ec FROM {ec_tx} GROUP BY ec_id) SELECT (cell_id % 2) || ':' || cell_id AS cell, ec, CAST(sum(n) AS BIGINT) AS n FROM {cell_ec} JOIN ky USING (ec_id) GROUP BY ALL"),
    "q36_validate_quantification": (q36, f"""WITH {PAIRS}, {TOTALS}, h AS (SELECT first AS half FROM pr UNION SELECT second FROM pr) SELECT count(DISTINCT cell_id) AS cells, count(DISTINCT ec_id) AS classes, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n < 0) AS negative,
        (SELECT count(*) FROM ct WHERE umis >= 40) AS eligible, (SELECT count(*) FROM ct WHERE cell_id IN (SELECT half FROM h)) AS overlap,
        (SELECT count(*) FROM pr JOIN ct a ON a.cell_id = first JOIN ct b ON b.cell_id = second WHERE a.umis >= 40 AND b.umis >= 40) AS complete FROM {{cell_ec}}"""),
    "q35_merged_features": (q35_features, f"WITH {MERGED} SELECT gid AS tx, 't' || tx_id AS feature FROM gf"),
    "q35_merged_counts": (q35_counts, f"WITH {MERGED} SELECT ce.cell, ce.name, cl2.ec, CAST(sum(n) AS BIGINT) AS n, array_to_string(key, ',') AS txs FROM {{cell_ec}} x JOIN ce USING (cell_id) JOIN cl2 ON cl2.ord = cell_id % 2 AND cl2.ec_id = x.ec_id GROUP BY ALL"),
    "q35_merged_probabilities": (q35_probabilities, f"WITH {MERGED} SELECT ce.cell, cl2.ec, array_to_string(list_transform(perm, lambda p: (cell_id * 13 + x.ec_id * 7 + p * 5) % 10 + 1), ',') AS tenths FROM {{cell_ec}} x JOIN ce USING (cell_id) JOIN cl2 ON cl2.ord = cell_id % 2 AND cl2.ec_id = x.ec_id"),
    "q36_quantification_report": (q36_report, f"""WITH {PAIRS}, {TOTALS}, k AS (SELECT DISTINCT cell_id FROM {{cell_ec}}) SELECT (SELECT count(*) FROM k) AS cells, (SELECT count(DISTINCT tx_id) FROM {{ec_tx}}) AS features, (SELECT count(DISTINCT ec_id) FROM {{ec_tx}}) AS classes, (SELECT count(*) FROM {{ec_tx}}) AS compatibilities,
        count(*) FILTER (n > 0) AS nonzeros, CAST(sum(n) AS DOUBLE) AS molecules, (SELECT count(*) FROM ct WHERE umis >= 40) AS eligible, (SELECT count(DISTINCT cell_id % 3) FROM k WHERE cell_id % 3 > 0) AS prefixes,
        (SELECT count(*) FROM {{cell_meta}} WHERE cell_id % 4 > 0 AND cell_id IN (SELECT cell_id FROM k)) AS overlap, (SELECT count(*) FROM pr) AS pairs, (SELECT count(*) FROM pr WHERE first IN (SELECT cell_id FROM k) AND second IN (SELECT cell_id FROM k)) AS complete FROM {{cell_ec}}"""),
    "q37_summarize_runs": (q37, "WITH r AS (SELECT sample, sum(num_reads) AS m, sum(num_reads) + sum(tpm) AS p FROM {quant} GROUP BY sample) SELECT count(*) AS runs, CAST(sum(p) AS BIGINT) AS processed, CAST(sum(m) AS BIGINT) AS mapped, round(min(m / CAST(p AS DOUBLE)), 6) AS min_rate, round(max(m / CAST(p AS DOUBLE)), 6) AS max_rate FROM r"),
    "q38_demultiplex_reads": (q38, f"""WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT {SEQ('k', 7919)} AS bc FROM o),
        p AS (SELECT i AS primer, {SEQ('i', 163)} AS b FROM (SELECT unnest(range(400)) AS i) q),
        nb AS (SELECT DISTINCT primer, substr(b, 1, j - 1) || x || substr(b, j + 1) AS bc FROM p CROSS JOIN (SELECT CAST(unnest(range(1, 9)) AS INT) AS j) q CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS x) w),
        u AS (SELECT bc, min(primer) AS near FROM nb GROUP BY bc HAVING count(*) = 1)
        SELECT coalesce(p.primer, near) AS primer, CASE WHEN p.primer IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'corrected' ELSE 'unknown' END AS how, count(*) AS n FROM r LEFT JOIN p ON p.b = r.bc LEFT JOIN u ON u.bc = r.bc GROUP BY ALL"""),
    "q39_tag_spliced_alignments": (q39, """SELECT DISTINCT user_id AS barcode, event_id % 16 AS umi, event_id % 5 AS pos, '20M100N30M' AS cigar, subject || '__' || cell_type AS sample FROM events JOIN {cell_meta} ON cell_id = user_id
        WHERE user_id % 5 > 0 AND event_id % 3 <> 0 AND event_id % 4 > 0 AND (event_id % 6 = 0 OR (event_id % 6 + 1) % 2 = 0)"""),
    "q40_segment_whitelists": (q40, f"WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT 0 AS segment, {SEQ('k', 1)} AS value FROM o UNION SELECT 1, {SEQ('k', 31)} FROM o UNION SELECT 2, {SEQ('k', 101)} FROM o"),
    "q41_compare_sparse": (q41, f"""WITH {EC}, {PROBS}, {LEN}, m AS (SELECT ec_id, pos, avg(prob) AS p FROM p GROUP BY ALL), x AS (SELECT ec_id, tx_id, coalesce(m.p, 1.0 / k) AS a FROM g LEFT JOIN m USING (ec_id, pos)),
        b AS (SELECT * FROM (SELECT ec_id, tx_id, a / sum(a) OVER (PARTITION BY tx_id) AS y FROM x) q WHERE ec_id < 35),
        a AS (SELECT ec_id, tx_id, u / sum(u) OVER (PARTITION BY tx_id) AS x FROM {{ec_tx}} JOIN ln USING (tx_id)),
        j AS (SELECT x IS NOT NULL AND y IS NOT NULL AS s, coalesce(x, 0) AS x, coalesce(y, 0) AS y, abs(coalesce(x, 0) - coalesce(y, 0)) AS d FROM a FULL JOIN b USING (ec_id, tx_id))
        SELECT count(*) FILTER (s) AS shared, count(*) AS either, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(sqrt(sum(d * d) / sum(x * x)), 6) AS frobenius, round(avg(d), 6) AS mean_delta,
               round(quantile_cont(d, 0.5), 6) AS median_delta, round(max(d), 6) AS max_delta, round(avg(CASE WHEN d > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS over_tenth FROM j"""),
    "q42_ec_compatibility": (q42, """WITH b AS (SELECT ec_id, tx_id FROM {ec_tx} WHERE ec_id % 3 > 0 UNION ALL SELECT ec_id + 100, tx_id FROM {ec_tx} WHERE ec_id % 5 = 1),
        ka AS (SELECT ec_id, list(tx_id ORDER BY tx_id) AS k FROM {ec_tx} GROUP BY ec_id), kb AS (SELECT ec_id, list(tx_id ORDER BY tx_id) AS k FROM b GROUP BY ec_id), c AS (SELECT k, count(*) AS c FROM kb GROUP BY k)
        SELECT CASE WHEN c IS NULL THEN 'missing' WHEN c = 1 THEN 'unique' ELSE 'ambiguous' END AS kind, count(*) AS n FROM ka LEFT JOIN c USING (k) GROUP BY 1"""),
    "q42_weight_conflicts": (q42_conflicts, """WITH a AS (SELECT ec_id, tx_id, CASE WHEN ec_id % 4 > 0 THEN (tx_id % 7 + 1) / 8.0 END AS w FROM {ec_tx}),
        b AS (SELECT * FROM a WHERE ec_id % 3 > 0 UNION ALL SELECT ec_id + 100, tx_id, (tx_id % 7 + 1) / 8.0 + CASE WHEN ec_id % 5 >= 3 AND tx_id % 2 = 0 THEN 0.25 ELSE 0 END FROM {ec_tx} WHERE ec_id % 3 = 1),
        k AS (SELECT ec_id, list(tx_id ORDER BY tx_id) AS k, list(w ORDER BY tx_id) FILTER (w IS NOT NULL) AS w FROM b GROUP BY ec_id),
        c AS (SELECT k, count(*) AS c, count(DISTINCT w) AS d FROM k GROUP BY k), o AS (SELECT ec_id, list(tx_id ORDER BY tx_id) AS k FROM {ec_tx} GROUP BY ec_id)
        SELECT ec_id, CASE WHEN c IS NULL THEN 'missing' WHEN d > 1 THEN 'conflicting' WHEN c = 1 THEN 'unique' ELSE 'repeated' END AS kind FROM o LEFT JOIN c USING (k)"""),
    "q43_fisher_information": (q43, f"""WITH {SAMPLES}, {LEN}, q AS (SELECT ec_id, tx_id, u * (CAST(tx_id % 5 + 1 AS DOUBLE) / 50) AS q FROM {{ec_tx}} JOIN ln USING (tx_id)),
        p AS (SELECT sample AS grp, ec_id, tx_id, n, q / sum(q) OVER (PARTITION BY sample, ec_id) AS p FROM sm JOIN q USING (ec_id)), t AS (SELECT sample AS grp, sum(n) AS t FROM sm GROUP BY sample),
        m AS (SELECT grp, tx_id, sum(n * p) / any_value(t) AS m FROM p JOIN t USING (grp) GROUP BY ALL),
        x AS (SELECT a.grp, a.tx_id AS tx_a, b.tx_id AS tx_b, sum(a.n * a.p * b.p) AS s FROM p a JOIN p b ON a.grp = b.grp AND a.ec_id = b.ec_id GROUP BY ALL)
        SELECT x.grp, tx_a, tx_b, round(s / t - a.m * b.m, 8) AS info FROM x JOIN t USING (grp) JOIN m a ON a.grp = x.grp AND a.tx_id = tx_a JOIN m b ON b.grp = x.grp AND b.tx_id = tx_b"""),
    "q44_path_proportions": (q44, f"WITH {BLOCKS}, {JV}, x AS (SELECT sample, block_id, path_index AS path, sum(value) AS m FROM v JOIN blocks USING (tx_id) GROUP BY ALL) SELECT sample, block_id, path, round(m / nullif(sum(m) OVER (PARTITION BY sample, block_id), 0), 6) AS p FROM x"),
    "q45_decode_theta": (q45, f"""WITH {EC}, {TOTALS}, tg AS (SELECT DISTINCT tx_id, gene_id FROM g), c AS (SELECT cell_id, cell_type AS grp, cell_id % 7 / 7.0 AS r1, cell_id % 5 / 5.0 AS r2 FROM {{cell_meta}}),
        ge AS (SELECT cell_id, grp, r1, r2, gene_id, exp(r1 * (t % 3) + r2 * (t % 4 / 2.0)) AS e FROM c CROSS JOIN (SELECT gene_id, min(tx_id) AS t FROM tg GROUP BY gene_id) q),
        gp AS (SELECT *, e / sum(e) OVER (PARTITION BY cell_id) AS pg FROM ge),
        te AS (SELECT cell_id, grp, pg, tx_id, gene_id, exp(r1 * (tx_id % 3) + r2 * (tx_id % 4 / 2.0)) AS x FROM gp JOIN tg USING (gene_id)),
        th AS (SELECT grp, tx_id, cell_id, pg * x / sum(x) OVER (PARTITION BY cell_id, gene_id) AS theta FROM te)
        SELECT grp, tx_id, round(sum(theta * umis) / sum(umis), 6) AS theta FROM th JOIN ct USING (cell_id) GROUP BY ALL"""),
    "q46_collapse_to_paths": (q46, f"""WITH {LEN}, p AS (SELECT tx_id, u, CASE WHEN tx_id % 4 > 0 THEN 'p' || CAST(floor(tx_id / 10) AS BIGINT) ELSE 'tx:' || tx_id END AS path FROM ln), t AS (SELECT path, sum(u) AS t FROM p GROUP BY path)
        SELECT ec_id, path, round(sum(u * u / t), 6) AS a FROM {{ec_tx}} JOIN p USING (tx_id) JOIN t USING (path) GROUP BY ALL"""),
    "q47_overlap_report": (q47, "SELECT count(DISTINCT cell_id) AS observed, count(DISTINCT ec_id) AS features, CAST(sum(n) AS BIGINT) AS umis, count(DISTINCT CASE WHEN n > 0 THEN cell_id END) AS with_umis, (SELECT count(*) FROM {cell_meta} WHERE cell_id % 4 > 0) AS expected, count(DISTINCT CASE WHEN cell_id % 4 > 0 THEN cell_id END) AS shared FROM {cell_ec}"),
    "q48_gene_slices": (q48, f"WITH {EC}, {SAMPLES}, {LEN} SELECT gene_id, sample, sm.ec_id, t.tx_id, u AS a, n FROM sm JOIN eg USING (ec_id) JOIN {{ec_tx}} t ON t.ec_id = sm.ec_id JOIN ln ON ln.tx_id = t.tx_id WHERE t.tx_id % 6 > 0"),
}
