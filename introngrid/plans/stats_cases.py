"""Queries over p-value tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from introngrid.functions.windows import bh, simes
from introngrid.operators import annotation as A
from introngrid.operators import stats as S
from introngrid.plans.adapters import view
from introngrid.plans.annotation_cases import EQUIV
from introngrid.storage import materialize

K = ["k1", "k2", "k3", "k4"]
BH = """{name} AS (SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1, min(q) OVER (PARTITION BY {part}, {p} IS NULL ORDER BY {p} DESC, {desc} ROWS UNBOUNDED PRECEDING)) END AS fdr FROM (
    SELECT *, {p} * count({p}) OVER (PARTITION BY {part}, {p} IS NULL) / row_number() OVER (PARTITION BY {part}, {p} IS NULL ORDER BY {p}, {ties}) AS q FROM {src}) _b)"""


def fdr(name, src, p="p_value", part="method", ties="k1, k2, k3, k4"):
    return BH.format(name=name, src=src, p=p, part=part, ties=ties, desc=", ".join(f"{t.strip()} DESC" for t in ties.split(",")))


def SIM(name, src, keys):
    return f"""{name} AS (SELECT {keys}, least(1, min(s)) AS p_value, count(*) AS n_features FROM (
        SELECT {keys}, p_value * count(*) OVER (PARTITION BY {keys}) / row_number() OVER (PARTITION BY {keys} ORDER BY p_value) AS s FROM {src} WHERE p_value IS NOT NULL) _s GROUP BY {keys})"""


BARE = "pv AS (SELECT * REPLACE (split_part(gene_id, '.', 1) AS gene_id), least(level_a, level_b) || '||' || greatest(level_a, level_b) AS pair_id FROM {pvals})"
GENES = f"{BARE}, {SIM('g', 'pv', 'method, gene_id')}"
FOLDS = f"fo AS (SELECT *, k1 % 2 AS fold FROM pv), {SIM('ff', 'fo', 'method, fold, gene_id')}"


def pv(s, d):
    return view(s, d, "pvals")


def nv(s, d):
    return view(s, d, "null_pvals")


def r(df, *names, n=6):
    for x in names:
        df = df.withColumn(x, F.round(x, n))
    return df


def p01(s, d):
    return r(bh(pv(s, d), "p_value", ["method"], K).select(*K, "fdr"), "fdr")


def p02(s, d):
    return r(S.bh_eligible(pv(s, d), ties=K).select(*K, "fdr"), "fdr")


def p03(s, d):
    return r(simes(pv(s, d), "p_value", ["method", "level_a"], wide=True), "p_value", n=9)


def p04(s, d):
    return r(S.gene_pvalues(pv(s, d)), "p_value", n=9)


def p05(s, d):
    return r(S.feature_pvalues(pv(s, d)), "p_value", n=9)


def p06(s, d):
    return r(S.gene_pair_pvalues(pv(s, d)), "p_value", n=9)


def p07(s, d):
    return r(S.simes_omnibus(pv(s, d), 0.3), "p_value", "fdr")


def p08(s, d):
    return r(pv(s, d).groupBy("method", "gene_id").agg(S.cauchy("p_value").alias("p_value")), "p_value")


def _blocks(s, d):
    return A.splice_blocks(view(s, d, "tx_exon"))


def _tests(s, blocks, mul):
    number = F.regexp_extract("block_id", r"g(\d+):B(\d+)$", 1).cast("long") * 10 + F.regexp_extract("block_id", r"B(\d+)$", 1).cast("long")
    rows = blocks.select("block_id").distinct().crossJoin(s.range(3).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("cell_type"), F.col("id").alias("t")))
    return rows.select("block_id", "cell_type", (((number * mul + F.col("t") * 37) % 9973 + 1).cast("double") / F.lit(9974.0)).alias("p_value"))


def p09(s, d):
    blocks = materialize(_blocks(s, d).select("gene_id", "block_id", "tx_id", "path_index"), "blocks")  # three tables come from it
    return r(S.joint_block_tests([_tests(s, blocks, 7919), _tests(s, blocks, 104729)], A.block_equivalence(blocks)), "p_value", "fdr")


def p10(s, d):
    rows = _tests(s, _blocks(s, d), 7919).withColumn("converged", F.col("p_value") > 0.01)
    return r(S.joint_gene_tests(rows), "p_value", "fdr")


def p11(s, d):
    out = S.calibrate_ecdf(pv(s, d), nv(s, d).where("method <> 'R'"))
    return r(out.select(*K, "calibrated"), "calibrated")


def _strata(df):
    return df.withColumn("stratum", F.col("k1") % 5)


def p12(s, d):
    rows = _strata(pv(s, d)).withColumn("test_id", F.col("k3"))
    return r(S.calibrate_pooled(rows, _strata(nv(s, d)), "p_value", ["method", "stratum"], "test_id").select(*K, "calibrated"), "calibrated")


def _by_depth(s, d, want):
    """Tests, one a part and method, with the depth and degrees of freedom of their lines; every fiftieth has degrees of its own."""
    own = F.when(F.col("test_id") % 50 == 0, F.col("test_id"))
    tests = pv(s, d).groupBy("method", F.col("k3").alias("test_id")).agg(F.min("p_value").alias("p_value"), F.sum("k2").cast("double").alias("depth"), F.max("k2").cast("long").alias("m"))
    nulls = nv(s, d).withColumn("df", F.coalesce(own, F.col("k2").cast("long") % 3)).select("method", "test_id", "p_value", "df")
    return S.calibrate_by_depth(tests.withColumn("df", F.coalesce(own, F.col("m") % 3)), nulls, 4, want=want)


def p12_depth(s, d):
    return r(_by_depth(s, d, (True, False))[0].select("method", "test_id", "calibration_bin", "stratum", "calibrated"), "calibrated")


def p12_null(s, d):
    rows = _by_depth(s, d, (False, True))[1]
    return r(rows.groupBy("method", "stratum").agg(F.count("*").alias("n"), F.avg("calibrated").alias("mean"), F.avg((F.col("calibrated") <= 0.05).cast("double")).alias("rejected")), "mean", "rejected")


def _runs(s, d, method):
    """One test a part: least p-value, a statistic, a flag."""
    rows = pv(s, d).where(F.col("method") == method).groupBy(F.col("k3").alias("test_id")).agg(F.min("p_value").alias("p_value"), F.max((F.col("k1") * 17 + F.col("k3")) % 1000 / 100).alias("statistic"), (F.count("*") % 7 > 0).alias("converged"))
    return S.bh_eligible(rows.withColumn("method", F.lit(method)), ties=["test_id"])


def p29_report(s, d):
    return r(S.coverage_report(_runs(s, d, "A"), _runs(s, d, "N"), 0.4), "p_value_spearman", "statistic_spearman")


def p29_overlap(s, d):
    rows = None
    for method in "ANR":
        part = _runs(s, d, method)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("method", "test_id", "fdr").crossJoin(s.range(2).select(F.when(F.col("id") == 0, "strict").otherwise("permissive").alias("coverage"), (F.col("id") + 1).alias("x")))
    return S.method_overlap(rows.withColumn("fdr", F.col("fdr") / F.col("x")), ("A", "N", "R"), 0.3)


def p32_paths(s, d):
    weights = F.array((F.col("k1") % 7 + 1).cast("double"), (F.col("k2") % 5 + 1).cast("double"), (F.col("k3") % 9 + 1).cast("double"))
    total = F.aggregate("w", F.lit(0.0), lambda t, x: t + x)
    x, y, z = (F.col("k1") % 17 + 1) / 40.0, (F.col("k4") % 5 - 2) / 100.0, (F.col("k3") % 13 + 1) / 40.0
    rows = pv(s, d).select(*K, weights.alias("w")).withColumn("t", total).select(*K, F.transform("w", lambda v: v / F.col("t")).alias("p"), F.array(x, y, y, z).alias("cov"), (F.col("k3") % 60 + 5).alias("umis"))
    out = S.effective_counts_ilr(rows)
    return r(out.select(*K, "size", F.col("counts")[0].alias("n1"), F.col("counts")[2].alias("n3")), "size", "n1", "n3")


def p32_two(s, d):
    rows = pv(s, d).select(*K, F.array("p_value", 1 - F.col("p_value")).alias("p"), F.array((F.col("k1") % 17 + 1) / 40).alias("cov"), (F.col("k3") % 60 + 5).alias("umis"))
    return r(S.effective_counts_ilr(rows).select(*K, "size", F.col("counts")[0].alias("n1"), F.col("counts")[1].alias("n2")), "size", "n1", "n2")


def _fits(s, d):
    """Observed, null and power fits by method and test."""
    fit = lambda t: t.withColumn("converged", F.col("k1") % 11 > 0)
    null = fit(nv(s, d))
    seen = null.groupBy("method", "test_id").agg((F.max("statistic") * 0.9).alias("statistic"), F.min("p_value").alias("p_value"), (F.count("*") % 6 > 0).alias("converged"))
    power = fit(pv(s, d)).select("method", F.col("k3").alias("test_id"), (F.col("k2") % 3).alias("effect_size"), ((F.col("k1") * 17 + F.col("k3")) % 1000 / 100).alias("statistic"), "p_value", "converged")
    return seen, null, power


def p37_observed(s, d):
    seen, null, _ = _fits(s, d)
    return S.observed_summary(seen, null, 0.2)


def p37_null(s, d):
    return r(S.null_fits(_fits(s, d)[1]), "rejected", "quantile_05")


def p37_power(s, d):
    _, null, power = _fits(s, d)
    return r(S.power_report(power, null, 0.2), "asymptotic_power", "calibrated_power")


def p13(s, d):
    rows = _strata(pv(s, d)).select("method", "stratum", F.col("k3").alias("test_id"), *K, ((F.col("k1") * 17 + F.col("k3")) % 1000 / 100).alias("statistic"))
    return r(S.calibrate_exceedance(rows, _strata(nv(s, d))).select(*K, "calibrated"), "calibrated")


def p14(s, d):
    return S.quantile_bins(pv(s, d), "p_value", 4).groupBy("method", "bin").agg(F.count("*").alias("n"))


def p15(s, d):
    rows = pv(s, d).withColumn("stratum", (F.col("k1") * F.col("k2")) % 13)
    return S.calibration_strata(rows, "stratum", "k3", 650).groupBy("method", "pooled").agg(F.count("*").alias("n"))


def _observed(s, d):
    return nv(s, d).groupBy("test_id").agg(F.max("statistic").alias("statistic"))


def p16(s, d):
    return r(S.permutation_pvalue(_observed(s, d).withColumn("statistic", F.col("statistic") * 0.8), nv(s, d)), "observed", "p_value")


def p17(s, d):
    null = nv(s, d).withColumn("depth_bin", F.col("k1") % 3)
    return r(S.gated_fdr(pv(s, d), null, 0.0475, 0.0545, ties=K).select(*K, "passed", "fdr"), "fdr")


def p18(s, d):
    rows = S.bh_eligible(pv(s, d), ties=K)
    out = S.merge_summary(rows, nv(s, d).withColumn("bin", F.col("k1") % 3))
    return r(out, "null_01", "null_05", "null_1", "bin_min", "bin_max")


def p19(s, d):
    rows = _observed(s, d).withColumn("statistic", F.col("statistic") * 0.9).withColumn("converged", F.col("test_id") % 5 > 0)
    return r(S.simulation_pvalues(rows, nv(s, d)).select("test_id", "p_value", "fdr"), "p_value", "fdr")


def _models(s, d, mul):
    rows = pv(s, d).groupBy(F.col("k3").alias("test_id")).agg(F.sum("k1").alias("z"))
    return rows.select("test_id", F.lit(40).alias("n_samples"), ((F.col("z") * mul) % 501 / 10).alias("null_objective"), ((F.col("z") * mul % 997 + 1) / 998).alias("p_value"), (F.col("z") % (mul % 7 + 3) > 0).alias("converged"), F.lit(mul % 3 + 1).alias("n_parameters"))


def p20(s, d):
    return r(S.select_hybrid(_models(s, d, 31), _models(s, d, 77)), "gain", "p_value", "fdr")


def p21(s, d):
    rows = pv(s, d).withColumn("p_text", F.when(F.col("k1") % 9 == 0, "NA").otherwise(F.col("p_value").cast("string")))
    out = S.normalize_pvalues(rows, {"gene_id": "gene_id", "feature_id": "k3", "p_value": "p_text", "a": "k1", "b": "k2", "c": "k4"}, "tool", ties=("feature_id", "a", "b", "c"))
    return r(out.select("a", "b", "c", "feature_id", "fdr", "significant"), "fdr")


def p22(s, d):
    rows = pv(s, d).select(*K, F.when(F.col("k1") % 2 == 0, F.col("p_value")).alias("pval"), F.when(F.col("k1") % 3 == 0, F.lit(0.5)).alias("p.value"))
    return S.adapt_comparator(rows, ["padj", "pval", "p.value"], ["k2", "k3"], order=K).select("feature_id", F.round("p_value", 9).alias("p_value"))


def p23(s, d):
    rows = pv(s, d).withColumn("contrast", F.concat_ws("_vs_", "level_a", "level_b")).drop("level_a", "level_b")
    return S.pairwise_tables(rows).select(*K, "level_a", "level_b")


def p24(s, d):
    rows = pv(s, d).withColumn("effect", F.when(F.col("k2") % 2 == 0, "condition").otherwise("cell_type")).withColumn("significant", F.col("p_value") < 0.05)
    return S.discovery_summary(rows, S.simes_omnibus(rows.where("effect = 'cell_type'"), 0.5))


def _folds(s, d):
    rows = pv(s, d).withColumn("gene_id", F.split("gene_id", r"\.")[0]).withColumn("fold", F.col("k1") % 2)
    return simes(rows, "p_value", ["method", "fold", "gene_id"], wide=True)


def p25(s, d):
    return r(S.reproducibility(_folds(s, d), 0.2), "replication", "spearman")


def p26(s, d):
    return r(S.topk_overlap(_folds(s, d), [5, 20, 500]), "overlap")


def p27(s, d):
    rows = pv(s, d).withColumn("fold", F.col("k1") % 2).where("k4 % 5 > 0 OR k2 < 5 OR method = 'A'")
    return r(S.pair_reproducibility(rows, 0.2), "replication", "spearman")


def p28(s, d):
    rows = S.gene_pvalues(pv(s, d)).withColumn("converged", F.conv(F.substring("gene_id", 2, 9), 10, 10).cast("int") % 9 > 0).withColumn("p_value", F.col("p_value") * 0.3)
    return r(S.compare_discoveries(rows, "A", 0.2), "jaccard")


def _two(s, d):
    rows = pv(s, d).groupBy(F.col("k3").alias("test_id")).agg(F.min("p_value").alias("p_value"), F.max("p_value").alias("q"), F.count("*").alias("n"))
    return rows.where("test_id % 3 > 0").select("test_id", "p_value"), rows.where("test_id % 4 > 0").select("test_id", (F.col("p_value") * 0.5 + F.col("q") * 0.01).alias("p_value"))


def p29(s, d):
    return r(S.compare_coverage(*_two(s, d)), "spearman")


def p30(s, d):
    a, b = _two(s, d)
    more = lambda t, m: t.withColumn("converged", F.col("test_id") % m > 0).withColumn("seconds", (F.col("test_id") % m + 1).cast("double"))
    return r(S.compare_runs(more(a, 7), more(b, 5)), "median_diff", "max_diff", "jaccard", "speedup")


def p31(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_partkey") % 40).alias("feature"), (F.col("l_suppkey") % 9).alias("subject"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_orderkey") % 2).alias("category")).agg(F.count("*").alias("n"))
    return r(S.paired_logratio(rows).select("feature", "n_subjects", "n_categories", "statistic", "p_value"), "statistic", "p_value")


def p31_hotelling(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_partkey") % 40).alias("feature"), (F.col("l_suppkey") % 9).alias("subject"), (F.col("l_linenumber") % 2).alias("side"), (F.col("l_orderkey") % 4).alias("category")).agg(F.count("*").alias("n"))
    return r(S.paired_logratio(rows), "statistic", "p_value")


def p32(s, d):
    rows = pv(s, d).select(*K, F.col("p_value").alias("p1"), (1 - F.col("p_value")).alias("p2"), ((F.col("k1") % 17 + 1) / 40).alias("v"), (F.col("k3") % 60 + 5).alias("umis"))
    return r(S.effective_counts(rows).select(*K, "size", "n1", "n2"), "size", "n1", "n2")


def p33(s, d):
    rows = view(s, d, "quant").select("sample", F.col("tx_id").alias("path"), (F.col("num_reads") * 7 % 64 / 16).alias("x"))
    return S.integerize(rows).select("sample", "path", "count")


def p34(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 50).alias("feature"), F.col("l_returnflag").alias("level"), (F.col("l_linenumber") % 3).alias("category"), F.lit(1).alias("n"))
    return r(S.multinomial_lrt(rows).select("feature", "statistic", "df", "p_value"), "statistic").drop("p_value")


def p35(s, d):
    rows = pv(s, d).select(F.col("k3").alias("feature"), F.col("method").alias("level"), F.col("p_value").alias("y"), ((F.col("k1") % 11 + 1) / 20).alias("v"))
    return r(S.weighted_wald(rows, 0.1).drop("p_value"), "statistic")


def p36(s, d):
    return r(S.null_summary(nv(s, d)), "rejected", "ks", "quantile_05")


def p37(s, d):
    rows = _observed(s, d).select("test_id", (F.col("statistic") * 0.95).alias("statistic"), F.lit("m").alias("method"), (F.col("test_id") % 3).alias("effect_size"))
    return r(S.power_summary(rows, nv(s, d), level=0.2), "power", "median_statistic")


def p38(s, d):
    shards = nv(s, d).groupBy("method", (F.col("k1") % 8).alias("shard")).agg(F.count("*").alias("n"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("rate"))
    return r(S.merge_shards_summary(shards), "rate")


def p39(s, d):
    rows = nv(s, d).withColumn("x", F.when(F.col("k1") % 7 == 0, F.lit(float("nan"))).when(F.col("k1") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("statistic")))
    return r(S.finite_summary(rows, "x", ["method"]), "mean", "median", "q10", "q90")


def _estimates(s, d, mul):
    rows = view(s, d, "cell_ec").join(view(s, d, "cell_meta"), "cell_id")
    return rows.where(f"cell_id % {mul} > 0").select(F.col("ec_id").alias("block_id"), F.col("cell_id").alias("sample"), "condition", "subject", (F.col("n") * mul).alias("value"))


def p40(s, d):
    return S.match_estimates(_estimates(s, d, 3), _estimates(s, d, 4), min_subjects=5).select("block_id", "sample", "value", "value_2")


def p41(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("campaign"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    elapsed = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "1-").otherwise(""), two(F.col("o_orderkey") % 24), F.lit(":"), two(F.col("o_orderkey") % 60), F.lit(":"), two(F.col("o_orderkey") * 7 % 60))
    memory = F.concat((F.col("o_orderkey") % 900).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "M").otherwise("K"))
    day = lambda k: F.concat(F.lit("2026-01-"), two(F.col("o_orderkey") % 20 + k), F.lit(" 00:00:00"))
    return r(S.resource_summary(o.select("campaign", elapsed.alias("elapsed"), memory.alias("memory"), day(1).alias("started"), day(5).alias("ended"))), "hours", "median_min", "p90_min", "peak_gib", "span_hours")


def p42(s, d):
    rows = pv(s, d).groupBy((F.col("k3") % 30).alias("run"), (F.col("k1") % 12).alias("strength")).agg(F.round(F.avg("p_value"), 9).alias("loss"), F.count("*").alias("n"))
    fits = rows.select("run", "strength", "loss", F.lit(0.05).alias("se"), (F.col("n") % 9).cast("double").alias("variance"), (F.col("n") % 6 > 0).alias("converged"), (F.col("n") % 7 == 0).alias("degenerate"))
    return S.select_candidate(fits, "one_se_variance", 0.8).select("run", "strength", "loss")


def p43(s, d):
    a = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("fit"), F.when(F.col("n_nationkey") % 4 == 0, "failed").otherwise("ok").alias("status"), F.col("n_name").alias("x"))
    b = s.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") + 100).cast("long").alias("fit"), F.lit("ok").alias("status"), F.col("r_name").alias("y"))
    return S.combine_scores([a, b])


def p44(s, d):
    rows = nv(s, d).select(F.lit("f").alias("family"), "method", (F.col("k1") % 3).alias("effect"), "statistic", F.col("p_value").alias("estimate"), (F.col("k2") % 4 > 0).alias("converged"))
    return r(S.replicate_summary(rows), "rejected", "bias", "rmse", "converged", "median_statistic")


RANK = "rank() OVER (PARTITION BY method ORDER BY {p}) + count(*) OVER (PARTITION BY method, {p}) / 2.0"
REPRO = f"""sh AS (SELECT gene_id FROM ff GROUP BY gene_id HAVING count(DISTINCT (method, fold)) = (SELECT count(DISTINCT (method, fold)) FROM ff)),
    w AS (SELECT method, gene_id, max(p_value) FILTER (fold = 0) AS p0, max(p_value) FILTER (fold = 1) AS p1, max(p_value) AS joint FROM ff WHERE gene_id IN (SELECT gene_id FROM sh) GROUP BY method, gene_id),
    {fdr('b0', 'w', 'p0', 'method', 'gene_id')}, {fdr('b1', 'w', 'p1', 'method', 'gene_id')}, {fdr('bj', 'w', 'joint', 'method', 'gene_id')},
    z AS (SELECT w.*, b0.fdr AS q0, b1.fdr AS q1, bj.fdr AS qj FROM w JOIN b0 USING (method, gene_id) JOIN b1 USING (method, gene_id) JOIN bj USING (method, gene_id)),
    zz AS (SELECT *, {RANK.format(p='p0')} AS r0, {RANK.format(p='p1')} AS r1 FROM z)
    SELECT method, count(*) AS genes, count(*) FILTER (q0 < 0.2) AS found_0, count(*) FILTER (q1 < 0.2) AS found_1, count(*) FILTER (qj < 0.2) AS conjunction,
           round(avg(CASE WHEN p1 < 0.2 THEN 1.0 ELSE 0.0 END) FILTER (q0 < 0.2), 6) AS replication, round(corr(r0, r1), 6) AS spearman FROM zz GROUP BY method"""
NUM = "CAST(regexp_extract(block_id, 'g([0-9]+):B', 1) AS BIGINT) * 10 + CAST(regexp_extract(block_id, 'B([0-9]+)$', 1) AS BIGINT)"
TESTS = lambda mul: f"SELECT block_id, 'T' || t AS cell_type, CAST((({NUM}) * {mul} + t * 37) % 9973 + 1 AS DOUBLE) / 9974 AS p_value FROM (SELECT DISTINCT block_id FROM blocks) b CROSS JOIN (SELECT unnest([0, 1, 2]) AS t) q"
CAUCHY = "0.5 - atan(avg(tan(pi() * (0.5 - least(greatest(p_value, 1e-15), 1 - 1e-15))))) / pi()"
OBS = "ob AS (SELECT test_id, max(statistic) AS m FROM {null_pvals} GROUP BY test_id)"
PERM = lambda f, tol: f"pm AS (SELECT o.test_id, m * {f} AS observed, (1 + count(*) FILTER (statistic >= m * {f} - {tol} * greatest(1, abs(m * {f})))) / CAST(1 + count(statistic) AS DOUBLE) AS p_value FROM ob o JOIN {{null_pvals}} n ON n.test_id = o.test_id GROUP BY o.test_id, m)"
TWO = "tw AS (SELECT k3 AS test_id, min(p_value) AS p, max(p_value) AS q FROM {pvals} GROUP BY k3), ta AS (SELECT test_id, p AS a FROM tw WHERE test_id % 3 > 0), tb AS (SELECT test_id, p * 0.5 + q * 0.01 AS b FROM tw WHERE test_id % 4 > 0)"
MODEL = lambda mul: f"SELECT test_id, 40 AS n_samples, (z * {mul}) % 501 / 10.0 AS o, CAST(z * {mul} % 997 + 1 AS DOUBLE) / 998 AS p, z % {mul % 7 + 3} > 0 AS c, {mul % 3 + 1} AS k FROM (SELECT k3 AS test_id, CAST(sum(k1) AS BIGINT) AS z FROM {{pvals}} GROUP BY k3) q"

#: Tests and null values of the depth-wise calibration with their strata.
DEPTH = """t AS (SELECT method, k3 AS test_id, min(p_value) AS p_value, CAST(sum(k2) AS DOUBLE) AS depth, CASE WHEN k3 % 50 = 0 THEN k3 ELSE max(k2) % 3 END AS df FROM {pvals} GROUP BY method, k3),
e AS (SELECT method, list_sort(list_distinct(quantile_cont(depth, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM t GROUP BY method),
b AS (SELECT t.*, CASE WHEN len(e) > 2 THEN len(list_filter(e[2:len(e) - 1], lambda v: v < depth)) ELSE 0 END AS bin FROM t JOIN e USING (method)),
sz AS (SELECT method, df, bin, count(*) AS size FROM b GROUP BY ALL),
ts AS (SELECT b.*, CASE WHEN size >= 20 THEN CAST(b.df AS VARCHAR) ELSE 'rare' END || ':' || bin AS s FROM b JOIN sz USING (method, df, bin)),
nb AS (SELECT n.method, n.test_id, n.p_value, CASE WHEN n.test_id % 50 = 0 THEN n.test_id ELSE n.k2 % 3 END AS df, coalesce(b.bin, 0) AS bin FROM {null_pvals} n LEFT JOIN b ON b.method = n.method AND b.test_id = n.test_id),
ns AS (SELECT nb.*, CASE WHEN coalesce(size, 0) >= 20 THEN CAST(nb.df AS VARCHAR) ELSE 'rare' END || ':' || nb.bin AS s FROM nb LEFT JOIN sz USING (method, df, bin))"""
RUNS = f"""rr AS (SELECT method, k3 AS test_id, k3 AS k1, 0 AS k2, 0 AS k3, 0 AS k4, min(p_value) AS pmin, max((k1 * 17 + k3) % 1000 / CAST(100 AS DOUBLE)) AS statistic, count(*) % 7 > 0 AS converged FROM {{pvals}} GROUP BY method, k3),
{fdr("rg", "(SELECT *, CASE WHEN converged THEN pmin END AS p_value FROM rr)")}, rf AS (SELECT * REPLACE (pmin AS p_value) FROM rg)"""
FITS = "nl AS (SELECT *, k1 % 11 > 0 AS converged FROM {null_pvals})"
CASES = {
    "p01_bh": (p01, f"WITH {fdr('b', '{pvals}')} SELECT k1, k2, k3, k4, round(fdr, 6) AS fdr FROM b"),
    "p02_bh_eligible": (p02, f"WITH m AS (SELECT * REPLACE (CASE WHEN converged THEN p_value END AS p_value) FROM {{pvals}}), {fdr('b', 'm')} SELECT k1, k2, k3, k4, round(fdr, 6) AS fdr FROM b"),
    "p03_simes": (p03, f"WITH {SIM('x', '{pvals}', 'method, level_a')} SELECT method, level_a, round(p_value, 9) AS p_value, n_features FROM x"),
    "p04_gene_pvalues": (p04, f"WITH {GENES} SELECT method, gene_id, round(p_value, 9) AS p_value, n_features FROM g"),
    "p05_feature_pvalues": (p05, f"WITH {BARE}, {SIM('x', 'pv', 'method, feature_id, gene_id')} SELECT method, feature_id, gene_id, round(p_value, 9) AS p_value, n_features FROM x"),
    "p06_gene_pair_pvalues": (p06, f"WITH {BARE}, {SIM('x', 'pv', 'method, gene_id, pair_id')} SELECT method, gene_id, pair_id, round(p_value, 9) AS p_value, n_features FROM x"),
    "p07_simes_omnibus": (p07, f"""WITH {SIM('x', '{pvals}', 'method, feature_id')}, m AS (SELECT method, feature_id, CASE WHEN count(DISTINCT gene_id) = 1 THEN min(gene_id) END AS gene_id FROM {{pvals}} GROUP BY ALL),
        {fdr('b', 'x', ties='feature_id')} SELECT method, feature_id, round(p_value, 6) AS p_value, n_features, gene_id, round(fdr, 6) AS fdr, fdr < 0.3 AS significant FROM b JOIN m USING (method, feature_id)"""),
    "p08_cauchy_combine": (p08, f"SELECT method, gene_id, round({CAUCHY}, 6) AS p_value FROM {{pvals}} GROUP BY ALL"),
    "p09_joint_block_tests": (p09, f"""WITH {EQUIV}, t AS (SELECT *, 0 AS src FROM ({TESTS(7919)}) a UNION ALL SELECT *, 1 FROM ({TESTS(104729)}) b),
        o AS (SELECT representative AS rep, p_value, row_number() OVER (PARTITION BY representative, cell_type, src ORDER BY block_id) AS rn FROM t JOIN rep USING (block_id)),
        c AS (SELECT rep, {CAUCHY} AS p_value, count(*) AS n, 1 AS method FROM o WHERE rn = 1 GROUP BY rep), {fdr('b', 'c', ties='rep')} SELECT rep, round(p_value, 6) AS p_value, n, round(fdr, 6) AS fdr FROM b"""),
    "p10_joint_gene_tests": (p10, f"""WITH {EQUIV}, c AS (SELECT split_part(block_id, ':', 1) AS gene_id, {CAUCHY} AS p, bool_and(p_value > 0.01) AS converged, count(*) AS n, 1 AS method FROM ({TESTS(7919)}) t GROUP BY 1),
        e AS (SELECT *, CASE WHEN converged THEN p END AS p_value FROM c), {fdr('b', 'e', ties='gene_id')} SELECT gene_id, round(p, 6) AS p_value, converged, n, round(fdr, 6) AS fdr FROM b"""),
    "p11_calibrate_ecdf": (p11, """WITH nl AS (SELECT method, p_value FROM {null_pvals} WHERE method <> 'R'), u AS (SELECT method, p_value, k1, k2, k3, k4, 0 AS z FROM {pvals} UNION ALL SELECT method, p_value, NULL, NULL, NULL, NULL, 1 FROM nl),
        c AS (SELECT *, sum(z) OVER (PARTITION BY method ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS h, sum(z) OVER (PARTITION BY method) AS n FROM u)
        SELECT k1, k2, k3, k4, round(CASE WHEN n > 0 THEN (1 + h) / CAST(n + 1 AS DOUBLE) ELSE p_value END, 6) AS calibrated FROM c WHERE z = 0"""),
    "p12_calibrate_pooled": (p12, """WITH u AS (SELECT method, k1 % 5 AS st, k3 AS t, p_value, k1, k2, k3, k4, 0 AS z FROM {pvals} UNION ALL SELECT method, k1 % 5, test_id, p_value, NULL, NULL, NULL, NULL, 1 FROM {null_pvals}),
        c AS (SELECT *, sum(z) OVER (PARTITION BY method, st ORDER BY p_value RANGE UNBOUNDED PRECEDING) - sum(z) OVER (PARTITION BY method, st, t ORDER BY p_value RANGE UNBOUNDED PRECEDING) AS h, sum(z) OVER (PARTITION BY method, st) - sum(z) OVER (PARTITION BY method, st, t) AS n FROM u)
        SELECT k1, k2, k3, k4, round(CASE WHEN n >= 1 THEN (1 + h) / CAST(n + 1 AS DOUBLE) END, 6) AS calibrated FROM c WHERE z = 0"""),
    "p12_calibrate_by_depth": (p12_depth, f"""WITH {DEPTH} SELECT method, test_id, bin AS calibration_bin, s AS stratum, round((1 + h) / CAST(1 + m AS DOUBLE), 6) AS calibrated FROM (
        SELECT t.method, t.test_id, t.bin, t.s, count(*) FILTER (n.p_value <= t.p_value) AS h, count(n.p_value) AS m FROM ts t LEFT JOIN ns n ON n.method = t.method AND n.s = t.s AND n.test_id <> t.test_id GROUP BY ALL) x"""),
    "p12_calibrate_by_depth_null": (p12_null, f"""WITH {DEPTH}, c AS (SELECT method, s, (1 + count(*) OVER (PARTITION BY method, s ORDER BY p_value RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY method, s, test_id ORDER BY p_value RANGE UNBOUNDED PRECEDING))
            / CAST(1 + count(*) OVER (PARTITION BY method, s) - count(*) OVER (PARTITION BY method, s, test_id) AS DOUBLE) AS c FROM ns)
        SELECT method, s AS stratum, count(*) AS n, round(avg(c), 6) AS mean, round(avg(CASE WHEN c <= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rejected FROM c GROUP BY ALL"""),
    "p13_calibrate_exceedance": (p13, """WITH u AS (SELECT method, k1 % 5 AS st, k3 AS t, (k1 * 17 + k3) % 1000 / CAST(100 AS DOUBLE) AS x, k1, k2, k3, k4, 0 AS z FROM {pvals} UNION ALL SELECT method, k1 % 5, test_id, statistic, NULL, NULL, NULL, NULL, 1 FROM {null_pvals}),
        c AS (SELECT *, sum(z) OVER (PARTITION BY method, st ORDER BY x DESC RANGE UNBOUNDED PRECEDING) - sum(z) OVER (PARTITION BY method, st, t ORDER BY x DESC RANGE UNBOUNDED PRECEDING) AS h, sum(z) OVER (PARTITION BY method, st) - sum(z) OVER (PARTITION BY method, st, t) AS n FROM u)
        SELECT k1, k2, k3, k4, round(CASE WHEN n >= 2 THEN (1 + h) / CAST(n + 1 AS DOUBLE) END, 6) AS calibrated FROM c WHERE z = 0"""),
    "p14_quantile_bins": (p14, """WITH e AS (SELECT method, quantile_cont(p_value, 0.25) AS a, quantile_cont(p_value, 0.5) AS b, quantile_cont(p_value, 0.75) AS c FROM {pvals} GROUP BY method)
        SELECT method, CAST(p_value >= a AS INT) + CAST(p_value >= b AS INT) + CAST(p_value >= c AS INT) AS bin, count(*) AS n FROM {pvals} JOIN e USING (method) GROUP BY ALL"""),
    "p15_calibration_strata": (p15, """WITH x AS (SELECT method, (k1 * k2) % 13 AS st, k3 FROM {pvals}), c AS (SELECT method, st, count(DISTINCT k3) AS n FROM x GROUP BY ALL)
        SELECT method, CASE WHEN n >= 650 THEN CAST(st AS VARCHAR) ELSE 'pooled' END AS pooled, count(*) AS n FROM x JOIN c USING (method, st) GROUP BY 1, 2"""),
    "p16_permutation_pvalue": (p16, f"WITH {OBS}, {PERM('0.8', '1e-9')} SELECT test_id, round(observed, 6) AS observed, round(p_value, 6) AS p_value FROM pm"),
    "p17_gated_fdr": (p17, f"""WITH nl AS (SELECT method, k1 % 3 AS b, CASE WHEN p_value <= 0.05 THEN 1.0 ELSE 0.0 END AS h FROM {{null_pvals}}), rt AS (SELECT method, avg(h) AS r FROM nl GROUP BY method UNION ALL SELECT method, avg(h) FROM nl GROUP BY method, b),
        ps AS (SELECT method, bool_and(r BETWEEN 0.0475 AND 0.0545) AS passed FROM rt GROUP BY method), m AS (SELECT k1, k2, k3, k4, method, passed, CASE WHEN passed THEN p_value END AS p_value FROM {{pvals}} LEFT JOIN ps USING (method)),
        {fdr('b', 'm')} SELECT k1, k2, k3, k4, passed, round(fdr, 6) AS fdr FROM b"""),
    "p18_merge_summary": (p18, f"""WITH m AS (SELECT *, p_value AS p, CASE WHEN converged THEN p_value END AS pe FROM {{pvals}}), {fdr('b', 'm', 'pe')}, nl AS (SELECT method, k1 % 3 AS bin, p_value AS p FROM {{null_pvals}}),
        r AS (SELECT method, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END) AS r FROM nl GROUP BY method, bin)
        SELECT b.method, count(*) AS tests, count(*) FILTER (converged) AS converged, count(*) FILTER (p < 0.05) AS nominal, count(*) FILTER (fdr < 0.05) AS discoveries,
            (SELECT round(avg(CASE WHEN p <= 0.01 THEN 1.0 ELSE 0.0 END), 6) FROM nl WHERE nl.method = b.method) AS null_01, (SELECT round(avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END), 6) FROM nl WHERE nl.method = b.method) AS null_05,
            (SELECT round(avg(CASE WHEN p <= 0.1 THEN 1.0 ELSE 0.0 END), 6) FROM nl WHERE nl.method = b.method) AS null_1, (SELECT round(min(r), 6) FROM r WHERE r.method = b.method) AS bin_min, (SELECT round(max(r), 6) FROM r WHERE r.method = b.method) AS bin_max
        FROM b GROUP BY b.method"""),
    "p19_simulation_pvalues": (p19, f"WITH {OBS}, {PERM('0.9', '0')}, m AS (SELECT test_id, p_value AS p, CASE WHEN test_id % 5 > 0 THEN p_value END AS p_value, 1 AS method FROM pm), {fdr('b', 'm', ties='test_id')} SELECT test_id, round(p, 6) AS p_value, round(fdr, 6) AS fdr FROM b"),
    "p20_select_hybrid": (p20, f"""WITH a AS ({MODEL(31)}), b AS ({MODEL(77)}), j AS (SELECT a.test_id, 2 * b.o + b.k * ln(40) - 2 * a.o - a.k * ln(40) AS gain, a.p AS p1, b.p AS p2, a.c AND b.c AS converged FROM a JOIN b USING (test_id)),
        m AS (SELECT test_id, gain, CASE WHEN gain > 0 THEN 'first' ELSE 'second' END AS model, CASE WHEN gain > 0 THEN p1 ELSE p2 END AS p, converged, CASE WHEN converged THEN CASE WHEN gain > 0 THEN p1 ELSE p2 END END AS p_value, 1 AS method FROM j),
        {fdr('f', 'm', ties='test_id')} SELECT test_id, round(gain, 6) AS gain, model, round(p, 6) AS p_value, converged, round(fdr, 6) AS fdr FROM f"""),
    "p21_normalize_pvalues": (p21, f"WITH m AS (SELECT k1, k2, k3, k4, 1 AS method, CASE WHEN k1 % 9 <> 0 THEN p_value END AS p_value FROM {{pvals}}), {fdr('b', 'm', ties='k3, k1, k2, k4')} SELECT k1 AS a, k2 AS b, k4 AS c, k3 AS feature_id, round(fdr, 6) AS fdr, coalesce(fdr < 0.05, false) AS significant FROM b"),
    "p22_adapt_comparator": (p22, """WITH m AS (SELECT k1, k2, k3, k4, coalesce(CASE WHEN k1 % 2 = 0 THEN p_value END, CASE WHEN k1 % 3 = 0 THEN 0.5 END) AS p FROM {pvals}), x AS (SELECT *, k2 || ':' || k3 AS f FROM m WHERE p IS NOT NULL)
        SELECT CASE WHEN count(*) OVER (PARTITION BY f) > 1 THEN f || '#' || (row_number() OVER (PARTITION BY f ORDER BY k1, k2, k3, k4) - 1) ELSE f END AS feature_id, round(p, 9) AS p_value FROM x"""),
    "p23_pairwise_tables": (p23, "SELECT k1, k2, k3, k4, level_a, level_b FROM {pvals} WHERE converged"),
    "p24_discovery_summary": (p24, f"""WITH ct AS (SELECT * FROM {{pvals}} WHERE k2 % 2 = 1), {SIM('x', 'ct', 'method, feature_id')}, {fdr('b', 'x', ties='feature_id')}
        SELECT method, 'condition' AS effect, count(*) AS tests, count(*) FILTER (p_value < 0.05) AS discoveries FROM {{pvals}} WHERE k2 % 2 = 0 GROUP BY method UNION ALL SELECT method, 'cell_type', count(*), count(*) FILTER (fdr < 0.5) FROM b GROUP BY method"""),
    "p25_reproducibility": (p25, f"WITH {BARE}, {FOLDS}, {REPRO}"),
    "p26_topk_overlap": (p26, f"""WITH {BARE}, {FOLDS}, r AS (SELECT *, row_number() OVER (PARTITION BY method, fold ORDER BY p_value, gene_id) AS rk, count(*) OVER (PARTITION BY method, fold) AS n FROM ff),
        w AS (SELECT *, least(want, n) AS k FROM r CROSS JOIN (SELECT unnest([5, 20, 500]) AS want) q), c AS (SELECT method, want, k, gene_id, count(*) AS c FROM w WHERE rk <= k GROUP BY ALL)
        SELECT method, want, k, round(count(*) FILTER (c = 2) / CAST(k AS DOUBLE), 6) AS overlap FROM c GROUP BY method, want, k"""),
    "p27_pair_reproducibility": (p27, f"""WITH {BARE}, fx AS (SELECT *, k1 % 2 AS fold FROM pv WHERE k4 % 5 > 0 OR k2 < 5 OR method = 'A'),
        hs AS (SELECT gene_id, pair_id FROM fx GROUP BY ALL HAVING count(DISTINCT (method, fold)) = (SELECT count(DISTINCT (method, fold)) FROM fx)), fo AS (SELECT * FROM fx SEMI JOIN hs USING (gene_id, pair_id)), {SIM('ff', 'fo', 'method, fold, gene_id')}, {REPRO}"""),
    "p28_compare_discoveries": (p28, f"""WITH {GENES}, u AS (SELECT method, gene_id, p_value * 0.3 AS p_value FROM g WHERE CAST(substr(gene_id, 2) AS INT) % 9 > 0), cm AS (SELECT gene_id FROM u GROUP BY gene_id HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM g)),
        rw AS (SELECT *, 'own' AS universe FROM u UNION ALL SELECT *, 'common' FROM u WHERE gene_id IN (SELECT gene_id FROM cm)), {fdr('b', 'rw', part='method, universe', ties='gene_id')},
        rf AS (SELECT universe, gene_id FROM b WHERE method = 'A' AND fdr < 0.2), c AS (SELECT b.method, b.universe, count(*) AS tests, count(*) FILTER (fdr < 0.2) AS found, count(*) FILTER (fdr < 0.2 AND rf.gene_id IS NOT NULL) AS hits FROM b LEFT JOIN rf ON rf.universe = b.universe AND rf.gene_id = b.gene_id GROUP BY ALL)
        SELECT method, universe, tests, found, round(hits / CAST(nullif(found + (SELECT count(*) FROM rf WHERE rf.universe = c.universe) - hits, 0) AS DOUBLE), 6) AS jaccard FROM c"""),
    "p29_compare_coverage": (p29, f"""WITH {TWO}, j AS (SELECT a, b, a IS NOT NULL AND b IS NOT NULL AS s FROM ta FULL JOIN tb USING (test_id)),
        x AS (SELECT *, rank() OVER (PARTITION BY s ORDER BY a) + count(*) OVER (PARTITION BY s, a) / 2.0 AS ra, rank() OVER (PARTITION BY s ORDER BY b) + count(*) OVER (PARTITION BY s, b) / 2.0 AS rb FROM j)
        SELECT count(a) AS strict, count(b) AS permissive, count(*) FILTER (s) AS shared, count(*) FILTER (a < 0.05) AS found_strict, count(*) FILTER (b < 0.05) AS found_permissive, count(*) FILTER (a < 0.05 AND b < 0.05) AS found_both, round(corr(ra, rb) FILTER (s), 6) AS spearman FROM x"""),
    "p29_coverage_report": (p29_report, f"""WITH {RUNS}, j AS (SELECT a.test_id AS ta, b.test_id AS tb, a.test_id IS NOT NULL AND b.test_id IS NOT NULL AS s, coalesce(a.converged, false) AS c1, coalesce(b.converged, false) AS c2, a.p_value AS p1, b.p_value AS p2, a.fdr <= 0.4 AS h1, b.fdr <= 0.4 AS h2, a.statistic AS x1, b.statistic AS x2
            FROM (SELECT * FROM rf WHERE method = 'A') a FULL JOIN (SELECT * FROM rf WHERE method = 'N') b ON a.test_id = b.test_id),
        {fdr("fam", "(SELECT tb AS k1, 0 AS k2, 0 AS k3, 0 AS k4, p2 AS p_value, 1 AS method FROM j WHERE s AND c2)")},
        k AS (SELECT x1, x2, p1, p2, rank() OVER (ORDER BY p1) + count(*) OVER (PARTITION BY p1) / 2.0 AS a1, rank() OVER (ORDER BY p2) + count(*) OVER (PARTITION BY p2) / 2.0 AS a2, rank() OVER (ORDER BY x1) + count(*) OVER (PARTITION BY x1) / 2.0 AS b1, rank() OVER (ORDER BY x2) + count(*) OVER (PARTITION BY x2) / 2.0 AS b2 FROM j WHERE s)
        SELECT count(ta) AS strict_tests, count(tb) AS permissive_tests, count(*) FILTER (s) AS shared_tests, count(*) FILTER (c1) AS strict_converged, count(*) FILTER (c2) AS permissive_converged, count(*) FILTER (c1 AND p1 <= 0.4) AS strict_nominal, count(*) FILTER (c2 AND p2 <= 0.4) AS permissive_nominal,
            count(*) FILTER (h1) AS strict_fdr, count(*) FILTER (h2) AS permissive_fdr, (SELECT count(*) FROM fam WHERE fdr <= 0.4) AS permissive_shared_family_fdr, count(*) FILTER (s AND h1 AND h2) AS significant_both, count(*) FILTER (s AND h1 AND NOT coalesce(h2, false)) AS strict_only_shared,
            count(*) FILTER (s AND h2 AND NOT coalesce(h1, false)) AS permissive_only_shared, count(*) FILTER (NOT s AND h2) AS permissive_only_universe, (SELECT round(corr(a1, a2), 6) FROM k) AS p_value_spearman, (SELECT round(corr(b1, b2), 6) FROM k) AS statistic_spearman FROM j"""),
    "p29_method_overlap": (p29_overlap, f"""WITH {RUNS}, x AS (SELECT CASE WHEN i = 1 THEN 'strict' ELSE 'permissive' END AS coverage, test_id, bool_or(method = 'A' AND coalesce(fdr / i <= 0.3, false)) AS a, bool_or(method = 'N' AND coalesce(fdr / i <= 0.3, false)) AS b, bool_or(method = 'R' AND coalesce(fdr / i <= 0.3, false)) AS c
            FROM rf CROSS JOIN (SELECT unnest([1, 2]) AS i) q GROUP BY ALL)
        SELECT coverage, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS first_only, count(*) FILTER (b AND NOT a) AS second_only, count(*) FILTER (a AND b AND c) AS all_three FROM x GROUP BY coverage"""),
    "p30_compare_runs": (p30, f"""WITH {TWO}, j AS (SELECT a, b, test_id % 7 > 0 AND test_id % 5 > 0 AS c, test_id % 7 + 1 AS s1, test_id % 5 + 1 AS s2 FROM ta JOIN tb USING (test_id))
        SELECT count(*) AS tests, count(*) FILTER (c) AS converged, round(quantile_cont(abs(a - b), 0.5) FILTER (c), 6) AS median_diff, round(max(abs(a - b)) FILTER (c), 6) AS max_diff,
               round(count(*) FILTER (c AND a < 0.05 AND b < 0.05) / CAST(nullif(count(*) FILTER (c AND (a < 0.05 OR b < 0.05)), 0) AS DOUBLE), 6) AS jaccard, round(sum(s1) / CAST(sum(s2) AS DOUBLE), 6) AS speedup FROM j"""),
    "p31_paired_logratio": (p31, """WITH c AS (SELECT l_partkey % 40 AS f, l_suppkey % 9 AS s, l_linenumber % 2 AS side, l_orderkey % 2 AS cat, ln(count(*) + 0.5) AS x FROM lineitem GROUP BY ALL), q AS (SELECT *, x - avg(x) OVER (PARTITION BY f, s, side) AS y FROM c),
        d AS (SELECT f, s, cat, sum(y) FILTER (side = 1) - sum(y) FILTER (side = 0) AS d FROM q GROUP BY ALL HAVING count(*) = 2), g AS (SELECT f FROM d GROUP BY f HAVING count(DISTINCT s) >= 3 AND count(DISTINCT cat) = 2),
        t AS (SELECT f, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d WHERE cat = 0 AND f IN (SELECT f FROM g) GROUP BY f),
        h AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS h FROM t),
        a AS (SELECT *, CASE WHEN v % 2 = 0 THEN sin(h) * list_sum(list_transform([0, 1, 2, 3], lambda k: CASE WHEN 2 * k <= v - 2 THEN [1, 1 / 2.0, 3 / 8.0, 5 / 16.0][k + 1] * cos(h) ** (2 * k) ELSE 0 END))
            ELSE 2 / pi() * (h + sin(h) * list_sum(list_transform([0, 1, 2], lambda k: CASE WHEN 2 * k <= v - 3 THEN [1, 2 / 3.0, 8 / 15.0][k + 1] * cos(h) ** (2 * k + 1) ELSE 0 END))) END AS a FROM h)
        SELECT f AS feature, n AS n_subjects, 2 AS n_categories, round(t, 6) AS statistic, round(1 - a, 6) AS p_value FROM a"""),
    "p31_paired_logratio_hotelling": (p31_hotelling, None),
    "p32_effective_counts": (p32, "WITH x AS (SELECT *, least((1 / p_value + 1 / (1 - p_value)) / (2 * ((k1 % 17 + 1) / 40.0)), k3 % 60 + 5) AS z FROM {pvals}) SELECT k1, k2, k3, k4, round(z, 6) AS size, round(z * p_value, 6) AS n1, round(z * (1 - p_value), 6) AS n2 FROM x"),
    "p32_effective_counts_two_paths": (p32_two, "WITH x AS (SELECT *, least((1 / p_value + 1 / (1 - p_value)) / (2 * ((k1 % 17 + 1) / 40.0)), k3 % 60 + 5) AS z FROM {pvals}) SELECT k1, k2, k3, k4, round(z, 6) AS size, round(z * p_value, 6) AS n1, round(z * (1 - p_value), 6) AS n2 FROM x"),
    "p32_effective_counts_three_paths": (p32_paths, """WITH w AS (SELECT k1, k2, k3, k4, CAST(k1 % 7 + 1 AS DOUBLE) AS a, CAST(k2 % 5 + 1 AS DOUBLE) AS b, CAST(k3 % 9 + 1 AS DOUBLE) AS c, (k1 % 17 + 1) / CAST(40 AS DOUBLE) AS x, (k4 % 5 - 2) / CAST(100 AS DOUBLE) AS y, (k3 % 13 + 1) / CAST(40 AS DOUBLE) AS z FROM {pvals}),
        p AS (SELECT *, a / (a + b + c) AS p1, b / (a + b + c) AS p2, c / (a + b + c) AS p3 FROM w),
        u AS (SELECT *, (1 / p1 + 1 / p2) / 2 AS u11, (1 / p1 - 1 / p2) / sqrt(12) AS u12, (1 / p1 + 1 / p2 + 4 / p3) / 6 AS u22 FROM p),
        f AS (SELECT *, (u11 * x + 2 * u12 * y + u22 * z) / (u11 * u11 + 2 * u12 * u12 + u22 * u22) AS f FROM u), n AS (SELECT *, CASE WHEN f > 0 THEN least(1 / f, k3 % 60 + 5) END AS n FROM f)
        SELECT k1, k2, k3, k4, round(n, 6) AS size, round(n * p1, 6) AS n1, round(n * p3, 6) AS n3 FROM n"""),
    "p33_integerize": (p33, """WITH x AS (SELECT sample, tx_id AS path, num_reads * 7 % 64 / 16.0 AS x FROM {quant}), y AS (SELECT *, floor(x) AS f, row_number() OVER (PARTITION BY sample ORDER BY x - floor(x) DESC, path) AS rk, round_even(sum(x) OVER (PARTITION BY sample), 0) - sum(floor(x)) OVER (PARTITION BY sample) AS l FROM x)
        SELECT sample, path, CAST(f + CASE WHEN rk <= l THEN 1 ELSE 0 END AS BIGINT) AS count FROM y"""),
    "p34_multinomial_lrt": (p34, """WITH c AS (SELECT l_partkey % 50 AS f, l_returnflag AS l, l_linenumber % 3 AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY f, l) AS r, sum(n) OVER (PARTITION BY f, k) AS q, sum(n) OVER (PARTITION BY f) AS t FROM c)
        SELECT f AS feature, round(2 * sum(n * ln(n * t / (r * q))), 6) AS statistic, (count(DISTINCT l) - 1) * (count(DISTINCT k) - 1) AS df FROM m GROUP BY f"""),
    "p35_weighted_wald": (p35, """WITH w AS (SELECT k3 AS f, method AS l, p_value AS y, 1 / ((k1 % 11 + 1) / 20.0 + 0.1) AS w FROM {pvals}), m AS (SELECT f, l, sum(w) AS w, sum(w * y) / sum(w) AS m FROM w GROUP BY ALL), g AS (SELECT *, sum(w * m) OVER (PARTITION BY f) / sum(w) OVER (PARTITION BY f) AS g FROM m)
        SELECT f AS feature, round(sum(w * (m - g) * (m - g)), 6) AS statistic, count(*) - 1 AS df FROM g GROUP BY f"""),
    "p36_null_summary": (p36, """WITH x AS (SELECT method, p_value AS p, row_number() OVER (PARTITION BY method ORDER BY p_value) AS r, count(*) OVER (PARTITION BY method) AS n FROM {null_pvals})
        SELECT method, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rejected, round(max(greatest(r / CAST(n AS DOUBLE) - p, p - (r - 1) / CAST(n AS DOUBLE))), 6) AS ks, round(quantile_cont(p, 0.05), 6) AS quantile_05 FROM x GROUP BY method"""),
    "p37_power_summary": (p37, f"WITH {OBS}, {PERM('0.95', '0')} SELECT 'm' AS method, test_id % 3 AS effect_size, count(*) AS tests, round(avg(CASE WHEN p_value <= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS power, round(quantile_cont(observed, 0.5), 6) AS median_statistic FROM pm GROUP BY 2"),
    "p37_observed_summary": (p37_observed, f"""WITH {FITS}, o AS (SELECT method, test_id, max(statistic) * 0.9 AS statistic, min(p_value) AS p_value, count(*) % 6 > 0 AS ok FROM nl GROUP BY ALL),
        e AS (SELECT o.method, o.test_id AS k1, 0 AS k2, 0 AS k3, 0 AS k4, CASE WHEN ok THEN o.p_value END AS p_value, CASE WHEN ok AND count(n.statistic) > 0 THEN (1 + count(*) FILTER (n.statistic >= o.statistic - 1e-6 * greatest(1, abs(o.statistic)))) / CAST(1 + count(n.statistic) AS DOUBLE) END AS ranked FROM o LEFT JOIN nl n ON n.method = o.method AND n.test_id = o.test_id AND n.converged GROUP BY o.method, o.test_id, ok, o.p_value, o.statistic),
        {fdr("f1", "e")}, {fdr("f2", "(SELECT * REPLACE (ranked AS p_value) FROM e)")}
        SELECT method, count(*) AS tests, count(a.p_value) AS converged, count(*) FILTER (a.p_value < 0.2) AS nominal, count(*) FILTER (a.fdr <= 0.2) AS discoveries, count(*) FILTER (b.p_value <= 0.2) AS permutation_nominal, count(*) FILTER (b.fdr <= 0.2) AS permutation_discoveries
        FROM (SELECT method, k1, p_value, fdr FROM f1) a JOIN (SELECT method, k1, p_value, fdr FROM f2) b USING (method, k1) GROUP BY method"""),
    "p37_null_fits": (p37_null, f"WITH {FITS} SELECT method, count(*) AS fits, count(*) FILTER (converged) AS converged, round(avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (converged), 6) AS rejected, round(quantile_cont(p_value, 0.05) FILTER (converged), 6) AS quantile_05 FROM nl GROUP BY method"),
    "p37_power_report": (p37_power, f"""WITH {FITS}, n AS (SELECT method, test_id, list(statistic) AS l FROM nl WHERE converged GROUP BY ALL),
        w AS (SELECT p.method, k2 % 3 AS effect_size, p_value, k1 % 11 > 0 AS ok, (k1 * 17 + k3) % 1000 / CAST(100 AS DOUBLE) AS x, l FROM {{pvals}} p LEFT JOIN n ON n.method = p.method AND n.test_id = p.k3),
        q AS (SELECT *, CASE WHEN l IS NOT NULL THEN (1 + len(list_filter(l, lambda v: v >= x - 1e-6 * greatest(1, abs(x))))) / CAST(1 + len(l) AS DOUBLE) END AS q FROM w)
        SELECT method, effect_size, count(*) AS fits, count(*) FILTER (ok) AS converged, round(avg(CASE WHEN p_value < 0.2 THEN 1.0 ELSE 0.0 END) FILTER (ok), 6) AS asymptotic_power, round(avg(CASE WHEN q <= 0.2 THEN 1.0 ELSE 0.0 END) FILTER (ok AND q IS NOT NULL), 6) AS calibrated_power FROM q GROUP BY ALL"""),
    "p38_merge_shards_summary": (p38, "SELECT method, count(*) AS n, round(avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {null_pvals} GROUP BY method"),
    "p39_finite_summary": (p39, "SELECT method, count(*) AS n, round(avg(statistic), 6) AS mean, round(quantile_cont(statistic, 0.5), 6) AS median, round(quantile_cont(statistic, 0.1), 6) AS q10, round(quantile_cont(statistic, 0.9), 6) AS q90 FROM {null_pvals} WHERE k1 % 7 <> 0 AND k1 % 11 <> 0 GROUP BY method"),
    "p40_match_estimates": (p40, """WITH e AS (SELECT ec_id AS b, cell_id AS c, condition, subject, n FROM {cell_ec} JOIN {cell_meta} USING (cell_id) WHERE cell_id % 3 > 0 AND cell_id % 4 > 0), l AS (SELECT b, condition FROM e GROUP BY ALL HAVING count(DISTINCT subject) >= 5), g AS (SELECT b FROM l GROUP BY b HAVING count(*) >= 2)
        SELECT b AS block_id, c AS sample, n * 3 AS value, n * 4 AS value_2 FROM e SEMI JOIN l USING (b, condition) SEMI JOIN g USING (b)"""),
    "p41_resource_summary": (p41, """WITH x AS (SELECT o_orderpriority AS c, (CASE WHEN o_orderkey % 5 = 0 THEN 86400 ELSE 0 END) + o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey * 7 % 60 AS s, (o_orderkey % 900) / CASE WHEN o_orderkey % 3 = 0 THEN 1024.0 ELSE 1048576.0 END AS g, o_orderkey % 20 AS d FROM orders)
        SELECT c AS campaign, count(*) AS tasks, round(sum(s) / 3600.0, 6) AS hours, round(quantile_cont(s, 0.5) / 60.0, 6) AS median_min, round(quantile_cont(s, 0.9) / 60.0, 6) AS p90_min, round(max(g), 6) AS peak_gib, CAST((max(d) + 4 - min(d)) * 24 AS DOUBLE) AS span_hours FROM x GROUP BY c"""),
    "p42_select_candidate": (p42, """WITH x AS (SELECT k3 % 30 AS run, k1 % 12 AS strength, round(avg(p_value), 9) AS loss, count(*) AS n FROM {pvals} GROUP BY ALL), o AS (SELECT *, n % 9 AS v FROM x WHERE n % 6 > 0 AND n % 7 <> 0),
        b AS (SELECT run, arg_min(v, (loss, strength)) AS bv, min(loss) AS bl FROM o GROUP BY run), k AS (SELECT o.*, row_number() OVER (PARTITION BY run ORDER BY strength DESC, loss) AS rn FROM o JOIN b USING (run) WHERE loss <= bl + 0.05 AND v >= 0.8 * bv)
        SELECT run, strength, loss FROM k WHERE rn = 1"""),
    "p43_combine_scores": (p43, "SELECT CAST(n_nationkey AS BIGINT) AS fit, 'ok' AS status, n_name AS x, NULL AS y FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), 'ok', NULL, r_name FROM region"),
    "p44_replicate_summary": (p44, """WITH x AS (SELECT method, k1 % 3 AS effect, statistic, p_value AS e, CASE WHEN k2 % 4 > 0 THEN 1.0 ELSE 0.0 END AS c FROM {null_pvals}), l AS (SELECT method, quantile_cont(statistic, 0.95) AS l FROM x WHERE effect = 0 GROUP BY method)
        SELECT 'f' AS family, method, effect, round(avg(CASE WHEN statistic > l THEN 1.0 ELSE 0.0 END), 6) AS rejected, round(avg(e - effect), 6) AS bias, round(sqrt(avg((e - effect) * (e - effect))), 6) AS rmse, round(avg(c), 6) AS converged, round(quantile_cont(statistic, 0.5), 6) AS median_statistic FROM x JOIN l USING (method) GROUP BY ALL"""),
}
