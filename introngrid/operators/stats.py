"""Combining, calibrating and comparing tables of p-values."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.functions.scan import Ranges, mid_ranks, percentiles
from introngrid.functions.tails import chi2_sf, t_two_sided
from introngrid.functions.windows import bh, simes, unique_or_null
from introngrid.schema import assert_unique, require_columns
from introngrid.storage import bounded_broadcast, materialize

EDGE = 1e-15


def _over(*keys):
    return Window.partitionBy(*keys)


def bh_eligible(df: DataFrame, p: str = "p_value", keys=("method",), eligible: str = "converged", ties=(), out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg over eligible rows only; the others get null."""
    masked = df.withColumn("__p", F.when(F.coalesce(F.col(eligible), F.lit(False)), F.col(p)))
    return bh(masked, "__p", keys, ties, out).drop("__p")


def gene_pvalues(df: DataFrame) -> DataFrame:
    """Simes p-value by method and gene, ids without version."""
    return simes(df.withColumn("gene_id", F.split("gene_id", r"\.")[0]), "p_value", ["method", "gene_id"], wide=True)


def feature_pvalues(df: DataFrame) -> DataFrame:
    return simes(df.withColumn("gene_id", F.split("gene_id", r"\.")[0]), "p_value", ["method", "feature_id", "gene_id"])


def gene_pair_pvalues(df: DataFrame) -> DataFrame:
    """Simes p-value by method, gene and unordered pair of levels; the pair's name joins both by two pipes."""
    pair = F.concat_ws("||", F.least("level_a", "level_b"), F.greatest("level_a", "level_b"))
    return simes(df.withColumn("gene_id", F.split("gene_id", r"\.")[0]).withColumn("pair_id", pair), "p_value", ["method", "gene_id", "pair_id"], wide=True)


def simes_omnibus(df: DataFrame, level: float = 0.05, metadata=("gene_id",)) -> DataFrame:
    """Simes by method and feature with metadata where it is unique, FDR by method and a flag."""
    out = simes(df, "p_value", ["method", "feature_id"], extra=[unique_or_null(m).alias(m) for m in metadata])
    return bh(out, "p_value", ["method"], ["feature_id"]).withColumn("significant", F.col("fdr") < level)


def cauchy(p: str) -> Column:
    """Aggregate: the Cauchy combination of p-values clipped to [1e-15, 1 - 1e-15]."""
    clipped = F.least(F.greatest(F.col(p), F.lit(EDGE)), F.lit(1 - EDGE))
    return 0.5 - F.atan(F.avg(F.tan(F.lit(np.pi) * (0.5 - clipped)))) / F.lit(np.pi)


def joint_block_tests(sources: list[DataFrame], equivalence: DataFrame) -> DataFrame:
    """Rows of several sources, one per representative block, cell type and source, combined over cell types, with FDR.

    Each source has (block_id, cell_type, p_value).
    """
    rows = None
    for i, source in enumerate(sources):
        part = source.select("block_id", "cell_type", "p_value", F.lit(i).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    mapped = rows.join(equivalence, "block_id", "left").withColumn("rep", F.coalesce("representative", "block_id"))
    first = F.row_number().over(_over("rep", "cell_type", "source").orderBy("block_id"))
    once = mapped.withColumn("__r", first).where("__r = 1")
    out = once.groupBy("rep").agg(cauchy("p_value").alias("p_value"), F.count("p_value").alias("n"))
    return bh(out, "p_value", ties=["rep"])


def joint_gene_tests(df: DataFrame) -> DataFrame:
    """Cauchy combination of a gene's blocks (gene:Bn), eligible only if all converged, with FDR."""
    gene = F.regexp_replace("block_id", ":B[^:]*$", "")
    out = df.groupBy(gene.alias("gene_id")).agg(cauchy("p_value").alias("p_value"), F.bool_and(F.coalesce("converged", F.lit(False))).alias("converged"), F.count("*").alias("n"))
    return bh_eligible(out.withColumn("method", F.lit("joint")), ties=["gene_id"]).drop("method")


def _null_counts(df: DataFrame, null: DataFrame, keys: list[str], value: str, upper: bool, hits: str, total: str) -> DataFrame:
    """Rows of both tables (null ones with __null 1) with the number of the key's null values at least as extreme, and of all its null values.

    At equal values null rows come first, so a running count over range partitions includes them; no key's rows meet in one task.
    """
    both = df.withColumn("__null", F.lit(0)).unionByName(null.withColumn("__null", F.lit(1)), allowMissingColumns=True)
    ranges = Ranges(both, keys, [f"-{value}" if upper else value, "-__null"])
    return ranges.close(ranges.counts(F.col("__null") == 1, hits, total))


def calibrate_ecdf(df: DataFrame, null: DataFrame, p: str = "p_value", key: str = "method") -> DataFrame:
    """p-values as (1 + number of null values not above) / (n + 1) by method; a method without null values keeps its own."""
    both = _null_counts(df, null.select(key, p), [key], p, False, "__h", "__n")
    value = F.when(F.col("__n") > 0, (1 + F.coalesce("__h", F.lit(0))) / (F.col("__n") + 1)).otherwise(F.col(p))
    return both.withColumn("calibrated", value).where("__null = 0").drop("__null", "__h", "__n")


def calibrate_pooled(df: DataFrame, null: DataFrame, value: str, strata: list[str], own: str, upper: bool = False, least: int = 1) -> DataFrame:
    """Share of null values as extreme, inside strata and without the row's own test: (1 + count) / (n + 1).

    Counts over the pool, from range partitions, less counts over the own test, from a
    window over the test's rows. upper counts values at least as large. Fewer than `least`
    null values give null.
    """
    both = _null_counts(df, null.select(*strata, own, value), strata, value, upper, "__h", "__n")
    mine = _over(*strata, own)
    order = F.col(value).desc() if upper else F.col(value).asc()
    hits = F.col("__h") - F.sum("__null").over(mine.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("__o", hits).withColumn("__n", F.col("__n") - F.sum("__null").over(mine))
    return both.withColumn("calibrated", F.when(F.col("__n") >= least, (1 + F.col("__o")) / (1 + F.col("__n")))).where("__null = 0").drop("__null", "__h", "__o", "__n")


def depth_bins(df: DataFrame, value: str, bins: int, key: str = "method", out: str = "calibration_bin") -> DataFrame:
    """df with the number of inner quantile edges of its method that lie below the value; two edges or fewer, or bins = 1, give 0."""
    if bins <= 1:
        return df.withColumn(out, F.lit(0))
    edges = materialize(percentiles(df, value, [i / bins for i in range(bins + 1)], [key], "__e").withColumn("__e", F.array_distinct("__e")), "edges")
    inner = F.filter(F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0))), lambda e: e < F.col(value))
    return df.join(bounded_broadcast(edges), key, "left").withColumn(out, F.when(F.size("__e") > 2, F.size(inner)).otherwise(0)).drop("__e")


def calibrate_by_depth(df: DataFrame, null: DataFrame, bins: int = 1, depth: str = "depth", parameters: str = "df", own: str = "test_id", key: str = "method", least: int = 20, want: tuple = (True, True)) -> tuple[DataFrame | None, DataFrame | None]:
    """(tests, null values), both (what want leaves out is None and not worked out) with calibration_bin and calibrated: p-values against null values of the same degrees of freedom and depth from other tests.

    Strata are degrees of freedom x quantile bin of the tests' depth; null values take the
    bin of their test (0 if it isn't there). A stratum with under `least` tests is pooled
    with the other small ones of its bin. The null values are calibrated alike, each
    without those of its own test, which shows how the calibration behaves. Where no other null value is left the result is 1.
    One row of df for each key and own.
    """
    tests = materialize(depth_bins(materialize(df, "tests"), depth, bins, key), "binned")
    nulls = null.join(tests.select(key, own, "calibration_bin"), [key, own], "left").withColumn("calibration_bin", F.coalesce("calibration_bin", F.lit(0)))
    strata = [key, parameters, "calibration_bin"]
    # Only strata that are large enough are looked up: the small ones, as many as there are rare degrees of freedom, are all told alike.
    sizes = tests.groupBy(*strata).agg(F.count("*").alias("__size")).where(F.col("__size") >= least)
    sizes = bounded_broadcast(materialize(sizes.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(strata)], "__size"), "strata"))

    def pooled(t: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, c in enumerate(strata):
            same &= F.col(c).eqNullSafe(F.col(f"__{i}"))
        told = F.when(F.col("__size").isNotNull(), F.coalesce(F.col(parameters).cast("string"), F.lit("?"))).otherwise("rare")
        return t.join(sizes, same, "left").withColumn("stratum", F.concat_ws(":", told, F.col("calibration_bin").cast("string"))).drop("__size", *[f"__{i}" for i in range(len(strata))])

    nulls = pooled(nulls)
    nulls = materialize(_own_counts(nulls, "p_value", [key, "stratum"], own) if want[1] else nulls, "null-strata")
    by = [key, "stratum"]
    return calibrate_pooled(pooled(tests), nulls, "p_value", by, own, least=0) if want[0] else None, _calibrate_among(nulls, "p_value", by) if want[1] else None


def _own_counts(null: DataFrame, value: str, strata: list[str], own: str) -> DataFrame:
    """null with __own_h and __own_n: how many of its own test's values in the stratum are not above, and how many there are."""
    mine = _over(*strata, own)
    return null.withColumns({"__own_h": F.count("*").over(mine.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)), "__own_n": F.count("*").over(mine)})


def _calibrate_among(null: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """calibrate_pooled() of _own_counts() rows against themselves: different values are counted and ranked, and told to their rows."""
    levels = null.groupBy(*strata, value).agg(F.count("*").alias("__equal"))
    ranges = Ranges(levels, strata, [value])
    names = {c: f"__{i}" for i, c in enumerate([*strata, value])}
    equal = lambda cols: reduce(and_, [F.col(c).eqNullSafe(F.col(names[c])) for c in cols])
    totals = bounded_broadcast(materialize(ranges.rows.groupBy(*strata).agg(F.sum("__equal").alias("__n")).withColumnsRenamed({c: names[c] for c in strata}), "strata-totals"))
    ranked = ranges.close(ranges.running(ranges.rows, "__equal", "__h")).select(*[F.col(c).alias(n) for c, n in names.items()], "__h")
    met = null.join(ranked, equal([*strata, value]), "left").drop(*names.values()).join(totals, equal(strata), "left")
    calibrated = (1 + F.col("__h") - F.col("__own_h")) / (1 + F.col("__n") - F.col("__own_n"))
    return met.withColumn("calibrated", calibrated).drop("__h", "__n", "__own_h", "__own_n", *names.values())


def calibrate_exceedance(df: DataFrame, null: DataFrame, strata=("method", "stratum"), own: str = "test_id") -> DataFrame:
    """Leave-out calibration of statistics: null values at least as large, at least two of them."""
    return calibrate_pooled(df, null, "statistic", list(strata), own, upper=True, least=2)


def quantile_bins(df: DataFrame, value: str, k: int, key: str = "method", out: str = "bin") -> DataFrame:
    """Bin number of a value among its method's unique quantile edges; a single edge gives one bin.

    The edges come from running counts over range partitions (percentiles), k + 1 numbers a key.
    """
    edges = percentiles(df, value, [i / k for i in range(k + 1)], [key], "__e").withColumn("__e", F.array_distinct("__e"))
    inner = F.size(F.filter(F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0))), lambda e: e <= F.col(value)))
    return df.join(bounded_broadcast(materialize(edges, "edges")), key).withColumn(out, F.when(F.size("__e") <= 2, 0).otherwise(inner)).drop("__e")


def calibration_strata(df: DataFrame, stratum: str, own: str, least: int, key: str = "method") -> DataFrame:
    """df with pooled: the stratum, or 'pooled' where it has under `least` different tests."""
    sizes = df.groupBy(key, stratum).agg(F.countDistinct(own).alias("__n"))
    return df.join(sizes, [key, stratum]).withColumn("pooled", F.when(F.col("__n") >= least, F.col(stratum).cast("string")).otherwise("pooled")).drop("__n")


def permutation_pvalue(observed: DataFrame, null: DataFrame, tolerance: float = 1e-9, keys=("test_id",)) -> DataFrame:
    """(1 + null statistics not below the observed one, within a relative tolerance) / (n + 1) for each test."""
    floor_ = F.col("observed") - tolerance * F.greatest(F.lit(1.0), F.abs("observed"))
    joined = observed.select(*keys, F.col("statistic").alias("observed")).join(null.select(*keys, "statistic"), list(keys), "left")
    return joined.groupBy(*keys, "observed").agg(((1 + F.count(F.when(F.col("statistic") >= floor_, 1))) / (1 + F.count("statistic"))).alias("p_value"))


def permutation_ranks(df: DataFrame, null: DataFrame, keys=("method", "test_id"), tolerance: float = 1e-6) -> DataFrame:
    """df with permutation_p_value: (1 + the key's null statistics not below the row's, within a relative tolerance) / (n + 1).

    Running counts over range partitions: rows and null statistics are not paired. Null
    where the key has no null statistic or the row's is not finite.
    """
    x = F.col("statistic")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.withColumn("__at", F.when(finite, x - tolerance * F.greatest(F.lit(1.0), F.abs(x))))
    both = _null_counts(rows, null.where(finite).select(*keys, x.alias("__at")), list(keys), "__at", True, "__h", "__n").where("__null = 0")
    value = F.when(F.col("__at").isNotNull() & (F.col("__n") > 0), (1 + F.col("__h")) / (1 + F.col("__n")))
    return both.withColumn("permutation_p_value", value).drop("__null", "__h", "__n", "__at")


def gated_fdr(df: DataFrame, null: DataFrame, lo: float, hi: float, bins=("depth_bin",), ties=()) -> DataFrame:
    """FDR for methods whose share of null p-values up to .05 lies within the limits, over all and in every bin; null for others."""
    hit = (F.col("p_value") <= 0.05).cast("double")
    checks = null.groupBy("method").agg(F.avg(hit).alias("rate"))
    for b in bins:
        checks = checks.unionByName(null.groupBy("method", b).agg(F.avg(hit).alias("rate")).drop(b))
    passed = checks.groupBy("method").agg(F.bool_and(F.col("rate").between(lo, hi)).alias("passed"))
    return bh_eligible(df.join(bounded_broadcast(materialize(passed, "passed")), "method", "left"), eligible="passed", ties=ties)


def merge_summary(df: DataFrame, null: DataFrame, key: str = "method") -> DataFrame:
    """By method: tests, converged, nominal and FDR discoveries, null rejection at three levels, least and greatest by bin."""
    main = df.groupBy(key).agg(
        F.count("*").alias("tests"), F.count(F.when(F.coalesce("converged", F.lit(False)), 1)).alias("converged"),
        F.count(F.when(F.col("p_value") < 0.05, 1)).alias("nominal"), F.count(F.when(F.col("fdr") < 0.05, 1)).alias("discoveries"),
    )
    rates = null.groupBy(key).agg(*[F.avg((F.col("p_value") <= a).cast("double")).alias(f"null_{str(a)[2:]}") for a in (0.01, 0.05, 0.1)])
    by_bin = null.groupBy(key, "bin").agg(F.avg((F.col("p_value") <= 0.05).cast("double")).alias("r")).groupBy(key).agg(F.min("r").alias("bin_min"), F.max("r").alias("bin_max"))
    return main.join(rates, key, "left").join(by_bin, key, "left")


def simulation_pvalues(df: DataFrame, null: DataFrame, usable: str = "converged") -> DataFrame:
    """Permutation p-values without tolerance, and FDR over usable rows."""
    p = permutation_pvalue(df, null, 0.0)
    return bh_eligible(df.join(p.drop("observed"), "test_id").withColumn("method", F.lit("sim")), eligible=usable, ties=["test_id"]).drop("method")


def select_hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """For each test the first model if it gains in null BIC over the second, else the second; FDR over tests where both converged.

    Both have (test_id, n_samples, null_objective, p_value, converged, n_parameters).
    """
    bic = lambda o, k: 2 * F.col(o) + F.col(k) * F.log("n_samples")
    two = second.select("test_id", *[F.col(c).alias(f"{c}_2") for c in ("null_objective", "p_value", "converged", "n_parameters")])
    joined = first.join(two, "test_id").withColumn("gain", bic("null_objective_2", "n_parameters_2") - bic("null_objective", "n_parameters"))
    out = joined.select("test_id", "gain", F.when(F.col("gain") > 0, "first").otherwise("second").alias("model"), F.when(F.col("gain") > 0, F.col("p_value")).otherwise(F.col("p_value_2")).alias("p_value"), (F.col("converged") & F.col("converged_2")).alias("converged"), F.lit("hybrid").alias("method"))
    return bh_eligible(out, ties=["test_id"]).drop("method")


def normalize_pvalues(df: DataFrame, columns: dict[str, str], method: str, level: float = 0.05, ties=("feature_id",)) -> DataFrame:
    """A comparator's table in the common columns (method, gene_id, feature_id, p_value), with FDR and a flag."""
    out = require_columns(df, columns.values()).select(F.lit(method).alias("method"), *[(F.expr(f"try_cast(`{v}` AS DOUBLE)") if k == "p_value" else F.col(v)).alias(k) for k, v in columns.items()])
    return bh(out, "p_value", ["method"], ties).withColumn("significant", F.coalesce(F.col("fdr") < level, F.lit(False)))


def adapt_comparator(df: DataFrame, names: list[str], parts: list[str], order=()) -> DataFrame:
    """p_value from the first of names that the table has, a composite feature id, and a running number on repeated ids; untestable rows drop out."""
    found = [F.expr(f"try_cast(`{n}` AS DOUBLE)") for n in names if n in df.columns]
    out = df.withColumn("p_value", F.coalesce(*found)).where("p_value IS NOT NULL AND NOT isnan(p_value)")
    out = out.withColumn("__f", F.concat_ws(":", *[F.col(p).cast("string") for p in parts]))
    w = _over("__f")
    k, n = F.row_number().over(w.orderBy(*(order or parts))) - 1, F.count("*").over(w)
    return out.withColumn("feature_id", F.when(n > 1, F.concat_ws("#", "__f", k.cast("string"))).otherwise(F.col("__f"))).drop("__f")


def pairwise_tables(df: DataFrame) -> DataFrame:
    """Converged rows with the contrast A_vs_B split into both levels."""
    kept = df.where(F.coalesce("converged", F.lit(False)))
    pair = F.split("contrast", "_vs_", 2)
    return kept.withColumn("level_a", pair[0]).withColumn("level_b", pair[1])


def discovery_summary(df: DataFrame, omnibus: DataFrame) -> DataFrame:
    """Tests and discoveries by method and effect; cell types are counted after Simes over levels."""
    count = lambda d: d.groupBy("method", "effect").agg(F.count("*").alias("tests"), F.count(F.when(F.col("significant"), 1)).alias("discoveries"))
    return count(df.where("effect <> 'cell_type'")).unionByName(count(omnibus.withColumn("effect", F.lit("cell_type"))))


def reproducibility(folds: DataFrame, level: float = 0.05) -> DataFrame:
    """By method, on genes that all methods and both folds share: discoveries by fold and jointly, replication, rank correlation.

    folds has (method, fold, gene_id, p_value), fold 0 or 1, one row each.
    """
    need = folds.select("method").distinct().crossJoin(folds.select("fold").distinct()).agg(F.count("*").alias("need"))
    shared = folds.groupBy("gene_id").agg(F.countDistinct("method", "fold").alias("have")).crossJoin(F.broadcast(need)).where("have = need")
    rows = folds.join(shared.select("gene_id"), "gene_id", "left_semi")
    wide = rows.groupBy("method", "gene_id").pivot("fold", [0, 1]).agg(F.first("p_value"))
    wide = wide.select("method", "gene_id", F.col("0").alias("p0"), F.col("1").alias("p1")).withColumn("joint", F.greatest("p0", "p1"))
    for p, q in (("p0", "q0"), ("p1", "q1"), ("joint", "qj")):
        wide = bh(wide, p, ["method"], ["gene_id"], q)
    wide = mid_ranks(mid_ranks(materialize(wide, "both-folds"), "p0", ["method"], "r0"), "p1", ["method"], "r1")
    a, b = F.col("q0") < level, F.col("q1") < level
    return wide.groupBy("method").agg(
        F.count("*").alias("genes"), F.count(F.when(a, 1)).alias("found_0"), F.count(F.when(b, 1)).alias("found_1"), F.count(F.when(F.col("qj") < level, 1)).alias("conjunction"),
        F.avg(F.when(a, (F.col("p1") < level).cast("double"))).alias("replication"), F.corr("r0", "r1").alias("spearman"),
    )


def topk_overlap(folds: DataFrame, ks: list[int]) -> DataFrame:
    """Rows (method, k, overlap): share of a method's k best genes of fold 0 that are among the k best of fold 1; k is at most the number of genes."""
    best = folds.withColumn("r", F.row_number().over(_over("method", "fold").orderBy("p_value", "gene_id"))).where(F.col("r") <= max(ks))
    ranked = best.join(folds.groupBy("method", "fold").agg(F.count("*").alias("n")), ["method", "fold"])
    ranked = ranked.select("method", "fold", "gene_id", "r", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("want"))
    kept = ranked.withColumn("k", F.least("want", "n")).where("r <= k")
    both = kept.groupBy("method", "want", "k", "gene_id").agg(F.count("*").alias("c"))
    return both.groupBy("method", "want", "k").agg((F.count(F.when(F.col("c") == 2, 1)) / F.col("k")).alias("overlap"))


def pair_reproducibility(folds: DataFrame, level: float = 0.05) -> DataFrame:
    """reproducibility() after keeping (gene, level pair) hypotheses that all methods and folds share. folds adds level_a, level_b."""
    pair = F.concat_ws("||", F.least("level_a", "level_b"), F.greatest("level_a", "level_b"))
    rows = folds.withColumn("gene_id", F.split("gene_id", r"\.")[0]).withColumn("pair_id", pair)
    need = rows.select("method", "fold").distinct().agg(F.count("*").alias("need"))
    shared = rows.groupBy("gene_id", "pair_id").agg(F.countDistinct("method", "fold").alias("have")).crossJoin(F.broadcast(need)).where("have = need")
    kept = rows.join(shared.select("gene_id", "pair_id"), ["gene_id", "pair_id"], "left_semi")
    return reproducibility(simes(kept, "p_value", ["method", "fold", "gene_id"], wide=True), level)


def compare_discoveries(df: DataFrame, first: str, level: float = 0.05, key: str = "gene_id") -> DataFrame:
    """By method and universe (own, common): tests and discoveries, and the Jaccard index with the first method's discoveries."""
    usable = df.where(F.coalesce("converged", F.lit(False)))
    need = df.select("method").distinct().agg(F.count("*").alias("need"))
    common = usable.groupBy(key).agg(F.countDistinct("method").alias("have")).crossJoin(F.broadcast(need)).where("have = need").select(key)
    rows = usable.withColumn("universe", F.lit("own")).unionByName(usable.join(common, key, "left_semi").withColumn("universe", F.lit("common")))
    called = bh(rows, "p_value", ["method", "universe"], [key]).withColumn("hit", F.col("fdr") < level)
    base = called.where((F.col("method") == first) & F.col("hit")).select("universe", key, F.lit(True).alias("ref"))
    joined = called.join(base, ["universe", key], "left")
    out = joined.groupBy("method", "universe").agg(F.count("*").alias("tests"), F.count(F.when(F.col("hit"), 1)).alias("found"), F.count(F.when(F.col("hit") & F.col("ref"), 1)).alias("both"))
    sizes = base.groupBy("universe").agg(F.count("*").alias("n_ref"))
    return out.join(sizes, "universe", "left").withColumn("jaccard", F.col("both") / F.nullif(F.col("found") + F.coalesce("n_ref", F.lit(0)) - F.col("both"), F.lit(0))).select("method", "universe", "tests", "found", "jaccard")


def compare_coverage(strict: DataFrame, permissive: DataFrame, level: float = 0.05, key: str = "test_id") -> DataFrame:
    """One row: tests in either and both tables, discoveries of each and both, rank correlation on shared tests."""
    joined = strict.select(key, F.col("p_value").alias("a")).join(permissive.select(key, F.col("p_value").alias("b")), key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    joined = materialize(joined.withColumn("__both", both), "both-tables")
    ranked = mid_ranks(mid_ranks(joined, "a", ["__both"], "ra"), "b", ["__both"], "rb")
    return ranked.agg(
        F.count("a").alias("strict"), F.count("b").alias("permissive"), F.count(F.when(both, 1)).alias("shared"),
        F.count(F.when(F.col("a") < level, 1)).alias("found_strict"), F.count(F.when(F.col("b") < level, 1)).alias("found_permissive"), F.count(F.when((F.col("a") < level) & (F.col("b") < level), 1)).alias("found_both"),
        F.corr(F.when(F.col("__both"), F.col("ra")), F.when(F.col("__both"), F.col("rb"))).alias("spearman"),
    )


def coverage_report(strict: DataFrame, permissive: DataFrame, level: float = 0.05, key: str = "test_id") -> DataFrame:
    """One row on two runs of a method (key, p_value, fdr, statistic, converged), one test a row.

    Tests, converged ones, nominal and FDR discoveries of each; tests of both; discoveries
    of the permissive run when the FDR family is the shared, usable tests only;
    discoveries of both and of one alone; rank correlations of p-values and statistics over tests with both p-values.
    """
    columns = ("p_value", "fdr", "statistic", "converged")
    side = lambda t, n: t.select(key, F.lit(True).alias(f"in{n}"), *[F.col(c).alias(f"{c}{n}") for c in columns])
    both = F.col("in1") & F.col("in2")
    usable = lambda n: F.coalesce(F.col(f"converged{n}") & F.col(f"p_value{n}").isNotNull(), F.lit(False))
    joined = side(strict, 1).join(side(permissive, 2), key, "full").withColumns({"both": F.coalesce(both, F.lit(False)), "paired": F.coalesce(both & F.col("p_value1").isNotNull() & F.col("p_value2").isNotNull(), F.lit(False))})
    joined = bh(joined.withColumn("family", F.when(F.col("both") & usable(2), F.col("p_value2"))), "family", ties=[key], out="family_fdr")
    ranked = materialize(joined, "coverage")
    for name in ("p_value1", "p_value2", "statistic1", "statistic2"):
        ranked = mid_ranks(ranked, name, ["paired"], f"rank_{name}")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    hit1, hit2 = F.coalesce(F.col("fdr1") <= level, F.lit(False)), F.coalesce(F.col("fdr2") <= level, F.lit(False))
    of = lambda x: F.when(F.col("paired"), F.col(f"rank_{x}"))
    return ranked.agg(
        n(F.col("in1"), "strict_tests"), n(F.col("in2"), "permissive_tests"), n(F.col("both"), "shared_tests"), n(usable(1), "strict_converged"), n(usable(2), "permissive_converged"),
        n(usable(1) & (F.col("p_value1") <= level), "strict_nominal"), n(usable(2) & (F.col("p_value2") <= level), "permissive_nominal"), n(hit1, "strict_fdr"), n(hit2, "permissive_fdr"),
        n(F.col("family_fdr") <= level, "permissive_shared_family_fdr"), n(F.col("both") & hit1 & hit2, "significant_both"), n(F.col("both") & hit1 & ~hit2, "strict_only_shared"),
        n(F.col("both") & hit2 & ~hit1, "permissive_only_shared"), n(~F.col("both") & hit2, "permissive_only_universe"),
        F.corr(of("p_value1"), of("p_value2")).alias("p_value_spearman"), F.corr(of("statistic1"), of("statistic2")).alias("statistic_spearman"),
    )


def method_overlap(tables: DataFrame, methods: tuple[str, str, str], level: float = 0.05, key: str = "test_id") -> DataFrame:
    """Rows (coverage, both, first_only, second_only, all_three): discoveries that the first two methods share, those of one of them alone, and those of all three.

    tables has (coverage, method, key, fdr); a coverage without discoveries gives zeros.
    """
    hit = lambda m: F.bool_or((F.col("method") == m) & F.coalesce(F.col("fdr") <= level, F.lit(False)))
    flags = tables.groupBy("coverage", key).agg(*[hit(m).alias(n) for m, n in zip(methods, "abc", strict=True)])
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    return flags.groupBy("coverage").agg(n("a AND b", "both"), n("a AND NOT b", "first_only"), n("b AND NOT a", "second_only"), n("a AND b AND c", "all_three"))


def compare_runs(first: DataFrame, second: DataFrame, level: float = 0.05, key: str = "test_id", check: bool = True) -> DataFrame:
    """One row for a pair of runs (key, p_value, converged, seconds): joint convergence, differences, Jaccard index of calls, speed ratio."""
    if check:
        assert_unique(first, key)
        assert_unique(second, key)
    two = second.select(key, F.col("p_value").alias("p2"), F.col("converged").alias("c2"), F.col("seconds").alias("s2"))
    j = first.join(two, key).withColumn("both", F.col("converged") & F.col("c2")).withColumn("d", F.when(F.col("both"), F.abs(F.col("p_value") - F.col("p2"))))
    a, b = F.col("both") & (F.col("p_value") < level), F.col("both") & (F.col("p2") < level)
    return j.agg(
        F.count("*").alias("tests"), F.count(F.when(F.col("both"), 1)).alias("converged"), F.max("d").alias("max_diff"),
        (F.count(F.when(a & b, 1)) / F.nullif(F.count(F.when(a | b, 1)), F.lit(0))).alias("jaccard"), (F.sum("seconds") / F.sum("s2")).alias("speedup"),
    ).join(percentiles(j, "d", [0.5]).select(F.col("quantiles")[0].alias("median_diff")), how="left")


def paired_logratio(counts: DataFrame, pseudocount: float = 0.5, min_subjects: int = 3) -> DataFrame:
    """Rows (feature, n_subjects, n_categories, statistic, p_value): paired test of centred log ratios between two conditions.

    counts has (feature, subject, side 0 or 1, category, n). With two categories the
    statistic is Student's t on the subjects' differences; with more it is Hotelling's,
    solved for one feature at a time with its F tail.
    """
    log = counts.withColumn("x", F.log(F.col("n") + pseudocount))
    clr = log.withColumn("x", F.col("x") - F.avg("x").over(_over("feature", "subject", "side")))
    pairs = clr.groupBy("feature", "subject", "category").agg(F.sum(F.when(F.col("side") == 1, F.col("x"))).alias("a"), F.sum(F.when(F.col("side") == 0, F.col("x"))).alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    sized = pairs.withColumn("k", F.size(F.collect_set("category").over(_over("feature")))).withColumn("m", F.size(F.collect_set("subject").over(_over("feature")))).where(F.col("m") >= min_subjects)
    two = sized.where("k = 2").withColumn("c0", F.min("category").over(_over("feature"))).where("category = c0").groupBy("feature").agg(F.count("*").alias("n_subjects"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n_subjects")))
    two = two.select("feature", "n_subjects", F.lit(2).alias("n_categories"), t.alias("statistic")).withColumn("p_value", t_two_sided(F.col("statistic"), F.col("n_subjects") - 1))
    more = sized.where("k > 2 AND m > k").groupBy("feature").applyInPandas(_hotelling, "feature string, n_subjects long, n_categories int, statistic double, p_value double")
    return two.unionByName(more.select(F.col("feature").cast(two.schema["feature"].dataType).alias("feature"), "n_subjects", "n_categories", "statistic", "p_value"))


def _hotelling(frame: pd.DataFrame) -> pd.DataFrame:
    from introngrid.functions.tails import beta_i

    wide = frame.pivot_table(index="subject", columns="category", values="d").dropna()
    n, k = wide.shape
    x = wide.to_numpy()[:, : k - 1]
    cov = np.cov(x, rowvar=False)
    t2, p = np.nan, np.nan
    if n > k - 1 and np.linalg.matrix_rank(cov) == k - 1:
        m = x.mean(0)
        t2 = float(n * m @ np.linalg.solve(cov, m))
        f = t2 * (n - k + 1) / ((n - 1) * (k - 1))
        d1, d2 = k - 1, n - k + 1
        p = float(beta_i(np.array(d2 / 2), np.array(d1 / 2), np.array(d2 / (d2 + d1 * f))))
    return pd.DataFrame({"feature": [str(frame["feature"].iloc[0])], "n_subjects": [n], "n_categories": [k], "statistic": [t2], "p_value": [p]})


def effective_counts(df: DataFrame) -> DataFrame:
    """Two-path rows (p1, p2, v, umis) with the multinomial size that explains the variance v of the log ratio, at most the UMIs, and path counts."""
    size = F.least((1 / F.nullif("p1", F.lit(0.0)) + 1 / F.nullif("p2", F.lit(0.0))) / F.nullif(2 * F.col("v"), F.lit(0.0)), F.col("umis").cast("double"))
    return df.withColumn("size", size).withColumn("n1", F.col("size") * F.col("p1")).withColumn("n2", F.col("size") * F.col("p2"))


def effective_counts_ilr(df: DataFrame, proportions: str = "p", covariance: str = "cov", maximum: str = "umis") -> DataFrame:
    """df with size, the multinomial size that fits an ILR covariance best, at most `maximum`, and counts, the size shared out by the proportions; any number of paths from two.

    proportions is an array of k positive shares that add up to 1, covariance that of the
    k - 1 coordinates in the Helmert basis, row by row in one array. A multinomial of size
    n has the covariance U / n with U = B' diag(1/p) B; 1 / size is the least-squares factor
    <U, C> / <U, U>. Column j of B is 1/s in rows 0..j and -(j+1)/s in row j+1, s = sqrt((j+1)(j+2)),
    so U follows from running sums of 1/p. Shares or shapes that don't fit, and factors that aren't positive, give null.
    """
    k = F.size(proportions)
    inverse = F.transform(proportions, lambda x: 1 / F.nullif(x, F.lit(0.0)))
    upto = F.aggregate(inverse, F.array().cast("array<double>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0.0)) + x)))
    scale = lambda j: F.sqrt((j + 1) * (j + 2).cast("double"))

    def entry(i: Column, j: Column) -> Column:
        low = F.least(i, j)
        head, next_ = F.get("__upto", low), F.get("__inv", low + 1)
        return (head + F.when(i == j, (low + 1) * (low + 1)).otherwise(-(low + 1)) * next_) / (scale(i) * scale(j))

    steps = F.sequence(F.lit(0), k - 2)
    unit = F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: entry(i, j))))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, a: t + a)
    sums = F.aggregate(proportions, F.lit(0.0), lambda t, x: t + x)
    fits = (k >= 2) & F.forall(proportions, lambda x: x > 0) & (F.abs(sums - 1) <= 1e-5) & (F.size(covariance) == (k - 1) * (k - 1))
    with_unit = df.withColumn("__inv", inverse).withColumn("__upto", upto).withColumn("__unit", F.when(fits, unit))
    factor = dot(F.col("__unit"), F.col(covariance)) / dot(F.col("__unit"), F.col("__unit"))
    sized = with_unit.withColumn("__f", factor).withColumn("size", F.when((F.col("__f") > 0) & (F.col("__f") < float("inf")), F.least(1 / F.col("__f"), F.col(maximum).cast("double"))))
    return sized.withColumn("counts", F.transform(proportions, lambda x: x * F.col("size"))).drop("__inv", "__upto", "__unit", "__f")


def integerize(df: DataFrame, value: str = "x", keys=("sample",), order=("path",)) -> DataFrame:
    """Integers by largest remainder that keep each key's rounded total; ties go by order."""
    w = _over(*keys)
    out = df.withColumn("__f", F.floor(value)).withColumn("__r", F.col(value) - F.col("__f"))
    left = F.rint(F.sum(value).over(w)).cast("long") - F.sum("__f").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("__r"), *order))
    return out.withColumn("count", (F.col("__f") + (rank <= left).cast("long")).cast("long")).drop("__f", "__r")


def multinomial_lrt(counts: DataFrame) -> DataFrame:
    """Rows (feature, statistic, df, p_value): likelihood ratio of level-wise against common proportions.

    counts has (feature, level, category, n). The saturated one-way fit has the levels'
    own proportions, so the ratio is the G statistic.
    """
    cell = counts.groupBy("feature", "level", "category").agg(F.sum("n").cast("double").alias("n"))
    c = cell.withColumn("row", F.sum("n").over(_over("feature", "level"))).withColumn("col", F.sum("n").over(_over("feature", "category"))).withColumn("all", F.sum("n").over(_over("feature")))
    term = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") * F.col("all") / (F.col("row") * F.col("col")))).otherwise(0.0)
    g = c.where("row > 0 AND col > 0").groupBy("feature").agg((2 * F.sum(term)).alias("statistic"), ((F.countDistinct("level") - 1) * (F.countDistinct("category") - 1)).alias("df"))
    return g.withColumn("p_value", chi2_sf(F.greatest("statistic", F.lit(0.0)), F.col("df")))


def weighted_wald(df: DataFrame, tau2: float) -> DataFrame:
    """Rows (feature, statistic, df, p_value): do levels differ in a log ratio y with variances v + tau2?"""
    w = df.withColumn("w", 1 / F.nullif(F.col("v") + tau2, F.lit(0.0)))
    means = w.groupBy("feature", "level").agg(F.sum("w").alias("W"), (F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    grand = F.sum(F.col("W") * F.col("m")).over(_over("feature")) / F.nullif(F.sum("W").over(_over("feature")), F.lit(0.0))
    out = means.withColumn("g", grand).groupBy("feature").agg(F.sum(F.col("W") * (F.col("m") - F.col("g")) ** 2).alias("statistic"), (F.count("*") - 1).alias("df"))
    return out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("df")))


def null_summary(null: DataFrame, key: str = "method") -> DataFrame:
    """By method: share under .05, greatest distance to the uniform distribution, 5 % quantile."""
    ranges = Ranges(null.where("p_value IS NOT NULL").select(key, "p_value"), [key], ["p_value"])
    ranked = ranges.counts(F.lit(True), "r", "n")
    gap = F.greatest(F.col("r") / F.nullif("n", F.lit(0)) - F.col("p_value"), F.col("p_value") - (F.col("r") - 1) / F.nullif("n", F.lit(0)))
    out = ranked.groupBy(key).agg(F.avg((F.col("p_value") < 0.05).cast("double")).alias("rejected"), F.max(gap).alias("ks"))
    return out.join(percentiles(null, "p_value", [0.05], [key]).select(key, F.col("quantiles")[0].alias("quantile_05")), key)


def power_summary(observed: DataFrame, null: DataFrame, keys=("method", "effect_size"), level: float = 0.05) -> DataFrame:
    """By method and effect: tests, power after permutation calibration within a test, median statistic."""
    p = permutation_pvalue(observed, null, 0.0, keys=("test_id",)).drop("observed")
    rows = observed.join(p, "test_id").groupBy(*keys).agg(F.count("*").alias("tests"), F.avg((F.col("p_value") <= level).cast("double")).alias("power"))
    return rows.join(percentiles(observed, "statistic", [0.5], keys).select(*keys, F.col("quantiles")[0].alias("median_statistic")), list(keys), "left")


def _usable() -> Column:
    p = F.col("p_value")
    return F.coalesce(F.col("converged") & p.isNotNull() & ~F.isnan(p), F.lit(False))


def observed_summary(observed: DataFrame, null: DataFrame, level: float = 0.05, ties=("test_id",)) -> DataFrame:
    """By method: tests, converged, nominal discoveries, FDR discoveries, and both again with permutation p-values.

    observed and null have (method, test_id, statistic, p_value, converged). The
    permutation p-value ranks a statistic among the usable null ones of its test and
    method; FDR families are the method's usable tests, and for permutation p-values those that have one.
    """
    ranked = permutation_ranks(observed, null.where(_usable())).withColumn("usable", _usable())
    ranked = ranked.withColumn("ranked", F.col("usable") & F.col("permutation_p_value").isNotNull())
    called = bh_eligible(ranked, eligible="usable", ties=ties)
    called = bh_eligible(called, "permutation_p_value", eligible="ranked", ties=ties, out="permutation_fdr")
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return called.groupBy("method").agg(
        F.count("*").alias("tests"), n(F.col("usable"), "converged"), n(F.col("usable") & (F.col("p_value") < level), "nominal"), n(F.col("fdr") <= level, "discoveries"),
        n(F.col("ranked") & (F.col("permutation_p_value") <= level), "permutation_nominal"), n(F.col("permutation_fdr") <= level, "permutation_discoveries"),
    )


def null_fits(null: DataFrame) -> DataFrame:
    """By method: null fits, converged ones, their share of p-values under .05 and 5 % quantile of p-values."""
    main = null.withColumn("usable", _usable()).groupBy("method").agg(F.count("*").alias("fits"), F.count(F.when(F.col("usable"), 1)).alias("converged"), F.avg(F.when(F.col("usable"), (F.col("p_value") < 0.05).cast("double"))).alias("rejected"))
    at = percentiles(null.where(_usable()), "p_value", [0.05], ["method"]).select("method", F.col("quantiles")[0].alias("quantile_05"))
    return main.join(at, "method", "left")


def power_report(power: DataFrame, null: DataFrame, level: float = 0.05) -> DataFrame:
    """By method and effect size: fits, converged, power of the asymptotic p-value and of the permutation p-value among usable fits (null without any)."""
    ranked = permutation_ranks(power, null.where(_usable())).withColumn("usable", _usable())
    share = lambda cond, hit: F.avg(F.when(cond, hit.cast("double")))
    return ranked.groupBy("method", "effect_size").agg(
        F.count("*").alias("fits"), F.count(F.when(F.col("usable"), 1)).alias("converged"), share(F.col("usable"), F.col("p_value") < level).alias("asymptotic_power"),
        share(F.col("usable") & F.col("permutation_p_value").isNotNull(), F.col("permutation_p_value") <= level).alias("calibrated_power"),
    )


def merge_shards_summary(shards: DataFrame, key: str = "method") -> DataFrame:
    """Shard rows (method, n, rate) as one rate weighted by n."""
    return shards.groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("rate")) / F.nullif(F.sum("n"), F.lit(0))).alias("rate"))


def finite_summary(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Number, mean, median, 10 % and 90 % quantile of finite values."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    main = good.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    at = percentiles(good, value, [0.5, 0.1, 0.9], keys)
    return (main.join(at, list(keys), "left") if keys else main.join(at, how="left")).select("*", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "q10", "q90"))]).drop("quantiles")


def match_estimates(first: DataFrame, second: DataFrame, keys=("block_id", "sample"), metadata=("condition",), min_subjects: int = 2, check: bool = True) -> DataFrame:
    """Rows that both tables have, if their metadata agree, of blocks with enough subjects in every level."""
    from introngrid.schema import assert_none

    two = second.select(*keys, F.col("value").alias("value_2"), *[F.col(m).alias(f"{m}_2") for m in metadata])
    joined = first.join(two, list(keys))
    if check:
        assert_none(joined.where(" OR ".join(f"NOT ({m} <=> {m}_2)" for m in metadata)), "metadata of the two tables differ")
    levels = joined.groupBy("block_id", *metadata).agg(F.countDistinct("subject").alias("s")).where(F.col("s") >= min_subjects)
    good = levels.groupBy("block_id").agg(F.count("*").alias("n")).where("n >= 2")
    return joined.join(levels, ["block_id", *metadata], "left_semi").join(good, "block_id", "left_semi").drop(*[f"{m}_2" for m in metadata])


def seconds_of(text: str) -> Column:
    """Seconds of [days-]hours:minutes:seconds."""
    part = lambda k: F.coalesce(F.expr(f"try_cast(regexp_extract({text}, '^(?:([0-9]+)-)?([0-9]+):([0-9]+):([0-9]+)', {k}) AS DOUBLE)"), F.lit(0.0))
    return part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def gib_of(text: str) -> Column:
    """GiB of a number with K, M, G or T."""
    number = F.expr(f"try_cast(regexp_extract({text}, '^([0-9.]+)', 1) AS DOUBLE)")
    unit = F.regexp_extract(text, r"([KMGT])", 1)
    return number * F.when(unit == "K", 1 / 1024**2).when(unit == "M", 1 / 1024).when(unit == "T", 1024.0).otherwise(1.0)


def resource_summary(jobs: DataFrame, key: str = "campaign") -> DataFrame:
    """By campaign: tasks, hours, median and 90 % minutes, peak GiB, and span in hours. jobs has (campaign, elapsed, memory, started, ended)."""
    j = jobs.withColumn("s", seconds_of("elapsed")).withColumn("g", gib_of("memory"))
    at = lambda c: F.unix_timestamp(F.to_timestamp(c))
    main = j.groupBy(key).agg(F.count("*").alias("tasks"), (F.sum("s") / 3600).alias("hours"), F.max("g").alias("peak_gib"), ((F.max(at("ended")) - F.min(at("started"))) / 3600).alias("span_hours"))
    minutes = percentiles(j, "s", [0.5, 0.9], [key]).select(key, (F.col("quantiles")[0] / 60).alias("median_min"), (F.col("quantiles")[1] / 60).alias("p90_min"))
    return main.join(minutes, key, "left")


def select_candidate(fits: DataFrame, rule: str = "minimum", retain: float = 0.9, keys=("run",)) -> DataFrame:
    """One candidate of each run: least loss, or the strongest penalty within one standard error, also with enough variance kept.

    fits has (run, strength, loss, se, variance, converged, degenerate).
    """
    ok = fits.where(F.coalesce("converged", F.lit(False)) & ~F.coalesce("degenerate", F.lit(False)))
    best = ok.groupBy(*keys).agg(F.min_by(F.struct("loss", "se", "variance"), F.struct("loss", "strength")).alias("b"))
    joined = ok.join(best, list(keys))
    if rule == "minimum":
        order = [F.asc("loss"), F.asc("strength")]
    else:
        joined = joined.where(F.col("loss") <= F.col("b.loss") + F.col("b.se"))
        if rule == "one_se_variance":
            joined = joined.where(F.col("variance") >= retain * F.col("b.variance"))
        order = [F.desc("strength"), F.asc("loss")]
    return joined.withColumn("__r", F.row_number().over(_over(*keys).orderBy(*order))).where("__r = 1").drop("__r", "b")


def combine_scores(tables: list[DataFrame], key: str = "fit") -> DataFrame:
    """One row per fit with the union of columns; failed rows drop out and a fit in two tables is an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return assert_unique(out.where(F.coalesce(F.col("status") == "ok", F.lit(False))), key)


def replicate_summary(df: DataFrame) -> DataFrame:
    """By family, method and effect: rejection over the null's 95 % threshold, bias, RMSE, convergence, median statistic.

    df has (family, method, effect, statistic, estimate, converged); effect 0 is the null.
    """
    limit = percentiles(df.where("effect = 0"), "statistic", [0.95], ["family", "method"]).select("family", "method", F.col("quantiles")[0].alias("limit"))
    err = F.col("estimate") - F.col("effect")
    rows = df.join(limit, ["family", "method"]).groupBy("family", "method", "effect").agg(
        F.avg((F.col("statistic") > F.col("limit")).cast("double")).alias("rejected"), F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.col("converged").cast("double")).alias("converged"),
    )
    medians = percentiles(df, "statistic", [0.5], ["family", "method", "effect"])
    return rows.join(medians, ["family", "method", "effect"], "left").withColumn("median_statistic", F.col("quantiles")[0]).drop("quantiles")
