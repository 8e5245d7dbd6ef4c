"""Normalization, quantification and sparse projection of long count tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.functions.tiles import by_tiles, matrix
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C
from introngrid.schema import assert_no_conflict, assert_none, assert_unique, require_columns
from introngrid.storage import bounded_broadcast, gather, materialize, release, shares


def over(*keys: str):
    return Window.partitionBy(*keys)


def bare(name: str) -> Column:
    """An id without its version."""
    return F.split(F.col(name), r"\.")[0]


def key_of(items: str) -> Column:
    """A canonical text of a set of ids."""
    return F.array_join(F.array_sort(F.collect_set(items)), ",")


# Q01-Q05: bulk samples


def normalize_junction(quant: DataFrame, read_length: float = 100, overhang: float = 2, paired: bool = True, sizing: float = 1.0) -> DataFrame:
    """Rows (sample, tx_id, value): reads scaled to what junctions would see; only transcripts with TPM over 0. An effective length of 0 gives null."""
    scale = (read_length - overhang) * (2 if paired else 1) * sizing
    return quant.where("tpm > 0").select("sample", "tx_id", (F.col("num_reads").cast("double") * F.lit(float(scale)) / F.nullif("effective_length", F.lit(0))).alias("value"))


def normalize_global(quant: DataFrame) -> DataFrame:
    """TPM scaled so that a sample's values add up to its reads; null where a sample has no TPM."""
    return quant.select("sample", "tx_id", (F.col("tpm") * F.sum("num_reads").over(over("sample")) / F.nullif(F.sum("tpm").over(over("sample")), F.lit(0))).alias("value"))


def normalize_local(quant: DataFrame, genes: DataFrame) -> DataFrame:
    """TPM's share inside a gene and sample, times the gene's reads there."""
    joined = quant.join(genes, "tx_id")
    share = F.col("tpm") / F.nullif(F.sum("tpm").over(over("sample", "gene_id")), F.lit(0))
    return joined.select("sample", "tx_id", "gene_id", F.coalesce(share * F.sum("num_reads").over(over("sample", "gene_id")), F.lit(0.0)).alias("value"))


def count_features(values: DataFrame, support: DataFrame, cutoff: float = 0.0, together: bool = False) -> DataFrame:
    """Rows (feature, sample, value): what the transcripts above cutoff give to each intron or exon.

    With together rows move by feature alone, so that what goes by feature afterwards needs no further shuffle.
    """
    given = values.where(F.col("value") > cutoff).join(support.select("tx_id", "feature"), "tx_id")
    if together:
        given = gather(given, "feature")
    return given.groupBy("feature", "sample").agg(F.sum("value").alias("value"))


def unmapped_transcripts(values: DataFrame, support: DataFrame) -> DataFrame:
    return values.select("tx_id").distinct().join(support.select("tx_id"), "tx_id", "left_anti")


# Q06-Q17: pseudobulks


def project_counts(values: DataFrame, edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rows (feature, sample, value) of features whose total is over threshold; transcript ids match without version.

    Totals are compared to nine decimals, so one at the threshold doesn't depend on the order in which doubles were added.
    """
    joined = values.withColumn("tx_id", bare("tx_id")).join(edges.select(bare("tx_id").alias("tx_id"), "feature").distinct(), "tx_id")
    sums = joined.groupBy("feature", "sample").agg(F.sum("value").alias("value"))
    return sums.withColumn("__t", F.round(F.sum("value").over(over("feature")), 9)).where(F.col("__t") > threshold).drop("__t")


def clean_labels(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.regexp_replace(F.col(name).cast("string"), " ", "_"))


def metacells(barcodes: DataFrame, n: int, seed: int = 0, label: str = "cell_type", cell: str = "cell_id", order: Column | None = None) -> DataFrame:
    """Rows (cell, label, metacell): cells of a label in shuffled blocks of n; the remainder drops out."""
    rank = F.row_number().over(over(label).orderBy(order if order is not None else F.xxhash64(cell, F.lit(seed)), cell)) - 1
    block = F.floor(rank / n)
    ranked = barcodes.select(cell, label, block.alias("__b"), F.count("*").over(over(label)).alias("__n"))
    return ranked.where(F.col("__b") < F.floor(F.col("__n") / n)).select(cell, label, F.concat_ws("_", label, F.col("__b").cast("string")).alias("metacell"))


def bootstrap_groups(barcodes: DataFrame, n: int, k: int, seed: int = 0, label: str = "cell_type", cell: str = "cell_id", pick: Column | None = None) -> DataFrame:
    """Rows (label, round, draw, cell): k rounds of n draws with replacement of each label with at least n cells.

    A draw takes the cell whose place among the label's cells is pick, a number from label, round and draw (a seeded hash of them if None), modulo their number.
    """
    ranked = barcodes.select(cell, label, (F.row_number().over(over(label).orderBy(cell)) - 1).alias("__i"), F.count("*").over(over(label)).alias("__n"))
    sizes = ranked.groupBy(label).agg(F.first("__n").alias("__n")).where(F.col("__n") >= n)
    draws = sizes.select(label, "__n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("round")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    draws = draws.withColumn("__i", F.pmod(pick if pick is not None else F.xxhash64(label, "round", "draw", F.lit(seed)), F.col("__n")).cast("int")).drop("__n")
    return draws.join(ranked.drop("__n"), [label, "__i"]).select(label, "round", "draw", cell)


def check_barcodes(groups: DataFrame, known: DataFrame, cell: str = "cell_id", group: str = "grp") -> DataFrame:
    """Rows (group, n_valid, n_lost): how many of a pseudobulk's barcodes are in the data."""
    flagged = groups.join(known.select(cell).distinct().withColumn("__k", F.lit(1)), cell, "left")
    return flagged.groupBy(group).agg(F.count("__k").alias("n_valid"), F.count(F.when(F.col("__k").isNull(), 1)).alias("n_lost"))


def eliminated_barcodes(groups: DataFrame, known: DataFrame, cell: str = "cell_id") -> DataFrame:
    return groups.select(cell).distinct().join(known.select(cell), cell, "left_anti")


def aggregate_groups(counts: DataFrame, groups: DataFrame, cell: str = "cell_id", group: str = "grp", col: str = "ec_id", value: str = "n") -> DataFrame:
    """Rows (group, col, value): sums over a group's cells; a repeated (cell, group) pair counts once."""
    return counts.join(groups.select(cell, group).distinct(), cell).groupBy(group, col).agg(F.sum(value).alias(value))


def eligible_groups(groups: DataFrame, totals: DataFrame, pairs: DataFrame, min_cells: int, min_umis: int) -> DataFrame:
    """Groups with enough cells and UMIs; a cell's UMIs are those of its halves, listed by pairs (cell_id, half)."""
    cells = pairs.join(totals.select(F.col("cell_id").alias("half"), "umis"), "half").groupBy("cell_id").agg(F.sum("umis").alias("umis"))
    summed = groups.join(cells, "cell_id").groupBy("grp").agg(F.count("*").alias("cells"), F.sum("umis").alias("umis"))
    return summed.where((F.col("cells") >= min_cells) & (F.col("umis") >= min_umis))


def filter_support(counts: DataFrame, membership: DataFrame, min_ec: float, min_tx: float, value: str = "n") -> DataFrame:
    """Membership edges whose class has at least min_ec counts and whose transcript, over these, more than min_tx."""
    ec = counts.groupBy("ec_id").agg(F.sum(value).alias("__e")).where(F.col("__e") >= min_ec)
    kept = membership.join(ec, "ec_id")
    tx = kept.groupBy("tx_id").agg(F.sum("__e").alias("__t")).where(F.col("__t") > min_tx)
    return kept.join(tx, "tx_id", "left_semi").select("ec_id", "tx_id")


def feature_weights(lengths: DataFrame, mean: float = 300.0) -> DataFrame:
    """1 / (length - mean) for longer transcripts, else 1 / length, null for length 0."""
    return lengths.select("tx_id", F.when(F.col("length") > mean, 1 / (F.col("length") - mean)).otherwise(1 / F.nullif("length", F.lit(0))).alias("w"))


def em_abundance(counts: DataFrame, membership: DataFrame, weights: DataFrame, iterations: int = 30, offset: float = 1e-7, cut_every: int = 5) -> DataFrame:
    """Rows (sample, tx_id, alpha) after fixed rounds of alpha * w / sum over the class, shared out by the class's counts and renormalised.

    counts has (sample, ec_id, n). Every kept class gets the offset in every sample, so the
    grid is samples times kept classes. A class whose weights are all 0 gives nothing. The growing plan is cut by a written table every few rounds.
    """
    design = membership.join(weights, "tx_id").select("ec_id", "tx_id", "w")
    kept = design.select("ec_id").distinct()
    samples = bounded_broadcast(materialize(counts.select("sample").distinct(), "samples"))
    grid = kept.crossJoin(samples).join(counts.groupBy("sample", "ec_id").agg(F.sum("n").alias("n")), ["sample", "ec_id"], "left")
    grid = materialize(grid.select("sample", "ec_id", (F.coalesce(F.col("n").cast("double"), F.lit(0.0)) + offset).alias("n")), "grid")
    edges = materialize(grid.join(design, "ec_id"), "em-edges")
    n_tx = design.select("tx_id").distinct().count()
    alpha = design.select("tx_id").distinct().crossJoin(samples).select("sample", "tx_id", F.lit(1.0 / max(n_tx, 1)).alias("alpha"))
    held = None
    for i in range(iterations):
        part = edges.join(alpha, ["sample", "tx_id"]).withColumn("__x", F.col("alpha") * F.col("w"))
        part = part.withColumn("__x", F.coalesce(F.col("__x") / F.nullif(F.sum("__x").over(over("sample", "ec_id")), F.lit(0)) * F.col("n"), F.lit(0.0)))
        raw = part.groupBy("sample", "tx_id").agg(F.sum("__x").alias("__a"))
        alpha = raw.select("sample", "tx_id", F.coalesce(F.col("__a") / F.nullif(F.sum("__a").over(over("sample")), F.lit(0)), F.lit(0.0)).alias("alpha"))
        if i + 1 < iterations and (i + 1) % cut_every == 0:
            alpha = materialize(alpha, "alpha")
            if held is not None:
                release(held)
            held = alpha
    return alpha


def abundance_to_counts(alpha: DataFrame, totals: DataFrame, lengths: DataFrame | None = None, mode: str = "global", read_length: float = 100, overhang: float = 2) -> DataFrame:
    """Rows (sample, tx_id, tpm, count): alpha closed to a million, and counts by mode (global, junction, or snRNA without unspliced ids)."""
    if mode == "snRNA":
        alpha = alpha.where(~F.col("tx_id").cast("string").contains("-I"))
    share = F.col("alpha") / F.nullif(F.sum("alpha").over(over("sample")), F.lit(0))
    out = alpha.withColumn("tpm", share * 1e6).join(totals, "sample").withColumn("count", share * F.col("total"))
    if mode == "junction":
        out = out.join(lengths, "tx_id").withColumn("count", F.col("count") * (read_length - overhang) / F.nullif("length", F.lit(0)))
    return out.select("sample", "tx_id", "tpm", "count")


def drop_small(df: DataFrame, value: str = "count", least: float = 0.1) -> DataFrame:
    return df.where((F.col(value) >= least) & ~F.col("tx_id").cast("string").contains("-I"))


# Q18-Q25: equivalence-class designs


def ec_design_legacy(membership: DataFrame, usage: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Rows (ec_id, tx_id, a): usage over length (phi) with lengths, else usage (theta)."""
    out = membership.join(usage, "tx_id")
    return out.join(lengths, "tx_id").select("ec_id", "tx_id", (F.col("u") / F.nullif("length", F.lit(0))).alias("a")) if lengths is not None else out.select("ec_id", "tx_id", F.col("u").alias("a"))


def normalize_columns(df: DataFrame, col: str = "tx_id", value: str = "a", extra=()) -> DataFrame:
    return df.withColumn(value, F.col(value) / F.nullif(F.sum(value).over(over(col, *extra)), F.lit(0)))


def normalize_rows(df: DataFrame, row: str = "cell_id", value: str = "n") -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value) / F.nullif(F.sum(value).over(over(row)), F.lit(0)), F.lit(0.0)))


def ec_design_weighted(membership: DataFrame, probabilities: DataFrame, keys=()) -> DataFrame:
    """Rows (keys, ec_id, tx_id, a): the mean probability of each class and position, uniform where none was seen, column-normalised.

    membership has (ec_id, pos, tx_id), probabilities (keys, ec_id, pos, prob).
    """
    mean = probabilities.groupBy(*keys, "ec_id", "pos").agg(F.avg("prob").alias("p"))
    sized = membership.withColumn("k", F.count("*").over(over("ec_id")))
    if keys:
        sized = sized.crossJoin(bounded_broadcast(materialize(probabilities.select(*keys).distinct(), "groups")))
    out = sized.join(mean, [*keys, "ec_id", "pos"], "left").withColumn("a", F.coalesce("p", 1 / F.col("k")))
    return normalize_columns(out.select(*keys, "ec_id", "tx_id", "a"), extra=keys)


def ec_design_grouped(membership: DataFrame, probabilities: DataFrame, group: str = "cell_type") -> DataFrame:
    """The design over all cells (group null) and for each group, from one grouping-sets pass."""
    both = probabilities.groupingSets([[group, "ec_id", "pos"], ["ec_id", "pos"]], group, "ec_id", "pos").agg(F.avg("prob").alias("p"))
    groups = probabilities.select(group).distinct().unionByName(probabilities.select(F.lit(None).cast("string").alias(group)).limit(1))
    sized = membership.withColumn("k", F.count("*").over(over("ec_id"))).crossJoin(bounded_broadcast(materialize(groups.withColumnRenamed(group, "__g"), "groups")))
    same = (F.col("__g").eqNullSafe(F.col(group))) & (sized["ec_id"] == both["ec_id"]) & (sized["pos"] == both["pos"])
    out = sized.join(both, same, "left").select(F.col("__g").alias(group), sized["ec_id"], "tx_id", F.coalesce("p", 1 / F.col("k")).alias("a"))
    return out.withColumn("a", F.col("a") / F.nullif(F.sum("a").over(over(group, "tx_id")), F.lit(0)))


def ec_design_positional(membership: DataFrame, rich: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (ec_id, tx_id, a, matched): rich weights by transcript set, count-weighted over runs, else the inverse effective length.

    rich has (run, key, tx_id, weight, count) with key the canonical text of the set.
    """
    keys = membership.groupBy("ec_id").agg(key_of("tx_id").alias("key"))
    known = rich.groupBy("key", "tx_id").agg((F.sum(F.col("weight") * F.col("count")) / F.nullif(F.sum("count"), F.lit(0))).alias("__w"))
    out = membership.join(keys, "ec_id").join(known, ["key", "tx_id"], "left").join(lengths, "tx_id")
    out = out.select("ec_id", "tx_id", F.coalesce("__w", 1 / F.greatest("length", F.lit(1.0))).alias("a"), F.col("__w").isNotNull().alias("matched"))
    return normalize_columns(out)


def effective_lengths(runs: DataFrame) -> DataFrame:
    """Rows (tx_id, length): the mean of effective lengths over runs, weighted by mapped reads, at least 1."""
    return runs.groupBy("tx_id").agg(F.greatest(F.sum(F.col("reads") * F.col("effective_length")) / F.nullif(F.sum("reads"), F.lit(0)), F.lit(1.0)).alias("length"))


def ec_gene(membership: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (ec_id, gene_id) of classes whose transcripts all map to one gene."""
    joined = membership.join(genes, "tx_id", "left").groupBy("ec_id").agg(F.countDistinct("gene_id").alias("g"), F.count("*").alias("n"), F.count("gene_id").alias("k"), F.min("gene_id").alias("gene_id"))
    return joined.where("g = 1 AND n = k").select("ec_id", "gene_id")


def gene_counts(counts: DataFrame, ec_genes: DataFrame) -> DataFrame:
    return counts.join(ec_genes, "ec_id").groupBy("cell_id", "gene_id").agg(F.sum("n").alias("n"))


def modeled_gene_umis(counts: DataFrame, ec_genes: DataFrame, supported: DataFrame) -> DataFrame:
    """Gene UMIs from classes that the design supports for the gene; supported has (ec_id, gene_id)."""
    usable = ec_genes.join(supported.distinct(), ["ec_id", "gene_id"], "left_semi")
    return counts.join(usable, "ec_id").groupBy("cell_id", "gene_id").agg(F.sum("n").alias("umis"))


# Q28-Q34: paired half cells and folds


def primer_pairs(barcodes: DataFrame, rt: DataFrame) -> DataFrame:
    """Rows (cell_id, first, second): a barcode's suffix in the RT list names both halves; two fitting suffixes are an error.

    rt has (first, second), the suffixes of the two primers.
    """
    lengths = sorted(r[0] for r in rt.select(F.length("first")).distinct().collect())  # as many as a suffix has characters, at most
    ends = barcodes.select("cell_id", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n"))
    ends = ends.where(F.length("cell_id") >= F.col("n")).select("cell_id", F.right("cell_id", F.col("n")).alias("first"), F.expr("substr(cell_id, 1, length(cell_id) - n)").alias("__p"))
    found = ends.join(rt, "first").select("cell_id", F.concat("__p", "first").alias("first"), F.concat("__p", "second").alias("second"))
    assert_none(found.groupBy("cell_id").count().where("count > 1"), "a barcode fits several RT suffixes")
    return found


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (cell_id, first, second); a half in two cells, or two pairs of a cell, are errors."""
    pairs = require_columns(pairs, ["cell_id", "first", "second"]).select("cell_id", "first", "second").distinct()
    halves = pairs.select("cell_id", F.explode(F.array("first", "second")).alias("half"))
    assert_no_conflict(halves, "half", "cell_id")
    return assert_no_conflict(pairs, "cell_id", "first", "second")


def complete_pairs(pairs: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """Pairs whose halves both have at least `least` UMIs; totals has (half, umis)."""
    half = lambda name: totals.select(F.col("half").alias(name), F.col("umis").alias(f"{name}_umis")).where(F.col("umis") >= least)
    return pairs.join(half("first"), "first").join(half("second"), "second").select("cell_id", "first", "second", "first_umis", "second_umis")


def paired_response(counts: DataFrame) -> DataFrame:
    """counts (cell_id, primer, col, n) with value 0.5 * n / sum over the cell's half."""
    return counts.withColumn("value", 0.5 * F.col("n") / F.nullif(F.sum("n").over(over("cell_id", "primer")), F.lit(0)))


def paired_response_gene_aux(counts: DataFrame, genes: DataFrame, weight: float) -> DataFrame:
    """The paired response, with the cells' gene shares (genes: cell_id, gene_id, n) appended at scale 0.5 * sqrt(weight)."""
    main = paired_response(counts).select("cell_id", "primer", F.col("col").cast("string").alias("col"), "value")
    share = 0.5 * (weight**0.5) * F.col("n") / F.nullif(F.sum("n").over(over("cell_id")), F.lit(0))
    return main.unionByName(genes.select("cell_id", F.lit("gene").alias("primer"), F.col("gene_id").cast("string").alias("col"), share.alias("value")))


def sample_cells(totals: DataFrame, min_count: int, n: int | None = None, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Cells with at least min_count; with n, that many of them, the first by order (a seeded hash if None)."""
    kept = totals.where(F.col("n") >= min_count)
    return kept.orderBy(order if order is not None else F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(n) if n else kept


def count_folds(counts: DataFrame, k: int, seed: int = 0, row: str = "cell_id", col: str = "ec_id", value: str = "n") -> DataFrame:
    """Rows (row, col, fold, value): each counted molecule falls in one of k folds, so the folds add back."""
    single = counts.select(row, col, F.explode(F.sequence(F.lit(1).cast("long"), F.col(value))).alias("__i"))
    return single.groupBy(row, col, F.pmod(F.xxhash64(row, col, "__i", F.lit(seed)), F.lit(k)).cast("int").alias("fold")).agg(F.count("*").alias(value))


# Q35-Q42: runs, reads and designs compared


def merge_runs(counts: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows (cell, ec, n) of all runs: classes are named by their set of transcripts, cells by run:barcode.

    counts has (run, cell_id, ec_id, n), membership (run, ec_id, tx_id).
    """
    keys = membership.groupBy("run", "ec_id").agg(key_of("tx_id").alias("ec"))
    joined = counts.join(keys, ["run", "ec_id"])
    return joined.groupBy(F.concat_ws(":", "run", F.col("cell_id").cast("string")).alias("cell"), "ec").agg(F.sum("n").alias("n"))


class MergedRuns(NamedTuple):
    """Tables of merged runs: features (tx, feature), classes (ec, txs), cells (cell, name), counts (cell, ec, n), probabilities (cell, ec, umi_rank, probs)."""

    features: DataFrame
    classes: DataFrame
    cells: DataFrame
    counts: DataFrame
    probabilities: DataFrame


def merge_quantifications(runs: DataFrame, features: DataFrame, membership: DataFrame, cells: DataFrame, counts: DataFrame, probabilities: DataFrame) -> MergedRuns:
    """Runs in one numbering of transcripts, classes and cells, each from 0 in order of first appearance.

    runs (run, ord) names the order; features (run, idx, feature); membership (run, ec_id,
    pos, idx), pos the place in the class; cells (run, idx, barcode); counts (run, cell,
    ec_id, n); probabilities (run, cell, ec_id, umi_rank, probs), probs by place in the
    run's class. Classes are one where their sets of transcripts are. A merged class has its transcripts
    in global order, so each run's probabilities are permuted from the run's own order. Numbers come from range partitions
    (dense_ids), not from a table on the driver.

    Errors: a repeated run or order, probabilities of another length than their class, or of no class.
    """
    assert_unique(runs, "run")
    assert_unique(runs, "ord")
    placed = F.broadcast(runs.select("run", "ord"))  # a list of inputs
    named = features.join(placed, "run").select("run", F.col("idx").alias("fidx"), "feature", F.struct("ord", "idx").alias("place"))
    first = named.groupBy("feature").agg(F.min("place").alias("place"))
    tx = materialize(first.join(A.dense_ids(first, "place", "tx"), "place").select("feature", "tx"), "tx-ids")
    local = named.join(tx, "feature").select("run", "fidx", "tx")
    members = membership.join(local, (membership["run"] == local["run"]) & (membership["idx"] == local["fidx"])).select(membership["run"], "ec_id", "pos", "tx")
    sets = members.groupBy("run", "ec_id").agg(F.array_sort(F.collect_list(F.struct("tx", "pos"))).alias("m"))
    sets = materialize(sets.join(placed, "run").select("run", "ord", "ec_id", F.col("m.tx").alias("txs"), F.col("m.pos").alias("order")), "class-sets")
    first = sets.groupBy("txs").agg(F.min(F.struct("ord", "ec_id")).alias("place"))
    classes = materialize(first.join(A.dense_ids(first, "place", "ec"), "place").select("ec", "txs"), "classes")
    told = materialize(sets.join(classes, "txs").select("run", "ec_id", "ec", "order"), "class-ids")
    at = cells.join(placed, "run").select("run", F.col("idx").alias("cidx"), F.concat_ws(":", "run", "barcode").alias("name"), F.struct("ord", "idx").alias("place"))
    at = materialize(at.join(A.dense_ids(at, "place", "cell"), "place").select("run", "cidx", "name", F.col("cell").alias("__cell")), "cells")

    def moved(t: DataFrame) -> DataFrame:
        t = t.withColumnRenamed("cell", "cidx").join(told, ["run", "ec_id"], "left")
        return t.join(at.drop("name"), ["run", "cidx"]).withColumnRenamed("__cell", "cell")

    probs = moved(probabilities)
    assert_none(probs.where(F.col("ec").isNull() | (F.size("probs") != F.size("order"))), "probabilities don't fit their class")
    ordered = F.transform("order", lambda p: F.get("probs", p.cast("int")))
    summed = moved(counts).where("ec IS NOT NULL").groupBy("cell", "ec").agg(F.sum("n").alias("n"))
    return MergedRuns(tx.select("tx", "feature"), classes, at.select(F.col("__cell").alias("cell"), "name"), summed, probs.select("cell", "ec", "umi_rank", ordered.alias("probs")))


def quantification_report(cells: DataFrame, features: DataFrame, counts: DataFrame, membership: DataFrame, reference: DataFrame | None = None, pairs: DataFrame | None = None, prefixes=(), min_umis: float = 500, min_overlap: int = 1, max_total: float | None = None) -> DataFrame:
    """One row on a merged quantification that passed its checks.

    cells (cell_id) and features (feature) must be unique, counts (cell_id, ec_id, n) and
    membership (ec_id, tx_id) not negative or empty, every expected prefix (what stands before the
    first colon of a cell id) seen, the total at most max_total, at least one cell of
    min_umis, min_overlap ids of reference (cell_id) known and one of pairs (first, second)
    whole; whatever fails is an error.
    """
    assert_unique(cells, "cell_id")
    assert_unique(features, "feature")
    assert_none(counts.where("n < 0"), "negative counts")
    seen = cells.where(F.col("cell_id").contains(":")).select(F.substring_index("cell_id", ":", 1).alias("prefix")).distinct()
    missing = cells.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(prefixes)], "prefix string").join(seen, "prefix", "left_anti")
    assert_none(missing, "expected prefixes of cells are missing")
    totals = counts.groupBy("cell_id").agg(F.sum("n").alias("umis"))
    n = lambda t, name: t.agg(F.count("*").alias(name))
    row = n(cells, "cells").crossJoin(n(features, "features")).crossJoin(n(membership.select("ec_id").distinct(), "classes")).crossJoin(n(membership, "compatibilities"))
    row = row.crossJoin(counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("nonzeros"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("molecules")))
    row = row.crossJoin(totals.agg(F.count(F.when(F.col("umis") >= min_umis, 1)).alias("eligible"))).crossJoin(n(seen, "prefixes"))
    row = row.crossJoin(n(reference.select("cell_id").distinct().join(cells, "cell_id", "left_semi"), "overlap")) if reference is not None else row.withColumn("overlap", F.lit(0).cast("long"))
    if pairs is not None:
        known = lambda t, c: t.join(cells.select(F.col("cell_id").alias(c)), c, "left_semi")
        row = row.crossJoin(n(pairs, "pairs")).crossJoin(n(known(known(pairs, "first"), "second"), "complete"))
    row = materialize(row, "report")
    assert_none(row.where("nonzeros = 0 OR compatibilities = 0"), "the quantification is empty")
    assert_none(row.where("eligible = 0"), f"no cell has at least {min_umis:g} UMIs")
    if max_total is not None:
        assert_none(row.where(F.col("molecules") > max_total), f"more than {max_total:g} molecules")
    if reference is not None:
        assert_none(row.where(F.col("overlap") < min_overlap), "too few reference ids are known")
    if pairs is not None:
        assert_none(row.where("complete = 0"), "no pair is whole")
    return row


def validate_quantification(counts: DataFrame, pairs: DataFrame, min_umis: int) -> DataFrame:
    """One row of checks: cells, classes, total, negative values, cells with enough UMIs, overlap with the pairs and complete pairs."""
    totals = counts.groupBy("cell_id").agg(F.sum("n").alias("umis"))
    main = counts.agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("ec_id").alias("classes"), F.sum("n").alias("total"), F.count(F.when(F.col("n") < 0, 1)).alias("negative"))
    enough = totals.agg(F.count(F.when(F.col("umis") >= min_umis, 1)).alias("eligible"))
    halves = pairs.select(F.explode(F.array("first", "second")).alias("cell_id"))
    overlap = totals.join(halves, "cell_id", "left_semi").agg(F.count("*").alias("overlap"))
    whole = complete_pairs(pairs, totals.withColumnRenamed("cell_id", "half"), min_umis).agg(F.count("*").alias("complete"))
    return main.crossJoin(enough).crossJoin(overlap).crossJoin(whole)


def summarize_runs(runs: DataFrame) -> DataFrame:
    """Totals over runs (processed, mapped) with the least and greatest mapping rate; a run that maps more than it has is an error."""
    assert_none(runs.where("mapped > processed"), "a run maps more reads than it has")
    rate = F.col("mapped") / F.nullif(F.col("processed"), F.lit(0))
    return runs.agg(F.count("*").alias("runs"), F.sum("processed").alias("processed"), F.sum("mapped").alias("mapped"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))


def demultiplex_reads(first: DataFrame, second: DataFrame, primers: DataFrame, start: int, length: int) -> DataFrame:
    """Rows (primer, how, n): reads paired by name, the barcode looked up exactly, then at one unambiguous substitution.

    first and second have (name, seq); primers (primer, barcode), a list of a plate's size.
    """
    pairs = first.select("name", F.col("seq").alias("s1")).join(second.select("name", F.col("seq").alias("s2")), "name")
    pairs = pairs.withColumn("bc", F.expr(f"substring(s2, {start + 1}, {length})"))
    letters = F.array(*[F.lit(x) for x in "ACGTN"])
    near = primers.select("primer", "barcode", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("i")).select("primer", "barcode", "i", F.explode(letters).alias("x"))
    near = near.select("primer", F.concat(F.expr("substring(barcode, 1, i - 1)"), "x", F.expr("substring(barcode, i + 1)")).alias("bc")).distinct()
    near = near.groupBy("bc").agg(F.count("*").alias("c"), F.min("primer").alias("near")).where("c = 1").drop("c")
    exact = primers.select(F.col("barcode").alias("bc"), F.col("primer").alias("exact"))
    told = pairs.join(exact, "bc", "left").join(near, "bc", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "corrected").otherwise("unknown")
    return told.groupBy(F.coalesce("exact", "near").alias("primer"), how.alias("how")).agg(F.count("*").alias("n"))


def tag_spliced_alignments(alignments: DataFrame, samples: DataFrame) -> DataFrame:
    """Primary, unique, spliced alignments of known barcodes with their sample; one per barcode, UMI, place and CIGAR."""
    kept = alignments.where(F.col("primary") & (F.col("nh") == 1) & F.col("cigar").rlike("[0-9]+N"))
    return kept.join(samples.select("barcode", "sample"), "barcode").dropDuplicates(["barcode", "umi", "ref", "pos", "cigar"])


def segment_whitelists(barcodes: DataFrame, size: int = 8) -> DataFrame:
    """Rows (segment, value): distinct 8-base parts of cleaned 24-base barcodes; anything else is an error."""
    clean = barcodes.select(F.upper(F.trim("barcode")).alias("b")).distinct()
    assert_none(clean.where(~F.col("b").rlike(f"^[ACGT]{{{3 * size}}}$")), "a barcode is not 24 bases")
    parts = F.array(*[F.substring("b", 1 + i * size, size) for i in range(3)])
    return clean.select(F.posexplode(parts).alias("segment", "value")).distinct()


def compare_sparse(a: DataFrame, b: DataFrame, keys=("ec_id", "tx_id"), value: str = "a") -> DataFrame:
    """One row: entries in both or one, cosine, relative Frobenius distance, mean, median and greatest difference."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), list(keys), "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    d = F.abs(x - y)
    return both.agg(
        F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("shared"), F.count("*").alias("either"),
        (F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x) * F.sum(y * y)), F.lit(0.0))).alias("cosine"), F.sqrt(F.sum(d * d) / F.nullif(F.sum(x * x), F.lit(0))).alias("frobenius"),
        F.avg(d).alias("mean_delta"), F.percentile(d, 0.5).alias("median_delta"), F.max(d).alias("max_delta"), F.avg((d > 0.1).cast("double")).alias("over_tenth"),
    )


def ec_compatibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (kind, n): classes of a whose transcript set is in b once, several times or never; both have (ec_id, tx_id)."""
    key = lambda m: m.groupBy("ec_id").agg(key_of("tx_id").alias("key"))
    known = key(b).groupBy("key").agg(F.count("*").alias("c"))
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("c") == 1, "unique").otherwise("ambiguous")
    return key(a).join(known, "key", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def ec_weight_conflicts(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows (ec_id, kind) for a's classes: 'missing' in b, 'unique', 'repeated' (its set occurs several times with the same weights) or 'conflicting' (with others).

    Both have (ec_id, tx_id), b also weight (null where a class has none). Weights are compared in
    the order of transcripts with the first class that has any, by id; other lengths
    conflict too. Classes without weights are passed over.
    """
    own = a.groupBy("ec_id").agg(key_of("tx_id").alias("key"))
    listed = b.groupBy("ec_id").agg(key_of("tx_id").alias("key"), F.transform(F.array_sort(F.collect_list(F.struct("tx_id", "weight"))), lambda x: x["weight"]).alias("w"))
    listed = listed.withColumn("w", F.when(F.exists("w", lambda x: x.isNotNull()), F.array_compact("w")))
    first = listed.where("w IS NOT NULL").groupBy("key").agg(F.min_by("w", "ec_id").alias("w0"))
    differs = (F.size("w") != F.size("w0")) | F.exists(F.zip_with("w", "w0", lambda x, y: F.abs(x - y) > tolerance), lambda x: F.coalesce(x, F.lit(False)))
    known = listed.join(first, "key", "left").groupBy("key").agg(F.count("*").alias("c"), F.max(F.coalesce(differs & F.col("w").isNotNull(), F.lit(False))).alias("d"))
    kind = F.when(F.col("c").isNull(), "missing").when(F.col("d"), "conflicting").when(F.col("c") == 1, "unique").otherwise("repeated")
    return own.join(known, "key", "left").select("ec_id", kind.alias("kind"))


# Q43-Q48: local estimates


def fisher_information(design: DataFrame, theta: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (grp, tx_a, tx_b, info): information on log abundance, sum over classes of n * pa * pb less the outer product of means.

    design has (ec_id, tx_id, a), theta (grp, tx_id, theta), totals (grp, ec_id, n). pa is a
    transcript's share of its class. A class's members are gathered once; the upper
    triangle of its outer product is made where they lie and summed before it moves.
    """
    part = design.join(theta, "tx_id").withColumn("q", F.col("a") * F.col("theta")).groupBy("grp", "ec_id").agg(F.array_sort(F.collect_list(F.struct("tx_id", "q"))).alias("m"), F.sum("q").alias("t"))
    shares = F.transform("m", lambda x: F.struct(x["tx_id"].alias("tx"), (x["q"] / F.nullif("t", F.lit(0.0))).alias("p")))
    part = materialize(part.join(totals, ["grp", "ec_id"]).select("grp", "n", shares.alias("m")), "class-shares")
    upper = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 1, F.size("m")), lambda y: F.struct(x["tx"].alias("a"), y["tx"].alias("b"), (F.col("n") * x["p"] * y["p"]).alias("s"))))
    cross = part.select("grp", F.explode(F.flatten(upper)).alias("x")).groupBy("grp", "x.a", "x.b").agg(F.sum("x.s").alias("s"))
    cross = materialize(cross, "cross")
    norm = totals.groupBy("grp").agg(F.sum("n").alias("t"))
    mean = part.select("grp", "n", F.explode("m").alias("x")).groupBy("grp", "x.tx").agg(F.sum(F.col("n") * F.col("x.p")).alias("m")).join(norm, "grp").withColumn("m", F.col("m") / F.nullif("t", F.lit(0)))
    mean = materialize(mean, "means")
    both = cross.unionByName(cross.where("a <> b").select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    of = lambda c, m: mean.select("grp", F.col("tx").alias(c), F.col("m").alias(m), *(["t"] if m == "ma" else []))
    out = both.join(of("a", "ma"), ["grp", "a"]).join(of("b", "mb"), ["grp", "b"])
    return out.select("grp", F.col("a").alias("tx_a"), F.col("b").alias("tx_b"), (F.col("s") / F.nullif("t", F.lit(0)) - F.col("ma") * F.col("mb")).alias("info"))


def path_proportions(values: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows (sample, block_id, path, p): transcript mass by path, closed to 1 in each block."""
    mass = values.join(paths, "tx_id").groupBy("sample", "block_id", "path").agg(F.sum("value").alias("m"))
    return mass.select("sample", "block_id", "path", (F.col("m") / F.nullif(F.sum("m").over(over("sample", "block_id")), F.lit(0))).alias("p"))


def decode_theta(cells: DataFrame, gene_left: DataFrame, tx_left: DataFrame, umis: DataFrame, clip: float = 30.0) -> DataFrame:
    """Rows (grp, tx_id, theta): softmax over genes times softmax over a gene's isoforms, averaged over a group's cells by UMIs.

    cells has (cell_id, grp, right), gene_left (gene_id, left), tx_left (tx_id, gene_id,
    left), umis (cell_id, umis). Cells and genes, each with its isoforms, meet in tiles, twice: for the cells'
    sums over genes, one number a cell and tile, and for the groups' weighted sums, one
    number for each group and isoform of a block. No row stands for a cell and gene.
    """
    cell, grp, tx = (t.schema[c].dataType.simpleString() for t, c in ((cells, "cell_id"), (cells, "grp"), (tx_left, "tx_id")))
    forms = tx_left.groupBy("gene_id").agg(F.collect_list("tx_id").alias("txs"), F.flatten(F.collect_list("left")).alias("lefts"))
    genes = materialize(gene_left.select("gene_id", "left").join(forms, "gene_id", "left"), "genes")
    exp = lambda x, y: np.exp(np.clip(x @ y.T, -clip, clip))

    def sums(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": c["cell_id"], "z": exp(matrix(c["right"]), matrix(g["left"])).sum(1)})

    def shares(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["txs"].notna()]
        if not len(g):
            return pd.DataFrame()
        x, sizes = matrix(c["right"]), g["txs"].map(len).to_numpy()
        by_gene = exp(x, matrix(g["left"])) / c["z"].to_numpy()[:, None]
        e = exp(x, np.concatenate(g["lefts"].to_list()).astype(float).reshape(int(sizes.sum()), -1))
        starts = np.cumsum(sizes) - sizes
        theta = np.repeat(by_gene / np.add.reduceat(e, starts, axis=1), sizes, axis=1) * e
        codes, names = pd.factorize(c["grp"], use_na_sentinel=False)
        weighted = np.zeros((len(names), theta.shape[1]))
        np.add.at(weighted, codes, theta * c["umis"].to_numpy(dtype=float)[:, None])
        return pd.DataFrame({"grp": np.repeat(np.asarray(names, dtype=object), theta.shape[1]), "tx_id": np.tile(np.concatenate(g["txs"].to_list()), len(names)), "s": weighted.ravel()})

    known = cells.join(umis, "cell_id").select("cell_id", "grp", "right", "umis")
    z = by_tiles(known.select("cell_id", "right").dropDuplicates(["cell_id"]), genes.select("left"), sums, f"cell_id {cell}, z double").groupBy("cell_id").agg(F.sum("z").alias("z"))
    summed = by_tiles(materialize(known.join(z, "cell_id"), "cell-sums"), genes, shares, f"grp {grp}, tx_id {tx}, s double", tile=256).groupBy("grp", "tx_id").agg(F.sum("s").alias("s"))
    weight = known.groupBy("grp").agg(F.sum("umis").alias("u"))
    return summed.join(weight, "grp").select("grp", "tx_id", (F.col("s") / F.nullif("u", F.lit(0))).alias("theta"))


def collapse_to_paths(design: DataFrame, paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows (ec_id, path, a): isoform columns by fixed weights inside a path; isoforms without a path keep their own."""
    out = design.join(paths, "tx_id", "left").withColumn("path", F.coalesce("path", F.concat(F.lit("tx:"), F.col("tx_id").cast("string")))).join(weights, "tx_id")
    total = out.select("path", "tx_id", "w").distinct().groupBy("path").agg(F.sum("w").alias("__t"))
    return out.join(total, "path").groupBy("ec_id", "path").agg(F.sum(F.col("a") * F.col("w") / F.nullif("__t", F.lit(0))).alias("a"))


def overlap_report(observed: DataFrame, expected: DataFrame, least: float = 0.0) -> DataFrame:
    """One row: observed, expected and shared barcodes, features, UMIs, cells with UMIs; too small a share is an error."""
    known = expected.select("cell_id").distinct()
    shared = observed.join(known, "cell_id", "left_semi")
    row = observed.agg(F.countDistinct("cell_id").alias("observed"), F.countDistinct("ec_id").alias("features"), F.sum("n").alias("umis"), F.countDistinct(F.when(F.col("n") > 0, F.col("cell_id"))).alias("with_umis"))
    row = row.crossJoin(known.agg(F.count("*").alias("expected"))).crossJoin(shared.agg(F.countDistinct("cell_id").alias("shared")))
    if least:
        assert_none(row.where(F.col("shared") < least * F.col("expected")), "too few of the expected barcodes are observed")
    return row


def gene_slices(counts: DataFrame, design: DataFrame, ec_genes: DataFrame) -> DataFrame:
    """Rows (gene_id, sample, ec_id, tx_id, a, n) of unambiguous, supported classes; samples without counts for a gene drop out."""
    rows = design.where("a > 0").join(ec_genes, "ec_id")
    joined = counts.join(ec_genes, "ec_id").withColumn("__t", F.sum("n").over(over("gene_id", "sample"))).where("__t > 0")
    return joined.join(rows.drop("gene_id"), "ec_id").select("gene_id", "sample", "ec_id", "tx_id", "a", "n")


# C11, C12: whole paths


def psi_pipeline(quant: DataFrame, exons: DataFrame, mode: int = 3, cutoff: float = 0.1, pct: float = 0.01, min_total: float = 1.0, named: bool = True) -> DataFrame:
    """Rows (intron, name, sample, value, psi) from transcript quantification: normalize, project, cluster, link, refine, number, share.

    Rows move by transcript and into ranges of places, where an intron's values are added up, the chains of a chromosome found and clusters
    refined; only clusters that reach over a range's end move again. An intron's values go along as a list, and of its exons the ends that it
    doesn't have itself. Without named, clusters are not numbered and rows have no name.
    """
    listed = F.array_sort(F.collect_list(F.struct("sample", "value")))
    values = normalize_junction(quant).where("value > 0").groupBy("tx_id").agg(listed.alias("given")).select("tx_id", "given.sample", "given.value")
    rows = A.introns_from_exons(exons, ends=True).join(values, "tx_id", "left")
    return _psi_of(C.refined_where_packed(C.packed_clusters(_valued_places(rows), first=_added_up), cutoff, pct, mode), min_total, named)


def _valued_places(rows: DataFrame) -> DataFrame:
    """Rows (chrom, start, stop, strand, lows, highs, sample, value), one a place with values, of the introns of transcripts with their lists sample and value.

    They lie in ranges of (chrom, start, stop). The lists of a place's transcripts follow each other, so a sample may come more than once: _added_up().
    """
    place, last = ["chrom", "start", "stop"], ["gene_id", "tx_id", "ord", "strand"]
    narrow, wanted = rows.select(*place, *last, "low", "high", "sample", "value"), shares(rows)
    moved = narrow.repartitionByRange(wanted, *place) if wanted else narrow.repartitionByRange(*place)
    given = F.collect_list(F.when(F.col("sample").isNotNull(), F.struct("sample", "value")))
    placed = moved.groupBy(*place).agg(F.max(F.struct(*last)).alias("last"), F.collect_set("low").alias("lows"), F.collect_set("high").alias("highs"), given.alias("given"))
    strand = F.when(F.col("last.strand") == "+", "+").otherwise("-")  # never null, so no intron is sought that has none
    lists = [F.flatten("given.sample").alias("sample"), F.flatten("given.value").alias("value")]
    return placed.where(F.size("given") > 0).select(*place, strand.alias("strand"), "lows", "highs", *lists)


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the values of equal samples in a row's lists sample and value added up, in order of the sample."""
    for batch in batches:
        lists = batch.column("sample")
        row, coded = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = row * len(order) + rank[coded.indices.to_numpy()]
        if (key[1:] > key[:-1]).all():
            yield batch
            continue
        each, at = np.unique(key, return_inverse=True)
        ends = np.append(0, np.cumsum(np.bincount(each // len(order), minlength=batch.num_rows))).astype(np.int32)
        sums = np.bincount(at, weights=batch.column("value").flatten().to_numpy(zero_copy_only=False))
        new = {"sample": coded.dictionary.take(pa.array(order[each % len(order)])), "value": pa.array(sums)}
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), new[n]) if n in new else c for n, c in zip(batch.schema.names, batch.columns)], names=batch.schema.names)


def _psi_of(final: DataFrame, min_total: float, named: bool) -> DataFrame:
    """Percent spliced in of introns in refined clusters, with lists sample, value and shares."""
    if named:
        final = C.number_clusters(materialize(final, "final"), min_total=min_total)
    else:
        final = final.where(F.round("total", 9) > min_total)
    names = ["name"] if named else []
    each = final.select("intron", *names, F.explode(F.arrays_zip("sample", "value", "shares")).alias("x"))
    return each.select("intron", *names, "x.sample", "x.value", F.round("x.shares", 6).alias("psi"))


def pseudobulk_pipeline(cell_ec: DataFrame, ec_tx: DataFrame, cell_meta: DataFrame, exons: DataFrame, size: int = 5, iterations: int = 4, min_ec: float = 5, min_tx: float = 5, order: Column | None = None) -> DataFrame:
    """Rows (intron, sample, psi) from cell-level class counts: metacells (shuffled by order, a hash of the cell if None), sums, support filter, abundance, projection, clusters."""
    groups = metacells(cell_meta, size, order=order).select("cell_id", F.col("metacell").alias("grp"))
    summed = materialize(aggregate_groups(cell_ec, groups).withColumnRenamed("grp", "sample"), "summed")
    kept = materialize(filter_support(summed, ec_tx, min_ec, min_tx), "kept")
    weights = kept.select("tx_id").distinct().withColumn("length", (F.lit(250.0) + F.col("tx_id").cast("double") * 5)).transform(feature_weights)
    alpha = em_abundance(summed, kept, weights, iterations)
    totals = summed.groupBy("sample").agg(F.sum("n").alias("total"))
    counts = drop_small(abundance_to_counts(alpha, totals)).select("sample", F.concat(F.lit("t"), F.col("tx_id").cast("string")).alias("tx_id"), F.col("count").alias("value"))
    introns = materialize(A.introns_from_exons(exons), "introns")
    projected = project_counts(counts, introns.select("tx_id", F.col("intron").alias("feature"))).withColumnRenamed("feature", "intron")
    listed = projected.groupBy("intron").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("given"))
    near = F.array_distinct(F.flatten(F.collect_set(F.array("left_exon", "right_exon"))))
    places = introns.groupBy("intron").agg(F.first("chrom").alias("chrom"), F.max_by("strand", F.struct("gene_id", "tx_id", "ord")).alias("strand"), F.first("start").alias("start"), F.first("stop").alias("stop"), near.alias("exons"))
    placed = places.join(listed, "intron").select("chrom", "start", "stop", "strand", "exons", "given.sample", "given.value")
    return _psi_of(C.linked_and_refined(C.initial_clusters(materialize(placed, "places")), shares=True), 1.0, named=False).select("intron", "sample", "psi")
