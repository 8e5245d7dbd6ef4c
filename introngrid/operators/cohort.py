"""Cohort metadata, contrasts and designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.functions.windows import unique_or_null
from introngrid.schema import assert_no_conflict, assert_none, assert_unique


def _over(*keys):
    return Window.partitionBy(*keys)


def _run(default: str) -> Column:
    """What stands before the first colon of a cell id."""
    return F.when(F.col("cell").contains(":"), F.substring_index("cell", ":", 1)).otherwise(default)


def _barcode() -> Column:
    return F.expr("substring(cell, instr(cell, ':') + 1)")


def cell_metadata(cells: DataFrame, label: str = "label", check: bool = True) -> DataFrame:
    """Rows (run, barcode, cell_type, condition, subject) from cell ids run:barcode (or barcode, run *) and labels type__condition__subject.

    The label is split from the right, so a cell type keeps its own underscores.
    """
    run = _run("*")
    tail = F.substring_index(label, "__", -2)
    rest = F.expr(f"substring({label}, 1, length({label}) - length(substring_index({label}, '__', -2)) - 2)")
    out = cells.select(run.alias("run"), _barcode().alias("barcode"), rest.alias("cell_type"), F.substring_index(tail, "__", 1).alias("condition"), F.substring_index(tail, "__", -1).alias("subject"))
    return assert_unique(out, "run", "barcode") if check else out


def join_cell_metadata(labels: DataFrame, conditions: DataFrame, subjects: DataFrame, default_run: str = "*", check: bool = True) -> DataFrame:
    """Rows (run, barcode, cell_type, condition, subject) of the cells that all three tables (cell, value) name.

    A cell twice in a table, or two cells that come to one run and barcode, are errors.
    """
    out = None
    for table, name in ((labels, "cell_type"), (conditions, "condition"), (subjects, "subject")):
        table = table.select("cell", F.col("value").alias(name))
        if check:
            assert_unique(table, "cell")
        out = table if out is None else out.join(table, "cell")
    out = out.select(_run(default_run).alias("run"), _barcode().alias("barcode"), "cell_type", "condition", "subject")
    return assert_unique(out, "run", "barcode") if check else out


def combined_groups(metadata: DataFrame) -> DataFrame:
    """Rows (cell, grp) of cell metadata: run:barcode (the bare barcode for run *) and type__condition__subject."""
    cell = F.when(F.col("run") == "*", F.col("barcode")).otherwise(F.concat_ws(":", "run", "barcode"))
    return metadata.select(cell.alias("cell"), F.concat_ws("__", "cell_type", "condition", "subject").alias("grp"))


def reference_labels(labels: DataFrame, batches: DataFrame, wells: DataFrame, check: bool = True) -> DataFrame:
    """Rows (cell, annotation, subject): labels (batch, well, annotation, subject) with the run of their batch and both barcodes of their well.

    The first row of a cell by annotation wins; two subjects for one cell are an error.
    """
    joined = labels.join(batches, "batch").join(wells, "well").withColumn("barcode", F.explode(F.array("barcode_1", "barcode_2")))
    out = joined.select(F.concat_ws(":", "run", "barcode").alias("cell"), "annotation", "subject")
    if check:
        assert_no_conflict(out, "cell", "subject")
    return out.groupBy("cell").agg(F.min(F.struct("annotation", "subject")).alias("x")).select("cell", "x.annotation", "x.subject")


def sample_table(cells: DataFrame, check: bool = True) -> DataFrame:
    """Rows (sample_id, cell_type, condition, subject, n_cells); the id is subject__cell_type with other characters as _."""
    sample = F.concat_ws("__", *[F.regexp_replace(c, "[^A-Za-z0-9.-]+", "_") for c in ("subject", "cell_type")])
    rows = cells.withColumn("sample_id", sample)
    if check:
        assert_no_conflict(rows, "sample_id", "condition")
    return rows.groupBy("sample_id").agg(F.min("cell_type").alias("cell_type"), F.min("condition").alias("condition"), F.min("subject").alias("subject"), F.count("*").alias("n_cells"))


def pseudobulk_junctions(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (sample_id, junction_id, value): junction counts (run, barcode, chrom, start, stop, strand, n) by sample; cells with run * match every run.

    Two equi joins, one with the run and one without, instead of a join on either.
    """
    exact = counts.join(cells.where("run <> '*'").select("run", "barcode", "sample_id"), ["run", "barcode"])
    every = counts.join(cells.where("run = '*'").select("barcode", "sample_id"), "barcode")
    both = exact.unionByName(every.select(*exact.columns))
    key = F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), "strand")
    return both.groupBy("sample_id", key.alias("junction_id")).agg(F.sum("n").alias("value")).where("value > 0")


def plan_contrasts(samples: DataFrame, min_subjects: int = 4) -> DataFrame:
    """Rows (contrast_id, effect, stratum, level_a, level_b, samples_a, samples_b, paired_subjects).

    Conditions are compared inside a cell type if both have enough subjects; cell types over
    the subjects with exactly one sample of each.
    """
    listed = lambda c: F.array_sort(F.collect_set(c))
    groups = samples.groupBy("cell_type", "condition").agg(listed("sample_id").alias("s"), F.countDistinct("subject").alias("n")).where(F.col("n") >= min_subjects)
    a = groups.select("cell_type", F.col("condition").alias("level_a"), F.col("s").alias("samples_a"))
    b = groups.select("cell_type", F.col("condition").alias("level_b"), F.col("s").alias("samples_b"))
    nobody = F.array().cast("array<string>")
    conditions = a.join(b, "cell_type").where("level_a < level_b").select(
        F.concat_ws("__", F.lit("condition"), "cell_type", "level_a", "level_b").alias("contrast_id"), F.lit("condition").alias("effect"), F.col("cell_type").alias("stratum"), "level_a", "level_b", "samples_a", "samples_b", nobody.alias("paired_subjects")
    )
    single = samples.withColumn("__n", F.count("*").over(_over("subject", "cell_type"))).where("__n = 1")
    x = single.select("subject", F.col("cell_type").alias("level_a"), F.col("sample_id").alias("a"))
    y = single.select("subject", F.col("cell_type").alias("level_b"), F.col("sample_id").alias("b"))
    pairs = x.join(y, "subject").where("level_a < level_b").groupBy("level_a", "level_b").agg(F.array_sort(F.collect_list(F.struct("subject", "a", "b"))).alias("p")).where(F.size("p") >= min_subjects)
    types = pairs.select(
        F.concat_ws("__", F.lit("cell_type"), "level_a", "level_b").alias("contrast_id"), F.lit("cell_type").alias("effect"), F.lit("all").alias("stratum"), "level_a", "level_b",
        F.transform("p", lambda r: r["a"]).alias("samples_a"), F.transform("p", lambda r: r["b"]).alias("samples_b"), F.transform("p", lambda r: r["subject"]).alias("paired_subjects"),
    )
    return conditions.unionByName(types)


def permute_pairs(pairs: DataFrame, seed: int = 0, contrast: str = "contrast_id", subject: str = "subject", coin: Column | None = None, order: Column | None = None) -> DataFrame:
    """pairs with swap: a choice per contrast and subject, never all nor none where there are two subjects or more.

    The choice is coin modulo 2, and where all of a contrast agree the first subject by order is turned; both are seeded hashes if None.
    """
    w = _over(contrast)
    out = pairs.withColumn("__s", F.pmod(coin if coin is not None else F.xxhash64(contrast, subject, F.lit(seed)), F.lit(2))).withColumn("__sum", F.sum("__s").over(w)).withColumn("__n", F.count("*").over(w))
    rank = F.row_number().over(w.orderBy(order if order is not None else F.xxhash64(subject, F.lit(seed + 1)), subject))
    flip = (F.col("__n") > 1) & ((F.col("__sum") == 0) | (F.col("__sum") == F.col("__n"))) & (rank == 1)
    return out.withColumn("swap", F.when(flip, 1 - F.col("__s")).otherwise(F.col("__s")) == 1).drop("__s", "__sum", "__n")


def subject_folds(subjects: DataFrame, k: int, seed: int = 0, order: Column | None = None, check: bool = True) -> DataFrame:
    """Rows (subject, condition, fold): folds of alike many subjects of each condition; fewer than k of one is an error."""
    rows = subjects.select("subject", "condition").distinct()
    if check:
        assert_none(rows.groupBy("condition").count().where(F.col("count") < k), "a condition has fewer subjects than folds")
    rank = F.row_number().over(_over("condition").orderBy(order if order is not None else F.xxhash64("subject", F.lit(seed)), "subject")) - 1
    return rows.withColumn("fold", (rank % k).cast("int"))


def filter_subjects(rows: DataFrame, keep: DataFrame) -> DataFrame:
    return rows.join(keep.select("subject").distinct(), "subject", "left_semi")


def covered_celltype_design(samples: DataFrame, min_umis: float, min_subjects: int, min_samples: int) -> DataFrame:
    """Covered samples (feature, sample_id, subject, cell_type, umis) in cell types with enough subjects, of features with enough samples and two types."""
    covered = samples.where(F.col("umis") >= min_umis)
    types = covered.groupBy("feature", "cell_type").agg(F.countDistinct("subject").alias("n")).where(F.col("n") >= min_subjects)
    kept = covered.join(types.select("feature", "cell_type"), ["feature", "cell_type"], "left_semi")
    good = kept.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("cell_type").alias("t")).where((F.col("n") >= min_samples) & (F.col("t") > 1))
    return kept.join(good.select("feature"), "feature", "left_semi")


def covered_pairwise_designs(samples: DataFrame, min_umis: float, min_subjects: int) -> DataFrame:
    """Rows (feature, level_a, level_b, n_subjects) of cell-type pairs on shared covered subjects."""
    c = samples.where(F.col("umis") >= min_umis).select("feature", "subject", "cell_type").distinct()
    pairs = c.withColumnRenamed("cell_type", "level_a").join(c.withColumnRenamed("cell_type", "level_b"), ["feature", "subject"]).where("level_a < level_b")
    return pairs.groupBy("feature", "level_a", "level_b").agg(F.count("*").alias("n_subjects")).where(F.col("n_subjects") >= min_subjects)


def covered_condition_designs(samples: DataFrame, min_umis: float, min_subjects: int) -> DataFrame:
    """Covered samples of (feature, cell_type) with at least two conditions that have enough subjects."""
    covered = samples.where(F.col("umis") >= min_umis)
    levels = covered.groupBy("feature", "cell_type", "condition").agg(F.countDistinct("subject").alias("n")).where(F.col("n") >= min_subjects)
    good = levels.groupBy("feature", "cell_type").agg(F.count("*").alias("n")).where("n >= 2")
    return covered.join(levels, ["feature", "cell_type", "condition"], "left_semi").join(good, ["feature", "cell_type"], "left_semi")


def design_rows(samples: DataFrame, level: str = "cell_type", subject: str | None = "subject") -> DataFrame:
    """Long design rows (sample_id, column, value): intercept, treatment dummies against the least level, and subject dummies likewise."""
    out = samples.select("sample_id", F.lit("intercept").alias("column"), F.lit(1.0).alias("value"))
    for name in [level, subject] if subject else [level]:
        least = samples.agg(F.min(name).alias("__least"))  # one row
        coded = samples.crossJoin(F.broadcast(least)).where(F.col(name) > F.col("__least"))
        out = out.unionByName(coded.select("sample_id", F.concat_ws("=", F.lit(name), F.col(name)).alias("column"), F.lit(1.0).alias("value")))
    return out


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """The first test of every gene that parts the same transcripts alike; path labels count by first appearance only.

    candidates has (test_id, gene_id, transcripts array, labels array).
    """
    canonical = F.transform("labels", lambda x: F.array_position("labels", x))
    rank = F.row_number().over(_over("gene_id", "transcripts", "__k").orderBy("test_id"))
    return candidates.withColumn("__k", canonical).withColumn("__r", rank).where("__r = 1").drop("__k", "__r")


def joint_gene_candidates(candidates: DataFrame, keys=("gene_id", "design")) -> DataFrame:
    """One joint candidate per gene and design, named by both with a pipe between."""
    return candidates.select(*keys).distinct().withColumn("test_id", F.concat_ws("|", *keys))


def filter_junction_groups(counts: DataFrame, min_samples: int, min_share: float) -> DataFrame:
    """Junctions of annotated groups of two or more, seen in enough samples of each side and with a share of the group's counts.

    counts has (junction_id, intron_group, sample_id, side, value).
    """
    j = counts.where("intron_group IS NOT NULL").groupBy("intron_group", "junction_id").agg(
        F.countDistinct(F.when((F.col("side") == 0) & (F.col("value") > 0), F.col("sample_id"))).alias("a"), F.countDistinct(F.when((F.col("side") == 1) & (F.col("value") > 0), F.col("sample_id"))).alias("b"), F.sum("value").alias("t")
    )
    kept = j.where((F.col("a") >= min_samples) & (F.col("b") >= min_samples)).withColumn("share", F.col("t") / F.nullif(F.sum("t").over(_over("intron_group")), F.lit(0))).where(F.col("share") >= min_share)
    return kept.withColumn("__n", F.count("*").over(_over("intron_group"))).where("__n >= 2").select("intron_group", "junction_id", "share")


def attach_group_metadata(results: DataFrame, metadata: DataFrame, key: str = "intron_group", value: str = "gene_id") -> DataFrame:
    """results with a group's metadata where it is unique."""
    return results.join(metadata.groupBy(key).agg(unique_or_null(value).alias(value)), key, "left")


def contrast_sheet(contrasts: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows (contrast_id, sample_id, grp, subject) for an external tool."""
    side = lambda c, g: contrasts.select("contrast_id", F.explode(c).alias("sample_id"), F.lit(g).alias("grp"))
    return side("samples_a", "A").unionByName(side("samples_b", "B")).join(samples.select("sample_id", "subject"), "sample_id")


def top_paths(values: DataFrame, n: int) -> DataFrame:
    """The n paths of a block with the largest UMI-weighted share, closed to 1 in every sample. values has (block_id, sample, path, p, umis)."""
    total = values.groupBy("block_id", "path").agg(F.sum(F.col("umis") * F.col("p")).alias("t"))
    best = total.withColumn("r", F.row_number().over(_over("block_id").orderBy(F.desc("t"), "path"))).where(F.col("r") <= n)
    kept = values.join(best.select("block_id", "path"), ["block_id", "path"])
    return kept.withColumn("p", F.col("p") / F.nullif(F.sum("p").over(_over("block_id", "sample")), F.lit(0)))


def range_lookup(names: DataFrame, ranges: DataFrame, check: bool = True, bin_size: int = 1000) -> DataFrame:
    """Rows (name, number, batch): the number in a name and the range (batch, first, last) that holds it; none is an error.

    Ranges are spread over bins, so the range predicate has an equality beside it.
    """
    numbered = names.select("name", F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("number")).withColumn("__b", F.floor(F.col("number") / bin_size))
    spread = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col("first") / bin_size), F.floor(F.col("last") / bin_size))))
    out = numbered.join(spread, "__b").where("number BETWEEN first AND last").select("name", "number", "batch")
    if check:
        assert_none(names.join(out, "name", "left_anti"), "a name is in no range")
    return out
