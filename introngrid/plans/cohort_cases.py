"""Queries over cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from introngrid.operators import annotation as A
from introngrid.operators import cohort as D
from introngrid.plans.adapters import view
from introngrid.plans.annotation_cases import BLOCKS, GROUPS
from introngrid.storage import gather

SM = "sm AS (SELECT subject || '__' || cell_type AS sample_id, cell_type, min(condition) AS condition, min(subject) AS subject, count(*) AS n_cells FROM {cell_meta} GROUP BY subject, cell_type)"
COVER = """cv AS (SELECT ec_id AS feature, subject || '__' || cell_type AS sample_id, subject, cell_type, condition, CAST(sum(n) AS BIGINT) AS umis FROM {cell_ec} JOIN {cell_meta} USING (cell_id) GROUP BY ALL)"""


def meta(s, d):
    return view(s, d, "cell_meta")


def samples(s, d):
    return D.sample_table(meta(s, d))


def cover(s, d):
    joined = view(s, d, "cell_ec").join(meta(s, d), "cell_id")
    return joined.groupBy(F.col("ec_id").alias("feature"), F.concat_ws("__", "subject", "cell_type").alias("sample_id"), "subject", "cell_type", "condition").agg(F.sum("n").alias("umis"))


def d01(s, d):
    cell = F.when(F.col("cell_id") % 2 == 0, F.concat(F.lit("run1:"), F.col("cell_id").cast("string"))).otherwise(F.col("cell_id").cast("string"))
    return D.cell_metadata(meta(s, d).select(cell.alias("cell"), F.concat_ws("__", F.concat(F.lit("EX_"), "cell_type"), "condition", "subject").alias("label")))


def d01_join(s, d):
    cell = F.when(F.col("cell_id") % 2 == 0, F.concat(F.lit("run1:x:"), F.col("cell_id").cast("string"))).otherwise(F.col("cell_id").cast("string"))
    one = lambda c, k: meta(s, d).where(f"cell_id % {k} > 0").select(cell.alias("cell"), F.col(c).alias("value"))
    rows = D.join_cell_metadata(one("cell_type", 7), one("condition", 5), one("subject", 11), "any")
    return rows.join(D.combined_groups(rows).withColumnRenamed("cell", "full"), F.concat_ws(":", "run", "barcode") == F.col("full")).drop("full")


def d02(s, d):
    labels = meta(s, d).select((F.col("cell_id") % 3).alias("batch"), (F.col("cell_id") % 8).alias("well"), F.col("cell_type").alias("annotation"), F.lit("s").alias("subject"))
    batches = s.range(3).select(F.col("id").alias("batch"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("run"))
    wells = s.range(8).select(F.col("id").alias("well"), (F.col("id") * 2).cast("string").alias("barcode_1"), (F.col("id") * 2 + 1).cast("string").alias("barcode_2"))
    return D.reference_labels(labels, batches, wells)


def d03(s, d):
    return samples(s, d)


def _junctions(s, d):
    introns = A.introns_from_exons(view(s, d, "tx_exon"))
    barcode = F.regexp_extract("tx_id", r"(\d+)$", 1).cast("long") % 200
    return introns.select(F.concat(F.lit("run"), (F.col("ord") % 2).cast("string")).alias("run"), barcode.cast("string").alias("barcode"), "chrom", "start", "stop", "strand", F.lit(1).cast("long").alias("n"))


def d04(s, d):
    cells = meta(s, d).select(F.when(F.col("cell_id") % 3 == 0, "*").otherwise("run1").alias("run"), F.col("cell_id").cast("string").alias("barcode"), F.concat_ws("__", "subject", "cell_type").alias("sample_id"))
    return D.pseudobulk_junctions(_junctions(s, d), cells)


def _contrasts(s, d):
    return D.plan_contrasts(samples(s, d), 2)


def d05(s, d):
    j = lambda c: F.array_join(c, ",").alias(c)
    return _contrasts(s, d).select("contrast_id", "effect", "stratum", "level_a", "level_b", j("samples_a"), j("samples_b"), j("paired_subjects"))


def d06(s, d):
    pairs = _contrasts(s, d).where("effect = 'cell_type'").select("contrast_id", F.explode("paired_subjects").alias("subject"))
    number = F.expr("CAST(substr(subject, 2) AS INT)")
    return D.permute_pairs(pairs, coin=F.floor(number * F.ascii(F.right("contrast_id", F.lit(1))) / 3), order=number * 5 % 7)


def d07(s, d):
    return D.subject_folds(meta(s, d), 2, order=F.substring("subject", 2, 5).cast("int") * 7 % 11)


def d08(s, d):
    return D.filter_subjects(cover(s, d), meta(s, d).where("condition = 'C1'")).select("feature", "sample_id", "umis")


def d09(s, d):
    return D.covered_celltype_design(cover(s, d), 3, 4, 8).select("feature", "sample_id", "umis")


def d10(s, d):
    return D.covered_pairwise_designs(cover(s, d), 3, 2)


def d11(s, d):
    return D.covered_condition_designs(cover(s, d), 3, 2).select("feature", "sample_id", "condition")


def d12(s, d):
    return D.design_rows(samples(s, d))


def d13(s, d):
    b = A.splice_blocks(view(s, d, "tx_exon")).groupBy("gene_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("tx_id", "path_index"))).alias("x"))
    rows = b.select(F.col("block_id").alias("test_id"), "gene_id", F.transform("x", lambda r: r["tx_id"]).alias("transcripts"), F.transform("x", lambda r: r["path_index"] + 10).alias("labels"))
    return D.dedup_candidates(rows).select("test_id", "gene_id")


def d14(s, d):
    return D.joint_gene_candidates(A.splice_blocks(view(s, d, "tx_exon")).select("gene_id", F.col("strand").alias("design")))


def d15(s, d):
    j = A.introns_from_exons(view(s, d, "tx_exon")).withColumn("k", F.regexp_extract("tx_id", r"(\d+)$", 1).cast("long"))
    rows = j.select(F.col("intron").alias("junction_id"), F.concat("gene_id", F.lit("_"), "strand").alias("intron_group"), (F.col("k") % 4).alias("sample_id"), (F.col("k") % 2).alias("side"), (F.col("k") % 9).alias("v"))
    counts = gather(rows, "intron_group").groupBy("junction_id", "intron_group", "sample_id", "side").agg(F.sum("v").alias("value"))
    return D.filter_junction_groups(counts, 1, 0.02).withColumn("share", F.round("share", 6))


def _annotated(s, d):
    from introngrid.plans.annotation_cases import _junctions as junctions
    from introngrid.plans.annotation_cases import _one_based

    return A.annotate_junction_groups(junctions(s, d), _one_based(s, d))


def d16(s, d):
    rows = _annotated(s, d).withColumn("big", F.concat_ws("_", "chrom", F.floor(F.col("start") / 15000).cast("string")))
    return D.attach_group_metadata(rows.select("big").distinct(), rows.select("big", "gene_id"), "big")


def d17(s, d):
    return D.contrast_sheet(_contrasts(s, d), samples(s, d))


def d18(s, d):
    q = view(s, d, "quant").select(F.concat("sample", F.lit("")).alias("sample"), F.expr("substr(tx_id, 1, 3)").alias("block_id"), F.expr("substr(tx_id, -1)").alias("path"), "num_reads")
    v = q.groupBy("sample", "block_id", "path").agg(F.sum("num_reads").cast("double").alias("p")).withColumn("umis", F.length("block_id").cast("double"))
    return D.top_paths(v, 3).select("sample", "block_id", "path", F.round("p", 6).alias("p"))


def d19(s, d):
    number = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey").distinct()
    names = number.select(F.concat(F.lit("SRR"), F.col("o_orderkey").cast("string")).alias("name"))
    batches = number.select(F.floor(F.col("o_orderkey") / 5000).alias("id")).distinct()
    ranges = batches.select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("batch"), (F.col("id") * 5000).alias("first"), (F.col("id") * 5000 + 4999).alias("last"))
    return D.range_lookup(names, ranges)


PAIRED = f"{SM}, sg AS (SELECT *, count(*) OVER (PARTITION BY subject, cell_type) AS c FROM sm), tp AS (SELECT a.cell_type AS level_a, b.cell_type AS level_b, a.subject, a.sample_id AS a, b.sample_id AS b FROM sg a JOIN sg b ON a.subject = b.subject AND a.cell_type < b.cell_type WHERE a.c = 1 AND b.c = 1)"
PLAN = f"""{PAIRED}, g AS (SELECT cell_type, condition, list(sample_id ORDER BY sample_id) AS s FROM sm GROUP BY ALL HAVING count(DISTINCT subject) >= 2),
pl AS (SELECT 'condition__' || a.cell_type || '__' || a.condition || '__' || b.condition AS contrast_id, 'condition' AS effect, a.cell_type AS stratum, a.condition AS level_a, b.condition AS level_b, a.s AS sa, b.s AS sb, CAST([] AS VARCHAR[]) AS ps FROM g a JOIN g b ON a.cell_type = b.cell_type AND a.condition < b.condition
    UNION ALL SELECT 'cell_type__' || level_a || '__' || level_b, 'cell_type', 'all', level_a, level_b, list(a ORDER BY subject), list(b ORDER BY subject), list(subject ORDER BY subject) FROM tp GROUP BY level_a, level_b HAVING count(*) >= 2)"""

CASES = {
    "d01_cell_metadata": (d01, "SELECT CASE WHEN cell_id % 2 = 0 THEN 'run1' ELSE '*' END AS run, CAST(cell_id AS VARCHAR) AS barcode, 'EX_' || cell_type AS cell_type, condition, subject FROM {cell_meta}"),
    "d01_join_cell_metadata": (d01_join, """SELECT CASE WHEN cell_id % 2 = 0 THEN 'run1' ELSE 'any' END AS run, CASE WHEN cell_id % 2 = 0 THEN 'x:' ELSE '' END || cell_id AS barcode, cell_type, condition, subject, cell_type || '__' || condition || '__' || subject AS grp
        FROM {cell_meta} WHERE cell_id % 7 > 0 AND cell_id % 5 > 0 AND cell_id % 11 > 0"""),
    "d02_reference_labels": (d02, "WITH x AS (SELECT 'r' || (cell_id % 3) || ':' || (cell_id % 8 * 2) AS cell, cell_type FROM {cell_meta} UNION ALL SELECT 'r' || (cell_id % 3) || ':' || (cell_id % 8 * 2 + 1), cell_type FROM {cell_meta}) SELECT cell, min(cell_type) AS annotation, 's' AS subject FROM x GROUP BY cell"),
    "d03_sample_table": (d03, f"WITH {SM} SELECT * FROM sm"),
    "d04_pseudobulk_junctions": (d04, f"""WITH {GROUPS}, jc AS (SELECT 'run' || (ord % 2) AS run, CAST(regexp_extract(tx_id, '([0-9]+)$', 1) AS BIGINT) % 200 AS bc, chrom || ':' || start || ':' || stop || ':' || strand AS junction_id FROM kept)
        SELECT subject || '__' || cell_type AS sample_id, junction_id, count(*) AS value FROM jc JOIN {{cell_meta}} ON cell_id = bc AND (cell_id % 3 = 0 OR run = 'run1') GROUP BY ALL"""),
    "d05_plan_contrasts": (d05, f"WITH {PLAN} SELECT contrast_id, effect, stratum, level_a, level_b, array_to_string(sa, ',') AS samples_a, array_to_string(sb, ',') AS samples_b, coalesce(array_to_string(ps, ','), '') AS paired_subjects FROM pl"),
    "d06_permute_pairs": (d06, f"""WITH {PLAN}, x AS (SELECT contrast_id, unnest(ps) AS subject FROM pl WHERE effect = 'cell_type'), n AS (SELECT *, CAST(substr(subject, 2) AS INT) AS k FROM x),
        c AS (SELECT *, CAST(floor(k * ascii(right(contrast_id, 1)) / 3.0) AS BIGINT) % 2 AS s FROM n), w AS (SELECT *, sum(s) OVER (PARTITION BY contrast_id) AS t, count(*) OVER (PARTITION BY contrast_id) AS n, row_number() OVER (PARTITION BY contrast_id ORDER BY k * 5 % 7, subject) AS r FROM c)
        SELECT contrast_id, subject, CASE WHEN n > 1 AND (t = 0 OR t = n) AND r = 1 THEN 1 - s ELSE s END = 1 AS swap FROM w"""),
    "d07_subject_folds": (d07, "SELECT subject, condition, CAST((row_number() OVER (PARTITION BY condition ORDER BY CAST(substr(subject, 2) AS INT) * 7 % 11, subject) - 1) % 2 AS INT) AS fold FROM (SELECT DISTINCT subject, condition FROM {cell_meta}) x"),
    "d08_filter_subjects": (d08, f"WITH {COVER} SELECT feature, sample_id, umis FROM cv WHERE condition = 'C1'"),
    "d09_covered_celltype_design": (d09, f"""WITH {COVER}, c AS (SELECT * FROM cv WHERE umis >= 3), k AS (SELECT * FROM c WHERE (feature, cell_type) IN (SELECT (feature, cell_type) FROM c GROUP BY feature, cell_type HAVING count(DISTINCT subject) >= 4))
        SELECT feature, sample_id, umis FROM k WHERE feature IN (SELECT feature FROM k GROUP BY feature HAVING count(*) >= 8 AND count(DISTINCT cell_type) > 1)"""),
    "d10_covered_pairwise_designs": (d10, f"WITH {COVER}, c AS (SELECT DISTINCT feature, subject, cell_type FROM cv WHERE umis >= 3) SELECT a.feature, a.cell_type AS level_a, b.cell_type AS level_b, count(*) AS n_subjects FROM c a JOIN c b ON a.feature = b.feature AND a.subject = b.subject AND a.cell_type < b.cell_type GROUP BY ALL HAVING count(*) >= 2"),
    "d11_covered_condition_designs": (d11, f"""WITH {COVER}, c AS (SELECT * FROM cv WHERE umis >= 3), l AS (SELECT feature, cell_type, condition FROM c GROUP BY ALL HAVING count(DISTINCT subject) >= 2), g AS (SELECT feature, cell_type FROM l GROUP BY ALL HAVING count(*) >= 2)
        SELECT feature, sample_id, condition FROM c SEMI JOIN l USING (feature, cell_type, condition) SEMI JOIN g USING (feature, cell_type)"""),
    "d12_design_rows": (d12, f"WITH {SM} SELECT sample_id, 'intercept' AS \"column\", CAST(1 AS DOUBLE) AS value FROM sm UNION ALL SELECT sample_id, 'cell_type=' || cell_type, CAST(1 AS DOUBLE) FROM sm WHERE cell_type > (SELECT min(cell_type) FROM sm) UNION ALL SELECT sample_id, 'subject=' || subject, CAST(1 AS DOUBLE) FROM sm WHERE subject > (SELECT min(subject) FROM sm)"),
    "d13_dedup_candidates": (d13, f"""WITH {BLOCKS}, c AS (SELECT block_id, gene_id, list(tx_id ORDER BY tx_id) AS t, list(path_index ORDER BY tx_id) AS l FROM blocks GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY gene_id, t, list_transform(l, lambda x: list_position(l, x)) ORDER BY block_id) AS rn FROM c) SELECT block_id AS test_id, gene_id FROM k WHERE rn = 1"""),
    "d14_joint_gene_candidates": (d14, f"WITH {BLOCKS} SELECT DISTINCT gene_id, strand AS design, gene_id || '|' || strand AS test_id FROM blocks"),
    "d15_filter_junction_groups": (d15, f"""WITH {GROUPS}, r AS (SELECT intron AS junction_id, gene_id || '_' || strand AS intron_group, CAST(regexp_extract(tx_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM kept),
        c AS (SELECT junction_id, intron_group, k % 4 AS sm, k % 2 AS side, sum(k % 9) AS v FROM r GROUP BY ALL),
        jt AS (SELECT intron_group, junction_id, sum(v) AS t FROM c GROUP BY ALL HAVING count(DISTINCT CASE WHEN side = 0 AND v > 0 THEN sm END) >= 1 AND count(DISTINCT CASE WHEN side = 1 AND v > 0 THEN sm END) >= 1),
        sh AS (SELECT intron_group, junction_id, t / CAST(nullif(sum(t) OVER (PARTITION BY intron_group), 0) AS DOUBLE) AS share FROM jt), e AS (SELECT *, count(*) OVER (PARTITION BY intron_group) AS n FROM sh WHERE share >= 0.02)
        SELECT intron_group, junction_id, round(share, 6) AS share FROM e WHERE n >= 2"""),
    "d16_attach_group_metadata": (d16, f"WITH {GROUPS} SELECT chrom || '_' || CAST(floor(start / 15000) AS BIGINT) AS big, CASE WHEN count(DISTINCT gene_id) = 1 THEN min(gene_id) END AS gene_id FROM grp GROUP BY 1"),
    "d17_contrast_sheet": (d17, f"WITH {PLAN}, x AS (SELECT contrast_id, unnest(sa) AS sample_id, 'A' AS grp FROM pl UNION ALL SELECT contrast_id, unnest(sb), 'B' FROM pl) SELECT contrast_id, sample_id, grp, subject FROM x JOIN sm USING (sample_id)"),
    "d18_top_paths": (d18, """WITH v AS (SELECT sample, substr(tx_id, 1, 3) AS block_id, substr(tx_id, -1) AS path, CAST(sum(num_reads) AS DOUBLE) AS p FROM {quant} GROUP BY ALL),
        b AS (SELECT block_id, path, row_number() OVER (PARTITION BY block_id ORDER BY sum(p) DESC, path) AS r FROM v GROUP BY block_id, path)
        SELECT sample, block_id, path, round(p / sum(p) OVER (PARTITION BY block_id, sample), 6) AS p FROM v JOIN b USING (block_id, path) WHERE r <= 3"""),
    "d19_range_lookup": (d19, "SELECT DISTINCT 'SRR' || o_orderkey AS name, o_orderkey AS number, 'b' || CAST(floor(o_orderkey / 5000) AS BIGINT) AS batch FROM orders"),
}
