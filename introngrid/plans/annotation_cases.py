"""Queries over annotation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from introngrid.operators import annotation as A
from introngrid.plans.adapters import view
from introngrid.storage import materialize

#: Introns of the transcripts, shared by several texts below.
INTRONS = """introns AS (
    SELECT tx_id, gene_id, chrom, ord, CASE WHEN stop < n_start THEN stop ELSE n_stop END AS start,
           CASE WHEN stop < n_start THEN n_start ELSE start END + 1 AS stop, CASE WHEN stop < n_start THEN '+' ELSE '-' END AS strand,
           chrom || ':' || start || '-' || stop AS left_exon, chrom || ':' || n_start || '-' || n_stop AS right_exon
    FROM (SELECT *, row_number() OVER w AS ord, lead(start) OVER w AS n_start, lead(stop) OVER w AS n_stop FROM {tx_exon} WINDOW w AS (PARTITION BY tx_id ORDER BY exon_number)) x
    WHERE n_start IS NOT NULL),
named AS (SELECT *, chrom || ':' || start || '-' || stop AS intron FROM introns)"""
LIMITED = INTRONS + ", kept AS (SELECT * FROM named WHERE abs(start - stop) > 50 AND abs(start - stop) < 5000000)"


def exons(s, d):
    return view(s, d, "tx_exon")


def g01(s, d):
    return A.filter_annotation(view(s, d, "features")).select("tx_id", "exon_number", "chrom", "gene_type", "transcript_type")


def g02(s, d):
    return A.backfill_gene_ids(view(s, d, "features")).select("tx_id", "exon_number", "ref_gene_id", "gene_name")


def g03(s, d):
    return A.introns_from_exons(exons(s, d)).select("tx_id", "ord", "intron", "strand")


def g04(s, d):
    return A.support_map(exons(s, d)).select("tx_id", "gene_id", F.array_join("introns", ",").alias("introns"), F.array_join("exons", ",").alias("exons"))


def g05(s, d):
    return A.intron_connectivity(exons(s, d)).select("intron", F.array_join("exons", ",").alias("exons"), "strand")


def g06(s, d):
    edges = A.incidence(A.support_map(exons(s, d)))
    ids = A.dense_ids(edges, "feature", "feature_id")
    return edges.join(ids, "feature").select("tx_id", "feature", "feature_id")


def g07(s, d):
    return A.add_virtual_introns(A.support_map(exons(s, d))).select("tx_id", "first_intron", "last_intron", "strand", F.size("introns").alias("n"))


def g08(s, d):
    types = view(s, d, "features").select("tx_id", "transcript_type").where("transcript_type IS NOT NULL").distinct()
    return A.intron_sources(A.introns_from_exons(exons(s, d)), types)


def g09(s, d):
    return A.tx_gene_map(exons(s, d))


def g10(s, d):
    return A.merge_intervals(view(s, d, "intervals"), ["grp"])


def g11(s, d):
    return A.constitutive_intervals(exons(s, d))


def _flat(paths="signature"):
    return F.array_join(F.transform(paths, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")


def g12(s, d):
    return A.splice_blocks(exons(s, d)).select("block_id", "tx_id", "path_index", _flat().alias("signature"))


def g13(s, d):
    return A.classify_event(A.block_paths(A.splice_blocks(exons(s, d)))).select("block_id", F.size("paths").alias("n_paths"), "event")


def g14(s, d):
    return A.event_components(A.block_paths(A.splice_blocks(exons(s, d))))


def g15(s, d):
    return A.event_type_summary(g13(s, d))


def g16(s, d):
    p = view(s, d, "pvals").select(F.col("k3").alias("test_id"), "method", F.col("p_value").alias("fdr"))
    return A.robust_catalog([p.where(F.col("method") == m) for m in ("A", "N", "R")], level=0.3)


def g16_records(s, d):
    blocks = materialize(A.splice_blocks(exons(s, d)), "blocks")  # tests, names and records come from it
    number = F.regexp_extract("block_id", r"^g(\d+):", 1).cast("long") * 7 + F.regexp_extract("block_id", r":B(\d+)$", 1).cast("long")
    results = blocks.select(F.col("block_id").alias("test_id"), number.alias("z")).distinct()
    table = lambda m: results.select("test_id", ((F.col("z") % m) / m).alias("fdr"), (F.col("z") % 50 / 10).alias("statistic"), (F.col("z") % 31 / 31).alias("p_value"), (F.col("z") % 3 + 2).alias("n_levels"))
    names = blocks.select("gene_id").distinct().where("substr(gene_id, -1) <> '3'").select("gene_id", F.concat(F.lit("N"), "gene_id").alias("gene_name"))
    out = A.catalog_records([table(5), table(7)], table(5), blocks, names, 0.5)
    return out.withColumns({"left_anchor": F.col("left_anchor.start"), "right_anchor": F.col("right_anchor.start"), "statistic": F.round("statistic", 6), "p_value": F.round("p_value", 6), "fdr": F.round("fdr", 6)})


def g17(s, d):
    return A.block_equivalence(A.splice_blocks(exons(s, d))).select("block_id", "representative")


def g18(s, d):
    blocks = materialize(A.splice_blocks(exons(s, d)).select("gene_id", "block_id", "tx_id", "path_index"), "blocks")
    results = blocks.groupBy("block_id").agg(F.count("*").alias("n_tx")).crossJoin(s.range(3).select(F.col("id").alias("cell_type")))
    return A.collapse_equivalent(results, A.block_equivalence(blocks)).select("representative", "cell_type", "n_tx")


def g19(s, d):
    blocks = A.splice_blocks(exons(s, d)).withColumn("tx_id", F.concat("tx_id", F.lit(".1")))
    return A.block_mapping(blocks, exons(s, d).where("substr(tx_id, -1) < '7'").select("tx_id"))


def _junctions(s, d):
    out = A.introns_from_exons(exons(s, d)).select("chrom", "start", "stop", "strand").distinct()
    return out.select(F.concat_ws(":", "chrom", "start", "stop", "strand").alias("junction_id"), "chrom", "start", (F.col("stop") - 1).alias("stop"), "strand")


def _one_based(s, d):
    return exons(s, d).select("chrom", "gene_id", (F.col("start") + 1).alias("start"), (F.col("stop") - 1).alias("stop"))


def g20(s, d):
    return A.annotate_junction_groups(_junctions(s, d), _one_based(s, d)).select("junction_id", "gene_id", "intron_group", "group_size")


def g21(s, d):
    genes = A.annotate_junction_groups(_junctions(s, d), _one_based(s, d))
    members = genes.select("junction_id", F.concat("chrom", F.lit("/"), F.floor(F.col("start") / 15000).cast("string")).alias("cluster"))
    return A.cluster_gene_map(members, genes)


def g22(s, d):
    t2g = A.tx_gene_map(exons(s, d))
    twins = t2g.where("substr(tx_id, -1) = '5'").select(F.col("tx_id").alias("duplicate"), F.concat(F.expr("substr(tx_id, 1, length(tx_id) - 1)"), F.lit("4")).alias("retained"))
    return A.t2t_maps(t2g, twins).join(A.dedup_t2g(t2g, twins).select("tx_id", F.lit(True).alias("kept")), "tx_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def g23(s, d):
    introns = A.introns_from_exons(exons(s, d))
    near = introns.select("intron", F.explode(F.array("left_exon", "right_exon")).alias("exon")).distinct()
    counts = exons(s, d).select(A.place().alias("exon"), F.lit(1).alias("value"))
    return A.valid_exons(near, counts, 2)


def _regions(s, d, size):
    """Windows of a size over all chromosomes, wherever an exon lies."""
    tiles = exons(s, d).select("chrom", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("w")).distinct()
    return tiles.select(F.concat_ws("/", "chrom", "w").alias("region"), "chrom", (F.col("w") * size).alias("start"), ((F.col("w") + 1) * size).alias("stop"))


def g24(s, d):
    reads = exons(s, d).withColumn("sample", F.expr("substr(tx_id, -1)"))
    return A.region_coverage(reads, _regions(s, d, 50_000))


def g24_junctions(s, d):
    return A.region_junctions(A.introns_from_exons(exons(s, d)).withColumn("sample", F.expr("substr(tx_id, -1)")).withColumn("value", F.lit(1)), _regions(s, d, 30_000))


def g25(s, d):
    q = view(s, d, "quant").select(F.expr("substr(tx_id, 1, 3)").alias("intron"), F.concat("sample", F.lit("_"), F.expr("cast(effective_length % 3 AS string)")).alias("sample"), F.col("num_reads").alias("value"))
    return A.aggregate_samples(q).select("intron", "cell_type", F.round("mean", 6).alias("mean"))


def g26(s, d):
    introns = A.introns_from_exons(exons(s, d)).select(F.col("gene_id").alias("grp"), "start", "stop")
    return A.intersect_introns(introns)


def g27(s, d):
    return A.region_models(exons(s, d), _regions(s, d, 20_000))


BLOCKS = """m AS (
    SELECT tx_id, gene_id, chrom, strand, min(start) AS start, max(stop) AS stop FROM (
        SELECT *, sum(CASE WHEN start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY tx_id ORDER BY start, stop) AS isl FROM (
            SELECT *, coalesce(max(stop) OVER (PARTITION BY tx_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS pm FROM {tx_exon}) a) b
    GROUP BY tx_id, gene_id, chrom, strand, isl),
edge AS (SELECT DISTINCT gene_id, start AS a FROM m UNION SELECT gene_id, stop FROM m),
seg AS (SELECT * FROM (SELECT gene_id, a, lead(a) OVER (PARTITION BY gene_id ORDER BY a) AS b FROM edge) x WHERE b IS NOT NULL),
cov AS (SELECT s.gene_id, a, b FROM seg s JOIN m ON m.gene_id = s.gene_id AND m.start <= a AND m.stop >= b GROUP BY s.gene_id, a, b
        HAVING count(DISTINCT tx_id) = (SELECT count(DISTINCT tx_id) FROM m q WHERE q.gene_id = s.gene_id)),
anc AS (SELECT gene_id, min(a) AS start, max(b) AS stop FROM (
        SELECT *, sum(CASE WHEN a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id ORDER BY a) AS isl FROM (
            SELECT *, coalesce(lag(b) OVER (PARTITION BY gene_id ORDER BY a), a) AS pb FROM cov) x) y GROUP BY gene_id, isl),
gene AS (SELECT gene_id, any_value(strand) AS strand, min(start) AS lo, max(stop) AS hi FROM m GROUP BY gene_id HAVING count(DISTINCT tx_id) > 1),
blk AS (SELECT g.gene_id, strand, start AS ls, stop AS b0, lead(start) OVER w AS rs, coalesce(lead(start) OVER w, hi) AS b1 FROM anc JOIN gene g USING (gene_id) WINDOW w AS (PARTITION BY g.gene_id ORDER BY start)
        UNION ALL SELECT g.gene_id, strand, NULL, lo, min(start), min(start) FROM anc JOIN gene g USING (gene_id) GROUP BY ALL
        UNION ALL SELECT gene_id, strand, NULL, lo, NULL, hi FROM gene WHERE gene_id NOT IN (SELECT gene_id FROM anc)),
sig AS (SELECT k.gene_id, strand, ls, rs, b0, b1, t.tx_id,
           coalesce((SELECT list({'start': greatest(m.start, b0), 'stop': least(m.stop, b1)} ORDER BY m.start * CASE WHEN k.strand = '+' THEN 1 ELSE -1 END)
                     FROM m WHERE m.tx_id = t.tx_id AND m.start < b1 AND m.stop > b0), []) AS signature
        FROM blk k JOIN (SELECT DISTINCT gene_id, tx_id FROM m) t USING (gene_id) WHERE b0 < b1),
idx AS (SELECT *, dense_rank() OVER (PARTITION BY gene_id, b0, b1 ORDER BY signature) - 1 AS path_index FROM sig),
many AS (SELECT * FROM (SELECT *, max(path_index) OVER (PARTITION BY gene_id, b0, b1) AS mx FROM idx) x WHERE mx > 0),
blocks AS (SELECT *, gene_id || ':B' || dense_rank() OVER (PARTITION BY gene_id ORDER BY b0 * CASE WHEN strand = '+' THEN 1 ELSE -1 END) AS block_id FROM many)"""
PAIR = """CASE WHEN len(o1) = 0 OR len(o2) = 0 THEN CASE WHEN len(o1) + len(o2) = 1 THEN 'cassette exon' ELSE 'multi-exon skipping' END
    WHEN len(o1) = 1 AND len(o2) = 1 AND o1[1].start = o2[1].start AND o1[1].stop <> o2[1].stop THEN CASE WHEN strand = '+' THEN 'alternative donor' ELSE 'alternative acceptor' END
    WHEN len(o1) = 1 AND len(o2) = 1 AND o1[1].stop = o2[1].stop AND o1[1].start <> o2[1].start THEN CASE WHEN strand = '+' THEN 'alternative acceptor' ELSE 'alternative donor' END
    WHEN len(o1) = 1 AND len(o2) = 1 AND (o1[1].stop <= o2[1].start OR o2[1].stop <= o1[1].start) THEN 'mutually exclusive exons'
    WHEN len(o1) = 1 AND len(o2) > 1 AND o1[1].start <= list_min(list_transform(o2, lambda x: x.start)) AND o1[1].stop >= list_max(list_transform(o2, lambda x: x.stop)) THEN 'retained intron'
    WHEN len(o2) = 1 AND len(o1) > 1 AND o2[1].start <= list_min(list_transform(o1, lambda x: x.start)) AND o2[1].stop >= list_max(list_transform(o1, lambda x: x.stop)) THEN 'retained intron'
    ELSE 'complex internal' END"""
EVENTS = BLOCKS + f""",
path AS (SELECT DISTINCT block_id, strand, ls, rs, path_index, signature FROM blocks),
pair AS (SELECT x.block_id, x.strand, x.ls, x.rs, list_filter(x.signature, lambda e: NOT list_contains(y.signature, e)) AS o1, list_filter(y.signature, lambda e: NOT list_contains(x.signature, e)) AS o2
         FROM path x JOIN path y ON x.block_id = y.block_id AND x.path_index < y.path_index),
kind AS (SELECT block_id, strand, ls, rs, {PAIR} AS kind FROM pair),
event AS (SELECT b.block_id, n_paths, CASE WHEN b.ls IS NULL AND b.rs IS NULL THEN 'whole-gene complex'
        WHEN b.ls IS NULL THEN CASE WHEN b.strand = '+' THEN 'alternative first region' ELSE 'alternative last region' END
        WHEN b.rs IS NULL THEN CASE WHEN b.strand = '+' THEN 'alternative last region' ELSE 'alternative first region' END
        WHEN n_paths = 2 THEN k.kind ELSE 'compound internal' END AS event
    FROM (SELECT block_id, strand, ls, rs, CAST(count(*) AS INT) AS n_paths FROM path GROUP BY ALL) b LEFT JOIN (SELECT block_id, min(kind) AS kind FROM kind GROUP BY block_id HAVING count(*) = 1) k USING (block_id))"""
EQUIV = BLOCKS + """,
mem AS (SELECT gene_id, block_id, path_index, list(tx_id ORDER BY tx_id) AS g FROM blocks GROUP BY ALL),
eq AS (SELECT gene_id, block_id, list(g ORDER BY g) AS k FROM mem GROUP BY ALL),
rep AS (SELECT block_id, arg_min(block_id, CAST(regexp_extract(block_id, ':B([0-9]+)$', 1) AS INT)) OVER (PARTITION BY gene_id, k) AS representative FROM eq)"""
GROUPS = LIMITED + """,
j AS (SELECT DISTINCT chrom || ':' || start || ':' || stop || ':' || strand AS junction_id, chrom, start, stop - 1 AS stop, strand FROM kept),
b AS (SELECT DISTINCT chrom, gene_id, start AS pos FROM {tx_exon} UNION SELECT chrom, gene_id, stop FROM {tx_exon}),
s AS (SELECT junction_id, chrom, start AS pos FROM j UNION ALL SELECT junction_id, chrom, stop FROM j),
u AS (SELECT junction_id, min(gene_id) AS gene_id FROM s JOIN b USING (chrom, pos) GROUP BY junction_id HAVING count(DISTINCT gene_id) = 1),
grp AS (SELECT junction_id, j.chrom, j.start, gene_id, CASE WHEN gene_id IS NOT NULL THEN gene_id || '_' || chrom || '_' || CASE WHEN strand = '+' THEN stop ELSE start END || '_' || strand END AS intron_group FROM j LEFT JOIN u USING (junction_id))"""

CASES = {
    "g01_filter_annotation": (g01, """SELECT tx_id, exon_number, chrom, gene_type, transcript_type FROM {features}
        WHERE chrom LIKE '%chr%' AND chrom <> 'chrM' AND coalesce(gene_type NOT LIKE '%artifact%' AND gene_type NOT LIKE '%pseudogene%', true) AND coalesce(transcript_type NOT LIKE '%decay%', true)"""),
    "g02_backfill_gene_ids": (g02, """SELECT tx_id, exon_number, coalesce(first_value(ref_gene_id IGNORE NULLS) OVER w, ref_gene_id) AS ref_gene_id, coalesce(first_value(gene_name IGNORE NULLS) OVER w, gene_name) AS gene_name
        FROM {features} WINDOW w AS (PARTITION BY gene_id ORDER BY tx_id, exon_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "g03_introns": (g03, f"WITH {LIMITED} SELECT tx_id, ord, intron, strand FROM kept"),
    "g04_support_map": (g04, f"""WITH {LIMITED}, i AS (SELECT tx_id, string_agg(intron, ',' ORDER BY ord) AS introns FROM kept GROUP BY tx_id),
        e AS (SELECT tx_id, min(gene_id) AS gene_id, string_agg(chrom || ':' || start || '-' || stop, ',' ORDER BY exon_number) AS exons FROM {{tx_exon}} GROUP BY tx_id)
        SELECT tx_id, gene_id, coalesce(introns, '') AS introns, exons FROM e LEFT JOIN i USING (tx_id)"""),
    "g05_intron_connectivity": (g05, f"""WITH {INTRONS}, n AS (SELECT intron, left_exon AS e FROM named UNION SELECT intron, right_exon FROM named)
        SELECT intron, string_agg(e, ',' ORDER BY e) AS exons, (SELECT arg_max(strand, (gene_id, tx_id, ord)) FROM named x WHERE x.intron = n.intron) AS strand FROM n GROUP BY intron"""),
    "g06_incidence": (g06, f"WITH {LIMITED}, e AS (SELECT DISTINCT tx_id, intron AS feature FROM kept) SELECT tx_id, feature, dense_rank() OVER (ORDER BY feature) - 1 AS feature_id FROM e"),
    "g07_virtual_introns": (g07, f"""WITH {LIMITED}, e AS (SELECT tx_id, min(gene_id) AS gene_id, min(chrom) AS chrom, count(*) AS ne, arg_min(start, exon_number) AS fs, arg_min(stop, exon_number) AS fe, arg_max(start, exon_number) AS ls, arg_max(stop, exon_number) AS le FROM {{tx_exon}} GROUP BY tx_id),
        g AS (SELECT gene_id, min(least(fs, ls)) - 500 AS lo, max(greatest(fe, le)) + 500 AS hi, coalesce(arg_max(fs <= ls, tx_id) FILTER (ne > 1), arg_min(fs <= ls, tx_id)) AS fwd FROM e GROUP BY gene_id),
        k AS (SELECT tx_id, count(*) AS c FROM kept GROUP BY tx_id)
        SELECT tx_id, CASE WHEN fwd THEN chrom || ':' || lo || '-' || fs ELSE chrom || ':' || fe || '-' || hi END AS first_intron,
               CASE WHEN fwd THEN chrom || ':' || le || '-' || hi ELSE chrom || ':' || lo || '-' || ls END AS last_intron, CASE WHEN fwd THEN '+' ELSE '-' END AS strand, CAST(coalesce(c, 0) + 2 AS INT) AS n
        FROM e JOIN g USING (gene_id) LEFT JOIN k USING (tx_id)"""),
    "g08_intron_sources": (g08, f"""WITH {LIMITED}, x AS (SELECT DISTINCT intron, transcript_type FROM kept JOIN (SELECT DISTINCT tx_id, transcript_type FROM {{features}} WHERE transcript_type IS NOT NULL) t USING (tx_id))
        SELECT intron, string_agg(transcript_type, ',' ORDER BY transcript_type) AS sources FROM x GROUP BY intron"""),
    "g09_tx_gene_map": (g09, "SELECT DISTINCT tx_id, gene_id FROM {tx_exon}"),
    "g10_merge_intervals": (g10, """SELECT grp, min(start) AS start, max(stop) AS stop FROM (
        SELECT *, sum(CASE WHEN start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM (
            SELECT *, coalesce(max(stop) OVER (PARTITION BY grp ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS pm FROM {intervals}) a) b GROUP BY grp, isl"""),
    "g11_constitutive_intervals": (g11, f"WITH {BLOCKS} SELECT gene_id, start, stop FROM anc"),
    "g12_splice_blocks": (g12, f"WITH {BLOCKS} SELECT block_id, tx_id, path_index, coalesce(array_to_string(list_transform(signature, lambda x: x.start || '-' || x.stop), ','), '') AS signature FROM blocks"),
    "g13_classify_event": (g13, f"WITH {EVENTS} SELECT block_id, n_paths, event FROM event"),
    "g14_event_components": (g14, f"WITH {EVENTS} SELECT block_id, coalesce(string_agg(DISTINCT CASE WHEN kind <> 'complex internal' THEN kind END, ',' ORDER BY CASE WHEN kind <> 'complex internal' THEN kind END), '') AS components FROM kind GROUP BY block_id"),
    "g15_event_type_summary": (g15, f"WITH {EVENTS} SELECT event, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM event GROUP BY event"),
    "g16_robust_catalog": (g16, "SELECT k3 AS test_id FROM {pvals} WHERE method = 'A' AND p_value < 0.3 INTERSECT SELECT k3 FROM {pvals} WHERE method = 'N' AND p_value < 0.3 INTERSECT SELECT k3 FROM {pvals} WHERE method = 'R' AND p_value < 0.3"),
    "g16_catalog_records": (g16_records, f"""WITH {EVENTS}, z AS (SELECT DISTINCT block_id, gene_id, strand, ls, rs, CAST(regexp_extract(block_id, '^g([0-9]+):', 1) AS BIGINT) * 7 + CAST(regexp_extract(block_id, ':B([0-9]+)$', 1) AS BIGINT) AS z FROM blocks),
        cm AS (SELECT block_id, coalesce(string_agg(DISTINCT CASE WHEN kind <> 'complex internal' THEN kind END, ',' ORDER BY CASE WHEN kind <> 'complex internal' THEN kind END), '') AS components FROM kind GROUP BY block_id),
        st AS (SELECT b.block_id, max(anc.start) FILTER (anc.stop = b.b0) AS la FROM (SELECT DISTINCT block_id, gene_id, b0, ls FROM blocks) b LEFT JOIN anc ON anc.gene_id = b.gene_id AND b.ls IS NOT NULL GROUP BY b.block_id)
        SELECT z.block_id AS test_id, z.gene_id, CASE WHEN substr(z.gene_id, -1) <> '3' THEN 'N' || z.gene_id ELSE z.gene_id END AS gene_name, event, components, c.chrom, z.strand, la AS left_anchor, rs AS right_anchor, n_paths, z % 3 + 2 AS n_levels,
            round(z % 50 / CAST(10 AS DOUBLE), 6) AS statistic, round(z % 31 / CAST(31 AS DOUBLE), 6) AS p_value, round(z % 5 / CAST(5 AS DOUBLE), 6) AS fdr
        FROM z JOIN event e USING (block_id) JOIN cm USING (block_id) JOIN st USING (block_id) JOIN (SELECT DISTINCT gene_id, chrom FROM m) c ON c.gene_id = z.gene_id WHERE z % 5 < 2.5 AND z % 7 < 3.5"""),
    "g17_block_equivalence": (g17, f"WITH {EQUIV} SELECT block_id, representative FROM rep"),
    "g18_collapse_equivalent": (g18, f"""WITH {EQUIV}, c AS (SELECT block_id, count(*) AS n_tx, unnest([0, 1, 2]) AS cell_type FROM blocks GROUP BY block_id),
        r AS (SELECT representative, cell_type, n_tx, row_number() OVER (PARTITION BY representative, cell_type ORDER BY block_id) AS rn FROM c JOIN rep USING (block_id))
        SELECT representative, CAST(cell_type AS BIGINT) AS cell_type, n_tx FROM r WHERE rn = 1"""),
    "g19_block_mapping": (g19, f"""WITH {BLOCKS}, k AS (SELECT block_id, tx_id, dense_rank() OVER (PARTITION BY block_id ORDER BY path_index) - 1 AS path FROM blocks WHERE substr(tx_id, -1) < '7')
        SELECT block_id, tx_id, path FROM (SELECT *, max(path) OVER (PARTITION BY block_id) AS mx FROM k) x WHERE mx > 0"""),
    "g20_junction_groups": (g20, f"WITH {GROUPS} SELECT junction_id, gene_id, intron_group, CASE WHEN intron_group IS NOT NULL THEN count(*) OVER (PARTITION BY intron_group) END AS group_size FROM grp"),
    "g21_cluster_gene_map": (g21, f"WITH {GROUPS} SELECT chrom || '/' || CAST(floor(start / 15000) AS BIGINT) AS cluster, min(gene_id) AS gene_id FROM grp WHERE gene_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gene_id) = 1"),
    "g22_t2t_maps": (g22, "SELECT DISTINCT tx_id, CASE WHEN substr(tx_id, -1) = '5' THEN substr(tx_id, 1, length(tx_id) - 1) || '4' ELSE tx_id END AS retained, gene_id, substr(tx_id, -1) <> '5' AS kept FROM {tx_exon}"),
    "g23_valid_exons": (g23, f"""WITH {LIMITED}, n AS (SELECT intron, left_exon AS e FROM kept UNION SELECT intron, right_exon FROM kept),
        c AS (SELECT chrom || ':' || start || '-' || stop AS e FROM {{tx_exon}} GROUP BY 1 HAVING count(*) >= 2)
        SELECT intron, string_agg(e, ',' ORDER BY e) AS exons FROM n JOIN c USING (e) GROUP BY intron"""),
    "g24_region_coverage": (g24, """WITH e AS (SELECT substr(tx_id, -1) AS sample, strand, chrom, unnest(range(start, stop)) AS pos FROM {tx_exon}),
        n AS (SELECT chrom || '/' || CAST(floor(pos / 50000) AS BIGINT) AS region, sample, strand, pos, count(*) AS depth FROM e GROUP BY ALL),
        g AS (SELECT *, pos - row_number() OVER (PARTITION BY region, sample, strand, depth ORDER BY pos) AS run FROM n)
        SELECT region, sample, strand, min(pos) AS start, max(pos) + 1 AS stop, depth FROM g GROUP BY region, sample, strand, depth, run"""),
    "g24_region_junctions": (g24_junctions, f"""WITH {LIMITED}, w AS (SELECT DISTINCT chrom, unnest(range(CAST(floor(start / 30000) AS BIGINT), CAST(floor((stop - 1) / 30000) AS BIGINT) + 1)) AS w FROM {{tx_exon}})
        SELECT chrom || '/' || w AS region, substr(tx_id, -1) AS sample, strand, start, stop, count(*) AS n FROM kept JOIN w USING (chrom) WHERE start >= w * 30000 AND stop <= (w + 1) * 30000 GROUP BY ALL"""),
    "g25_aggregate_samples": (g25, "SELECT substr(tx_id, 1, 3) AS intron, sample AS cell_type, round(avg(num_reads), 6) AS mean FROM {quant} GROUP BY ALL"),
    "g26_intersect_introns": (g26, f"""WITH RECURSIVE {LIMITED}, rn AS (SELECT gene_id AS grp, start, stop, row_number() OVER (PARTITION BY gene_id ORDER BY start, stop) AS i FROM kept),
        fold AS (SELECT grp, i, start AS s, stop AS e, 1 AS k FROM rn WHERE i = 1
            UNION ALL SELECT f.grp, r.i, CASE WHEN r.start > f.e THEN r.start ELSE greatest(f.s, r.start) END, CASE WHEN r.start > f.e THEN r.stop ELSE least(f.e, r.stop) END, f.k + CASE WHEN r.start > f.e THEN 1 ELSE 0 END FROM fold f JOIN rn r ON r.grp = f.grp AND r.i = f.i + 1)
        SELECT grp, arg_max(s, i) AS start, arg_max(e, i) AS stop FROM fold GROUP BY grp, k"""),
    "g27_region_models": (g27, """WITH w AS (SELECT *, unnest(range(CAST(floor(start / 20000) AS BIGINT), CAST(floor((stop - 1) / 20000) AS BIGINT) + 1)) AS w FROM {tx_exon}),
        c AS (SELECT chrom || '/' || w AS region, tx_id, greatest(start, w * 20000) AS start, least(stop, (w + 1) * 20000) AS stop FROM w),
        n AS (SELECT *, lead(start) OVER (PARTITION BY region, tx_id ORDER BY start) AS nx FROM c)
        SELECT region, tx_id, 'exon' AS kind, start, stop FROM c UNION ALL SELECT region, tx_id, 'intron', stop, nx FROM n WHERE nx > stop"""),
}
