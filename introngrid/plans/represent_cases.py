"""Queries over cell representations, on the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from introngrid.operators import represent as R
from introngrid.plans.adapters import view

#: Cells of the reduced tables that the SQL texts below use: four dimensions and a fixed number of loadings.
FC = "fc AS (SELECT vec_id AS cell_id, [abs(CAST(embedding[1] AS DOUBLE)), abs(CAST(embedding[2] AS DOUBLE)), abs(CAST(embedding[3] AS DOUBLE)), abs(CAST(embedding[4] AS DOUBLE))] AS r, 'L' || label AS label, 'G' || (vec_id % 20) AS grp FROM embeddings)"
LD = "ld AS (SELECT t AS gene_id, [t % 5 / 5.0, t % 3 / 3.0, t % 7 / 7.0, (t % 2) * 0.5] AS l FROM (SELECT DISTINCT tx_id AS t FROM {ec_tx}) q)"
DOT = "(r[1] * l[1] + r[2] * l[2] + r[3] * l[3] + r[4] * l[4])"
EXPR = f"{FC}, {LD}, x0 AS (SELECT cell_id, gene_id, greatest({DOT}, 0) AS x FROM fc CROSS JOIN ld), ex AS (SELECT cell_id, gene_id, ln(1 + x * 10000 / sum(x) OVER (PARTITION BY cell_id)) AS x FROM x0)"


def cells(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    part = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    return e.select(F.col("vec_id").alias("cell_id"), part.alias("right"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), F.concat(F.lit("G"), (F.col("vec_id") % 20).cast("string")).alias("grp"))


def loadings(s, d):
    t = view(s, d, "ec_tx").select(F.col("tx_id").alias("gene_id")).distinct()
    g = F.col("gene_id")
    return t.select("gene_id", F.array((g % 5 / 5.0).cast("double"), (g % 3 / 3.0).cast("double"), (g % 7 / 7.0).cast("double"), ((g % 2) * 0.5).cast("double")).alias("left"))


def r6(df, *names, n=6):
    for x in names:
        df = df.withColumn(x, F.round(x, n))
    return df


def r01(s, d):
    c = cells(s, d)
    return R.align_metadata(c.select("cell_id"), c.where("cell_id % 3 > 0").select("cell_id", "label", "grp").union(c.where("cell_id % 2 = 1 AND cell_id % 3 > 0").select("cell_id", "label", "grp")))


def r02(s, d):
    left = loadings(s, d).withColumnRenamed("gene_id", "tx_id")
    genes = left.select("tx_id", F.concat(F.lit("G"), (F.col("tx_id") % 6).cast("string")).alias("gene_id"))
    return r6(R.gene_loadings(left, genes), "w")


def r03(s, d):
    return r6(R.reconstruct_expression(cells(s, d), loadings(s, d)), "x")


def r04(s, d):
    return r6(R.gene_moments(R.reconstruct_expression(cells(s, d), loadings(s, d))), "mean", "variance")


def r05(s, d):
    return R.select_hvg(r6(R.gene_moments(R.reconstruct_expression(cells(s, d), loadings(s, d))), "variance"), 12).select("gene_id")


def r06(s, d):
    rows = R.reconstruct_expression(cells(s, d), loadings(s, d))
    best = R.select_hvg(R.gene_moments(rows), 12).select("gene_id")
    wide = rows.join(F.broadcast(best), "gene_id").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_id", "x"))), lambda p: p["x"]).alias("features"))
    return R.pca_embedding(wide, 3)[0].select("cell_id", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


def r07(s, d):
    counts = view(s, d, "cell_ec").withColumnRenamed("ec_id", "gene_id")
    return R.log_gene_pca(counts, 2, 0.2)[0].select("cell_id", F.transform("pc", lambda x: F.round(F.abs(x), 4)).alias("pc"))


def r07_features(s, d):
    counts = view(s, d, "cell_ec").withColumnRenamed("ec_id", "gene_id")
    return R.log_gene_features(counts, 0.2).select("cell_id", F.size("features").alias("k"), F.round(F.aggregate("features", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


def r08(s, d):
    out = R.factor_transform(cells(s, d), "log1p_l1")
    return out.select("cell_id", "active", *[F.round(F.col("right")[i], 6).alias(f"x{i}") for i in range(4)])


def r09(s, d):
    return r6(R.profile_diagnostics(cells(s, d), loadings(s, d), 10), "relative_variance", "active", "mean_norm")


def r10(s, d):
    return R.grouped_folds(cells(s, d), 3, order=F.expr("CAST(substr(grp, 2) AS INT)") * 7 % 11)


def r11(s, d):
    return R.score_labels(cells(s, d))


def r11_metrics(s, d):
    pairs = cells(s, d).select((F.col("cell_id") % 3).alias("fold"), "label", F.when(F.col("cell_id") % 4 == 0, "L0").otherwise(F.col("label")).alias("predicted"))
    return r6(R.label_metrics(pairs), "accuracy", "balanced_accuracy", "macro_f1")


def r11_summary(s, d):
    pairs = cells(s, d).select((F.col("cell_id") % 3).alias("fold"), "label", F.when(F.col("cell_id") % (F.col("cell_id") % 3 + 4) == 0, "L0").otherwise(F.col("label")).alias("predicted"))
    out = R.score_summary(R.label_metrics(pairs))
    return r6(out, *[c for c in out.columns if c != "folds"])


def r12(s, d):
    return R.kmeans_clusters(cells(s, d), 4, seed=1).select("cell_id", "cluster")


def r13(s, d):
    return r6(R.ari_nmi(cells(s, d).withColumn("cluster", F.when(F.col("cell_id") % 5 == 0, "L1").otherwise(F.col("label")))), "ari", "nmi")


def r14(s, d):
    return r6(R.silhouette(cells(s, d), order=F.col("cell_id") * 7919 % 100_003), "silhouette")


def r15(s, d):
    c = cells(s, d)
    mapping = c.select(F.concat(F.lit("n"), F.col("cell_id").cast("string")).alias("name"), "cell_id")
    return R.score_reference_embedding(c.join(mapping, "cell_id").select("name", "right"), mapping, c)


def r16(s, d):
    return R.als_factors(view(s, d, "cell_ec"), 4)[0]


CASES = {
    "r01_align_metadata": (r01, "SELECT vec_id AS cell_id, 'L' || label AS label, 'G' || (vec_id % 20) AS grp FROM embeddings WHERE vec_id % 3 > 0"),
    "r02_gene_loadings": (r02, f"WITH {LD} SELECT 'G' || (gene_id % 6) AS gene_id, k, round(sum(l[k + 1]), 6) AS w FROM ld CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) q GROUP BY 1, 2"),
    "r03_reconstruct_expression": (r03, f"WITH {EXPR} SELECT cell_id, gene_id, round(x, 6) AS x FROM ex"),
    "r04_gene_moments": (r04, f"WITH {EXPR} SELECT gene_id, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM ex GROUP BY gene_id"),
    "r05_select_hvg": (r05, f"WITH {EXPR} SELECT gene_id FROM (SELECT gene_id, round(var_samp(x), 6) AS v FROM ex GROUP BY gene_id) q ORDER BY v DESC, gene_id LIMIT 12"),
    "r06_pca_embedding": (r06, None),
    "r07_log_gene_pca": (r07, None),
    "r07_log_gene_features": (r07_features, """WITH c AS (SELECT ec_id, count(DISTINCT cell_id) AS c FROM {cell_ec} GROUP BY ec_id), g AS (SELECT ec_id FROM c WHERE c >= 0.2 * (SELECT count(DISTINCT cell_id) FROM {cell_ec})),
        x AS (SELECT cell_id, ec_id, ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY cell_id)) AS x FROM {cell_ec}) SELECT cell_id, CAST((SELECT count(*) FROM g) AS INT) AS k, round(sum(CASE WHEN ec_id IN (SELECT ec_id FROM g) THEN x ELSE 0 END), 6) AS total FROM x GROUP BY cell_id"""),
    "r08_factor_transform": (r08, f"WITH {FC}, t AS (SELECT *, r[1] + r[2] + r[3] + r[4] AS t FROM fc) SELECT cell_id, t > 0 AS active, {', '.join(f'round(ln(1 + coalesce(r[{i + 1}] / nullif(t, 0), 0) * 10000), 6) AS x{i}' for i in range(4))} FROM t"),
    "r09_profile_diagnostics": (r09, f"""WITH {FC}, {LD}, b AS (SELECT * FROM ld ORDER BY sqrt(l[1] * l[1] + l[2] * l[2] + l[3] * l[3] + l[4] * l[4]) DESC, gene_id LIMIT 10), x AS (SELECT cell_id, gene_id, greatest({DOT}, 0) AS x FROM fc CROSS JOIN b),
        p AS (SELECT *, sum(x) OVER (PARTITION BY cell_id) AS t FROM x), q AS (SELECT *, coalesce(x / nullif(t, 0), 0) AS p FROM p), g AS (SELECT avg(p) AS m, var_pop(p) AS v FROM q GROUP BY gene_id)
        SELECT round(sum(v) / sum(m * m), 6) AS relative_variance, (SELECT round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END), 6) FROM q) AS active, true AS finite, (SELECT round(avg(sqrt(r[1] * r[1] + r[2] * r[2] + r[3] * r[3] + r[4] * r[4])), 6) FROM fc) AS mean_norm FROM g"""),
    "r10_grouped_folds": (r10, f"""WITH {FC}, l AS (SELECT grp, label, count(*) AS n FROM fc GROUP BY ALL), m AS (SELECT grp, arg_max(label, (n, label)) AS label, sum(n) AS n FROM l GROUP BY grp)
        SELECT grp, CAST((row_number() OVER (PARTITION BY label ORDER BY n DESC, CAST(substr(grp, 2) AS INT) * 7 % 11, grp) - 1) % 3 AS INT) AS fold FROM m"""),
    "r11_score_labels": (r11, None),
    "r11_label_metrics": (r11_metrics, f"""WITH {FC}, p AS (SELECT cell_id % 3 AS fold, label, CASE WHEN cell_id % 4 = 0 THEN 'L0' ELSE label END AS pred FROM fc), a AS (SELECT fold, label AS n, count(*) AS a, count(*) FILTER (label = pred) AS h FROM p GROUP BY ALL), t AS (SELECT fold, pred AS n, count(*) AS p FROM p GROUP BY ALL),
        j AS (SELECT fold, coalesce(a, 0) AS a, coalesce(h, 0) AS h, coalesce(p, 0) AS p FROM a FULL JOIN t USING (fold, n)) SELECT fold, round(sum(h) / CAST(sum(a) AS DOUBLE), 6) AS accuracy, round(avg(h / CAST(nullif(a, 0) AS DOUBLE)), 6) AS balanced_accuracy, round(avg(2 * h / CAST(a + p AS DOUBLE)), 6) AS macro_f1 FROM j GROUP BY fold"""),
    "r11_score_summary": (r11_summary, f"""WITH {FC}, p AS (SELECT cell_id % 3 AS fold, label, CASE WHEN cell_id % (cell_id % 3 + 4) = 0 THEN 'L0' ELSE label END AS pred FROM fc), a AS (SELECT fold, label AS n, count(*) AS a, count(*) FILTER (label = pred) AS h FROM p GROUP BY ALL), t AS (SELECT fold, pred AS n, count(*) AS p FROM p GROUP BY ALL),
        j AS (SELECT fold, coalesce(a, 0) AS a, coalesce(h, 0) AS h, coalesce(p, 0) AS p FROM a FULL JOIN t USING (fold, n)), f AS (SELECT fold, sum(h) / CAST(sum(a) AS DOUBLE) AS x, avg(h / CAST(nullif(a, 0) AS DOUBLE)) AS y, avg(2 * h / CAST(a + p AS DOUBLE)) AS z FROM j GROUP BY fold)
        SELECT count(*) AS folds, {', '.join(f'round(avg({c}), 6) AS {n}_mean, round(stddev_samp({c}), 6) AS {n}_sd' for c, n in (('x', 'accuracy'), ('y', 'balanced_accuracy'), ('z', 'macro_f1')))} FROM f"""),
    "r12_kmeans_clusters": (r12, None),
    "r13_ari_nmi": (r13, f"""WITH {FC}, c AS (SELECT label AS a, CASE WHEN cell_id % 5 = 0 THEN 'L1' ELSE label END AS b, CAST(count(*) AS DOUBLE) AS n FROM fc GROUP BY ALL), ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b),
        z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM ra) AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS sb, (SELECT -sum(n / s * ln(n / s)) FROM c, (SELECT sum(n) AS s FROM c) q) AS h, (SELECT -sum(n / s * ln(n / s)) FROM ra, (SELECT sum(n) AS s FROM ra) q) AS ha, (SELECT -sum(n / s * ln(n / s)) FROM rb, (SELECT sum(n) AS s FROM rb) q) AS hb)
        SELECT round((ij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round((ha + hb - h) / ((ha + hb) / 2), 6) AS nmi FROM z"""),
    "r14_silhouette": (r14, f"""WITH {FC}, sp AS (SELECT * FROM fc ORDER BY cell_id * 7919 % 100003, cell_id LIMIT 10000), m AS (SELECT x.cell_id, x.label AS l, y.label AS m, avg(sqrt((x.r[1] - y.r[1]) ** 2 + (x.r[2] - y.r[2]) ** 2 + (x.r[3] - y.r[3]) ** 2 + (x.r[4] - y.r[4]) ** 2)) AS d FROM sp x JOIN sp y ON x.cell_id <> y.cell_id GROUP BY ALL),
        s AS (SELECT cell_id, max(d) FILTER (l = m) AS a, min(d) FILTER (l <> m) AS b FROM m GROUP BY cell_id) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s"""),
    "r15_score_reference_embedding": (r15, None),
    "r16_als_factors": (r16, None),
}
