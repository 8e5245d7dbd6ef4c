"""Range-partitioned scans, tiled products and the operators built on them, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from introngrid.functions import scan
from introngrid.functions.tiles import by_tiles, matrix
from introngrid.functions.windows import bh, islands, wide_islands
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C
from introngrid.operators import quant as Q
from introngrid.operators import stats as S


def plain_bh(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_one_key_of_a_million_rows_spreads_over_many_tasks(spark):
    rows = spark.range(1_000_000).select("id", F.lit("m").alias("method"), ((F.col("id") * 7919) % 1_000_003 / 1_000_003).alias("p"))
    sizes = [r["count"] for r in scan.Ranges(rows, ["method"], ["p"], 64).rows.groupBy("__part").count().collect()]
    assert len(sizes) >= 50 and max(sizes) < 40_000
    out = bh(rows, "p", ["method"], ranges=64)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    windows = re.findall(r"\w+\(([^()]*)\) windowspecdefinition\(([^)]*)", plan)
    assert windows and all("__part" in spec or value.startswith(("__t#", "1")) for value, spec in windows)  # whole keys only over one row a range
    got = out.agg(F.sum("fdr").alias("s"), F.min("fdr").alias("lo"), F.count("*").alias("n")).first()
    want = plain_bh((np.arange(1_000_000) * 7919) % 1_000_003 / 1_000_003)
    assert got["n"] == 1_000_000 and abs(got["s"] - want.sum()) < 1e-6 * want.sum() and abs(got["lo"] - want.min()) < 1e-12


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_bh_with_ties_nulls_and_many_keys(spark, ranges):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, "one"]) if i else "lone", rng.choice([None, 0.0, 0.5, 1.0, round(rng.random(), 3)])) for i in range(400)]
    got = {r["id"]: r["fdr"] for r in bh(spark.createDataFrame(rows, "id int, k string, p double"), "p", ["k"], ranges=ranges).collect()}
    for key in {k for _, k, _ in rows}:
        mine = [(i, p) for i, k, p in rows if k == key]
        known = [(i, p) for i, p in mine if p is not None]
        for (i, _), q in zip(known, plain_bh(np.array([p for _, p in known])) if known else [], strict=True):
            assert abs(got[i] - q) < 1e-12
        assert all(got[i] is None for i, p in mine if p is None)


def test_islands_of_tiles_equal_islands_of_a_window(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), s := rng.randint(0, 3000), s + rng.choice([0, 1, 5, 30, 800])) for i in range(500)] + [(900, "x", 10, 2999), (901, "y", 5, 5), (901, "y", 5, 5)]
    df = spark.createDataFrame(rows, "id int, k string, start long, stop long")
    for touching in (True, False):
        pick = lambda d: sorted(map(str, d.select("id", "island").collect()))
        assert pick(wide_islands(df, ["k"], ties=["id"], touching=touching, ranges=11)) == pick(islands(df, ["k"], ties=["id"], touching=touching))


def test_percentiles_and_middle_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([None, 1.0, 1.0, rng.random() * 9, -3.5])) for _ in range(301)] + [("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["quantiles"] for r in scan.percentiles(df, "x", [0, 0.1, 0.5, 0.95, 1], ["k"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([x for y, x in rows if y == k and x is not None], [0, 0.1, 0.5, 0.95, 1]))
    assert abs(scan.percentiles(df, "x", [0.5]).first()["quantiles"][0] - np.median([x for _, x in rows if x is not None])) < 1e-12
    for r in scan.mid_ranks(df, "x", ["k"], "r").collect():
        mine = [x for k, x in rows if k == r["k"]]
        less = sum((x is None and r["x"] is not None) or (x is not None and r["x"] is not None and x < r["x"]) for x in mine)
        assert r["r"] == less + (sum(x == r["x"] for x in mine) + 1) / 2
    empty = df.where("false")
    assert bh(empty, "x", ["k"]).count() == 0 and scan.percentiles(empty, "x", [0.5], ["k"]).count() == 0 and wide_islands(empty.selectExpr("k", "1L AS start", "2L AS stop"), ["k"]).count() == 0


def test_coverage_of_regions_base_by_base(spark, monkeypatch):
    monkeypatch.setattr(A, "TILE", 64)
    rng = random.Random(6)
    reads = [(rng.choice(["c1", "c2"]), rng.choice("st"), "+", s := rng.randint(0, 900), s + rng.choice([0, 1, 40, 300])) for _ in range(150)]
    regions = [("r1", "c1", 100, 500), ("r2", "c1", 450, 460), ("r3", "c2", 0, 2000), ("r4", "c3", 0, 10), ("r5", "c1", 7, 7)]
    got = A.region_coverage(spark.createDataFrame(reads, "chrom string, sample string, strand string, start long, stop long"), spark.createDataFrame(regions, "region string, chrom string, start long, stop long")).collect()
    depth = {}
    for name, chrom, lo, hi in regions:
        for c, sample, _, a, b in reads:
            for pos in range(max(a, lo), min(b, hi)) if c == chrom else ():
                depth[name, sample, pos] = depth.get((name, sample, pos), 0) + 1
    assert {(r["region"], r["sample"], p): r["depth"] for r in got for p in range(r["start"], r["stop"])} == depth
    spans = {(r["region"], r["sample"], r["stop"]): r["depth"] for r in got}
    assert all(spans.get((r["region"], r["sample"], r["start"])) != r["depth"] for r in got)  # stretches are as long as can be


def test_constitutive_intervals_base_by_base(spark):
    rng = random.Random(7)
    exons = [(f"t{g}.{t}", f"g{g}", "c", "+", s := rng.randint(0, 200), s + rng.randint(5, 90)) for g in range(6) for t in range(3) for _ in range(5)]
    got = A.constitutive_intervals(spark.createDataFrame(exons, "tx_id string, gene_id string, chrom string, strand string, start long, stop long")).collect()
    for gene in {e[1] for e in exons}:
        covers = [{p for x in exons if x[0] == t for p in range(x[4], x[5])} for t in {e[0] for e in exons if e[1] == gene}]
        assert {p for r in got if r["gene_id"] == gene for p in range(r["start"], r["stop"])} == set.intersection(*covers)


def helmert(k):
    b = np.zeros((k, k - 1))
    for j in range(k - 1):
        s = np.sqrt((j + 1) * (j + 2))
        b[: j + 1, j], b[j + 1, j] = 1 / s, -(j + 1) / s
    return b


def test_effective_size_of_several_paths(spark):
    rng, rows = np.random.default_rng(8), []
    for k in (2, 3, 4, 6):
        p = rng.dirichlet(np.ones(k))
        unit = helmert(k).T @ np.diag(1 / p) @ helmert(k)
        rows.append((p.tolist(), (unit / 37.5).ravel().tolist(), 1000, 37.5))
        noisy = unit / 20 + np.diag(rng.random(k - 1))
        rows.append((p.tolist(), noisy.ravel().tolist(), 1000, float((unit * unit).sum() / (unit * noisy).sum())))
        rows.append((p.tolist(), (unit / 37.5).ravel().tolist(), 5, 5.0))
    rows += [([0.5, 0.6], [1.0], 9, None), ([1.0], [], 9, None), ([0.0, 1.0], [1.0], 9, None), ([0.5, 0.5], [1.0, 1.0], 9, None), ([0.5, 0.5], [-1.0], 9, None), (None, None, 9, None)]
    for r in S.effective_counts_ilr(spark.createDataFrame(rows, "p array<double>, cov array<double>, umis long, want double")).collect():
        assert r["size"] == r["want"] or abs(r["size"] - r["want"]) < 1e-9 * r["want"]
        assert r["size"] is None or np.allclose(r["counts"], np.array(r["p"]) * r["size"])


def test_calibration_by_depth_pools_small_strata(spark):
    rng = random.Random(9)
    tests = [("m", i, rng.choice([0.1, 0.4, rng.random()]), float(rng.randint(1, 50)), 1 if i < 50 else 2 + i % 7) for i in range(70)]
    nulls = [("m", i, rng.choice([0.1, 0.4, rng.random()]), 1 if i < 50 else 2 + i % 7) for i in range(75) for _ in range(3)]
    got, null = S.calibrate_by_depth(spark.createDataFrame(tests, "method string, test_id int, p_value double, depth double, df int"), spark.createDataFrame(nulls, "method string, test_id int, p_value double, df int"), 2, least=20)
    edge = np.quantile([t[3] for t in tests], 0.5)
    bins = {t[1]: int(t[3] > edge) for t in tests}
    size = {}
    for t in tests:
        size[t[4], bins[t[1]]] = size.get((t[4], bins[t[1]]), 0) + 1
    stratum = lambda d, i: f"{d if size.get((d, bins.get(i, 0)), 0) >= 20 else 'rare'}:{bins.get(i, 0)}"

    def plain(i, p, s):
        pool = [x for _, j, x, d in nulls if stratum(d, j) == s and j != i]
        return (1 + sum(x <= p for x in pool)) / (1 + len(pool))

    want = {t[1]: (stratum(t[4], t[1]), round(plain(t[1], t[2], stratum(t[4], t[1])), 9)) for t in tests}
    assert {r["test_id"]: (r["stratum"], round(r["calibrated"], 9)) for r in got.collect()} == want
    assert sorted(round(r["calibrated"], 9) for r in null.collect()) == sorted(round(plain(i, p, stratum(d, i)), 9) for _, i, p, d in nulls)


def test_merged_runs_reorder_probabilities(spark):
    frame = spark.createDataFrame
    args = dict(
        runs=frame([("a", 0), ("b", 1)], "run string, ord int"), features=frame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "x"), ("b", 2, "z")], "run string, idx int, feature string"),
        membership=frame([("a", 0, 0, 0), ("a", 0, 1, 1), ("b", 7, 0, 0), ("b", 7, 1, 1), ("b", 8, 0, 2)], "run string, ec_id int, pos int, idx int"),
        cells=frame([("a", 0, "AC"), ("b", 0, "AC"), ("b", 1, "GT")], "run string, idx int, barcode string"), counts=frame([("a", 0, 0, 3), ("b", 1, 7, 4), ("b", 0, 8, 1)], "run string, cell int, ec_id int, n int"),
    )
    probs = frame([("a", 0, 0, 0, [0.4, 0.6]), ("b", 1, 7, 2, [0.6, 0.4]), ("b", 0, 8, 0, [1.0])], "run string, cell int, ec_id int, umi_rank int, probs array<double>")
    out = Q.merge_quantifications(**args, probabilities=probs)
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(out.features) == [(0, "x"), (1, "y"), (2, "z")] and rows(out.classes) == [(0, [0, 1]), (1, [2])]
    assert rows(out.cells) == [(0, "a:AC"), (1, "b:AC"), (2, "b:GT")] and rows(out.counts) == [(0, 0, 3), (1, 1, 1), (2, 0, 4)]
    assert rows(out.probabilities) == [(0, 0, 0, [0.4, 0.6]), (1, 1, 0, [1.0]), (2, 0, 2, [0.4, 0.6])]
    with pytest.raises(ValueError, match="probabilities"):
        Q.merge_quantifications(**args, probabilities=probs.withColumn("probs", F.array(F.lit(1.0))))
    with pytest.raises(ValueError, match="repeated run"):
        Q.merge_quantifications(**(args | {"runs": frame([("a", 0), ("a", 1)], "run string, ord int")}), probabilities=probs)


def test_quantification_report_refuses_what_is_wrong(spark):
    frame = spark.createDataFrame
    cells, features = frame([("a:1",), ("a:2",), ("3",)], "cell_id string"), frame([("x",), ("y",)], "feature string")
    counts, members = frame([("a:1", 0, 5), ("a:2", 1, 2)], "cell_id string, ec_id int, n int"), frame([(0, "x"), (1, "y")], "ec_id int, tx_id string")
    assert Q.quantification_report(cells, features, counts, members, prefixes=["a"], min_umis=4).first()["eligible"] == 1
    bad = [
        (dict(prefixes=["a", "b"], min_umis=1), "prefixes"), (dict(min_umis=9), "UMIs"), (dict(min_umis=1, max_total=3), "molecules"),
        (dict(min_umis=1, reference=frame([("q",)], "cell_id string")), "reference"), (dict(min_umis=1, pairs=frame([("a:1", "q")], "first string, second string")), "pair"),
    ]
    for kw, text in bad:
        with pytest.raises(ValueError, match=text):
            Q.quantification_report(cells, features, counts, members, **kw)
    for change in (dict(cells=cells.union(cells)), dict(features=features.union(features)), dict(counts=counts.withColumn("n", -F.col("n"))), dict(counts=counts.where("false"))):
        with pytest.raises(ValueError):
            Q.quantification_report(**(dict(cells=cells, features=features, counts=counts, membership=members, min_umis=1) | change))


def test_clusters_beyond_a_task_close_alike(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(f"i{i}", f"k{i % 3}", s := rng.randint(0, 60), s + rng.randint(1, 20)) for i in range(120)]
    df = spark.createDataFrame(rows, "intron string, cluster string, start long, stop long").where("cluster <> 'k2' OR start < 9")
    near = spark.createDataFrame([(f"i{i}", f"e{i % 37}") for i in range(120)], "intron string, exon string")
    pick = lambda: [sorted(map(tuple, C.refine_links(df, near if m == 3 else None, m).select("intron", "cluster", "component").collect())) for m in (2, 3)]
    whole = pick()
    monkeypatch.setattr(C, "LARGEST", 60)
    assert pick() == whole


def test_tiles_make_every_product_once(spark):
    a = spark.createDataFrame([(i % 9, [float(i), 1.0]) for i in range(30)], "i int, v array<double>")
    b = spark.createDataFrame([(j, [2.0, float(j)]) for j in range(11)], "j int, w array<double>")

    def work(x, y):
        import pandas as pd

        return pd.DataFrame({"s": (matrix(x["v"]) @ matrix(y["w"]).T).ravel()})

    got = sorted(r["s"] for r in by_tiles(a, b, work, "s double", block=4, tile=3).collect())
    assert got == sorted(2.0 * i + j for i in range(30) for j in range(11))
    assert by_tiles(a.limit(0), b, work, "s double").count() == 0


def test_silhouette_by_tiles_equals_all_pairs(spark, monkeypatch):
    from introngrid.operators import represent as R

    rng = np.random.default_rng(11)
    labels = [["a", "b", None, "", "c"][i % 4] if i else "c" for i in range(60)]
    points = rng.normal(size=(60, 3)) + np.array([{"a": 0, "b": 3, None: -3, "": 6, "c": 9}[x] for x in labels])[:, None]
    rows = [(i // 2, labels[i], points[i].tolist()) for i in range(60)]  # ids repeat
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    mean = []
    for i, x in enumerate(labels):
        own = [j for j in range(60) if labels[j] == x and j != i]
        b = min(d[i, [j for j in range(60) if labels[j] == y]].mean() for y in set(labels) - {x})
        a = d[i, own].mean() if own else 0
        mean.append((b - a) / max(a, b) if own else 0.0)
    cells = spark.createDataFrame(rows, "cell_id int, label string, right array<double>")
    assert abs(R.silhouette(cells).first()[0] - np.mean(mean)) < 1e-9


def test_features_of_cells_without_kept_genes(spark):
    from introngrid.operators import represent as R

    counts = spark.createDataFrame([(1, "g", 5), (1, "h", 5), (2, "g", 1), (3, "rare", 2)], "cell_id int, gene_id string, n int")
    got = {r["cell_id"]: [round(x, 6) for x in r["features"]] for r in R.log_gene_features(counts, 0.5).collect()}
    assert got == {1: [round(float(np.log1p(5000)), 6)], 2: [round(float(np.log1p(10000)), 6)], 3: [0.0]}


def test_weights_fall_back_where_no_run_has_the_set(spark):
    frame = spark.createDataFrame
    members = frame([(0, "a"), (0, "b"), (1, "b")], "ec_id int, tx_id string")
    rich = frame([(0, "a,b", "a", 0.8, 3), (1, "a,b", "a", 0.4, 1), (0, "a,b", "b", 0.2, 3)], "run int, key string, tx_id string, weight double, count int")
    got = {(r["ec_id"], r["tx_id"]): (round(r["a"], 6), r["matched"]) for r in Q.ec_design_positional(members, rich, frame([("a", 4.0), ("b", 0.5)], "tx_id string, length double")).collect()}
    assert got == {(0, "a"): (1.0, True), (0, "b"): (round(0.2 / 1.2, 6), True), (1, "b"): (round(1 / 1.2, 6), False)}
    counts = frame([(1, 0, 5), (1, 1, 7)], "cell_id int, ec_id int, n int")
    genes = frame([(0, "G"), (1, "G")], "ec_id int, gene_id string")
    assert [tuple(r) for r in Q.modeled_gene_umis(counts, genes, frame([(0, "G"), (0, "G"), (1, "H")], "ec_id int, gene_id string")).collect()] == [(1, "G", 5)]
