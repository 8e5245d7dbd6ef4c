"""Hand-worked cases for the splicing operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from introngrid.functions.tails import beta_i, gamma_q
from introngrid.functions.windows import bh, merge_intervals, simes
from introngrid.graph import connected_components
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C
from introngrid.operators import cohort as D
from introngrid.operators import quant as Q
from introngrid.operators import represent as R
from introngrid.operators import stats as S
from introngrid.sources import scans as SC

EXON = "tx_id string, gene_id string, chrom string, strand string, exon_number int, start long, stop long"
INTRON = "intron string, chrom string, strand string, start long, stop long, cluster string, count double"


def exons(spark, rows, strand="+", gene="g"):
    return spark.createDataFrame([(t, gene, "chr1", strand, n, a, b) for t, n, a, b in rows], EXON)


def test_introns_forward_and_reverse(spark):
    rows = exons(spark, [("t", 1, 0, 100), ("t", 2, 200, 300), ("t", 3, 400, 500), ("r", 1, 400, 500), ("r", 2, 200, 300)])
    got = {(r["tx_id"], r["intron"], r["strand"]) for r in A.introns_from_exons(rows).collect()}
    assert got == {("t", "chr1:100-201", "+"), ("t", "chr1:300-401", "+"), ("r", "chr1:300-401", "-")}


def test_short_introns_stay_in_the_connectivity(spark):
    rows = exons(spark, [("t", 1, 0, 100), ("t", 2, 149, 300)])
    assert A.introns_from_exons(rows).count() == 0 and A.intron_connectivity(rows).count() == 1


def test_merge_intervals(spark):
    rows = spark.createDataFrame([("k", 0, 10), ("k", 10, 20), ("k", 25, 30)], "g string, start long, stop long")
    assert sorted((r["start"], r["stop"]) for r in merge_intervals(rows, ["g"]).collect()) == [(0, 20), (25, 30)]


def test_blocks_of_a_cassette(spark):
    rows = exons(spark, [("t1", 1, 0, 100), ("t1", 2, 200, 300), ("t2", 1, 0, 100), ("t2", 2, 150, 170), ("t2", 3, 200, 300)])
    blocks = A.splice_blocks(rows)
    assert {(r["tx_id"], r["path_index"]) for r in blocks.collect()} == {("t1", 0), ("t2", 1)}
    row = A.classify_event(A.block_paths(blocks)).first()
    assert (row["block_id"], row["event"]) == ("g:B1", "cassette exon")


@pytest.mark.parametrize(
    ("one", "two", "strand", "event"),
    [
        ([(20, 30)], [(20, 30), (40, 50)], "+", "cassette exon"),
        ([(20, 30)], [(20, 40)], "+", "alternative donor"),
        ([(20, 30)], [(20, 40)], "-", "alternative acceptor"),
        ([(10, 30)], [(20, 30)], "+", "alternative acceptor"),
        ([(10, 20)], [(30, 40)], "+", "mutually exclusive exons"),
        ([(10, 40)], [(12, 20), (30, 38)], "+", "retained intron"),
        ([], [(1, 2), (3, 4)], "+", "multi-exon skipping"),
        ([(10, 25)], [(20, 30)], "+", "complex internal"),
    ],
)
def test_pair_events(spark, one, two, strand, event):
    row = spark.createDataFrame([(one, two, strand)], "a array<struct<start:long,stop:long>>, b array<struct<start:long,stop:long>>, s string")
    assert row.select(A.pair_event(F.col("a"), F.col("b"), F.col("s"))).first()[0] == event


def introns(spark, rows):
    return spark.createDataFrame([(n, "chr1", s, a, b, "c", float(k)) for n, s, a, b, k in rows], INTRON)


def groups(df, label, name="intron"):
    return sorted(sorted(r["x"]) for r in df.groupBy(label).agg(F.collect_list(name).alias("x")).collect())


def test_initial_clusters(spark):
    rows = introns(spark, [("a", "+", 10, 20, 1), ("b", "+", 20, 30, 1), ("c", "+", 31, 40, 1), ("d", None, 10, 20, 1), ("e", None, 12, 18, 1)])
    assert groups(C.initial_clusters(rows.drop("cluster")), "cluster") == [["a", "b"], ["c"], ["d"], ["e"]]


def test_links_by_site_and_exon(spark):
    rows = introns(spark, [("a", "+", 10, 50, 1), ("b", "+", 50, 90, 1), ("c", "+", 60, 95, 1)])
    near = spark.createDataFrame([("b", "x"), ("c", "x")], "intron string, exon string")
    assert groups(C.refine_links(rows, mode=2), "component") == [["a", "b"], ["c"]]
    assert groups(C.refine_links(rows, near, mode=3), "component") == [["a", "b", "c"]]


def test_filter_and_psi(spark):
    rows = introns(spark, [("a", "+", 1, 2, 100), ("b", "+", 1, 3, 50), ("c", "+", 1, 4, 1)])
    assert groups(C.filter_introns(rows, cutoff=5, pct=0.01), "cluster") == [["a", "b"]]
    values = spark.createDataFrame([("a", "c", "s1", 3.0), ("b", "c", "s1", 1.0), ("a", "c", "s2", 0.0), ("b", "c", "s2", 0.0)], "intron string, cluster string, sample string, value double")
    assert sorted(r["psi"] for r in C.psi(values).collect()) == [0.0, 0.0, 0.25, 0.75]


def test_refinement_ends_and_drops_lone_introns(spark):
    rows = introns(spark, [("a", "+", 10, 20, 50), ("b", "+", 10, 30, 40), ("c", "+", 25, 40, 0.01), ("d", "+", 35, 60, 30), ("e", "+", 50, 60, 30)])
    assert groups(C.refine_clusters(rows, cutoff=1, pct=0.01), "cluster") == [["a", "b"], ["d", "e"]]


def test_components_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000, 9001 + i) for i in range(400)]
    low = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    loops = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    for n in (2, 16):
        df = spark.createDataFrame(pairs, "src long, dst long").repartition(n)
        assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {k: v for k, v in low.items() if k not in loops}


def test_junction_reads(spark):
    row = spark.createDataFrame([("s", "t", 98.0, 1.0, 10.0)], "sample string, tx_id string, effective_length double, tpm double, num_reads double")
    assert Q.normalize_junction(row).first()["value"] == 20.0


def test_weights_and_abundance(spark):
    lengths = spark.createDataFrame([("a", 300.0), ("b", 301.0)], "tx_id string, length double")
    assert {r["tx_id"]: r["w"] for r in Q.feature_weights(lengths).collect()} == {"a": 1 / 300, "b": 1.0}
    one = spark.createDataFrame([("s", 1, 4)], "sample string, ec_id long, n long")
    members = spark.createDataFrame([(1, "a"), (1, "b")], "ec_id long, tx_id string")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "tx_id string, w double")
    for rounds in (1, 7):
        assert [r["alpha"] for r in Q.em_abundance(one, members, weights, rounds).collect()] == [0.5, 0.5]


def test_folds_add_back(spark):
    rows = spark.createDataFrame([(c, e, (c * e) % 5 + 1) for c in range(4) for e in range(3)], "cell_id long, ec_id long, n long")
    back = Q.count_folds(rows, 3, seed=2).groupBy("cell_id", "ec_id").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_metacells_are_disjoint(spark):
    cells = spark.range(23).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("cell_type"))
    got = Q.metacells(cells, 5, seed=1).collect()
    assert len({r["cell_id"] for r in got}) == len(got) == 20


def test_ambiguous_suffix_is_an_error(spark):
    cells = spark.createDataFrame([("AAGGTT",)], "cell_id string")
    rt = spark.createDataFrame([("TT", "CC"), ("GTT", "CCC")], "first string, second string")
    with pytest.raises(ValueError, match="several"):
        Q.primer_pairs(cells, rt)


def test_segments(spark):
    rows = spark.createDataFrame([("acgtacgt" * 3,)], "barcode string")
    assert Q.segment_whitelists(rows).count() == 3
    with pytest.raises(ValueError, match="24"):
        Q.segment_whitelists(spark.createDataFrame([("ACGN" * 6,)], "barcode string")).count()


def test_bh_and_simes(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "id string, p double")
    assert {r["id"]: r["fdr"] and round(r["fdr"], 9) for r in bh(rows, "p").collect()} == {"a": 0.03, "b": 0.04, "c": 0.04, "d": None}
    three = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.5)], "method string, p_value double")
    row = simes(three, "p_value", ["method"]).first()
    assert (round(row["p_value"], 9), row["n_features"]) == (0.03, 3)


def test_null_calibration(spark):
    rows = spark.createDataFrame([("m", 0.01), ("m", 0.5), ("other", 0.2)], "method string, p_value double")
    null = spark.createDataFrame([("m", 0.01), ("m", 0.2), ("m", 0.9)], "method string, p_value double")
    assert sorted((r["method"], r["calibrated"]) for r in S.calibrate_ecdf(rows, null).collect()) == [("m", 0.5), ("m", 0.75), ("other", 0.2)]


def test_exceedance_leaves_out_the_own_test(spark):
    rows = spark.createDataFrame([("a", "m", 0, 3.0), ("b", "m", 0, 1.0)], "test_id string, method string, stratum int, statistic double")
    null = spark.createDataFrame([("a", "m", 0, 9.0), ("b", "m", 0, 2.0), ("c", "m", 0, 4.0)], "test_id string, method string, stratum int, statistic double")
    assert {r["test_id"]: round(r["calibrated"], 6) for r in S.calibrate_exceedance(rows, null).collect()} == {"a": round(2 / 3, 6), "b": 1.0}


def test_largest_remainder_ties(spark):
    rows = spark.createDataFrame([("s", "a", 1.5), ("s", "b", 1.5)], "sample string, path string, x double")
    assert {r["path"]: r["count"] for r in S.integerize(rows).collect()} == {"a": 2, "b": 1}


def test_tails_against_known_values():
    assert gamma_q(np.array([0.5]), np.array([3.841458820694124 / 2]))[0] == pytest.approx(0.05, abs=1e-12)
    assert gamma_q(np.array([1.0]), np.array([2.5]))[0] == pytest.approx(math.exp(-2.5), rel=1e-12)
    assert gamma_q(np.array([2.5]), np.array([11.070497693516351 / 2]))[0] == pytest.approx(0.05, abs=1e-12)
    t, n = 2.2281388519649385, 10
    assert beta_i(np.array([n / 2]), np.array([0.5]), np.array([n / (n + t * t)]))[0] == pytest.approx(0.05, abs=1e-10)


def test_contrasts(spark):
    samples = spark.createDataFrame([(f"S{s}__{t}", t, f"C{s % 2}", f"S{s}") for s in range(4) for t in ("x", "y")], "sample_id string, cell_type string, condition string, subject string")
    plan = D.plan_contrasts(samples, 2).collect()
    assert sorted(r["effect"] for r in plan) == ["cell_type", "condition", "condition"]
    pairs = D.plan_contrasts(samples, 2).where("effect = 'cell_type'").select("contrast_id", F.explode("paired_subjects").alias("subject"))
    for seed in range(6):
        assert {r["swap"] for r in D.permute_pairs(pairs, seed).collect()} == {True, False}


def test_labels_keep_their_underscores(spark):
    rows = spark.createDataFrame([("AAA", "EX_cell_type__case__mouse_1"), ("r1:BBB", "x__y__z")], "cell string, label string")
    got = {tuple(r) for r in D.cell_metadata(rows).collect()}
    assert got == {("*", "AAA", "EX_cell_type", "case", "mouse_1"), ("r1", "BBB", "x", "y", "z")}


def test_agreement_of_equal_partitions(spark):
    rows = spark.range(30).select((F.col("id") % 3).alias("label"), (F.col("id") % 3 + 5).alias("cluster"))
    row = R.ari_nmi(rows).first()
    assert row["ari"] == pytest.approx(1) and row["nmi"] == pytest.approx(1)


def test_same_rows_on_few_and_many_partitions(spark):
    rows = exons(spark, [(f"t{i}", 1 + j, 1000 * j + 7 * (i % 3), 1000 * j + 200 + 11 * (i % 2)) for i in range(12) for j in range(6)])
    both = [sorted(map(str, A.splice_blocks(rows.repartition(n)).select("block_id", "tx_id", "path_index").collect())) for n in (2, 16)]
    assert both[0] == both[1]


def test_shards_and_blank_files(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("id\tp\na\t0.1\nb\t0.2\n")
    (tmp_path / "s2.tsv").write_text("id\tp\nb\t0.3\n")
    (tmp_path / "s3.tsv").write_text("")
    got = SC.read_shards(spark, [str(tmp_path / f"s{i}.tsv") for i in (1, 2, 3)], ["id"])
    assert {r["id"]: r["p"] for r in got.collect()} == {"a": "0.1", "b": "0.3"}


def settled_clusters(rows, near, cutoff, pct):
    """The refinement rule, one cluster after the other: rows are (intron, start, stop, count)."""

    def chains(part):
        out = []
        for r in sorted(part, key=lambda r: (r[1], r[2])):
            if out and r[1] <= max(x[2] for x in out[-1]):
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def linked(part, exons):
        sites = lambda r: {r[1], r[2]} | (near.get(r[0], set()) if exons else set())
        left, out = list(part), []
        while left:
            own, grown = [left.pop()], True
            while grown:
                more = [r for r in left if any(sites(r) & sites(o) for o in own)]
                left = [r for r in left if r not in more]
                own += more
                grown = bool(more)
            out.append(own)
        return out

    todo, done = [c for chain in chains(rows) for c in linked(chain, True)], []
    while todo:
        part = todo.pop()
        total = sum(r[3] for r in part)
        kept = [r for r in part if total and r[3] / total >= pct and r[3] >= cutoff]
        if len(kept) < 2:
            continue
        if len(kept) == len(part) and len(chains(part)) == 1:
            done.append(sorted(r[0] for r in part))
        else:
            todo += [c for chain in chains(kept) for c in linked(chain, False)]
    return sorted(done)


def test_refinement_against_brute_force(spark):
    """Random introns with exon links; also a pair that only an exon links, which stays."""
    rng = np.random.default_rng(8)
    rows = [(f"i{k:03d}", int(s), int(s + rng.integers(1, 40) * 5), float(rng.choice([0.0, 0.5, 3, 40, 200]))) for k, s in enumerate(rng.integers(0, 1200, 240) * 5)]
    rows = list({(r[1], r[2]): r for r in rows}.values()) + [("pa", 19000, 19200, 10.0), ("pb", 19100, 19300, 10.0)]
    near = {r[0]: {f"e{rng.integers(60)}"} for r in rows if rng.random() < 0.5} | {"pa": {"shared"}, "pb": {"shared"}}
    table = spark.createDataFrame([(i, "chr1", "+", a, b, c) for i, a, b, c in rows], "intron string, chrom string, strand string, start long, stop long, count double")
    exons = spark.createDataFrame([(i, e) for i, es in near.items() for e in es], "intron string, exon string")
    linked = C.refine_links(C.initial_clusters(table), exons, mode=3).withColumn("cluster", F.col("component")).drop("component")
    for cutoff, pct in ((1.0, 0.01), (0.0, 0.2)):
        got = groups(C.refine_clusters(linked, cutoff, pct), "cluster")
        assert got == settled_clusters(rows, near, cutoff, pct) and ["pa", "pb"] in got and len(got) > 3


def test_large_cluster_closes_over_many_batches(spark):
    n = 400
    chain = introns(spark, [(f"c{i:04d}", "+", i, i + 1, 1) for i in range(n)] + [("lone", "+", 9000, 9001, 1)])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert sorted(map(len, groups(C.refine_links(chain, mode=2), "component"))) == [1, n]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_divisions_by_zero_are_defined(spark):
    """Zero lengths, TPM, counts, weights and designs give null or 0, never an error."""
    q = spark.createDataFrame([("s", "t", 0.0, 1.0, 5.0), ("z", "t", 10.0, 0.0, 5.0)], "sample string, tx_id string, effective_length double, tpm double, num_reads double")
    assert [r["value"] for r in Q.normalize_junction(q).collect()] == [None]
    assert {r["sample"]: r["value"] for r in Q.normalize_global(q).collect()} == {"s": 5.0, "z": None}
    lengths = spark.createDataFrame([("t", 0.0), ("u", 500.0)], "tx_id string, length double")
    assert {r["tx_id"]: r["w"] for r in Q.feature_weights(lengths).collect()} == {"t": None, "u": 1 / 200}
    counts = spark.createDataFrame([("s", 1, 4.0), ("s", 2, 6.0)], "sample string, ec_id int, n double")
    member = spark.createDataFrame([(1, "a"), (2, "b")], "ec_id int, tx_id string")
    weights = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "tx_id string, w double")
    got = {r["tx_id"]: r["alpha"] for r in Q.em_abundance(counts, member, weights, iterations=3).collect()}
    assert got["a"] == 0.0 and abs(got["b"] - 1.0) < 1e-9
    x = spark.createDataFrame([(1, 0, 0.0)], "row int, col int, value double")
    assert R.silhouette(spark.createDataFrame([(1, "a", [0.0]), (2, "b", [0.0])], "cell_id int, label string, right array<double>")).first()["silhouette"] == 0.0 and x.count() == 1


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(6)
    points, labels = rng.normal(size=(60, 5)), rng.integers(0, 4, 60)
    labels[0] = 9  # alone
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    s = []
    for i in range(60):
        own = (labels == labels[i]) & (np.arange(60) != i)
        b = min(d[i][labels == m].mean() for m in set(labels.tolist()) - {labels[i]})
        s.append((b - d[i][own].mean()) / max(b, d[i][own].mean()) if own.any() else 0.0)
    table = spark.createDataFrame([(i, f"l{m}", p.tolist()) for i, (m, p) in enumerate(zip(labels, points, strict=True))], "cell_id int, label string, right array<double>")
    assert abs(R.silhouette(table.repartition(3)).first()["silhouette"] - np.mean(s)) < 1e-9
