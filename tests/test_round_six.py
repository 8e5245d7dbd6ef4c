"""Cases of the findings of round 3 on growth that round 5 left open."""

from __future__ import annotations

import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from introngrid import storage
from introngrid.functions.scan import Ranges
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C
from introngrid.operators import stats as S
from introngrid.plans import annotation_cases, cluster_cases, stats_cases
from introngrid.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [stats_cases.p09, annotation_cases.g16_records, annotation_cases.g18])
def test_splice_blocks_are_worked_out_once(spark, monkeypatch, query):
    whole, sources = A.splice_blocks, []
    monkeypatch.setattr(A, "splice_blocks", lambda e: sources.append(1) or whole(e))
    out = query(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sources == [1] and "lineitem" not in plan and "l_orderkey" not in plan  # before: as many times as tables came from them
    assert out.count()


def test_null_values_meet_themselves_once_for_each_value(spark, monkeypatch):
    """Equal values over all tests, rare degrees of freedom, tests that aren't there; only the null values are asked for."""
    sizes, whole = [], S.Ranges
    monkeypatch.setattr(S, "Ranges", lambda df, *more: sizes.append(df.count()) or whole(df, *more))
    tests = [("m", i, 0.5, float(i), i % 2 if i % 5 else 100 + i) for i in range(60)]
    null = [("m", i % 70, (i % 3 + 1) / 4 if i % 11 else None, i % 2) for i in range(600)]
    df, nulls = spark.createDataFrame(tests, "method string, test_id int, p_value double, depth double, df int"), spark.createDataFrame(null, "method string, test_id int, p_value double, df int")
    none, got = S.calibrate_by_depth(df, nulls, 2, least=10, want=(False, True))
    rows = got.collect()
    assert none is None and len(rows) == 600 and max(sizes) < 60  # before: all null values twice
    key = lambda r: (r["stratum"], r["test_id"], -1.0 if r["p_value"] is None else r["p_value"])
    flat = [key(r) for r in rows]
    for r in rows:
        s, t, p = key(r)
        others = [x for x in flat if x[0] == s and x[1] != t]
        assert r["calibrated"] == pytest.approx((1 + sum(x[2] <= p for x in others)) / (1 + len(others)))
    assert len({r["stratum"] for r in rows}) > 2


def test_bed_lines_are_counted_and_placed_in_one_move(spark, tmp_path):
    """A place on two strands, one of which no sample has, and one that no sample has at all."""
    rows = [("chr1", 11, 20, "+", "x", 2), ("chr1", 11, 20, "+", "x", 3), ("chr1", 11, 20, "-", "y", 1), ("chr1", 30, 40, "-", "y", 4), ("chr1", 30, 40, "+", None, None), ("chr1", 50, 60, "+", None, None), ("chr1", 70, 80, "+", "x", 0)]
    df = spark.createDataFrame(rows, "chrom string, start long, stop long, strand string, sample_id string, value long")
    named = df.withColumn("junction_id", A.place())
    counts = named.where("sample_id IS NOT NULL").groupBy("sample_id", "junction_id").agg(F.sum("value").alias("value"))
    places = named.groupBy("junction_id", "chrom", "start", "stop").agg(F.min("strand").alias("strand"))
    want = sorted(map(tuple, sinks.junction_bed(counts, places).collect()))
    got = sinks.counted_bed(df)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 3
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    sinks.write_counted_bed(df, f"{tmp_path}/bed")
    assert sorted((r["sample_id"], r["value"]) for r in spark.read.text(f"{tmp_path}/bed").select("sample_id", "value").collect()) == want
    assert all(p.suffix == ".gz" for p in Path(f"{tmp_path}/bed").glob("*/part-*"))  # before: plain text


def _places(spark, n=250):
    rng = random.Random(8)
    rows = sorted({(f"chr{rng.randint(1, 2)}", rng.choice("+-"), s := rng.randint(0, 900), s + rng.randint(1, 40)) for _ in range(n)})
    return spark.createDataFrame([(*r, ["e%d" % (r[2] % 13), None]) for r in rows], "chrom string, strand string, start long, stop long, exons array<string>")


def test_dealt_places_give_the_same_clusters(spark):
    df = _places(spark)
    want = C.initial_clusters(df).select("chrom", "strand", "start", "stop", "intron", "cluster")
    dealt = df.repartitionByRange(17, "chrom", "start", "stop")
    got = C.initial_clusters(dealt, dealt=True)  # before: moved again
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [C.LARGEST, 40])
def test_edges_over_sites_move_by_cluster_alone(spark, monkeypatch, most):
    monkeypatch.setattr(C, "LARGEST", most)
    rows = C.initial_clusters(_places(spark))
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r["cluster"], []).append((r["intron"], {str(r["start"]), str(r["stop"]), *filter(None, r["exons"])}))
    for mode in (2, 3):
        out = C.cluster_edges(rows, mode=mode)
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert most == 40 or plan.count("Exchange hashpartitioning(cluster#") == 1 and "Exchange hashpartitioning(a#" not in plan  # before: both sides by cluster and site, and the pairs
        pairs = {(c, *sorted((x[0], y[0]))) for c, g in groups.items() for x, y in combinations(g, 2) if {s for s in x[1] if mode == 3 or s[0] != "e"} & {s for s in y[1] if mode == 3 or s[0] != "e"}}
        assert sorted(map(tuple, out.collect())) == sorted(pairs) and pairs


def test_clusterings_with_edges_in_several_clusters(spark):
    first = spark.createDataFrame([("p", "a", "b"), ("q", "a", "b"), ("p", "b", "c"), ("r", "x", "y")], "cluster string, a string, b string")
    second = spark.createDataFrame([("u", "a", "b"), ("v", "a", "b"), ("u", "b", "c"), ("w", "y", "z")], "cluster string, a string, b string")
    got = {(r["c1"], r["c2"]): (r["shared"], r["n1"], r["n2"], r["kind"]) for r in C.compare_clusterings(first, second).collect()}
    assert got == {("p", "u"): (2, 2, 2, "identical"), ("p", "v"): (1, 2, 1, "partial"), ("q", "u"): (1, 1, 2, "partial"), ("q", "v"): (1, 1, 1, "identical"), ("r", None): (0, 1, 0, "first only"), (None, "w"): (0, 0, 1, "second only")}
    one = C.clustering_summary(first, second).first()
    assert (one["shared"], one["edges_1"], one["edges_2"], one["identical"], one["partial"], one["first_only"], one["second_only"]) == (5, 4, 4, 2, 2, 1, 1)


def test_edges_are_made_once_for_the_summary(spark, monkeypatch):
    tables, whole = [], C._edge_counts
    monkeypatch.setattr(C, "_edge_counts", lambda *both: tables.append(1) or whole(*both))
    plan = cluster_cases.c10_summary(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert tables == [1] and "start" not in plan  # before: both edge tables again for each count


def test_ranges_are_worked_on_in_as_many_tasks_as_the_input_asks_for(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("'g' || id % 100 AS region", "id * 7919 % 3001 AS pos", "id % 5 - 2 AS d").write.parquet(f"{tmp_path}/steps")
    steps = spark.read.parquet(f"{tmp_path}/steps")
    want = sorted(map(tuple, steps.selectExpr("region", "pos", "sum(d) OVER (PARTITION BY region ORDER BY pos) AS depth").collect()))
    monkeypatch.setattr(storage, "SHARE", 2000)
    asked = storage.shares(steps)
    ranges = Ranges(steps, ["region"], ["pos"])
    deep = ranges.running(ranges.rows, "d", "depth")
    assert asked > 4 and deep.rdd.getNumPartitions() == ranges.counts(F.lit(True), "r", "n").rdd.getNumPartitions() == asked  # before: the session's number
    assert sorted(map(tuple, deep.select("region", "pos", "depth").collect())) == want
    reads = spark.range(500).selectExpr("'chr1' AS chrom", "'s' AS sample", "'+' AS strand", "id * 37 % 9000 AS start", "id * 37 % 9000 + id % 90 AS stop")
    reads.write.parquet(f"{tmp_path}/reads")
    regions = spark.createDataFrame([("a", "chr1", 0, 5000), ("b", "chr1", 4000, 9100)], "region string, chrom string, start long, stop long")
    few = sorted(map(tuple, A.region_coverage(reads, regions).collect()))
    many = sorted(map(tuple, A.region_coverage(spark.read.parquet(f"{tmp_path}/reads"), regions).collect()))
    assert many == few and len(few) > 100
