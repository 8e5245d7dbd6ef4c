"""Findings of round 3: each case failed on the code before."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from introngrid import storage
from introngrid.functions import scan
from introngrid.functions.windows import simes
from introngrid.operators import cluster as C
from introngrid.operators import quant as Q
from introngrid.plans.adapters import ADAPTERS, view
from introngrid.sources import sinks

SMALL = "/root/testdata/sf0.001"


def test_range_lookup_of_order_keys_of_any_size(spark, tmp_path):
    keys = [0, 4999, 5000, 999_999, 1_000_000, 9_000_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["number"]: r["batch"] for r in entry.queries()["d19_range_lookup"](spark, str(tmp_path)).collect()}
    assert got == {k: f"b{k // 5000}" for k in keys}


def test_total_at_the_threshold_whatever_the_order_of_adding(spark):
    values = spark.createDataFrame([("a", "t1", 0.1), ("b", "t1", 0.2), ("a", "t2", 0.1), ("b", "t2", 0.21)], "sample string, tx_id string, value double")
    edges = spark.createDataFrame([("t1", "x"), ("t2", "y")], "tx_id string, feature string")
    assert 0.1 + 0.2 > 0.3
    assert {r["feature"] for r in Q.project_counts(values, edges, 0.3).collect()} == {"y"}


def exchanges(df):
    return sum(line.strip(" +-:*()0123456789").startswith("Exchange hashpartitioning") for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines())


@pytest.mark.parametrize("name", ["tx_exon", "quant"])
def test_rows_by_transcript_are_the_view_and_need_no_second_shuffle(spark, name):
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    plain, mine = spark.sql(ADAPTERS[name], lineitem=lineitem), view(spark, SMALL, name)
    assert mine.schema == plain.schema and mine.exceptAll(plain).count() == 0 and plain.exceptAll(mine).count() == 0
    assert exchanges(mine.groupBy("tx_id").agg(F.count("*"))) == 1


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.range(200_000).select("id", F.lit("m").alias("k"), F.rand(1).alias("p")).write.parquet(path := f"{tmp_path}/rows")
    rows = spark.read.parquet(path)
    assert storage.shares(rows) is None
    monkeypatch.setattr(storage, "SHARE", 64 << 10)
    assert storage.shares(rows) > 16 and storage.spread(rows, "id").rdd.getNumPartitions() == storage.shares(rows)
    assert scan.Ranges(rows, ["k"], ["p"]).rows.select("__part").distinct().count() > 16


def test_simes_of_one_wide_key_equals_the_plain_one(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 500 + 1) / 501).alias("p"))
    found = [sorted(map(tuple, simes(rows, "p", ["k"], wide=w, ranges=7).collect())) for w in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_refused_bundle_has_no_manifest_and_tables_are_worked_out_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)
    seen = lambda it: (runs.add(1) or r for r in it)
    counts = spark.createDataFrame([("s", "j", 2)], "sample_id string, junction_id string, value long")
    once = spark.createDataFrame(counts.rdd.coalesce(1).mapPartitions(seen), counts.schema)
    junctions, samples = counts.select("junction_id"), counts.select("sample_id")
    sinks.write_bundle(f"{tmp_path}/good", once, junctions, samples)
    assert runs.value == 1
    with pytest.raises(ValueError, match="negative"):
        sinks.write_bundle(f"{tmp_path}/bad", counts.withColumn("value", -F.col("value")), junctions, samples)
    assert not (tmp_path / "bad" / "manifest").exists()


def test_extended_clusters_move_by_intron_alone(spark):
    clusters = spark.createDataFrame([("i", "c"), ("j", "c"), ("k", "d")], "intron string, cluster string")
    counts = spark.createDataFrame([("i", "a", 1.0), ("i", "b", None), ("j", "b", 2.0), ("z", "e", 3.0)], "intron string, sample string, value double")
    got = C.extend_clusters(clusters, counts)
    assert sorted(map(tuple, got.collect())) == sorted((i, c, s, {("i", "a"): 1.0, ("j", "b"): 2.0}.get((i, s), 0.0)) for i, c in (("i", "c"), ("j", "c"), ("k", "d")) for s in "abe")
    assert "intron" in got.columns and "sample#" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(intron" in x)
