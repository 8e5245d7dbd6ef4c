"""Cases of the findings of round 3 on growth."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from introngrid import storage
from introngrid.functions.windows import islands, wide_islands
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C


def moves(df, key: str) -> int:
    """How often the plan of df moves rows by key; tables written before don't count."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({key}#")


def test_clusters_are_linked_refined_and_shared_in_one_shuffle(spark):
    rng = random.Random(4)
    rows = [(s := rng.randint(0, 3000), s + rng.randint(1, 60), [f"s{k}" for k in range(3)], [float(rng.choice((0.5, 4, 90))) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(sorted({r[:2]: r for r in rows}.values()), "start long, stop long, sample array<string>, value array<double>").selectExpr("'chr1' AS chrom", "'+' AS strand", "*", "array('e' || start % 11) AS exons")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = C.initial_clusters(df)
        done = C.linked_and_refined(first, 1.0, 0.05, shares=True)
        assert moves(done, "cluster") == 1  # before: each join, window and closure, and each round, moved them
        got = done.select("intron", "cluster", F.explode(F.arrays_zip("sample", "shares")).alias("x")).select("intron", "cluster", "x.sample", F.round("x.shares", 9).alias("psi"))
        named = first.withColumn("count", F.expr("aggregate(value, 0D, (a, x) -> a + x)"))
        linked = C.refine_links(named).withColumn("cluster", F.col("component")).drop("component")
        wide = C._refine_widely(linked, 1.0, 0.05, 100)
        each = wide.select("intron", "cluster", F.explode(F.arrays_zip("sample", "value")).alias("x")).select("intron", "cluster", "x.*")
        want = C.psi(each).select("intron", "cluster", "sample", F.round("psi", 9).alias("psi"))
        rounded = got.withColumn("psi", F.round("psi", 6))
        assert sorted(map(tuple, rounded.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_large_clusters_give_the_same_shares(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s := rng.randint(0, 2500), s + rng.randint(1, 60), ["x", "y"], [float(rng.choice((0.5, 4, 90))), 1.0]) for _ in range(150)]
    df = spark.createDataFrame(sorted({r[:2]: r for r in rows}.values()), "start long, stop long, sample array<string>, value array<double>").selectExpr("'chr1' AS chrom", "'+' AS strand", "*", "array('e' || start % 11) AS exons")
    pick = lambda: sorted((r["intron"], r["cluster"], r["total"], tuple(round(x, 9) for x in r["shares"])) for r in C.linked_and_refined(C.initial_clusters(df), 1.0, 0.05, shares=True).collect())
    whole = pick()
    monkeypatch.setattr(C, "LARGEST", 80)
    assert pick() == whole and len(whole) > 5


def test_chains_over_many_ranges_and_batches(spark):
    """Long intervals reach over several ranges; nulls, equal rows and both kinds of ends."""
    rng = random.Random(6)
    rows = [(f"k{i % 2}" if i % 9 else None, s := rng.randint(0, 4000), s + (rng.randint(1, 9) if i % 40 else 900), i) for i in range(400)] + [("k0", 5, 9, 1000 + i) for i in range(50)]
    rows += [("k1", None, 7, 2000), ("k1", 3, None, 2001)]
    df = spark.createDataFrame(rows, "k string, start long, stop long, id int")
    pick = lambda x: sorted(map(tuple, x.select(F.coalesce("k", F.lit("")), F.coalesce("start", F.lit(-1)), F.coalesce("stop", F.lit(-1)), "id", "island").collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for touching in (True, False):
            assert pick(wide_islands(df, ["k"], ties=["id"], touching=touching, ranges=23)) == pick(islands(df, ["k"], ties=["id"], touching=touching))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_genes_are_dealt_over_as_many_tasks_as_the_input_asks_for(spark, tmp_path, monkeypatch):
    rows = [(f"t{i}", f"g{i // 3}", "chr1", "+", 1, i // 3 * 100, i // 3 * 100 + 50) for i in range(300)]
    spark.createDataFrame(rows, "tx_id string, gene_id string, chrom string, strand string, exon_number int, start long, stop long").write.parquet(f"{tmp_path}/exons")
    exons = spark.read.parquet(f"{tmp_path}/exons")
    monkeypatch.setattr(storage, "SHARE", 500)
    out = A.constitutive_intervals(exons)
    assert out.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))  # before: the session's number, whatever the input
    assert sorted(r["start"] for r in out.collect()) == [100 * g for g in range(100)]
