"""Case of the finding of round 4 on the disk that c11_psi_pipeline takes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from introngrid.functions import windows
from introngrid.operators import annotation as A
from introngrid.operators import cluster as C
from introngrid.operators import quant as Q


def odd_tables(spark):
    """Exons of 60 transcripts on both strands, places shared by genes and strands, a null end, and counts that some transcripts lack."""
    rng = random.Random(8)
    exons, quant = [], []
    for t in range(60):
        base, ends = rng.choice((0, 0, 5000, 9000)), sorted(rng.sample(range(0, 3000, 100), 2 * rng.randint(1, 5)))
        spans = [(base + a, base + b) for a, b in zip(ends[::2], ends[1::2])]
        spans = spans[::-1] if t % 3 == 0 else spans
        exons += [(f"t{t}", f"g{t // 7}", f"chr{t % 2}", "+", i, a, b) for i, (a, b) in enumerate(spans)]
        quant += [(s, f"t{t}", 100 + t, rng.randint(1, 40), rng.randint(0, 2)) for s in ("x", "y", "z") if rng.random() < 0.6 and t % 10]
    exons.append(("t1", "g0", "chr1", "+", 9, None, 9990))
    return spark.createDataFrame(quant, "sample string, tx_id string, effective_length int, num_reads int, tpm int"), spark.createDataFrame(exons, "tx_id string, gene_id string, chrom string, strand string, exon_number int, start long, stop long")


@pytest.mark.parametrize(("mode", "piece", "ranges"), [(1, 10_000, True), (2, 10_000, True), (3, 10_000, True), (3, 10_000, False), (3, 40, True)])
def test_flagship_writes_places_once_and_moves_only_split_clusters(spark, monkeypatch, mode, piece, ranges):
    """Clusters that reach over ranges, or all in one range; a small piece and small batches split the others too."""
    quant, exons = odd_tables(spark)
    introns = A.introns_from_exons(exons)
    counts = Q.normalize_junction(quant).join(introns.select("tx_id", "intron"), "tx_id").groupBy("intron", "sample").agg(F.sum("value").alias("value"))
    strand = introns.groupBy("intron", "chrom", "start", "stop").agg(F.max_by("strand", F.struct("gene_id", "tx_id", "ord")).alias("strand"))
    placed = strand.join(counts.groupBy("intron").agg(F.sum("value").alias("count")), "intron")
    near = introns.select("intron", F.explode(F.array("left_exon", "right_exon")).alias("exon")).distinct()
    linked = C.refine_links(C.initial_clusters(placed), near, mode=mode).withColumn("cluster", F.col("component")).drop("component")
    final = C.refine_clusters(linked, 5.0, 0.05)
    final = final.join(final.groupBy("cluster").agg(F.sum("count").alias("total")).where("total > 30"), "cluster")
    want = sorted(map(tuple, C.psi(final.join(counts, "intron")).select("intron", "sample", "psi").collect()))

    written, whole = [], windows.materialize
    monkeypatch.setattr(C, "PIECE", piece)
    record = lambda df, label, *more: written.append((label, set(df.columns))) or whole(df, label, *more)
    for module in (windows, Q, C):
        monkeypatch.setattr(module, "materialize", record)
    moved, by_cluster = [], C._by_cluster
    monkeypatch.setattr(C, "_by_cluster", lambda rows: moved.append(rows.count()) or by_cluster(rows))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if piece < 100 else old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not ranges).lower())
    try:
        got = sorted(map(tuple, Q.psi_pipeline(quant, exons, mode, 5.0, 0.05, 30.0, named=False).select("intron", "sample", "psi").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and len(want) > 40
    assert len(moved) == 1 and (moved[0] > 0) == ranges and (moved[0] < placed.count() or piece < 100)  # before: all places
    labels = [label for label, _ in written]
    assert "places" not in labels and labels.count("islands") == 1  # before: a table of places, and another with their chains
    assert not any({"exons", "intron"} & columns for _, columns in written)  # before: names of exons in both and behind each move


def test_exons_beside_an_intron_are_told_by_their_far_ends(spark):
    _, exons = odd_tables(spark)
    rows = A.introns_from_exons(exons.where("start IS NOT NULL"), min_len=None, ends=True).withColumns({"lows": F.array("low"), "highs": F.array("high")})
    out = rows.select(F.array_sort(F.array("left_exon", "right_exon")).alias("a"), F.array_sort(A.neighbours()).alias("b")).collect()
    assert len(out) > 60 and all(r["a"] == r["b"] for r in out)
