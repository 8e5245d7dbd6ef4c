"""Transcript structure: introns, supports, splice blocks and event classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.functions.scan import Ranges
from introngrid.functions.windows import merge_intervals  # noqa: F401
from introngrid.schema import assert_no_conflict
from introngrid.storage import gather, materialize, shares, spread


def place(chrom: str = "chrom", start: str = "start", stop: str = "stop") -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(text(chrom), F.lit(":"), text(start), F.lit("-"), text(stop))


def filter_annotation(features: DataFrame, qc: bool = True) -> DataFrame:
    """Rows of chromosomes named chr*, without artifact genes and chrM; with qc also without pseudogenes and decay transcripts."""
    has = lambda c, text: F.coalesce(F.col(c).contains(text), F.lit(False))
    out = features.where(F.col("chrom").contains("chr") & ~has("gene_type", "artifact") & (F.col("chrom") != "chrM"))
    return out.where(~has("gene_type", "pseudogene") & ~has("transcript_type", "decay")) if qc else out


def backfill_gene_ids(features: DataFrame, order=("tx_id", "exon_number")) -> DataFrame:
    """The first reference gene id and name of an assembled gene, for all its rows."""
    window = Window.partitionBy("gene_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = F.first(F.when(F.col("ref_gene_id").isNotNull(), F.struct("ref_gene_id", "gene_name")), ignorenulls=True).over(window)
    out = features.withColumn("__known", known)
    return out.withColumn("ref_gene_id", F.coalesce("__known.ref_gene_id", "ref_gene_id")).withColumn("gene_name", F.coalesce("__known.gene_name", "gene_name")).drop("__known")


def introns_from_exons(exons: DataFrame, min_len: int | None = 50, max_len: int = 5_000_000, ends: bool = False) -> DataFrame:
    """Rows (tx_id, gene_id, chrom, ord, start, stop, strand, intron, left_exon, right_exon) between consecutive exons.

    The strand follows from the order of the coordinates, the end is one past the gap, and
    the length lies strictly between the limits; without min_len all are kept. With ends rows also have low and high, where
    the exon below the intron starts and the one above it stops: their other ends are the intron's own, so these tell both (neighbours()).
    """
    order = Window.partitionBy("tx_id").orderBy("exon_number")
    pair = exons.withColumn("__next", F.lead(F.struct("start", "stop", place().alias("exon"))).over(order)).withColumn("ord", F.row_number().over(order)).where("__next IS NOT NULL")
    forward = F.col("stop") < F.col("__next.start")
    out = pair.select(
        "tx_id", "gene_id", "chrom", "ord",
        F.when(forward, F.col("stop")).otherwise(F.col("__next.stop")).alias("__a"), (F.when(forward, F.col("__next.start")).otherwise(F.col("start")) + 1).alias("__b"),
        F.when(forward, "+").otherwise("-").alias("strand"), place().alias("left_exon"), F.col("__next.exon").alias("right_exon"),
        *([F.when(forward, F.col("start")).otherwise(F.col("__next.start")).alias("low"), F.when(forward, F.col("__next.stop")).otherwise(F.col("stop")).alias("high")] if ends else []),
    ).withColumnsRenamed({"__a": "start", "__b": "stop"}).withColumn("intron", place())
    if min_len is None:
        return out
    length = F.abs(F.col("start") - F.col("stop"))
    return out.where((length > min_len) & (length < max_len))


def neighbours() -> Column:
    """Names of the exons beside an intron (chrom, start, stop) that start at lows or stop at highs (arrays), as introns_from_exons() gives them."""
    text = lambda *parts: F.concat(*[F.coalesce(x.cast("string") if isinstance(x, Column) else F.lit(x), F.lit("null")) for x in parts])
    chrom, start, stop = F.col("chrom"), F.col("start"), F.col("stop")
    return F.concat(F.transform("lows", lambda x: text(chrom, ":", x, "-", start)), F.transform("highs", lambda x: text(chrom, ":", stop - 1, "-", x)))


def intron_places(introns: DataFrame, *values: Column, ranged: bool = False) -> DataFrame:
    """Rows (chrom, start, stop, strand, intron, exons, values): one per intron and strand, with the neighbouring exons that the intron has on any strand; rows move once, with ranged into ranges of (chrom, start, stop), which reads them twice."""
    wanted, by = shares(introns) if ranged else None, ["chrom", "start", "stop"]
    moved = gather(introns, *by) if not ranged else introns.repartitionByRange(wanted, *by) if wanted else introns.repartitionByRange(*by)
    near = F.array_distinct(F.flatten(F.collect_set(F.array("left_exon", "right_exon"))))
    one = moved.groupBy("start", "stop", "chrom").agg(F.collect_set("strand").alias("strands"), near.alias("exons"), *values)
    return one.withColumn("strand", F.explode("strands")).withColumn("intron", place()).drop("strands")


def support_map(exons: DataFrame, **limits) -> DataFrame:
    """One row per transcript: ordered arrays of its introns and exons."""
    names = lambda order, name: F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])
    introns = introns_from_exons(exons, **limits).groupBy("tx_id").agg(names("ord", "intron").alias("introns"))
    listed = exons.withColumn("exon", place()).groupBy("tx_id").agg(F.first("gene_id").alias("gene_id"), F.first("chrom").alias("chrom"), names("exon_number", "exon").alias("exons"))
    return listed.join(introns, "tx_id", "left").withColumn("introns", F.coalesce("introns", F.array().cast("array<string>")))


def intron_connectivity(exons: DataFrame) -> DataFrame:
    """Rows (intron, exons, strand): the neighbouring exons of every intron, and the strand of its last sight."""
    introns = introns_from_exons(exons, min_len=None)
    last = F.max_by("strand", F.struct("gene_id", "tx_id", "ord"))
    both = introns.withColumn("exon", F.explode(F.array("left_exon", "right_exon")))
    return both.groupBy("intron").agg(F.array_sort(F.collect_set("exon")).alias("exons"), last.alias("strand"))


def incidence(support: DataFrame, which: str = "introns") -> DataFrame:
    """Edges (tx_id, feature) of transcripts and their introns or exons."""
    return support.select("tx_id", F.explode(which).alias("feature")).distinct()


def dense_ids(df: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct values of a column with numbers from 0 in their order, without a global sort in one task."""
    wanted = shares(df)
    named = df.select(name).distinct()
    spread = (named.repartitionByRange(wanted, name) if wanted else named.repartitionByRange(name)).sortWithinPartitions(name).withColumn("__p", F.spark_partition_id())
    spread = materialize(spread, "ids")
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = spread.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(name)) - 1)
    return ranked.join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p").select(name, (F.col("__r") + F.col("__b")).cast("long").alias(out))


def add_virtual_introns(support: DataFrame, pad: int = 500) -> DataFrame:
    """support with a virtual intron before the first and after the last exon of each transcript, out to the gene's extent plus pad."""
    part = lambda e, k: F.regexp_extract(e, r":(\d+)-(\d+)$", k).cast("long")
    first, last = F.element_at("exons", 1), F.element_at("exons", -1)
    df = support.withColumn("__fs", part(first, 1)).withColumn("__fe", part(first, 2)).withColumn("__ls", part(last, 1)).withColumn("__le", part(last, 2))
    df = df.withColumn("__fwd", F.col("__fs") <= F.col("__ls"))
    extent = df.groupBy("gene_id").agg(
        F.min(F.least("__fs", "__ls")).alias("__lo"), F.max(F.greatest("__fe", "__le")).alias("__hi"),
        F.coalesce(F.max_by(F.when(F.size("exons") > 1, F.col("__fwd")), F.when(F.size("exons") > 1, F.col("tx_id"))), F.min_by("__fwd", "tx_id")).alias("__gene_fwd"),
    )
    df = df.join(extent, "gene_id")
    span = lambda a, b: F.format_string("%s:%d-%d", F.col("chrom"), a, b)
    low, high = F.col("__lo") - pad, F.col("__hi") + pad
    v0 = F.when(F.col("__gene_fwd"), span(low, F.col("__fs"))).otherwise(span(F.col("__fe"), high))
    v1 = F.when(F.col("__gene_fwd"), span(F.col("__le"), high)).otherwise(span(low, F.col("__ls")))
    strand = F.when(F.col("__gene_fwd"), "+").otherwise("-")
    return df.select("tx_id", "gene_id", "chrom", "exons", F.concat(F.array(v0), "introns", F.array(v1)).alias("introns"), v0.alias("first_intron"), v1.alias("last_intron"), strand.alias("strand"))


def intron_sources(introns: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (intron, sources): the transcript types that hold an intron, comma-joined in order."""
    return introns.join(types, "tx_id").groupBy("intron").agg(F.array_join(F.array_sort(F.collect_set("transcript_type")), ",").alias("sources"))


def tx_gene_map(features: DataFrame, check: bool = True) -> DataFrame:
    """Rows (tx_id, gene_id), one per transcript; two genes for one transcript are an error."""
    out = features.where("tx_id IS NOT NULL AND gene_id IS NOT NULL").select("tx_id", "gene_id").distinct()
    return assert_no_conflict(out, "tx_id", "gene_id") if check else out


POINT = "struct<start:bigint,stop:bigint>"


def transcript_chains(exons: DataFrame) -> DataFrame:
    """Rows (gene_id, tx_id, chrom, strand, chain): a transcript's exons in order, overlapping and touching ones as one."""
    listed = exons.groupBy("gene_id", "tx_id", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "stop").cast(POINT))).alias("chain"))

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(out) > 0) & (x["start"] <= F.try_element_at(out, F.lit(-1))["stop"]), joined).otherwise(F.concat(out, F.array(x)))

    return listed.withColumn("chain", F.aggregate("chain", F.array().cast(f"array<{POINT}>"), add))


def _genes_of(chains: DataFrame) -> DataFrame:
    """chains with n (the gene's transcripts), lo and hi (its ends)."""
    gene = Window.partitionBy("gene_id")
    return chains.select("*", F.count("*").over(gene).alias("n"), F.min(F.col("chain")[0]["start"]).over(gene).alias("lo"), F.max(F.element_at("chain", -1)["stop"]).over(gene).alias("hi"))


def _anchors(chains: DataFrame) -> DataFrame:
    """Rows (gene_id, start, stop) where every transcript of a gene covers: a sweep over the starts (+1) and ends (-1) of its exons.

    A transcript's own exons don't touch, so two such intervals of a gene don't either.
    """
    steps = F.flatten(F.transform("chain", lambda x: F.array(F.struct(x["start"].alias("pos"), F.lit(1).alias("d")), F.struct(x["stop"].alias("pos"), F.lit(-1).alias("d")))))
    events = chains.select("gene_id", "n", F.explode(steps).alias("e")).groupBy("gene_id", "e.pos").agg(F.sum("e.d").alias("d"), F.first("n").alias("n")).where("d <> 0")
    along = Window.partitionBy("gene_id").orderBy("pos")
    depth = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return events.select("gene_id", "n", F.col("pos").alias("start"), F.lead("pos").over(along).alias("stop"), depth.alias("depth")).where("depth = n").select("gene_id", "start", "stop")


def constitutive_intervals(exons: DataFrame) -> DataFrame:
    """Rows (gene_id, start, stop): what every transcript of a gene covers. Rows move once, by gene, in as many tasks as the input asks for."""
    return _anchors(_genes_of(transcript_chains(gather(exons, "gene_id"))))


def splice_blocks(exons: DataFrame) -> DataFrame:
    """Rows (gene_id, block_id, strand, chrom, left_anchor, right_anchor, tx_id, signature, path_index), one per block and transcript.

    Blocks lie between consecutive constitutive intervals and at both ends of a gene; a gene
    without any is one block. A signature is the transcript's exons clipped to the block, in
    transcription order. Blocks with one signature go; the others are numbered in
    transcription order. exons are read once; all else is keyed by the gene.
    """
    chains = materialize(_genes_of(transcript_chains(gather(exons, "gene_id"))).where("n > 1"), "chains")
    anchors = _anchors(chains).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("anchors"))
    nothing = F.lit(None).cast(POINT)
    block = lambda left, right, b0, b1: F.struct(left.alias("left_anchor"), right.alias("right_anchor"), b0.alias("b0"), b1.alias("b1"))
    a, lo, hi = F.col("anchors"), F.col("lo"), F.col("hi")

    def after(i: Column) -> Column:
        here, then = F.get(a, i), F.get(a, i + 1)
        return block(here, then, here["stop"], F.coalesce(then["start"], hi))

    inner = F.concat(F.array(block(nothing, F.get(a, F.lit(0)), lo, F.get(a, F.lit(0))["start"])), F.transform(F.sequence(F.lit(0), F.size(a) - 1), after))
    cut = F.when(a.isNull(), F.array(block(nothing, nothing, lo, hi))).otherwise(inner)
    both = chains.join(anchors, "gene_id", "left").withColumn("block", F.explode(cut)).select("gene_id", "tx_id", "chrom", "strand", "chain", "block.*").where("b0 < b1")
    clipped = F.transform("chain", lambda x: F.struct(F.greatest(x["start"], F.col("b0")).alias("start"), F.least(x["stop"], F.col("b1")).alias("stop")))
    clipped = F.filter(clipped, lambda x: x["start"] < x["stop"])
    both = both.withColumn("signature", F.when(F.col("strand") == "+", clipped).otherwise(F.reverse(clipped))).drop("chain")
    own = Window.partitionBy("gene_id", "b0", "b1")
    both = both.withColumn("path_index", F.dense_rank().over(own.orderBy("signature")) - 1).withColumn("paths", F.max("path_index").over(own)).where("paths > 0")
    along = F.when(F.col("strand") == "+", F.col("b0")).otherwise(-F.col("b0"))
    rank = F.dense_rank().over(Window.partitionBy("gene_id").orderBy(along))
    return both.withColumn("block_id", F.format_string("%s:B%d", "gene_id", rank)).select("gene_id", "block_id", "strand", "chrom", "left_anchor", "right_anchor", "tx_id", "signature", "path_index")


def block_paths(blocks: DataFrame) -> DataFrame:
    """One row per block with the array of its distinct signatures."""
    return blocks.groupBy("gene_id", "block_id", "strand").agg(
        F.first("left_anchor").alias("left_anchor"), F.first("right_anchor").alias("right_anchor"), F.array_sort(F.collect_set("signature")).alias("paths")
    )


def pair_event(first: Column, second: Column, strand: Column) -> Column:
    """The structural difference of two exon chains."""
    one, two = F.array_except(first, second), F.array_except(second, first)
    more = F.when(F.size(one) == 0, two).otherwise(one)
    a, b = one[0], two[0]
    span = lambda x: (F.array_min(F.transform(x, lambda i: i["start"])), F.array_max(F.transform(x, lambda i: i["stop"])))
    (lo1, hi1), (lo2, hi2) = span(one), span(two)
    single = (F.size(one) == 1) & (F.size(two) == 1)
    donor, acceptor = F.when(strand == "+", "alternative donor").otherwise("alternative acceptor"), F.when(strand == "+", "alternative acceptor").otherwise("alternative donor")
    retained = ((F.size(one) == 1) & (F.size(two) > 1) & (a["start"] <= lo2) & (a["stop"] >= hi2)) | ((F.size(two) == 1) & (F.size(one) > 1) & (b["start"] <= lo1) & (b["stop"] >= hi1))
    none = (F.size(one) == 0) | (F.size(two) == 0)
    return (
        F.when(none & (F.size(more) == 1), "cassette exon")
        .when(none & (F.size(more) > 1), "multi-exon skipping")
        .when(single & (a["start"] == b["start"]) & (a["stop"] != b["stop"]), donor)
        .when(single & (a["stop"] == b["stop"]) & (a["start"] != b["start"]), acceptor)
        .when(single & ((a["stop"] <= b["start"]) | (b["stop"] <= a["start"])), "mutually exclusive exons")
        .when(retained, "retained intron")
        .otherwise("complex internal")
    )


def classify_event(paths: DataFrame) -> DataFrame:
    """block_paths() rows with their event class."""
    left, right, plus = F.col("left_anchor").isNull(), F.col("right_anchor").isNull(), F.col("strand") == "+"
    ends = F.when(left & right, "whole-gene complex").when(left, F.when(plus, "alternative first region").otherwise("alternative last region"))
    ends = ends.when(right, F.when(plus, "alternative last region").otherwise("alternative first region"))
    return paths.withColumn("event", ends.when(F.size("paths") == 2, pair_event(F.col("paths")[0], F.col("paths")[1], F.col("strand"))).otherwise("compound internal"))


def event_components(paths: DataFrame) -> DataFrame:
    """Rows (block_id, components): classes of all pairs of a block's paths, complex internal left out, comma-joined in order."""
    numbered = paths.select("block_id", "strand", F.posexplode("paths").alias("i", "path"))
    pairs = numbered.alias("x").join(numbered.alias("y"), (F.col("x.block_id") == F.col("y.block_id")) & (F.col("x.i") < F.col("y.i")))
    kinds = pairs.select("x.block_id", pair_event(F.col("x.path"), F.col("y.path"), F.col("x.strand")).alias("kind"))
    return kinds.groupBy("block_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") != "complex internal", F.col("kind")))), ",").alias("components"))


def event_type_summary(events: DataFrame) -> DataFrame:
    """Rows (event, n, share)."""
    counts = events.groupBy("event").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(True))), 6))


def robust_catalog(tables: list[DataFrame], key: str = "test_id", level: float = 0.05, fdr: str = "fdr") -> DataFrame:
    """Keys that are significant in every table."""
    out = tables[0].where(F.col(fdr) < level).select(key)
    for table in tables[1:]:
        out = out.intersect(table.where(F.col(fdr) < level).select(key))
    return out.distinct()


def catalog_records(tables: list[DataFrame], primary: DataFrame, blocks: DataFrame, names: DataFrame | None = None, level: float = 0.05) -> DataFrame:
    """What is known of the blocks that are significant in every table: place, event, results of the primary table.

    tables and primary have (test_id, fdr, ...), test_id being a block's id; primary also statistic, p_value and
    n_levels. blocks are splice_blocks() rows, names (gene_id, gene_name); a gene without a name keeps its id.
    Rows (test_id, gene_id, gene_name, event, components, chrom, strand, left_anchor, right_anchor, n_paths, n_levels, statistic, p_value, fdr).
    Only paths of blocks in the catalog are compared.
    """
    kept = blocks.join(robust_catalog(tables, level=level).select(F.col("test_id").alias("block_id")), "block_id", "left_semi")
    kept = materialize(kept, "catalog-blocks")
    paths = classify_event(block_paths(kept)).join(event_components(block_paths(kept)), "block_id").join(kept.select("block_id", "chrom").distinct(), "block_id")
    known = paths.join(names, "gene_id", "left") if names is not None else paths.withColumn("gene_name", F.lit(None).cast("string"))
    results = primary.select(F.col("test_id").alias("block_id"), "n_levels", "statistic", "p_value", "fdr")
    return known.join(results, "block_id").select(
        F.col("block_id").alias("test_id"), "gene_id", F.coalesce("gene_name", "gene_id").alias("gene_name"), "event", "components", "chrom", "strand", "left_anchor", "right_anchor",
        F.size("paths").alias("n_paths"), "n_levels", "statistic", "p_value", "fdr",
    )


def block_equivalence(blocks: DataFrame) -> DataFrame:
    """Rows (block_id, representative): the first block of a gene that parts its transcripts alike."""
    paths = blocks.groupBy("gene_id", "block_id", "path_index").agg(F.array_sort(F.collect_set("tx_id")).alias("members"))
    keys = paths.groupBy("gene_id", "block_id").agg(F.array_sort(F.collect_list("members")).alias("key"))
    number = F.regexp_extract("block_id", r":B(\d+)$", 1).cast("int")
    first = F.min_by("block_id", number).over(Window.partitionBy("gene_id", "key"))
    return keys.select("gene_id", "block_id", first.alias("representative"))


def collapse_equivalent(results: DataFrame, equivalence: DataFrame, identity=("cell_type",), order=("block_id",)) -> DataFrame:
    """results with each block's representative; the first row per representative and identity stays."""
    mapped = results.join(equivalence.select("block_id", "representative"), "block_id", "left").withColumn("representative", F.coalesce("representative", "block_id"))
    rank = F.row_number().over(Window.partitionBy("representative", *identity).orderBy(*order))
    return mapped.withColumn("__r", rank).where("__r = 1").drop("__r")


def block_mapping(blocks: DataFrame, present: DataFrame) -> DataFrame:
    """Paths of blocks among the transcripts present (ids without version), renumbered; blocks with under two go."""
    bare = lambda c: F.split(F.col(c), r"\.")[0]
    kept = blocks.withColumn("bare", bare("tx_id")).join(present.select(bare("tx_id").alias("bare")).distinct(), "bare", "left_semi")
    block = Window.partitionBy("block_id")
    kept = kept.withColumn("path", F.dense_rank().over(block.orderBy("path_index")) - 1).withColumn("__m", F.max("path").over(block))
    return kept.where("__m > 0").select("block_id", F.col("bare").alias("tx_id"), "path")


def annotate_junction_groups(junctions: DataFrame, exons: DataFrame) -> DataFrame:
    """junctions (junction_id, chrom, start, stop, strand) with gene, three-prime group and its size; exons have 1-based starts.

    A junction gets a gene if exactly one has an exon boundary next to either end and the strand is known.
    """
    contig = lambda c: F.regexp_replace(F.col(c), "^chr", "")
    ends = exons.select(contig("chrom").alias("c"), "gene_id", F.explode(F.array(F.col("start") - 1, F.col("stop") + 1)).alias("pos")).distinct()
    sites = junctions.select("junction_id", contig("chrom").alias("c"), F.explode(F.array("start", "stop")).alias("pos"))
    genes = sites.join(ends, ["c", "pos"]).groupBy("junction_id").agg(F.collect_set("gene_id").alias("genes"))
    out = junctions.join(genes, "junction_id", "left")
    sure = (F.size("genes") == 1) & F.col("strand").isin("+", "-")
    anchor = F.when(F.col("strand") == "+", F.col("stop")).otherwise(F.col("start"))
    out = out.withColumn("gene_id", F.when(sure, F.col("genes")[0])).withColumn("intron_group", F.when(sure, F.concat_ws("_", F.col("genes")[0], "chrom", anchor.cast("string"), "strand"))).drop("genes")
    sizes = out.where("intron_group IS NOT NULL").groupBy("intron_group").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "intron_group", "left")


def cluster_gene_map(members: DataFrame, junction_genes: DataFrame) -> DataFrame:
    """Rows (cluster, gene_id) of clusters whose junctions have one gene."""
    joined = members.join(junction_genes, "junction_id").where("gene_id IS NOT NULL")
    return joined.groupBy("cluster").agg(F.countDistinct("gene_id").alias("n"), F.min("gene_id").alias("gene_id")).where("n = 1").drop("n")


def t2t_maps(t2g: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows (tx_id, retained, gene_id): every transcript with the one that stands for it; duplicates has (duplicate, retained)."""
    mapped = t2g.join(duplicates.select(F.col("duplicate").alias("tx_id"), F.col("retained").alias("__kept")), "tx_id", "left")
    return mapped.select("tx_id", F.coalesce("__kept", "tx_id").alias("retained"), "gene_id")


def dedup_t2g(t2g: DataFrame, duplicates: DataFrame) -> DataFrame:
    """t2g without the transcripts that another one stands for."""
    return t2g.join(duplicates.select(F.col("duplicate").alias("tx_id")), "tx_id", "left_anti")


def valid_exons(near_exons: DataFrame, exon_counts: DataFrame, cutoff: float) -> DataFrame:
    """Rows (intron, exons): neighbouring exons whose counts add up to at least cutoff."""
    good = exon_counts.groupBy("exon").agg(F.sum("value").alias("t")).where(F.col("t") >= cutoff)
    return near_exons.join(good, "exon", "left_semi").groupBy("intron").agg(F.array_join(F.array_sort(F.collect_set("exon")), ",").alias("exons"))


#: Bases of a tile on which intervals and regions meet.
TILE = 16_384


def _tiles(start: Column, stop: Column) -> Column:
    return F.sequence(F.floor(start / TILE).cast("long"), F.floor((stop - 1) / TILE).cast("long"))


def _in_regions(intervals: DataFrame, regions: DataFrame, columns) -> DataFrame:
    """Rows (chrom, region, columns, start, stop, lo, hi, tile): intervals and regions (region, chrom, start, stop) that share a tile of a chromosome and overlap; once for each tile."""
    mine = intervals.where("start < stop").select("chrom", *columns, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.explode(_tiles(F.col("start"), F.col("stop"))).alias("tile"))
    frames = regions.where("start < stop").select("chrom", "region", F.col("start").cast("long").alias("lo"), F.col("stop").cast("long").alias("hi"), F.explode(_tiles(F.col("start"), F.col("stop"))).alias("tile"))
    return spread(mine, "chrom", "tile").join(frames, ["chrom", "tile"]).where("start < hi AND stop > lo")


def region_coverage(reads: DataFrame, regions: DataFrame, keys=("sample", "strand")) -> DataFrame:
    """Rows (region, keys, start, stop, depth): stretches of equal depth above 0 that intervals of reads (chrom, keys, start, stop) have in each region (region, chrom, start, stop).

    Intervals meet regions on tiles. What is summed are the steps of the depth, +1 where a
    read begins and -1 behind its end, at most two a read and tile and added up before they
    move; depth is their running sum, whatever a region's size. Steps at the border of
    tiles cancel. Regions may overlap; empty ones and empty reads give nothing.
    """
    keys = list(keys)
    met = _in_regions(reads, regions, keys)
    a, b = F.greatest("start", "lo", F.col("tile") * TILE), F.least("stop", "hi", (F.col("tile") + 1) * TILE)
    steps = F.explode(F.array(F.struct(a.alias("pos"), F.lit(1).alias("d")), F.struct(b.alias("pos"), F.lit(-1).alias("d"))))
    turns = met.where(a < b).select("chrom", "tile", "region", *keys, steps.alias("e")).select("chrom", "tile", "region", *keys, "e.*")
    if shares(turns):  # added up where a tile's rows lie, then moved in as many tasks as the input asks for
        turns = spread(turns.groupBy("chrom", "tile", "region", *keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0").drop("chrom", "tile"), "region", *keys, "pos")
    turns = turns.groupBy("region", *keys, "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    ranges = Ranges(turns, ["region", *keys], ["pos"])
    deep = ranges.running(ranges.rows, "d", "depth")
    runs = ranges.running(deep, "pos", "stop", how="min", reverse=True, exclusive=True).where("depth > 0")
    return runs.select("region", *keys, F.col("pos").alias("start"), "stop", "depth")


def region_junctions(junctions: DataFrame, regions: DataFrame, keys=("sample", "strand"), value: str = "value") -> DataFrame:
    """Rows (region, keys, start, stop, n): counts of the junctions that lie wholly in each region."""
    met = _in_regions(junctions, regions, [*keys, value]).where((F.floor(F.col("start") / TILE) == F.col("tile")) & (F.col("start") >= F.col("lo")) & (F.col("stop") <= F.col("hi")))
    return met.groupBy("region", *keys, "start", "stop").agg(F.sum(value).alias("n"))


def aggregate_samples(counts: DataFrame, keys=("intron",), pattern: str = r"_\d+$", value: str = "value") -> DataFrame:
    """Mean over the replicates of a cell type, which is the sample's name without its number."""
    return counts.withColumn("cell_type", F.regexp_replace("sample", pattern, "")).groupBy(*keys, "cell_type").agg(F.avg(value).alias("mean"))


def intersect_introns(introns: DataFrame, keys=("grp",)) -> DataFrame:
    """Common cores of chains of overlapping introns: the running intersection, restarted where an intron lies behind it.

    The fold runs over the sorted introns of one key, which is a plotted region.
    """
    kind = "struct<start:bigint,stop:bigint>"
    start = F.struct(F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
    item = lambda x: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        core = F.struct(F.greatest(acc["now"]["start"], x["start"]).cast("long").alias("start"), F.least(acc["now"]["stop"], x["stop"]).cast("long").alias("stop"))
        return (
            F.when(acc["now"].isNull(), F.struct(item(x).alias("now"), acc["out"].alias("out")))
            .when(x["start"] > acc["now"]["stop"], F.struct(item(x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))
            .otherwise(F.struct(core.alias("now"), acc["out"].alias("out")))
        )

    lists = introns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("x"))
    folded = lists.select(*keys, F.aggregate("x", start, step, lambda acc: F.concat(acc["out"], F.array(acc["now"]))).alias("cores"))
    return folded.select(*keys, F.explode("cores").alias("core")).select(*keys, "core.start", "core.stop")


def region_models(exons: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (region, tx_id, kind, start, stop): exons clipped to each region and the introns between a transcript's exons there."""
    first = F.greatest(F.floor(F.col("start") / TILE), F.floor(F.col("lo") / TILE)) == F.col("tile")
    inside = _in_regions(exons, regions, ["tx_id"]).where(first)
    clipped = inside.select("region", "tx_id", F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop"))
    after = F.lead("start").over(Window.partitionBy("region", "tx_id").orderBy("start"))
    told = clipped.withColumn("__n", after)
    exon = F.struct(F.lit("exon").alias("kind"), F.col("start").alias("start"), F.col("stop").alias("stop"))
    gap = F.when(F.col("__n") > F.col("stop"), F.struct(F.lit("intron").alias("kind"), F.col("stop").alias("start"), F.col("__n").alias("stop")))
    return told.select("region", "tx_id", F.explode(F.array_compact(F.array(exon, gap))).alias("x")).select("region", "tx_id", "x.kind", "x.start", "x.stop")
