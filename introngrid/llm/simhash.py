"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introngrid.graph import connected_components, forest
from introngrid.llm.shingles import MOST_ENDS, named_sets, set_name, shingle_hashes, shingle_set, similar_pairs
from introngrid.llm.words import by_batches, encoded, mix64, slices
from introngrid.storage import bounded_broadcast, free_shuffles, materialize, release

BITS = 64
#: Pairs of one bucket up to so many places apart in sort order are compared on the spot.
NEAR = 256
#: Members of one block where a larger bucket is compared block by block.
BLOCK = 1024
#: Near copies: bits of a fingerprint that make its buckets, for so many texts (a power of two) and fewer, and the radius that the masks cover.
KEY_BITS, KEY_RADIUS = ((26, 44), (30, 52), (34, 60), (64, 64)), 4
#: A pair of the least similarity meets in some bucket with this probability; it sets the number of fingerprints.
MEETING = 0.98
#: Fingerprints that one pass over the buckets takes: fewer at a time keep the shuffle's files small.
PASS = 5
#: Two texts of one bucket are looked at if at most so many of 96 bits of their fingerprints differ: true of 99.9 % of the pairs of similarity 0.8 there.
SKETCH_RADIUS = 21
#: They are verified if all their fingerprints lie as close as those of all but this share of the pairs of the least similarity.
MISSED = 0.005
#: Pairs but the nearest are verified if sketches of their whole sets lie as close as those of all but this share of the pairs of the least similarity.
SKETCH_MISSED = 0.001
#: Bits of such a sketch, and shingles up to which a set is sketched whole; of a larger set a half, a quarter, ... is sketched.
SKETCH_BITS, SKETCH_FULL = 2048, 2048
#: Buckets up to this size give all their pairs; of larger ones each text gives the nearest pair first.
SMALL = 9
#: Pairs of each text that are verified first.
FIRST = 3
#: The byte's bits, lowest first, as the eight bytes of a number.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def majorities(values: np.ndarray, counts: np.ndarray, prints: int = 1) -> np.ndarray:
    """Unsigned fingerprints, one row per group of counts[i] hashes, one column per print: a bit is 1 if over half of the hashes have it.

    The first print takes the hashes as they are, the others scramble them anew. Eight
    bits are counted at once, one to each byte of a 64-bit lane, in stretches too short
    for a byte to overflow.
    """
    out = np.zeros((len(counts), prints), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    inside = np.arange(len(values)) - np.repeat(first, counts[full])
    stretch = np.flatnonzero(inside % 255 == 0)
    owner = np.searchsorted(stretch, first)
    for k in range(prints):
        octets = values.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(SPREAD[octets[:, byte]], stretch)
            ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
            bits = (2 * ones > counts[full][:, None]).astype(np.uint64) << np.arange(8, dtype=np.uint64)
            out[full, k] |= bits.sum(1, dtype=np.uint64) << np.uint64(8 * byte)
        values = mix64(values + np.uint64(k + 1))
    return out


def simhash(texts: list[bytes], width: int = 4) -> np.ndarray:
    """Unsigned fingerprints of the texts' shingles, repeats included, hashed by XXH64 with seed 42; wordless texts have 0."""
    lists = [shingle_hashes(text, width) for text in texts]
    values = np.fromiter((h for x in lists for h in x), dtype=np.uint64, count=sum(map(len, lists)))
    return majorities(values, np.array([len(x) for x in lists], dtype=np.int64))[:, 0]


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 masks of the lowest `bits` bits, as signed 64-bit numbers.

    Bit i has the vector m(i) of radius + 1 bits, not zero; mask v keeps the bits whose
    m(i) has an odd number of bits in common with v. The vectors of at most `radius`
    differing bits don't span the space, so some v is orthogonal to all of them: that
    mask clears every differing bit, and the pair shares its bucket.
    """
    n = 2 ** (radius + 1)
    masks = []
    for v in range(1, n):
        mask = sum(1 << i for i in range(bits) if bin((i % (n - 1) + 1) & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _sorted_neighbours(radius: int):
    """Of rows sorted by (t, key, fp): edges between members of a bucket, and the buckets not compared whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, first, last = None, None, None
        for frame in frames:
            t, key, fp = (frame[c].to_numpy() for c in ("t", "key", "fp"))
            if not len(t):
                continue
            new = 0
            if tail is not None:
                new = len(tail[0])
                t, key, fp = (np.concatenate((x, y)) for x, y in zip(tail, (t, key, fp), strict=True))
            if first is None:
                first = (int(t[0]), int(key[0]))
            last = (int(t[-1]), int(key[-1]))
            ea, eb, at = [], [], np.arange(len(t))
            for s in range(1, NEAR + 1):
                at = at[at + s < len(t)]
                at = at[(t[at] == t[at + s]) & (key[at] == key[at + s])]
                if not len(at):
                    break
                pair = at[at + s >= new]  # both in the tail: compared before
                d = np.bitwise_count((fp[pair] ^ fp[pair + s]).view(np.uint64))
                hit = pair[(d <= radius) & (d > 0)]
                ea.append(fp[hit])
                eb.append(fp[hit + s])
            a, b = forest(np.concatenate(ea), np.concatenate(eb)) if ea else (fp[:0], fp[:0])
            yield pd.DataFrame({"kind": np.zeros(len(a), np.int32), "a": a, "b": b})
            if len(at):  # some bucket has a pair NEAR places apart, and so perhaps farther ones
                far = pd.DataFrame({"kind": np.ones(len(at), np.int32), "a": t[at].astype(np.int64), "b": key[at]}).drop_duplicates()
                yield far
            tail = (t[-NEAR:], key[-NEAR:], fp[-NEAR:])
        if first is not None:  # these may go on in the partitions beside this one
            ends = pd.DataFrame([first, last], columns=["a", "b"]).drop_duplicates()
            yield ends.assign(kind=np.int32(1))[["kind", "a", "b"]]

    return run


def _blocks(radius: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fp, comp, block = (frame[c].to_numpy() for c in ("fp", "comp", "block"))
        lo, hi = frame["i"].iloc[0], frame["j"].iloc[0]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        ea, eb = [fp[:0]], [fp[:0]]
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            near = np.bitwise_count((fp[rows][:, None] ^ fp[right][None, :]).view(np.uint64)) <= radius
            x, y = np.nonzero(near & (comp[rows][:, None] != comp[right][None, :]))
            a, b = forest(fp[rows][x], fp[right][y])
            ea.append(a)
            eb.append(b)
        a, b = forest(np.concatenate(ea), np.concatenate(eb))
        return pd.DataFrame({"a": a, "b": b})

    return run


def link_fingerprints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Rows (fp, comp) for every distinct fingerprint of prints (fp long): comp is its component's smallest fp.

    Every pair within the radius shares a bucket of some covering mask. The buckets lie
    sorted over range partitions, so that a bucket of any size is spread, and each member
    is compared with the next NEAR ones. Buckets larger than that, or cut by a partition's
    edge, are looked at again: if they still hold more than one component, all pairs of
    different components are compared, in blocks of about BLOCK members. Only edges of
    spanning forests are written, never all pairs.
    """
    masks = covering_masks(radius)
    prints = materialize(prints.select("fp").distinct(), "prints")
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks]), F.col("t") + 1))
    bare = prints.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"), "fp")
    rows = bare.withColumn("key", key)
    schema = "kind int, a long, b long"
    # Only t and fp move; the key is worked out again behind the shuffle.
    dealt = bare.repartitionByRange("t", key, "fp").select("t", key.alias("key"), "fp")
    found = dealt.sortWithinPartitions("t", "key", "fp").mapInPandas(_sorted_neighbours(radius), schema)
    found = materialize(found, "found")
    edges = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comps = materialize(connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("comp")), "comps")
    unfinished = found.where("kind = 1").select(F.col("a").cast("int").alias("t"), F.col("b").alias("key")).distinct()
    members = rows.join(unfinished, ["t", "key"]).join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    members = materialize(members, "members")
    mixed = members.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(mixed.select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "mixed")
    if mixed.limit(1).count():
        spread = members.join(mixed, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        more = spread.groupBy("t", "key", "i", "j").applyInPandas(_blocks(radius), "a long, b long")
        more = materialize(more, "more")  # the components read their edges twice
        edges = edges.union(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        comps = materialize(connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("comp")), "comps")
    release(members, found)
    return prints.join(comps, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows (doc_id, fp) for whole texts, lower-cased A-Z; null or wordless text has fingerprint 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "fp": simhash([encoded(x) for x in part["text"]], width).view(np.int64)})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return by_batches(narrow, run, "doc_id long, fp long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (signed), fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable through fingerprints within the radius.
    Equal fingerprints link, zero included. Rows are kept with repeats; a null doc_id gets
    its component's id, which is null only if all its ids are. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    comps = link_fingerprints(prints, radius)
    labelled = materialize(comps.join(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fp"), "labelled")
    lowest = materialize(labelled.groupBy("comp").agg(F.min("low").alias("component_id")), "lowest")
    names = materialize(labelled.join(lowest, "comp").select("fp", "component_id"), "names")
    release(labelled, lowest)
    free_shuffles(docs.sparkSession)
    return prints.join(names, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tables_for(texts: int, least: float) -> tuple[int, int]:
    """Key bits and number of fingerprints for so many texts and a least similarity.

    Longer keys keep buckets of unlike texts small, more fingerprints make up for the
    pairs that longer keys part. What two sets of similarity s differ in is arccos(2 s /
    (1 + s)) / pi of all bits, and drawn pairs tell how many of them the masks bring together.
    """
    bits = next(b for most, b in KEY_BITS if texts <= 1 << most)
    rng = np.random.default_rng(1)
    differ = rng.random((20_000, bits)) < np.arccos(2 * least / (1 + least)) / np.pi
    differ = (differ.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
    masks = np.array(covering_masks(KEY_RADIUS, bits), dtype=np.int64).view(np.uint64)
    met = (differ[:, None] & masks == 0).any(1).mean()
    return bits, int(np.ceil(np.log(1 - MEETING) / np.log(1 - met)))


def _signatures(width: int, prints: int):
    """Of each text: the name of its shingle set, and fingerprints of the set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            sets = [shingle_set(encoded(x), width) for x in part["text"]]
            found = majorities(np.concatenate(sets), np.array([len(x) for x in sets], dtype=np.int64), prints).view(np.int64)
            names = np.array([set_name(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "node": names, "prints": list(found)})

    return run


def _apart(fp: np.ndarray, more: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprints of rows x and y."""
    return sum(np.bitwise_count((c[x] ^ c[y]).view(np.uint64)).astype(np.int64) for c in (fp, more))


def _bucket_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by bucket: likely pairs (kind 0, nodes a and b, distance d), and all rows of buckets whose pairs are not all among these (kind 1, bucket a, node b).

    comp is a row's component as far as it is known, 0 for one of its own: pairs inside a
    component are not given, nor are the rows of buckets that lie in one.
    """
    names = ["bucket", "node", "fp", "more", "comp"]
    held = [np.zeros(0, np.int64)] * len(names)  # the last bucket so far: it may go on
    known = False  # whether the held rows' bucket began before them
    large = False  # whether it is one of those that are given row by row

    def look(rows: list[np.ndarray], old: int, first_cut: bool, first_large: bool, last_cut: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """old: rows at the start that were looked at before."""
        bucket, node, fp, more, comp = rows
        new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.append(new, len(bucket)))
        big = size > SMALL
        big &= (np.minimum.reduceat(comp, new) != np.maximum.reduceat(comp, new)) | (comp[new] == 0)
        big[0] |= first_cut | first_large
        big[-1] |= last_cut
        of_row = np.repeat(big, size)
        end = np.repeat(new + size, size)
        ea, eb, ed = [], [], []
        at = np.arange(len(bucket))
        open_ = np.ones(len(bucket), bool)
        for s in range(1, SMALL):
            at = at[at + s < end[at]]
            if not len(at):
                break
            x = at[(at + s >= old) & (open_[at] | ~of_row[at])]
            x = x[(comp[x] != comp[x + s]) | (comp[x] == 0)]
            d = _apart(fp, more, x, x + s)
            hit = d <= SKETCH_RADIUS
            x, d = x[hit], d[hit]
            open_[x] = False
            ea.append(node[x])
            eb.append(node[x + s])
            ed.append(d)
        a, b, d = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ea, eb, ed))
        pairs = pd.DataFrame({"kind": np.zeros(len(a), np.int32), "a": a, "b": b, "d": d})
        row = np.flatnonzero(of_row)
        row = row[row >= (old if first_large else 0)]
        members = pd.DataFrame({"kind": np.ones(len(row), np.int32), "a": bucket[row], "b": node[row], "d": np.zeros(len(row), np.int64)})
        return pairs, members

    start = True
    for frame in frames:
        if not len(frame):
            continue
        rows = [np.concatenate((h, frame[c].to_numpy().astype(np.int64))) for h, c in zip(held, names, strict=True)]
        old = len(held[0]) if large else 0
        first_cut = known if len(held[0]) else start
        start = False
        bucket = rows[0]
        last = int(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[-1])
        if last > 0 or large or len(bucket) > SMALL:
            whole = last == 0  # one bucket fills all rows: it is large, and only its last rows are kept for the pairs to come
            done = len(bucket) if whole else last
            yield from look([c[:done] for c in rows], old, first_cut, large, whole)
            if whole:
                held, large, known = [c[-(SMALL - 1) :] for c in rows], True, first_cut
            else:
                held, large, known = [c[last:] for c in rows], False, False
        else:
            held, known = rows, first_cut
    if len(held[0]):
        if not large:
            yield from look(held, 0, known, False, True)


def _in_buckets(nodes: DataFrame, masks: list[int], count: int, start: int, stop: int) -> DataFrame:
    """What _bucket_pairs finds in the buckets of fingerprints start to stop, as a written table; nodes has (nid, prints, comp)."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t") + 1)
    mask = F.element_at(F.array(*[F.lit(m) for m in masks]), (F.col("t") % len(masks) + 1).cast("int"))
    bucket = F.col("fp").bitwiseAND(mask).bitwiseXOR(pick(_marks(count * len(masks)).tolist()))
    prints = [
        F.struct(F.lit(i * len(masks)).alias("base"), F.col("prints")[i].alias("fp"), F.col("prints")[(i + 1) % count].bitwiseAND(F.lit(0xFFFFFFFF)).alias("more"))
        for i in range(start, stop)
    ]
    rows = nodes.select(F.col("nid").alias("node"), "comp", F.explode(F.array(*prints)).alias("p")).select("node", "comp", "p.*")
    rows = rows.select("node", "comp", "fp", "more", F.explode(F.sequence(F.col("base"), F.col("base") + len(masks) - 1)).alias("t"))
    # Only t, the component and the fingerprints move; the bucket is worked out again behind the shuffle, and one long sorts fast.
    dealt = rows.repartitionByRange(bucket, "node").select(bucket.alias("bucket"), "node", "fp", "more", "comp")
    return materialize(dealt.sortWithinPartitions("bucket").mapInPandas(_bucket_pairs, "kind int, a long, b long, d long"), "buckets")


def _likely(found: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) with their least distance."""
    return found.where("kind = 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _pairs_of(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("a", "b")
    for table in tables[1:]:
        out = out.union(table.select("a", "b"))
    return out


def _sets_of(texts: DataFrame, nodes: DataFrame, want: DataFrame, width: int, have: DataFrame | None = None) -> DataFrame:
    """The shingle sets of all nodes wanted that are not among those at hand."""
    want = want.distinct()
    if have is not None:
        want = want.join(have.select("node"), "node", "left_anti")
    ids = materialize(nodes.join(want, "node", "left_semi").select("doc_id"), "met")
    sets = materialize(named_sets(texts.join(bounded_broadcast(ids, MOST_ENDS), "doc_id", "left_semi"), width), "sets-met")
    # A repeated doc_id brings other texts along, and some of them twice.
    return sets if sets.count() == ids.count() else sets.join(want, "node", "left_semi").dropDuplicates(["node"])


def _wanted(pairs: DataFrame) -> DataFrame:
    """The FIRST nearest pairs of each text, from either side."""
    ends = pairs.select(F.col("a").alias("v"), "a", "b", "d").union(pairs.select(F.col("b").alias("v"), "a", "b", "d"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("d", "a", "b"))
    return ends.withColumn("r", rank).where(F.col("r") <= FIRST).groupBy("a", "b").agg(F.min("d").alias("d"))


def _labels(edges: DataFrame) -> DataFrame:
    return materialize(connected_components(edges).select(F.col("node"), F.col("component").alias("comp")), "comps")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    left = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    told = pairs.join(left, "a", "left").join(right, "b", "left")
    return told.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def _crowds(found: DataFrame, nodes: DataFrame, prints: int) -> DataFrame:
    """Rows (nid, node, crowd, k): texts that large buckets of one fingerprint join, and the blocks that each crowd is dealt to.

    A crowd is given if comparing all its pairs once costs no more than comparing those of
    its buckets for each of the fingerprints; a looser one stays with its buckets.
    """
    rows = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("nid"))
    large = rows.groupBy("bucket").agg(F.min("nid").alias("low"), F.count("*").alias("n")).where(F.col("n") > SMALL)
    large = materialize(large, "large")
    edges = rows.join(large, "bucket").select(F.col("nid").alias("src"), F.col("low").alias("dst"))
    placed = materialize(connected_components(edges).select(F.col("node").alias("nid"), F.col("component").alias("crowd")), "placed")
    work = large.join(placed, F.col("low") == F.col("nid")).groupBy("crowd").agg(F.sum(F.col("n") * F.col("n") * prints).alias("work"))
    size = placed.groupBy("crowd").agg(F.count("*").alias("n")).join(work, "crowd").where(F.col("n") * F.col("n") <= F.col("work"))
    size = materialize(size.select("crowd", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "crowd-sizes")
    out = materialize(placed.join(size, "crowd").join(nodes.select("nid", "node"), "nid").select("nid", "node", "crowd", "k"), "crowds")
    release(large, placed, size)
    return out


def _in_crowds(crowds: DataFrame, nodes: DataFrame, comps: DataFrame, sketches: DataFrame, prints: int, least: float, nearest: int | None) -> DataFrame:
    """Pairs (a, b) of a crowd's texts in different components that are close and whose sketches may reach `least`: all, or the nearest ones of each text in each block."""
    traits = crowds.select("node", F.col("crowd").alias("bucket"), "k").join(nodes.select("node", "prints"), "node").join(sketches, "node")
    blocks = _in_blocks(traits.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    dealt = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    pairs = dealt.mapInPandas(_close_across([], prints, _most_apart(prints, least), least, nearest), "a long, b long")
    return pairs.distinct() if nearest else pairs


def link_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (doc_id, comp) for every row with an id: texts are linked if the Jaccard similarity of their shingle sets is at least `least`.

    Texts of equal sets are one node, wordless ones too. Each node has several SimHash
    fingerprints, and covering masks over the key bits of each make its buckets (tables_for
    says how many). Buckets lie sorted over range partitions, so that one of any size is
    spread. Two nodes of a bucket whose fingerprints differ little are a pair to verify, and
    every link is verified on the whole sets. Most pairs of a large group are never looked
    at: each node's nearest pairs are verified first, then pairs that still join different
    components, and at last those of large buckets that still hold several components. So
    the components are those of all likely pairs, and no link lies below `least` (but for
    collisions of 64-bit hashes).

    The buckets of the first fingerprint come first, and the links that it gives make
    components before the buckets of all fingerprints are looked through: there a large
    group is one component, and only its pairs with others are left. Texts that its large
    buckets join are a crowd, links or not. All pairs of a crowd are compared there and
    then, in blocks of texts, so its pairs are never spelled out bucket by bucket.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    bits, count = tables_for(narrow.count(), least)
    told = materialize(narrow.mapInPandas(_signatures(width, count), "doc_id long, node long, prints array<long>"), "signatures")
    nodes = told.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("prints").alias("prints"))
    nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # short numbers: they move often
    masks = covering_masks(KEY_RADIUS, bits)
    # One fingerprint first: what it links need not be paired again in the buckets of all.
    lone = nodes.select("nid", "node", "prints", F.lit(0).cast("long").alias("comp"))
    found = _in_buckets(lone, masks, count, 0, 1)
    pairs = materialize(_likely(found), "pairs")
    first = materialize(_close(_wanted(pairs), nodes, count, least), "first-pairs")
    free_shuffles(spark)
    crowds = _crowds(found, nodes, count)
    sets = materialize(_sets_of(narrow, nodes, _ends(first).union(crowds.select("node")), width), "sets")
    edges = materialize(similar_pairs(first, sets, least), "near-edges")
    comps = _labels(edges)
    free_shuffles(spark)
    tried = [first]  # tables of pairs that have been verified
    if crowds.limit(1).count():
        drawn = materialize(_sketched(sets.join(crowds.select("node"), "node", "left_semi"), least), "sketches")
        for nearest in (FIRST, None):
            across = _in_crowds(crowds, nodes, comps, drawn, count, least, nearest).join(_pairs_of(tried), ["a", "b"], "left_anti")
            across = materialize(across, "crowd-pairs")
            tried.append(across)
            if across.limit(1).count():
                edges = edges.unionByName(materialize(similar_pairs(across, sets, least), "near-edges"))
                comps = _labels(edges)
                free_shuffles(spark)
        release(drawn)
    # Pairs of one crowd are settled, as those of one component are.
    label = F.coalesce(-F.col("crowd") - 1, "comp", F.lit(0)).alias("comp")
    known = nodes.join(comps, "node", "left").join(crowds.select("node", "crowd"), "node", "left").select("nid", "node", "prints", label)
    known = materialize(known, "known")
    release(found, pairs)
    parts = []
    for k in range(0, count, PASS):
        parts.append(_in_buckets(known, masks, count, k, min(k + PASS, count)))
        free_shuffles(spark)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    pairs = materialize(_close(_likely(found), nodes, count, least), "pairs")
    free_shuffles(spark)
    members = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("nid")).join(nodes.select("nid", "node"), "nid")
    members = materialize(members.drop("nid"), "members")
    release(known, *parts)
    met = _ends(pairs).union(members.select("node").distinct())
    sets = sets.unionByName(materialize(_sets_of(narrow, nodes, met, width, sets), "sets"))
    first = materialize(_wanted(pairs), "first-pairs")
    edges = edges.unionByName(materialize(similar_pairs(first, sets, least), "near-edges"))
    comps = _labels(edges)
    free_shuffles(spark)
    sketches = materialize(_sketched(sets, least), "sketches")
    rest = _across(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), comps)
    rest = materialize(_within_reach(rest, sketches, least), "rest-pairs")
    if rest.limit(1).count():
        edges = edges.unionByName(materialize(similar_pairs(rest, sets, least), "near-edges"))
        comps = _labels(edges)
        free_shuffles(spark)
    placed = materialize(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "mixed")
    inside = materialize(placed.join(mixed, "bucket"), "mixed-members")
    # Fingerprints and sketches join the members of mixed buckets alone.
    there = materialize(inside.select("node").distinct(), "mixed-nodes")
    traits = nodes.select("node", "prints").join(there, "node", "left_semi").join(sketches, "node")
    inside = _in_blocks(inside.join(materialize(traits, "traits"), "node"))
    dealt = inside.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = dealt.mapInPandas(_close_across(masks, count, _most_apart(count, least), least), "a long, b long")
    more = materialize(more.join(_pairs_of([pairs, *tried]), ["a", "b"], "left_anti"), "more-pairs")
    if more.limit(1).count():
        edges = edges.unionByName(materialize(similar_pairs(more, sets, least), "near-edges"))
        comps = _labels(edges)
    out = materialize(told.select("doc_id", "node").join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp")), "near-groups")
    release(told, nodes, crowds, pairs, first, sketches, rest, members, placed, there, more, *tried)
    free_shuffles(spark)
    return out


def _most_apart(prints: int, least: float) -> int:
    """Differing bits of all fingerprints that a pair of similarity `least` exceeds with probability MISSED."""
    rate = np.arccos(2 * least / (1 + least)) / np.pi
    spread = NormalDist().inv_cdf(1 - MISSED)
    return int(np.ceil(BITS * prints * rate + spread * np.sqrt(BITS * prints * rate * (1 - rate))))


def _close(pairs: DataFrame, nodes: DataFrame, prints: int, least: float) -> DataFrame:
    """The pairs, given by nid, whose fingerprints all together are close, now by node, a < b."""
    side = lambda end: nodes.select(F.col("nid").alias(end), F.col("node").alias(f"n{end}"), F.col("prints").alias(f"p{end}"))
    apart = sum(F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(prints))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= _most_apart(prints, least))
    return both.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "d")


def set_sketch(hashes: np.ndarray, least: float) -> np.ndarray:
    """A set in few numbers: its size, the hashes sketched at its level and at the next, and the sketches of both, the second only where a partner may need it.

    At level k one hash in 2**k is sketched; a set's level is the least at which about
    SKETCH_FULL remain. A sketch has one bit for each of SKETCH_BITS classes of hashes:
    whether the class holds an odd number of them. The sketches of two sets differ where
    the sets do. Sets whose sizes lie within 2 : 1 share a level; one whose partners, at
    most 1 / least times as large, have no higher level is sketched once.
    """
    low = max(0, int(np.ceil(np.log2(max(1, len(hashes)) / SKETCH_FULL))))
    counts, bits = [len(hashes)], []
    for level in (low, low + 1):
        part = hashes[(hashes >> np.uint64(11)) & np.uint64((1 << level) - 1) == 0]
        odd = np.bincount((part % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        counts.append(len(part))
        bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    if len(hashes) <= least * SKETCH_FULL * 2**low:
        bits.pop()
    return np.concatenate([np.array(counts, dtype=np.int64), *bits])


def stacked(sketches: Iterable[np.ndarray]) -> np.ndarray:
    """Sketches as the rows of one matrix; a second one that is not there is zero."""
    sketches = list(sketches)
    out = np.zeros((len(sketches), 3 + 2 * SKETCH_BITS // 64), dtype=np.int64)
    for row, sketch in zip(out, sketches, strict=True):
        row[: len(sketch)] = sketch
    return out


def _sketched(sets: DataFrame, least: float) -> DataFrame:
    """Rows (node, sketch) of sets (node, shingles)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            sketch = [set_sketch(np.asarray(x, dtype=np.int64).view(np.uint64), least) for x in part["shingles"]]
            yield pd.DataFrame({"node": part["node"].array, "sketch": sketch})

    return sets.mapInPandas(run, "node long, sketch array<long>")


def may_reach(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets of the sketches x and y (a row each) may have a Jaccard similarity of `least`: true of all but SKETCH_MISSED of the pairs that just have it.

    Sets of m and n hashes with that similarity differ in d = (m + n)(1 - least) / (1 + least)
    of them. Of 2,048 classes, 2048 (1 - exp(-2 d / 2048)) / 2 then hold an odd number of
    these on average. The spread is that of odd classes and, where only a part is sketched, of that part.
    """
    size, other = x[:, 0], y[:, 0]
    low, high = np.minimum(size, other), np.maximum(size, other)
    level = lambda m: np.maximum(0, np.ceil(np.log2(np.maximum(1, m) / SKETCH_FULL)))
    top = level(high)
    words = SKETCH_BITS // 64

    def at_top(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        later = level(z[:, 0]) < top
        return np.where(later, z[:, 2], z[:, 1]), np.where(later[:, None], z[:, 3 + words :], z[:, 3 : 3 + words])

    (m, a), (n, b) = at_top(x), at_top(y)
    odd = np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)
    d = (m + n) * (1 - least) / (1 + least)
    both = (m + n - d) / 2
    fade = np.exp(-2 * d / SKETCH_BITS)
    spread = SKETCH_BITS / 4 * (1 - fade**2) - d * fade**2
    part = np.where(top > 0, 4 * d * both / np.maximum(4 * both + d, 1), 0.0)
    limit = SKETCH_BITS / 2 * (1 - fade) + NormalDist().inv_cdf(1 - SKETCH_MISSED) * np.sqrt(np.maximum(spread, 0) + part * fade**2)
    return (low >= least * high) & ((odd <= np.ceil(limit)) | (top - level(low) > 1))  # no level in common: sketches tell nothing


def _within_reach(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches may reach `least`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 8192):
                part = frame.iloc[k : k + 8192]
                yield part.loc[may_reach(stacked(part["x"]), stacked(part["y"]), least), ["a", "b"]]

    side = lambda end, name: sketches.select(F.col("node").alias(end), F.col("sketch").alias(name))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(run, "a long, b long")


def _marks(tables: int) -> np.ndarray:
    """A number for each table (a fingerprint under a mask) that tells its buckets from those of others."""
    return mix64(np.arange(1, tables + 1, dtype=np.uint64)).view(np.int64)


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members of buckets, each in all pairs (i, j) of blocks that it belongs to: a bucket of up to BLOCK members is one block and moves once."""
    spread = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "prints", "sketch")


def _close_across(masks: list[int], prints: int, most: int, least: float, nearest: int | None = None):
    """Of rows sorted by (bucket, i, j): pairs (a, b), a < b, from both blocks and different components that differ in at most `most` bits and whose sketches may reach `least`.

    A pair is given once, by the first of all tables in which its ends share a bucket:
    that bucket is here as well, or it is a small one whose pairs were all looked at before.
    Without masks a bucket is a crowd, which holds a pair once. With `nearest`, a row's
    nearest pairs, so many, are looked at alone, from either side.
    """
    mask, marks = np.tile(np.array(masks, dtype=np.int64), prints), _marks(prints * len(masks))

    def block(rows: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        _, i, j, own = rows[:4]
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        yield from side(rows, left, right)
        if nearest and i[0] != j[0]:
            yield from side(rows, right, left)

    def side(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        bucket, i, j, _, node, comp, fp, sketch = rows
        for k in range(0, len(left), 128):
            x = left[k : k + 128]
            apart = np.zeros((len(x), len(right)), np.int32)
            for c in range(prints):
                apart += np.bitwise_count((fp[x, c][:, None] ^ fp[right, c][None, :]).view(np.uint64))
            good = (apart <= most) & (comp[x][:, None] != comp[right][None, :])
            if nearest and len(right) > nearest:
                apart[~good] = most + 1
                picked = np.argpartition(apart, nearest - 1, axis=1)[:, :nearest]
                chosen = np.zeros_like(good)
                np.put_along_axis(chosen, picked, True, axis=1)
                good &= chosen
            elif i[0] == j[0] and not nearest:
                good &= node[x][:, None] < node[right][None, :]
            u, v = np.nonzero(good)
            u, v = x[u], right[v]
            reach = [may_reach(sketch[u[k : k + 8192]], sketch[v[k : k + 8192]], least) for k in range(0, len(u), 8192)]
            u, v = (z[np.concatenate(reach)] if reach else z for z in (u, v))
            first = np.full(len(u), -1)
            if not masks:
                a, b = node[u], node[v]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
                continue
            for t in range(len(mask)) if len(u) else ():
                open_ = np.flatnonzero(first < 0)
                if not len(open_):
                    break
                c = t // len(masks)
                met = open_[(fp[u[open_], c] ^ fp[v[open_], c]) & mask[t] == 0]
                first[met] = t
            here = (fp[u, first // len(masks)] & mask[first]) ^ marks[first] == bucket[0]
            a, b = node[u[here]], node[v[here]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[list[np.ndarray]] = []  # rows of the last pair of blocks so far, which may go on
        for frame in frames:
            if not len(frame):
                continue
            rows = [frame[c].to_numpy() for c in ("bucket", "i", "j", "own", "node", "comp")] + [np.stack(frame["prints"].to_numpy()), stacked(frame["sketch"])]
            if rest:
                rows = [np.concatenate(z) for z in zip(rest[0], rows, strict=True)]
            edges = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            starts = [0, *edges.tolist()]
            for s, e in zip(starts, starts[1:], strict=False):
                yield from block([r[s:e] for r in rows])
            rest = [[r[starts[-1] :] for r in rows]]
        if rest:
            yield from block(rest[0])

    return run


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id.

    Rows without a doc_id stay and link nothing. Rows that repeat a kept doc_id all stay.
    """
    groups = link_near_copies(docs, id_col, text_col, width, least)
    kept = materialize(groups.groupBy("comp").agg(F.min("doc_id").alias("keep")), "kept")
    gone = groups.join(kept, "comp").where(F.col("doc_id") != F.col("keep")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = gone.join(kept.select(F.col("keep").alias("__gone")), "__gone", "left_anti")
    return docs.join(materialize(gone, "near-copies"), docs[id_col] == F.col("__gone"), "left_anti")
