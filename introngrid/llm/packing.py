"""Harmonic packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introngrid.llm.tokens import word_ids
from introngrid.llm.words import by_batches, encoded, slices
from introngrid.storage import bounded_broadcast, free_shuffles, materialize

CAPACITY = 2048
#: Class k holds the lengths in (capacity / (k + 1), capacity / k] for k up to this; shorter pieces only fill gaps.
CLASSES = 63
#: Pieces of a worker's share, about: each share fills the bins of its classes on its own.
SHARE = 50_000
#: Steps by which the part of the pieces that fills gaps is set.
STEPS = 1024
#: Positions that one cell of the join of gaps with fillers covers.
CELL = 4096
END_ID = 1

PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces before gaps are filled: whole sequences, then what remains."""
    return [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, ids), one per piece; every document has its ids and end_id.

    ids (little-endian uint32) are given of pieces below the capacity, which may be cut later, and of all with with_ids.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(tokenizer_path)
        for part in slices(frames):
            ids, sizes = encoder.encode([encoded(x) for x in part["text"]])
            ids, at, own, rows = ids.astype("<u4"), 0, [], []
            for i, n in enumerate(sizes.tolist()):
                full = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                start = 0
                for length in cut_lengths(n + 1, capacity):
                    piece = full[start : start + length].tobytes()
                    own.append(i)
                    rows.append((start, length, zlib.crc32(piece), n + 1, piece if with_ids or length < capacity else None))
                    start += length
            out = pd.DataFrame(rows, columns=[*PIECE[1:], "ids"])
            out.insert(0, "doc_id", part["doc_id"].array[np.array(own, dtype=np.int64)])
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_batches(narrow, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows that come before in the order of a column without repeats.

    Range partitions sum up side by side; only their totals, one row each, meet in one task.
    """
    placed = materialize(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("__part").agg(F.sum(value).alias("__all"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("__base")
    return placed.join(bounded_broadcast(materialize(totals, "range-totals")), "__part").withColumn(name, sums).drop("__part", "__base")


def filler_steps(counts: list[tuple[int, int, int]], tokens: int, capacity: int) -> int:
    """The least number of steps such that the pieces in them fill the gaps of all bins. counts: (class, step, pieces).

    With n pieces of class k left, floor(n / k) bins are filled; there is enough to fill
    them to the brim once these bins' capacity is at most all tokens.
    """
    table = np.zeros((CLASSES + 1, STEPS + 1), dtype=np.int64)
    for k, step, n in counts:
        table[k, step] += n
    left = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]  # pieces of a class in this step and later ones
    bins = (left[1:] // np.arange(1, CLASSES + 1)[:, None]).sum(0)
    return int(np.argmax(bins * capacity <= tokens))


def _fill_cuts(fillers: DataFrame, gaps: DataFrame, bins: int, room: int, capacity: int) -> DataFrame:
    """Rows (uid, inner, length, sequence_id, offset): fillers laid end to end over the gaps, and then over new sequences.

    Both lie on one line of token positions. They meet by an equality of cells of this
    line beside the overlap, so no range is joined without a key.
    """
    units = materialize(_before(fillers.select("uid", "length"), "uid", "length", "s").withColumn("e", F.col("s") + F.col("length")), "units")
    holes = _before(gaps, "sequence_id", "gap", "hs").withColumn("he", F.col("hs") + F.col("gap"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL))).alias("cell")
    over = units.where(F.col("s") < room).select("uid", "s", "e", cells("s", "e")).join(holes.select("sequence_id", "gap", "hs", "he", cells("hs", "he")), "cell")
    low, high = F.greatest("s", "hs"), F.least("e", "he")
    over = over.where((low < high) & (F.floor(low / CELL) == F.col("cell")))
    inside = over.select("uid", (low - F.col("s")).alias("inner"), (high - low).alias("length"), "sequence_id", (F.lit(capacity) - F.col("gap") + low - F.col("hs")).alias("offset"))
    past = units.where(F.col("e") > room).withColumn("from", F.greatest(F.col("s"), F.lit(room)) - room).withColumn("to", F.col("e") - room)
    past = past.select("*", F.explode(F.sequence(F.floor(F.col("from") / capacity), F.floor((F.col("to") - 1) / capacity))).alias("j"))
    a, b = F.greatest(F.col("from"), F.col("j") * capacity), F.least(F.col("to"), (F.col("j") + 1) * capacity)
    beyond = past.select("uid", (a + room - F.col("s")).alias("inner"), (b - a).alias("length"), (F.col("j") + bins).alias("sequence_id"), (a - F.col("j") * capacity).alias("offset"))
    return inside.unionByName(beyond)


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        own, rows = [], []
        for i, (start, total, ids, cuts) in enumerate(zip(frame["start"], frame["doc_tokens"], frame["ids"], frame["cuts"], strict=True)):
            for c in cuts:
                part = ids[4 * c["inner"] : 4 * (c["inner"] + c["length"])]
                own.append(i)
                rows.append((start + c["inner"], c["length"], zlib.crc32(part), total, part, c["sequence_id"], c["offset"]))
        out = pd.DataFrame(rows, columns=[*PIECE[1:], "ids", "sequence_id", "offset"])
        out.insert(0, "doc_id", frame["doc_id"].array[np.array(own, dtype=np.int64)])
        yield out


def pack(pieces: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces (a written table) with sequence_id and offset: no sequence holds over `capacity` tokens, offsets leave no gap.

    Lengths in (capacity / (k + 1), capacity / k] are class k, and a bin of class k takes k
    of its pieces. Pieces are dealt by hash to shares, whose (class, share) groups fill
    their bins independently of each other. What a group leaves over, pieces below the
    smallest class and as many others, chosen by hash, as it takes are fillers: they are
    laid end to end into the bins' gaps and cut where a gap ends, and what remains of them
    makes sequences of its own. So all sequences but the last are full, whatever the
    lengths. Pieces of full length are a sequence each. Sequence ids run from 0.
    """
    length = F.col("length")
    k = F.when(length >= capacity, F.lit(0)).otherwise(F.floor(F.lit(capacity) / length)).cast("int")
    mark = lambda salt: F.xxhash64("uid", "ids_crc32", F.lit(salt))
    step = F.pmod(mark("step"), F.lit(STEPS)).cast("int")
    narrow = pieces.select("uid", "length", "ids_crc32", k.alias("k"), step.alias("step"))
    # One row for each class and step, about 65,000 at most.
    counts = narrow.groupBy(F.when(F.col("k") <= CLASSES, F.col("k")).otherwise(-1).alias("k"), "step").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    steps = filler_steps([(r["k"], r["step"], r["n"]) for r in counts if r["k"] > 0], sum(r["t"] for r in counts if r["k"] != 0), capacity)
    shares = max(1, -(-sum(r["n"] for r in counts) // SHARE))
    classed = narrow.where((F.col("k") == 0) | ((F.col("k") <= CLASSES) & (F.col("step") >= steps))).withColumn("share", F.pmod(mark("share"), F.lit(shares)))
    sizes = classed.groupBy("k", "share").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("bins", F.floor(F.col("n") / F.greatest("k", F.lit(1)))).withColumn("order", F.struct((F.col("k") == 0).alias("whole"), "k", "share"))
    sizes = materialize(_before(sizes, "order", "bins", "first").drop("order"), "shares")
    bins = sizes.where("k > 0").agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("b")).first()["b"]
    group = Window.partitionBy("k", "share")
    ranked = classed.withColumn("rank", F.row_number().over(group.orderBy("uid")) - 1).withColumn("n", F.count("*").over(group))
    each = F.greatest("k", F.lit(1))
    ranked = ranked.withColumn("bin", F.when(F.col("rank") < F.col("n") - F.col("n") % each, F.floor(F.col("rank") / each)))
    slot = Window.partitionBy("k", "share", "bin").orderBy("rank")
    table = ranked.withColumn("offset", F.coalesce(F.sum("length").over(slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = table.withColumn("gap", F.lit(capacity) - F.sum("length").over(Window.partitionBy("k", "share", "bin")))
    spot = sizes.select("k", "share", "first")
    table = table.join(bounded_broadcast(spot), ["k", "share"]).withColumn("sequence_id", F.col("first") + F.col("bin"))
    table = materialize(table.select("uid", "k", "sequence_id", "offset", "gap"), "placed")
    gaps = table.where("k > 0 and sequence_id is not null and offset = 0 and gap > 0").select("sequence_id", "gap")
    room = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("g")).first()["g"]
    fixed = table.where("sequence_id is not null")
    fillers = materialize(narrow.where("k > 0").join(fixed.select("uid"), "uid", "left_anti").select("uid", "length"), "fillers")
    total = fillers.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()["t"]
    extra = max(0, -(-(total - room) // capacity))
    columns = [*PIECE, *["ids"] * with_ids]
    after = F.col("sequence_id") + F.when(F.col("k") == 0, F.lit(extra)).otherwise(F.lit(0))
    whole = pieces.join(fixed, "uid").select(*columns, after.alias("sequence_id"), "offset")
    cuts = _fill_cuts(fillers, gaps, bins, room, capacity)
    cuts = cuts.groupBy("uid").agg(F.collect_list(F.struct("inner", "length", "sequence_id", "offset")).alias("cuts"))  # one piece's cuts: at most its length
    torn = pieces.join(cuts, "uid").select("doc_id", "start", "doc_tokens", "ids", "cuts")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    torn = by_batches(torn, _cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long")
    return whole.unionByName(torn.select(whole.columns))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as little-endian uint32 with with_ids).

    Null text counts as empty: such a document has its end id alone. Rows that repeat a
    document are packed each. A sequence is padded to the capacity unless its length is a
    power of two; only the last one may be. An empty table gives no rows.
    """
    pieces = pieces_of(docs, tokenizer_path, id_col, text_col, capacity, with_ids=with_ids)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    free_shuffles(docs.sparkSession)
    return pack(pieces, capacity, with_ids)
