"""Interval islands, multiple testing and rank windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from introngrid.functions.scan import Ranges
from introngrid.storage import materialize, shares, spread


def islands(df: DataFrame, keys, start: str = "start", stop: str = "stop", ties=(), out: str = "island", touching: bool = True) -> DataFrame:
    """Number the runs of overlapping intervals inside each key, from 1 in order of start; for keys whose rows fit a task (transcripts, clusters)."""
    order = Window.partitionBy(*keys).orderBy(start, stop, *ties)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > before if touching else F.col(start) >= before
    return df.withColumn(out, F.sum(F.when(before.isNull() | apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _local_chains(keys: list[str], start: str, stop: str, touching: bool):
    """Of rows sorted by keys, start and stop: the partition, the chain's number in its key and partition, and its first start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, reach, chain, first = None, None, 0, None  # the last row's
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
            turns = np.zeros(n, bool)
            for code in codes:
                turns[1:] |= code[1:] != code[:-1]
            own = np.cumsum(turns)
            a, b = (batch.column(c).to_pandas() for c in (start, stop))
            began = [batch.column(k)[0].as_py() for k in keys]
            goes_on = began == key
            head = own == 0
            top = b.groupby(own).cummax().groupby(own).ffill()
            top, before = top.to_numpy(float, copy=True), top.groupby(own).shift().to_numpy(float, copy=True)
            if goes_on and reach is not None:
                top[head], before[head] = np.fmax(top[head], reach), np.fmax(before[head], reach)
            apart = (a > before) if touching else (a >= before)
            opens = np.isnan(before) | apart.to_numpy()
            number = pd.Series(opens.astype(np.int64)).groupby(own).cumsum().to_numpy()
            place = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
            starts = batch.column(start)
            if goes_on:
                number = number + np.where(head, chain, 0)
            firsts = starts.take(pa.array(np.maximum(place, 0)))
            if (place < 0).any():
                firsts = pc.if_else(pa.array(place < 0), pa.scalar(first, starts.type), firsts)
            key, chain, first = [batch.column(k)[n - 1].as_py() for k in keys], int(number[-1]), firsts[n - 1].as_py()
            reach = None if np.isnan(top[-1]) else top[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(number), firsts], names=[*batch.schema.names, "__part", "__chain", "__first"])

    return run


def _packed(keys: list[str], start: str, stop: str, most: int):
    """Rows of _local_chains() as one row for several of a chain: its keys, first start and farthest stop, and the list rows of what they had beside the keys.

    A row takes up to so many values, those in lists counted too, so one is never much larger than a batch of unpacked rows.
    """
    told = ["__part", "__chain", "__first"]

    def turns_of(table: pa.Table) -> np.ndarray:
        turns = np.zeros(table.num_rows, bool)
        turns[0] = True
        for name in (*keys, "__chain"):
            code = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            turns[1:] |= code[1:] != code[:-1]
        return turns

    def weight_of(table: pa.Table) -> np.ndarray:
        weight = np.ones(table.num_rows, np.int64)
        for column in table.columns:
            if pa.types.is_list(column.type):
                weight += pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        return weight

    def pack(table: pa.Table, turns: np.ndarray) -> Iterator[pa.RecordBatch]:
        weight = weight_of(table)
        before = np.cumsum(weight) - weight
        first = np.maximum.accumulate(np.where(turns, np.arange(table.num_rows), 0))
        piece = (before - before[first]) // most
        heads = np.flatnonzero(turns | (piece != np.append(0, piece[:-1])))
        ends = np.append(heads, table.num_rows)
        owner = pa.array(np.repeat(np.arange(len(heads)), np.diff(ends)))
        far = pa.table({"at": owner, "x": table.column(stop)}).group_by("at", use_threads=False).aggregate([("x", "max")]).column("x_max")
        names = [c for c in table.column_names if c not in (*keys, *told)]
        each = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in names], names)
        firsts = table.select([*keys, start, *told]).take(pa.array(heads))
        out = firsts.select([*keys, start]).append_column(stop, far).append_column("rows", pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each))
        for name in told:
            out = out.append_column(name, firsts.column(name))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last chain so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            turns = turns_of(table)
            last = int(np.flatnonzero(turns)[-1])
            held = table.slice(last)
            whole = last
            if weight_of(held).sum() >= most:
                held, whole = None, table.num_rows
            if whole:
                yield from pack(table.slice(0, whole), turns[:whole])
        if held is not None:
            yield from pack(held, np.arange(held.num_rows) == 0)

    return run


def wide_islands(df: DataFrame, keys, start: str = "start", stop: str = "stop", ties=(), out: str = "island", touching: bool = True, ranges: int | None = None, dealt: bool = False, most: int | None = None, first=None) -> DataFrame:
    """islands() for keys of any size, such as chromosomes: range partitions of a key are worked on side by side.

    Rows move once and are numbered where they lie, as if nothing reached in from before.
    What the partitions before a key's next one hand on is their farthest stop and their
    number of chains; chains that begin within that reach go with the last one of these. Only keys
    that lie in several partitions have such a row, and a partition has two such keys at most.
    Rows that are dealt lie in such ranges already, perhaps by the first keys, start and stop alone, and stay there.
    With most, rows of a chain that lie together are packed, up to so many values in one: keys, first start, farthest stop, the list rows of them, and out.
    first is work on the sorted rows' Arrow batches that keeps their number, order and columns.
    """
    keys = list(keys)
    by = [*keys, start, stop, *ties]
    wanted = None if dealt else ranges or shares(df)
    tied, tie = (df, []) if ties else (df.withColumn("__tie", F.monotonically_increasing_id()), ["__tie"])  # many equal rows split
    moved = tied if dealt else tied.repartitionByRange(wanted, *by, *tie) if wanted else tied.repartitionByRange(*by, *tie)
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__chain", LongType()), StructField("__first", df.schema[start].dataType)])
    steps, columns = [*([first] if first else []), _local_chains(keys, start, stop, touching)], df.columns
    if most:
        steps, fields = [*steps, _packed(keys, start, stop, most)], {f.name: f for f in schema}
        each = StructType([f for f in df.schema if f.name not in keys])
        columns = [*keys, start, stop, "rows"]
        schema = StructType([*[fields[c] for c in columns[:-1]], StructField("rows", ArrayType(each)), *schema.fields[-3:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    rows = materialize(moved.sortWithinPartitions(*by, *tie).select(*df.columns).mapInArrow(work, schema), "islands")
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__part", *keys).agg(F.max(stop).alias("__top"), F.max("__chain").alias("__chains"))
    ends = ends.select("*", F.max("__top").over(earlier).alias("__reach"), F.count("*").over(whole).alias("__parts")).where("__parts > 1")
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    ends = materialize(ends.select(F.col("__part").alias("__at"), *[F.col(k).alias(n) for k, n in names.items()], "__chains", "__reach"), "island-ends")
    same = F.col("__part") == F.col("__at")
    for k, n in names.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    inside = F.col("__first").isNull() | ((F.col("__first") <= F.col("__reach")) if touching else (F.col("__first") < F.col("__reach")))
    met = rows.join(F.broadcast(ends.where("__reach IS NOT NULL")), same).where(inside).groupBy("__at", *names.values()).agg(F.max("__chain").alias("__joined"))
    again = {n: f"{n}_" for n in names.values()}
    met = met.withColumnsRenamed(again | {"__at": "__at_"})
    equal = F.col("__at") == F.col("__at_")
    for n, m in again.items():
        equal &= F.col(n).eqNullSafe(F.col(m))
    over = Window.partitionBy(*names.values()).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    told = ends.join(F.broadcast(met), equal, "left").withColumn("__joined", F.coalesce("__joined", F.lit(0)))
    told = told.withColumn("__before", F.coalesce(F.sum(F.col("__chains") - F.col("__joined")).over(over), F.lit(0))).select("__at", *names.values(), "__joined", "__before")
    moved = rows.join(F.broadcast(told), same, "left")
    number = F.coalesce("__before", F.lit(0)) + F.greatest(F.col("__chain") - F.coalesce("__joined", F.lit(0)), F.lit(0))
    return moved.select(*columns, number.alias(out))


def merge_intervals(df: DataFrame, keys, start: str = "start", stop: str = "stop") -> DataFrame:
    """Overlapping or touching intervals of a key, of any size, become one."""
    marked = wide_islands(df.select(*keys, start, stop), keys, start, stop, out="__island")
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__island")


def bh(df: DataFrame, p: str, keys=(), ties=(), out: str = "fdr", ranges: int | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted values inside each key; null p-values stay null and don't count.

    Keys may have any number of rows: ranks are running counts over range partitions, and
    the least scaled value from here on is carried back through them. Equal p-values get
    one value whatever their order, so ties only names columns for a stable order.
    """
    tiles = Ranges(df, keys, [p, *ties], ranges)
    counted = tiles.counts(F.col(p).isNotNull(), "__rank", "__n")
    scaled = counted.withColumn("__q", F.when(F.col(p).isNotNull(), F.col(p) * F.col("__n") / F.col("__rank")))
    least = tiles.running(scaled, "__q", "__least", how="min", reverse=True)
    return tiles.close(least).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "__least"))).drop("__rank", "__n", "__q", "__least")


def simes(df: DataFrame, p: str, keys, out: str = "p_value", n: str = "n_features", extra=(), wide: bool = False, ranges: int | None = None) -> DataFrame:
    """Simes p-value of each key's non-null p-values, with their number.

    A key's rows are ranked in one task; with wide, for keys of any size, over range partitions.
    """
    rows = df.where(F.col(p).isNotNull())
    rows = rows if extra else rows.select(*keys, p)
    if wide:
        ranked = Ranges(rows, keys, [p], ranges).counts(F.lit(True), "__rank", "__n")
    else:
        part = Window.partitionBy(*keys).orderBy(p)
        ranked = spread(rows, *keys).withColumns({"__rank": F.row_number().over(part), "__n": F.count("*").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    scaled = ranked.withColumn("__s", F.col(p) * F.col("__n") / F.col("__rank"))
    return scaled.groupBy(*keys).agg(F.least(F.lit(1.0), F.min("__s")).alias(out), F.count("*").alias(n), *extra)


def unique_or_null(name: str) -> Column:
    """The only value of a group, or null if it has several."""
    return F.when(F.countDistinct(name) == 1, F.first(name, ignorenulls=True))


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)
