"""Running values, ranks and exact quantiles over keys of any size: range partitions work side by side and hand on one value each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.storage import materialize, shares

#: A fold of a column, and of two of its results (nulls are passed over).
FOLDS = {"sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def ordering(order, reverse: bool = False) -> list[Column]:
    """Sort columns of names; a name that begins with - falls."""
    return [(F.desc if c.startswith("-") != reverse else F.asc)(c.removeprefix("-")) for c in order]


class Ranges:
    """The rows of df, written in range partitions of (keys, order); a key may span any number of them.

    Rows that are equal in all of these are told apart by a running number, so many of them
    split as well. Nulls of keys are a key; nulls in the order come first. There are as many
    ranges as the input asks for (storage.shares), so a range doesn't grow with it.
    """

    def __init__(self, df: DataFrame, keys, order, ranges: int | None = None):
        self.keys, self.order = list(keys), [*order, "__tie"]
        by = [*map(F.asc, self.keys), *ordering(self.order)]
        self.ranges = ranges = ranges or shares(df)
        tied = df.withColumn("__tie", F.monotonically_increasing_id())
        spread = tied.repartitionByRange(ranges, *by) if ranges else tied.repartitionByRange(*by)
        self.rows = materialize(spread.withColumn("__part", F.spark_partition_id()), "ranges")

    def _together(self, rows: DataFrame) -> DataFrame:
        """self.rows with a partition's rows of a key together, in as many tasks as there are ranges; other rows come from such ones."""
        return rows.repartition(self.ranges, "__part", *self.keys) if self.ranges and rows is self.rows else rows

    def running(self, rows: DataFrame, value: Column | str, out: str, how: str = "sum", reverse: bool = False, exclusive: bool = False) -> DataFrame:
        """rows (self.rows, perhaps with more columns) with the fold of value over the key's rows up to here, or from here on with reverse; exclusive leaves out the row itself.

        What a partition hands on is one value for each of its keys. Only a key that began in
        another partition takes one over, and a partition has one such key at most: so there
        are no more of these rows than partitions, and they are broadcast.
        """
        fold, join = FOLDS[how]
        given, rows = self._together(rows), rows.withColumn("__v", F.col(value) if isinstance(value, str) else value)
        parts = rows.groupBy("__part", *self.keys).agg(fold("__v").alias("__t"))
        earlier = Window.partitionBy(*self.keys).orderBy(F.desc("__part") if reverse else F.asc("__part"))
        first = F.row_number().over(earlier) == 1
        carried = parts.withColumn("__c", fold("__t").over(earlier.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__first", first).where("NOT __first AND __c IS NOT NULL")
        names = {k: f"__key{i}" for i, k in enumerate(self.keys)}
        carried = carried.select(F.col("__part").alias("__from"), *[F.col(k).alias(n) for k, n in names.items()], "__c")
        inside = Window.partitionBy("__part", *self.keys).orderBy(*ordering(self.order, reverse)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        local = given.withColumn("__v", F.col(value) if isinstance(value, str) else value).withColumn("__l", fold("__v").over(inside))
        same = F.col("__part") == F.col("__from")
        for k, n in names.items():
            same &= F.col(k).eqNullSafe(F.col(n))
        met = local.join(F.broadcast(carried), same, "left")
        return met.withColumn(out, join(F.col("__l"), F.col("__c"))).drop("__v", "__l", "__c", "__from", *names.values())

    def counts(self, counted: Column, rank: str, total: str) -> DataFrame:
        """self.rows with the number of counted rows of the key up to here, and of all of the key.

        Both come from one window over a key's rows in a partition and one sum for each key
        and partition. Only keys that lie in several partitions take something over: a
        partition has two such keys at most, so these rows are broadcast as well.
        """
        rows = self.rows.withColumn("__v", counted.cast("long"))
        parts = rows.groupBy("__part", *self.keys).agg(F.sum("__v").alias("__t"))
        whole, earlier = Window.partitionBy(*self.keys), Window.partitionBy(*self.keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("*", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"), F.sum("__t").over(whole).alias("__all"), F.count("*").over(whole).alias("__parts")).where("__parts > 1")
        names = {k: f"__key{i}" for i, k in enumerate(self.keys)}
        shared = parts.select(F.col("__part").alias("__from"), *[F.col(k).alias(n) for k, n in names.items()], "__before", "__all")
        inside = Window.partitionBy("__part", *self.keys).orderBy(*ordering(self.order))
        local = self._together(self.rows).withColumn("__v", counted.cast("long")).select("*", F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__l"), F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__s"))
        same = F.col("__part") == F.col("__from")
        for k, n in names.items():
            same &= F.col(k).eqNullSafe(F.col(n))
        met = local.join(F.broadcast(shared), same, "left")
        out = met.withColumns({rank: F.col("__l") + F.coalesce("__before", F.lit(0)), total: F.coalesce("__all", "__s")})
        return out.drop("__v", "__l", "__s", "__before", "__all", "__from", *names.values())

    def close(self, rows: DataFrame) -> DataFrame:
        return rows.drop("__tie", "__part")


def mid_ranks(df: DataFrame, value: str, keys, out: str) -> DataFrame:
    """df with the rank of a value inside its key, equal values sharing the middle of theirs; null and NaN values rank like others, nulls first.

    Distinct values are counted first, so that many equal ones don't meet.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranges = Ranges(counts, keys, [value])
    ranked = ranges.close(ranges.running(ranges.rows, "__n", "__before", exclusive=True))
    ranked = ranked.select(*[F.col(k).alias(f"__m{i}") for i, k in enumerate([*keys, value])], (F.coalesce("__before", F.lit(0)) + (F.col("__n") + 1) / 2).alias(out))
    same = F.lit(True)
    for i, k in enumerate([*keys, value]):
        same &= F.col(k).eqNullSafe(F.col(f"__m{i}"))
    return df.join(ranked, same, "left").drop(*[f"__m{i}" for i in range(len(keys) + 1)])


def percentiles(df: DataFrame, value: str | Column, probs, keys=(), out: str = "quantiles") -> DataFrame:
    """Rows (keys, out): the exact percentiles of the non-null values of each key, linear between neighbours, as an array in the order of probs.

    A running count finds the two values beside each place; no list of a key's values is
    held. NaN is the greatest value. Keys without values have no row.
    """
    keys, probs = list(keys), [float(x) for x in probs]
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__x")).where("__x IS NOT NULL")
    ranges = Ranges(rows, keys, ["__x"])
    ranked = ranges.counts(F.lit(True), "__r", "__n").withColumn("__r", F.col("__r") - 1)
    place = F.transform(F.array(*map(F.lit, probs)), lambda p: p * (F.col("__n") - 1))
    wanted = F.exists(place, lambda x: (F.floor(x) == F.col("__r")) | (F.ceil(x) == F.col("__r")))
    found = ranked.where(wanted).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__x"))).alias("__at"), F.first("__n").alias("__n"))
    low, high = (lambda x: F.floor(x).cast("long")), (lambda x: F.ceil(x).cast("long"))
    between = F.transform(place, lambda x: F.when(low(x) == high(x), F.col("__at")[low(x)]).otherwise((high(x) - x) * F.col("__at")[low(x)] + (x - low(x)) * F.col("__at")[high(x)]))
    return found.select(*keys, between.alias(out))
