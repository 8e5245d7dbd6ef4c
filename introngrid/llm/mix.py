"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.storage import bounded_broadcast, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one step of the reduction tree rounds together.
FAN_IN = 128
SEED = 1729
#: A source whose words miss the target by more than this share of it lets settled documents trade once more.
NEAR = 0.07
#: Of each source, direction and power of two of the size so many documents may trade; the SHORTEST of all do it in every combination.
TRADERS, SHORTEST = 4, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Rows (source, source_size, n, target): the fill level at which capped shares add up to all sizes.

    Sources by code point, null last, take the weights in turn. A share stops at cap times
    its source's size and what is over goes to the others by weight. The windows run over
    one row per source, never over documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ring = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.element_at(ring, ((rank - 1) % len(weights) + 1).cast("int"))).withColumn(
        "top", F.col("source_size") * F.lit(float(cap))
    )
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.max(F.when(F.col("top") / F.col("w") >= F.col("level"), F.col("level"))).over(everything)
    return by.select("source", "source_size", "n", F.least(F.col("top"), level * F.col("w")).alias("target"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _draw(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _with_x(item: Column, x: Column) -> Column:
    return item.withField("x", x)


def _pivot(acc: Column, item: Column, level: int, seed: int) -> Column:
    """One step: carry and item trade mass until one of them is integral; sizes keep the sum of words."""
    carry, out = acc["carry"], acc["out"]
    ratio = item["a"] / carry["a"]
    room = F.struct(
        F.least(1 - carry["x"], item["x"] * ratio).alias("up"),
        F.least(carry["x"], (1 - item["x"]) * ratio).alias("down"),
        _draw(carry["h"], item["h"], F.lit(level), F.lit(seed)).alias("u"),
    )

    def trade(r: Column) -> Column:
        up = r["u"] * (r["up"] + r["down"]) < r["down"]
        cx = F.when(
            up, F.when(r["up"] >= 1 - carry["x"], F.lit(1.0)).otherwise(carry["x"] + r["up"])
        ).otherwise(F.when(r["down"] >= carry["x"], F.lit(0.0)).otherwise(carry["x"] - r["down"]))
        ix = F.when(
            up, F.when(r["up"] >= 1 - carry["x"], item["x"] - r["up"] / ratio).otherwise(F.lit(0.0))
        ).otherwise(F.when(r["down"] >= carry["x"], item["x"] + r["down"] / ratio).otherwise(F.lit(1.0)))
        snapped = F.struct(cx.alias("c"), F.least(F.greatest(ix, F.lit(0.0)), F.lit(1.0)).alias("i"))

        def settle(s: Column) -> Column:
            first, second = _with_x(carry, s["c"]), _with_x(item, s["i"])
            done = (s["c"] <= 0) | (s["c"] >= 1)
            return F.struct(
                F.when(done, second).otherwise(first).alias("carry"),
                F.concat(out, F.array(F.when(done, first).otherwise(second))).alias("out"),
            )

        return _let(snapped, settle)

    settled = (carry["x"] <= 0) | (carry["x"] >= 1)
    return (
        F.when(carry.isNull(), F.struct(item.alias("carry"), out.alias("out")))
        .when(settled, F.struct(item.alias("carry"), F.concat(out, F.array(carry)).alias("out")))
        .otherwise(_let(room, trade))
    )


def _flips(left: Column, slack: Column, traders: Column, seed: int) -> Column:
    """The traders (by falling size; each has h, d = the words its flip adds) whose flips bring `left` within slack of 0, or as near as they can.

    Those before the last SHORTEST flip one by one if that helps; the last ones do in one of all their combinations:
    of those within the slack one with the fewest flips, drawn by a hash, so that no document is always the one that gives way.
    """
    n = F.size(traders)
    cut = F.greatest(n - SHORTEST, F.lit(0))
    kind = "array<int>"
    start = F.struct(left.alias("r"), F.array().cast(kind).alias("at"))

    def flipped(s: Column, i: Column) -> Column:
        return F.struct((s["r"] - F.get(traders, i)["d"]).alias("r"), F.concat(s["at"], F.array(i)).alias("at"))

    def greedy(acc: Column, i: Column) -> Column:
        helps = (F.abs(acc["r"]) > slack) & (F.abs(acc["r"] - F.get(traders, i)["d"]) < F.abs(acc["r"]))
        return F.when(helps, flipped(acc, i)).otherwise(acc)

    def rated(s: Column) -> Column:
        draw = F.aggregate(s["at"], F.lit(seed).cast("long"), lambda acc, i: F.xxhash64(acc, F.get(traders, i)["h"]))
        return F.struct(F.greatest(F.abs(s["r"]) - slack, F.lit(0.0)).alias("over"), F.size(s["at"]).alias("many"), draw.alias("draw"), s["at"].alias("at"))

    def best(first: Column) -> Column:
        last = F.when(n > cut, F.sequence(cut, n - 1)).otherwise(F.array().cast(kind))
        subsets = F.aggregate(last, F.array(first), lambda acc, i: F.concat(acc, F.transform(acc, lambda s: flipped(s, i))))
        return F.array_min(F.transform(subsets, rated))["at"]

    long_ones = F.when(cut > 0, F.sequence(F.lit(0), cut - 1)).otherwise(F.array().cast(kind))
    return F.transform(_let(F.aggregate(long_ones, start, greedy), best), lambda i: F.get(traders, i))


def _settle_rest(rounded: DataFrame, rest: DataFrame, seed: int) -> DataFrame:
    """rounded (source, item) with some x flipped in the sources of rest (source, slack, left: words still to take, or below 0 taken too many)."""
    rest = materialize(rest, "mixrest")
    if not rest.limit(1).count():
        return rounded
    mine = rounded.join(bounded_broadcast(rest.select(F.col("source").alias("__source"), "left", "slack")), F.col("source").eqNullSafe(F.col("__source")))
    mine = mine.select("source", "left", "slack", "item.doc_id", "item.size", "item.h", "item.a", F.when(F.col("item.x") > 0.5, -F.col("item.a")).otherwise(F.col("item.a")).alias("d"))
    some = Window.partitionBy("source", F.signum("d"), F.floor(F.log2("a"))).orderBy("h", "doc_id", "size")
    mine = mine.withColumn("k", F.row_number().over(some)).where(F.col("k") <= TRADERS)
    trader = F.struct((-F.col("a")).alias("order"), "h", "doc_id", "size", "d")
    groups = mine.groupBy("source", "left", "slack").agg(F.array_sort(F.collect_list(trader)).alias("traders"))
    flips = groups.select("source", F.explode(_flips(F.col("left"), F.col("slack"), F.col("traders"), seed)).alias("f"))
    flips = materialize(flips.select(F.col("source").alias("__source"), F.col("f.doc_id").alias("__doc"), F.col("f.size").alias("__size"), F.lit(True).alias("__flip")), "mixflips")
    same = F.col("source").eqNullSafe(F.col("__source")) & F.col("item.doc_id").eqNullSafe(F.col("__doc")) & (F.col("item.size") == F.col("__size"))
    told = rounded.join(bounded_broadcast(flips), same, "left")
    return told.select("source", F.when(F.col("__flip"), _with_x(F.col("item"), 1 - F.col("item.x"))).otherwise(F.col("item")).alias("item"))


def _round_all(items: DataFrame, n_max: int, seed: int) -> DataFrame:
    """items (source, n, target, item struct) with every item.x rounded to 0 or 1 by a tree of small folds."""
    kind = items.schema["item"].dataType.simpleString()
    done, level, chunks = [], 0, n_max
    while True:
        chunks = -(-chunks // FAN_IN)
        width = F.ceil(F.col("n") / F.lit(float(FAN_IN ** (level + 1)))).cast("long")
        chunk = F.pmod(F.xxhash64("item.h", F.lit(level), F.lit(seed)), F.greatest(width, F.lit(1)))
        start = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("out"))
        folded = (
            items.withColumn("chunk", chunk)
            .groupBy("source", "n", "target", "chunk")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select("source", "n", "target", F.aggregate("items", start, lambda acc, it: _pivot(acc, it, level, seed)).alias("f"))
        )
        folded = materialize(folded, f"mix{level}")
        settled = (F.col("f.carry.x") <= 0) | (F.col("f.carry.x") >= 1)
        done.append(folded.select("source", F.explode("f.out").alias("item")))
        done.append(folded.where(settled).select("source", F.col("f.carry").alias("item")))
        items = folded.where(~settled).select("source", "n", "target", F.col("f.carry").alias("item"))
        level += 1
        if chunks <= 1:
            break
    # At most one document of a source is left: it is drawn by its probability, and settled ones may take over the words it leaves.
    coin = F.when(_draw(F.col("item.h"), F.lit(-1), F.lit(seed)) < F.col("item.x"), F.lit(1.0)).otherwise(F.lit(0.0))
    done.append(items.select("source", _with_x(F.col("item"), coin).alias("item")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    left = F.col("item.a") * (F.col("item.x") - coin)
    slack = F.lit(NEAR) * F.col("target")
    return _settle_rest(out, items.select("source", left.alias("left"), slack.alias("slack")).where(F.abs("left") > F.col("slack")), seed)


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), cap: float = 3.0, seed: int = SEED
) -> DataFrame:
    """One row per distinct (doc_id, source, size): m rows of it, base copies of each and extra copies for all.

    A source wants target / source_size copies of each document. The whole part is sure;
    the fractions are rounded by the pivotal method with the documents' sizes as weights,
    so a source's words miss the target by less than one document. Where that is over NEAR of
    the target (small sources), as few settled documents as it takes flip to come within it, or
    as near as they can; documents' expected shares hold but for these flips. Folds of about FAN_IN
    documents, dealt by hash inside each source, each leave one unsettled document, and
    those meet in the next level of the tree. Draws hash the documents, so reruns agree.

    Null text has size 0, null sources form one source, documents without words are
    taken 0 times their size. m equal rows share base * m + extra copies. Empty in, empty out.
    """
    sizes = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")),
        "sizes",
    )
    stats = materialize(source_targets(sizes.withColumn("size", F.col("size") * F.col("m")), weights, cap), "targets")
    n_max = stats.agg(F.max("n")).first()[0] or 1
    small = bounded_broadcast(stats.select(F.col("source").alias("__source"), "source_size", "n", "target"))
    joined = sizes.join(small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    near = lambda c: F.when(F.abs(c - F.round(c)) < 1e-9, F.round(c)).otherwise(c)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("share", near(share)).withColumn("base", F.floor("share"))
    joined = joined.withColumn("mass", near((F.col("share") - F.col("base")) * F.col("m"))).withColumn("sure", F.floor("mass"))
    # Long documents come first in a fold: the short ones behind them take up the slack, so what is left over is short.
    item = F.struct(
        (-F.col("size")).alias("order"),
        F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("h"), F.col("size").cast("double").alias("a"), (F.col("mass") - F.col("sure")).alias("x"),
        "doc_id", "size", "m", "base", "sure",
    )
    ready = joined.select("source", "n", "target", item.alias("item"))
    open_ = (F.col("item.x") > 0) & (F.col("item.a") > 0)
    still = ready.where(~open_).select("source", _with_x(F.col("item"), F.lit(0.0)).alias("item"))
    rounded = _round_all(ready.where(open_), n_max, seed).union(still)
    return (
        rounded.select("source", "item.*")
        .withColumn("extra", F.col("sure") + F.col("x").cast("long"))
        .join(small, F.col("source").eqNullSafe(F.col("__source")))
        .select("doc_id", "source", "size", "m", F.col("base").cast("long").alias("base"), "extra", "source_size", "target")
    )


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    plan = plan_mix(docs, **options)
    rows = plan.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("k"))
    copies = F.col("base") + (F.col("k") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as many times as the mix takes it, in the columns of docs."""
    plan = materialize(plan_mix(docs, id_col, text_col, source_col, **options), "mixplan")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__src"), F.col("size").alias("__size"), F.col("m").alias("__m"), F.col("base").alias("__base"), F.col("extra").alias("__extra"))
    # The plan has a row for every document, so it is never broadcast.
    wide = docs.join(
        plan.hint("merge"),
        docs[id_col].eqNullSafe(F.col("__id")) & docs[source_col].cast("string").eqNullSafe(F.col("__src")) & (word_count(docs[text_col]) == F.col("__size")),
    )
    times = lambda extra: F.explode(F.array_repeat(F.lit(1), (F.col("__base") + extra).cast("int"))).alias("__one")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = wide.where("__m = 1").select(*names, times(F.col("__extra")))
    if plan.where("__m > 1").limit(1).count():
        order = F.row_number().over(Window.partitionBy("__id", "__src", "__size").orderBy(F.xxhash64(F.col(text_col))))
        out = out.union(wide.where("__m > 1").withColumn("__k", order).select(*names, times((F.col("__k") <= F.col("__extra")).cast("long"))))
    return out.drop("__one")
