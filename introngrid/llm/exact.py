"""Exact de-duplication by content-defined chunk recipes (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.storage import materialize, release

#: A chunk has 512 to 4,096 characters and ends at the first white space that follows one of these letters.
CHUNK_PATTERN = r"(?s).{512,4096}?(?<=[aeinorst]\s)|(?s).{1,4096}"


def chunks_of(text: Column) -> Column:
    """Content-defined chunks of a text, in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, n_same, text_sha256.

    Every text becomes a recipe, the ordered list of its chunks' identifiers. An
    identifier is a chunk's digest, verified by comparing the bytes: distinct
    (digest, chunk) pairs are gathered after a combine on the map side, and where two
    chunks share a digest each gets a number of its own. Texts are equal when their
    recipes are, so only short lists of numbers move, not documents.

    Null text counts as empty. Of equal texts the largest doc_id stays; a null doc_id is
    below any other. Rows that repeat both doc_id and text are all marked alike and n_same
    counts them. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = docs.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    # Distinct chunks: the first aggregation drops the copies before anything moves.
    known = chunks.select(digest(F.col("chunk")).alias("digest"), "chunk").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    clashes = materialize(known.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clashes")
    recipes = docs.select(
        "doc_id",
        F.sha2(F.col("text"), 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("text")), lambda c: digest(c)).alias("digests"),
    )
    plain = F.transform(F.col("digests"), lambda d: F.struct(d.alias("digest"), F.lit(0).alias("variant")))
    if not clashes.limit(1).count():
        named = recipes.select("doc_id", "text_sha256", plain.alias("recipe"))
    else:
        variants = known.join(clashes, "digest").select(
            "digest", "chunk", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")).alias("variant")
        )
        placed = (
            docs.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("text"))).alias("pos", "chunk"))
            .withColumn("digest", digest(F.col("chunk")))
            .join(variants, ["digest", "chunk"], "left")
            .dropDuplicates(["doc_id", "text_sha256", "pos"])
        )
        lists = placed.groupBy("doc_id", "text_sha256").agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("parts")
        )
        parts = F.transform(F.col("parts"), lambda p: F.struct(p["digest"].alias("digest"), p["variant"].alias("variant")))
        lists = lists.select(F.col("doc_id").alias("id2"), F.col("text_sha256").alias("sha2"), parts.alias("recipe"))
        empty = F.array().cast("array<struct<digest:bigint,variant:int>>")
        named = recipes.join(
            lists, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("text_sha256") == F.col("sha2")), "left"
        ).select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))
    named = materialize(named, "recipes")
    per_id = named.groupBy("recipe", "doc_id").agg(F.count("*").alias("n"))
    groups = materialize(
        per_id.groupBy("recipe")
        .agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
        .select("recipe", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.n").alias("n_keep")),
        "groups",
    )
    release(clashes)
    out = named.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.col("doc_id").eqNullSafe(keep)
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.when(kept, F.coalesce("n_keep", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("n_same"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep; of rows that repeat doc_id and text one stays."""
    groups = materialize(exact_groups(docs, id_col, text_col), "exact")
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct()
    same = lambda a, b: docs[id_col].eqNullSafe(F.col(a)) & (sha == F.col(b))
    left = docs.join(gone, same("__gone_id", "__gone_sha"), "left_anti")
    repeated = groups.where("kept and n_same > 1").select(F.col("doc_id").alias("__rep_id"), F.col("text_sha256").alias("__rep_sha")).distinct()
    if not repeated.limit(1).count():
        return left
    once = left.join(repeated, same("__rep_id", "__rep_sha"), "left_semi")
    once = once.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates([id_col, "__text"]).drop("__text")
    return left.join(repeated, same("__rep_id", "__rep_sha"), "left_anti").unionByName(once)
