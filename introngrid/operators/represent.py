"""Cell representations: loadings, embeddings, label transfer and agreement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from introngrid.functions.tiles import by_tiles, matrix
from introngrid.operators.annotation import dense_ids
from introngrid.schema import assert_no_conflict, assert_none, assert_unique
from introngrid.storage import materialize


def _over(*keys):
    return Window.partitionBy(*keys)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def align_metadata(cells: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """cells (cell_id, ...) with their label and group; two labels or groups for one cell are an error, cells without drop out."""
    unique = labels.select("cell_id", "label", "grp").distinct()
    if check:
        assert_no_conflict(unique, "cell_id", "label", "grp")
    return cells.join(unique.dropDuplicates(["cell_id"]), "cell_id")


def gene_loadings(left: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (gene_id, k, w): transcript loadings (tx_id, left) summed over each gene."""
    return left.join(genes, "tx_id").select("gene_id", F.posexplode("left").alias("k", "x")).groupBy("gene_id", "k").agg(F.sum("x").alias("w"))


def reconstruct_expression(cells: DataFrame, loadings: DataFrame, total: float = 10_000.0) -> DataFrame:
    """Rows (cell_id, gene_id, x): rectified products of cell factors (right) and gene loadings (left), scaled to `total` a cell, log1p.

    The product is made in tiles, twice: first for the cells' sums, of which a task hands on
    one number for each cell, then for the values, which are the result's rows. A cell whose sum is 0 has zeros.
    """
    cell, gene = cells.schema["cell_id"].dataType.simpleString(), loadings.schema["gene_id"].dataType.simpleString()

    def sums(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": c["cell_id"], "s": np.maximum(matrix(c["right"]) @ matrix(g["left"]).T, 0).sum(1)})

    def values(c: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        x, whole = np.maximum(matrix(c["right"]) @ matrix(g["left"]).T, 0), c["s"].to_numpy()[:, None]
        x = np.log1p(np.divide(x * total, whole, out=np.zeros_like(x), where=whole > 0))
        return pd.DataFrame({"cell_id": np.repeat(c["cell_id"].to_numpy(), len(g)), "gene_id": np.tile(g["gene_id"].to_numpy(), len(c)), "x": x.ravel()})

    cells, loadings = cells.select("cell_id", "right"), loadings.select("gene_id", "left")
    whole = by_tiles(cells, loadings, sums, f"cell_id {cell}, s double").groupBy("cell_id").agg(F.sum("s").alias("s"))
    return by_tiles(materialize(cells.join(whole, "cell_id"), "cell-sums"), loadings, values, f"cell_id {cell}, gene_id {gene}, x double")


def gene_moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene_id").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"))


def select_hvg(moments: DataFrame, n: int, least: float = 1e-8, check: bool = True) -> DataFrame:
    """The n genes of largest variance; it is an error if their variance relative to the squared mean is no more than `least`."""
    best = moments.orderBy(F.desc("variance"), "gene_id").limit(n)
    if check:
        assert_none(best.agg(F.max(F.col("variance") / F.greatest(F.col("mean") ** 2, F.lit(1e-300))).alias("r")).where(F.col("r") <= least), "the representation has collapsed")
    return best


def pca_embedding(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """Rows (cell_id, pc array) of standardised gene values (cell_id, features array), and the explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select("cell_id", array_to_vector("features").alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(data).transform(data)
    model = PCA(k=k, inputCol="s", outputCol="p").fit(scaled)
    return model.transform(scaled).select("cell_id", vector_to_array("p").alias("pc")), model.explainedVariance.toArray().tolist()


def log_gene_features(counts: DataFrame, min_share: float) -> DataFrame:
    """Rows (cell_id, features): log1p of counts (cell_id, gene_id, n) per 10,000, for genes in at least min_share of cells, in gene order.

    Genes are numbered by range; a cell's counts meet and are laid out where they lie, so there is no row for a zero.
    """
    kind = counts.schema["cell_id"].dataType.simpleString()
    cells = counts.select("cell_id").distinct()
    n_cells = cells.agg(F.count("*").alias("all"))
    genes = counts.where("n > 0").groupBy("gene_id").agg(F.countDistinct("cell_id").alias("c")).crossJoin(F.broadcast(n_cells)).where(F.col("c") >= min_share * F.col("all")).select("gene_id")
    ids = materialize(dense_ids(genes, "gene_id", "i"), "gene-ids")
    size = ids.count()
    norm = counts.withColumn("x", F.log1p(F.col("n") * 10_000.0 / F.nullif(F.sum("n").over(_over("cell_id")), F.lit(0)))).select("cell_id", "gene_id", "x")
    sparse = norm.join(ids, "gene_id").groupBy("cell_id").agg(F.collect_list("i").alias("i"), F.collect_list(F.coalesce("x", F.lit(0.0))).alias("x"))

    def lay_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = np.zeros((len(frame), size))
            for k, (at, x) in enumerate(zip(frame["i"], frame["x"], strict=True)):
                if at is not None:
                    np.add.at(rows[k], np.asarray(at, dtype=np.int64), np.asarray(x, dtype=float))
            yield pd.DataFrame({"cell_id": frame["cell_id"].array, "features": list(rows)})

    return cells.join(sparse, "cell_id", "left").select("cell_id", "i", "x").mapInPandas(lay_out, f"cell_id {kind}, features array<double>")


def log_gene_pca(counts: DataFrame, k: int, min_share: float = 0.01) -> tuple[DataFrame, list[float]]:
    return pca_embedding(log_gene_features(counts, min_share), k)


def factor_transform(cells: DataFrame, kind: str) -> DataFrame:
    """cells (cell_id, right) raw, as shares of the row (l1) or log1p of 10,000 shares; inactive rows (sum 0) are flagged."""
    total = F.aggregate("right", F.lit(0.0), lambda s, x: s + x)
    out = cells.withColumn("active", total > 0)
    if kind == "raw":
        return out
    share = F.transform("right", lambda x: x / F.nullif(total, F.lit(0.0)))
    share = F.when(F.col("active"), share).otherwise(F.transform("right", lambda x: F.lit(0.0)))
    return out.withColumn("right", share if kind == "l1" else F.transform(share, lambda x: F.log1p(x * 10_000)))


def profile_diagnostics(cells: DataFrame, loadings: DataFrame, top: int) -> DataFrame:
    """One row: relative variance of the normalised profile over the features of largest loading norm, active share, finite and norm checks."""
    norm = F.sqrt(dot("left", "left"))
    best = loadings.orderBy(F.desc(norm), "gene_id").limit(top)
    x = cells.crossJoin(F.broadcast(best)).select("cell_id", "gene_id", F.greatest(dot("right", "left"), F.lit(0.0)).alias("x"))
    x = x.withColumn("t", F.sum("x").over(_over("cell_id"))).withColumn("p", F.coalesce(F.col("x") / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0)))
    spread = x.groupBy("gene_id").agg(F.avg("p").alias("m"), F.var_pop("p").alias("v")).agg((F.sum("v") / F.nullif(F.sum(F.col("m") ** 2), F.lit(0.0))).alias("relative_variance"))
    active = x.groupBy("cell_id").agg(F.max("t").alias("t")).agg(F.avg((F.col("t") > 0).cast("double")).alias("active"))
    finite = cells.agg(F.bool_and(~F.exists("right", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).alias("finite"), F.avg(F.sqrt(dot("right", "right"))).alias("mean_norm"))
    return spread.crossJoin(active).crossJoin(finite)


def grouped_folds(cells: DataFrame, k: int, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Rows (grp, fold): groups in folds, dealt in turn inside each group's commonest label, large ones first, equal ones by order (a seeded hash if None)."""
    labels = cells.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = labels.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.sum("n").alias("n"))
    rank = F.row_number().over(_over("label").orderBy(F.desc("n"), order if order is not None else F.xxhash64("grp", F.lit(seed)), "grp")) - 1
    return main.select("grp", (rank % k).cast("int").alias("fold"))


def label_metrics(pairs: DataFrame, keys=("fold",)) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 by keys, from rows (label, predicted)."""
    c = pairs.groupBy(*keys, "label", "predicted").agg(F.count("*").alias("n"))
    actual = c.groupBy(*keys, F.col("label").alias("name")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    told = c.groupBy(*keys, F.col("predicted").alias("name")).agg(F.sum("n").alias("p"))
    j = actual.join(told, [*keys, "name"], "full").na.fill(0, ["a", "hit", "p"])
    return j.groupBy(*keys).agg((F.sum("hit") / F.sum("a")).alias("accuracy"), F.avg(F.col("hit") / F.nullif(F.col("a"), F.lit(0))).alias("balanced_accuracy"), F.avg(2 * F.col("hit") / (F.col("a") + F.col("p"))).alias("macro_f1"))


def score_labels(cells: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Rows (fold, accuracy, balanced_accuracy, macro_f1) of held-out logistic regression on factors, balanced by label.

    cells has (cell_id, grp, label, right); groups never lie in two folds.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    data = materialize(cells.join(grouped_folds(cells, k, seed), "grp"), "folds").withColumn("v", array_to_vector("right"))
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    data = indexer.transform(data)
    told = None
    for fold in range(k):
        train = data.where(F.col("fold") != fold)
        weights = train.groupBy("label").agg((1 / F.count("*")).alias("w"))
        model = Pipeline(stages=[StandardScaler(inputCol="v", outputCol="s", withMean=True), LogisticRegression(featuresCol="s", labelCol="y", weightCol="w", predictionCol="yhat", maxIter=50, regParam=0.01)]).fit(train.join(F.broadcast(weights), "label"))
        part = IndexToString(inputCol="yhat", outputCol="predicted", labels=indexer.labels).transform(model.transform(data.where(F.col("fold") == fold))).select("fold", "label", "predicted")
        told = part if told is None else told.unionByName(part)
    return label_metrics(told)


def score_summary(folds: DataFrame, names=("accuracy", "balanced_accuracy", "macro_f1")) -> DataFrame:
    """One row: number of folds, and mean and sample standard deviation of each score over them (null with one fold)."""
    return folds.agg(F.count("*").alias("folds"), *[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def kmeans_clusters(cells: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Rows (cell_id, cluster) of k-means on the factors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = cells.withColumn("v", array_to_vector("right"))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(data).transform(data).drop("v")


def ari_nmi(pairs: DataFrame, a: str = "label", b: str = "cluster") -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two partitions."""
    c = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    n = F.col("n")
    cells = c.agg(F.sum(two(n)).alias("ij"), F.sum("n").alias("t"), F.sum(n * F.log(n)).alias("h"))
    margin = lambda k, s, h: c.groupBy(k).agg(F.sum("n").alias("n")).agg(F.sum(two(n)).alias(s), F.sum(n * F.log(n)).alias(h))
    row = cells.crossJoin(margin(a, "sa", "ha")).crossJoin(margin(b, "sb", "hb"))
    expected = F.col("sa") * F.col("sb") / two(F.col("t"))
    entropy = lambda h: F.log("t") - F.col(h) / F.col("t")
    mutual = F.log("t") + (F.col("h") - F.col("ha") - F.col("hb")) / F.col("t")
    return row.select(
        ((F.col("ij") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))).alias("ari"), (mutual / F.nullif((entropy("ha") + entropy("hb")) / 2, F.lit(0.0))).alias("nmi")
    )


def silhouette(cells: DataFrame, label: str = "label", sample: int | None = 10_000, seed: int = 0, order: Column | None = None) -> DataFrame:
    """One row: mean silhouette by Euclidean distance, over the first `sample` cells by order (a seeded hash if None), or over all with sample None.

    Cells meet cells in tiles; a task hands on one sum of distances for each cell and label of
    a tile. A cell alone in its label has silhouette 0, as in the usual definition; a null
    label is a label of its own, repeated cell ids are cells of their own.
    """
    chosen = cells.select("cell_id", F.col(label).cast("string").alias("l"), "right")
    chosen = chosen.orderBy(order if order is not None else F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(sample) if sample else chosen
    chosen = materialize(chosen.select("l", "right", F.monotonically_increasing_id().alias("row")), "silhouette")

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x["right"]), matrix(y["right"])
        d = np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))
        d[x["row"].to_numpy()[:, None] == y["row"].to_numpy()[None, :]] = 0.0
        codes, names = pd.factorize(y["l"], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        total = np.add.reduceat(d[:, order], np.searchsorted(codes[order], np.arange(len(names))), axis=1)
        names = np.array([None if pd.isna(n) else n for n in names], dtype=object)
        return pd.DataFrame({"row": np.repeat(x["row"].to_numpy(), len(names)), "own": np.repeat(x["l"].to_numpy(dtype=object), len(names)), "other": np.tile(names, len(x)), "d": total.ravel()})

    met = by_tiles(chosen, chosen, sums, "row long, own string, other string, d double").groupBy("row", "own", "other").agg(F.sum("d").alias("d"))
    sizes = chosen.groupBy(F.col("l").alias("name")).agg(F.count("*").alias("n"))
    same = F.col("own").eqNullSafe(F.col("other"))
    sized = met.join(sizes, F.col("other").eqNullSafe(F.col("name")))
    per = sized.groupBy("row").agg(F.max(F.when(same, F.col("n"))).alias("size"), F.max(F.when(same, F.col("d") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    most = F.greatest("a", "b")
    return per.agg(F.avg(F.when((F.col("size") > 1) & F.col("b").isNotNull() & (most > 0), (F.col("b") - F.col("a")) / most).otherwise(0.0)).alias("silhouette"))


def score_reference_embedding(embedding: DataFrame, mapping: DataFrame, labels: DataFrame, k: int = 3, check: bool = True) -> DataFrame:
    """Fold scores of an external embedding (name, right), mapped one to one to labelled cells (name, cell_id)."""
    if check:
        assert_unique(mapping, "name")
        assert_unique(mapping, "cell_id")
    return score_labels(embedding.join(mapping, "name").join(labels.select("cell_id", "grp", "label").distinct(), "cell_id"), k)


def als_factors(counts: DataFrame, rank: int, seed: int = 0, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors (cell_id, right) and (ec_id, left) of row-normalised counts, by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    rows = counts.select(F.col("cell_id").cast("int"), F.col("ec_id").cast("int"), (F.col("n") / F.nullif(F.sum("n").over(_over("cell_id")), F.lit(0))).cast("float").alias("x"))
    model = ALS(rank=rank, maxIter=rounds, seed=seed, nonnegative=True, userCol="cell_id", itemCol="ec_id", ratingCol="x").fit(rows)
    return model.userFactors.select(F.col("id").alias("cell_id"), F.col("features").cast("array<double>").alias("right")), model.itemFactors.select(F.col("id").alias("ec_id"), F.col("features").cast("array<double>").alias("left"))
