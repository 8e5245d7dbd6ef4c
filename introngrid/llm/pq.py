"""Near-duplicate embeddings by product quantisation over coarse inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.graph import connected_components, forest
from introngrid.storage import free_shuffles, materialize

#: Vectors that the index is fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: Where vectors have several lengths, each length's index is fitted on so many at least.
LEAST_SAMPLE = 1000
#: Vectors of one list on average, and members of one block of a list.
LIST, BLOCK = 1500, 1024
#: Lists that a vector is looked up in, at most; subspaces; codes of a subspace.
PROBES, PARTS, CODES = 3, 8, 64
#: Slack of the quantised squared distance, in units of the codes' mean squared error.
SLACK = 3.0


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres, 1)[0][:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centres of each row, nearest first, with squared distances."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    k = min(k, len(centres))
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(k), (len(x), 1))
    near = np.take_along_axis(d, at, 1)
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Index:
    """Coarse centres and residual codebooks, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = sample.astype(np.float32)
        self.dim = sample.shape[1]
        lists = int(min(max(1, -(-total // LIST)), max(1, len(sample) // 8), 4096))
        self.coarse = _kmeans(sample, lists, 8, rng)
        residual = sample - self.coarse[_nearest(sample, self.coarse, 1)[0][:, 0]]
        self.edges = np.linspace(0, self.dim, min(PARTS, self.dim) + 1).astype(int)
        self.books = [_kmeans(residual[:, a:b], CODES, 8, rng) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        coded = self.decode(self.encode(residual))
        self.error = float(((residual - coded) ** 2).sum(1).mean())

    def encode(self, residual: np.ndarray) -> np.ndarray:
        parts = zip(self.edges[:-1], self.edges[1:], self.books, strict=True)
        return np.stack([_nearest(residual[:, a:b], book, 1)[0][:, 0] for a, b, book in parts], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances from each query's residual to all codes, by subspace."""
        parts = zip(self.edges[:-1], self.edges[1:], self.books, strict=True)
        return [((residual[:, None, a:b] - book[None]) ** 2).sum(2) for a, b, book in parts]


def _assign(indexes: dict[int, tuple[Index, int]], threshold: float):
    """Rows of the lists: each vector once in its own list, and as a query in the others it may have links to."""
    reach = 2 * np.sqrt(2 - 2 * threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole, dim in ((f, d) for f in frames for d in f["dim"].unique()):
            frame, (index, base) = whole[whole["dim"] == dim], indexes[int(dim)]
            for k in range(0, len(frame), 4096):
                part = frame.iloc[k : k + 4096]
                raw = np.stack([np.frombuffer(v, dtype="<f8") for v in part["vec"]])
                unit = _unit(raw).astype(np.float32)
                at, d = _nearest(unit, index.coarse, PROBES)
                root = np.sqrt(np.maximum(d, 0))
                use = root <= root[:, :1] + reach  # farther lists hold no vector within the threshold
                codes = index.encode(unit - index.coarse[at[:, 0]])
                n = use.sum(1)
                row = np.repeat(np.arange(len(part)), n)
                at = at + base
                lists = at[use]
                probes = [p[u].astype(np.int32) for p, u in zip(at, use, strict=True)]
                yield pd.DataFrame({
                    "list": lists.astype(np.int32), "own": at[row, 0].astype(np.int32), "node": part["node"].to_numpy()[row], "m": part["m"].to_numpy()[row],
                    "probes": [probes[i] for i in row], "code": [codes[i].tobytes() for i in row], "vec": part["vec"].to_numpy()[row],
                })

    return run


def _search(indexes: dict[int, tuple[Index, int]], threshold: float):
    """Links of one block of queries with one block of a list's members: partial link counts and a spanning forest."""
    radius = 2 - 2 * threshold

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        this, qb, mb = (int(frame[c].iloc[0]) for c in ("list", "qblock", "mblock"))
        role = frame["role"].to_numpy()
        q, m = frame[role == 0].reset_index(drop=True), frame[role == 1].reset_index(drop=True)
        none = pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(q) or not len(m):
            return none
        exact_q, exact_m = (np.stack([np.frombuffer(v, dtype="<f8") for v in x["vec"]]) for x in (q, m))
        exact_q, exact_m = _unit(exact_q), _unit(exact_m)
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in m["code"]])
        index, base = indexes[exact_q.shape[1]]
        centre = index.coarse[this - base]
        residual = (exact_q - centre).astype(np.float32)
        gap = ((exact_m - centre - index.decode(codes)) ** 2).sum(1)
        bound = (np.sqrt(radius) + np.sqrt(np.maximum(gap, SLACK * index.error))) ** 2
        q_node, m_node, q_own = q["node"].to_numpy(), m["node"].to_numpy(), q["own"].to_numpy()
        q_m, m_m = q["m"].to_numpy(), m["m"].to_numpy()
        m_probes = m["probes"].tolist()
        back = {}  # by other list: whether each member also looks there, and so sees the pair there
        for other in np.unique(q_own[q_own < this]):
            back[int(other)] = np.array([other in p for p in m_probes])
        links, ea, eb = {}, [], []
        for k in range(0, len(q), 256):
            tables = index.tables(residual[k : k + 256])
            near = tables[0][:, codes[:, 0]]
            for i in range(1, len(tables)):
                near += tables[i][:, codes[:, i]]
            x, y = np.nonzero(near <= bound[None, :])
            own = q_own[k + x]
            ok = (own != this) | (q_node[k + x] < m_node[y])  # a pair of members once, and none with itself
            x, y = x[ok] + k, y[ok]
            for other, also in back.items():
                there = (q_own[x] == other) & also[y]
                x, y = x[~there], y[~there]
            for s in range(0, len(x), 65_536):  # exact rerank
                xs, ys = x[s : s + 65_536], y[s : s + 65_536]
                hit = (exact_q[xs] * exact_m[ys]).sum(1) >= threshold
                xs, ys = xs[hit], ys[hit]
                for nodes, n in ((q_node[xs], m_m[ys]), (m_node[ys], q_m[xs])):
                    names, at = np.unique(nodes, return_inverse=True)
                    for name, c in zip(names.tolist(), np.bincount(at, weights=n).astype(np.int64).tolist() if len(at) else [], strict=True):
                        links[name] = links.get(name, 0) + c
                a, b = forest(q_node[xs], m_node[ys])
                ea.append(a)
                eb.append(b)
        a, b = forest(np.concatenate(ea), np.concatenate(eb)) if ea else (q_node[:0], q_node[:0])
        edges = pd.DataFrame({"kind": np.zeros(len(a), np.int32), "a": a, "b": b})
        counts = pd.DataFrame({"kind": np.ones(len(links), np.int32), "a": np.fromiter(links, np.int64, len(links)), "b": np.fromiter(links.values(), np.int64, len(links))})
        return pd.concat([edges, counts], ignore_index=True)

    return run


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine in double precision is at least the threshold. Equal
    vectors are first made one node with a count. Nodes lie in coarse inverted lists with
    residual codes; each looks through up to PROBES lists, fewer where the others lie too
    far away to hold a link, by table look-ups with a bound that takes in each member's own
    quantisation error, and what remains is ranked by exact cosine. So no pair that meets is
    missed, and only pairs that meet in no probed list are. Lists are searched in blocks of
    about BLOCK members, and a block gives link counts and a spanning forest, never pairs.

    Vectors of each length have an index of their own, and link with none of another length.
    A vector that is null or zero, or has null or non-finite components, links with
    nothing: n_links 0 and its own id as component. Links of a repeated id's rows count as to
    other rows. A null id is its own null component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(F.col("v"), lambda x: x != 0)
    rows = materialize(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.col("v"))),
        "vectors",
    )
    nodes = rows.where("ok and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"))
    nodes = materialize(nodes, "nodes")
    total = nodes.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = {r["dim"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    indexes, base = {}, 0
    for dim, n in sorted(lengths.items()):
        own = nodes.where(F.size("v") == dim)
        few = min(sample, n) if len(lengths) == 1 else max(min(n, LEAST_SAMPLE), sample * n // total)
        chosen = own.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(min(1.0, 1.2 * few / n) * 1_000_000)).limit(few)
        fitted = [r["v"] for r in chosen.select("v").collect()] or [r["v"] for r in own.select("v").limit(few).collect()]
        indexes[dim] = Index(_unit(np.array(fitted)), n), base
        base += len(indexes[dim][0].coarse)

    def binary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"node": f["node"], "m": f["m"], "dim": f["v"].str.len(), "vec": [np.asarray(v, dtype="<f8").tobytes() for v in f["v"]]})

    same = nodes.mapInPandas(binary, "node long, m long, dim int, vec binary")
    listed = same.mapInPandas(_assign(indexes, threshold), "list int, own int, node long, m long, probes array<int>, code binary, vec binary")
    listed = materialize(listed, "lists")
    sizes = listed.groupBy("list").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("nq"), F.greatest(F.ceil(F.count(F.when(F.col("own") == F.col("list"), 1)) / BLOCK), F.lit(1)).cast("int").alias("nm")
    )
    listed = listed.join(F.broadcast(sizes), "list")  # one row per list, at most 4,096 for each length
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "own", "node", "m", "probes", "code", "vec"]
    queries = listed.select(*columns, F.lit(0).alias("role"), block("nq").alias("qblock"), every("nm").alias("mblock"))
    members = listed.where("own = list").select(*columns, F.lit(1).alias("role"), every("nq").alias("qblock"), block("nm").alias("mblock"))
    found = queries.unionByName(members).groupBy("list", "qblock", "mblock").applyInPandas(_search(indexes, threshold), "kind int, a long, b long")
    found = materialize(found, "links")
    comps = connected_components(found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    named = nodes.join(comps, "node", "left").join(counts, "node", "left")
    named = materialize(named.select(F.col("v"), F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    free_shuffles(spark)
    lone = rows.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("ok and vec_id is not null").join(named, "v").select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
