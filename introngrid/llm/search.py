"""Ranked lexical search: every item's best documents, by grouping documents on the mask of the item's terms that they hold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from introngrid.llm.words import encoded, slices
from introngrid.storage import materialize, release

#: Letters of a term: 0-9, a-z (A-Z become these) and all of UTF-8 above ASCII; every other byte parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Items answered by one pass over the postings, and their distinct terms at most; more items take more passes.
ITEMS, TERMS = 5_000, 100_000
#: Postings of one block of documents.
BLOCK = 1_000_000


def terms_of(text: str | None) -> list[bytes]:
    return encoded(text).translate(LETTERS).split()


def postings(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with at least one term of any kind: doc_id, n (its terms with repeats), and parallel arrays of the numbers of the given terms it holds and how often."""
    index = {t: k for k, t in enumerate(terms)}
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (pd.DataFrame({"doc_id": pd.Series(b.column(0).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)), "text": b.column(1).to_pandas()}) for b in batches)
        for part in slices(frames):
            lists = [terms_of(x) for x in part["text"]]
            n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.fromiter(map(index.get, chain.from_iterable(lists), repeat(-1)), dtype=np.int64, count=int(n.sum()))
            keys, tf = np.unique((np.repeat(np.arange(len(n)) * len(terms), n) + flat)[flat >= 0], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(keys // max(len(terms), 1), minlength=len(n)))))
            lists_of = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))  # noqa: E731, B023
            out = pa.RecordBatch.from_arrays([pa.array(part["doc_id"].array, pa.int64()), pa.array(n), lists_of(keys % max(len(terms), 1)), lists_of(tf)], schema=fields)
            yield out.filter(pa.array(n > 0))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """The postings of some documents by term, with what each adds to a score."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, length: int):
        m = 100 - 50 + (50 * n * total) // max(length, 1)
        order = np.argsort(terms, kind="stable")
        self.size, self.docs, terms, tfs = len(n), docs[order], terms[order], tfs[order].astype(np.int64)
        self.gains = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[self.docs]))
        self.known, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        self.most = np.maximum.reduceat(self.gains, first) if len(first) else np.zeros(0, np.int64)

    def best(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, and their scores, that hold all of the item's k highest above zero in this block, and no other than such as score `least` or more if k are known to.

        Documents are grouped by the mask of terms that they hold. Masks are evaluated by
        falling bound, the sum of their terms' greatest gains, until the next bound lies
        below the k-th score: nothing left can enter, equal scores included.
        """
        at = np.searchsorted(self.known, item)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == item)] if len(self.known) else at[:0]
        at = at[self.most[at] > 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = np.zeros((-(-len(at) // 64), self.size), np.uint64)
        for bit, t in enumerate(at):
            masks[bit // 64][self.docs[self.first[t] : self.first[t + 1]]] |= np.uint64(1 << bit % 64)
        held = np.flatnonzero(masks.any(axis=0))
        masks = masks[:, held]
        order = np.argsort(masks[0], kind="stable") if len(masks) == 1 else np.lexsort(masks)
        held, masks = held[order], masks[:, order]
        starts = np.flatnonzero(np.append(True, (masks[:, 1:] != masks[:, :-1]).any(axis=0)))
        stops, kinds = np.append(starts[1:], len(held)), masks[:, starts]
        bounds = sum(((kinds[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64) * self.most[t] for bit, t in enumerate(at))
        ranked = np.argsort(-bounds, kind="stable")
        found, scores, done, want = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 2 * k
        sizes = np.cumsum((stops - starts)[ranked])
        while done < len(ranked) and bounds[ranked[done]] >= least:
            until = min(len(ranked), max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + want))))
            some = ranked[done:until]
            n = stops[some] - starts[some]
            rows = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            gained = np.zeros(len(rows), np.int64)
            for bit, t in enumerate(at):
                has = np.flatnonzero((masks[bit // 64][rows] >> np.uint64(bit % 64)) & np.uint64(1))
                a, b = self.first[t], self.first[t + 1]
                gained[has] += self.gains[a + np.searchsorted(self.docs[a:b], held[rows[has]])]
            found, scores = np.concatenate((found, held[rows])), np.concatenate((scores, gained))
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                found, scores = found[keep], scores[keep]
            done, want = until, 2 * want
        keep = scores >= max(least, 1)
        return found[keep], scores[keep]


def _ranked(table: DataFrame, items: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score): each task's k best documents of each item."""

    def top(score: np.ndarray, ids: pa.Array) -> np.ndarray:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.lexsort((values, ids.is_null().to_numpy(zero_copy_only=False), -score))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), pa.array([], pa.int64()))
        best = [none] * len(items)

        def settle(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            if not len(rows):
                return
            ids, lists = rows.column("doc_id").chunk(0), rows.column("terms").chunk(0)
            sizes = np.diff(lists.offsets.to_numpy())
            arrays = (lists.flatten().to_numpy(), rows.column("tfs").chunk(0).flatten().to_numpy())
            block = Block(rows.column("n").to_numpy(), np.repeat(np.arange(len(rows)), sizes), *arrays, weights, total, length)
            for i, item in enumerate(items):
                score, known = best[i]
                docs, more = block.best(item, k, int(score[-1]) if len(score) == k else 1)
                if len(docs):
                    score, known = np.concatenate((score, more)), pa.concat_arrays([known, ids.take(pa.array(docs))])
                    order = top(score, known)
                    best[i] = (score[order], known.take(pa.array(order)))

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size > BLOCK:
                settle(held)
                held, size = [], 0
        if held:
            settle(held)
        numbers = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.concat_arrays([d for _, d in best] or [none[1]]), pa.array(np.concatenate([s for s, _ in best] or [none[0]]), pa.int64())], names=["item", "doc_id", "score"]
        )

    return table.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    A term is a maximal run of 0-9, A-Z (lower-cased), a-z and characters above ASCII. Of a
    document's score, a term of weight w = floor(1000 ln((2N+2)/(2df+1))) gives
    w ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L, in whole numbers.

    One pass over the texts writes each document's counts of the items' terms; N, L and df
    come from that table, over all documents. Then every task ranks its documents for all
    items, block by block, by masks of matched terms (Block.best), and hands on k rows an item.

    Ids are whole numbers. Null or empty texts match nothing. Rows of one item_id are one
    item with the terms of all its texts; a null item_id is an item of its own. Repeated
    rows of documents are ranked each; a null doc_id comes after others of its score. Empty
    tables give no rows. Items are taken in blocks of at most ITEMS items and about TERMS
    terms, one pass over documents each.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    out, block, seen = None, {}, set()

    def answer(block: dict) -> DataFrame:
        terms = sorted(set().union(*block.values()))
        index = {t: i for i, t in enumerate(terms)}
        table = materialize(postings(docs, terms, id_col, text_col), "postings")
        total, length = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(terms), np.int64)
        for row in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most TERMS rows
            weights[row["term"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * row["count"] + 1)))
        numbered = [np.array(sorted(index[t] for t in ts), np.int64) for ts in block.values()]
        best = materialize(_ranked(table, numbered, weights, total, length, k), "ranked")
        release(table)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = F.broadcast(spark.createDataFrame(list(enumerate(block)), f"item int, item_id {kind.simpleString()}"))  # at most ITEMS rows
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")

    for row in items.select(F.col(item_col).alias("item"), F.col(query_col).alias("text")).sort("item").toLocalIterator():
        if row["item"] not in block and (len(block) == ITEMS or len(seen) > TERMS):
            out, block, seen = answer(block) if out is None else out.unionByName(answer(block)), {}, set()
        mine = set(terms_of(row["text"]))
        block[row["item"]] = block.get(row["item"], set()) | mine
        seen |= mine
    last = answer(block)
    return last if out is None else out.unionByName(last)
