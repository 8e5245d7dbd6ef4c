"""Alignment of two tokenizers over the bytes of the same texts."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.llm.tokens import SPACE, byte_letters
from introngrid.llm.words import encoded, slices
from introngrid.storage import materialize, release

#: Distinct parts of texts, and token ids of them, that a worker keeps.
CACHE, FLAT = 300_000, 4_000_000
#: Id pairs whose counts go to every worker; the others' counts are joined.
HOT = 200_000


class ByteLevel:
    """A byte-level BPE file; strings of special tokens are plain text. Its pre-tokens never run from a word into white space, so parts are encoded alone."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        decode = {c: b for b, c in byte_letters().items()}
        self.tokens = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece file, which puts a space before what it encodes.

    The vocabulary is looked through once: if no piece holds a space after anything else, no
    merge runs from a word into the space behind it, nor into white space that is only ever a
    piece of its own. `part` is then the pattern of a word with the white space before it
    (and with what follows on white space that other pieces hold), otherwise that of a whole text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        glued = "".join(sorted({c for p in names if len(p) > 1 for c in re.findall(f"[{SPACE}]", p)}))
        on = f"(?:[{re.escape(glued)}][{SPACE}]*[^{SPACE}]*)*" if glued else ""
        self.part = "(?s).+" if any(re.search("[^▁]▁", p) for p in names) or " " in glued else f"[{SPACE}]*[^{SPACE}]+{on}|[{SPACE}]+"
        self.space = self.model.piece_to_id("▁")

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts that follow on others: the added space stands for a part's own first one, or its token goes."""
        own = [p[0] == " " for p in parts]
        found = self.model.encode([p[1:] if o else p for p, o in zip(parts, own, strict=True)], num_threads=1)
        return [ids or [self.space] if o else ids[1:] for ids, o in zip(found, own, strict=True)]


class Both:
    """Token ids of both files for texts put together from parts that no token crosses; known parts are looked up."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.lengths = [np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b)]
        self.find = re.compile(self.b.part).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends, self.exact = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2, np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        exact = np.ones(len(new), bool)
        sizes = np.array([len(encoded(p)) for p in new])
        for k, side in enumerate((self.a, self.b)):
            lists = side.encode(new)
            n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            ids = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(n.sum()))
            stops = np.concatenate(([0], np.cumsum(self.lengths[k][ids])))[np.concatenate(([0], np.cumsum(n)))]
            same = b"".join(map(side.tokens.__getitem__, ids.tolist())) == b"".join(map(encoded, new))
            if not same or (np.diff(stops) != sizes).any():
                exact &= [b"".join(map(side.tokens.__getitem__, i)) == encoded(p) for p, i in zip(new, lists, strict=True)]
            self.flat[k] = np.concatenate((self.flat[k], ids))
            self.ends[k] = np.concatenate((self.ends[k], self.ends[k][-1] + np.cumsum(n)))
        self.exact = np.concatenate((self.exact, exact))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A, all of B, and each text's numbers of both; texts whose tokens' bytes are not the text's get none."""
        if len(self.index) > CACHE or max(map(len, self.flat)) > FLAT:
            self.clear()
        lists = [self.find(t) for t in texts]
        parts = list(chain.from_iterable(lists))
        new = [p for p in dict.fromkeys(parts) if p not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, parts), dtype=np.int64, count=len(parts))
        n_parts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        text = np.repeat(np.arange(len(texts)), n_parts)
        fine = np.bincount(text[~self.exact[at]], minlength=len(texts)) == 0
        at, text = at[fine[text]], text[fine[text]]
        out = []
        for flat, ends in zip(self.flat, self.ends, strict=True):
            first, n = ends[at], ends[at + 1] - ends[at]
            stop = np.cumsum(n)
            ids = flat[np.repeat(first - (stop - n), n) + np.arange(int(n.sum()))].astype(np.int64)
            out.append((ids, np.bincount(text, n, len(texts)).astype(np.int64)))
        (a, n_a), (b, n_b) = out
        return a, b, n_a, n_b


@lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def gallop(keys: np.ndarray, into: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each key the first place of the sorted list `into` that is not below it, by steps of doubling length from `near`, then by halving."""
    n = len(into)
    near = np.clip(near, 0, max(n - 1, 0))
    low, high = near.copy(), near.copy()  # into[low] < key (or low = -1) <= into[high] (or high = n)
    up = into[near] < keys
    for rising in (True, False):
        open_, step = np.flatnonzero(up == rising), 1
        while len(open_):
            if rising:
                high[open_] = np.minimum(low[open_] + step, n)
                more = (high[open_] < n) & (into[np.minimum(high[open_], n - 1)] < keys[open_])
                low[open_[more]] = high[open_[more]]
            else:
                low[open_] = np.maximum(high[open_] - step, -1)
                more = (low[open_] >= 0) & (into[np.maximum(low[open_], 0)] >= keys[open_])
                high[open_[more]] = low[open_[more]]
            open_, step = open_[more], 2 * step
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = into[middle] < keys[open_]
        low[open_[below]], high[open_[~below]] = middle[below], middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def choose(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, take_y: np.ndarray) -> np.ndarray:
    """The texts' rows in order, each text's from y where take_y says so, else from x; n_x and n_y are their numbers."""
    from_y = np.repeat(take_y, np.where(take_y, n_y, n_x))
    out = np.empty(len(from_y), x.dtype)
    out[~from_y], out[from_y] = x[np.repeat(~take_y, n_x)], y[np.repeat(take_y, n_y)]
    return out


class Aligned:
    """Groups and links of the tokens of several texts in a row; n_a and n_b hold each text's numbers of tokens, whose bytes are the same."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, bytes_a: np.ndarray, bytes_b: np.ndarray):
        ends_a, ends_b = np.cumsum(bytes_a), np.cumsum(bytes_b)
        swap = n_b < n_a  # B's list is the shorter one and drives
        n_short, n_long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        short, long = choose(ends_a, ends_b, n_a, n_b, swap), choose(ends_a, ends_b, n_a, n_b, ~swap)
        text = np.repeat(np.arange(len(n_a)), n_short)
        stop = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
        start = np.concatenate(([0], stop[:-1]))
        near = (np.cumsum(n_long) - n_long)[text] + (short - start[text]) * n_long[text] // np.maximum(stop - start, 1)[text] - 1
        place = gallop(short, long, near)
        hit = long[place] == short
        first = np.concatenate(([0], (place + hit)[:-1]))[: len(place)]
        links = place - first + 1  # the ranks of a token's two ends differ by the other side's tokens that it overlaps
        left = np.repeat(np.arange(len(short)), links)
        right = np.repeat(first - (np.cumsum(links) - links), links) + np.arange(int(links.sum()))
        met = np.zeros(len(long), bool)
        met[place[hit]] = True
        ids_short, ids_long = choose(a, b, n_a, n_b, swap)[left], choose(a, b, n_a, n_b, ~swap)[right]
        self.text = text[left]
        turned = swap[self.text]
        self.a, self.b = np.where(turned, ids_long, ids_short), np.where(turned, ids_short, ids_long)
        self.n_links, self.n_groups = np.bincount(self.text, minlength=len(n_a)), np.bincount(text[hit], minlength=len(n_a))
        self.last_a, self.last_b = choose(hit, met, n_short, n_long, swap), choose(hit, met, n_short, n_long, ~swap)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of A's and of B's tokens where each group's A tokens come before its B tokens."""
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        total_a, total_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        return np.arange(len(group_a)) + np.concatenate(([0], total_b))[group_a], np.arange(len(group_b)) + total_a[group_b]


@lru_cache(maxsize=2)
def _digits(size_a: int, size_b: int) -> np.ndarray:
    """Decimal ids with what follows them: A's inside and at the end of its side, B's likewise."""
    return np.array([f"{i}{c}" for n, cs in ((size_a, ",|"), (size_b, ",;")) for c in cs for i in range(n)], dtype=object)


def _aligned_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = both(path_a, path_b)
        length_a, length_b = tokenizers.lengths
        size_a, size_b = len(length_a), len(length_b)
        table = _digits(size_a, size_b)
        for batch in batches:
            ids = batch.column(0)
            for part in slices(iter([pd.DataFrame({"at": np.arange(batch.num_rows), "text": batch.column(1).to_pandas()})])):
                texts = [f" {x}" if x else "" for x in part["text"]]
                a, b, n_a, n_b = tokenizers.ids(texts)
                x = Aligned(a, b, n_a, n_b, length_a[a], length_b[b])
                hashes = [""] * len(texts)
                if len(a):
                    codes, (at_a, at_b) = np.empty(len(a) + len(b), np.int64), x.merged()
                    codes[at_a], codes[at_b] = a + size_a * x.last_a, b + 2 * size_a + size_b * x.last_b
                    words, stops = table[codes].tolist(), np.cumsum(n_a + n_b).tolist()
                    for i, (s, e) in enumerate(zip([0, *stops], stops, strict=False)):
                        if e > s:
                            hashes[i] = hashlib.sha256("".join(words[s:e])[:-1].encode()).hexdigest()
                keys, times = np.unique(x.text * (size_a * size_b) + x.a * size_b + x.b, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(np.bincount(keys // (size_a * size_b), minlength=len(texts)))))
                lists = lambda v, t: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t))  # noqa: E731, B023
                columns = [ids.take(pa.array(part["at"].to_numpy())), *(pa.array(v, pa.int64()) for v in (n_a, n_b, x.n_groups, x.n_links)), pa.array(hashes, pa.string()), lists(keys % (size_a * size_b), pa.int64()), lists(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their times, added up in parts of a bounded size."""
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def fold() -> tuple[np.ndarray, np.ndarray]:
        pair, of = np.unique(np.concatenate(keys), return_inverse=True)
        return pair, np.bincount(of, np.concatenate(times), len(pair)).astype(np.int64)

    for batch in batches:
        keys.append(batch.column(0).flatten().to_numpy())
        times.append(batch.column(1).flatten().to_numpy().astype(np.int64))
        if sum(map(len, keys)) > 3_000_000:
            pair, n = fold()
            if len(pair) > 1_500_000:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = pair[:0], n[:0]
            keys, times = [pair], [n]
    pair, n = fold()
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A space and the text are encoded by the byte-level BPE file path_a (A) and the
    sentencepiece file path_b (B). The shorter list of token ends drives exponential and
    binary search into the longer one: common ends cut both into groups, differences of
    ranks are the overlaps (links). An id pair's count is its links in all documents; n_best
    counts the links whose pair has the highest count of its B id, ties included, and
    count_sum adds the counts up over the links.

    Each text is encoded once; a written table keeps its distinct id pairs. Counts of the
    at most HOT commonest pairs go to every worker, those of the others are joined by pair,
    which no pair dominates then.

    Null and empty texts, and texts whose tokens' bytes differ from space and text, have no
    tokens: zeros and an empty groups_sha256. Repeated rows count and stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size_b = len(Pieces(path_b).tokens)
    table = materialize(_aligned_texts(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    summed = table.select("pairs", "times").mapInArrow(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "pair-counts")
    top = summed.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B's vocabulary at most
    counts = materialize(summed.join(F.broadcast(top), F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    step = F.floor(F.log2("n") * 8).cast("int")  # a few hundred steps at most
    left, least = HOT, 1 << 30
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    hot = counts.where(step >= least).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), hot["best"].to_numpy(zero_copy_only=False)))

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes, keys, times = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            found = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            of = np.repeat(np.arange(len(sizes)), sizes)
            sums = []
            for gain in (best, count):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, of[found], times[found] * gain[at[found]])
                sums.append(pa.array(total))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[~found], minlength=len(sizes))))), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(keys[~found], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times[~found], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *sums, *rest], names=[*kept, "n_best", "count_sum", "pairs", "times"])

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in kept)
    looked = table.select(*kept, "pairs", "times").mapInArrow(run, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<int>")
    looked = materialize(looked, "looked-up")
    release(table, summed)
    rare = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(step < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    out = looked.drop("pairs", "times").join(rare, "row", "left")
    with_rare = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", with_rare("n_best", "b"), with_rare("count_sum", "c"), "groups_sha256")
