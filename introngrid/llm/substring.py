"""Removal of passages that occur more than once, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.llm.words import by_batches, encoded, mix64, slices
from introngrid.storage import free_shuffles, materialize, release

#: Rounds of recompression; symbols then cover about (4/3)**ROUNDS words.
ROUNDS = 4
#: Odd multipliers of the polynomial hashes.
BASE_A, BASE_B = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Spans:
    """Hashes of any span of a word sequence: sum of h[i] * base**(i - start), modulo 2**64."""

    def __init__(self, h: np.ndarray, base: np.uint64):
        up = _powers(base, len(h) + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
        self.down = _powers(inverse, len(h) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start]) ^ mix64((end - start).astype(np.uint64))


def _levels(h: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Symbols of each round as (name, left, right): [left, right) are all words that the symbol's extent and name depend on.

    A round drops the boundary between two neighbours if their names are equal (runs) or
    if the left one's name falls in one half of the names and the right one's in the
    other (pairs). Each boundary depends on its two neighbours alone, so equal texts
    get equal symbols wherever the words on both sides reach far enough.
    """
    n = len(h)
    name, left, right = h, np.arange(n), np.arange(1, n + 1)
    levels = [(name, left, right)]
    for r in range(ROUNDS):
        side = mix64(name + np.uint64(r + 1)) >> np.uint64(63)
        joined = (name[:-1] == name[1:]) | ((side[:-1] == 0) & (side[1:] == 1))
        joined &= doc[:-1] == doc[1:]
        first = np.flatnonzero(np.concatenate(([True], ~joined)))
        last = np.append(first[1:], len(name)) - 1
        inside = np.arange(len(name)) - np.repeat(first, last - first + 1)
        up = _powers(BASE_B, int(inside.max()) + 1)
        grouped = np.add.reduceat(name * up[inside], first)
        # A symbol alone keeps its name; a run or pair is named by its parts and their number.
        grouped = np.where(first == last, name[first], mix64(grouped + (last - first).astype(np.uint64)))
        # The neighbours' words count as well; at a document's edge nothing is known, so the span sticks out.
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        edge_l = (first == 0) | (doc[before] != doc[first])
        edge_r = (last == len(name) - 1) | (doc[after] != doc[last])
        left, right = np.where(edge_l, left[first] - 1, left[before]), np.where(edge_r, right[last] + 1, right[after])
        name, doc = grouped, doc[first]
        levels.append((name, left, right))
    return levels


def _witnesses(h: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(start, count, key, whole) of runs of windows that have the same witness.

    A window's witness is a symbol that depends on the window's words alone: on the
    highest level that has one, that with the least key. Its key names the symbol and
    all words that it depends on, so equal windows have equal witness keys. whole is
    the hash of all words of the run's windows.
    """
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    doc = np.repeat(np.arange(len(ends)), lengths)
    place = np.arange(len(h))
    win = place[place + window <= ends[doc]]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if not len(win):
        return none
    spans = _Spans(h, BASE_A)
    key, at = np.zeros(len(win), np.uint64), np.full(len(win), -1)
    for level, (name, left, right) in reversed(list(enumerate(_levels(h, doc)))):
        todo = np.flatnonzero(at < 0)
        if not len(todo):
            break
        safe_l, safe_r = np.maximum(left, 0), np.minimum(right, len(h))
        own = mix64(name + np.uint64(level)) ^ spans.of(safe_l, safe_r)
        w = win[todo]
        # left and right never fall from one symbol to the next, so a window's symbols are a range.
        lo = np.searchsorted(left, w, side="left")
        hi = np.searchsorted(right, w + window, side="right")
        some = hi > lo
        todo, lo, hi = todo[some], lo[some], hi[some]
        if not len(todo):
            continue
        best, width, table = np.zeros(len(todo), np.int64), 1, np.arange(len(own))
        count = hi - lo
        while True:  # least key of each range, from ranges of lengths that are powers of two
            here = np.flatnonzero((count >= width) & (count < 2 * width))
            if len(here):
                a, b = table[lo[here]], table[hi[here] - width]
                best[here] = np.where(own[b] < own[a], b, a)
            if not (count >= 2 * width).any():
                break
            a, b = table[:-width], table[width:]
            table = np.where(own[b] < own[a], b, a)
            width *= 2
        key[todo] = own[best]
        at[todo] = best * (ROUNDS + 1) + level
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (win[1:] != win[:-1] + 1))))
    count = np.diff(np.append(new, len(win)))
    start = win[new]
    return start, count, key[new], spans.of(start, start + count + window - 1)


def _hashed(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts with at least `window` words, where each such text ends, and which ones they are."""
    words, ends, which, total = [], [], [], 0
    for i, text in enumerate(texts):
        own = text.split()
        if len(own) >= window:
            words += own
            total += len(own)
            ends.append(total)
            which.append(i)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=total)
    return h, np.array(ends, dtype=np.int64), np.array(which, dtype=np.int64)


def _scan(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            h, ends, which = _hashed([encoded(x) for x in part["text"]], window)
            if not len(h):
                continue
            start, count, key, whole = _witnesses(h, ends, window)
            own = np.searchsorted(ends, start, side="right")
            base = np.concatenate(([0], ends[:-1]))
            yield pd.DataFrame({
                "uid": part["uid"].to_numpy()[which[own]], "key": key.view(np.int64), "whole": whole.view(np.int64),
                "start": (start - base[own]).astype(np.int32), "n": count.astype(np.int32),
            })

    return run


def _windows(window: int):
    """Hashes of single windows: those of the runs that `spots` lists as start, count, start, count, ..."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            h, ends, which = _hashed([encoded(x) for x in part["text"]], window)
            if not len(h):
                continue
            base = np.concatenate(([0], ends[:-1]))
            spots = [np.asarray(x, dtype=np.int64).reshape(-1, 2) for x in part["spots"]]
            own = np.repeat(np.arange(len(which)), [len(spots[i]) for i in which])
            runs = np.concatenate([spots[i] for i in which])
            count = runs[:, 1]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(runs[:, 0], count) + inside
            own = np.repeat(own, count)
            at = start + base[own]
            yield pd.DataFrame({
                "uid": part["uid"].to_numpy()[which[own]], "start": start.astype(np.int32),
                "h1": _Spans(h, BASE_A).of(at, at + window).view(np.int64), "h2": _Spans(mix64(h), BASE_B).of(at, at + window).view(np.int64),
            })

    return run


def _kept(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            rows = []
            for text, spots in zip(part["text"], part["spots"], strict=True):
                words, cut = encoded(text).split(), 0
                if spots is not None:
                    runs = np.asarray(spots, dtype=np.int64).reshape(-1, 2)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, runs[:, 0], 1)
                    np.add.at(edge, runs[:, 0] + runs[:, 1] + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    cut = len(words) - int(keep.sum())
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                else:
                    kept = b" ".join(words)
                rows.append((len(words), cut, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            out.insert(0, "doc_id", part["doc_id"].array)
            yield out

    return run


def repeated_runs(docs: DataFrame, window: int = 35) -> DataFrame:
    """Rows (uid, start, n): windows start .. start + n - 1 of that text occur elsewhere too. docs: uid, text; one row per text and copy."""
    spark = docs.sparkSession
    seen = materialize(docs.mapInPandas(_scan(window), "uid long, key long, whole long, start int, n int"), "witnesses")
    # Symbols that occur once end here: nothing that holds them can occur twice.
    shared = materialize(seen.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    found = materialize(seen.join(shared, "key", "left_semi"), "found")
    release(seen, shared)
    free_shuffles(spark)
    # A run whose words all occur twice needs no closer look.
    twice = materialize(found.groupBy("key", "whole").agg(F.count("*").alias("c")).select("key", "whole", (F.col("c") > 1).alias("twice")), "twice")
    known = materialize(found.join(twice, ["key", "whole"]), "known")
    torn = materialize(twice.where(~F.col("twice")).select("key").distinct(), "torn")
    # The others, and all that share their symbols, are verified window by window.
    spots = known.join(torn, "key", "left_semi").groupBy("uid").agg(F.flatten(F.collect_set(F.array("start", "n"))).alias("spots"))
    open_ = docs.join(materialize(spots, "spots"), "uid")
    single = materialize(open_.mapInPandas(_windows(window), "uid long, start int, h1 long, h2 long"), "windows")
    repeats = materialize(single.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "repeats")
    edges = single.join(repeats, ["h1", "h2"], "left_semi").select("uid", "start", F.lit(1).alias("n"))
    out = materialize(known.where("twice").select("uid", "start", "n").union(edges).distinct(), "runs")
    release(found, twice, known, torn, single, repeats)
    free_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of characters other than ASCII white space, unchanged. Every word that
    lies in a window of `window` consecutive words whose sequence also starts elsewhere, in
    the same text or another, goes; windows are judged on the input. Rows that repeat
    doc_id and text count as further texts. Null text has no words; shorter texts than a
    window lose nothing; an empty table gives no rows. kept_text joins the kept words by one space.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("uid", F.xxhash64("doc_id", "text"))
    runs = repeated_runs(base.where("text is not null").select("uid", "text"), window)
    spots = materialize(runs.groupBy("uid").agg(F.flatten(F.collect_list(F.array("start", "n"))).alias("spots")), "removed")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return by_batches(base.join(spots, "uid", "left").select("doc_id", "text", "spots"), _kept(window), schema)
