"""Sets of word shingles and their exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.llm.words import LOWER, encoded, slices
from introngrid.storage import materialize

#: Up to so many sets are picked by a broadcast of their names, 8 bytes each, before they are joined.
MOST_ENDS = 200_000


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """Hashes (XXH64, seed 42) of all runs of `width` words in order, A-Z lower-cased; a shorter text is one shingle, a wordless one has none."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a text, in order of size."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def set_name(hashes: np.ndarray) -> int:
    """One number for a whole set; the empty set is 0."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) if len(hashes) else 0


def named_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """Rows (node, shingles) with the set's name and its hashes, one for each row of texts (text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(frames):
            sets = [shingle_set(encoded(x), width) for x in part["text"]]
            names = np.array([set_name(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"node": names, "shingles": [x.view(np.int64) for x in sets]})

    return texts.mapInPandas(run, "node long, shingles array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (src, dst): the pairs (a, b, a written table) of set names whose sets have a Jaccard similarity of at least `least`. Only sets of few pairs' ends move."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    if ends.limit(MOST_ENDS + 1).count() <= MOST_ENDS:
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(F.col("i") / (F.col("m") + F.col("n") - F.col("i")) >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
