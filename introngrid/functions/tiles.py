"""Work on all pairs of two tables of vectors, block by tile, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of the first table and of a tile of the second: a task holds their product, 8 MB, and the vectors.
BLOCK, TILE = 512, 2048


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=float).reshape(len(column), -1)


def by_tiles(first: DataFrame, second: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """The rows of work(block, tile) for every block of first and tile of second.

    Blocks and tiles are dealt by a hash of the row's number, so equal keys split too. A
    block is sent once for each tile and a tile once for each block, and they meet by an
    equality of both numbers; neither table is held whole anywhere. Empty tables give nothing.
    """
    blocks, tiles = max(1, -(-first.count() // block)), max(1, -(-second.count() // tile))
    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    a = first.withColumn("__b", number(blocks)).withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))
    b = second.withColumn("__t", number(tiles)).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return work(x, y) if len(x) and len(y) else pd.DataFrame()

    return a.groupBy("__b", "__t").cogroup(b.groupBy("__b", "__t")).applyInPandas(run, schema)
