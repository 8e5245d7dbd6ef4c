"""Words and hashes of whole texts, for the operators that work in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: bytes.split() cuts at exactly these: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(frames: Iterator[pd.DataFrame], column: str = "text", most: int = 1_500_000) -> Iterator[pd.DataFrame]:
    """Cut frames so that each holds about `most` characters, and at least one row: memory stays bounded whatever the texts' lengths."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        part = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def by_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInPandas(run, schema), but long columns stay exact beside nulls.

    Plain pandas turns a long column that holds a null into floats, which round above
    2**53. Here such a column is a nullable Int64 one; without nulls it is the usual int64.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(fields)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = batch.to_pandas()
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if pa.types.is_integer(column.type) and column.null_count:
                    frame[name] = column.to_pandas(types_mapper={column.type: pd.Int64Dtype()}.get)
            yield frame

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(frames(incoming)):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    return df.mapInArrow(batches, fields)
