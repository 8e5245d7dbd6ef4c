"""Packed token matrices in files: best-fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from introngrid.llm.tokens import word_ids
from introngrid.llm.warc import filesystem
from introngrid.llm.words import by_batches, encoded, slices
from introngrid.storage import materialize, work_folder

CAPACITY = 2048
#: Characters of text that one worker packs together; more characters make more workers' shares.
SHARE = 6_000_000
END_ID = 1
#: Neighbouring rows are read back in one request of at most so many bytes.
MOST = 8 << 20


class CapacityTree:
    """Number of open bins by free room, in a segment tree; finds the tightest bin that holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def pop(self, least: int) -> tuple[int, int] | None:
        """The (room, bin) of least room that is not below `least`."""
        i = least + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, longest first; all lengths are 1 .. capacity."""
    tree, n, bins, offsets = CapacityTree(capacity), 0, [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop(lengths[i])
        room, number = found or (capacity, n)
        n += found is None
        bins[i], offsets[i] = number, capacity - room
        if room > lengths[i]:
            tree.push(room - lengths[i], number)
    return bins, offsets


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
INDEX = pa.schema(
    [("file", pa.string()), ("row", pa.int64()), ("ids_sha256", pa.string()), ("n_tokens", pa.int32())]
    + [("cu_seqlens", _INTS), ("position_resets", _INTS), ("doc_ids", _LONGS), ("doc_starts", _INTS)]
)


def _share(capacity: int, pad_id: int, folder: str):
    """Pack one share, write its matrix to a file of its own and give the index rows."""

    def run(table: pa.Table) -> pa.Table:
        keys = [("doc_id", "ascending"), ("salt", "ascending")]
        table = table.sort_by(keys)
        names, lists = table.column("doc_id").to_pylist(), [np.frombuffer(x, dtype="<u2") for x in table.column("ids").to_pylist()]
        doc, start, length = [], [], []
        for i, ids in enumerate(lists):
            for s in range(0, len(ids), capacity):
                doc.append(i)
                start.append(s)
                length.append(min(capacity, len(ids) - s))
        bins, offsets = best_fit(length, capacity)
        n = max(bins) + 1
        matrix = np.full((n, capacity), pad_id, dtype="<u2")
        members: list[list[tuple]] = [[] for _ in range(n)]
        for d, s, size, b, o in zip(doc, start, length, bins, offsets, strict=True):
            matrix[b, o : o + size] = lists[d][s : s + size]
            members[b].append((o, size, names[d], s))
        files, root = filesystem(folder)
        name = f"share-{uuid.uuid4().hex}.u16"  # a name per attempt: what a lost attempt wrote is in no index
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(matrix.tobytes())
        rows = []
        for b, own in enumerate(members):
            own.sort(key=lambda x: x[0])
            ends = np.cumsum([x[1] for x in own]).tolist()
            digest = hashlib.sha256(matrix[b].tobytes()).hexdigest()
            rows.append((f"{folder}/{name}", b, digest, ends[-1], [0, *ends], [x[0] for x in own], [x[2] for x in own], [x[3] for x in own]))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), INDEX, strict=True)], schema=INDEX)

    return run


def write_matrices(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0, share: int = SHARE
) -> DataFrame:
    """Write packed sequences to files of id matrices, and return their index, a written table with a row for each sequence.

    A file holds rows of `capacity` little-endian uint16 ids, padded with pad_id, and
    nothing else, so row r lies at byte 2 * capacity * r. Columns of the index: file and row
    (together the sequence's name), ids_sha256 (of the row as written), n_tokens (without
    padding), cu_seqlens (cumulative segment lengths from 0), position_resets (where positions
    start again from 0), doc_ids and doc_starts (by segment: its document and its first token
    there). The index alone says which files count: a lost task's are in none.

    Documents over the capacity are split without loss. Documents are dealt by hash to
    shares of about `share` characters, each packed by best-fit decreasing on its own; how
    rows are dealt follows their split, so sequences may differ between runs. Null text is a
    document of its end id alone; null ids stay null; repeated rows are packed each; an empty
    table gives no rows. A vocabulary of over 65,536 ids raises a ValueError. folder must be a
    place that all workers share (by default one in the session's shared folder) and pyarrow can open.
    """
    spark = docs.sparkSession
    folder = folder or f"{work_folder(spark)}/matrices-{uuid.uuid4().hex}"
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = narrow.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    shares = max(1, -(-size // share))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_ids(tokenizer_path)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit into 16 bits")
        for part in slices(frames):
            ids, sizes = encoder.encode([encoded(x) for x in part["text"]])
            cuts = np.cumsum(sizes)[:-1]
            own = [np.append(x, np.uint32(end_id)).astype("<u2").tobytes() for x in np.split(ids, cuts)]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "salt": part["salt"].array, "ids": own})

    coded = by_batches(narrow.withColumn("salt", F.xxhash64("doc_id", "text")), run, "doc_id long, salt long, ids binary")
    # Repeated rows must not meet in one share, however many: their place among all rows salts them too.
    spread = F.pmod(F.xxhash64("doc_id", "salt", F.monotonically_increasing_id()), F.lit(shares)).cast("int")
    index = coded.withColumn("share", spread).groupBy("share").applyInArrow(_share(capacity, pad_id, folder), from_arrow_schema(INDEX))
    return materialize(index, "matrix-index")


def read_matrices(index: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of index with ids (the sequence's bytes as they lie in its file) and valid (they have the digest of the index).

    Rows are sorted by file and row over range partitions; neighbours are read in one request of at most MOST bytes.
    """
    fields = StructType([*index.schema.fields, StructField("ids", BinaryType()), StructField("valid", BooleanType())])
    target, width = to_arrow_schema(fields), 2 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for batch in batches:
            names, at, ids = batch.column("file").to_pylist(), batch.column("row").to_pylist(), []
            while len(ids) < len(at):
                i = j = len(ids)
                while j + 1 < len(at) and names[j + 1] == names[i] and at[j + 1] == at[j] + 1 and (j + 2 - i) * width <= MOST:
                    j += 1
                if names[i] != opened:
                    files, path = filesystem(names[i])
                    handle, opened = files.open_input_file(path), names[i]
                data = handle.read_at((j + 1 - i) * width, at[i] * width)
                ids += [data[k : k + width] for k in range(0, len(data), width)]
            valid = [hashlib.sha256(x).hexdigest() == d for x, d in zip(ids, batch.column("ids_sha256").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(valid)], schema=target)

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return index.repartitionByRange(parts, "file", "row").sortWithinPartitions("file", "row").mapInArrow(run, fields)


def packed_matrices(docs: DataFrame, tokenizer_path: str, folder: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Write all documents to matrix files and read every row back with its segments."""
    return read_matrices(write_matrices(docs, tokenizer_path, folder, capacity=capacity, **options), capacity)
