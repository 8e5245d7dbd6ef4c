"""WARC archives with an index that is made first and read by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introngrid.llm.words import encoded, slices
from introngrid.storage import materialize, work_folder

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Neighbouring records up to so many bytes apart are read in one request, of at most MOST bytes.
GAP, MOST = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, digest string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, valid boolean"


def filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, a gzip member of its own. A revisit has the HTTP header but no payload; a page without an id gets a name of no page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """rows as a frame whose ids stay whole numbers beside nulls: pandas would make them floats, which end at 2**53."""
    ids = {"page_id": "Int64", "refers_to": "Int64"}
    return pd.DataFrame({c: pd.array(x, dtype=ids[c]) if c in ids else list(x) for c, x in zip(columns, zip(*rows, strict=True), strict=True)})


def _writer(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        out = name = None
        at = 0
        try:
            for part in slices(frames, "html"):
                if out is None:  # a name per attempt: what a lost attempt wrote is in no index
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                rows = []
                for page, url, html, digest, refers in zip(part["page_id"], part["url"], part["html"], part["digest"], part["refers_to"], strict=True):
                    page, refers = (None if pd.isna(x) else x for x in (page, refers))
                    record = _record(page, url, encoded(html), digest, refers)
                    out.write(record)
                    rows.append((None if page is None else int(page), url, digest, f"{folder}/{name}", at, len(record)))
                    at += len(record)
                yield _frame(rows, ["page_id", "url", "digest", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row to *.warc.gz files in folder, and return their index.

    The index (page_id, url, digest, file, offset, length) is itself a written table; it
    alone says which files count. Of equal payloads of at least LEAST_REVISIT bytes the
    row with the smallest page_id is a response, the others are revisits that name it (rows
    that repeat this page_id are responses too: a revisit can't name its own id).
    Null html is an empty payload. A row with a null page_id is a response with its own
    payload, named by no revisit, and is read back with a null page_id. folder must be a place that
    all workers share (by default one in the session's shared folder) and pyarrow can open.
    """
    spark = pages.sparkSession
    folder = folder or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    html = F.col(html_col)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    # Only short rows move: digests, combined before the shuffle.
    first = materialize(
        pages.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"),
        "responses",
    )
    revisit = F.when((F.col("n") >= LEAST_REVISIT) & (F.col("first") != F.col("page_id")), F.col("first"))
    told = pages.join(first, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", revisit.cast("string").alias("refers_to"))
    return materialize(told.mapInPandas(_writer(folder), INDEX), "warc-index")


def _parse(raw: bytes) -> tuple:
    record = zlib.decompress(raw, 31)
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda key: int(fields[key].removeprefix("<urn:page:").rstrip(">")) if fields.get(key, "").startswith("<urn:page:") else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    valid = not response or (len(payload) == declared and hashlib.sha256(payload).hexdigest() == digest)
    return number("WARC-Record-ID"), declared, digest, fields["WARC-Type"], number("WARC-Refers-To"), fields["WARC-Target-URI"], payload if response else None, valid


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) rows coalesced to (file, start, end, members)."""
    now = None
    for file, offset, length in rows:
        if now and now[0] == file and offset - now[2] <= GAP and offset + length - now[1] <= MOST:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
        else:
            if now:
                yield tuple(now)
            now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield tuple(now)


def _reader(with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, handle = None, None
        for frame in frames:
            rows = list(frame[["file", "offset", "length"]].itertuples(index=False, name=None))
            for file, start, end, members in _ranges(rows):
                if file != opened:
                    files, path = filesystem(file)
                    handle, opened = files.open_input_file(path), file
                data = handle.read_at(end - start, start)
                out = [_parse(data[o - start : o - start + n]) for o, n in members]
                if not with_payload:
                    out = [(*r[:6], None, r[7]) for r in out]
                yield _frame(out, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "valid"])

    return run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of index name: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload, valid.

    Rows are sorted by file and offset over range partitions, and neighbours are read in
    one request. valid is false if a response's payload has not the digest of its header.
    A revisit has no payload of its own. An empty index gives no rows.
    """
    spark = index.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = index.select("file", "offset", "length").repartitionByRange(width, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(_reader(with_payload), RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to archives and read every record back, without payloads."""
    return read_records(write_archives(pages, folder), with_payload=False)
