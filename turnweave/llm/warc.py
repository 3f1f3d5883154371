"""WARC archives: a writer and a splittable reader of gzip members.

Every record is a gzip member of its own. The reader cuts archives into byte ranges; a task
scans its range for the gzip magic, validates a candidate by inflating it until a WARC
header can be decoded, and owns the records that start inside its range, reading on past
the range's end for the last one. From a valid member the reader goes straight to the
member's end, so magic bytes inside compressed data are seen only at the start of a range,
where they fail to inflate to a header. Files are opened with pyarrow's file systems, so
any URI they know works; `file:` needs a folder that all executors share.

Edge cases: a null payload is empty; payloads of any size stream through in pieces; rows
that repeat the largest id of a payload are all responses; headers of any length are read; rows with a null id revisit a
response that has one and are responses where none has; an empty table writes no archive
and reads as an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.storage import materialise, new_folder

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 1000
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 16
ROWS_SCHEMA = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


# --- Writing -----------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """`page_id`, `url`, `payload`, digest, size and, for revisits, `refers_to`.

    The largest id of each payload of `least` bytes or more comes from a pre-aggregated
    maximum over (digest, size); only digests held by several rows take part in the join,
    so a frequent payload meets one small row, not its copies.
    """
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"),
        F.col(id_col).alias("order_id"),
        url.alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    repeated = rows.where(F.col("bytes") >= least).groupBy(F.col("digest").alias("g_digest"), F.col("bytes").alias("g_bytes"))
    repeated = repeated.agg(F.max("order_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 and first_id is not null")
    repeated = materialise(repeated.select("g_digest", "g_bytes", "first_id"), "warc-repeated")
    joined = rows.join(repeated, (rows["digest"] == repeated["g_digest"]) & (rows["bytes"] == repeated["g_bytes"]), "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("order_id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", "bytes", refers.alias("refers_to"))


def _record(page_id, url, payload, digest: str, size: int, refers_to) -> bytes:
    kind = "revisit" if refers_to is not None else "response"
    block = b"" if payload is None else bytes(payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("X-Refers-To-Page-Id", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode("utf-8") + block + b"\r\n\r\n") + deflate.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task and return the manifest (path, bytes, records).

    A file belongs to the archive set only if the manifest lists it: the file of a lost or
    repeated attempt has another name and no row. The manifest is a table in the folder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, count, size = None, 0, 0
        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if out is None:
                    fs, path = _open(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)  # members are compressed here
                member = _record(*row)
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [uri], "bytes": [size], "records": [count]})

    manifest = records.select("page_id", "url", "payload", "digest", "bytes", "refers_to").mapInPandas(run, "path string, bytes long, records long")
    return materialise(manifest, "warc-manifest")


# --- Reading -----------------------------------------------------------------------------


class _Input:
    """Sequential pieces of a file from any offset."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def piece(self, at: int, n: int = READ_BYTES) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""


def _member(source: _Input, at: int) -> Iterator[bytes] | None:
    """Inflated pieces of the member at `at`; the last item is the member's end as an int. Raises zlib.error."""
    inflate = zlib.decompressobj(31)
    while not inflate.eof:
        piece = source.piece(at)
        if not piece:
            raise zlib.error("truncated member")
        at += len(piece)
        yield inflate.decompress(piece)
    yield at - len(inflate.unused_data)


def _parse(source: _Input, at: int):
    """(fields, payload size, payload SHA-1, end) of the record in the member at `at`, or None if it is no record."""
    head, fields, digest, size, wanted = bytearray(), None, hashlib.sha1(), 0, 0
    try:
        for piece in _member(source, at):
            if isinstance(piece, int):
                return None if fields is None or size < wanted else (fields, wanted, digest.hexdigest(), piece)
            if fields is None:
                seen = max(0, len(head) - 3)
                head += piece
                if not head.startswith(b"WARC/"[: len(head)]):
                    return None
                if (blank := head.find(b"\r\n\r\n", seen)) < 0:  # headers are as long as their record says
                    continue
                piece = bytes(head[blank + 4 :])
                pairs = (line.split(": ", 1) for line in head[:blank].decode("utf-8").split("\r\n")[1:])
                fields = {p[0].lower(): p[1] for p in pairs if len(p) == 2}
                wanted = int(fields["content-length"])
            body = piece[: max(0, wanted - size)]
            digest.update(body)
            size += len(body)
    except (zlib.error, UnicodeDecodeError, KeyError, ValueError):
        return None
    return None


def scan_range(uri: str, start: int, stop: int) -> Iterator[tuple]:
    """(offset, fields, payload size, SHA-1) of the records that start in [start, stop)."""
    source, at = _Input(uri), start
    while at < stop:
        window = source.piece(at, min(READ_BYTES, stop - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            if not window:
                return
            continue
        at += found
        if at >= stop:
            return
        record = _parse(source, at)
        if record is None:
            at += 1
            continue
        yield at, *record[:3]
        at = record[3]


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives (path, bytes), read by byte ranges of `split_bytes`."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("stop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS_SCHEMA.split(", ")]
        for pdf in batches:
            for path, start, stop in pdf.itertuples(index=False):
                rows = []
                for _, fields, size, digest in scan_range(path, start, stop):
                    kind = fields["warc-type"]
                    if kind == "revisit":  # the block is empty; the full payload's figures are in the header
                        size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), kind, size, digest, fields.get("x-refers-to-page-id")))
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return ranges.repartition(spark.sparkContext.defaultParallelism * 2, "path", "start").mapInPandas(run, ROWS_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None, split_bytes: int = SPLIT_BYTES, **columns) -> DataFrame:
    """Write `pages` as WARC archives and read them back."""
    spark = pages.sparkSession
    manifest = write_archives(plan_records(pages, **columns), folder or new_folder(spark, "warc"))
    return read_archives(spark, manifest, split_bytes)
