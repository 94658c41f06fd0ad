"""WARC archives as tables of payload chunks.

``write_archives`` turns rows of record headers and payload chunks into gzip WARC files, one member per record, in a
folder that driver and executors share. ``read_chunks`` streams archives back as (record id, chunk number) rows of at
most ``CHUNK`` payload bytes; each row carries the SHA-1 of the payload up to its end, so the last chunk of a record has
the digest of the whole and no task ever holds a whole payload that it reads.

A task writes to files of its own name and reports them; only files that a finished task reported are read, so a task
that is run again, or an executor that is lost, leaves no half-written archive in the result.

Defined results: a null payload is an empty one; records of equal payloads are one response, that of the least page_id,
and revisits; rows with a null page_id and an equal payload elsewhere refer to it, else they are responses; repeated rows
with the least page_id are all responses; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm._common import join_groups, new_path, tidy, written

CHUNK = 256 << 10
ARCHIVE_BYTES = 256 << 20

CHUNK_SCHEMA = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, header_digest string, "
    "chunk_no int, chunk_start bigint, chunk_bytes int, is_last boolean, sha1_so_far string"
)


def base32_digest(digest) -> str:
    return base64.b32encode(digest.digest()).decode("ascii")


def resolve_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with payload (binary), payload_bytes and first_id, the least page_id with an equal payload.

    Payloads of fewer than ``least_bytes`` bytes never refer to another.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    repeated = (
        rows.filter(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first_id")
    )
    joined = join_groups(rows, repeated, ["digest"], F.col("page_id"))
    return joined.select("page_id", "url", "payload", "first_id")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8")


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(rows: DataFrame, folder: str, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, first_id) rows as WARC files; path, bytes and records of each file."""
    import pyarrow as pa

    def write(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        done, out, name, records = [], None, "", 0

        def close():
            nonlocal out
            if out is not None:
                done.append((name, out.tell(), records))
                out.close()
                out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "first_id")]
            for i in range(batch.num_rows):
                page, url, payload, first = (c[i] for c in columns)
                page, url, first = page.as_py(), url.as_py(), first.as_py()
                data = payload.as_buffer()
                if out is None or out.tell() >= archive_bytes:
                    close()
                    name, records = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                view = memoryview(data) if data is not None and data.size else memoryview(b"")
                digest = hashlib.sha1()
                for at in range(0, len(view), chunk):
                    digest.update(view[at : at + chunk])
                revisit = first is not None and first != page
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{url}')}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Target-URI", "".join((url or "urn:none").split())),
                    ("Content-Type", "text/html"),
                    ("WARC-Payload-Digest", f"sha1:{base32_digest(digest)}"),
                    ("X-Page-ID", "" if page is None else str(page)),
                    ("X-Payload-Length", str(len(view))),
                ]
                if revisit:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", f"<urn:page:{first}>"),
                    ]
                    view = view[:0]
                fields.append(("Content-Length", str(len(view))))
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(pack.compress(_header(fields)))
                for at in range(0, len(view), chunk):
                    out.write(pack.compress(view[at : at + chunk]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
        close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{n}" for n, _, _ in done], pa.string()),
                pa.array([b for _, b, _ in done], pa.int64()),
                pa.array([r for _, _, r in done], pa.int64()),
            ],
            names=["path", "bytes", "records"],
        )

    return rows.mapInArrow(tidy(write), "path string, bytes bigint, records bigint")


class _Members:
    """Bytes of the gzip members of a stream, read and unpacked piece by piece."""

    def __init__(self, stream, piece: int = 64 << 10):
        self.stream, self.piece, self.unpack, self.packed, self.ready = stream, piece, None, b"", bytearray()

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(self.piece)
            if not self.packed:
                return False
        if self.unpack is None:
            self.unpack = zlib.decompressobj(31)
        self.ready += self.unpack.decompress(self.packed, self.piece)
        self.packed = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.packed, self.unpack = self.unpack.unused_data, None
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None where the stream ends."""
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def iterate_records(stream, chunk: int):
    """(header dict, chunk number, start, data, is last, SHA-1 so far) of each chunk; an empty payload has one."""
    members = _Members(stream)
    while (line := members.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while line := members.line():
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        left, digest, number, start = int(head["content-length"]), hashlib.sha1(), 0, 0
        while True:
            data = members.take(min(chunk, left))
            digest.update(data)
            left -= len(data)
            yield head, number, start, data, not left, base32_digest(digest.copy())
            if not left:
                break
            number, start = number + 1, start + len(data)
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")


def read_chunks(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of the archives in ``path``; the payload bytes too if ``with_data``."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(CHUNK_SCHEMA + (", data binary" if with_data else ""))
    names = [f.name for f in schema.fields]
    most_rows, most_bytes = 4096, 8 << 20

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(at, compression=None, buffer_size=1 << 20) as stream:
                    for head, number, start, data, last, so_far in iterate_records(stream, chunk):
                        refers = head.get("warc-refers-to", "")
                        page = head.get("x-page-id", "")
                        row = (
                            head["warc-record-id"].strip("<>"),
                            int(page) if page else None,
                            head["warc-type"],
                            int(refers.strip("<>").rpartition(":")[2]) if refers else None,
                            int(head["x-payload-length"]),
                            head["warc-payload-digest"].partition(":")[2],
                            number,
                            start,
                            len(data),
                            last,
                            so_far,
                        )
                        rows.append((*row, data) if with_data else row)
                        held += len(data) if with_data else 0
                        if len(rows) >= most_rows or held >= most_bytes:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)],
                                names=names,
                            )
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=names
                    )

    # The listing is small and each archive is a task's work.
    spark = files.sparkSession
    n = max(1, files.count())
    dealt = files.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism * 64), "path")
    return dealt.mapInArrow(tidy(read), schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder; the table of files."""
    folder = new_path(spark, "warc")
    rows = resolve_revisits(pages)
    return written(write_archives(rows, folder), "warc-files")


def warc_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("bigint"), "url", "html")
    chunks = read_chunks(archive_pages(spark, pages), with_data=False)
    last = chunks.filter("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        "page_id",
        "payload_bytes",
        # A response's digest is that of the bytes read back; a revisit has no payload of its own.
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        (
            ~response
            | ((F.col("sha1_so_far") == F.col("header_digest"))
               & (F.col("chunk_start") + F.col("chunk_bytes") == F.col("payload_bytes")))
        ).alias("verified"),
    )


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p),
b AS (
  SELECT *, list_transform(range(40), lambda i: CAST(('0x' || substr(hex, i + 1, 1)) AS INTEGER)) AS n FROM f
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      list_aggregate(list_transform(range(5), lambda j:
        (((n[1 + ((i * 5 + j) // 4)] >> (3 - ((i * 5 + j) % 4))) & 1) << (4 - j))), 'sum') AS INTEGER), 1)
  ), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
  true AS verified
FROM b
"""
