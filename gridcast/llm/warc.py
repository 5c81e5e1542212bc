"""WARC archives written from and read back as a chunked record table.

A payload travels as rows ``(record, chunk number, bytes)`` of at most
``CHUNK`` bytes, from the scan on: digests are SHA-1 sums carried from chunk to
chunk, shuffles and sorts move chunk rows, the archive writer streams a record's
chunks behind its header, and the reader emits them again with a digest of what
it read.  No step after the scan holds a record whole.  Every record is a gzip
member of its own.

Writing.  Of the records with equal payloads of at least ``min_revisit_bytes``
bytes the one with the smallest id is the ``response``, the others are
``revisit`` records without a payload that name it (WARC-Refers-To); smaller
payloads are all responses.  Only ids and digests meet by digest; the responses
of repeated payloads are a written table, so that a payload that is everywhere
can be split.  An archive is written by one task under a name of its own try and
listed in the returned manifest only when complete: a task that is run again
writes another file, and readers see listed files alone.

Archives go to a folder that every executor reaches (a Hadoop-style URI that
``pyarrow.fs`` knows: file, s3, gs, hdfs).

Defined results: null payload is the empty payload; every row is a record, also
where ids repeat or are null; of equal payloads that with the smallest id is the
response, rows without an id come last and rows of one id in the order of the
table; a revisit of a response without an id refers to null; a URL of any length
comes back whole but for its white space; an empty table gives no archives and
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_path, materialize, scratch_path, shuffle_parts

#: Bytes of one chunk row.
CHUNK = 64 * 1024
MIN_REVISIT_BYTES = 0
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, copy: int) -> str:
    """A record's URI: made from its id and copy number, so it is the same
    whenever a task runs again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, copy, url, html`` of every record; ``(page_id, copy)`` names
    it.  Where ids repeat or are missing the table is written to number it."""
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    n = raw.agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("d")).first()
    if n["n"] == n["d"]:
        return raw.withColumn("copy", F.lit(0).cast("long"))
    return materialize(raw.withColumn("copy", F.monotonically_increasing_id()))


def _record(row: str = "") -> list:
    """Columns that name a record, safe to join by."""
    return [F.coalesce(F.col(f"{row}page_id"), F.lit(-1)).alias("k1"),
            F.when(F.col(f"{row}page_id").isNull(), -F.col(f"{row}copy") - 1).otherwise(F.col(f"{row}copy")).alias("k2")]


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: ``k1, k2, page_id, copy, chunk_no, url,
    chunk``, a row per ``chunk`` bytes (one at least), the URL on the first.  A
    record's rows leave its task one after another."""
    payload = records.withColumn("payload", F.encode("html", "UTF-8")).drop("html")
    n = F.ceil(F.octet_length("payload") / F.lit(chunk)).cast("int")
    numbered = payload.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    return numbered.select(*_record(), "page_id", "copy", "chunk_no", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"),
                           F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})").alias("chunk"))


def payload_digests(chunks: DataFrame) -> DataFrame:
    """``k1, k2, page_id, copy, sha1, size`` of every record, the digest carried
    from chunk to chunk."""
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, size = None, None, 0

        def rows(out):
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]),
                                               pa.array([o[4] for o in out], pa.binary()), pa.array([o[5] for o in out], pa.int64())],
                                              names=["k1", "k2", "page_id", "copy", "sha1", "size"])

        for b in batches:
            out = []
            for k1, k2, page_id, copy, no, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if no == 0:
                    if now is not None:
                        out.append((*now, sha.digest(), size))
                    now, sha, size = (k1, k2, page_id, copy), hashlib.sha1(), 0
                sha.update(part)
                size += len(part)
            if out:
                yield rows(out)
        if now is not None:
            yield rows([(*now, sha.digest(), size)])

    return (chunks.select("k1", "k2", "page_id", "copy", "chunk_no", "chunk")
            .mapInArrow(run, "k1 long, k2 long, page_id long, copy long, sha1 binary, size long"))


def revisits(digests: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``k1, k2, sha1, size, revisit, first_id, first_copy`` of every record:
    whether it repeats an earlier response, and which."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "copy")
    first = materialize(digests.where(F.col("size") >= min_revisit_bytes).groupBy("sha1", "size")
                        .agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"))
    again = F.col("first").isNotNull() & (F.col("first") != order)
    return (digests.join(first, ["sha1", "size"], "left")
            .select("k1", "k2", "sha1", "size", again.alias("revisit"), F.when(again, F.col("first.page_id")).alias("first_id"),
                    F.when(again, F.col("first.copy")).alias("first_copy")))


def as_uri(folder: str) -> str:
    """A folder as a URI for ``pyarrow.fs``."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return f"file://{folder}" if folder.startswith("/") else folder


def _line(text: str) -> str:
    return "".join(text.split())


def _header(page_id, copy, url, sha1, size, revisit, first_id, first_copy, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, copy)),
              ("WARC-Date", date), ("WARC-Target-URI", _line(url or "") or f"urn:page:{page_id}"),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode())]
    if page_id is not None:
        fields += [("X-Page-Id", str(page_id))]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(first_id, first_copy))]
        fields += [("X-Refers-To-Page-Id", str(first_id))] if first_id is not None else []
    fields += [("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(http) + (0 if revisit else size)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def write_archives(records: DataFrame, folder: str, archives: int | None = None, chunk: int = CHUNK,
                   date: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``records`` under ``folder``; the manifest ``path, records,
    bytes`` of the archives (a checkpointed table)."""
    spark = records.sparkSession
    bounded_batches(spark)
    stamp = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks = chunk_rows(records, chunk)
    known = materialize(revisits(materialize(payload_digests(chunks)), min_revisit_bytes))
    rows = chunks.join(known, ["k1", "k2"]).where("not revisit or chunk_no = 0").withColumn(
        "chunk", F.when(F.col("revisit"), F.expr("X''")).otherwise(F.col("chunk")))
    rows = rows.repartition(archives, "k1", "k2") if archives else rows
    rows = rows.sortWithinPartitions("k1", "k2", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        out = gz = store = path = None
        count = size = 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"records-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder.rstrip('/')}/{name}"
                    out = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                if r["chunk_no"] == 0:
                    if gz is not None:
                        size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    count += 1
                    size += out.write(gz.compress(_header(r["page_id"], r["copy"], r["url"], r["sha1"], r["size"], r["revisit"],
                                                          r["first_id"], r["first_copy"], stamp)))
                size += out.write(gz.compress(r["chunk"]))
        if out is not None:
            size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]},
                                             schema=pa.schema([("path", pa.string()), ("records", pa.int64()),
                                                               ("bytes", pa.int64())]))

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"))


class _Stream:
    """Bytes of a file of gzip members, unpacked piece by piece."""

    def __init__(self, raw, step: int):
        self.raw, self.step, self.left, self.buf, self.unzip = raw, step, b"", bytearray(), None

    def _more(self) -> bool:
        while True:
            if not self.left:
                self.left = self.raw.read(self.step)
                if not self.left:
                    return False
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.left, self.step)
            if self.unzip.eof:
                self.left, self.unzip = self.unzip.unused_data, None
            else:
                self.left = self.unzip.unconsumed_tail
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.buf.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buf)
            if not self._more():
                if self.buf.strip():
                    raise ValueError("the archive ends within a record")
                return None
        return self._take(at + len(mark))

    def some(self, n: int) -> bytes:
        """Between 1 and ``n`` bytes."""
        if not self.buf and not self._more():
            raise ValueError("the archive ends within a record")
        return self._take(n)

    def _take(self, n: int) -> bytes:
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def read_archives(manifest: DataFrame, with_chunks: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives listed in ``manifest(path)``: ``record_id,
    page_id, record_type, refers_to_record, refers_to, chunk_no, chunk,
    bytes_so_far, last, payload_digest, declared_digest``.  ``payload_digest``
    is computed from the bytes read, on a record's last row; without
    ``with_chunks`` only last rows come, with no bytes in them."""
    schema = ("record_id string, page_id long, record_type string, refers_to_record string, refers_to long, "
              "chunk_no int, chunk binary, bytes_so_far long, last boolean, payload_digest string, declared_digest string")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(),
             pa.bool_(), pa.string(), pa.string()]
    arrow = pa.schema(list(zip(names, kinds, strict=True)))
    bounded_batches(manifest.sparkSession)

    def records(path: str) -> Iterator[tuple]:
        from pyarrow import fs
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name, compression=None) as raw:
            s = _Stream(raw, chunk)
            while (head := s.until(b"\r\n\r\n")) is not None:
                f = _fields(head.lstrip(b"\r\n"))
                left = int(f["content-length"])
                http = s.until(b"\r\n\r\n")
                left -= len(http)
                page, refers = f.get("x-page-id"), f.get("x-refers-to-page-id")
                sha, size, no = hashlib.sha1(), 0, 0
                base = (f["warc-record-id"], None if page is None else int(page), f["warc-type"], f.get("warc-refers-to"),
                        None if refers is None else int(refers))
                declared = f["warc-payload-digest"].partition(":")[2]
                while True:
                    part = s.some(min(left, chunk)) if left else b""
                    left -= len(part)
                    sha.update(part)
                    size += len(part)
                    if with_chunks or not left:
                        digest = None if left else base64.b32encode(sha.digest()).decode()
                        yield (*base, no, part if with_chunks else None, size, not left, digest, declared)
                    no += 1
                    if not left:
                        break
                if s.until(b"\r\n\r\n") != b"\r\n\r\n":
                    raise ValueError("a record does not end where its length says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in records(path):
                    rows.append(r)
                    held += len(r[6] or b"") + 200
                    if held > 4 << 20:  # a few MB at a time, whatever a record's size
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=arrow)

    return manifest.select("path").repartition(max(1, shuffle_parts(manifest.sparkSession)), "path").mapInArrow(run, schema)


def archive_report(spark: SparkSession, pages: DataFrame, folder: str | None = None,
                   min_revisit_bytes: int = MIN_REVISIT_BYTES, archives: int | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back; per record ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``.  A revisit has
    the payload of the response it names, found by its record id; a digest
    that does not match what was read or declared is an error."""
    own_folder = folder is None
    folder = as_uri(folder or scratch_path(spark, "warc"))
    manifest = write_archives(records_of(pages), folder, archives, min_revisit_bytes=min_revisit_bytes)
    last = materialize(read_archives(manifest, with_chunks=False)
                       .select("record_id", "page_id", "record_type", "refers_to_record", "refers_to",
                               F.col("bytes_so_far").alias("size"), "payload_digest", "declared_digest"))
    if own_folder:  # what was read is kept by now
        drop_path(spark, folder)
    own = last.where("record_type = 'response'")
    origin = own.select(F.col("record_id").alias("refers_to_record"), F.col("size").alias("o_size"),
                        F.col("payload_digest").alias("o_digest"))
    again = (last.where("record_type = 'revisit'").join(origin, "refers_to_record", "left")
             .withColumn("size", F.col("o_size")).withColumn("payload_digest", F.col("o_digest")).select(*own.columns))
    checked = F.when(F.col("payload_digest") == F.col("declared_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("digest mismatch in record "), F.col("record_id"))))
    return own.union(again).select("page_id", F.col("size").alias("payload_bytes"), checked.alias("payload_digest"),
                                   "record_type", F.col("refers_to"))
