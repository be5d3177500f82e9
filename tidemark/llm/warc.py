"""WARC archives: records written as one gzip stream a file, normalised to
a member for each record with a sidecar offset index, and read by it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_dir, pa_schema, prepare, small, table, written
from tidemark.llm.token_files import file_system

MIN_REVISIT = 1000  # bytes; smaller payloads are never revisits
LEVEL, CHUNK = 4, 1 << 18
FILES = "path string,n_records long"
DATE = "1970-01-01T00:00:00Z"  # pages have no fetch time


def with_revisits(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of
    MIN_REVISIT bytes or more, all but those with the largest page_id refer
    to it. Rows that repeat that id are all responses; null ids sort last
    and refer like others."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw.alias("payload"), F.sha1(raw).alias("digest"))
    groups = (pages.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    groups = small(written(spark, groups.select(F.col("digest").alias("_digest"), "first"), "copies"))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return pages.join(groups, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _header(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, length: int) -> bytes:
    """Header fields; line breaks in a url are percent-encoded."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def write_monolithic(spark: SparkSession, records: DataFrame, folder: str) -> DataFrame:
    """One ``.warc.gz`` for each partition, a single gzip stream over all its
    records; (path, n_records), a written table. An attempt writes under its
    own name and renames at the end."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    schema = pa_schema(FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = file_system(folder)
        stem = f"{root}/{context.partitionId():06d}"
        part, out, n = f"{stem}.try{context.taskAttemptId()}", None, 0
        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(i) for i in range(5))):
                out = out or system.open_output_stream(part)
                page, url, payload, digest, refers = (x.as_py() for x in (page, url, payload, digest, refers))
                kind, body = ("response", payload) if refers is None else ("revisit", b"")
                head = _header(kind, page, url, digest, len(payload), refers, len(body))
                for data in (head, body, b"\r\n\r\n"):
                    out.write(gz.compress(data))
                n += 1
        if out:
            out.write(gz.flush())
            out.close()
            system.move(part, f"{stem}.warc.gz")
            name = f"{folder}/{context.partitionId():06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], schema=schema)

    return written(spark, records.mapInArrow(run, FILES), "archives")


def _inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members, in pieces of
    bounded size."""
    gz = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if gz.eof:
                gz = zlib.decompressobj(31)
            piece = gz.decompress(data, 4 * CHUNK)
            if piece:
                yield piece
            data = gz.unused_data if gz.eof else gz.unconsumed_tail


class _Reader:
    """Reads lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def line(self) -> bytes:
        """Up to and with the next line end; empty at the end."""
        parts = [self.held]
        while b"\n" not in parts[-1]:
            piece = next(self.pieces, b"")
            if not piece:
                break
            parts.append(piece)
        joined = b"".join(parts)
        end = joined.find(b"\n") + 1 or len(joined)
        self.held = joined[end:]
        return joined[:end]

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.held or next(self.pieces, b"")
            if not data:
                raise EOFError("the archive ends inside a record")
            yield data[:n]
            self.held, n = data[n:], n - len(data[:n])


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(header bytes, fields, body pieces) of every record; the body has to
    be read before the next record."""
    reader = _Reader(pieces)
    while line := reader.line():
        if not line.strip():
            continue
        head, fields = [line], {}
        while (line := reader.line()).strip():
            head.append(line)
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[key.strip().lower()] = value.strip(" \r\n")
        yield b"".join(head) + b"\r\n", fields, reader.take(int(fields["content-length"]))


def normalise(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) so that each record is a gzip member
    of its own; (path, n_records) of the new files, a written table. Beside
    each lies ``.idx``: a line ``offset length type id`` for each record.

    A file is inflated once, as a stream; neither it nor a record is held
    whole."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    schema = pa_schema(FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        attempt = f"try{TaskContext.get().taskAttemptId()}"
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                target = f"{root}/{name}"
                part, n, at = f"{target}.{attempt}", 0, 0
                there, path = file_system(path)
                with (there.open_input_stream(path, compression=None) as source,
                      system.open_output_stream(part, compression=None) as out, system.open_output_stream(f"{part}.idx") as index):
                    for head, fields, body in _records(_inflated(source)):
                        gz, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                        for data in _chain(head, body):
                            if packed := gz.compress(data):
                                out.write(packed)
                                size += len(packed)
                        packed = gz.flush()
                        out.write(packed)
                        size += len(packed)
                        index.write(f"{at} {size} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                        at, n = at + size, n + 1
                system.move(part, target)
                system.move(f"{part}.idx", f"{target}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], schema=schema)

    return written(spark, _by_file(archives).mapInArrow(run, FILES), "normalised")


def _chain(head: bytes, body: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from body
    yield b"\r\n\r\n"


def _by_file(files: DataFrame) -> DataFrame:
    """A task for each file: its row is a few bytes, the file is not."""
    return files.repartitionByRange(max(1, files.count()), "path")


def _id(field: str | None) -> int | None:
    number = (field or "").rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of
    every record, each found by its index line. A response's size and digest
    are computed from its payload and must agree with its header."""
    out = "page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long,url string"
    schema = pa_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, path = file_system(path)
                rows = []
                with system.open_input_stream(f"{path}.idx") as f:
                    index = [line.split(b" ")[:2] for line in f.read().splitlines()]
                with system.open_input_file(path) as f:
                    for offset, size in index:
                        member = zlib.decompress(f.read_at(int(size), int(offset)), 31)
                        for _, fields, body in _records(iter([member])):
                            sha, n = hashlib.sha1(), 0
                            for data in body:
                                sha.update(data)
                                n += len(data)
                            digest, kind = fields["warc-payload-digest"].rpartition(":")[2], fields["warc-type"]
                            length = int(fields["x-payload-length"])
                            if kind == "response" and (sha.hexdigest(), n) != (digest, length):
                                raise ValueError(f"{path}: record at {int(offset)} differs from its header")
                            rows.append((_id(fields["warc-record-id"]), length, digest, kind,
                                         _id(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return _by_file(files).mapInArrow(run, out)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder,
    normalise them and return the files (path, n_records).

    Null html is an empty payload, a null url leaves out its field, a null
    id its number; repeated rows are records of their own; other columns are
    ignored; an empty table gives no files."""
    prepare(spark)
    whole = write_monolithic(spark, with_revisits(spark, pages), new_dir(spark, "warc-stream"))
    return normalise(spark, whole, new_dir(spark, "warc"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(spark, archive(spark, table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d,
  octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
