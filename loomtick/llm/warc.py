"""WARC archives with a two-level capture index.

Each record is a gzip member of its own; an archive is one row of the Spark writer that
commits the file, of a bounded number of bytes (a longer record is one alone), and the
empty member at its end is the writer's.  So archives are ordinary ``.warc.gz`` content
on any file system that Spark writes, and a lost executor leaves nothing half written.

The index has two levels.  Capture lines ``key timestamp {json}``, keyed by the URL
with its host reversed, are sorted and cut into gzip-compressed blocks; a sparse
directory holds the first line of each block and its place.  A lookup searches the
directory, reads one block, searches in it, and reads one byte range of an archive.
``CaptureIndex`` does this for one URL, ``looked_up`` for a table of them: keys are dealt to
index files by the files' first lines, and places to archives, as Python on an executor
sees files by Spark's readers alone; both kinds of file are small.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtick.llm.common import discard, in_arrow, new_path, text_slices, written

#: An empty gzip member: what the writer puts at the end.
RECORD_END = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: Bytes of an archive (a longer record is one alone), and capture lines in an index block and blocks in an index file.
ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 2000
FILE_BLOCKS = 64
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: lower-case host reversed, no scheme, user, default port or fragment."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:  # not a URL: its text is the key
        return (url or "").strip().replace(" ", "%20").replace("\n", "%0A")
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path}".replace(" ", "%20").replace("\n", "%0A")


def header_url(url: str | None) -> str:
    """A URL as a header line can hold it."""
    return "" if url is None else re.sub(r"[\r\n]", " ", url).encode("utf-8", "replace").decode()


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def records(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, uncompressed record) of every record in an archive."""
    at = 0
    view = memoryview(archive)
    while at < len(archive):
        d = zlib.decompressobj(31)
        parts, pos = [], at
        while not d.eof:
            piece = view[pos : pos + (1 << 16)]
            if not piece:
                raise ValueError(f"the member at {at} is cut short")
            parts.append(d.decompress(piece))
            pos += len(piece)
        end = pos - len(d.unused_data)
        if raw := b"".join(parts):
            yield at, end - at, raw
        at = end


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, hex, refers_to, revisit): equal payloads refer to the smallest page_id.

    Only digests and ids meet in the aggregation, which sums up on the map side; a
    digest that very many pages share is spread by the adaptive skew join.  Rows
    that share the smallest id are all responses; null ids refer to any other.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hex", F.sha1("payload"))
    first = written(rows.where(F.octet_length("payload") >= min_bytes).groupBy("hex").agg(F.min("page_id").alias("first")), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "hex", "left").select("page_id", "url", "payload", "hex", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write one record for each row of ``pages`` (page_id, url, html); a null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
        for batch in text_slices(batches, 2):
            for i in range(batch.num_rows):
                page_id, url, payload, hexed, refers_to, revisit = (batch.column(c)[i].as_py() for c in range(6))
                made = record(page_id, url, payload, base64.b32encode(bytes.fromhex(hexed)).decode(), refers_to, revisit)
                if held and size + len(made) > archive_bytes:
                    yield archive()
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield archive()

    made = with_revisits(pages, min_bytes).transform(in_arrow, run, "archive binary")
    writer = made.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1)
    writer.option("lineSep", RECORD_END.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of what was written under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select(F.col("path").alias("file"), "content")


_CAPTURE = "page_id long, url string, url_key string, record_type string, refers_to long, payload_bytes long, payload_digest string, block_bytes long, block_digest string, file string, offset long, length long"
_CAPTURE_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]
_CAPTURE_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in _CAPTURE.split(", ")]


def _capture(raw: bytes, file: str, offset: int, length: int) -> tuple:
    """What a record says, and the size and digest of its block."""
    h, block = parse(raw)
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    url = h["WARC-Target-URI"]
    return number(h["WARC-Record-ID"]), url, url_key(url), h["WARC-Type"], number(h.get("WARC-Refers-To")), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], len(block), digest_of(block), file, offset, length


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, read from end to end: place, headers, and the size and digest of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _batch([_capture(raw, file, at, n) for at, n, raw in records(data.as_py())], _CAPTURE_NAMES, _CAPTURE_TYPES)

    return _files(spark, path).transform(in_arrow, run, _CAPTURE)


def places_in(spark: SparkSession, path: str) -> DataFrame:
    """(url_key, page_id, url, record_type, payload_digest, file, offset, length) of every record, by its headers."""
    names = ["url_key", "page_id", "url", "record_type", "payload_digest", "file", "offset", "length"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for at, n, raw in records(data.as_py()):
                    h, _ = parse(raw)
                    who = h["WARC-Record-ID"][len("<urn:page:") : -1]
                    rows.append((url_key(h["WARC-Target-URI"]), None if who == "null" else int(who), h["WARC-Target-URI"], h["WARC-Type"], h["WARC-Payload-Digest"][5:], file, at, n))
                yield _batch(rows, names, types)

    return _files(spark, path).transform(in_arrow, run, "url_key string, page_id long, url string, record_type string, payload_digest string, file string, offset long, length long")


def checked(captures: DataFrame) -> DataFrame:
    """Responses whose block is not what their header says stop the query."""
    wrong = (F.col("record_type") == "response") & ((F.col("block_bytes") != F.col("payload_bytes")) | (F.col("block_digest") != F.col("payload_digest")))
    return captures.withColumn("payload_digest", F.when(wrong, F.raise_error(F.concat(F.lit("damaged record: "), "file", F.lit(":"), F.col("offset").cast("string")))).otherwise(F.col("payload_digest")))


def write_index(captures: DataFrame, path: str, partitions: int | None = None, block_lines: int = BLOCK_LINES, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """Write the sorted capture lines as compressed blocks; returns the sparse directory.

    The directory has a row for each block: first (its first line), file, offset,
    length, n.  It is read back from the files, so it says what was written.
    """
    spark = captures.sparkSession
    line = F.concat_ws(" ", "url_key", F.lit(re.sub(r"\D", "", DATE)), F.to_json(F.struct("page_id", "url", "record_type", "payload_digest", "file", "offset", "length")))
    lines = captures.select("url_key", line.alias("line"))
    order = [F.col("line").cast("binary")]
    lines = lines.select("line").repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[str] = []
        block = lambda rows: pa.RecordBatch.from_arrays([pa.array([gzip.compress(("\n".join(rows) + "\n").encode(), mtime=0)], pa.binary())], ["block"])
        for batch in batches:
            kept += batch.column(0).to_pylist()
            while len(kept) >= block_lines:
                yield block(kept[:block_lines])
                kept = kept[block_lines:]
        if kept:
            yield block(kept)

    blocks = lines.transform(in_arrow, run, "block binary").select(F.col("block").cast("string"))
    writer = blocks.write.option("maxRecordsPerFile", file_blocks)
    writer.option("lineSep", RECORD_END.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(raw.split(b"\n", 1)[0].decode(), file, at, n, raw.count(b"\n")) for at, n, raw in records(data.as_py())]
                yield _batch(rows, ["first", "file", "offset", "length", "n"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()])

    return _files(spark, path).transform(in_arrow, places, "first string, file string, offset long, length long, n long")


def looked_up(urls: DataFrame, directory: DataFrame, index_path: str, archive_path: str) -> DataFrame:
    """The captures of (url), as ``read_archives`` gives them, by directory, block and byte range.

    Each capture comes once, however often its URL stands in ``urls``.  Only the first
    line of each index file reaches the driver.
    """
    spark = urls.sparkSession
    heads = directory.groupBy("file").agg(F.min(F.struct(F.col("first").cast("binary").alias("line"), "file")).alias("head"))
    order = sorted((bytes(r.head.line), r.head.file) for r in heads.collect())
    firsts, files = [x for x, _ in order], [x for _, x in order]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for url in batch.column(0).to_pylist():
                key = url_key(header_url(url))
                probe = (key + " ").encode()
                i = max(0, bisect.bisect_left(firsts, probe) - 1)
                while i < len(files) and (firsts[i] <= probe or firsts[i].startswith(probe)):
                    out.add((key, files[i]))
                    i += 1
            if out:
                yield _batch(sorted(out), ["key", "of"], [pa.string(), pa.string()])

    keys = urls.select(F.col("url").cast("string")).transform(in_arrow, dealt, "key string, of string")
    keys = keys.groupBy("of").agg(F.collect_set("key").alias("keys"))
    blocks = directory.groupBy(F.col("file").alias("f")).agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("binary").alias("first"), "offset", "length"))).alias("blocks"))
    search = keys.join(blocks, F.col("of") == F.col("f")).select("of", "keys", "blocks")
    content = _files(spark, index_path)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, places, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                view = memoryview(data.as_buffer())
                starts = [p["first"] for p in places]
                rows: list[tuple] = []
                at, lines = -1, []
                for key in sorted((k + " ").encode() for k in wanted):
                    i = max(0, bisect.bisect_left(starts, key) - 1)
                    while i < len(places) and (starts[i] <= key or starts[i].startswith(key)):
                        if i != at:
                            at, lines = i, gzip.decompress(view[places[i]["offset"] : places[i]["offset"] + places[i]["length"]]).split(b"\n")[:-1]
                        k = bisect.bisect_left(lines, key)
                        while k < len(lines) and lines[k].startswith(key):
                            found = json.loads(lines[k].split(b" ", 2)[2])
                            rows.append((found["file"], found["offset"], found["length"]))
                            k += 1
                        i += 1
                if rows:
                    yield _batch(rows, ["archive", "offset", "length"], [pa.string(), pa.int64(), pa.int64()])

    found = search.join(content, F.col("of") == F.col("file")).select("keys", "blocks", "content")
    places = found.transform(in_arrow, searched, "archive string, offset long, length long")
    ranges = places.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, wanted, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                view = memoryview(data.as_buffer())
                rows = [_capture(gzip.decompress(view[r["offset"] : r["offset"] + r["length"]]), file, r["offset"], r["length"]) for r in wanted]
                yield _batch(rows, _CAPTURE_NAMES, _CAPTURE_TYPES)

    archives = _files(spark, archive_path).join(ranges, F.col("file") == F.col("archive")).select("file", "ranges", "content")
    return archives.transform(in_arrow, read, _CAPTURE)


class CaptureIndex:
    """Lookups by URL: directory search, one block read, block search, one range read.

    The directory has a line for ``BLOCK_LINES`` captures and is read from a table;
    a lookup keeps nothing else.
    """

    def __init__(self, spark: SparkSession, directory: DataFrame):
        rows = directory.orderBy(F.col("first").cast("binary")).toLocalIterator()
        self.spark = spark
        self.blocks = [(r["first"].encode(), r["file"], r["offset"], r["length"]) for r in rows]
        self.firsts = [b[0] for b in self.blocks]

    def _range(self, file: str, offset: int, length: int) -> bytes:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(offset)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def captures(self, url: str) -> list[dict]:
        """The capture lines of a URL, in their order."""
        key = (url_key(url) + " ").encode()
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        out: list[dict] = []
        while i < len(self.blocks) and (self.firsts[i] <= key or self.firsts[i].startswith(key)):
            lines = gzip.decompress(self._range(*self.blocks[i][1:])).split(b"\n")[:-1]
            k = bisect.bisect_left(lines, key)
            while k < len(lines) and lines[k].startswith(key):
                out.append(json.loads(lines[k].split(b" ", 2)[2]))
                k += 1
            i += 1
        return out

    def read(self, capture: dict) -> tuple[dict[str, str], bytes]:
        """Headers and block of a capture, by one range read."""
        with gzip.open(io.BytesIO(self._range(capture["file"], capture["offset"], capture["length"]))) as f:
            return parse(f.read())


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives, index them, and read every capture back through the index.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and
    url_key, file, offset and length, for each row: URLs are looked up in the directory
    and its blocks, and records read from the byte ranges found there.  A record whose
    block is not what its header says stops the query.  The archives stay.
    """
    spark = pages.sparkSession
    archives, index = write_archives(pages, new_path(spark, "warc"), min_bytes), new_path(spark, "capture-index")
    directory = written(write_index(places_in(spark, archives), index), "directory")
    captures = written(checked(looked_up(pages.select("url"), directory, index, archives)), "captures")
    discard(directory)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "file", "offset", "length")


_LETTERS_SQL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY 1),
d AS (SELECT p.*, first, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr({_LETTERS_SQL}, (('0x' || substr(hex, i * 5 + 1, 5))::INT >> k) % 32 + 1, 1)), '')), '') AS digest FROM p JOIN f USING (hex))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d
"""
