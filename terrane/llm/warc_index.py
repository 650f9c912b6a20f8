"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so any record can be read by its offset. The index has a line per capture,
sorted by reversed-host key (com,example,www)/path, capture number: the lines are cut into compressed blocks, and a
sparse directory keeps the first key of each block. A lookup searches the directory by halves, opens one block,
searches its lines by halves, and reads just the record's range from its archive. Lookups of many keys meet the
directory in segments of about SEGMENT_BLOCKS entries; the driver holds one key for each segment, which is one for half
a million captures.

Writing is idempotent: a task writes archives under names of their own, and only those that its committed rows name
belong to the result, so retried or lost tasks leave nothing that is read.

Cases. Null html is an empty payload; null urls get an empty target. Pages with null ids are written and found like
others; of equal payloads the largest id answers, null ids last, and each repeated row of that id is a response.
Empty tables give empty archives and indexes. Other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import BROADCAST_BYTES, small_batches
from terrane.operators.skew import attach
from terrane.session import cut, files_for, new_path

#: Payloads of at least this many bytes are stored once.
LEAST_REVISIT = 1000
#: Bytes after which a task begins another archive, and lines of an index block.
ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 500
#: Directory entries of a segment on average, and keys that one task looks up in it.
SEGMENT_BLOCKS, SEGMENT_KEYS = 1000, 500_000
#: A fixed date: records carry no clock, so reruns give equal archives.
DATE = "1970-01-01T00:00:00Z"


def reversed_host_key(url: str | None) -> str:
    """com,example)/path?query for http://www.example.com/path?query#part; ports, www and case of the host go."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return re.sub(r"\s", "%20", url or "")
    host = re.sub(r"^www\d*\.", "", host)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + ")" + path)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def compress(data: bytes) -> bytes:
    """One gzip member without a date."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit without payload that names the response."""
    name = "revisit" if revisit else "response"
    target = re.sub(r"[\r\n]", "", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {name}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record is cut short")
    return headers, rest[:size]


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# Writing.

MANIFEST_DDL = "line_key string, capture bigint, archive string, offset bigint, length bigint"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                revisit = bool(r["revisit"])
                data = compress(record(r["page_id"], r["url"], payload, hashlib.sha1(payload).hexdigest(), r["refers_to"], revisit))
                out.write(data)
                capture = xxhash.xxh3_64_intdigest(name.encode(), seed=at) >> 1
                rows.append((reversed_host_key(r["url"]), capture, name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["line_key", "capture", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _blocks(most: int):
    """Sorted manifest lines to compressed blocks of ``most`` lines; a block never crosses a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        keys: list[tuple[str, int]] = []

        def block() -> pa.RecordBatch:
            key, capture = keys[0]
            data = compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            out = pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([capture], pa.int64()), pa.array([data], pa.binary()), pa.array([len(lines)], pa.int64())], names=["first_key", "first_capture", "lines", "n"]
            )
            lines.clear()
            keys.clear()
            return out

        for batch in batches:
            for key, capture, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(f"{key} {capture} {archive} {offset} {length}")
                keys.append((key, capture))
                if len(lines) == most:
                    yield block()
        if lines:
            yield block()

    return run


class CaptureArchive:
    """Archives and index of a table of pages in one shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    @property
    def directory(self) -> DataFrame:
        """The sparse level: number, first key and first capture of each block."""
        return self.spark.read.parquet(f"{self.path}/directory")

    @classmethod
    def write(cls, pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> CaptureArchive:
        spark = pages.sparkSession
        small_batches(spark)
        self = cls(spark, _uri(path or new_path(spark, "warc")))
        body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
        rows = pages.select(
            F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("html"),
            F.when(F.octet_length(body) >= LEAST_REVISIT, F.sha1(body.cast("binary"))).alias("large"),
        )
        twice = rows.filter("large IS NOT NULL").groupBy("large").agg(F.max("page_id").alias("answers"), F.count("*").alias("rows"))
        twice = cut(twice.filter("rows > 1"), "warc-twice")
        small = twice.count() * 64 <= BROADCAST_BYTES  # else pages are shuffled by digest, hot digests apart
        told = rows.join(F.broadcast(twice), "large", "left") if small else attach(rows, twice, "large", "rows")
        again = F.col("rows").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answers"))
        marked = told.withColumn("revisit", again).withColumn("refers_to", F.when(again, F.col("answers")))
        files, root = _filesystem(f"{self.path}/archives")
        files.create_dir(root)
        written = marked.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(_write(f"{self.path}/archives"), MANIFEST_DDL)
        self.manifest = cut(written, "warc-manifest")
        order = self.manifest.repartitionByRange(F.col("line_key"), F.col("capture")).sortWithinPartitions("line_key", "capture")
        blocks = order.mapInArrow(_blocks(BLOCK_LINES), "first_key string, first_capture bigint, lines binary, n bigint")
        blocks = blocks.coalesce(files_for(self.manifest))
        blocks.withColumn("block", F.monotonically_increasing_id()).write.option("compression", "uncompressed").parquet(f"{self.path}/index")
        self.blocks.select("block", "first_key", "first_capture").coalesce(files_for(self.manifest)).write.parquet(f"{self.path}/directory")
        return self

    def locate(self, keys: DataFrame) -> DataFrame:
        """(line_key, capture, archive, offset, length) of captures. keys: line_key, capture; null capture asks for all of a key.

        One directory entry in SEGMENT_BLOCKS, chosen by its hash, begins a segment; only these reach the driver. Keys and
        directory meet by segment and are searched by halves there; keys of a crowded segment are dealt to several tasks.
        """
        mine = F.pmod(F.xxhash64("first_key", "first_capture"), F.lit(SEGMENT_BLOCKS)) == 0
        bounds = sorted((r.first_key, r.first_capture) for r in self.directory.filter(mine).select("first_key", "first_capture").collect())
        asked = cut(keys.select("line_key", "capture").distinct().mapInArrow(_segments(bounds), "line_key string, capture bigint, segment bigint"), "warc-asked")
        crowded = asked.groupBy("segment").agg(F.ceil(F.count("*") / SEGMENT_KEYS).alias("parts")).filter("parts > 1")
        crowded = F.broadcast(cut(crowded, "warc-crowded"))  # no more rows than segments
        directory = self.directory.select(F.col("first_key").alias("line_key"), F.col("first_capture").alias("capture"), "block")
        placed = directory.mapInArrow(_segments(bounds), "line_key string, capture bigint, segment bigint, block bigint")
        left = asked.join(crowded, "segment", "left").withColumn("part", F.pmod(F.xxhash64("line_key", "capture"), F.coalesce("parts", F.lit(1)).cast("bigint"))).drop("parts")
        right = placed.join(crowded, "segment", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1))).drop("parts")
        found = left.groupBy("segment", "part").cogroup(right.groupBy("segment", "part")).applyInArrow(_search_directory, "line_key string, capture bigint, wanted bigint")
        blocks = self.blocks.select(F.col("block").alias("of"), "lines").groupBy("of")
        return found.groupBy("wanted").cogroup(blocks).applyInArrow(_open_block, MANIFEST_DDL)

    def read(self, where: DataFrame) -> DataFrame:
        """The records at (archive, offset, length) by range reads: (page_id, url, type, payload_bytes, payload_digest, refers_to, payload)."""
        order = where.select("archive", "offset", "length").repartition("archive", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("archive", "offset")
        return order.mapInArrow(_range_read(f"{self.path}/archives"), RECORD_DDL)

    def lookup(self, urls: list[str]) -> DataFrame:
        """All captures of the given urls, read from the archives."""
        keys = self.spark.createDataFrame([(reversed_host_key(u), None) for u in urls], "line_key string, capture bigint")
        return self.read(self.locate(keys))


def _segments(bounds: list[tuple]):
    """Adds the segment of each (key, capture); a key without capture goes to every segment that can hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, segments = [], []
            for i, (key, capture) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                low = bisect.bisect_right(bounds, (key, -1 if capture is None else capture))
                high = low if capture is not None else bisect.bisect_right(bounds, (key, 1 << 63))
                at += [i] * (high - low + 1)
                segments += range(low, high + 1)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(segments, pa.int64()), *rows.columns[2:]], names=["line_key", "capture", "segment", *batch.schema.names[2:]])

    return run


def _search_directory(key: tuple, asked: pa.Table, directory: pa.Table) -> pa.Table:
    """Binary search for the blocks that can hold the asked captures, in one segment of the directory."""
    rows = sorted(zip(*(directory.column(c).to_pylist() for c in ("line_key", "capture", "block")), strict=True))
    firsts, out = [r[:2] for r in rows], []
    for line_key, capture in zip(asked.column("line_key").to_pylist(), asked.column("capture").to_pylist(), strict=True):
        low, high = ((line_key, capture),) * 2 if capture is not None else ((line_key, -1), (line_key, 1 << 63))
        first, last = bisect.bisect_right(firsts, low) - 1, bisect.bisect_right(firsts, high) - 1
        out += [(line_key, capture, rows[i][2]) for i in range(max(0, first), last + 1)]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("line_key", "capture", "wanted"), columns, (pa.string(), pa.int64(), pa.int64()), strict=True)})


def _open_block(key: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
    """Binary search for the asked captures in one block's lines."""
    out: list[tuple] = []
    for blob in blocks.column("lines").to_pylist() if asked.num_rows else []:
        lines = [x.rsplit(" ", 4) for x in zlib.decompress(blob, 31).decode("utf-8", "surrogatepass").split("\n")]
        order = [(x[0], int(x[1])) for x in lines]
        for line_key, capture in zip(asked.column("line_key").to_pylist(), asked.column("capture").to_pylist(), strict=True):
            i = bisect.bisect_left(order, (line_key, -1 if capture is None else capture))
            while i < len(order) and order[i][0] == line_key and capture in (None, order[i][1]):
                out.append((line_key, order[i][1], lines[i][2], int(lines[i][3]), int(lines[i][4])))
                i += 1
    columns = list(zip(*out, strict=True)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("line_key", "capture", "archive", "offset", "length"), columns, kinds, strict=True)})


RECORD_DDL = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _range_read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        source, open_name = None, None
        for batch in batches:
            rows, weight = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != open_name:
                    if source is not None:
                        source.close()
                    source, open_name = files.open_input_file(f"{root}/{name}"), name
                headers, payload = parse(zlib.decompress(source.read_at(length, offset), 31))
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["warc-payload-length"])):
                    raise ValueError("a payload does not match its digest")
                rows.append(
                    {
                        "page_id": _page(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": headers["warc-type"], "payload_bytes": int(headers["warc-payload-length"]),
                        "payload_digest": digest, "refers_to": _page(headers["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
                    }
                )
                weight += len(payload)
                if weight > 16_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
        if source is not None:
            source.close()

    return run


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = CaptureArchive.write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    keys = archive.manifest.select("line_key", "capture")
    return archive.read(archive.locate(keys)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS answers FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> answers THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> answers THEN answers END AS refers_to
FROM r
"""
