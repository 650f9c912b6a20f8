"""Media columns stored as content-defined chunks.

A payload is stored losslessly as a WAVE file of 8-bit samples. A rolling gear hash cuts the file where the hash of
the last bytes has its high bits clear, so equal passages give equal chunks wherever they stand. Chunk digests meet
in a Spark aggregation that names one owner for each; a file's row in the store holds its header, the bytes of the
chunks it owns, and the ordered list of all its chunks. Reading back joins the chunks a file lacks by digest, puts each list in
order, and verifies every chunk and the whole against their digests. Files equal to another's are stored and read
once. Only small lists and chunks owned elsewhere are shuffled; a file's own bytes stay where they are read. What is
broadcast is measured in bytes first; beyond that bound only keys with many rows are. Files that lack chunks are rebuilt
in groups of about GROUP_BYTES, however many there are.

Cases. A null text counts as empty: its payload is 64 zero bytes. Null and repeated ids are passed on, row by row.
Empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import BROADCAST_BYTES, small_batches
from terrane.operators.skew import attach
from terrane.session import cut, drop_path, new_path

UNIT, RATE, HEADER = 64, 8000, 44
#: Smallest, usual and largest chunk. The header is the first part of a list and always the file's own.
LEAST, USUAL, MOST = 512, 4096, 65536
#: Bytes of the files that a task rebuilds at a time.
GROUP_BYTES = 16 << 20
#: One random 64-bit number for each byte value, made from a rule.
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=64) for b in range(256)], np.uint64)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zeros to a positive multiple of UNIT, and the length without padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(size, b"\0"), len(data)


def to_wave(payload: bytes) -> bytes:
    """Each byte as an unsigned 8-bit sample of a mono WAVE file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wave(media: bytes) -> bytes:
    riff, size, wave = struct.unpack_from("<4sI4s", media)
    if riff != b"RIFF" or wave != b"WAVE" or size != len(media) - 8:
        raise ValueError("not a whole WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def gear_cuts(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash h' = 2h + GEAR[byte] keeps 64 bytes in its 64 bits; the bits that are tested depend on the last 32
    only, so all positions are hashed at once by doubling the window five times.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
    bits = int(np.log2(usual))
    spots = np.flatnonzero((h >> np.uint64(32 - bits)) & np.uint64((1 << bits) - 1) == 0) + 1
    out, start = [], 0
    while n - start > least:
        i = np.searchsorted(spots, start + least)
        end = int(spots[i]) if i < len(spots) else n
        start = min(end, start + most, n)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunk(media: bytes) -> list[bytes]:
    """The header, then the chunks of the samples."""
    ends = [HEADER, *(HEADER + e for e in gear_cuts(media[HEADER:]))]
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def features(samples: bytes) -> str:
    """Mean, deviation, zero crossings around the mean and peak of the samples, in fixed notation."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    mean = total / len(x)
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"mean={mean:.4f};deviation={max(0.0, square / len(x) - mean * mean) ** 0.5:.4f};crossings={crossings};peak={int(x.max())}"


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's media digest and ordered chunk list, without bytes."""
    for batch in batches:
        whole, digests, lengths, sizes = [], [], [], []
        for text in batch.column(1).to_pylist():
            payload, n = payload_of(text)
            media = to_wave(payload)
            parts = chunk(media)
            whole.append(_digest(media))
            digests.append([_digest(p)[:16] for p in parts])
            lengths.append(list(map(len, parts)))
            sizes.append(n)
        columns = [batch.column(0), pa.array(whole, pa.binary()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32())), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "media", "digests", "lengths", "n_bytes"])


STORE_DDL = "id bigint, many boolean, n_bytes bigint, media binary, digests array<binary>, lengths array<int>, owned array<boolean>, shared array<boolean>, data binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each file owns, compressed, beside its list; the id of its row, unless ``many`` rows have it."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        rows: list[dict] = []
        weight = 0
        for r in batch.to_pylist():
            payload, size = payload_of(r["text"])
            parts = chunk(to_wave(payload))
            foreign = set(r["foreign"] or ())
            lent = set(r["lent"] or ())
            owned = [i not in foreign for i in range(len(parts))]
            data = pack.compress(b"".join(p for p, own in zip(parts, owned, strict=True) if own))
            rows.append(
                {"id": r["id"], "many": r["many"], "n_bytes": size, "media": r["media"], "digests": [_digest(p)[:16] for p in parts], "lengths": list(map(len, parts)), "owned": owned, "shared": [i in lent for i in range(len(parts))], "data": data}
            )
            weight += len(data)
            if weight > 8_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_STORE)
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_STORE)


_STORE = pa.schema(
    [("id", pa.int64()), ("many", pa.bool_()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("owned", pa.list_(pa.bool_())), ("shared", pa.list_(pa.bool_())), ("data", pa.binary())]
)


def _own_parts(r: dict, unpack) -> dict[int, bytes]:
    data, at, parts = unpack.decompress(r["data"], max_output_size=sum(r["lengths"]) + 1), 0, {}
    for i, (own, length) in enumerate(zip(r["owned"], r["lengths"], strict=True)):
        if own:
            parts[i] = data[at : at + length]
            at += length
    return parts


def _shared_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that other files need, by digest."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        digests, parts = [], []
        for r in batch.to_pylist():
            if any(r["shared"]):
                own = _own_parts(r, unpack)
                for i, lent in enumerate(r["shared"]):
                    if lent:
                        digests.append(r["digests"][i])
                        parts.append(own[i])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(parts, pa.binary())], names=["digest", "part"])


READ_DDL = "id bigint, many boolean, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_READ = pa.schema(
    [("id", pa.int64()), ("many", pa.bool_()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _rebuild(r: dict, own: dict[int, bytes], lent: dict[bytes, bytes]) -> dict:
    parts = [own[i] if i in own else lent[d] for i, d in enumerate(r["digests"])]
    if any(_digest(p)[:16] != d for p, d in zip(parts, r["digests"], strict=True)):
        raise ValueError("a chunk does not match its digest")
    media = b"".join(parts)
    if _digest(media) != r["media"]:
        raise ValueError("a file does not match its digest")
    payload = from_wave(media)
    return {
        "id": r["id"], "many": r["many"], "n_bytes": r["n_bytes"], "media": r["media"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(media), "media_sha256": r["media"].hex(), "feature": features(payload),
    }


def _read_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            yield pa.RecordBatch.from_pylist([_rebuild(r, _own_parts(r, unpack), {}) for r in part.to_pylist()], schema=_READ)


def _read_joined(key: tuple, files: pa.Table, parts: pa.Table) -> pa.Table:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    lent: dict[bytes, dict[bytes, bytes]] = {}
    for media, digest, part in zip(parts.column("for_media").to_pylist(), parts.column("digest").to_pylist(), parts.column("part").to_pylist(), strict=True):
        lent.setdefault(media, {})[digest] = part
    rows = [_rebuild(r, _own_parts(r, unpack), lent.get(r["media"], {})) for r in files.select(_STORE.names).to_pylist()]
    return pa.Table.from_pylist(rows, schema=_READ)


class MediaStore:
    """A chunk store made from a table of texts, read back as verified media."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = BROADCAST_BYTES):
        self.spark, self.most_broadcast = docs.sparkSession, most_broadcast
        small_batches(self.spark)
        self.docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        rows = self.docs.select("id", "text").mapInArrow(_lists, "row bigint, media binary, digests array<binary>, lengths array<int>, n_bytes bigint")
        self.lists = cut(rows.withColumnRenamed("row", "id"), "media-lists")
        files = self.lists.groupBy("media").agg(F.count("*").alias("rows"), F.first("digests").alias("digests"))
        self.files = cut(files, "media-files")
        refs = self.files.select("media", F.posexplode("digests").alias("seq", "digest")).filter("seq > 0")
        once = refs.groupBy("digest").agg(F.min(F.struct("media", "seq")).alias("owner"), F.count("*").alias("uses")).filter("uses > 1")
        self.owners = cut(once, "media-owners")
        told = attach(refs, self.owners, "digest", "uses", "inner", most=self.most_broadcast)
        mine = (F.col("owner.media") == F.col("media")) & (F.col("owner.seq") == F.col("seq"))
        marks = told.groupBy("media").agg(
            F.collect_list(F.when(~mine, F.col("seq"))).alias("foreign"),
            F.collect_list(F.when(mine, F.col("seq"))).alias("lent"),
            F.collect_set(F.when(~mine, F.col("digest"))).alias("wants"),
        )
        self.marks = cut(marks, "media-marks")
        self.table = self._write()

    def _write(self) -> DataFrame:
        """One stored row for each distinct file. Texts are shuffled only where files are equal to others."""
        special = self.files.select("media", "rows").join(self.marks, "media", "left").filter("rows > 1 OR foreign IS NOT NULL")
        special = cut(special.select("media", "rows", "foreign", "lent"), "media-special")
        rows = self.docs.select("id", "text").mapInArrow(_with_media, "id bigint, text string, media binary")
        rows = attach(rows, special, "media", "rows", most=self.most_broadcast)
        columns = ("text", "media", "foreign", "lent")
        alone = rows.filter("rows IS NULL OR rows = 1").select("id", F.lit(False).alias("many"), *columns)
        some = rows.filter("rows > 1").select(F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("many"), *columns).dropDuplicates(["media"])
        self.path = new_path(self.spark, "media-store")
        alone.unionByName(some).mapInArrow(_store, STORE_DDL).write.option("compression", "uncompressed").parquet(self.path)
        return self.spark.read.schema(STORE_DDL).parquet(self.path)

    def read(self) -> DataFrame:
        """One verified row for each distinct file."""
        whole = self.table.filter("forall(owned, x -> x)").mapInArrow(_read_own, READ_DDL)
        lacking = self.table.filter("exists(owned, x -> NOT x)")
        wants = self.marks.filter("size(wants) > 0").select(F.col("media").alias("for_media"), F.explode("wants").alias("digest"))
        parts = self.table.filter("exists(shared, x -> x)").mapInArrow(_shared_chunks, "digest binary, part binary")
        parts = cut(parts.join(self.owners.select("digest", "uses"), "digest"), "media-parts")
        self.parts = parts
        got = attach(wants, parts, "digest", "uses", "inner", most=self.most_broadcast)
        total = lacking.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
        buckets = F.lit(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES)))
        left = lacking.withColumn("deal", F.pmod(F.xxhash64("media"), buckets))
        right = got.withColumn("deal_for", F.pmod(F.xxhash64("for_media"), buckets))
        joined = left.groupBy("deal").cogroup(right.groupBy("deal_for")).applyInArrow(_read_joined, READ_DDL)
        return whole.unionByName(joined)

    def report(self) -> DataFrame:
        """One row for each document. A file that only one row has carries its id; rows of other files are joined to them."""
        read = cut(self.read(), "media-read")
        drop_path(self.spark, self.parts)
        columns = [c for c in read.columns if c not in ("id", "many", "n_bytes", "media")]
        counted = cut(read.filter("many").select("media", *columns).join(self.files.select("media", "rows"), "media"), "media-counted")
        several = attach(self.lists.select("id", "media", "n_bytes"), counted, "media", "rows", "inner", most=self.most_broadcast)
        return read.filter("NOT many").select("id", "n_bytes", *columns).unionByName(several.select("id", "n_bytes", *columns))


def _with_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [_digest(to_wave(payload_of(t)[0])) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(media, pa.binary())], names=["id", "text", "media"])


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = MediaStore(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).report()
    return report.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
