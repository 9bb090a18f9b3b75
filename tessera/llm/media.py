"""Media columns: texts as grey images, content-addressed in tar shards.

A payload (the text's bytes, filled with zeros up to a positive multiple of 64) is stored as an
8-bit grey PNG that is 64 samples wide. Each task writes the payloads that it meets, once each, to
tar shards of its own, whose members are named by the payload's SHA-256, and hands on (digest,
shard, offset, length). Of the places where one digest lies, the least counts, so a digest has one
place and the copies that other tasks may have written (one per task at most) aren't read. Then
shards are read by ranges, by two readers: one reads the 33 bytes of a header and nothing else, and
fills the metadata columns width, height and bits; the other reads whole ranges, for digests and feature.

A task that is run again writes new shards under new names; the ones that the index doesn't name
are never read. Null texts count as empty ones; equal texts share all values, repeated rows and rows
without a doc_id come out as they come in, and an empty table gives no rows. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, short_batches, sorted_groups, stored

WIDTH = 64
#: A shard is closed after so many bytes.
SHARD_BYTES = 256 << 20
#: Places that a task remembers; past that it may store a payload again, which costs disk and no result.
PLACES = 200_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a PNG's first bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", data[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    width, height, depth, colour = header(data)
    at, packed = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not plain 8-bit grey lines")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours in a row."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    used = share[share > 0]
    grid = x.reshape(-1, WIDTH).astype(np.int16)
    step = np.abs(np.diff(grid, axis=1)).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={max(0.0, -(used * np.log2(used)).sum()):.4f};step={step:.4f}"


class Shards:
    """Tar shards that one task writes."""

    def __init__(self, folder: str) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.out, self.at = "", None, 0

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length."""
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        block = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(block)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        place = self.name, self.at + len(block), len(data)
        self.at += len(block) + len(data) + -len(data) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, digest, shard, offset, length): where each document's payload lies."""
    short_batches(docs.sparkSession)
    rows = docs.select(key, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = Shards(folder), {}
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in places:
                    if len(places) >= PLACES:
                        places.clear()
                    places[digest] = shards.add(digest.hex(), to_png(payload))
                out.append((len((text or "").encode("utf-8", "surrogatepass")), digest, *places[digest]))
            n, digest, shard, offset, length = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(shard, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=[key, "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    fields = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {fields}, n_bytes long, digest binary, shard string, offset long, length long")


def head_at(stream, digest: bytes, length: int) -> tuple:
    """Width, height and bits from a range of 33 bytes."""
    return (digest, *header(stream.read(min(length, HEADER_BYTES)))[:3])


def whole_at(stream, digest: bytes, length: int) -> tuple:
    """Digests and feature from the whole range."""
    data = stream.read(length)
    payload = from_png(data)
    return (digest, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).digest(), feature_of(payload))


def with_headers(places: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bits) from ranges of 33 bytes; nothing else of the shards is read."""
    return _read(places, folder, "digest binary, width int, height int, bits int", head_at)


def with_payloads(places: DataFrame, folder: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature); digests are binary."""
    return _read(places, folder, "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string", whole_at)


def _read(places: DataFrame, folder: str, schema: str, one) -> DataFrame:
    """One row from each (digest, shard, offset, length). Ranges are dealt out by shard and span of
    16 MB, so a large shard is read by many tasks."""
    span = F.concat_ws("/", "shard", (F.col("offset") / (16 << 20)).cast("long").cast("string"))
    rows = places.select("digest", "shard", "offset", "length", span.alias("span"))
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for _, group in sorted_groups(batches, "span"):
            out = []
            # unbuffered: a range is asked for as it is
            with store.open_input_file(f"{path}/{group.column('shard')[0].as_py()}") as stream:
                for digest, offset, length in zip(*(group.column(c).to_pylist() for c in ("digest", "offset", "length")), strict=True):
                    stream.seek(offset)
                    out.append(one(stream, digest, length))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=kinds)

    kinds = pa.schema([(x.split()[0], {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]]) for x in schema.split(", ")])
    return rows.repartition(parts, "span").sortWithinPartitions("span", "offset").mapInArrow(run, schema)


def described(docs: DataFrame) -> DataFrame:
    """Every document with its place in the shards, what the header says and what was read back."""
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    index = stored(write_shards(docs, folder), "media-index")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    places = index.groupBy("digest").agg(place).select("digest", "place.*")
    heads, wholes = with_headers(places, folder), with_payloads(places, folder)
    read = stored(places.join(heads, "digest").join(wholes, "digest"), "media-read")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("payload_sha256", "media_sha256")]
    return index.select("doc_id", "n_bytes", "digest").join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", hexed[0], "tail_crc32", "media_bytes", hexed[1], "feature", "shard", "offset", "length", "width", "height", "bits")


def tar_members(data: bytes) -> list[str]:
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return tar.getnames()
