"""WARC archives: written as one gzip stream a file, then normalised so that each record can be
read alone.

``write_monolithic`` writes records into .warc.gz files that are a single gzip stream. ``normalise``
inflates such a stream once, from front to back, writes every record as a gzip member of its own
and, beside the archive, a sidecar index (JSON lines: id, type, offset, length). ``read_records``
reads records by the ranges of that index.

Of records with equal payloads of at least MINIMUM bytes, the one with the smallest page_id is a
response and the others revisit it; repeated rows that share this smallest page_id are all
responses. Null html counts as empty. Rows without a page_id take part like others but are never
referred to.

Files are named anew by each attempt of a task, and only files that the written index names are
read, so a lost executor leaves nothing but unread files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import deleted, scratch, sorted_groups, stored

#: Equal payloads shorter than this aren't made revisits.
MINIMUM = 100
#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 128 << 20
READ_BYTES = 1 << 20
# Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no block, but tells its payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) from a stream of inflated bytes; holds one record at a time."""
    held = bytearray()
    need = 0
    head: dict[str, str] | None = None
    for data in chunks:
        held += data
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = parse_head(bytes(held[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            head = None
    if held:
        raise ValueError("the stream ends within a record")


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file holds, of one member or of many, in pieces."""
    engine = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def with_types(pages: DataFrame) -> DataFrame:
    """Adds digest, record_type and refers_to. Digests are counted before they are shuffled, so a
    payload that a third of all pages share is no task's whole load."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    groups = keyed.where(F.col("n") >= MINIMUM).groupBy(F.unhex("digest").alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("key", "first")
    # written first, its size is known: a short table is broadcast, a long one is met in a shuffle
    groups = stored(groups, "warc-copies")
    joined = keyed.join(groups, F.unhex("digest") == F.col("key"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_monolithic(typed: DataFrame, folder: str) -> DataFrame:
    """(archive, records): files that are one gzip stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name, size, n = f"whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = store.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                record = to_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(engine.compress(record))
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    return typed.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, first, n): each archive rewritten with a gzip member a record, and spans of its
    sidecar index, of about 4 MB each, for those who read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for whole in batch.column(0).to_pylist():
                name, at, index, spans, begin, first = f"{uuid.uuid4().hex}.warc.gz", 0, [], [], 0, 0
                with store.open_input_stream(f"{path}/{whole}", compression=None) as source, store.open_output_stream(f"{path}/{name}", compression=None) as out, store.open_output_stream(f"{path}/{name}.idx", compression=None) as sidecar:
                    for k, (head, record) in enumerate(records(inflated(source))):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        out.write(member)
                        line = json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "offset": at, "length": len(member)}).encode() + b"\n"
                        sidecar.write(line)
                        at += len(member)
                        index.append(len(line))
                        if at - begin >= 4 << 20:
                            spans.append((name, first, sum(index[first:])))
                            begin, first = at, k + 1
                    if first < len(index):
                        spans.append((name, first, sum(index[first:])))
                starts = [0]
                for x in index:
                    starts.append(starts[-1] + x)
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in spans]), pa.array([starts[x[1]] for x in spans], pa.int64()), pa.array([x[2] for x in spans], pa.int64())], names=["archive", "index_at", "index_bytes"])

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(run, "archive string, index_at long, index_bytes long")


def read_records(spans: DataFrame, folder: str) -> DataFrame:
    """One row from each record, read by the ranges that the sidecar index tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for _, group in sorted_groups(batches, "span"):
            out: dict[str, list] = {x: [] for x in kinds.names}
            for archive, index_at, index_bytes in zip(*(group.column(c).to_pylist() for c in ("archive", "index_at", "index_bytes")), strict=True):
                with store.open_input_file(f"{path}/{archive}.idx") as sidecar:
                    sidecar.seek(index_at)
                    lines = sidecar.read(index_bytes).splitlines()
                with store.open_input_file(f"{path}/{archive}") as source:
                    for line in map(json.loads, lines):
                        source.seek(line["offset"])
                        record = zlib.decompress(source.read(line["length"]), 31)
                        head_bytes, _, rest = record.partition(b"\r\n\r\n")
                        head = parse_head(head_bytes)
                        block = rest[: int(head["content-length"])]
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{archive}: damaged record at {line['offset']}")
                        page = head.get("x-page-id")
                        out["page_id"].append(None if page is None else int(page))
                        out["payload_bytes"].append(int(head["x-payload-length"]) if revisit else len(block))
                        out["payload_digest"].append(digest)
                        out["record_type"].append(head["warc-type"])
                        out["refers_to"].append(int(head["x-refers-to-page"]) if revisit else None)
                        out["archive"].append(archive)
                        out["record_offset"].append(line["offset"])
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64())])
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = spans.select("archive", "index_at", "index_bytes", F.concat_ws("/", "archive", F.col("index_at").cast("string")).alias("span"))
    return keyed.repartition(parts, "span").sortWithinPartitions("span").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long")


def archived(pages: DataFrame) -> DataFrame:
    """Every page as it is read back from normalised archives."""
    folder = scratch(pages.sparkSession, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    whole = stored(write_monolithic(with_types(pages), folder), "warc-whole")
    spans = stored(normalise(whole, folder), "warc-index")
    deleted(pages.sparkSession, f"{folder}/whole-*")
    return read_records(spans, folder)
