"""Segment files, JSON documents and CSV tables of a library, and search tables.

Layout: <root>/<video_id>/outputs[/variants/<variant>]/segments/<language>.jsonl.gz or .jsonl.zst."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = r"/([^/]+)/outputs(?:/variants/([^/]+))?/"


def source_of(path: Column) -> Column:
    """struct(video_id, variant) from a file's path."""
    return F.struct(F.regexp_extract(path, PLACE, 1).alias("video_id"), F.nullif(F.regexp_extract(path, PLACE, 2), F.lit("")).alias("variant"))


def fingerprint() -> Column:
    """Size and modification time of the file that a row comes from."""
    return F.concat_ws(":", F.col("_metadata.file_size").cast("string"), F.unix_micros(F.col("_metadata.file_modification_time")).cast("string"))


def read_gz(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of gzip JSON lines with path and fingerprint; blank lines and other values than objects are passed
    over; a malformed line is an error, or with strict off is passed over too."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path"), fingerprint().alias("fingerprint"))
    value, full = F.try_parse_json("line"), F.col("line") != ""
    wrong = F.raise_error(F.concat(F.lit("malformed line in "), F.col("path"))).cast("boolean") if strict else F.lit(False)
    # one condition, so that no part of it is tried before a blank line is passed over
    rows = lines.where(F.when(~full, False).when(value.isNull(), wrong).otherwise(F.schema_of_variant(value).startswith("OBJECT")))
    return rows.select(F.from_json("line", schema).alias("_row"), "path", "fingerprint").select("_row.*", "path", "fingerprint")


def segment_glob(root: str, language: str, variant: str | None = None) -> str:
    """The pattern of the segment files of a language, of the base runs or of a variant."""
    part = f"outputs/variants/{variant}" if variant else "outputs"
    return f"{root}/*/{part}/segments/{language}.jsonl.{{gz,zst}}"


def read_zst(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of zstd JSON lines with path, position and fingerprint. A file is read as a stream of lines; blank
    lines and other values than objects are passed over; a malformed line is an error, or with strict off
    ends its file's rows."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")] if "<" not in schema else list(spark.createDataFrame([], schema).columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                out: list[dict] = []
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(row.content)) as stream:
                    for pos, line in enumerate(io.TextIOWrapper(stream, "utf-8")):
                        if not line.strip():
                            continue
                        try:
                            value = json.loads(line)
                        except ValueError:
                            if strict:
                                raise
                            break
                        if isinstance(value, dict):
                            out.append({n: value.get(n) for n in names} | {"path": row.path, "pos": pos, "fingerprint": row.fingerprint})
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=[*names, "path", "pos", "fingerprint"])
                            out = []
                yield pd.DataFrame(out, columns=[*names, "path", "pos", "fingerprint"])

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("fingerprint"))
    return files.mapInPandas(run, schema + ", path string, pos long, fingerprint string")


def write_zst(df: DataFrame, folder: str) -> int:
    """JSON lines, one zstd file a partition; the number of files. Tasks write under names of their own
    and tell them; only told files are moved to their place, so a task that runs twice leaves one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{uuid.uuid4().hex}.jsonl.zst"
        store.create_dir(f"{root}/_pending")
        with store.open_output_stream(f"{root}/_pending/{name}", compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw) as out:
            for batch in batches:
                out.write("".join(x + "\n" for x in batch["line"]).encode())
        yield pd.DataFrame({"name": [name]})

    names = [r.name for r in df.select(F.to_json(F.struct("*")).alias("line")).mapInPandas(run, "name string").collect()]
    store, root = fs.FileSystem.from_uri(folder)
    for name in names:
        store.move(f"{root}/_pending/{name}", f"{root}/{name}")
    store.delete_dir(f"{root}/_pending")
    return len(names)


def write_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def prefer_zst(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key, that of the file whose path sorts last (.zst after .gz)."""
    best = rows.groupBy(key).agg(F.max("path").alias("path"))
    return rows.join(best, [key, "path"], "left_semi")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; a file that can't be read is passed over."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return rows.where("_bad is null").drop("_bad")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV as text columns; with columns given, its header must be exactly these."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if columns is not None and rows.columns != list(columns):
        raise ValueError(f"{path}: the header differs")
    return rows


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def combined(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables one below the other, with all columns of any and where each row is from."""
    out = None
    for name, df in tables.items():
        one = df.withColumn("artifact", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def upserted(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A key-value cache with fresh rows in place of old ones."""
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def pick_video(files: DataFrame, preference: tuple[str, ...] = ("mp4", "avi", "mov", "mkv", "webm")) -> DataFrame:
    """(video_id, name): of each video's files, the first by extension, then by name."""
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    place = F.array_position(F.array(*map(F.lit, preference)), kind)
    return files.where(place > 0).groupBy("video_id").agg(F.min(F.struct(place.alias("p"), F.lower("name").alias("n"), "name")).alias("x")).select("video_id", "x.name")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
