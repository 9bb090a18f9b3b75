"""Exact deduplication as a stateful stream, in DataFrame operations only.

Rows are reduced to the digest of the normalised text, the stable identifier and the content locator
(file and place of the row), written, and streamed in BATCHES or more micro-batches through keyed
state that Spark keeps on disk (RocksDB) and that never expires. For each digest the state retains
the largest identifier with the locator of its content, and the number of rows. Every batch emits the
digests that it has hit again: those that were retained by a batch before, or that it holds twice.
The whole bytes of all hits are read by their locators and compared; where one digest has several
texts, rows are grouped by their bytes instead.

Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty. Of
equal texts, the row with the largest identifier stays; rows that repeat that identifier all stay. A
null identifier is less than all others; a group of nothing but nulls keeps them. An empty table gives
no rows. Other columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROW, located, scratch, stored

#: Micro-batches that a table is dealt into at least, if it has as many rows.
BATCHES = 2


def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase).cast("binary")


def digest_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def stream_hits(path: str, keyed: DataFrame, bytes_per_batch: int) -> DataFrame:
    """(digest, keep, group_size) of the digests that come more than once, after all files of a table of
    (digest, id, ROW) have been streamed through the state; keep is a struct (id, ROW)."""
    spark = keyed.sparkSession
    own = spark.newSession()
    # keys are narrow next to the rows that a session's partitions are made for
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # many small stores: no space set aside for each, and changes rather than whole files in the checkpoint
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    if path.startswith("file:"):  # local files have checksums, and the manager for other stores starts a process for each rename
        own.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")
        own.conf.set("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    out, done = scratch(spark, "dedup-hits"), scratch(spark, "dedup-stream")
    reader = own.readStream.schema(keyed.schema).option("maxBytesPerTrigger", bytes_per_batch)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.max(F.struct("id", *ROW)).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def emit(batch: DataFrame, number: int) -> None:
        batch.where("group_size > 1").write.mode("overwrite").parquet(f"{out}/batch={number}")

    none = counted(keyed.limit(0))
    none.write.parquet(f"{out}/batch=none")  # an empty stream has no batch
    query = counted(reader.parquet(path)).writeStream.outputMode("update").option("checkpointLocation", done).trigger(availableNow=True).foreachBatch(emit).start()
    query.awaitTermination()
    hits = spark.read.schema(none.schema).option("recursiveFileLookup", "true").parquet(out)
    return hits.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def folder_bytes(spark, path: str) -> int:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def resolved_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(ROW, digest, id, keep_id, group_size) of each row of a located() table."""
    spark = docs.sparkSession
    path = scratch(spark, "dedup-keys")
    keys = docs.select(digest_of(normalised(text)).alias("digest"), F.col(key).cast("long").alias("id"), *ROW)
    keys.write.option("maxRecordsPerFile", max(1, math.ceil(docs.count() / batches))).parquet(path)
    keyed = spark.read.schema(keys.schema).parquet(path)
    hits = stream_hits(path, keyed, max(1, math.ceil(folder_bytes(spark, path) / batches)))
    found = stored(keyed.join(hits, "digest", "left"), "dedup-rows")
    again = found.where("group_size is not null").select(*ROW, "digest")
    texts = docs.select(*ROW, normalised(text).alias("bytes")).join(again, ROW)
    mixed = stored(texts.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least <> most").select("digest"), "dedup-mixed")
    rows = found.select(*ROW, "digest", "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if mixed.isEmpty():
        return rows
    # several texts have one digest: their rows are grouped by the bytes
    apart = texts.join(mixed, "digest")
    ids = apart.join(found.select(*ROW, "id"), ROW)
    forms = ids.groupBy("digest", "bytes").agg(F.max("id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    own = ids.join(forms, ["digest", "bytes"]).select(*ROW, F.lit(True).alias("_own"), "_keep", "_size")
    joined = rows.join(own, ROW, "left")
    return joined.select(*ROW, "digest", "id", F.when(F.col("_own"), F.col("_keep")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"))


def resolved(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    rows = resolved_rows(located(docs), key, text, batches)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that another row stands for; all columns stay as they are."""
    rows = located(docs)
    dropped = resolved_rows(rows, key, text).where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(*ROW)
    return rows.join(dropped, ROW, "left_anti").drop(*ROW)
