"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters whole records into buckets of about BUCKET_BYTES by a seeded hash of key, text and
the row's place in its file, so that copies of one row are scattered too. Pass two orders each bucket
by that hash, so that nothing depends on how rows arrived, shuffles it in memory (Spark's shuffle() is
a Fisher-Yates shuffle of an array) and writes it. A record's place is its bucket's offset plus its
place in the bucket; shard k holds the k-th run of places, and the runs' lengths differ by one at most
(law ``rows``).

The number of buckets follows from the bytes, so a bucket fits in memory at any size; a text longer
than a bucket is a bucket's whole load. Offsets are summed in two levels, so no task meets all buckets.
Null keys and texts are hashed like others; a null text has 16 bytes and the checksum 0. An empty table
gives no rows. Columns may have any type and name; shard and slot replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tessera.llm.common import ROW, located, stored

BUCKET_BYTES = 8 << 20
OVERHEAD = 16
SEED = 20240229
#: Buckets whose offsets are summed together before those of all.
OFFSET_CELL = 4096


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def hashable(kind: DataType) -> bool:
    """Whether a column's values have a hash."""
    if isinstance(kind, StructType):
        return all(hashable(x.dataType) for x in kind)
    return hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def offsets_of(scattered: DataFrame) -> DataFrame:
    """(_bucket, _offset): rows in the buckets before, by cells of buckets and then within each cell."""
    ahead = (Window.unboundedPreceding, -1)
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.floor(F.col("_bucket") / OFFSET_CELL))
    inner = F.sum("_n").over(Window.partitionBy("_cell").orderBy("_bucket").rowsBetween(*ahead))
    cells = counts.groupBy("_cell").agg(F.sum("_n").alias("_all"))
    before = cells.select("_cell", F.coalesce(F.sum("_all").over(Window.orderBy("_cell").rowsBetween(*ahead)), F.lit(0)).alias("_base"))
    within = counts.select("_bucket", "_cell", F.coalesce(inner, F.lit(0)).alias("_inner"))
    return within.join(before, "_cell").select("_bucket", (F.col("_base") + F.col("_inner")).alias("_offset"))


def shuffled(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs, written in shuffled order, with the columns shard (int) and slot (long)."""
    docs = docs.drop("shard", "slot")
    total, rows = docs.agg(F.sum(size_of(text)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((total or 0) / BUCKET_BYTES))
    every = [f"`{x.name}`" for x in docs.schema if hashable(x.dataType)]
    places = located(docs).select(F.xxhash64(F.lit(seed), key, text, ROW[1]).alias("_rank"), F.xxhash64(*every).alias("_tie"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"))
    # the low part of the hash deals rows out, the whole of another orders them
    scattered = places.select(F.pmod("_rank", F.lit(buckets)).cast("int").alias("_bucket"), F.struct(F.xxhash64("_rank").alias("rank"), F.col("_tie").alias("tie"), F.col("_row").alias("row")).alias("_item"))

    def earlier(a: Column, b: Column) -> Column:
        first, second = (F.when(a[c] < b[c], -1).when(a[c] > b[c], 1) for c in ("rank", "tie"))
        return F.coalesce(first, second, F.lit(0))

    # each bucket's offset travels to it as a row of its own
    kind = scattered.schema["_item"].dataType
    offsets = offsets_of(scattered).select("_bucket", F.lit(None).cast(kind).alias("_item"), "_offset")
    dealt = scattered.withColumn("_offset", F.lit(None).cast("long")).unionByName(offsets).repartitionById(buckets, "_bucket")
    whole = dealt.groupBy("_bucket").agg(F.array_sort(F.collect_list("_item"), earlier).alias("_items"), F.max("_offset").alias("_offset"))
    placed = whole.select("_offset", F.posexplode(F.shuffle("_items", F.lit(seed))))
    place = F.col("_offset") + F.col("pos")
    least, more = divmod(rows, shards)
    full = more * (least + 1)
    early = place < full
    shard = F.when(early, F.floor(place / (least + 1))).otherwise(more + F.floor((place - full) / max(1, least)))
    slot = F.when(early, place % (least + 1)).otherwise((place - full) % max(1, least))
    return stored(placed.select(*[F.col("col")["row"][c].alias(c) for c in docs.columns], shard.cast("int").alias("shard"), slot.cast("long").alias("slot")), "shards")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where each document lies, from the shards as they were written."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shuffled(docs, shards).select("doc_id", size_of("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
