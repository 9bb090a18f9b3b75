"""What the operators of this package share: tables, the shared folder, names of rows, streaming
groups out of sorted partitions, connected components and running sums that no single key can overload."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that tell the rows of a located() table apart.
ROW = ["_tessera_file", "_tessera_row"]
#: Rows of an Arrow batch; Spark's own 10 000 hold gigabytes where texts are long.
BATCH_ROWS = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only a local
    master without that setting (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here, and what
    happened once (files written, say) isn't done again when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW: the hash of a row's file and its place there, which name the row in every
    scan, whatever doc_ids and texts repeat or are null. What isn't a Parquet scan, with filters and
    projections at most, is written first."""

    def named(scan: DataFrame) -> DataFrame:
        place = scan.metadataColumn("_metadata")
        return scan.select(*[scan[f"`{c}`"] for c in scan.columns], F.xxhash64(place["file_path"]).alias(ROW[0]), place["row_index"].alias(ROW[1]))

    node = docs._jdf.queryExecution().analyzed()
    sure = node.deterministic()
    while node.getClass().getSimpleName() in ("Filter", "Project", "SubqueryAlias"):
        node = node.children().head()
    if sure and node.getClass().getSimpleName() == "LogicalRelation":
        try:
            return named(docs)
        except AnalysisException:  # a format whose rows have no places
            pass
    return named(stored(docs, "located"))


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they were set to something before."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def deleted(spark: SparkSession, pattern: str) -> None:
    """Removes the files and folders of a pattern."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(at) or ():
        store.delete(found.getPath(), True)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of a partition that is sorted by key; holds one group at a time."""
    kept: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_pylist()
        begin = 0
        for i in range(len(values)):
            if kept or begin < i:
                if values[i] != now:
                    if begin < i:
                        kept.append(batch.slice(begin, i - begin))
                    yield now, pa.Table.from_batches(kept)
                    kept, begin, now = [], i, values[i]
            else:
                now = values[i]
        kept.append(batch.slice(begin))
    if kept:
        yield now, pa.Table.from_batches(kept)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices, each of about so many bytes in this string or binary column, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), of any type that has an order: one row (id, component) for each
    id in an edge, component being the smallest id that can be reached.

    Each round every id takes the smallest label among its neighbours' and then the label of that
    label, so long chains shrink by more than one step. Labels and edges stay distributed, each
    round is cut off by checkpoint(), and only a count of changes reaches the driver."""
    shared_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        now = hooked.join(jump, "component").select("id", "was", F.least("component", "up").alias("component")).checkpoint()
        changed = now.where("component <> was").limit(1).count()
        labels = now.select("id", "component")
        if not changed:
            return labels


def running_sum(df: DataFrame, keys: list[str], order: list[str], place, value, cells: int, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys that come before this row.

    place is a column of [0, 1) that rises with order. Rows are first summed by (keys, cell of
    place), the few sums are added up, and only then are rows ordered, within their cell: a key
    that holds a third of all rows is cut into cells, none of which is one task's whole load."""
    cell, base = f"{out}_cell", f"{out}_base"
    df = df.withColumn(cell, F.least(F.lit(cells - 1), F.floor(place * cells).cast("int")))
    sums = df.groupBy(*keys, cell).agg(F.sum(value).alias(base))
    ahead = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(ahead), F.lit(0)))
    here = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(here), F.lit(0)))
    names = [c for c in df.columns if c not in (cell, out)]
    on = [df[c].eqNullSafe(sums[c]) for c in (*keys, cell)]
    return df.join(sums, on).select(*[df[c] for c in names], (df[out] + sums[base]).alias(out))


def cells_for(rows: int) -> int:
    """Cells for running_sum(): as many as a cell has rows, so neither rows of a cell nor sums of cells are many."""
    return max(1, math.isqrt(rows))
