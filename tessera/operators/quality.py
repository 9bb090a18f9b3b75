"""Checks of manifests, artifacts and runs; differences between states of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import loose_float

# The columns of a dataset manifest, in order.
MANIFEST = ("dataset_id", "video_id", "source_path", "prepared_video_path", "split", "scene_id", "label_type", "has_anomaly", "duration_sec", "fps", "width", "height", "num_frames", "notes")
REQUIRED = ("dataset_id", "video_id", "source_path", "split")
POSITIVE = ("duration_sec", "fps", "width", "height")


def manifest_errors(rows: DataFrame, mock: bool = False) -> DataFrame:
    """(video_id, errors): what is wrong with each row of a manifest whose columns are all text; rows without
    errors are left out."""
    if missing := [c for c in MANIFEST if c not in rows.columns]:
        raise ValueError(f"manifest lacks {', '.join(missing)}")

    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""

    path = F.lower(F.trim("source_path"))
    counted = rows.withColumn("_ids", F.count(F.lit(1)).over(Window.partitionBy("video_id"))).withColumn("_path", path).withColumn("_paths", F.count(F.lit(1)).over(Window.partitionBy("_path")))
    tests = [F.when(blank(c), f"blank {c}") for c in REQUIRED]
    tests += [F.when(~blank("video_id") & (F.col("_ids") > 1), "duplicate video_id"), F.when(~blank("source_path") & (F.col("_paths") > 1), "duplicate source_path")]
    if not mock:
        tests.append(F.when(path.startswith("mock://"), "mock source"))
    tests += [F.when(~F.coalesce(loose_float(F.col(c)) > 0, F.lit(False)), f"{c} isn't positive") for c in POSITIVE]
    return counted.withColumn("errors", F.array_compact(F.array(*tests))).where(F.size("errors") > 0).select("video_id", "errors")


def merged_manifests(manifests: list[DataFrame]) -> DataFrame:
    """All rows; an error when a video or a source (in any case) comes twice."""
    for m in manifests:
        if tuple(m.columns) != MANIFEST:
            raise ValueError("manifest columns differ")
    every = manifests[0]
    for m in manifests[1:]:
        every = every.union(m)
    ids = F.count(F.lit(1)).over(Window.partitionBy("video_id"))
    paths = F.count(F.lit(1)).over(Window.partitionBy(F.lower(F.trim("source_path"))))
    checked = every.withColumn("_n", F.greatest(ids, paths))
    return checked.withColumn("video_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate: "), F.col("video_id")))).otherwise(F.col("video_id"))).drop("_n")


def slice_of(rows: DataFrame, order: str, first: str | None = None, last: str | None = None, most: int | None = None) -> DataFrame:
    """Rows in order from the first named video to the last, both included, at most so many. Names are found
    by their places in the order, so no row waits for those before it."""
    key, out = F.col("video_id"), rows
    if first is not None:
        begin = rows.where(key == first).agg(F.min(order).alias("_a"))
        out = out.join(F.broadcast(begin)).where(F.col(order) >= F.col("_a")).drop("_a")
    if last is not None:
        end = rows.where(key == last).agg(F.min(order).alias("_b"))
        out = out.join(F.broadcast(end)).where(F.col("_b").isNull() | (F.col(order) <= F.col("_b"))).drop("_b")
    return out if most is None else out.orderBy(order).limit(most)


def artifact_class(status: Column, has_manifest: Column, missing: Column, corrupted: Column, scope: str = "process") -> Column:
    """complete, or the first reason why not; missing and corrupted are arrays of names."""
    whole = (F.size(missing) == 0) & (F.size(corrupted) == 0)
    ready = F.coalesce(status == "ready", F.lit(False))
    return F.when(ready & whole, "complete").when(~has_manifest, "missing_manifest").when(ready, "manifest_ready_but_incomplete").when(F.size(corrupted) > 0, "corrupted_artifact").otherwise(f"incomplete_{scope}")


def run_class(documented: Column, exists: Column, clips: Column, segments: Column) -> Column:
    """struct(status, action) of a run."""

    def told(status: str, action: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(action).alias("action"))

    valid = F.coalesce((clips > 0) & (segments > 0), F.lit(False))
    return F.when(exists & valid, told("done_valid", "none")).when(documented, told("excluded_documented", "none")).when(exists, told("invalid", "rerun")).otherwise(told("missing", "run"))


def file_changes(now: DataFrame, known: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """(path, change): new, changed, same or deleted by fingerprint; with keep_deleted, files that went are
    passed over."""
    both = now.select("path", F.col("fingerprint").alias("a")).join(known.select("path", F.col("fingerprint").alias("b")), "path", "full")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    out = both.select("path", change.alias("change"))
    return out.where("change <> 'deleted'") if keep_deleted else out


def updated_docs(docs: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Search documents after an update: all rows of changed, new and deleted files go, fresh rows come."""
    gone = changes.where("change <> 'same'").select("path")
    added = fresh.join(changes.where("change in ('new', 'changed')").select("path"), "path", "left_semi")
    return docs.join(gone, "path", "left_anti").unionByName(added)


def to_embed(docs: DataFrame, changed: DataFrame, old: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, missing): vectors that are taken over (from unchanged documents, then from the cache by hash),
    and documents (doc_id, hash) that must be embedded."""
    rows = docs.select("doc_id", "hash").join(changed.select("doc_id", F.lit(True).alias("_changed")), "doc_id", "left")
    prior = rows.join(old.select("doc_id", F.col("vector").alias("_old")), "doc_id", "left").withColumn("_old", F.when(F.col("_changed").isNull(), F.col("_old")))
    both = prior.join(cache.select("hash", F.col("vector").alias("_cached")), "hash", "left").select("doc_id", "hash", F.coalesce("_old", "_cached").alias("vector"))
    return both.where("vector is not null"), both.where("vector is null").select("doc_id", "hash")


def dataset_of(rows: DataFrame) -> DataFrame:
    """(video_id, dataset_id); a video in two datasets is an error."""
    grouped = rows.groupBy("video_id").agg(F.min("dataset_id").alias("dataset_id"), F.countDistinct("dataset_id").alias("n"))
    return grouped.select("video_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflict: "), F.col("video_id").cast("string")))).otherwise(F.col("dataset_id")).alias("dataset_id"))
