"""Explicit schemas, and builders of rows that have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION = "clip_id string, video_id string, start_sec double, end_sec double, description string, anomaly_flag boolean, anomaly_confidence double, anomaly_notes array<string>"
SEGMENT = (
    "schema_version string, video_id string, segment_id string, start_sec double, end_sec double, language string, raw_caption string, normalized_caption string, event_type string, "
    "risk_level string, tags array<string>, objects array<string>, people_count_bucket string, motion_type string, anomaly_flag boolean, anomaly_confidence double, anomaly_notes array<string>, "
    "severity_reason string, needs_attention boolean, evidence struct<keyframe_path:string>, preprocessing_meta struct<fps:double,resize:string,dark_drop_ratio:double,lazy_drop_ratio:double,"
    "blur_flag_ratio:double,anonymized:boolean>, translation_meta struct<available_languages:array<string>,translated_from:string,mt_engine:string,post_edited_by_llm:boolean>, "
    "extra struct<merge_group_id:string,merged_from:array<int>>, description string"
)
HIT = "query_id long, video_id string, language string, start_sec double, end_sec double, description string, score double, sparse_score double, dense_score double, segment_id string, variant string"
LABEL = "query_id string, label_id string, video_id string, segment_id string, start_sec double, end_sec double, grade double"
JOB = "job_id string, video_id string, job_type string, profile string, variant string, language string, source_language string, state string, stage string, progress double, created_at double, updated_at double, started_at double, finished_at double, lease_until double"


def named_rows(rows: DataFrame, prefix: str, column: str, first: int, digits: int, order: list[str], key: str = "video_id") -> DataFrame:
    """Adds an identifier by position within each video: prefix and so many digits, counted from first."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1 + first
    return rows.withColumn(column, F.format_string(f"{prefix}%0{digits}d", n))


def observations(rows: DataFrame) -> DataFrame:
    """Clip observations, named clip_000001 and on."""
    named = named_rows(rows, "clip_", "clip_id", 1, 6, ["start_sec", "end_sec"])
    kinds = dict(x.split(" ", 1) for x in OBSERVATION.split(", "))
    return named.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def segments(merged: DataFrame, language: str, fps: float = 0.0) -> DataFrame:
    """Merged observations (video_id, start_sec, end_sec, description, anomaly_*, merged_from) as segments with
    the defaults that enrichment replaces."""
    named = named_rows(merged, "seg_", "segment_id", 1, 6, ["start_sec", "end_sec"])
    text, none = F.col("description"), F.array().cast("array<string>")
    zero, flag = F.lit(0.0), F.coalesce("anomaly_flag", F.lit(False))
    values = {
        "schema_version": F.lit("2.0"), "language": F.lit(language), "raw_caption": text, "normalized_caption": text, "event_type": F.lit("unclassified"), "risk_level": F.lit("normal"), "tags": none, "objects": none,
        "people_count_bucket": F.lit("none"), "motion_type": F.lit("stable"), "anomaly_flag": flag, "anomaly_confidence": F.coalesce("anomaly_confidence", zero), "anomaly_notes": F.coalesce("anomaly_notes", none), "severity_reason": F.lit(""), "needs_attention": flag,
        "evidence": F.struct(F.lit(None).cast("string").alias("keyframe_path")), "preprocessing_meta": F.struct(F.lit(fps).alias("fps"), F.lit("").alias("resize"), zero.alias("dark_drop_ratio"), zero.alias("lazy_drop_ratio"), zero.alias("blur_flag_ratio"), F.lit(False).alias("anonymized")),
        "translation_meta": F.struct(F.array(F.lit(language)).alias("available_languages"), F.lit(None).cast("string").alias("translated_from"), F.lit(None).cast("string").alias("mt_engine"), F.lit(False).alias("post_edited_by_llm")),
        "extra": F.struct(F.lit(None).cast("string").alias("merge_group_id"), F.col("merged_from").alias("merged_from")),
    }
    names = [f.name for f in merged.sparkSession.createDataFrame([], SEGMENT).schema]
    return named.select(*[values[c].alias(c) if c in values else F.col(c) for c in names])
