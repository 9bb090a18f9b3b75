"""Run metrics of single runs, index and library reports, and timeline views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import clean, safe_divide

# Stages in the order in which they run.
STAGES = ("prepare_video", "preprocess_video", "build_clips", "run_vlm_pipeline", "structuring_segments", "build_summary", "process_total")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Flat metrics of runs: shares of the total time, throughput, real-time factor; null where a divisor is
    missing or zero."""
    total = F.coalesce("total_time_sec", F.coalesce("preprocess_time_sec", F.lit(0.0)) + F.coalesce("model_time_sec", F.lit(0.0)) + F.coalesce("postprocess_time_sec", F.lit(0.0)))
    rows = runs.withColumn("total", total)
    t = F.col("total")
    return rows.select(
        "run_id",
        t.alias("total_time_sec"),
        *[safe_divide(F.col(f"{x}_time_sec"), t).alias(f"{x}_share") for x in ("preprocess", "model", "postprocess")],
        safe_divide(F.col("num_frames"), t).alias("frames_per_sec"),
        safe_divide(F.col("num_clips"), t).alias("clips_per_sec"),
        safe_divide(t, F.col("video_duration_sec")).alias("real_time_factor"),
        safe_divide(F.col("num_clips"), F.col("final_segments")).alias("compression_ratio"),
    )


# The numbers of a run's flat row, by the document that they are read from.
OWN_NUMBERS = ("video_duration_sec", "num_frames", "num_clips", "avg_clip_duration_sec", "preprocess_time_sec", "model_time_sec", "postprocess_time_sec", "total_time_sec")
EXTRA_NUMBERS = ("decode_time_sec", "source_fps", "processed_fps", "dark_drop_ratio", "lazy_drop_ratio", "blur_flag_ratio")
CLIP_NUMBERS = {"clip_frames_min": "frames_min", "clip_frames_max": "frames_max", "clip_frames_avg": "frames_avg"}
BATCH_NUMBERS = {"batch_count": "actual_batches", "batch_clips_avg": "actual_clips_avg", "batch_padding_ratio": "actual_padding_ratio", "batch_oom_retry_count": "oom_retry_count", "model_frames_per_sec": "model_frames_per_sec", "model_clips_per_sec": "model_clips_per_sec"}
TRANSLATION_SUMS = {"translation_segments_total": "segments_total", "translation_selected_candidates_total": "selected_candidates", "translation_selected_post_edited_total": "selected_post_edited"}
TIMELINE_NUMBERS = ("final_segments", "compression_ratio", "dd", "mean_segment_duration", "tcs", "srr", "sns", "sdi")


def flat_row(runs: DataFrame, timelines: DataFrame) -> DataFrame:
    """The flat row of each run: numbers out of its documents (text maps metrics, extra, clip_stats, batching), sums
    over its translations (map language -> struct(time_sec, segments_total, selected_candidates, selected_post_edited,
    summary_post_edited)) and over indexing (map language -> seconds), throughput and shares in percent, and the
    metrics of its timeline (video_id, variant, ...), null where there is none. runs also has video_id, variant,
    profile, config_fingerprint, run_language and languages (array)."""
    from tessera.functions.scalars import loose_float
    from tessera.operators.catalog import preferred_language

    def number(document: str, name: str) -> Column:
        return loose_float(F.try_element_at(F.col(document), F.lit(name)))

    told = F.map_values(F.coalesce("translations", F.create_map().cast(runs.schema["translations"].dataType)))
    times = F.filter(F.transform(told, lambda x: x["time_sec"]), lambda x: x.isNotNull())
    indexed = F.filter(F.map_values(F.coalesce("indexing", F.create_map().cast("map<string,double>"))), lambda x: x.isNotNull())

    def total(xs: Column) -> Column:
        return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x))

    def added(name: str) -> Column:
        return F.aggregate(told, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[name].cast("long"), F.lit(0)))

    rows = runs.select(
        "video_id",
        preferred_language(F.try_element_at("metrics", F.lit("language")), F.col("run_language")).alias("language"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("profile", "variant", "config_fingerprint")],
        F.array_join(F.array_sort("languages"), ",").alias("languages"),
        *[number("metrics", c).alias(c) for c in OWN_NUMBERS],
        *[number("extra", c).alias(c) for c in EXTRA_NUMBERS],
        F.try_element_at("extra", F.lit("anonymized")).alias("anonymized"),
        *[number("clip_stats", old).alias(new) for new, old in CLIP_NUMBERS.items()],
        total(times).alias("translation_total_time_sec"),
        F.size(told).alias("translation_languages_count"),
        *[added(old).alias(new) for new, old in TRANSLATION_SUMS.items()],
        F.size(F.filter(told, lambda x: F.coalesce(x["summary_post_edited"], F.lit(False)))).alias("translation_summary_post_edited_count"),
        total(indexed).alias("index_total_time_sec"),
        F.coalesce(F.size(F.map_keys("indexing")), F.lit(0)).alias("index_languages_count"),
        *[number("batching", old).alias(new) for new, old in BATCH_NUMBERS.items()],
    )
    whole = F.col("total_time_sec")
    rates = {"throughput_frames_per_sec": "num_frames", "throughput_clips_per_sec": "num_clips", "video_seconds_per_compute_second": "video_duration_sec"}
    rows = rows.withColumns({new: safe_divide(F.col(old), whole) for new, old in rates.items()} | {f"{c}_share_pct": 100.0 * safe_divide(F.col(f"{c}_time_sec"), whole) for c in ("preprocess", "model", "postprocess")})
    shape = timelines.select("video_id", F.coalesce("variant", F.lit("")).alias("variant"), *TIMELINE_NUMBERS)
    return rows.join(shape, ["video_id", "variant"], "left")


def duration(own: Column, last_end: Column) -> Column:
    """A video's duration: its own if that is positive, else the end of its last segment, else 0."""
    return F.coalesce(F.when(own > 0, own), last_end, F.lit(0.0))


def normal_fps(fps: Column) -> Column:
    """Below 1 (or missing) as 25, above 120 as 30, else rounded half to even."""
    v = F.coalesce(fps, F.lit(0.0))
    return F.when(v < 1, 25).when(v > 120, 30).otherwise(F.bround(v)).cast("int")


def frame_shares(frames: DataFrame) -> DataFrame:
    """(video_id, dark, lazy, blurred): shares of a video's raw frames by state; 0 without frames."""
    n = F.count(F.lit(1))
    return frames.groupBy("video_id").agg(*[F.coalesce(F.try_divide(F.count_if(F.col("state") == s).cast("double"), n), F.lit(0.0)).alias(s) for s in ("dark", "lazy", "blurred")])


def member_groups(segments: DataFrame) -> DataFrame:
    """(video_id, seg, members): positions of a segment's members from text that may hold other things; a
    segment without any stands for itself."""
    told = F.filter(F.transform("merged_from", lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return segments.select("video_id", "seg", F.when(F.coalesce(F.size(told), F.lit(0)) > 0, told).otherwise(F.array(F.col("seg").cast("int"))).alias("members"))


def guarded_summary(rows: DataFrame) -> DataFrame:
    """Summaries (global_summary, summary) repaired: both are the first that isn't blank, cleaned."""
    text = clean(F.coalesce(F.nullif("global_summary", F.lit("")), "summary"))
    return rows.withColumn("global_summary", text).withColumn("summary", text)


def repaired_summary(fallback: DataFrame, made: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Fallback summaries overlaid by what a model made, field by field; identity stays the fallback's."""
    rows = fallback.join(made.select("video_id", *[F.col(f).alias(f"_{f}") for f in fields]), "video_id", "left")
    return rows.select("video_id", *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def stage_rows(stats: DataFrame) -> DataFrame:
    """Stages in their usual order, others after them by name."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(10_000), "stage")
    return stats.withColumn("place", F.row_number().over(order))


def timeline_rows(segments: DataFrame, observations: DataFrame, most: int = 60) -> DataFrame:
    """(video_id, place, start_sec, text, alert): the first rows of each video's segments, or of its
    observations where it has no segments."""
    cols = ["video_id", "start_sec", "text", "alert"]
    rows = segments.select(*cols).unionByName(observations.join(segments.select("video_id").distinct(), "video_id", "left_anti").select(*cols))
    order = Window.partitionBy("video_id").orderBy("start_sec", "text")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def index_status(indexes: DataFrame) -> DataFrame:
    """The index of each (language, variant) that counts: the one with the wanted fingerprint, else the
    newest that has documents; error where there is none."""
    ok = F.col("num_docs") > 0
    order = Window.partitionBy("language", "variant").orderBy(F.desc(ok & (F.col("config_fingerprint") == F.col("wanted"))), F.desc(ok), F.desc("mtime"), "config_fingerprint")
    best = indexes.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("language", "variant", F.when(ok, F.col("config_fingerprint")).alias("config_fingerprint"), "num_docs", F.when(ok, "ready").otherwise("empty").alias("status"))


def search_report(docs: DataFrame, valid: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, reason): why a query has no hits: empty_docs, no_valid_docs_after_filter, no_candidates; or ok."""
    n = docs.agg((F.count(F.lit(1)) > 0).alias("some"))
    v = valid.agg((F.count(F.lit(1)) > 0).alias("valid"))
    hits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = queries.select("query_id").join(hits, "query_id", "left").join(F.broadcast(n)).join(F.broadcast(v))
    return rows.select("query_id", F.when(~F.col("some"), "empty_docs").when(~F.col("valid"), "no_valid_docs_after_filter").when(F.col("hits").isNull(), "no_candidates").otherwise("ok").alias("reason"), F.coalesce("hits", F.lit(0)).alias("hits"))


def expected_languages(source: Column, targets: Column) -> Column:
    """The source and each other target, once, lower case."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(source), targets), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def column_profile(rows: DataFrame) -> DataFrame:
    """(name, filled, numeric): how many values of each text column are filled, and how many are numbers."""
    from tessera.functions.scalars import loose_float

    parts = [F.struct(F.lit(c).alias("name"), F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias("filled"), F.count(loose_float(F.col(c))).alias("numeric")) for c in rows.columns]
    return rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def baselines(candidates: DataFrame, k: int) -> DataFrame:
    """(method, query_id, doc_id, rank): the candidates ranked by sparse score, dense score, reciprocal ranks
    and min-max fusion, k of each."""
    from tessera.operators.search import minmax, rrf, top

    methods = {"sparse": candidates.withColumn("score", F.coalesce("sparse", F.lit(0.0))), "dense": candidates.where("dense is not null").withColumn("score", F.col("dense")), "rrf": rrf(candidates), "minmax": minmax(candidates)}
    out = None
    for name, rows in methods.items():
        one = top(rows.withColumn("score", F.round("score", 9)), k).select(F.lit(name).alias("method"), "query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def recorded(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Running statistics of stages after each sample: count, mean and population deviation so far."""
    so_far = Window.partitionBy(*keys).orderBy("seq", "sec").rowsBetween(Window.unboundedPreceding, 0)
    return samples.select(*keys, "seq", F.count("sec").over(so_far).alias("count"), F.avg("sec").over(so_far).alias("mean"), F.stddev_pop("sec").over(so_far).alias("std"))


def document_order(files: DataFrame) -> DataFrame:
    """Of each (video_id, variant), the segment file to read: zst before gz."""
    best = F.max_by("path", F.struct(F.col("path").endswith(".zst"), "path"))
    return files.groupBy("video_id", "variant").agg(best.alias("path"))


def annotation_hits(segments: DataFrame, top_k: int) -> DataFrame:
    """The first segments (video_id, pos, ...) of each video as hits: scores 1, the caption where there is one."""
    order = Window.partitionBy("video_id").orderBy("pos")
    text = F.coalesce(F.nullif("normalized_caption", F.lit("")), "description", F.lit(""))
    rows = segments.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, top_k))
    return rows.withColumn("description", text).select("*", *[F.lit(1.0).alias(c) for c in ("score", "sparse_score", "dense_score")])


def citations(hits: DataFrame) -> DataFrame:
    """What a grounded answer tells of its hits."""
    return hits.select("video_id", F.coalesce("start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("end_sec", F.lit(0.0)).alias("end_sec"), "segment_id", "variant")
