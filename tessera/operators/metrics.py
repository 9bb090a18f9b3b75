"""Run metrics: grouped statistics, stage reports, roll-ups, comparison ranking, final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(name: str) -> Column:
    """struct(count, mean, std): population deviation; mean and std are null without values."""
    c = F.col(name)
    return F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))


def run_stats(runs: DataFrame, keys: list[str], fields: list[str], video: str = "video_id") -> DataFrame:
    """Per group, or over all rows without keys: runs, sorted distinct videos that aren't blank, statistics."""
    videos = F.sort_array(F.collect_set(F.when(F.trim(F.coalesce(F.col(video).cast("string"), F.lit(""))) != "", F.col(video).cast("string"))))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), videos.alias("videos"), *[stats(f).alias(f) for f in fields])


def stage_report(samples: DataFrame) -> DataFrame:
    """Stage statistics over the whole system and by (profile, variant), in one pass of grouping sets.
    samples has (profile, variant, stage, sec)."""
    sec = F.col("sec")
    values = [F.count(sec).alias("n"), F.avg(sec).alias("mean"), F.stddev_pop(sec).alias("std"), F.min(sec).alias("least"), F.max(sec).alias("most"), F.median(sec).alias("median")]
    stage, profile, variant = (F.col(c) for c in ("stage", "profile", "variant"))
    out = samples.groupingSets([[stage], [profile, variant, stage]], profile, variant, stage).agg(F.grouping("profile").alias("_whole"), *values)
    return out.select(F.when(F.col("_whole") == 1, "system").otherwise("profile_variant").alias("scope"), "profile", "variant", "stage", "n", "mean", "std", "least", "most", "median")


def stage_values(runs: DataFrame, keys: list[str], stages: str) -> DataFrame:
    """(keys, stage, sec) from a map stage -> struct(mean_sec, time_sec): the mean where there is one."""
    rows = runs.select(*keys, F.explode(stages).alias("stage", "v"))
    return rows.select(*keys, "stage", F.coalesce("v.mean_sec", "v.time_sec").alias("sec")).where("sec is not null")


def with_default_stages(runs: DataFrame, stages: str, scalars: dict[str, str]) -> DataFrame:
    """Where the stage map is empty, one is made of scalar times."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.struct(F.col(c).alias("mean_sec"), F.col(c).alias("time_sec")).alias("value")) for k, c in scalars.items()]), lambda e: e["value"]["time_sec"].isNotNull())
    made = F.map_from_entries(entries).cast(runs.schema[stages].dataType)
    return runs.withColumn(stages, F.when(F.coalesce(F.size(stages), F.lit(0)) > 0, F.col(stages)).otherwise(made))


def map_total(values: Column, missing: float | None) -> Column:
    """The sum of a map's numbers, or ``missing`` if there is none."""
    xs = F.filter(F.map_values(values), lambda x: x.isNotNull())
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(missing).cast("double"))


def latest(rows: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The row of each key with the latest time; of equal times, the later row."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scaled(name: str) -> Column:
    """Min-max over all rows; 0.5 where all are (nearly) equal; null stays."""
    w = Window.partitionBy()
    lo, hi, c = F.min(name).over(w), F.max(name).over(w), F.col(name)
    near = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
    return F.when(c.isNotNull(), F.when(near, 0.5).otherwise((c - lo) / (hi - lo)))


def compared(configs: DataFrame, w_quality: float, w_latency: float, w_cost: float, seq: str = "config_key") -> DataFrame:
    """Configurations (a short table) with scaled quality, latency and cost, balanced score and rank."""
    rows = configs.select("*", *[scaled(c).alias(f"{c}_norm") for c in ("quality", "latency", "cost")])
    q, l, c = (F.coalesce(F.col(f"{x}_norm"), F.lit(0.0)) for x in ("quality", "latency", "cost"))
    rows = rows.withColumn("balanced_score", w_quality * q - w_latency * l - w_cost * c)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("balanced_score"), seq)))


def quality(segments: DataFrame, keys: list[str], summary: Column) -> DataFrame:
    """Shares of structured, enriched and flagged segments, and the proxy that weighs them."""

    def filled(c: str) -> Column:
        return F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "")

    structured = (F.lower(F.trim("event_type")) != "unclassified") | (F.lower(F.trim("risk_level")) != "normal") | F.col("anomaly_flag")
    share = {"structured_ratio": structured, "enrichment_ratio": filled("tags") | filled("objects"), "anomaly_ratio": F.col("anomaly_flag")}
    rows = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments_total"), *[F.avg(c.cast("double")).alias(n) for n, c in share.items()], F.max(summary.cast("double")).alias("summary_present"))
    return rows.withColumn("quality_proxy_raw", 0.5 * F.col("structured_ratio") + 0.3 * F.col("enrichment_ratio") + 0.2 * F.col("summary_present"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def final_aggregation(runs: DataFrame) -> DataFrame:
    """Per (dataset_id, variant), over runs with clips and segments; missing numbers count as 0 and are part
    of means. Compression is a ratio of sums."""
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("num_clips", "final_segments", "video_duration_sec", "total_time_sec", "model_time_sec", "dd", "tcs")]
    valid = runs.select("dataset_id", "variant", *zero).where("num_clips > 0 and final_segments > 0")
    total, duration = F.sum("total_time_sec"), F.sum("video_duration_sec")
    return valid.groupBy("dataset_id", "variant").agg(
        F.count(F.lit(1)).alias("videos_processed"),
        total.alias("total_runtime_sec"),
        F.avg("total_time_sec").alias("mean_runtime_sec"),
        ratio(total, duration).alias("real_time_factor"),
        ratio(duration, total).alias("video_seconds_per_compute_second"),
        (100 * ratio(F.sum("model_time_sec"), total)).alias("model_share_pct"),
        ratio(F.sum("num_clips"), F.sum("final_segments")).alias("compression_ratio"),
        F.avg("dd").alias("dd"),
        F.avg("tcs").alias("tcs"),
    )


def dataset_scale(manifest: DataFrame, valid: DataFrame) -> DataFrame:
    """Per dataset: videos, processed, excluded, hours, scenes (blank ones aren't counted)."""
    marked = manifest.join(valid.select("video_id").distinct().withColumn("ok", F.lit(True)), "video_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    hours = F.coalesce("duration_sec", F.lit(0.0)) / 3600
    return marked.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("videos_total"), F.count_if("ok").alias("videos_processed"), F.count_if(~F.col("ok")).alias("videos_excluded"), F.sum(hours).alias("duration_hours_total"), F.sum(F.when(F.col("ok"), hours).otherwise(0.0)).alias("duration_hours_processed"), F.countDistinct(F.when(F.trim("scene_id") != "", F.col("scene_id"))).alias("scenes"))


def ablation_means(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means by identity; a blank key or a missing number is an error."""
    for k in keys:
        c = F.col(k)
        rows = rows.withColumn(k, F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.raise_error(F.lit(f"blank {k}"))).otherwise(c))
    checked = [F.avg(F.when(F.col(m).isNull(), F.raise_error(F.lit(f"missing {m}"))).otherwise(F.col(m))).alias(m) for m in metrics]
    return rows.groupBy(*keys).agg(*checked)


def missing_levels(rows: DataFrame, keys: list[str], column: str, grid: list) -> DataFrame:
    """Levels of the grid that an identity hasn't measured."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_except(F.array(*map(F.lit, grid)), F.collect_set(column))).alias("missing"))


def capsules(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, capsules): the top two event types, the top risk, people and motion, and the top two notes of
    flagged rows; of equal counts the first seen; each once in any case, at most eight."""
    parts = []
    for order, (name, top) in enumerate((("event_type", 2), ("risk_level", 1), ("people_count_bucket", 1), ("motion_type", 1))):
        parts.append(rows.select(key, F.lit(order).alias("o"), F.lit(top).alias("top"), F.trim(name).alias("v"), F.col(pos).alias("p"), F.lit(0).alias("q")))
    noted = rows.where("anomaly_flag").select(key, F.lit(4).alias("o"), F.lit(2).alias("top"), F.col(pos).alias("p"), F.posexplode("anomaly_notes").alias("q", "n"))
    parts.append(noted.select(key, "o", "top", F.trim("n").alias("v"), "p", "q"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = every.where("v <> ''").groupBy(key, "o", "top", "v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "q")).alias("first"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(key, "o").orderBy(F.desc("n"), "first"))).where("r <= top")
    once = ranked.withColumn("k", F.row_number().over(Window.partitionBy(key, F.lower("v")).orderBy("o", "r"))).where("k = 1")
    return once.groupBy(key).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("o", "r", "v"))), lambda x: x["v"]), 1, 8).alias("capsules"))


def summaries(segments: DataFrame) -> DataFrame:
    """Per video: the first ten citations, risks of the first five segments, key events of the first three,
    share of people (the first five over all), and the text: the first three distinct captions and how
    many segments need attention."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))
    rows = segments.withColumn("n", n).withColumn("text", F.trim("description"))
    first = F.col("n") <= 5
    risks = [F.count_if(first & (F.col("risk_level") == r)).alias(r) for r in ("normal", "attention", "warning", "critical")]
    facts = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= 10, F.struct("n", "segment_id")))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "event_type")))).alias("e"),
        F.struct(*risks).alias("risks"),
        F.count_if(first & (F.col("people_count_bucket") != "none")).alias("people"),
        F.count_if(F.col("anomaly_flag") | (F.col("risk_level") != "normal")).alias("attention"),
    )
    seen = rows.where("text <> ''").groupBy("video_id", "text").agg(F.min("n").alias("n"))
    heads = seen.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy("n"))).where("r <= 3").groupBy("video_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"])).alias("head"))
    alert = F.when(F.col("attention") > 0, F.concat(F.col("attention").cast("string"), F.lit(" segment(s) require attention based on visible anomaly signals.")))
    text = F.concat_ws(" ", F.nullif("head", F.lit("")), alert)
    return facts.join(heads, "video_id", "left").select("video_id", "total", F.transform("c", lambda x: x["segment_id"]).alias("citations"), F.transform("e", lambda x: x["event_type"]).alias("key_events"), "risks", (F.col("people") / F.col("total")).alias("people_ratio"), F.when(text == "", "No significant activity was detected in the processed video.").otherwise(text).alias("summary"))


def batch_state(jobs: DataFrame, key: str) -> DataFrame:
    """done if all are, failed if any is, running if any is; else what it was (queued)."""
    s = F.col("state")
    return jobs.groupBy(key).agg(F.when(F.every(s == "done"), "done").when(F.some(s == "failed"), "failed").when(F.some(s == "running"), "running").otherwise("queued").alias("state"))
