"""Artifacts of a library as data: documents merged, states by language, outputs of a video, targets of
experiments, imports and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import loose_float

# States of a language's outputs that are good or bad ends.
SUCCESS, FAILED = ("ready", "done"), ("failed", "error")
PLACEHOLDERS = ("unknown", "unset", "none", "null")
REQUIRED = ("clip_observations", "metrics", "run_manifest")


def merged_documents(old: Column, new: Column) -> Column:
    """A document (map of sections to maps) updated one level deep: keys of a section replace its own, sections
    that the update lacks stay."""
    old, new = (F.coalesce(c, F.create_map().cast("map<string,map<string,string>>")) for c in (old, new))

    def over(a: Column, b: Column) -> Column:
        a, b = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (a, b))
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return F.map_zip_with(old, new, lambda _, a, b: over(a, b))


def language_states(events: DataFrame) -> DataFrame:
    """(video_id, variant, language, fields...): the manifest entry of each language after all events (video_id,
    variant, language, at, seq, and any fields): of each field the last value that isn't blank."""
    keys = ["video_id", "variant", "language"]
    fields = [c for c in events.columns if c not in (*keys, "at", "seq")]
    order = F.struct("at", "seq")
    latest = [F.max_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", order)).alias(c) for c in fields]
    return events.groupBy(*keys).agg(F.max("at").alias("updated_at"), *latest)


def variant_index(states: DataFrame) -> DataFrame:
    """(video_id, variant, updated_at, languages): what a video's root manifest tells of its variants."""
    return states.where(F.coalesce("variant", F.lit("")) != "").groupBy("video_id", "variant").agg(F.max("updated_at").alias("updated_at"), F.array_sort(F.collect_set("language")).alias("languages"))


def readiness(states: DataFrame, expected: DataFrame, since: float) -> DataFrame:
    """(video_id, variant, ready, failures): whether all expected languages (video_id, variant, language) have come
    to an end since a time, and those that failed."""
    rows = expected.alias("e").join(states.alias("s"), [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("video_id", "variant", "language")], "left")
    status = F.lower(F.trim(F.coalesce("s.status", F.lit(""))))
    fresh = F.coalesce(F.col("s.updated_at") >= since, F.lit(False))
    failed = fresh & status.isin(*FAILED)
    failure = F.when(failed, F.concat_ws(":", "e.language", status))
    return rows.groupBy("e.video_id", "e.variant").agg(F.every(fresh & status.isin(*SUCCESS, *FAILED)).alias("ready"), F.array_sort(F.collect_list(failure)).alias("failures"))


def outputs(videos: DataFrame, parts: dict[str, DataFrame], lists: dict[str, DataFrame]) -> DataFrame:
    """All that is stored of each video (video_id, variant, language): from each of parts, one row by those of
    these keys that it has, as a struct, and from each of lists, its rows in order of pos. What is missing is
    null, or an empty list."""
    out = videos
    for name, rows in {**parts, **lists}.items():
        keys = [c for c in ("video_id", "variant", "language") if c in rows.columns]
        fields = [c for c in rows.columns if c not in keys]
        body = F.struct(*fields)
        if name in lists:
            side = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"]))).alias(name))
        else:
            side = rows.groupBy(*keys).agg(F.min(body).alias(name))
        side = side.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
        out = out.join(side, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
        if name in lists:
            kind = side.schema[name].dataType
            out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def targets(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, skipped) from rows (video_id, variant, artifact): a video's variants win over its base run; runs
    that lack a required artifact are skipped, with what they lack."""
    variant = F.coalesce("variant", F.lit(""))
    runs = artifacts.groupBy("video_id", variant.alias("variant")).agg(F.collect_set("artifact").alias("_have"))
    varied = F.max(F.col("variant") != "").over(Window.partitionBy("video_id"))
    wanted = runs.withColumn("_varied", varied).where(~F.col("_varied") | (F.col("variant") != ""))
    rows = wanted.select("video_id", "variant", F.concat_ws("_", "video_id", F.nullif("variant", F.lit(""))).alias("run_id"), F.array_except(F.array(*map(F.lit, REQUIRED)), "_have").alias("missing"))
    return rows.where("size(missing) = 0").drop("missing"), rows.where("size(missing) > 0")


def experiment_targets(results: DataFrame) -> DataFrame:
    """(target_id, video_id, profile, variant, run_idx) of the results (status, profile, video_id, run_idx, unit_key,
    variant, variant_results: map, seq) that are done: one for each variant of a result, or the result's own; each
    (video, profile, variant, run, unit) once, the first that comes."""
    def token(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))

    done = results.where(token("status") == "done")
    several = F.size(F.map_keys(F.coalesce("variant_results", F.create_map().cast("map<string,string>")))) > 0
    names = F.when(several, F.transform(F.map_keys("variant_results"), lambda x: F.lower(F.trim(x)))).otherwise(F.array(token("variant")))
    profile = F.coalesce(F.nullif(token("profile"), F.lit("")), F.lit("main"))
    rows = done.select("seq", F.trim(F.coalesce("video_id", F.lit(""))).alias("video_id"), profile.alias("profile"), F.coalesce("run_idx", F.lit(1)).alias("run_idx"), F.coalesce("unit_key", F.lit("")).alias("unit_key"), several.alias("_several"), F.posexplode(names).alias("_i", "variant"))
    order = Window.partitionBy("video_id", "profile", "variant", "run_idx", "unit_key").orderBy("seq", "_i")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    own = F.concat(F.col("profile"), F.lit(":"), F.coalesce(F.nullif("variant", F.lit("")), F.lit("base")), F.lit(":"), F.col("video_id"), F.lit(":run"), F.col("run_idx").cast("string"))
    name = F.when(F.col("_several"), F.concat("unit_key", F.lit("__"), "variant")).otherwise(F.coalesce(F.nullif("unit_key", F.lit("")), own))
    return rows.select(name.alias("target_id"), "video_id", "profile", "variant", "run_idx")


def preferred_language(own: Column, run: Column) -> Column:
    """A run's language: its own unless that is a placeholder, then the manifest's, else what there is."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (own, run))
    return F.when((a != "") & ~a.isin(*PLACEHOLDERS), a).when((b != "") & ~b.isin(*PLACEHOLDERS), b).otherwise(F.coalesce(F.nullif(a, F.lit("")), b))


def selected_runs(runs: DataFrame, profile: str = "", variant: str = "") -> DataFrame:
    """Runs of a profile and a variant, in any case; a blank name selects all."""
    out = runs
    for name, wanted in (("profile", profile), ("variant", variant)):
        if wanted.strip():
            out = out.where(F.lower(F.trim(F.coalesce(name, F.lit("")))) == wanted.strip().lower())
    return out


def metrics_summary(runs: DataFrame) -> DataFrame:
    """(video_id, language, variant, profile, config_fingerprint, timings, counters): timings that are numbers, as a
    map, and counters, of runs whose metrics are text."""
    times = ("preprocess_time_sec", "model_time_sec", "postprocess_time_sec", "total_time_sec")
    pairs = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), loose_float(F.col(t)).alias("value")) for t in times]), lambda x: x["value"].isNotNull())
    counters = F.struct("num_frames", "num_clips", "avg_clip_duration_sec", F.coalesce("metrics_language", "language").alias("language"), "device")
    return runs.select("video_id", "language", "variant", "profile", "config_fingerprint", F.map_from_entries(pairs).alias("timings"), counters.alias("counters"))


def importable(manifest: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of a manifest (video_id, source_path) to add to a library: all, or an error that names the sources
    that aren't there. Videos that the library has are left as they are."""
    lost = manifest.join(files.select(F.col("path").alias("source_path")), "source_path", "left_anti").agg(F.array_sort(F.collect_set("source_path")).alias("_lost"))
    rows = manifest.join(F.broadcast(lost)).withColumn("video_id", F.when(F.size("_lost") > 0, F.raise_error(F.concat(F.lit("missing sources: "), F.concat_ws(", ", "_lost")))).otherwise(F.col("video_id"))).drop("_lost")
    return rows.join(known.select("video_id"), "video_id", "left_anti")


def package_list(required: DataFrame, files: DataFrame) -> DataFrame:
    """(label, path, bytes, sha256): the one file that each required name (label, name) stands for. A label without a
    file that holds something, or with several, is an error."""
    full = files.where("length > 0").withColumn("name", F.element_at(F.split("path", "/"), -1))
    found = required.join(full, "name", "left").groupBy("label").agg(F.count("path").alias("_n"), F.min(F.when(F.col("path").isNotNull(), F.struct("path", F.col("length").alias("bytes"), "sha256"))).alias("x"))
    wrong = F.when(F.col("_n") == 0, F.concat(F.lit("missing or empty: "), F.col("label"))).when(F.col("_n") > 1, F.concat(F.lit("ambiguous: "), F.col("label")))
    return found.select(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("label")).alias("label"), "x.path", "x.bytes", "x.sha256")


def visual_tokens(luma: Column, edges: Column, blue: Column, green: Column, red: Column) -> Column:
    """What a keyframe looks like, as words, from its mean brightness, share of edges and mean channels; none if
    any is missing."""
    # Names and limits.
    light = F.when(luma < 55, "vf_brightness_dark").when(luma < 120, "vf_brightness_dim").when(luma < 190, "vf_brightness_normal").otherwise("vf_brightness_bright")
    edge = F.when(edges < 0.03, "vf_edges_low").when(edges < 0.08, "vf_edges_mid").otherwise("vf_edges_high")
    colour = F.when((blue >= green) & (blue >= red), "vf_color_blue").when(green >= red, "vf_color_green").otherwise("vf_color_red")
    known = luma.isNotNull() & edges.isNotNull() & blue.isNotNull() & green.isNotNull() & red.isNotNull()
    return F.when(known, F.array(light, edge, colour)).otherwise(F.array().cast("array<string>"))


def dense_text(display: Column, tokens: Column) -> Column:
    """The text that is embedded: what is displayed, and the words for the keyframe."""
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(display, F.lit(""))), tokens))


def kept_or(own: Column, new: Column) -> Column:
    """A document's metadata: what the segment tells, unless that is missing."""
    return F.coalesce(new, own)
