"""Queries of timelines; events of a user are the frames or observations of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import timeline
from tessera.plans.fixtures import OBSERVATIONS_SQL, observations, table

WINDOW, STRIDE, FPS = 60.0, 24.0, 0.1
#: Event types as descriptions.
WORDS = {"click": "person walking near entrance gate", "view": "person walking near entrance door", "purchase": "vehicle stopping beside gate", "signup": "empty scene quiet", "logout": "person leaving entrance gate"}


def _videos(obs: DataFrame) -> DataFrame:
    return obs.groupBy("video_id").agg(F.max("t").alias("duration"), F.count(F.lit(1)).alias("raw_clips"))


def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumnRenamed("obs_id", "id")
    found = timeline.clip_frames(obs, _videos(obs), WINDOW, STRIDE)
    return found.groupBy("video_id", "clip").agg(F.round(F.min("start_sec"), 3).alias("start_sec"), F.round(F.max("t"), 3).alias("last_t"), F.count(F.lit(1)).alias("frames"))


def fps_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.thinned_frames(observations(spark, sf_dir).withColumnRenamed("obs_id", "id"), FPS).select("video_id", "id")


def clip_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumnRenamed("obs_id", "id")
    made = timeline.clips(obs, _videos(obs), WINDOW, STRIDE, 0.0, 2, 3)
    return made.select("video_id", "clip", F.round("end_sec", 3).alias("end_sec"), F.size("ids").alias("n"), "keyframe")


def frame_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.even_frames(observations(spark, sf_dir).withColumnRenamed("obs_id", "id"), 7).select("video_id", "id")


def sharpest_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's seven frames, the sharpest of those whose sharpness is known."""
    frames = timeline.even_frames(observations(spark, sf_dir).withColumnRenamed("obs_id", "id"), 7)
    known = F.filter(F.collect_list(F.when(F.col("id") % 3 > 0, F.struct("id", (F.col("id") % 11).cast("double").alias("s")))), lambda x: x.isNotNull())
    rows = frames.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("ids"), F.map_from_entries(known).alias("sharpness"))
    return rows.select("video_id", timeline.keyframe(F.col("ids"), "sharpest", F.col("sharpness")).alias("keyframe"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    kind = F.pmod("obs_id", F.lit(5))
    words = F.element_at(F.array(*map(F.lit, WORDS.values())), (kind + 1).cast("int"))
    return obs.select("video_id", F.col("t").alias("start_sec"), (F.col("t") + 6.0).alias("end_sec"), F.col("obs_id").alias("pos"), words.alias("description"), (kind == 3).alias("anomaly_flag"), (kind / 10.0).alias("anomaly_confidence"), F.when(kind == 3, F.array(F.lit("quiet"))).otherwise(F.array().cast("array<string>")).alias("anomaly_notes"))


def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = timeline.merged_by_text(_described(spark, sf_dir), 0.6, 4.0)
    return merged.select("video_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "anomaly_flag", F.round("anomaly_confidence", 6).alias("confidence"), F.size("merged_from").alias("members"))


def _vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), pos.alias("pos"), F.col("embedding").alias("vector"))
    return rows.withColumn("start_sec", F.col("pos") * 5.0).withColumn("end_sec", F.col("pos") * 5.0 + 4.5)


def _semantic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of many lengths, one in nine of zeros, with flags and notes."""
    rows = _vector_rows(spark, sf_dir)
    pos = F.col("pos")
    scale = F.when(pos % 9 == 8, 0.0).otherwise(pos % 5 + 0.5)
    notes = F.when(pos % 4 == 0, F.array(F.lit("a"), F.concat(F.lit("n"), (pos % 6).cast("string")))).otherwise(F.array(F.concat(F.lit("n"), (pos % 6).cast("string"))))
    return rows.withColumn("vector", F.zip_with("vector", F.array_repeat(scale, F.size("vector")), lambda x, m: x.cast("double") * m)).select("*", F.concat(F.lit("[00:01 - 00:05] clip "), pos.cast("string")).alias("description"), (pos % 7 == 0).alias("anomaly_flag"), (pos % 10 / 10.0).alias("anomaly_confidence"), notes.alias("anomaly_notes"))


def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeline.merged_by_vector(_semantic_rows(spark, sf_dir), 0.2, 1.0)
    return out.select("video_id", "start_sec", "end_sec", "description", "anomaly_flag", F.round("anomaly_confidence", 6).alias("confidence"), F.concat_ws(",", "anomaly_notes").alias("notes"), F.size("members").alias("members"))


def change_gated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    frames = obs.select("video_id", "t", F.col("obs_id").alias("id"), "value", F.pmod("obs_id", F.lit(97)).cast("double").alias("brightness"), F.pmod("obs_id", F.lit(89)).cast("double").alias("sharpness"))
    return timeline.change_gate(frames, 20.0, 10.0, 10.0).withColumn("threshold", F.round("threshold", 6))


def _clip_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_windows(spark, sf_dir).select("video_id", F.col("clip").cast("int").alias("clip"), F.col("frames").alias("n"))


def clip_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.packed(_clip_sizes(spark, sf_dir), 4, 24, 0.5)


def batch_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What padding costs in the packed batches."""
    sizes = _clip_sizes(spark, sf_dir)
    out = timeline.batch_summary(timeline.packed(sizes, 4, 24, 0.5).join(sizes, ["video_id", "clip"]))
    return out.select("video_id", "batches", F.round("clips_avg", 6).alias("clips_avg"), "clips_max", "frames_real", "frames_padded", F.round("padding_ratio", 6).alias("padding_ratio"))


def clip_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clip_sizes(spark, sf_dir).withColumn("anomaly_flag", F.when(F.col("clip") % 4 > 0, F.col("clip") % 3 == 0)).withColumn("anomaly_confidence", F.col("clip") % 10 / 10.0)
    out = timeline.clip_stats(rows)
    return out.select("video_id", "clips", "frames_min", "frames_max", *[F.round(c, 6).alias(c) for c in ("frames_avg", "flag_rate", "confidence_mean")])


def timeline_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vector_rows(spark, sf_dir).withColumnRenamed("pos", "seg")
    return timeline.coherence(rows).select("video_id", *[F.round(c, 6).alias(c) for c in ("tcs", "srr", "sdi")])


def timeline_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.novelty(_vector_rows(spark, sf_dir).withColumnRenamed("pos", "seg")).select("video_id", F.round("sns", 6).alias("sns"))


def member_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of three clips each: their direction's product with the first clip."""
    raw = _vector_rows(spark, sf_dir)
    segs = raw.groupBy("video_id", F.floor(F.col("pos") / 3).alias("seg")).agg(F.array_append(F.collect_list("pos"), F.lit(10_000_000)).alias("members"))
    from tessera.functions import geometry

    made = timeline.member_vectors(segs, raw).join(raw.select("video_id", (F.col("pos") / 3).alias("seg"), F.col("vector").alias("first")), ["video_id", "seg"])
    return made.select("video_id", "seg", F.round(geometry.dot(F.col("vector"), F.col("first")), 6).alias("with_first"))


def timeline_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of the timelines that the text merge makes."""
    obs = _described(spark, sf_dir)
    videos = obs.groupBy("video_id").agg(F.max("end_sec").alias("duration"), F.count(F.lit(1)).alias("raw_clips"))
    out = timeline.shape(timeline.merged_by_text(obs, 0.6, 4.0), videos)
    return out.select("video_id", "raw_clips", "final_segments", *[F.round(c, 6).alias(c) for c in ("compression_ratio", "dd", "mean_segment_duration")])


def tau_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the merged timelines for each threshold and video."""
    raw = _vector_rows(spark, sf_dir)
    merged = timeline.tau_ablation(raw, [0.1, 0.2, 0.3], 1.0)
    key = F.concat_ws(":", F.col("video_id").cast("string"), F.col("tau").cast("string"))
    vectors = timeline.member_vectors(merged.withColumn("k", key).drop("video_id").withColumnRenamed("k", "video_id"), raw.withColumn("video_id", F.explode(F.array(*[F.concat_ws(":", F.col("video_id").cast("string"), F.lit(str(t))) for t in (0.1, 0.2, 0.3)]))))
    measured = timeline.coherence(vectors).join(timeline.novelty(vectors), "video_id", "left")
    counts = merged.groupBy("video_id", "tau").agg(F.count(F.lit(1)).alias("final_segments"), F.sum(F.size("members")).alias("raw_clips"))
    return counts.withColumn("k", key).join(measured.withColumnRenamed("video_id", "k"), "k", "left").select("video_id", "tau", "raw_clips", "final_segments", (F.col("raw_clips") / F.col("final_segments")).alias("compression_ratio"), *[F.round(c, 6).alias(c) for c in ("tcs", "srr", "sns", "sdi")])


def tau_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by discount over a fixed list, empty groups included."""
    grid = spark.sql("SELECT * FROM VALUES (0.0D), (0.03D), (0.06D), (0.09D), (0.5D) AS t(tau)")
    line = table(spark, sf_dir, "lineitem").select(F.round("l_discount", 2).alias("tau"), "l_quantity", "l_extendedprice")
    return grid.join(line, "tau", "left").groupBy("tau").agg(F.count("l_quantity").alias("runs"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


def tau_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.round("l_tax", 2).alias("tau")).agg(F.countDistinct("l_orderkey").alias("segments"), F.round(F.avg("l_discount"), 12).alias("compression"))
    return timeline.is_monotonic(line)


QUERIES = {f.__name__: f for f in (clip_windows, fps_downsample, clip_keyframes, frame_subsample, sharpest_keyframes, batch_payloads, clip_statistics, text_merge, semantic_merge, change_gated_frames, clip_batches, timeline_coherence, timeline_novelty, member_directions, timeline_shape, tau_ablation, tau_summary, tau_monotonic)}

_WINDOWS = f"""WITH RECURSIVE {OBSERVATIONS_SQL}, vid AS (SELECT video_id, max(t) AS duration FROM obs GROUP BY video_id),
    win AS (SELECT video_id, clip, clip * {STRIDE}::DOUBLE AS start_sec, least(clip * {STRIDE}::DOUBLE + {WINDOW}, duration) AS end_sec FROM (SELECT video_id, duration, unnest(range(0, CAST(floor((duration + 1e-6) / {STRIDE}) AS INT) + 1)) AS clip FROM vid) WHERE clip * {STRIDE}::DOUBLE < duration + 1e-6),
    inw AS (SELECT w.video_id, w.clip, w.start_sec, o.t, o.obs_id FROM win w JOIN obs o ON o.video_id = w.video_id AND o.t >= w.start_sec AND o.t <= w.end_sec)"""
_VEC = "v AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_TERMS = "list_distinct(list_filter(string_split(description, ' '), lambda x: length(x) > 2))"
_DESCRIBED = f"""d AS (SELECT video_id, obs_id, t AS start_sec, t + 6.0 AS end_sec, list_extract([{", ".join("'" + w + "'" for w in WORDS.values())}], CAST(obs_id % 5 + 1 AS INT)) AS description, obs_id % 5 = 3 AS flag, (obs_id % 5) / 10.0::DOUBLE AS conf FROM obs)"""
_TEXT_MERGE = f"""{OBSERVATIONS_SQL}, {_DESCRIBED}, o AS (SELECT *, {_TERMS} AS w, row_number() OVER (PARTITION BY video_id ORDER BY start_sec, obs_id) AS i FROM d),
        s AS (SELECT video_id, i, 1 AS seg, start_sec, end_sec, w, flag, conf, 1 AS members FROM o WHERE i = 1
              UNION ALL SELECT o.video_id, o.i, CASE WHEN m THEN s.seg ELSE s.seg + 1 END, CASE WHEN m THEN s.start_sec ELSE o.start_sec END, o.end_sec, CASE WHEN m THEN s.w ELSE o.w END,
                CASE WHEN m THEN s.flag OR o.flag ELSE o.flag END, CASE WHEN m THEN greatest(s.conf, o.conf) ELSE o.conf END, CASE WHEN m THEN s.members + 1 ELSE 1 END
              FROM o JOIN s ON o.video_id = s.video_id AND o.i = s.i + 1,
              LATERAL (SELECT o.start_sec - s.end_sec <= 4.0 AND len(list_intersect(o.w, s.w))::DOUBLE / least(len(o.w), len(s.w)) >= 0.6 AS m)),
        merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY i DESC) AS n FROM s) WHERE n = 1)"""
_SEMANTIC = f"""{_VEC}, o AS (SELECT video_id, pos, pos * 5.0::DOUBLE AS start_sec, pos * 5.0::DOUBLE + 4.5 AS end_sec, CASE WHEN pos % 9 < 8 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS u, 'clip ' || pos AS description,
            pos % 7 = 0 AS flag, (pos % 10) / 10.0::DOUBLE AS conf, CASE WHEN pos % 4 = 0 THEN ['a', 'n' || (pos % 6)] ELSE ['n' || (pos % 6)] END AS notes FROM v),
        s AS (SELECT video_id, pos, 0 AS seg, start_sec, end_sec, u, description, flag, conf, notes, 1 AS members FROM o WHERE pos = 0
              UNION ALL SELECT o.video_id, o.pos, CASE WHEN m THEN s.seg ELSE s.seg + 1 END, CASE WHEN m THEN s.start_sec ELSE o.start_sec END, o.end_sec,
                CASE WHEN m THEN list_transform(range(1, len(o.u) + 1), lambda k: (s.u[k] + o.u[k]) / sqrt(2 + 2 * list_dot_product(s.u, o.u))) ELSE o.u END, CASE WHEN m THEN s.description ELSE o.description END,
                CASE WHEN m THEN s.flag OR o.flag ELSE o.flag END, CASE WHEN m THEN greatest(s.conf, o.conf) ELSE o.conf END, CASE WHEN m THEN list_concat(s.notes, list_filter(o.notes, lambda x: NOT list_contains(s.notes, x)))[:4] ELSE o.notes END, CASE WHEN m THEN s.members + 1 ELSE 1 END
              FROM o JOIN s ON o.video_id = s.video_id AND o.pos = s.pos + 1, LATERAL (SELECT o.start_sec - s.end_sec <= 1.0 AND coalesce(list_dot_product(s.u, o.u), -1) >= 0.2 AS m))"""
_GATE = f"""{OBSERVATIONS_SQL}, o AS (SELECT video_id, obs_id AS id, value, obs_id % 97 AS brightness, obs_id % 89 AS sharpness, row_number() OVER (PARTITION BY video_id ORDER BY t, obs_id) AS i FROM obs),
        e AS (SELECT *, CASE WHEN sharpness < 3.5 THEN 'blurred' WHEN brightness < 4 THEN 'dark' END AS out FROM o),
        s AS (SELECT video_id, i, id, coalesce(out, 'warm_up') AS state, CASE WHEN out IS NULL THEN value END AS last, CAST([] AS DOUBLE[]) AS seen, 20.0::DOUBLE AS lim FROM e WHERE i = 1
              UNION ALL SELECT e.video_id, e.i, e.id, CASE WHEN out IS NOT NULL THEN out WHEN warm THEN 'warm_up' WHEN diff < s.lim THEN 'lazy' WHEN diff > 8 * s.lim THEN 'scene_cut' ELSE 'kept' END,
                CASE WHEN out IS NULL AND (warm OR diff >= s.lim) THEN e.value ELSE s.last END, CASE WHEN out IS NULL AND warm AND diff IS NOT NULL THEN list_append(s.seen, diff) ELSE s.seen END,
                CASE WHEN out IS NULL AND warm AND diff IS NOT NULL AND len(s.seen) = 7 THEN least(greatest(1.2::DOUBLE * (list_sum(s.seen) + diff) / 8, 5.0), 14.0) ELSE s.lim END
              FROM e JOIN s ON e.video_id = s.video_id AND e.i = s.i + 1, LATERAL (SELECT abs(e.value - s.last) AS diff), LATERAL (SELECT diff IS NULL OR len(s.seen) < 8 AS warm))"""
_PACKED = f"""g AS (SELECT video_id, clip, count(*) AS n FROM inw GROUP BY video_id, clip, start_sec), og AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, clip) AS i FROM g),
        p AS (SELECT video_id, i, clip, n, 0 AS batch, 1 AS size, n AS longest FROM og WHERE i = 1
              UNION ALL SELECT o.video_id, o.i, o.clip, o.n, CASE WHEN c THEN p.batch + 1 ELSE p.batch END, CASE WHEN c THEN 1 ELSE p.size + 1 END, CASE WHEN c THEN o.n ELSE p.longest END
              FROM og o JOIN p ON o.video_id = p.video_id AND o.i = p.i + 1, LATERAL (SELECT p.size >= 4 OR o.n < p.longest * 0.5 OR p.longest * (p.size + 1) > 24 AS c))"""
ORACLES = {
    "clip_windows": f"{_WINDOWS} SELECT video_id, clip, round(start_sec, 3) AS start_sec, round(max(t), 3) AS last_t, count(*) AS frames FROM inw GROUP BY video_id, clip, start_sec",
    "fps_downsample": f"""WITH RECURSIVE {OBSERVATIONS_SQL}, o AS (SELECT video_id, t, obs_id, row_number() OVER (PARTITION BY video_id ORDER BY t, obs_id) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM obs),
        s AS (SELECT video_id, i, n, t AS last, [obs_id] AS kept FROM o WHERE i = 1
              UNION ALL SELECT o.video_id, o.i, o.n, CASE WHEN o.t - s.last + 1e-9 >= {1 / FPS} THEN o.t ELSE s.last END,
                CASE WHEN o.t - s.last + 1e-9 >= {1 / FPS} THEN list_append(s.kept, o.obs_id) WHEN o.i = o.n THEN list_append(s.kept[:-2], o.obs_id) ELSE s.kept END
              FROM o JOIN s ON o.video_id = s.video_id AND o.i = s.i + 1)
        SELECT video_id, unnest(kept) AS id FROM s WHERE i = n""",
    "clip_keyframes": f"""{_WINDOWS}, g AS (SELECT video_id, clip, max(t) AS last_t, list(obs_id ORDER BY t, obs_id) AS ids FROM inw GROUP BY video_id, clip HAVING count(*) >= 2),
        k AS (SELECT video_id, clip, last_t, CASE WHEN len(ids) > 3 THEN [ids[1], ids[CAST(floor(len(ids) / 3.0) AS INT) + 1], ids[CAST(floor(2 * len(ids) / 3.0) AS INT) + 1]] ELSE ids END AS ids FROM g)
        SELECT video_id, clip, round(last_t, 3) AS end_sec, len(ids) AS n, ids[len(ids) // 2 + 1] AS keyframe FROM k""",
    "frame_subsample": f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT video_id, list(obs_id ORDER BY t, obs_id) AS ids FROM obs GROUP BY video_id)
        SELECT video_id, unnest(CASE WHEN len(ids) > 7 THEN list_transform(range(0, 7), lambda i: ids[CAST(floor(i * len(ids) / 7.0) AS INT) + 1]) ELSE ids END) AS id FROM g""",
    "text_merge": f"WITH RECURSIVE {_TEXT_MERGE} SELECT video_id, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, flag AS anomaly_flag, round(conf, 6) AS confidence, members FROM merged",
    "semantic_merge": f"""WITH RECURSIVE {_SEMANTIC} SELECT video_id, start_sec, end_sec, description, flag AS anomaly_flag, round(conf, 6) AS confidence, array_to_string(notes, ',') AS notes, members
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY pos DESC) AS n FROM s) WHERE n = 1""",
    "change_gated_frames": f"WITH RECURSIVE {_GATE} SELECT video_id, id, state, round(lim, 6) AS threshold FROM s",
    "clip_batches": f"{_WINDOWS}, {_PACKED} SELECT video_id, clip, batch FROM p",
    "batch_payloads": f"""{_WINDOWS}, {_PACKED}, b AS (SELECT video_id, batch, count(*) AS clips, sum(n) AS r, max(n) * count(*) AS p FROM p GROUP BY ALL)
        SELECT video_id, count(*) AS batches, round(avg(clips), 6) AS clips_avg, max(clips) AS clips_max, sum(r) AS frames_real, sum(p) AS frames_padded, round((sum(p) - sum(r))::DOUBLE / sum(p), 6) AS padding_ratio FROM b GROUP BY video_id""",
    "clip_statistics": f"""{_WINDOWS}, g AS (SELECT video_id, clip, count(*) AS n FROM inw GROUP BY video_id, clip, start_sec)
        SELECT video_id, count(*) AS clips, min(n) AS frames_min, max(n) AS frames_max, round(avg(n), 6) AS frames_avg, round(avg(CASE WHEN clip % 4 > 0 AND clip % 3 = 0 THEN 1 ELSE 0 END), 6) AS flag_rate, round(avg((clip % 10) / 10.0::DOUBLE), 6) AS confidence_mean FROM g GROUP BY video_id""",
    "sharpest_keyframes": f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT video_id, list(obs_id ORDER BY t, obs_id) AS ids FROM obs GROUP BY video_id),
        k AS (SELECT video_id, CASE WHEN len(ids) > 7 THEN list_transform(range(0, 7), lambda i: ids[CAST(floor(i * len(ids) / 7.0) AS INT) + 1]) ELSE ids END AS ids FROM g),
        u AS (SELECT video_id, ids, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS place FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id % 11 DESC, place) AS n FROM u WHERE id % 3 > 0)
        SELECT k.video_id, coalesce(r.id, k.ids[len(k.ids) // 2 + 1]) AS keyframe FROM k LEFT JOIN r ON r.video_id = k.video_id AND n = 1""",
    "timeline_coherence": f"""WITH {_VEC}, l AS (SELECT video_id, v, lead(v, 1) OVER w AS a, lead(v, 2) OVER w AS b FROM v WINDOW w AS (PARTITION BY video_id ORDER BY pos))
        SELECT video_id, round(avg(list_cosine_similarity(v, a)), 6) AS tcs, round(avg(list_cosine_similarity(v, b)), 6) AS srr, round(1 - avg(list_cosine_similarity(v, a)), 6) AS sdi FROM l GROUP BY video_id""",
    "timeline_novelty": f"""WITH {_VEC}, e AS (SELECT video_id, pos, unnest(range(1, len(v) + 1)) AS d, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM v),
        s AS (SELECT *, sum(x) OVER (PARTITION BY video_id, d ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e),
        n AS (SELECT video_id, pos, 1 - sum(x * s) / sqrt(sum(s * s)) AS novelty FROM s WHERE s IS NOT NULL GROUP BY video_id, pos)
        SELECT video_id, round(avg(novelty), 6) AS sns FROM n GROUP BY video_id""",
    "member_directions": f"""WITH {_VEC}, e AS (SELECT video_id, pos // 3 AS seg, unnest(range(1, len(v) + 1)) AS d, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM v),
        s AS (SELECT video_id, seg, d, sum(x) AS x FROM e GROUP BY ALL), m AS (SELECT video_id, seg, list(x ORDER BY d) AS m FROM s GROUP BY ALL)
        SELECT m.video_id, seg, round(list_dot_product(m, v) / sqrt(list_dot_product(m, m)), 6) AS with_first FROM m JOIN v ON v.video_id = m.video_id AND v.pos = seg * 3""",
    "tau_ablation": f"""WITH RECURSIVE {_VEC}, o AS (SELECT video_id, pos, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v), ts AS (SELECT unnest([0.1::DOUBLE, 0.2, 0.3]) AS tau),
        s AS (SELECT video_id, tau, pos, 0 AS seg, u AS d FROM o, ts WHERE pos = 0
              UNION ALL SELECT o.video_id, s.tau, o.pos, CASE WHEN m THEN s.seg ELSE s.seg + 1 END, CASE WHEN m THEN list_transform(range(1, len(o.u) + 1), lambda k: (s.d[k] + o.u[k]) / sqrt(2 + 2 * list_dot_product(s.d, o.u))) ELSE o.u END
              FROM o JOIN s ON o.video_id = s.video_id AND o.pos = s.pos + 1, LATERAL (SELECT list_dot_product(s.d, o.u) >= s.tau AS m)),
        c AS (SELECT video_id, tau, count(*) AS raw, max(seg) + 1 AS segs FROM s GROUP BY ALL),
        e AS (SELECT s.video_id, tau, seg, unnest(range(1, len(u) + 1)) AS d, unnest(u) AS x FROM s JOIN o USING (video_id, pos)), g AS (SELECT video_id, tau, seg, d, sum(x) AS x FROM e GROUP BY ALL),
        n AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY video_id, tau, seg)) AS y FROM g), mv AS (SELECT video_id, tau, seg, list(y ORDER BY d) AS m FROM n GROUP BY ALL),
        l AS (SELECT video_id, tau, list_cosine_similarity(m, lead(m, 1) OVER w) AS a, list_cosine_similarity(m, lead(m, 2) OVER w) AS b FROM mv WINDOW w AS (PARTITION BY video_id, tau ORDER BY seg)), lc AS (SELECT video_id, tau, avg(a) AS tcs, avg(b) AS srr FROM l GROUP BY ALL),
        r AS (SELECT *, sum(y) OVER (PARTITION BY video_id, tau, d ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM n), nv AS (SELECT video_id, tau, seg, 1 - sum(y * p) / sqrt(sum(p * p)) AS v FROM r WHERE p IS NOT NULL GROUP BY ALL), na AS (SELECT video_id, tau, avg(v) AS sns FROM nv GROUP BY ALL)
        SELECT c.video_id, c.tau, raw AS raw_clips, segs AS final_segments, raw / segs::DOUBLE AS compression_ratio, round(tcs, 6) AS tcs, round(srr, 6) AS srr, round(sns, 6) AS sns, round(1 - tcs, 6) AS sdi FROM c LEFT JOIN lc USING (video_id, tau) LEFT JOIN na USING (video_id, tau)""",
    "timeline_shape": f"""WITH RECURSIVE {_TEXT_MERGE}, g AS (SELECT video_id, max(end_sec) AS duration, count(*) AS raw_clips FROM d GROUP BY video_id), h AS (SELECT video_id, count(*) AS n, avg(greatest(0, end_sec - start_sec)) AS m FROM merged GROUP BY video_id)
        SELECT video_id, raw_clips, n AS final_segments, round(raw_clips / n::DOUBLE, 6) AS compression_ratio, round(60.0 * n / duration, 6) AS dd, round(m, 6) AS mean_segment_duration FROM g JOIN h USING (video_id)""",
    "tau_summary": "SELECT t.tau, count(l_quantity) AS runs, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price FROM (VALUES (0.0::DOUBLE), (0.03::DOUBLE), (0.06::DOUBLE), (0.09::DOUBLE), (0.5::DOUBLE)) t(tau) LEFT JOIN lineitem ON round(l_discount, 2) = t.tau GROUP BY t.tau",
    "tau_monotonic": """WITH g AS (SELECT round(l_tax, 2) AS tau, count(DISTINCT l_orderkey) AS s, round(avg(l_discount), 12) AS c FROM lineitem GROUP BY 1), l AS (SELECT s >= lag(s) OVER w AS a, c <= lag(c) OVER w AS b, row_number() OVER w = 1 AS f FROM g WINDOW w AS (ORDER BY tau))
        SELECT CASE WHEN bool_and(f OR coalesce(a, false)) THEN 'yes' ELSE 'no' END AS segments_rise, CASE WHEN bool_and(f OR coalesce(b, false)) THEN 'yes' ELSE 'no' END AS compression_falls FROM l""",
}
