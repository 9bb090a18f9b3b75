"""Timelines: sliding clips, frame thinning, merges of neighbours, quality gates and the metrics of
merged timelines.

Merges, thinning and gates depend on what was kept before: they fold a video's rows in order (folds.py) and
hold one segment, frame or batch at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry, text
from tessera.operators.folds import folded


def windows(videos: DataFrame, window: float, stride: float) -> DataFrame:
    """(video_id, clip, start_sec, end_sec): windows from 0 in steps of stride while they begin before the
    duration; ends are cut to it."""
    steps = F.sequence(F.lit(0), F.floor((F.col("duration") + 1e-6) / stride).cast("int"))
    rows = videos.where("duration > 0").select("video_id", "duration", F.explode(steps).alias("clip")).withColumn("start_sec", F.col("clip") * stride)
    return rows.where(F.col("start_sec") < F.col("duration") + 1e-6).select("video_id", "clip", "start_sec", F.least(F.col("start_sec") + window, F.col("duration")).alias("end_sec"))


def clip_frames(frames: DataFrame, videos: DataFrame, window: float, stride: float) -> DataFrame:
    """Frames (video_id, t, ...) with each window that they lie in, both ends included. Windows and frames
    meet on (video, step of stride), so a frame looks at the few windows around it, not at all."""
    wins = windows(videos, window, stride)
    span = F.sequence(F.floor(F.col("start_sec") / stride), F.floor(F.col("end_sec") / stride))
    spread = wins.withColumn("step", F.explode(span))
    placed = frames.withColumn("step", F.floor(F.col("t") / stride))
    return placed.join(spread, ["video_id", "step"]).where((F.col("t") >= F.col("start_sec")) & (F.col("t") <= F.col("end_sec"))).drop("step")


def thinned(frames: Column, fps: float) -> Column:
    """A clip's ordered array of struct(t, id) thinned to a rate; the end points stay: a last frame that is too
    close takes the place of the last one kept. Without a rate (0) all frames stay."""
    kind = "array<struct<t:double,id:bigint>>"
    if fps <= 0:
        return frames.cast(kind)
    gap = 1.0 / fps
    frames = frames.cast(kind)
    first, last = F.get(frames, F.lit(0)), F.element_at(frames, -1)
    inner = F.slice(frames, F.lit(2), F.greatest(F.lit(0), F.size(frames) - 2))
    kept = F.aggregate(inner, F.array(first), lambda acc, x: F.when(x["t"] - F.element_at(acc, -1)["t"] + 1e-9 >= gap, F.concat(acc, F.array(x))).otherwise(acc))
    far = last["t"] - F.element_at(kept, -1)["t"] + 1e-9 >= gap
    tail = F.when(far, F.concat(kept, F.array(last))).otherwise(F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(last)))
    return F.when(F.size(frames) <= 1, frames).otherwise(tail)


class _Thinner:
    """Holds the frame kept last, and the one before the next."""

    def __init__(self, gap: float) -> None:
        self.gap, self.kept, self.waiting = gap, None, None

    def far(self, row: tuple) -> bool:
        return row[1] - self.kept[1] + 1e-9 >= self.gap

    def add(self, row: tuple) -> list[tuple]:
        out, frame, self.waiting = [], self.waiting, row
        if frame is not None:
            if self.kept is None:
                self.kept = frame
            elif self.far(frame):
                out, self.kept = [self.kept], frame
        return out

    def end(self) -> list[tuple]:
        return [self.kept, self.waiting] if self.kept is not None and self.far(self.waiting) else [self.waiting]


def thinned_frames(frames: DataFrame, fps: float) -> DataFrame:
    """Frames (video_id, t, id) of whole videos thinned to a rate, as thinned() does for a clip."""
    kind = frames.schema["video_id"].dataType.simpleString()
    return folded(frames.select("video_id", "t", "id"), "video_id", ["t", "id"], lambda _: _Thinner(1.0 / fps), f"video_id {kind}, t double, id long")


def even_frames(frames: DataFrame, most: int) -> DataFrame:
    """At most ``most`` frames (video_id, t, id) of each video, at equal steps."""
    video = Window.partitionBy("video_id")
    rows = frames.withColumn("_r", (F.row_number().over(video.orderBy("t", "id")) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(video))
    step = F.expr(f"(_r * {most} + _n - 1) div _n")  # the first step that may fall on this frame
    on = (step < most) & (F.expr(f"(((_r * {most} + _n - 1) div _n) * _n) div {most}") == F.col("_r"))
    return rows.where((F.col("_n") <= most) | on).drop("_r", "_n")


def evenly(items: Column, most: int) -> Column:
    """At most ``most`` items, at equal steps."""
    n = F.size(items)
    return F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor(i * n / most).cast("int")))).otherwise(items)


def keyframe(items: Column, policy: str, sharpness: Column | None = None) -> Column:
    """The item that stands for a clip: the first, last or middle one, or the sharpest, by a map from items to
    numbers; of equal ones the first, and the middle one where none is told."""
    n = F.size(items)
    middle = F.get(items, F.floor(n / 2).cast("int"))
    if policy == "sharpest":
        known = F.filter(items, lambda x: F.try_element_at(sharpness, x).isNotNull())
        best = F.array_max(F.transform(known, lambda x: F.try_element_at(sharpness, x)))
        return F.coalesce(F.get(F.filter(known, lambda x: F.try_element_at(sharpness, x) == best), F.lit(0)), middle)
    return {"first": F.get(items, F.lit(0)), "last": F.get(items, n - 1), "middle": middle}[policy]


def clips(frames: DataFrame, videos: DataFrame, window: float, stride: float, fps: float, least: int, most: int, policy: str = "middle") -> DataFrame:
    """(video_id, start_sec, end_sec, ids, keyframe): clips with enough frames after thinning; a clip ends
    at its last frame."""
    grouped = clip_frames(frames, videos, window, stride).groupBy("video_id", "clip", "start_sec").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("f"))
    kept = grouped.select("video_id", "clip", "start_sec", thinned(F.col("f"), fps).alias("f")).where(F.size("f") >= least)
    ids = evenly(F.transform("f", lambda x: x["id"]), most)
    return kept.select("video_id", "clip", "start_sec", F.element_at("f", -1)["t"].alias("end_sec"), ids.alias("ids")).withColumn("keyframe", keyframe(F.col("ids"), policy))


MERGED = "start_sec double, end_sec double, description string, anomaly_flag boolean, anomaly_confidence double, anomaly_notes array<string>, {members} array<int>"


class _Merger:
    """Holds one segment. alike(now, next) tells whether the next row's key goes with the segment's, and joined
    makes the key of both. Rows are (video, start, end, pos, description, flag, confidence, notes, key)."""

    def __init__(self, gap: float, alike, joined) -> None:
        self.gap, self.alike, self.joined = gap, alike, joined
        self.now, self.i = None, -1

    def add(self, row: tuple) -> list[tuple]:
        self.i += 1
        video, start, end, _, description, flag, confidence, notes, key = row
        flag, confidence, notes = bool(flag), confidence or 0.0, notes or []
        now = self.now
        if now is not None and start - now["end"] <= self.gap and self.alike(now["key"], key):
            now["end"], now["key"] = end, self.joined(now["key"], key)
            now["flag"] |= flag
            now["confidence"] = max(now["confidence"], confidence)
            now["notes"] = list(dict.fromkeys([*now["notes"], *notes]))[:4]
            now["members"].append(self.i)
            return []
        out = self.end()
        self.now = {"video": video, "start": start, "end": end, "description": description, "flag": flag, "confidence": confidence, "notes": list(notes), "members": [self.i], "key": key}
        return out

    def end(self) -> list[tuple]:
        now = self.now
        return [] if now is None else [(now["video"], now["start"], now["end"], now["description"], now["flag"], now["confidence"], now["notes"], now["members"])]


def _observed(obs: DataFrame, key: Column) -> DataFrame:
    """The columns that _Merger takes; what observations don't tell is empty."""
    told = {"description": F.lit(None).cast("string"), "anomaly_flag": F.lit(False), "anomaly_confidence": F.lit(0.0), "anomaly_notes": F.array().cast("array<string>")}
    told = {c: F.col(c) if c in obs.columns else v for c, v in told.items()}
    return obs.select("video_id", "start_sec", "end_sec", "pos", text.strip_prefix(told["description"]).alias("description"), *[told[c].alias(c) for c in list(told)[1:]], key.alias("key"))


def merged_by_text(obs: DataFrame, similarity: float = 0.9, gap: float = 1.0) -> DataFrame:
    """Neighbours merged while the gap is small and the next text is like the first member's: end becomes
    the next one's, flags are or-ed, confidence is the largest, notes the first four. Input (video_id,
    start_sec, end_sec, pos, description, anomaly_flag, anomaly_confidence, anomaly_notes); rows of a video
    are ordered by start and position."""

    def alike(now: list[str], then: list[str]) -> bool:
        small = min(len(now), len(then))
        shared = set(now).intersection(then)
        return (len(shared) / small if small else 0.0) >= similarity

    kind = obs.schema["video_id"].dataType.simpleString()
    rows = _observed(obs, text.description_terms(F.col("description")))
    return folded(rows, "video_id", ["start_sec", "pos"], lambda _: _Merger(gap, alike, lambda now, _: now), f"video_id {kind}, {MERGED.format(members='merged_from')}")


def merged_by_vector(rows: DataFrame, similarity: float, gap: float) -> DataFrame:
    """As merged_by_text, by dot product of unit vectors with the running direction of the segment. A missing
    vector, or one of zeros, is unlike all (a product of -1)."""

    def product(now: np.ndarray | None, then: np.ndarray | None) -> float:
        return -1.0 if now is None or then is None else float(np.dot(now, then))

    def direction(now: np.ndarray | None, then: np.ndarray | None) -> np.ndarray | None:
        if now is None or then is None:
            return then if now is None else now
        both = np.add(now, then)
        n = float(np.linalg.norm(both))
        return both / n if n > 0 else now

    kind = rows.schema["video_id"].dataType.simpleString()
    observed = _observed(rows, geometry.unit(F.col("vector")))
    return folded(observed, "video_id", ["start_sec", "pos"], lambda _: _Merger(gap, lambda a, b: product(a, b) >= similarity, direction), f"video_id {kind}, {MERGED.format(members='members')}")


class _Gate:
    """Frames (video, t, id, value, brightness, sharpness)."""

    def __init__(self, base: float, dark: float, blur: float, warm_up: int, most: int | None) -> None:
        self.base, self.dark, self.blur, self.warm_up, self.most = base, dark, blur, warm_up, most
        self.last, self.seen, self.limit, self.kept = None, [], base, 0

    def told(self, value: float, brightness: float, sharpness: float) -> str:
        if sharpness < max(1.0, 0.35 * self.blur):
            return "blurred"
        if brightness < 0.4 * self.dark:
            return "dark"
        diff = None if self.last is None else abs(value - self.last)
        if diff is None or len(self.seen) < self.warm_up:
            self.last = value
            if diff is not None:
                self.seen.append(diff)
                if len(self.seen) == self.warm_up:
                    self.limit = min(max(1.2 * float(np.mean(self.seen)), 0.25 * self.base), 0.7 * self.base)
            return "warm_up"
        if diff < self.limit:
            return "lazy"
        self.last = value
        return "scene_cut" if diff > 8 * self.limit else "kept"

    def add(self, row: tuple) -> list[tuple]:
        if self.most is not None and self.kept >= self.most:
            return []
        state = self.told(*row[3:])
        self.kept += state in ("kept", "scene_cut")
        return [(row[0], row[2], state, self.limit)]

    def end(self) -> list[tuple]:
        return []


def change_gate(frames: DataFrame, base: float, dark: float, blur: float, warm_up: int = 8, most: int | None = None) -> DataFrame:
    """Which frames of (video_id, t, id, value, brightness, sharpness) are kept: sharp and bright enough, and
    changed by the threshold since the frame kept last. Differences of the warm-up set the threshold,
    and keep nothing; a change of eight thresholds is a scene cut."""
    kind = frames.schema["video_id"].dataType.simpleString()
    rows = frames.select("video_id", "t", "id", "value", "brightness", "sharpness")
    return folded(rows, "video_id", ["t", "id"], lambda _: _Gate(base, dark, blur, warm_up, most), f"video_id {kind}, id long, state string, threshold double")


class _Packer:
    """Clips (video, clip, n, -n)."""

    def __init__(self, most: int, budget: int, tolerance: float) -> None:
        self.most, self.budget, self.tolerance = most, budget, tolerance
        self.batch, self.size, self.longest = 0, 0, 0

    def add(self, row: tuple) -> list[tuple]:
        n = row[2]
        if self.size and (self.size >= self.most or n < self.longest * (1 - self.tolerance) or self.longest * (self.size + 1) > self.budget):
            self.batch, self.size = self.batch + 1, 0
        if not self.size:
            self.longest = n
        self.size += 1
        return [(row[0], row[1], self.batch)]

    def end(self) -> list[tuple]:
        return []


def packed(clips_df: DataFrame, most: int, budget: int, tolerance: float) -> DataFrame:
    """(video_id, clip, batch): clips by falling length packed greedily; a batch closes when it is full,
    when the next clip is shorter than tolerance allows, or when padded frames exceed the budget."""
    kind = clips_df.schema["video_id"].dataType.simpleString()
    rows = clips_df.select("video_id", "clip", "n", (-F.col("n")).alias("_less"))
    return folded(rows, "video_id", ["_less", "clip"], lambda _: _Packer(most, budget, tolerance), f"video_id {kind}, clip int, batch int")


def batch_summary(packed_clips: DataFrame) -> DataFrame:
    """(video_id, batches, clips_avg, clips_max, frames_real, frames_padded, padding_ratio) of packed clips
    (video_id, clip, batch, n): each clip is padded to the longest of its batch."""
    batches = packed_clips.groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("clips"), F.sum("n").alias("real"), (F.max("n") * F.count(F.lit(1))).alias("padded"))
    out = batches.groupBy("video_id").agg(F.count(F.lit(1)).alias("batches"), F.avg("clips").alias("clips_avg"), F.max("clips").alias("clips_max"), F.sum("real").alias("frames_real"), F.sum("padded").alias("frames_padded"))
    return out.withColumn("padding_ratio", F.coalesce(F.try_divide((F.col("frames_padded") - F.col("frames_real")).cast("double"), F.col("frames_padded")), F.lit(0.0)))


def clip_stats(clips_df: DataFrame) -> DataFrame:
    """(video_id, clips, frames_min, frames_max, frames_avg, flag_rate, confidence_mean) of clips (video_id, n,
    anomaly_flag, anomaly_confidence)."""
    return clips_df.groupBy("video_id").agg(F.count(F.lit(1)).alias("clips"), F.min("n").alias("frames_min"), F.max("n").alias("frames_max"), F.avg("n").alias("frames_avg"), F.avg(F.coalesce("anomaly_flag", F.lit(False)).cast("double")).alias("flag_rate"), F.avg(F.coalesce("anomaly_confidence", F.lit(0.0))).alias("confidence_mean"))


def member_vectors(segments: DataFrame, raw: DataFrame) -> DataFrame:
    """(video_id, seg, vector): the direction of the mean of the members' unit vectors. segments has
    (video_id, seg, members), raw has (video_id, pos, vector); members out of range are skipped."""
    rows = segments.select("video_id", "seg", F.explode("members").alias("pos")).join(raw.select("video_id", "pos", geometry.unit(F.col("vector")).alias("u")), ["video_id", "pos"]).where("u is not null")
    sums = rows.select("video_id", "seg", F.posexplode("u").alias("d", "x")).groupBy("video_id", "seg", "d").agg(F.sum("x").alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"])
    return sums.groupBy("video_id", "seg").agg(vector.alias("vector")).select("video_id", "seg", geometry.unit(F.col("vector")).alias("vector"))


def coherence(vectors: DataFrame) -> DataFrame:
    """(video_id, tcs, srr, sdi): mean cosine with the next segment and with the one after it."""
    order = Window.partitionBy("video_id").orderBy("seg")
    v = F.col("vector")
    rows = vectors.withColumn("near", geometry.cosine(v, F.lead("vector", 1).over(order))).withColumn("far", geometry.cosine(v, F.lead("vector", 2).over(order)))
    return rows.groupBy("video_id").agg(F.avg("near").alias("tcs"), F.avg("far").alias("srr")).withColumn("sdi", 1 - F.col("tcs"))


def novelty(vectors: DataFrame) -> DataFrame:
    """(video_id, sns): mean of 1 - cosine with the sum of all unit vectors before. Running sums are kept by
    dimension, so no row carries its whole past."""
    u = vectors.select("video_id", "seg", geometry.unit(F.col("vector")).alias("u")).where("u is not null")
    parts = u.select("video_id", "seg", F.posexplode("u").alias("d", "x"))
    before = Window.partitionBy("video_id", "d").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.withColumn("s", F.sum("x").over(before)).where("s is not null")
    scores = sums.groupBy("video_id", "seg").agg((1 - F.sum(F.col("x") * F.col("s")) / F.sqrt(F.sum(F.col("s") * F.col("s")))).alias("novelty"))
    return scores.groupBy("video_id").agg(F.avg("novelty").alias("sns"))


def shape(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, raw_clips, final_segments, compression_ratio, dd, mean_segment_duration) from segments
    (video_id, start_sec, end_sec) and videos (video_id, duration, raw_clips)."""
    counted = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("final_segments"), F.avg(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))).alias("mean_segment_duration"))
    n = F.coalesce("final_segments", F.lit(0))
    duration = F.when(F.col("duration") > 0, F.col("duration"))
    return videos.join(counted, "video_id", "left").select("video_id", "raw_clips", n.alias("final_segments"), F.try_divide(F.col("raw_clips").cast("double"), n).alias("compression_ratio"), (60.0 * n / duration).alias("dd"), "mean_segment_duration")


def tau_ablation(rows: DataFrame, taus: list[float], gap: float) -> DataFrame:
    """(video_id, tau, seg, start_sec, end_sec, members): semantic merges for each of a few thresholds."""
    out = None
    for tau in taus:
        order = Window.partitionBy("video_id").orderBy("start_sec", F.get("members", F.lit(0)))
        one = merged_by_vector(rows, tau, gap).withColumn("tau", F.lit(tau)).withColumn("seg", F.row_number().over(order) - 1)
        out = one if out is None else out.unionByName(one)
    return out


def is_monotonic(summary: DataFrame) -> DataFrame:
    """Whether segments never fall and compression never rises with tau: yes or no, nulls count as no."""
    order = Window.partitionBy().orderBy("tau")
    segs, ratio = F.lag("segments").over(order), F.lag("compression").over(order)
    first = F.row_number().over(order) == 1
    rows = summary.select((first | F.coalesce(F.col("segments") >= segs, F.lit(False))).alias("s"), (first | F.coalesce(F.col("compression") <= ratio, F.lit(False))).alias("c"))
    return rows.agg(F.when(F.every("s"), "yes").otherwise("no").alias("segments_rise"), F.when(F.every("c"), "yes").otherwise("no").alias("compression_falls"))
