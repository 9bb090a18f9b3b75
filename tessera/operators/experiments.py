"""Experiments: ablations joined with what archives measured, checks across tables, cases, annotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import loose_float


def dataset_by_prefix(video: Column, prefixes: dict[str, str], default: str | None = None) -> Column:
    """The dataset whose prefix a video's name has; an error, or the default, for others."""
    out = F.raise_error(F.concat(F.lit("unknown dataset of "), video)) if default is None else F.lit(default)
    for prefix, name in reversed(prefixes.items()):
        out = F.when(video.startswith(prefix), name).otherwise(out)
    return out


def common_dataset(datasets: Column, several: str) -> Column:
    """The dataset that all of a query's targets are in, or the name for several."""
    kinds = F.array_distinct(datasets)
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(several)


def with_reference(rows: DataFrame, reference: DataFrame, keys: list[str], fields: dict[str, str], order: str) -> DataFrame:
    """rows with fields (new name: name) of the last reference row of their keys; null without one."""
    last = reference.groupBy(*keys).agg(F.max_by(F.struct(*fields.values()), order).alias("_ref"))
    return rows.join(last, keys, "left").select(*[F.col(c) for c in rows.columns], *[F.col(f"_ref.{old}").alias(new) for new, old in fields.items()])


def with_archive(rows: DataFrame, archive: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """rows with fields of the first archive row of their keys, which must be there."""
    first = archive.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_first"), F.lit(True).alias("_there"))
    joined = rows.join(first, keys, "left")
    name = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no archive metrics for "), name))).otherwise(F.col(keys[0]))
    return joined.withColumn(keys[0], there).select(*rows.columns, *[F.col(f"_first.{f}").alias(f) for f in fields])


def consistent(indexes: DataFrame, archives: DataFrame) -> DataFrame:
    """(variant, num_docs, segments, passed): whether each index holds as many documents as the archives of its
    variant have segments."""
    sums = archives.groupBy("variant").agg(F.sum("final_segments").alias("segments"))
    rows = indexes.join(sums, "variant", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return rows.select("variant", "num_docs", "segments", (F.col("num_docs") == F.col("segments")).alias("passed"))


# Kinds of cases, in order, and how many of each there are.
CASES, EACH = ("success", "partial", "failure"), 3


def qualitative_cases(queries: DataFrame) -> DataFrame:
    """(kind, n, query_id): the best and worst queries (query_id, seq, p_1, ndcg_5, top_video, top_text) and the
    first that are neither, of those that have a top result; the next best stand in where these are too few."""
    def filled(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) != ""

    normal = queries.where(filled("top_video") & filled("top_text"))
    up = Window.orderBy(F.desc("p_1"), F.desc("ndcg_5"), "seq")
    down = Window.orderBy("p_1", "ndcg_5", "seq")
    between = F.coalesce((F.col("ndcg_5") > 0) & (F.col("ndcg_5") < 1), F.lit(False))
    rows = normal.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).withColumn("_mid", F.when(between, F.row_number().over(Window.partitionBy(between).orderBy("seq"))))
    rows = rows.withColumn("_enough", F.count("_mid").over(Window.partitionBy()) >= EACH)
    middle = F.when(F.col("_enough"), F.col("_mid")).otherwise(F.when(F.col("_up") > EACH, F.col("_up") - EACH))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), n.cast("int").alias("n")) for k, n in zip(CASES, (F.col("_up"), middle, F.col("_down")), strict=True)])
    return rows.select("query_id", F.explode(kinds).alias("x")).where(F.col("x.n") <= EACH).select("x.kind", "x.n", "query_id")


def annotation_errors(queries: DataFrame, labels: DataFrame, catalog: DataFrame, datasets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, label_id, error): all that is wrong with reviewed annotations. queries has (seq, query_id, query,
    language, video_id, dataset_id, negative_query, reviewed), labels (seq of the query, label_id, video_id, grade,
    segment_id, start_sec, end_sec, all of them text), catalog (video_id, segment_id, start_sec, end_sec) and datasets
    (video_id, dataset_id)."""
    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    own = Window.partitionBy("_id").orderBy("seq")
    q = queries.withColumn("_id", text("query_id")).withColumn("_turn", F.row_number().over(own))
    q = q.join(labels.groupBy("seq").agg(F.count(F.lit(1)).alias("_labels")), "seq", "left")
    asked = [
        F.when(~F.coalesce("reviewed", F.lit(False)), "not reviewed"),
        F.when(F.col("_id") == "", "blank query_id"),
        F.when((F.col("_id") != "") & (F.col("_turn") > 1), "repeated query_id"),
        F.when(text("query") == "", "blank query"),
        F.when(text("language") == "", "blank language"),
        F.when(F.col("_labels").isNull() & ~F.coalesce("negative_query", F.lit(False)), "no targets"),
    ]
    of_query = q.select(F.col("_id").alias("query_id"), F.lit(None).cast("string").alias("label_id"), F.explode(F.array_compact(F.array(*asked))).alias("error"))

    l = labels.join(q.select("seq", F.col("_id").alias("_query"), F.col("video_id").alias("_video"), text("dataset_id").alias("_dataset")), "seq")
    l = l.withColumn("_label", text("label_id")).withColumn("_at", F.coalesce(F.nullif(text("video_id"), F.lit("")), text("_video"))).withColumn("_segment", text("segment_id"))
    l = l.withColumn("_turn", F.row_number().over(Window.partitionBy("seq", "_label").orderBy("pos"))).withColumn("_a", loose_float(F.col("start_sec"))).withColumn("_b", loose_float(F.col("end_sec")))
    videos = catalog.select(F.col("video_id").alias("_at"), F.lit(True).alias("_known")).distinct()
    segs = catalog.select(F.col("video_id").alias("_at"), F.col("segment_id").alias("_segment"), F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"))
    l = l.join(videos, "_at", "left").join(segs, ["_at", "_segment"], "left").join(datasets.select(F.col("video_id").alias("_at"), F.col("dataset_id").alias("_own")), "_at", "left")
    timed = l.where("_segment = '' and _a is not null and _b is not null").alias("l")
    inside = (F.col("l._at") == F.col("c.video_id")) & (F.col("c.start_sec") <= F.col("l._a") + tolerance) & (F.col("c.end_sec") >= F.col("l._b") - tolerance)
    held = timed.join(catalog.alias("c"), inside, "left_semi").select("seq", "pos", F.lit(True).alias("_held"))
    l = l.join(held, ["seq", "pos"], "left")
    interval = F.col("start_sec").isNotNull() | F.col("end_sec").isNotNull()
    numbers = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    sound = numbers & (F.abs("_a") < math.inf) & (F.abs("_b") < math.inf) & (F.col("_a") >= 0) & (F.col("_b") > F.col("_a"))
    found = F.col("_s").isNotNull()
    within = (F.col("_a") >= F.col("_s") - tolerance) & (F.col("_b") <= F.col("_e") + tolerance)
    checks = [
        F.when(F.col("_label") == "", "blank label_id"),
        F.when((F.col("_label") != "") & (F.col("_turn") > 1), "repeated label_id"),
        F.when(F.col("_known").isNull(), "unknown video"),
        F.when(~F.coalesce(F.trim("grade").isin("1", "2", "3"), F.lit(False)), "grade isn't 1, 2 or 3"),
        F.when((F.col("_segment") == "") & ~interval, "neither segment nor interval"),
        F.when((F.col("_segment") != "") & ~found, "unknown segment"),
        F.when(interval & ~numbers, "interval isn't numeric"),
        F.when(interval & numbers & ~sound, "invalid interval"),
        F.when(interval & sound & found & ~within, "interval outside of its segment"),
        F.when(interval & sound & (F.col("_segment") == "") & F.col("_held").isNull(), "interval outside of segments"),
        F.when((F.col("_dataset") != "") & ~F.col("_dataset").eqNullSafe(F.col("_own")), "video of another dataset"),
    ]
    return of_query.unionByName(l.select(F.col("_query").alias("query_id"), F.col("_label").alias("label_id"), F.explode(F.array_compact(F.array(*checks))).alias("error")))


def language_split(queries: DataFrame) -> DataFrame:
    """queries with part: english, or multilingual."""
    return queries.withColumn("part", F.when(F.lower(F.trim(F.coalesce("language", F.lit("")))) == "en", "english").otherwise("multilingual"))


def wildcard_matches(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, target_id): targets that a query is for. A blank profile, variant or video of a query matches any;
    profiles and variants match in any case, videos as they are."""
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(F.col(f"q.{c}"), F.lit(""))) == ""

    def low(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))

    # queries that leave the same fields blank meet targets by the others, which are equal
    fields = ("video_id", "profile", "variant")
    asked = queries.alias("q").select("query_id", F.concat(*[F.when(blank(c), "0").otherwise("1") for c in fields]).alias("_kind"), F.trim("q.video_id").alias("_video_id"), *[low(c).alias(f"_{c}") for c in fields[1:]])
    asked = asked.select("query_id", "_kind", *[F.when(F.substring("_kind", k + 1, 1) == "1", F.col(f"_{c}")).otherwise("").alias(f"_{c}") for k, c in enumerate(fields)])
    kinds = sorted(r[0] for r in asked.select("_kind").distinct().collect())  # eight at most
    known = targets.select("target_id", F.explode(F.array(*map(F.lit, kinds)).cast("array<string>")).alias("_kind"), F.col("video_id").alias("_video_id"), *[low(c).alias(f"_{c}") for c in fields[1:]])
    known = known.select("target_id", "_kind", *[F.when(F.substring("_kind", k + 1, 1) == "1", F.col(f"_{c}")).otherwise("").alias(f"_{c}") for k, c in enumerate(fields)])
    return asked.join(known, ["_kind", *[f"_{c}" for c in fields]]).select("query_id", "target_id")


def batch_results(rows: DataFrame) -> DataFrame:
    """(batch, videos, done, failed, seconds, seconds_per_video) of runs (batch, video_id, status, seconds)."""
    good = F.col("status") == "done"
    out = rows.groupBy("batch").agg(F.countDistinct("video_id").alias("videos"), F.count_if(good).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(good, F.col("seconds"))).alias("seconds"))
    return out.withColumn("seconds_per_video", F.try_divide(F.col("seconds"), F.col("done")))
