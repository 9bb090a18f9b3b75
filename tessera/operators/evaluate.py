"""Evaluation of rankings against graded labels, and checks of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry


def normalised_labels(labels: DataFrame) -> DataFrame:
    """Grades: 1 where none is given, never below 0."""
    return labels.withColumn("grade", F.greatest(F.lit(0.0), F.coalesce(F.col("grade").cast("double"), F.lit(1.0))))


def matched(hits: DataFrame, labels: DataFrame, iou: float = 0.5) -> DataFrame:
    """(query_id, rank, label_id, grade): the label that each hit stands for, or none. Labels are tried in
    their order: the same segment wins over a strictly lower grade only, an interval also with an equal
    grade and a larger overlap. A query has few labels; they are folded for each hit."""
    pair = hits.alias("h").join(labels.where("grade > 0").alias("l"), F.col("h.query_id") == F.col("l.query_id"), "left")
    blank = [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in ("h.video_id", "l.video_id")]
    same_video = blank[0] | blank[1] | (F.col("h.video_id") == F.col("l.video_id"))
    same_segment = F.coalesce((F.col("h.segment_id") == F.col("l.segment_id")) & (F.col("h.segment_id") != ""), F.lit(False))
    over = geometry.ordered_iou(F.col("h.start_sec"), F.col("h.end_sec"), F.col("l.start_sec"), F.col("l.end_sec"))
    fits = F.col("l.label_id").isNotNull() & same_video & (same_segment | F.coalesce(over >= iou, F.lit(False)))
    row = F.when(fits, F.struct(F.col("l.pos").cast("long").alias("pos"), F.col("l.label_id").cast("string").alias("label_id"), F.col("l.grade").alias("grade"), same_segment.alias("seg"), F.coalesce(over, F.lit(0.0)).alias("iou")))
    lists = pair.groupBy("h.query_id", "h.rank").agg(F.sort_array(F.collect_list(row)).alias("ls"))
    zero = F.struct(F.lit(None).cast("string").alias("label_id"), F.lit(0.0).alias("grade"), F.lit(0.0).alias("iou"))

    def step(best: Column, x: Column) -> Column:
        better = (x["grade"] > best["grade"]) | (~x["seg"] & (x["grade"] == best["grade"]) & (x["iou"] > best["iou"]))
        return F.when(better, F.struct(x["label_id"].alias("label_id"), x["grade"].alias("grade"), F.when(x["seg"], 1.0).otherwise(x["iou"]).alias("iou"))).otherwise(best)

    return lists.select("query_id", "rank", F.aggregate("ls", zero, step).alias("b")).select("query_id", "rank", "b.label_id", "b.grade")


def ranking_metrics(found: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: precision (over k), recall, nDCG and MRR at each k, and MRR. A label counts once, where it
    is met first."""
    order = Window.partitionBy("query_id", "label_id").orderBy("rank")
    hit = F.col("label_id").isNotNull() & (F.col("grade") > 0)
    once = found.withColumn("g", F.when(hit & (F.row_number().over(order) == 1), F.col("grade")).otherwise(0.0))
    gain = (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col("rank") + 1)
    parts = [F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("hits_total")]
    for k in ks:
        inside = F.col("rank") <= k
        parts += [F.count_if(inside & (F.col("g") > 0)).alias(f"n{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"d{k}")]
    got = once.groupBy("query_id").agg(*parts)
    best = labels.where("grade > 0").groupBy("query_id", "label_id").agg(F.max("grade").alias("grade"))
    best = best.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal_gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1)
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant_total"), *[F.sum(F.when(F.col("i") <= k, ideal_gain).otherwise(0.0)).alias(f"i{k}") for k in ks])
    both = got.join(ideal, "query_id", "left")
    out = [F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        ndcg = F.coalesce(F.try_divide(F.col(f"d{k}"), F.col(f"i{k}")), F.lit(0.0))
        checked = F.when((ndcg < -1e-12) | (ndcg > 1 + 1e-9), F.raise_error(F.lit(f"nDCG@{k} out of range"))).otherwise(ndcg)
        out += [(F.col(f"n{k}") / k).alias(f"p_{k}"), F.coalesce(F.try_divide(F.col(f"n{k}").cast("double"), F.col("relevant_total")), F.lit(0.0)).alias(f"recall_{k}"), checked.alias(f"ndcg_{k}"), F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0).alias(f"mrr_{k}")]
    return both.select("query_id", F.coalesce("relevant_total", F.lit(0)).alias("relevant_total"), "hits_total", *out)


def percentile_both(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The percentile by interpolation and by nearest rank."""
    return rows.groupBy(*keys).agg(F.percentile(value, share).alias("interpolated"), F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("nearest"))


def label_violations(labels: DataFrame, catalog: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(label_id, error): labels without a query, with a segment that the catalog lacks, or with an interval
    that no segment of its video contains."""
    blank = labels.where(F.trim(F.coalesce("query_id", F.lit(""))) == "").select("label_id", F.lit("blank query").alias("error"))
    named = labels.where("segment_id is not null").join(catalog.select("video_id", "segment_id"), ["video_id", "segment_id"], "left_anti").select("label_id", F.lit("unknown segment").alias("error"))
    timed = labels.where("segment_id is null and start_sec is not null").alias("l")
    inside = (F.col("l.video_id") == F.col("c.video_id")) & (F.col("c.start_sec") <= F.col("l.start_sec") + tolerance) & (F.col("c.end_sec") >= F.col("l.end_sec") - tolerance)
    loose = timed.join(catalog.alias("c"), inside, "left_anti").select("label_id", F.lit("interval outside of segments").alias("error"))
    return blank.unionByName(named).unionByName(loose)


def quota_queries(segments: DataFrame, quotas: dict[str, int], dataset: str = "dataset_id") -> DataFrame:
    """The first fitting segment of each video, in order, up to each dataset's quota."""
    one = segments.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy("pos"))).where("_n = 1")
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])[F.col(dataset)]
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy(dataset).orderBy("video_id")))
    return ranked.where(F.col("n") <= F.coalesce(quota, F.lit(0))).drop("_n")
