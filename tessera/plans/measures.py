"""Queries of run metrics and evaluation; orders are runs, line items are samples of their stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evaluate, metrics
from tessera.plans.fixtures import SEGMENTS_SQL, segments, table
from tessera.plans.retrieval import BM25_SQL, _sparse


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("variant"), F.col("o_totalprice").alias("value"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("finished_at"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_stats(_runs(spark, sf_dir), ["profile", "variant"], ["value"])
    return out.select("profile", "variant", "runs", F.size("videos").alias("videos"), F.col("value.count").alias("n"), F.round("value.mean", 4).alias("mean"), F.round("value.std", 4).alias("std"))


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_stats(_runs(spark, sf_dir), [], ["value"])
    return out.select("runs", F.size("videos").alias("videos"), F.round("value.mean", 4).alias("mean"), F.round("value.std", 4).alias("std"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_quantity").cast("double").alias("sec"))
    return line.join(_runs(spark, sf_dir).select("run_id", "profile", "variant"), "run_id")


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_report(_samples(spark, sf_dir)).select("scope", "profile", "variant", "stage", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most", "median")])


def stage_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage maps of runs (with mean times for some), exploded and summed again; runs without a map get one
    from their scalar time."""
    entry = F.struct(F.when(F.col("sec") > 25, F.col("sec") / 2).alias("mean_sec"), F.col("sec").alias("time_sec"))
    maps = _samples(spark, sf_dir).groupBy("run_id", "stage").agg(F.max("sec").alias("sec")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", entry.alias("v")))).alias("stages"))
    runs = _runs(spark, sf_dir).join(maps, "run_id", "left").withColumn("total", F.round("value", 2))
    values = metrics.stage_values(metrics.with_default_stages(runs, "stages", {"total": "total"}), ["run_id"], "stages")
    return values.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sec"), 2).alias("sec"))


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _samples(spark, sf_dir).groupBy("run_id", "stage").agg(F.sum("sec").alias("sec")).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "sec"))).alias("m"))
    runs = _runs(spark, sf_dir).select("run_id").join(maps, "run_id", "left")
    m = F.coalesce("m", F.create_map().cast("map<string,double>"))
    return runs.select("run_id", metrics.map_total(m, None).alias("total"), metrics.map_total(m, 0.0).alias("total_or_zero"), F.size(F.map_keys(m)).alias("n"), F.concat_ws(",", F.array_sort(F.map_keys(m))).alias("stages"))


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(_runs(spark, sf_dir), "video_id", "finished_at", "run_id").select("video_id", "run_id", "finished_at")


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = metrics.latest(_runs(spark, sf_dir).withColumn("config_key", F.concat_ws("__", "profile", "variant")), "config_key", "finished_at", "run_id")
    return last.select("config_key", F.round("value", 2).alias("quality"), (F.col("run_id") % 101).cast("double").alias("latency"), F.lit(3.0).alias("cost"))


def comparison_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compared(_configs(spark, sf_dir), 0.5, 0.3, 0.2).select("config_key", "rank", F.round("quality_norm", 6).alias("quality_norm"), F.round("latency_norm", 6).alias("latency_norm"), "cost_norm", F.round("balanced_score", 6).alias("balanced_score"))


def quality_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.quality(segments(spark, sf_dir), ["video_id", "variant"], F.col("pos") < 3)
    return out.select("video_id", "variant", "segments_total", *[F.round(c, 6).alias(c) for c in ("structured_ratio", "enrichment_ratio", "anomaly_ratio", "summary_present", "quality_proxy_raw")])


def final_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    runs = r.select(F.col("profile").alias("dataset_id"), "variant", (F.col("run_id") % 7).alias("num_clips"), (F.col("run_id") % 5).alias("final_segments"), (F.col("value") / 100).alias("video_duration_sec"), F.when(F.col("run_id") % 3 > 0, F.col("value") / 50).alias("total_time_sec"), (F.col("value") / 80).alias("model_time_sec"), F.when(F.col("run_id") % 2 == 0, F.lit(2.0)).alias("dd"), (F.col("run_id") % 10 / 10).alias("tcs"))
    out = metrics.final_aggregation(runs)
    return out.select("dataset_id", "variant", "videos_processed", *[F.round(c, 4).alias(c) for c in out.columns[3:]])


def dataset_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_mktsegment").alias("dataset_id"), (F.col("c_custkey") % 900).cast("double").alias("duration_sec"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).otherwise(" ").alias("scene_id"))
    out = metrics.dataset_scale(manifest, _runs(spark, sf_dir))
    return out.select("dataset_id", "videos_total", "videos_processed", "videos_excluded", F.round("duration_hours_total", 6).alias("duration_hours_total"), F.round("duration_hours_processed", 6).alias("duration_hours_processed"), "scenes")


def ablation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), F.round("l_discount", 2).alias("alpha"), (F.col("l_quantity") / 50).alias("p_5"), F.col("l_tax").alias("mrr"))
    return metrics.ablation_means(rows, ["dataset_id", "alpha"], ["p_5", "mrr"]).select("dataset_id", "alpha", F.round("p_5", 6).alias("p_5"), F.round("mrr", 6).alias("mrr"))


def ablation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey"), F.round("l_discount", 2).alias("alpha"))
    return metrics.missing_levels(rows, ["l_suppkey"], "alpha", [0.0, 0.02, 0.05, 0.1, 0.25]).select("l_suppkey", F.size("missing").alias("n"), F.concat_ws(",", F.transform("missing", lambda x: x.cast("string"))).alias("missing"))


def scene_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.capsules(segments(spark, sf_dir), "video_id", "pos").select("video_id", F.concat_ws("|", "capsules").alias("capsules"))


def video_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summaries(segments(spark, sf_dir))
    return out.select("video_id", "total", F.concat_ws(",", "citations").alias("citations"), F.concat_ws(",", "key_events").alias("key_events"), F.col("risks.normal").alias("normal"), F.col("risks.warning").alias("warning"), F.round("people_ratio", 6).alias("people_ratio"), F.sha1("summary").alias("summary"))


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ("done", "done", "done", "running", "queued", "done", "failed"))), (F.col("l_linenumber") + 0).cast("int"))
    return metrics.batch_state(table(spark, sf_dir, "lineitem").select("l_orderkey", states.alias("state")), "l_orderkey")


def latency_p95_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.round("value", 6).alias("latency"))
    return evaluate.percentile_both(rows, ["event_type"], "latency").select("event_type", F.round("interpolated", 6).alias("interpolated"), "nearest")


def _label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each passage: some segments by name, some by time."""
    item, seg = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), segments(spark, sf_dir)
    named = item.withColumn("doc_id", F.explode(F.array(*[(F.col("query_id") * 7 + i * 3) for i in range(4)])))
    rows = named.join(seg.select("doc_id", "video_id", "segment_id", "start_sec", "end_sec"), "doc_id")
    by_time = F.col("doc_id") % 2 == 0
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return rows.select("query_id", pos.alias("pos"), F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("label_id"), "video_id", F.when(~by_time, F.col("segment_id")).alias("segment_id"), F.when(by_time, F.col("start_sec")).alias("start_sec"), F.when(by_time, F.col("end_sec")).alias("end_sec"), (F.col("doc_id") % 4).cast("double").alias("grade"))


def _hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hits of each passage, around its labels."""
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.sequence(F.lit(0), F.lit(9))).alias("i", "x"))
    hits = item.select("query_id", (F.col("i") + 1).alias("rank"), (F.col("query_id") * 7 + F.pmod(F.col("i") * 5 + F.col("query_id"), F.lit(11))).alias("doc_id"))
    return hits.join(segments(spark, sf_dir).select("doc_id", "video_id", "segment_id", "start_sec", "end_sec"), "doc_id")


def relevance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.matched(_hit_rows(spark, sf_dir), _label_rows(spark, sf_dir)).select("query_id", "rank", "label_id", "grade")


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _label_rows(spark, sf_dir)
    out = evaluate.ranking_metrics(evaluate.matched(_hit_rows(spark, sf_dir), labels), labels, [1, 5])
    return out.select("query_id", "relevant_total", "hits_total", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


def eval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ir_metrics(spark, sf_dir)
    return out.rollup((F.col("query_id") % 3).alias("target")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("ndcg_5"), 5).alias("ndcg_5"))


def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _label_rows(spark, sf_dir).withColumn("end_sec", F.when(F.col("pos") == 2, F.col("end_sec") + 3).otherwise(F.col("end_sec"))).withColumn("segment_id", F.when(F.col("grade") == 3, F.concat("segment_id", F.lit("x"))).otherwise(F.col("segment_id"))).withColumn("query_id", F.when(F.col("query_id") % 10 == 0, " ").otherwise(F.col("query_id").cast("string")))
    return evaluate.label_violations(labels, segments(spark, sf_dir))


def synthetic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("dataset_id", F.when(F.col("video_id") < "src15", "first").otherwise("second"))
    return evaluate.quota_queries(rows.where(F.length("description") >= 35), {"first": 5, "second": 4}).select("dataset_id", "video_id", "segment_id", "n")


def passage_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well BM25 finds the documents that hold a benchmark passage: relevance is containment of it."""
    from tessera.operators import search

    hits = search.top(_sparse(spark, sf_dir).withColumn("score", F.round("score", 6)), 10)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("head"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hits.join(asked, "query_id").join(docs, "doc_id").where(F.col("text").contains(F.col("head")))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.round(F.sum(1 / F.log2(F.col("rank") + 1)), 6).alias("dcg"))


QUERIES = {f.__name__: f for f in (run_stats, system_stats, stage_report, stage_maps, rollups, latest_by_key, comparison_rank, quality_proxy, final_aggregation, dataset_scale, ablation_means, ablation_gaps, scene_capsules, video_summaries, batch_states, latency_p95_both, relevance_match, ir_metrics, eval_means, label_checks, synthetic_labels, passage_retrieval)}

_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS video_id, o_orderpriority AS profile, o_orderstatus AS variant, o_totalprice AS value, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS finished_at FROM orders)"
_SAMPLES = f"{_RUNS}, smp AS (SELECT l_orderkey AS run_id, l_returnflag || l_linestatus AS stage, CAST(l_quantity AS DOUBLE) AS sec, profile, variant FROM lineitem JOIN runs ON run_id = l_orderkey)"
_LABELS = f"""{SEGMENTS_SQL}, lab AS (
    SELECT b.item_id AS query_id, row_number() OVER (PARTITION BY b.item_id ORDER BY s.doc_id) AS pos, 'l' || s.doc_id AS label_id, s.video_id, CASE WHEN s.doc_id % 2 = 1 THEN s.segment_id END AS segment_id,
           CASE WHEN s.doc_id % 2 = 0 THEN start_sec END AS start_sec, CASE WHEN s.doc_id % 2 = 0 THEN end_sec END AS end_sec, CAST(s.doc_id % 4 AS DOUBLE) AS grade
    FROM benchmark b, unnest([0, 3, 6, 9]) u(i) JOIN seg s ON s.doc_id = b.item_id * 7 + u.i)"""
_MATCH = f"""{_LABELS}, hit AS (
    SELECT b.item_id AS query_id, u.i + 1 AS rank, s.doc_id, s.video_id, s.segment_id, s.start_sec, s.end_sec FROM benchmark b, unnest(range(0, 10)) u(i) JOIN seg s ON s.doc_id = b.item_id * 7 + (u.i * 5 + b.item_id) % 11),
pr AS (
    SELECT h.query_id, h.rank, l.pos, l.label_id, l.grade, coalesce(l.segment_id = h.segment_id, false) AS sg,
           coalesce(greatest(0, least(h.end_sec, l.end_sec) - greatest(h.start_sec, l.start_sec)) / ((h.end_sec - h.start_sec) + (l.end_sec - l.start_sec) - greatest(0, least(h.end_sec, l.end_sec) - greatest(h.start_sec, l.start_sec))), 0) AS iou
    FROM hit h JOIN lab l ON l.query_id = h.query_id AND l.video_id = h.video_id AND l.grade > 0),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY grade DESC, CASE WHEN sg THEN 1 ELSE iou END DESC, pos) AS n FROM pr WHERE sg OR iou >= 0.5),
mt AS (SELECT h.query_id, h.rank, o.label_id, coalesce(o.grade, 0) AS grade FROM hit h LEFT JOIN ok o ON o.query_id = h.query_id AND o.rank = h.rank AND o.n = 1)"""
_METRICS = f"""{_MATCH}, fst AS (SELECT *, CASE WHEN label_id IS NOT NULL AND row_number() OVER (PARTITION BY query_id, label_id ORDER BY rank) = 1 THEN grade ELSE 0 END AS g FROM mt),
got AS (SELECT query_id, count(*) AS hits_total, min(CASE WHEN g > 0 THEN rank END) AS first, count_if(g > 0 AND rank <= 1) AS n1, count_if(g > 0 AND rank <= 5) AS n5,
        sum(CASE WHEN rank <= 1 THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) AS d1, sum(CASE WHEN rank <= 5 THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) AS d5 FROM fst GROUP BY query_id),
idl AS (SELECT query_id, count(*) AS relevant_total, sum(CASE WHEN i <= 1 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS i1, sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS i5
        FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM lab WHERE grade > 0) GROUP BY query_id),
met AS (SELECT query_id, coalesce(relevant_total, 0) AS relevant_total, hits_total, round(coalesce(1.0 / first, 0), 6) AS mrr, round(n1 / 1.0::DOUBLE, 6) AS p_1, round(coalesce(n1 / nullif(relevant_total, 0)::DOUBLE, 0), 6) AS recall_1,
        round(coalesce(d1 / nullif(i1, 0), 0), 6) AS ndcg_1, round(CASE WHEN first <= 1 THEN 1.0 / first ELSE 0 END, 6) AS mrr_1, round(n5 / 5.0::DOUBLE, 6) AS p_5, round(coalesce(n5 / nullif(relevant_total, 0)::DOUBLE, 0), 6) AS recall_5,
        round(coalesce(d5 / nullif(i5, 0), 0), 6) AS ndcg_5, round(CASE WHEN first <= 5 THEN 1.0 / first ELSE 0 END, 6) AS mrr_5 FROM got LEFT JOIN idl USING (query_id))"""
ORACLES = {
    "run_stats": f"WITH {_RUNS} SELECT profile, variant, count(*) AS runs, count(DISTINCT video_id) AS videos, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM runs GROUP BY ALL",
    "system_stats": f"WITH {_RUNS} SELECT count(*) AS runs, count(DISTINCT video_id) AS videos, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM runs",
    "stage_report": f"WITH {_SAMPLES} SELECT CASE WHEN grouping(profile) = 1 THEN 'system' ELSE 'profile_variant' END AS scope, profile, variant, stage, count(*) AS n, round(avg(sec), 6) AS mean, round(stddev_pop(sec), 6) AS std, round(min(sec), 6) AS least, round(max(sec), 6) AS most, round(median(sec), 6) AS median FROM smp GROUP BY GROUPING SETS ((stage), (profile, variant, stage))",
    "stage_maps": f"WITH {_SAMPLES}, m AS (SELECT run_id, stage, max(sec) AS sec FROM smp GROUP BY ALL), v AS (SELECT stage, CASE WHEN sec > 25 THEN sec / 2 ELSE sec END AS sec FROM m UNION ALL SELECT 'total', round(value, 2) FROM runs WHERE run_id NOT IN (SELECT run_id FROM m)) SELECT stage, count(*) AS n, round(sum(sec), 2) AS sec FROM v GROUP BY stage",
    "rollups": f"WITH {_SAMPLES}, m AS (SELECT run_id, sum(sec) AS t, count(DISTINCT stage) AS n, string_agg(DISTINCT stage, ',' ORDER BY stage) AS s FROM smp GROUP BY run_id) SELECT r.run_id, t AS total, coalesce(t, 0) AS total_or_zero, coalesce(n, 0) AS n, coalesce(s, '') AS stages FROM runs r LEFT JOIN m USING (run_id)",
    "latest_by_key": f"WITH {_RUNS} SELECT video_id, run_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY finished_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1",
    "comparison_rank": f"""WITH {_RUNS}, c AS (SELECT profile || '__' || variant AS config_key, round(value, 2) AS q, CAST(run_id % 101 AS DOUBLE) AS l FROM (SELECT *, row_number() OVER (PARTITION BY profile, variant ORDER BY finished_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1),
        s AS (SELECT config_key, (q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()) AS q, (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()) AS l FROM c), b AS (SELECT *, 0.5 * q - 0.3 * l - 0.2 * 0.5 AS b FROM s)
        SELECT config_key, row_number() OVER (ORDER BY b DESC, config_key) AS rank, round(q, 6) AS quality_norm, round(l, 6) AS latency_norm, 0.5::DOUBLE AS cost_norm, round(b, 6) AS balanced_score FROM b""",
    "quality_proxy": f"""WITH {SEGMENTS_SQL}, g AS (SELECT video_id, variant, count(*) AS n, avg(CAST(TRUE AS INT)) AS s, avg(CAST(len(tags) + len(objects) > 0 AS INT)) AS e, avg(CAST(anomaly_flag AS INT)) AS a, max(CAST(pos < 3 AS INT)) AS p FROM seg GROUP BY ALL)
        SELECT video_id, variant, n AS segments_total, round(s, 6) AS structured_ratio, round(e, 6) AS enrichment_ratio, round(a, 6) AS anomaly_ratio, CAST(p AS DOUBLE) AS summary_present, round(0.5 * s + 0.3 * e + 0.2 * p, 6) AS quality_proxy_raw FROM g""",
    "final_aggregation": f"""WITH {_RUNS}, r AS (SELECT profile AS dataset_id, variant, run_id % 7 AS c, run_id % 5 AS s, value / 100 AS d, CASE WHEN run_id % 3 > 0 THEN value / 50 ELSE 0 END AS t, value / 80 AS m, CASE WHEN run_id % 2 = 0 THEN 2.0 ELSE 0 END AS dd, (run_id % 10) / 10.0::DOUBLE AS tcs FROM runs)
        SELECT dataset_id, variant, count(*) AS videos_processed, round(sum(t), 4) AS total_runtime_sec, round(avg(t), 4) AS mean_runtime_sec, round(sum(t) / sum(d), 4) AS real_time_factor, round(sum(d) / sum(t), 4) AS video_seconds_per_compute_second, round(100 * sum(m) / sum(t), 4) AS model_share_pct,
               round(sum(c) / sum(s)::DOUBLE, 4) AS compression_ratio, round(avg(dd), 4) AS dd, round(avg(tcs), 4) AS tcs FROM r WHERE c > 0 AND s > 0 GROUP BY dataset_id, variant""",
    "dataset_scale": f"""WITH {_RUNS}, m AS (SELECT c_custkey, c_mktsegment AS dataset_id, (c_custkey % 900) / 3600.0::DOUBLE AS h, CASE WHEN c_nationkey > 3 THEN c_nationkey END AS scene, c_custkey IN (SELECT video_id FROM runs) AS ok FROM customer)
        SELECT dataset_id, count(*) AS videos_total, count_if(ok) AS videos_processed, count_if(NOT ok) AS videos_excluded, round(sum(h), 6) AS duration_hours_total, round(sum(CASE WHEN ok THEN h ELSE 0 END), 6) AS duration_hours_processed, count(DISTINCT scene) AS scenes FROM m GROUP BY dataset_id""",
    "ablation_means": "SELECT l_returnflag AS dataset_id, round(l_discount, 2) AS alpha, round(avg(l_quantity / 50), 6) AS p_5, round(avg(l_tax), 6) AS mrr FROM lineitem GROUP BY 1, 2",
    "ablation_gaps": "WITH g AS (SELECT l_suppkey, list(DISTINCT round(l_discount, 2)) AS have FROM lineitem GROUP BY 1), m AS (SELECT l_suppkey, list_filter([0.0::DOUBLE, 0.02, 0.05, 0.1, 0.25], lambda x: NOT list_contains(have, x)) AS missing FROM g) SELECT l_suppkey, len(missing) AS n, coalesce(array_to_string(list_transform(missing, lambda x: CAST(x AS VARCHAR)), ','), '') AS missing FROM m",
    "scene_capsules": f"""WITH {SEGMENTS_SQL}, parts AS (
            SELECT video_id, 0 AS o, 2 AS top, event_type AS v, pos AS p, 0 AS q FROM seg UNION ALL SELECT video_id, 1, 1, risk_level, pos, 0 FROM seg UNION ALL SELECT video_id, 2, 1, people_count_bucket, pos, 0 FROM seg
            UNION ALL SELECT video_id, 3, 1, motion_type, pos, 0 FROM seg UNION ALL SELECT video_id, 4, 2, unnest(anomaly_notes), pos, unnest(range(0, len(anomaly_notes))) FROM seg WHERE anomaly_flag),
        cnt AS (SELECT video_id, o, top, v, count(*) AS n, min(p * 10 + q) AS f FROM parts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, o ORDER BY n DESC, f) AS r FROM cnt),
        k AS (SELECT *, row_number() OVER (PARTITION BY video_id, lower(v) ORDER BY o, r) AS k FROM r WHERE r <= top)
        SELECT video_id, array_to_string((list(v ORDER BY o, r))[:8], '|') AS capsules FROM k WHERE k = 1 GROUP BY video_id""",
    "video_summaries": f"""WITH {SEGMENTS_SQL}, s AS (SELECT *, trim(description) AS txt FROM seg), t AS (SELECT video_id, txt, min(pos) AS p FROM s WHERE txt <> '' GROUP BY ALL),
        h AS (SELECT video_id, string_agg(txt, ' ' ORDER BY p) AS head FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY p) AS r FROM t) WHERE r <= 3 GROUP BY video_id),
        g AS (SELECT video_id, count(*) AS total, string_agg(segment_id, ',' ORDER BY pos) FILTER (pos < 10) AS citations, string_agg(event_type, ',' ORDER BY pos) FILTER (pos < 3) AS key_events, count_if(pos < 5 AND risk_level = 'normal') AS normal, count_if(pos < 5 AND risk_level = 'warning') AS warning,
              count_if(pos < 5 AND people_count_bucket <> 'none') / count(*)::DOUBLE AS pr, count_if(anomaly_flag OR risk_level <> 'normal') AS att FROM s GROUP BY video_id)
        SELECT video_id, total, citations, key_events, normal, warning, round(pr, 6) AS people_ratio, sha1(head || CASE WHEN att > 0 THEN ' ' || att || ' segment(s) require attention based on visible anomaly signals.' ELSE '' END) AS summary FROM g JOIN h USING (video_id)""",
    "batch_states": "WITH s AS (SELECT l_orderkey, list_extract(['done', 'done', 'done', 'running', 'queued', 'done', 'failed'], CAST(l_linenumber AS INT)) AS s FROM lineitem) SELECT l_orderkey, CASE WHEN bool_and(s = 'done') THEN 'done' WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'running') THEN 'running' ELSE 'queued' END AS state FROM s GROUP BY l_orderkey",
    "latency_p95_both": "SELECT event_type, round(quantile_cont(round(value, 6), 0.95), 6) AS interpolated, quantile_disc(round(value, 6), 0.95) AS nearest FROM events GROUP BY event_type",
    "relevance_match": f"WITH {_MATCH} SELECT query_id, rank, label_id, grade FROM mt",
    "ir_metrics": f"WITH {_METRICS} SELECT * FROM met",
    "eval_means": f"WITH {_METRICS} SELECT query_id % 3 AS target, count(*) AS queries, round(avg(mrr), 5) AS mrr, round(avg(ndcg_5), 5) AS ndcg_5 FROM met GROUP BY ROLLUP (query_id % 3)",
    "label_checks": f"""WITH {_LABELS}, m AS (SELECT label_id, CASE WHEN query_id % 10 = 0 THEN ' ' ELSE CAST(query_id AS VARCHAR) END AS q, video_id, CASE WHEN grade = 3 THEN segment_id || 'x' ELSE segment_id END AS s, start_sec AS a, CASE WHEN pos = 2 THEN end_sec + 3 ELSE end_sec END AS b FROM lab)
        SELECT label_id, 'blank query' AS error FROM m WHERE trim(q) = '' UNION ALL SELECT label_id, 'unknown segment' FROM m WHERE s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seg c WHERE c.video_id = m.video_id AND c.segment_id = m.s)
        UNION ALL SELECT label_id, 'interval outside of segments' FROM m WHERE s IS NULL AND a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seg c WHERE c.video_id = m.video_id AND c.start_sec <= m.a + 1e-6 AND c.end_sec >= m.b - 1e-6)""",
    "synthetic_labels": f"""WITH {SEGMENTS_SQL}, o AS (SELECT *, CASE WHEN video_id < 'src15' THEN 'first' ELSE 'second' END AS dataset_id, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS k FROM seg WHERE length(description) >= 35),
        r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY video_id) AS n FROM o WHERE k = 1) SELECT dataset_id, video_id, segment_id, n FROM r WHERE n <= CASE dataset_id WHEN 'first' THEN 5 ELSE 4 END""",
    "passage_retrieval": f"""WITH {BM25_SQL}, t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)
        SELECT query_id, count(*) AS hits, min(rank) AS first, round(sum(1 / log2(rank + 1)), 6) AS dcg FROM t JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 10 AND contains(d.text, b.text) GROUP BY query_id""",
}
