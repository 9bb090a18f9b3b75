"""Queries of the flows around runs: artifacts, experiments, translation, work; orders are runs, customers are
videos, line items are events of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, experiments, jobs, translate, views
from tessera.plans.fixtures import SEGMENTS_SQL, segments, table


def _text(c: Column) -> Column:
    return c.cast("string")


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics documents updated one level deep."""
    k = F.col("c_custkey")
    section = F.create_map(F.lit("a"), _text(k), F.lit("b"), F.lit("old"))
    old = F.when(k % 5 > 0, F.create_map(F.lit("x"), section, F.lit("y"), section))
    new = F.when(k % 7 > 0, F.create_map(F.lit("x"), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("1")), F.lit("z"), section))
    rows = table(spark, sf_dir, "customer").select("c_custkey", catalog.merged_documents(old, new).alias("m"))
    flat = F.transform(F.array_sort(F.map_keys("m")), lambda s: F.concat(s, F.lit("{"), F.concat_ws(",", F.transform(F.array_sort(F.map_keys(F.col("m")[s])), lambda x: F.concat_ws("=", x, F.col("m")[s][x]))), F.lit("}")))
    return rows.select("c_custkey", F.concat_ws("", flat).alias("document"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "", "ready", "failed", "done", " "))), F.col("l_linenumber").cast("int"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("video_id"), F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("v"), _text(F.col("l_suppkey") % 3))).otherwise("").alias("variant"), F.when(F.col("l_orderkey") % 2 == 0, "en").otherwise("ru").alias("language"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), status.alias("status"), F.when(F.col("l_linenumber") == 5, F.concat(F.lit("error "), _text(F.col("l_orderkey")))).alias("last_error"))


def language_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.language_states(_events(spark, sf_dir))


def variant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.variant_index(catalog.language_states(_events(spark, sf_dir))).select("video_id", "variant", "updated_at", F.concat_ws(",", "languages").alias("languages"))


def output_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = catalog.language_states(_events(spark, sf_dir))
    videos = table(spark, sf_dir, "customer").where("c_custkey < 500").select(F.col("c_custkey").alias("video_id"), F.lit("v1").alias("variant"))
    wanted = videos.select("*", F.explode(F.array(F.lit("en"), F.lit("ru"))).alias("language"))
    return catalog.readiness(states, wanted, 1000.0).select("video_id", "variant", "ready", F.concat_ws(",", "failures").alias("failures"))


def video_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, metrics and orders of customers, as what is stored of videos."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    videos = c.select(k.alias("video_id"), F.when(k % 2 == 0, "v").alias("variant"), F.lit("en").alias("language"))
    manifest = c.where("c_custkey % 3 > 0").select(k.alias("video_id"), F.when(k % 2 == 0, "v").alias("variant"), F.col("c_name").alias("name"))
    metrics = c.where("c_custkey % 4 > 0").select(k.alias("video_id"), F.col("c_acctbal").alias("balance"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("text"))
    out = catalog.outputs(videos, {"manifest": manifest, "metrics": metrics}, {"segments": rows})
    return out.select("video_id", "variant", F.col("manifest.name").alias("name"), F.col("metrics.balance").alias("balance"), F.concat_ws(",", F.transform("segments", lambda x: F.concat(_text(x["pos"]), x["text"]))).alias("segments"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, (*catalog.REQUIRED, "summary"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    variant = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("v"), _text(F.col("l_suppkey") % 2)))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), variant.alias("variant"), name.alias("artifact"))


def run_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = catalog.targets(_artifacts(spark, sf_dir))
    return good.select("run_id", F.lit("").alias("missing")).unionByName(bad.select("run_id", F.concat_ws(",", "missing").alias("missing")))


def experiment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    several = F.when(k % 3 == 0, F.create_map(F.lit("Base"), F.lit("1"), F.lit(" no_merge"), F.lit("2")))
    rows = table(spark, sf_dir, "orders").select(k.alias("seq"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise(" Done").alias("status"), F.when(k % 2 == 0, "V08").alias("profile"), F.concat(F.lit(" v"), _text(F.col("o_custkey") % 300)).alias("video_id"), F.when(k % 4 == 0, F.lit(2)).alias("run_idx"), F.when(k % 5 > 0, F.concat(F.lit("u"), _text(F.col("o_custkey") % 50))).alias("unit_key"), F.lit("Alt").alias("variant"), several.alias("variant_results"))
    return catalog.experiment_targets(rows)


def preferred_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.element_at(F.array(*map(F.lit, ("EN ", "unknown", "", "None", "ru"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    run = F.element_at(F.array(*map(F.lit, ("kz", "", "unset"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.preferred_language(own, run).alias("language"))


def run_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("variant"))
    return catalog.selected_runs(catalog.selected_runs(runs, " 1-urgent"), "", "f").select("o_orderkey")


def metrics_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    runs = table(spark, sf_dir, "orders").select(k.alias("video_id"), F.lit("en").alias("language"), F.col("o_orderstatus").alias("variant"), F.lit("main").alias("profile"), F.lit("fp").alias("config_fingerprint"), F.when(k % 3 > 0, _text(k)).otherwise("n/a").alias("preprocess_time_sec"), F.lit(None).cast("string").alias("model_time_sec"), F.lit(" 2.5 ").alias("postprocess_time_sec"), _text(k % 7).alias("total_time_sec"), (k % 100).alias("num_frames"), (k % 10).alias("num_clips"), v.alias("avg_clip_duration_sec"), F.when(k % 2 == 0, "ru").alias("metrics_language"), F.lit("cpu").alias("device"))
    out = catalog.metrics_summary(runs)
    times = F.transform(F.array_sort(F.map_keys("timings")), lambda t: F.concat_ws("=", t, _text(F.col("timings")[t])))
    return out.select("video_id", "variant", F.concat_ws(",", times).alias("timings"), "counters.num_frames", "counters.language")


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), _text(F.col("p_partkey"))).alias("video_id"), F.concat(F.lit("/in/"), _text(F.col("p_partkey"))).alias("source_path"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), _text(F.col("s_suppkey"))).alias("video_id"))
    return catalog.importable(manifest, manifest.select(F.col("source_path").alias("path")), known)


def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _text(F.col("s_suppkey"))
    s = table(spark, sf_dir, "supplier")
    wanted = s.select(F.concat(F.lit("table "), k).alias("label"), F.explode(F.array(F.concat(F.lit("t"), k, F.lit(".csv")), F.concat(F.lit("t"), k, F.lit(".json")))).alias("name"))
    files = s.select(F.concat(F.lit("results/"), F.lit("t"), k, F.lit(".csv")).alias("path"), (F.col("s_suppkey") + 10).alias("length"), F.sha2("s_name", 256).alias("sha256")).unionByName(s.select(F.concat(F.lit("other/t"), k, F.lit(".json")).alias("path"), F.lit(0).cast("long").alias("length"), F.lit("").alias("sha256")))
    return catalog.package_list(wanted, files)


def visual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tokens = catalog.visual_tokens(F.when(k % 9 > 0, k % 256), k % 100 / 1000.0, k % 7, k % 5, k % 3)
    return table(spark, sf_dir, "events").select("event_id", catalog.dense_text(F.concat(F.lit(" "), "event_type"), tokens).alias("text"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("seq"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("variant"), (k % 5 / 4.0).alias("alpha"), (k % 2 == 0).alias("rerank_enabled"), F.round(F.col("o_totalprice") % 1, 6).alias("mrr"))


def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an ablation with what was measured at alpha 0.5 without reranking."""
    rows = _settings(spark, sf_dir)
    reference = rows.where((F.round("alpha", 2) == 0.5) & ~F.col("rerank_enabled") & (F.col("seq") % 3 > 0))
    found = experiments.with_reference(rows.select("seq", "profile", "variant"), reference, ["profile", "variant"], {"MRR": "mrr"}, "seq")
    return found.select("seq", "MRR")


def archive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settings(spark, sf_dir)
    means = rows.groupBy("profile", "variant", "alpha").agg(F.round(F.avg("mrr"), 6).alias("mrr"))
    out = experiments.with_archive(means, rows.withColumn("tcs", F.col("mrr")), ["profile", "variant"], ["tcs"], "seq")
    return out.select("profile", "variant", "alpha", "mrr", "tcs")


def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("variant"), (F.col("o_orderkey") % 4).alias("final_segments"))
    indexes = archives.groupBy("variant").agg((F.sum("final_segments") + F.when(F.col("variant") == "P", 1).otherwise(0)).alias("num_docs")).unionByName(spark.range(1).select(F.lit("none").alias("variant"), F.lit(0).cast("long").alias("num_docs")))
    return experiments.consistent(indexes, archives)


def dataset_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.concat(F.when(F.col("o_custkey") % 3 > 0, "first_").otherwise("second_"), _text(F.col("o_custkey")))
    one = experiments.dataset_by_prefix(video, {"first_": "first_full", "second_": "second_full"})
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 700).alias("query_id"), one.alias("dataset"))
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list("dataset")).alias("d")).select("query_id", experiments.common_dataset(F.col("d"), "cross_dataset").alias("dataset"))


def qualitative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("query_id"), k.alias("seq"), (k % 2).cast("double").alias("p_1"), (k % 11 / 10.0).alias("ndcg_5"), F.when(k % 4 > 0, F.col("c_name")).otherwise(" ").alias("top_video"), F.col("c_name").alias("top_text"))
    return experiments.qualitative_cases(rows)


def _annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Annotated queries, and labels with faults of each kind."""
    k = F.col("c_custkey")
    q = table(spark, sf_dir, "customer").select(k.alias("seq"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit("q"), _text(F.when(k % 13 == 0, k - 1).otherwise(k)))).alias("query_id"), F.when(k % 19 == 0, "").otherwise(F.col("c_name")).alias("query"), F.when(k % 23 == 0, F.lit(None)).when(k % 2 == 0, "EN").otherwise("ru").alias("language"), F.when(k % 3 == 0, F.concat(F.lit("src"), _text(k % 20))).alias("video_id"), F.when(k % 5 == 0, "d1").alias("dataset_id"), (k % 4 == 0).alias("negative_query"), (k % 29 > 0).alias("reviewed"))
    seg = segments(spark, sf_dir)
    p = F.col("doc_id")
    labels = seg.where("doc_id % 2 = 1").select((p % 100 + 1).alias("seq"), p.alias("pos"), F.when(p % 31 == 0, "").otherwise(F.concat(F.lit("l"), _text(p % 90))).alias("label_id"), F.when(p % 7 == 0, " ").when(p % 37 == 0, "nowhere").otherwise(F.col("video_id")).alias("video_id"), F.element_at(F.array(*map(F.lit, ("1", "2", "3", "4", "x", " 1 "))), (p % 6 + 1).cast("int")).alias("grade"), F.when(p % 3 > 0, F.when(p % 41 == 0, "lost").otherwise(F.col("segment_id"))).alias("segment_id"), F.when(p % 5 > 0, _text(F.col("start_sec") - F.when(p % 9 == 0, 4).otherwise(0))).alias("start_sec"), F.when(p % 5 > 1, F.when(p % 11 == 0, "late").otherwise(_text(F.col("end_sec") - F.when(p % 8 == 0, 9).otherwise(0)))).alias("end_sec"))
    return q, labels


def annotation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).select("video_id", "segment_id", "start_sec", "end_sec")
    datasets = seg.select("video_id").distinct().select("video_id", F.when(F.col("video_id") < "src3", "d1").otherwise("d2").alias("dataset_id"))
    return experiments.annotation_errors(*_annotations(spark, sf_dir), seg, datasets)


def annotation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.language_split(_annotations(spark, sf_dir)[0]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def wildcard_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    queries = table(spark, sf_dir, "supplier").select(k.alias("query_id"), F.when(k % 2 == 0, " 1-Urgent").alias("profile"), F.when(k % 3 == 0, "f").otherwise("").alias("variant"), _text(k).alias("video_id"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("variant"), _text(F.col("o_custkey")).alias("video_id"))
    return experiments.wildcard_matches(queries, targets)


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("batch"), F.col("o_custkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"), F.col("o_totalprice").alias("seconds"))
    out = experiments.batch_results(rows)
    return out.select("batch", "videos", "done", "failed", F.round("seconds", 2).alias("seconds"), F.round("seconds_per_video", 4).alias("seconds_per_video"))


def _mock(c: Column) -> Column:
    return F.concat(F.lit("[RU] "), c)


def translation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns looked up in a cache that holds the assistant's, and is told wrong on purpose to show where a text
    comes from."""
    key = translate.cache_key(F.col("text"), F.lit("EN"), F.lit("kk"), "m", "1", "fp")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", key.alias("key"))
    cache = turns.where("role = 'assistant'").select("key", F.concat(F.lit("kept "), "text").alias("translated")).dropDuplicates(["key"])
    out, _ = translate.through_cache(turns, cache, _mock)
    return out.select("conv_id", "turn", "key", F.sha1("translated").alias("translated"))


def selective_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir).select("doc_id", "video_id", "pos", F.col("description").alias("text"), F.when(F.col("doc_id") % 9 > 0, _mock(F.col("description"))).otherwise(" ").alias("translated"), "anomaly_flag", "risk_level")
    out = translate.post_edited(seg, lambda _, mt: F.when(F.length(mt) % 2 == 0, F.concat(mt, F.lit("!"))).otherwise(mt), 3, "en", "ru")
    return out.select("doc_id", F.sha1("translated").alias("translated"), "post_edited")


def summary_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    view = F.struct(F.lit("old").alias("mt_text"), F.lit(True).alias("post_edited"))
    rows = table(spark, sf_dir, "customer").select(k.alias("video_id"), F.when(k % 5 > 0, F.when(k % 2 == 0, "").otherwise(F.col("c_name"))).alias("global_summary"), F.when(k % 3 > 0, F.lit("short")).alias("summary"), F.when(k % 7 > 0, F.create_map(F.lit("ru"), view, F.lit("kz"), view)).alias("translation_views"))
    out = translate.translated_summaries(rows, _mock, "ru", lambda _, mt: F.when(F.length(mt) > 8, F.concat(mt, F.lit("."))))
    views_text = F.transform(F.array_sort(F.map_keys("translation_views")), lambda x: F.concat(x, F.lit("="), F.col("translation_views")[x]["mt_text"], F.lit(":"), _text(F.col("translation_views")[x]["post_edited"])))
    return out.select("video_id", "language", "global_summary", F.concat_ws("|", views_text).alias("views"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("process", "Translate", "index", "summary_polish", "odd"))), (k % 5 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "leased", "queued", "paused"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("j"), _text(k)).alias("job_id"), kind.alias("job_type"), state.alias("state"), k.alias("place"), F.when(k % 6 == 3, (k % 100).cast("double")).when(k % 6 == 1, 60.0).alias("lease_until"), F.when(k % 11 > 0, F.col("o_custkey")).alias("video_id"), F.when(k % 2 == 0, "x").alias("variant"), F.when(k % 13 > 0, "EN").alias("language"))


def role_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _jobs(spark, sf_dir).select("job_id", "job_type", "place")
    out = None
    for role, paused in (("GPU", False), ("worker_cpu", False), ("any", False), ("mt", True)):
        one = jobs.claimed(rows, role, paused).select(F.lit(role).alias("role"), "job_id", "claim", "priority")
        out = one if out is None else out.unionByName(one)
    return out


def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty jobs taken by a worker, and beats of that worker and of another one."""
    taken = jobs.leased(_jobs(spark, sf_dir).select("job_id", "state", "lease_until", "place"), "w1", 100.0, 30.0, 50)
    beats = taken.select("job_id", F.when(F.col("place") % 2 == 0, "w1").otherwise("w2").alias("owner"), F.explode(F.array(F.lit(110.0), (F.col("place") % 40 + 100).cast("double"))).alias("at"))
    return jobs.heard(taken, beats, 30.0).select("job_id", "state", "owner", "lease_until")


def created_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    live = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.lit("index").alias("job_type"), F.lit("main").alias("profile"), F.lit(None).cast("string").alias("variant"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("source_language"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"), F.lit(None).cast("double").alias("lease_until"), F.col("o_orderkey").alias("created_at"))
    asked = table(spark, sf_dir, "customer").select(k.alias("request_id"), F.when(k % 10 == 0, k - 1).otherwise(k).alias("video_id"), F.lit("index").alias("job_type"), F.lit("main").alias("profile"), F.lit(None).cast("string").alias("variant"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("source_language"))
    return jobs.created(asked, live, 0.0)


def failure_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.failure_entries(_jobs(spark, sf_dir).withColumn("error", F.lit("broken"))).select("job_id", "kind", "name", "status")


def variant_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("video_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("variant_ids")).withColumn("batch_id", F.concat(F.lit("b"), _text(F.col("video_id"))))
    return jobs.variant_jobs(rows).select("job_id", "video_id", "variant", "pos")


def stopped_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _jobs(spark, sf_dir).select("job_id", "state", "place")
    action = F.element_at(F.array(*map(F.lit, ("pause", "cancel", "resume"))), (F.col("at") % 3 + 1).cast("int"))
    flags = rows.where("place % 2 = 0").select("job_id", F.explode(F.array(F.col("place") % 7, F.col("place") % 5 + 7)).alias("at")).select("job_id", "at", action.alias("action"))
    return jobs.stopped(rows, flags).select("job_id", "state", "cancel_requested")


def hit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.citations(views.annotation_hits(segments(spark, sf_dir).withColumn("normalized_caption", F.when(F.col("doc_id") % 2 == 0, F.col("description")).otherwise("")), 4)).select("video_id", "start_sec", "end_sec", "segment_id", "variant")


def annotation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).withColumn("normalized_caption", F.when(F.col("doc_id") % 2 == 0, "caption").otherwise(""))
    return views.annotation_hits(rows, 5).select("video_id", "rank", F.sha1("description").alias("description"), "score", "segment_id", F.size("tags").alias("tags"))


QUERIES = {f.__name__: f for f in (merged_documents, language_states, variant_index, output_readiness, video_outputs, run_targets, experiment_targets, preferred_languages, run_selection, metrics_summaries, import_rows, package_rows, visual_texts, reference_join, archive_join, index_consistency, dataset_prefix, qualitative_cases, annotation_checks, annotation_split, wildcard_targets, batch_results, translation_cache, selective_edits, summary_views, role_claims, job_leases, created_jobs, failure_entries, variant_jobs, stopped_jobs, hit_citations, annotation_hits)}

_EVENTS = """ev AS (SELECT l_orderkey % 500 AS video_id, CASE WHEN l_suppkey % 3 > 0 THEN 'v' || (l_suppkey % 3) ELSE '' END AS variant, CASE WHEN l_orderkey % 2 = 0 THEN 'en' ELSE 'ru' END AS language, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS at_, l_orderkey * 10 + l_linenumber AS seq,
    list_extract(['queued', 'running', '', 'ready', 'failed', 'done', ' '], CAST(l_linenumber AS INT)) AS status, CASE WHEN l_linenumber = 5 THEN 'error ' || l_orderkey END AS last_error FROM lineitem),
    ls AS (SELECT video_id, variant, language, max(at_) AS updated_at, last(status ORDER BY at_, seq) FILTER (trim(status) <> '') AS status, last(last_error ORDER BY at_, seq) FILTER (last_error IS NOT NULL) AS last_error FROM ev GROUP BY ALL)"""
_SETTINGS = "st AS (SELECT o_orderkey AS seq, o_orderpriority AS profile, o_orderstatus AS variant, (o_orderkey % 5) / 4.0::DOUBLE AS alpha, o_orderkey % 2 = 0 AS rerank, round(o_totalprice % 1, 6) AS mrr FROM orders)"
_JOBS = """jb AS (SELECT 'j' || o_orderkey AS job_id, list_extract(['process', 'Translate', 'index', 'summary_polish', 'odd'], CAST(o_orderkey % 5 + 1 AS INT)) AS job_type, list_extract(['queued', 'running', 'done', 'leased', 'queued', 'paused'], CAST(o_orderkey % 6 + 1 AS INT)) AS state, o_orderkey AS place,
    CASE WHEN o_orderkey % 6 = 3 THEN CAST(o_orderkey % 100 AS DOUBLE) WHEN o_orderkey % 6 = 1 THEN 60.0::DOUBLE END AS lease_until, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS video_id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS variant, CASE WHEN o_orderkey % 13 > 0 THEN 'EN' END AS language FROM orders)"""
_ANNOTATIONS = f"""{SEGMENTS_SQL},
aq AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'q' || CASE WHEN c_custkey % 13 = 0 THEN c_custkey - 1 ELSE c_custkey END END AS id, CASE WHEN c_custkey % 19 = 0 THEN '' ELSE c_name END AS query, CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'EN' ELSE 'ru' END AS lang, CASE WHEN c_custkey % 3 = 0 THEN 'src' || (c_custkey % 20) ELSE '' END AS qvideo,
       CASE WHEN c_custkey % 5 = 0 THEN 'd1' ELSE '' END AS ds, c_custkey % 4 = 0 AS neg, c_custkey % 29 > 0 AS rev FROM customer),
al AS (SELECT doc_id % 100 + 1 AS seq, doc_id AS pos, CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'l' || (doc_id % 90) END AS label, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 37 = 0 THEN 'nowhere' ELSE video_id END AS lvideo, trim(list_extract(['1', '2', '3', '4', 'x', ' 1 '], CAST(doc_id % 6 + 1 AS INT))) AS grade,
       CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 41 = 0 THEN 'lost' ELSE segment_id END ELSE '' END AS segment, CASE WHEN doc_id % 5 > 0 THEN start_sec - CASE WHEN doc_id % 9 = 0 THEN 4 ELSE 0 END END AS a,
       doc_id % 5 > 0 OR doc_id % 5 > 1 AS timed, CASE WHEN doc_id % 5 > 1 AND doc_id % 11 > 0 THEN end_sec - CASE WHEN doc_id % 8 = 0 THEN 9 ELSE 0 END END AS b FROM seg WHERE doc_id % 2 = 1)"""
ORACLES = {
    "merged_documents": """WITH d AS (SELECT c_custkey AS k, c_custkey % 5 > 0 AS o, c_custkey % 7 > 0 AS n FROM customer)
        SELECT k AS c_custkey, CASE WHEN o AND n THEN 'x{a=' || k || ',b=new,c=1}y{a=' || k || ',b=old}z{a=' || k || ',b=old}' WHEN o THEN 'x{a=' || k || ',b=old}y{a=' || k || ',b=old}' WHEN n THEN 'x{b=new,c=1}z{a=' || k || ',b=old}' ELSE '' END AS document FROM d""",
    "language_states": f"WITH {_EVENTS} SELECT * FROM ls",
    "variant_index": f"WITH {_EVENTS} SELECT video_id, variant, max(updated_at) AS updated_at, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM ls WHERE variant <> '' GROUP BY ALL",
    "output_readiness": f"""WITH {_EVENTS}, w AS (SELECT c_custkey AS video_id, 'v1' AS variant, unnest(['en', 'ru']) AS language FROM customer WHERE c_custkey < 500),
        r AS (SELECT w.*, coalesce(updated_at >= 1000 AND status IN ('ready', 'done', 'failed'), false) AS ended, coalesce(updated_at >= 1000 AND status = 'failed', false) AS bad FROM w LEFT JOIN ls USING (video_id, variant, language))
        SELECT video_id, variant, bool_and(ended) AS ready, coalesce(string_agg(language || ':failed', ',' ORDER BY language) FILTER (bad), '') AS failures FROM r GROUP BY ALL""",
    "video_outputs": """WITH o AS (SELECT o_custkey, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
        SELECT c_custkey AS video_id, CASE WHEN c_custkey % 2 = 0 THEN 'v' END AS variant, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance, coalesce(s, '') AS segments FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "run_targets": """WITH a AS (SELECT l_orderkey AS v, CASE WHEN l_orderkey % 3 = 0 THEN 'v' || (l_suppkey % 2) ELSE '' END AS x, list(DISTINCT list_extract(['clip_observations', 'metrics', 'run_manifest', 'summary'], CAST(l_linenumber % 4 + 1 AS INT))) AS h FROM lineitem GROUP BY ALL)
        SELECT v || CASE WHEN x <> '' THEN '_' || x ELSE '' END AS run_id, array_to_string(list_filter(['clip_observations', 'metrics', 'run_manifest'], lambda y: NOT list_contains(h, y)), ',') AS missing FROM a""",
    "experiment_targets": """WITH r AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'v08' ELSE 'main' END AS profile, 'v' || (o_custkey % 300) AS video_id, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS run_idx, CASE WHEN o_orderkey % 5 > 0 THEN 'u' || (o_custkey % 50) ELSE '' END AS unit, o_orderkey % 3 = 0 AS several FROM orders WHERE o_orderstatus <> 'O'),
        e AS (SELECT *, unnest(CASE WHEN several THEN ['base', 'no_merge'] ELSE ['alt'] END) AS variant FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY video_id, profile, variant, run_idx, unit ORDER BY seq) AS n FROM e)
        SELECT CASE WHEN several THEN unit || '__' || variant WHEN unit <> '' THEN unit ELSE profile || ':' || variant || ':' || video_id || ':run' || run_idx END AS target_id, video_id, profile, variant, run_idx FROM f WHERE n = 1""",
    "preferred_languages": """WITH l AS (SELECT c_custkey, trim(lower(list_extract(['EN ', 'unknown', '', 'None', 'ru'], CAST(c_custkey % 5 + 1 AS INT)))) AS a, list_extract(['kz', '', 'unset'], CAST(c_custkey % 3 + 1 AS INT)) AS b FROM customer)
        SELECT c_custkey, CASE WHEN a NOT IN ('', 'unknown', 'none') THEN a WHEN b NOT IN ('', 'unset') THEN b WHEN a <> '' THEN a ELSE b END AS language FROM l""",
    "run_selection": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    "metrics_summaries": "SELECT o_orderkey AS video_id, o_orderstatus AS variant, 'postprocess_time_sec=2.5' || CASE WHEN o_orderkey % 3 > 0 THEN ',preprocess_time_sec=' || CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR) ELSE '' END || ',total_time_sec=' || CAST(CAST(o_orderkey % 7 AS DOUBLE) AS VARCHAR) AS timings, o_orderkey % 100 AS num_frames, CASE WHEN o_orderkey % 2 = 0 THEN 'ru' ELSE 'en' END AS language FROM orders",
    "import_rows": "SELECT 'v' || p_partkey AS video_id, '/in/' || p_partkey AS source_path FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)",
    "package_rows": "SELECT 'table ' || s_suppkey AS label, 'results/t' || s_suppkey || '.csv' AS path, s_suppkey + 10 AS bytes, sha256(s_name) AS sha256 FROM supplier",
    "visual_texts": """WITH e AS (SELECT event_id AS k, event_type, event_id % 256 AS l, event_id % 100 / 1000.0::DOUBLE AS g, event_id % 7 AS b, event_id % 5 AS gr, event_id % 3 AS r FROM events)
        SELECT k AS event_id, event_type || CASE WHEN k % 9 > 0 THEN ' vf_brightness_' || CASE WHEN l < 55 THEN 'dark' WHEN l < 120 THEN 'dim' WHEN l < 190 THEN 'normal' ELSE 'bright' END || ' vf_edges_' || CASE WHEN g < 0.03 THEN 'low' WHEN g < 0.08 THEN 'mid' ELSE 'high' END || ' vf_color_' || CASE WHEN b >= gr AND b >= r THEN 'blue' WHEN gr >= r THEN 'green' ELSE 'red' END ELSE '' END AS text FROM e""",
    "reference_join": f"WITH {_SETTINGS}, r AS (SELECT profile, variant, arg_max(mrr, seq) AS m FROM st WHERE alpha = 0.5 AND NOT rerank AND seq % 3 > 0 GROUP BY ALL) SELECT seq, m AS \"MRR\" FROM st LEFT JOIN r USING (profile, variant)",
    "archive_join": f"WITH {_SETTINGS}, f AS (SELECT profile, variant, arg_min(mrr, seq) AS tcs FROM st GROUP BY ALL) SELECT profile, variant, alpha, round(avg(mrr), 6) AS mrr, max(tcs) AS tcs FROM st JOIN f USING (profile, variant) GROUP BY ALL",
    "index_consistency": "WITH a AS (SELECT o_orderstatus AS variant, sum(o_orderkey % 4) AS s FROM orders GROUP BY 1) SELECT variant, s + CASE WHEN variant = 'P' THEN 1 ELSE 0 END AS num_docs, s AS segments, variant <> 'P' AS passed FROM a UNION ALL SELECT 'none', 0, 0, true",
    "dataset_prefix": "SELECT o_orderkey % 700 AS query_id, CASE WHEN bool_and(o_custkey % 3 > 0) THEN 'first_full' WHEN bool_and(o_custkey % 3 = 0) THEN 'second_full' ELSE 'cross_dataset' END AS dataset FROM orders GROUP BY 1",
    "qualitative_cases": """WITH n AS (SELECT c_custkey AS q, c_custkey % 2 AS p, (c_custkey % 11) / 10.0::DOUBLE AS g FROM customer WHERE c_custkey % 4 > 0),
        r AS (SELECT *, row_number() OVER (ORDER BY p DESC, g DESC, q) AS u, row_number() OVER (ORDER BY p, g, q) AS d FROM n), m AS (SELECT q, row_number() OVER (ORDER BY q) AS i FROM n WHERE g > 0 AND g < 1)
        SELECT 'success' AS kind, u AS n, q AS query_id FROM r WHERE u <= 3 UNION ALL SELECT 'partial', i, q FROM m WHERE i <= 3 UNION ALL SELECT 'failure', d, q FROM r WHERE d <= 3""",
    "annotation_checks": f"""WITH {_ANNOTATIONS}, q1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS turn, seq IN (SELECT seq FROM al) AS labelled FROM aq),
        l1 AS (SELECT al.*, q.id, q.ds, CASE WHEN lvideo = '' THEN qvideo ELSE lvideo END AS v, row_number() OVER (PARTITION BY al.seq, label ORDER BY pos) AS turn FROM al JOIN aq q ON q.seq = al.seq),
        l2 AS (SELECT l1.*, v IN (SELECT video_id FROM seg) AS known, s.start_sec AS s, s.end_sec AS e, CASE WHEN v NOT IN (SELECT video_id FROM seg) THEN NULL WHEN v < 'src3' THEN 'd1' ELSE 'd2' END AS own, a IS NOT NULL AND b IS NOT NULL AS num, EXISTS (SELECT 1 FROM seg c WHERE c.video_id = l1.v AND c.start_sec <= a + 1e-6 AND c.end_sec >= b - 1e-6) AS held FROM l1 LEFT JOIN seg s ON s.video_id = l1.v AND s.segment_id = l1.segment)
        SELECT id AS query_id, NULL AS label_id, unnest(list_filter([CASE WHEN NOT rev THEN 'not reviewed' END, CASE WHEN id = '' THEN 'blank query_id' END, CASE WHEN id <> '' AND turn > 1 THEN 'repeated query_id' END, CASE WHEN query = '' THEN 'blank query' END, CASE WHEN lang IS NULL THEN 'blank language' END, CASE WHEN NOT labelled AND NOT neg THEN 'no targets' END], lambda x: x IS NOT NULL)) AS error FROM q1
        UNION ALL SELECT id, label, unnest(list_filter([CASE WHEN label = '' THEN 'blank label_id' END, CASE WHEN label <> '' AND turn > 1 THEN 'repeated label_id' END, CASE WHEN NOT known THEN 'unknown video' END, CASE WHEN grade NOT IN ('1', '2', '3') THEN 'grade isn''t 1, 2 or 3' END, CASE WHEN segment = '' AND NOT timed THEN 'neither segment nor interval' END,
            CASE WHEN segment <> '' AND s IS NULL THEN 'unknown segment' END, CASE WHEN timed AND NOT num THEN 'interval isn''t numeric' END, CASE WHEN timed AND num AND NOT (a >= 0 AND b > a) THEN 'invalid interval' END, CASE WHEN num AND a >= 0 AND b > a AND s IS NOT NULL AND NOT (a >= s - 1e-6 AND b <= e + 1e-6) THEN 'interval outside of its segment' END,
            CASE WHEN num AND a >= 0 AND b > a AND segment = '' AND NOT held THEN 'interval outside of segments' END, CASE WHEN ds <> '' AND own IS DISTINCT FROM ds THEN 'video of another dataset' END], lambda x: x IS NOT NULL)) FROM l2""",
    "annotation_split": "SELECT CASE WHEN c_custkey % 23 > 0 AND c_custkey % 2 = 0 THEN 'english' ELSE 'multilingual' END AS part, count(*) AS n FROM customer GROUP BY 1",
    "wildcard_targets": "SELECT s_suppkey AS query_id, o_orderkey AS target_id FROM supplier JOIN orders ON o_custkey = s_suppkey AND (s_suppkey % 2 > 0 OR o_orderpriority = '1-URGENT') AND (s_suppkey % 3 > 0 OR o_orderstatus = 'F')",
    "batch_results": "SELECT o_orderkey % 40 AS batch, count(DISTINCT o_custkey) AS videos, count_if(o_orderstatus <> 'F') AS done, count_if(o_orderstatus = 'F') AS failed, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 2) AS seconds, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F') / nullif(count_if(o_orderstatus <> 'F'), 0), 4) AS seconds_per_video FROM orders GROUP BY 1",
    "translation_cache": "WITH c AS (SELECT *, sha1(sha1(text) || '|en|kz|m|1|fp') AS key FROM conversations), k AS (SELECT DISTINCT key FROM c WHERE role = 'assistant') SELECT conv_id, turn, key, sha1(CASE WHEN key IN (SELECT key FROM k) THEN 'kept ' || text ELSE trim('[RU] ' || text, ' ') END) AS translated FROM c",
    "selective_edits": f"""WITH {SEGMENTS_SQL}, t AS (SELECT doc_id, video_id, pos, CASE WHEN doc_id % 9 > 0 THEN '[RU] ' || description ELSE ' ' END AS mt, anomaly_flag OR risk_level <> 'normal' AS look FROM seg), n AS (SELECT *, sum(CAST(look AS INT)) OVER (PARTITION BY video_id ORDER BY pos) AS turn FROM t),
        e AS (SELECT *, look AND turn <= 3 AND trim(mt) <> '' AS edit FROM n) SELECT doc_id, sha1(CASE WHEN edit THEN trim(CASE WHEN length(mt) % 2 = 0 THEN mt || '!' ELSE mt END, ' ') ELSE mt END) AS translated, edit AND trim(CASE WHEN length(mt) % 2 = 0 THEN mt || '!' ELSE mt END, ' ') <> mt AS post_edited FROM e""",
    "summary_views": """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 2 > 0 THEN c_name WHEN c_custkey % 3 > 0 THEN 'short' END AS s FROM customer), m AS (SELECT k, '[RU] ' || s || CASE WHEN length('[RU] ' || s) > 8 THEN '.' ELSE '' END AS x, length('[RU] ' || s) > 8 AS e FROM t WHERE s IS NOT NULL)
        SELECT k AS video_id, 'ru' AS language, x AS global_summary, CASE WHEN k % 7 > 0 THEN 'kz=old:true|' ELSE '' END || 'ru=' || x || ':' || e AS views FROM m""",
    "role_claims": f"""WITH {_JOBS}, c AS (SELECT role, job_id, lower(job_type) AS t, CASE role WHEN 'mt' THEN 'wait' WHEN 'any' THEN 'run' WHEN 'GPU' THEN CASE WHEN job_type = 'process' THEN 'run' ELSE 'requeue' END ELSE CASE WHEN job_type IN ('index', 'summary_polish') THEN 'run' ELSE 'requeue' END END AS claim FROM jb, (VALUES ('GPU'), ('worker_cpu'), ('any'), ('mt')) r(role))
        SELECT role, job_id, claim, CASE WHEN claim = 'requeue' THEN CASE t WHEN 'translate' THEN 20 WHEN 'summary_polish' THEN 25 WHEN 'index' THEN 30 ELSE 10 END END AS priority FROM c""",
    "job_leases": f"""WITH {_JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY state = 'queued' ORDER BY place, job_id) AS turn FROM jb), t AS (SELECT job_id, place, state = 'queued' AND turn <= 50 AS take, state, lease_until FROM n)
        SELECT job_id, CASE WHEN take THEN 'leased' ELSE state END AS state, CASE WHEN take THEN 'w1' END AS owner, CASE WHEN take AND place % 2 = 0 AND greatest(110, place % 40 + 100) <= 130 THEN greatest(130.0, greatest(110, place % 40 + 100) + 30.0)::DOUBLE WHEN take THEN 130.0::DOUBLE ELSE lease_until END AS lease_until FROM t""",
    "created_jobs": """WITH l AS (SELECT o_custkey AS v, min(o_orderkey) AS j FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), a AS (SELECT c_custkey AS r, CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS v FROM customer)
        SELECT r AS request_id, coalesce(CAST(j AS VARCHAR), 'job_' || sha1(a.v || '|index|main|-|en|-')[:12]) AS job_id, j IS NULL AS is_new, 30 AS priority FROM a LEFT JOIN l ON l.v = a.v""",
    "failure_entries": f"""WITH {_JOBS}, f AS (SELECT job_id, lower(job_type) AS t, video_id IS NOT NULL AS v, language IS NOT NULL AS l, coalesce(variant, 'base') AS x FROM jb)
        SELECT job_id, 'manifest' AS kind, x || '/en' AS name, 'failed' AS status FROM f WHERE v AND l AND t IN ('process', 'translate') UNION ALL SELECT job_id, 'batch', x, 'failed' FROM f WHERE v AND t = 'process' UNION ALL SELECT job_id, 'job', job_id, 'failed' FROM f UNION ALL SELECT job_id, 'index', 'state', 'failed' FROM f""",
    "variant_jobs": "WITH d AS (SELECT DISTINCT o_custkey % 200 AS v, o_orderpriority AS p FROM orders) SELECT 'b' || v || '_' || p AS job_id, v AS video_id, p AS variant, row_number() OVER (PARTITION BY v ORDER BY p) - 1 AS pos FROM d",
    "stopped_jobs": f"""WITH {_JOBS}, a AS (SELECT job_id, state, CASE WHEN place % 2 = 0 THEN list_extract(['pause', 'cancel', 'resume'], CAST((place % 5 + 7) % 3 + 1 AS INT)) END AS act FROM jb)
        SELECT job_id, CASE WHEN act = 'cancel' AND state IN ('queued', 'paused') THEN 'canceled' WHEN act = 'pause' AND state IN ('queued', 'paused') THEN 'paused' WHEN act = 'resume' AND state = 'paused' THEN 'queued' ELSE state END AS state, coalesce(act = 'cancel' AND state IN ('running', 'leased'), false) AS cancel_requested FROM a""",
    "hit_citations": f"WITH {SEGMENTS_SQL} SELECT video_id, start_sec, end_sec, segment_id, variant FROM seg WHERE pos < 4",
    "annotation_hits": f"WITH {SEGMENTS_SQL} SELECT video_id, pos + 1 AS rank, sha1(CASE WHEN doc_id % 2 = 0 THEN 'caption' ELSE description END) AS description, 1.0::DOUBLE AS score, segment_id, len(tags) AS tags FROM seg WHERE pos < 5",
}
