"""Queries of checks, jobs, library views, grounded text, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import grounded, jobs, quality
from tessera.plans.fixtures import SEGMENTS_SQL, table
from tessera.plans.retrieval import _ranked_segments, _ranked_sql
from tessera.plans.texts import _redacted
from tessera.sources.shared import scratch
from tessera.streaming import events as streams


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manifest rows, all columns text."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k)
    text = {
        "dataset_id": F.when(k % 50 == 0, " ").otherwise(F.concat(F.lit("ds"), (k % 3).cast("string"))),
        "video_id": F.concat(F.lit("v"), F.when(k % 41 == 0, k - 1).otherwise(k).cast("string")),
        "source_path": F.when(k % 37 == 0, F.concat(F.lit("mock://"), k.cast("string"))).otherwise(F.concat(F.lit("/Data/"), F.when(k % 43 == 0, k - 1).otherwise(k).cast("string"))),
        "split": F.when(k % 4 == 0, "train").otherwise("test"),
        "duration_sec": F.when(k % 29 == 0, "abc").otherwise((k % 31).cast("string")),
        "fps": F.lit("25"),
        "width": F.lit("640"),
        "height": F.when(k % 100 == 1, "1d").otherwise("480"),
    }
    return rows.select(*[text.get(c, F.lit("")).alias(c) for c in quality.MANIFEST], k.alias("k"))


def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.manifest_errors(_manifest(spark, sf_dir)).select("video_id", F.concat_ws(";", "errors").alias("errors"))


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir).where("k % 41 > 0 and k % 43 > 0 and k % 37 > 0").drop("k")
    halves = [rows.where("split = 'train'"), rows.where("split = 'test'")]
    return quality.merged_manifests(halves).groupBy("dataset_id", "split").agg(F.count(F.lit(1)).alias("n"))


def manifest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir).where("k % 41 > 0")
    return quality.slice_of(rows.where("dataset_id = 'ds1'"), "k", "v40", "v130", 20).select("video_id", "k")


def artifact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("clip_observations", "segments", "summary")))
    missing = F.filter(names, lambda x: (F.length(x) + k) % 5 == 0)
    corrupted = F.filter(names, lambda x: (F.length(x) + k) % 7 == 0)
    rows = table(spark, sf_dir, "orders").select(k, F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing").alias("status"), missing.alias("missing"), corrupted.alias("corrupted"))
    return rows.select("o_orderkey", quality.artifact_class(F.col("status"), k % 11 > 0, F.col("missing"), F.col("corrupted")).alias("class"), F.concat_ws(",", "missing").alias("missing"))


def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), (F.min("o_orderkey") % 4).alias("clips"))
    c = table(spark, sf_dir, "customer").join(runs, "c_custkey", "left")
    told = quality.run_class(F.col("c_custkey") % 13 == 0, F.col("n").isNotNull(), F.col("clips"), F.col("n") - 5)
    return c.select(told.alias("t"), F.col("c_mktsegment").alias("variant")).groupBy("variant", "t.status", "t.action").agg(F.count(F.lit(1)).alias("n"))


def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha1("text").alias("fingerprint"), "doc_id")
    known = docs.where("doc_id % 5 > 0").select("path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return quality.file_changes(docs.where("doc_id % 11 > 0"), known)


def incremental_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search documents after the update that incremental_diff tells."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.lit("old").alias("version"))
    out = quality.updated_docs(docs.where("doc_id % 5 > 0"), docs.withColumn("version", F.lit("new")), incremental_diff(spark, sf_dir))
    return out.select("doc_id", "version")


def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.sha1(F.col("vec_id").cast("string")).alias("hash"), F.col("embedding").alias("vector"))
    known, missing = quality.to_embed(v, v.where("doc_id % 3 = 0").select("doc_id"), v.where("doc_id % 2 = 0"), v.where("doc_id % 5 = 0"))
    return known.select("doc_id", F.lit("known").alias("state")).unionByName(missing.select("doc_id", F.lit("missing").alias("state")))


def dataset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.concat(F.lit("ds"), (F.col("o_custkey") % 4).cast("string")).alias("dataset_id"))
    return quality.dataset_of(rows)


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    items = o.select((F.col("o_orderkey") % 3 * 10 + 10).alias("priority"), F.substring("o_orderpriority", 1, 1).alias("tag"), F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"))
    known = o.where("o_custkey % 2 = 0").select(F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("o_custkey").alias("video_id"))
    return items, known


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queued(*_queue(spark, sf_dir)).select("job_id", "video_id", "place", jobs.queue_name(F.col("priority"), F.col("tag"), F.col("job_id")).alias("file"))


def queue_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = jobs.queued(*_queue(spark, sf_dir))
    fifth = queue.where("place = 5").select("job_id").first()
    once = jobs.moved(queue, fifth.job_id if fifth else "", "down", 3)
    return jobs.moved(once, fifth.job_id if fifth else "", "top").select("job_id", "place")


def job_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    live = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.lit("process").alias("job_type"), F.lit("main").alias("profile"), F.when(F.col("o_orderstatus") == "F", "x").alias("variant"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("source_language"), F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise("queued").alias("state"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(10.0)).alias("lease_until"), (F.col("o_orderkey") % 97).alias("created_at"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("video_id"), F.lit("process").alias("job_type"), F.lit("main").alias("profile"), F.when(F.col("c_custkey") % 2 == 0, "x").alias("variant"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("source_language"))
    return jobs.reusable(asked, live, 50.0)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ("queued", "leased", "running", "running", "indexing", "done", "failed"))), F.col("l_linenumber").cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("job_id"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("at"), F.col("l_linenumber").cast("long").alias("seq"), states.alias("state"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.current(_log(spark, sf_dir))


def job_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful stream over the log as files; its last answer for each job."""
    path = scratch(spark, "joblog")
    _log(spark, sf_dir).write.parquet(f"{path}/log")
    stream = streams.job_states(spark.readStream.schema("job_id long, at double, seq long, state string").parquet(f"{path}/log"))
    out = f"{path}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("job_id long, state string, at double, batch int").parquet(out)
    return rows.groupBy("job_id").agg(F.max_by("state", "batch").alias("state"), F.max_by("at", "batch").alias("at"))


def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "leased").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("state"), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 100).cast("double")).alias("lease_until"))
    return jobs.stale(o, 50.0)


def most_recent_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"), F.when(F.col("o_orderkey") % 2 == 0, day).alias("updated_at"), F.when(F.col("o_orderkey") % 3 == 0, day).alias("started_at"), (day - 30).alias("created_at"))
    return jobs.most_recent_running(o).select("job_id", "at")


def matrix_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.sql(jobs.matrix(profile=["main", "v08"], variant=["", "no_merge"]))
    videos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"))
    return videos.join(F.broadcast(grid))


def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("language"))
    return jobs.pending(wanted, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderstatus").alias("language")), ["video_id", "language"])


def follow_up_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.when(F.col("o_orderkey") % 2 == 0, "en").otherwise("ru").alias("language"))
    return jobs.follow_ups(done, {"ru": 20, "kz": 30})


def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    videos = table(spark, sf_dir, "customer").select(k.alias("video_id"), F.col("c_name").alias("filename"), (k * 3600.0).alias("mtime"), F.when(k % 5 == 0, "Observed ").when(k % 7 == 0, "failed").alias("status"), F.when(k % 3 == 0, F.array(F.lit("en"))).when(k % 3 == 1, F.array(F.lit("en"), F.lit("ru"))).otherwise(F.array().cast("array<string>")).alias("languages"), F.when(k % 4 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("variants"), F.when(k % 2 == 0, F.lit("seen")).alias("summary"))
    return jobs.library(videos, status="ready", tag="translated", days=30, now=1500 * 3600.0, text="TOMER", sort="name").select("video_id", "status", F.concat_ws(",", "tags").alias("tags"))


def translated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation with translations by place; where there is none, the text itself."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), "text")
    made = turns.where("pos % 2 = 0").select("video_id", "pos", F.when(F.col("video_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("[RU] "), F.col("text"))).alias("text"))
    return jobs.translated(turns, made).select("video_id", "pos", F.sha1("text").alias("sha1"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_segments(spark, sf_dir, 8)


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded.context(_hits(spark, sf_dir)).select("query_id", F.sha1("context").alias("context"))


def grounded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounded.guarded(grounded.report(_hits(spark, sf_dir)), "report").withColumn("report", F.sha1("report"))


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id")))
    return grounded.with_fallback(queries, grounded.answer(_hits(spark, sf_dir)), "answer", grounded.NO_ANSWER).withColumn("answer", F.sha1("answer"))


def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed(table(spark, sf_dir, "events"), "6 hours", "3 hours", "1 hour")
    return out.select(F.unix_seconds("begins").alias("begins"), F.unix_seconds("ends").alias("ends"), "event_type", "n", F.round("total", 4).alias("total"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(table(spark, sf_dir, "events"), "4 hours", "1 hour")
    return out.select("user_id", F.unix_micros("begins").alias("begins"), F.unix_micros("ends").alias("ends"), "n")


QUERIES = {f.__name__: f for f in (manifest_validation, manifest_merge, manifest_slice, artifact_classes, run_audit, incremental_diff, incremental_docs, embedding_reuse, dataset_map, queue_order, queue_reorder, job_reuse, job_states, job_states_streamed, stale_leases, most_recent_running, matrix_cross, pending_jobs, follow_up_jobs, library_filter, translated_turns, context_blocks, grounded_reports, grounded_answers, sliding_events, session_events)}

_MANIFEST = """m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE 'ds' || (p_partkey % 3) END AS dataset_id, 'v' || CASE WHEN p_partkey % 41 = 0 THEN p_partkey - 1 ELSE p_partkey END AS video_id,
    CASE WHEN p_partkey % 37 = 0 THEN 'mock://' || p_partkey ELSE '/Data/' || CASE WHEN p_partkey % 43 = 0 THEN p_partkey - 1 ELSE p_partkey END END AS source_path, CASE WHEN p_partkey % 4 = 0 THEN 'train' ELSE 'test' END AS split FROM part)"""
_DIFF = """now AS (SELECT 'f' || doc_id AS path, sha1(text) AS a FROM documents WHERE doc_id % 11 > 0), known AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha1(text) END AS b FROM documents WHERE doc_id % 5 > 0),
    diff AS (SELECT coalesce(n.path, k.path) AS path, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'deleted' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM now n FULL JOIN known k ON n.path = k.path)"""
_QUEUE = "q AS (SELECT 'job_' || o_orderkey AS job_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS video_id, o_orderkey % 3 * 10 + 10 AS priority, o_orderpriority[1] AS tag, row_number() OVER (ORDER BY o_orderkey % 3, o_orderpriority[1], 'job_' || o_orderkey) AS place FROM orders)"
_LOG = "log AS (SELECT l_orderkey AS job_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS day, l_linenumber AS seq, list_extract(['queued', 'leased', 'running', 'running', 'indexing', 'done', 'failed'], CAST(l_linenumber AS INT)) AS state FROM lineitem), lg AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY state IN ('done', 'failed', 'canceled') DESC, day DESC, seq DESC) AS n FROM log)"
_HITS = f"{_ranked_sql(8)}, h AS (SELECT *, printf('%.1f', round_even(start_sec, 1)) AS a, printf('%.1f', round_even(end_sec, 1)) AS b FROM hits)"
ORACLES = {
    "manifest_validation": f"""WITH {_MANIFEST}, c AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS ids, count(*) OVER (PARTITION BY lower(source_path)) AS paths FROM m),
        e AS (SELECT video_id, list_filter([CASE WHEN trim(dataset_id) = '' THEN 'blank dataset_id' END, CASE WHEN ids > 1 THEN 'duplicate video_id' END, CASE WHEN paths > 1 THEN 'duplicate source_path' END, CASE WHEN k % 37 = 0 THEN 'mock source' END,
              CASE WHEN k % 29 = 0 OR k % 31 = 0 THEN 'duration_sec isn''t positive' END, CASE WHEN k % 100 = 1 THEN 'height isn''t positive' END], lambda x: x IS NOT NULL) AS e FROM c) SELECT video_id, array_to_string(e, ';') AS errors FROM e WHERE len(e) > 0""",
    "manifest_merge": f"WITH {_MANIFEST} SELECT dataset_id, split, count(*) AS n FROM m WHERE k % 41 > 0 AND k % 43 > 0 AND k % 37 > 0 GROUP BY ALL",
    "manifest_slice": f"WITH {_MANIFEST} SELECT video_id, k FROM m WHERE dataset_id = 'ds1' AND k % 41 > 0 AND k BETWEEN 40 AND 130 ORDER BY k LIMIT 20",
    "artifact_classes": """WITH n AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS ready, list_filter(['clip_observations', 'segments', 'summary'], lambda x: (length(x) + o_orderkey) % 5 = 0) AS mi, list_filter(['clip_observations', 'segments', 'summary'], lambda x: (length(x) + o_orderkey) % 7 = 0) AS co FROM orders)
        SELECT k AS o_orderkey, CASE WHEN ready AND len(mi) + len(co) = 0 THEN 'complete' WHEN k % 11 = 0 THEN 'missing_manifest' WHEN ready THEN 'manifest_ready_but_incomplete' WHEN len(co) > 0 THEN 'corrupted_artifact' ELSE 'incomplete_process' END AS class, coalesce(array_to_string(mi, ','), '') AS missing FROM n""",
    "run_audit": """WITH r AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) % 4 AS c FROM orders GROUP BY 1), t AS (SELECT c_mktsegment AS variant, CASE WHEN n IS NOT NULL AND c > 0 AND n - 5 > 0 THEN 'done_valid' WHEN c_custkey % 13 = 0 THEN 'excluded_documented' WHEN n IS NOT NULL THEN 'invalid' ELSE 'missing' END AS status FROM customer LEFT JOIN r ON o_custkey = c_custkey)
        SELECT variant, status, CASE status WHEN 'invalid' THEN 'rerun' WHEN 'missing' THEN 'run' ELSE 'none' END AS action, count(*) AS n FROM t GROUP BY ALL""",
    "incremental_diff": f"WITH {_DIFF} SELECT path, change FROM diff",
    "incremental_docs": f"WITH {_DIFF} SELECT d.doc_id, CASE WHEN change = 'same' THEN 'old' ELSE 'new' END AS version FROM documents d JOIN diff ON path = 'f' || d.doc_id WHERE change <> 'deleted'",
    "embedding_reuse": "SELECT vec_id AS doc_id, CASE WHEN (vec_id % 2 = 0 AND vec_id % 3 > 0) OR vec_id % 5 = 0 THEN 'known' ELSE 'missing' END AS state FROM embeddings",
    "dataset_map": "SELECT DISTINCT o_custkey AS video_id, 'ds' || (o_custkey % 4) AS dataset_id FROM orders",
    "queue_order": f"WITH {_QUEUE} SELECT job_id, video_id, place, 'p0' || priority || '__' || tag || '__' || job_id || '.q' AS file FROM q",
    "queue_reorder": f"WITH {_QUEUE} SELECT job_id, CASE WHEN place = 5 THEN 1 WHEN place < 5 THEN place + 1 ELSE place END AS place FROM q",
    "job_reuse": """SELECT c_custkey AS request_id, arg_min(o_orderkey, (o_orderkey % 97) * 100000000 + o_orderkey) AS job_id FROM customer JOIN orders ON o_custkey = c_custkey AND (c_custkey % 2 = 0) = (o_orderstatus = 'F') WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 GROUP BY 1""",
    "job_states": f"WITH {_LOG} SELECT job_id, max(state) FILTER (n = 1) AS state, min(day) AS created_at, min(day) FILTER (state = 'running') AS started_at, min(day) FILTER (state IN ('done', 'failed')) AS finished_at, count(*) AS entries FROM lg GROUP BY job_id",
    "job_states_streamed": f"WITH {_LOG} SELECT job_id, state, day AS \"at\" FROM lg WHERE n = 1",
    "stale_leases": "SELECT o_orderkey AS job_id, 'queued' AS state FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_orderkey % 4 = 0 OR o_orderkey % 100 <= 50)",
    "most_recent_running": "WITH d AS (SELECT o_orderkey AS job_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderstatus = 'O') SELECT job_id, CASE WHEN job_id % 2 = 0 OR job_id % 3 = 0 THEN day ELSE day - 30 END AS \"at\" FROM d ORDER BY 2 DESC, job_id LIMIT 1",
    "matrix_cross": "SELECT s_suppkey AS video_id, profile, variant FROM supplier, (VALUES ('main'), ('v08')) p(profile), (VALUES (''), ('no_merge')) v(variant)",
    "pending_jobs": "SELECT c_custkey AS video_id, language FROM customer, (VALUES ('F'), ('O'), ('P')) l(language) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = language)",
    "follow_up_jobs": """WITH d AS (SELECT o_orderkey AS job_id, o_custkey AS video_id, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'ru' END AS l FROM orders)
        SELECT job_id, video_id, 'index' AS job_type, l AS target, 25 AS priority FROM d UNION ALL SELECT job_id, video_id, 'translate', t, p FROM d, (VALUES ('ru', 20), ('kz', 30)) x(t, p) WHERE t <> l""",
    "library_filter": """SELECT c_custkey AS video_id, 'ready' AS status, CASE WHEN c_custkey % 2 = 0 THEN 'summary,' ELSE '' END || 'translated,' || CASE WHEN c_custkey % 4 = 0 THEN 'variants,' ELSE '' END || 'outputs' AS tags
        FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 3 = 1 AND c_custkey * 3600.0 >= 1500 * 3600.0 - 30 * 86400 AND contains(lower(c_name), 'tomer')""",
    "translated_turns": "SELECT conv_id AS video_id, turn AS pos, sha1(CASE WHEN turn % 2 = 0 AND conv_id % 5 > 0 THEN trim('[RU] ' || text, ' ') ELSE text END) AS sha1 FROM conversations",
    "context_blocks": f"WITH {_HITS} SELECT query_id, sha1(string_agg(rank || '. video=' || video_id || ' time=' || a || '-' || b || ' segment=' || segment_id || ' text=' || trim(description), chr(10) ORDER BY rank)) AS context FROM h WHERE rank <= 6 GROUP BY query_id",
    "grounded_reports": f"WITH {_HITS}, g AS (SELECT query_id, 'Grounded report.' || chr(10) || string_agg(rank || '. ' || video_id || ' [' || a || '-' || b || '] ' || trim(description) || ' [type=' || event_type || ' | risk=' || risk_level || ' | people=' || people_count_bucket || ' | motion=' || motion_type || ']', chr(10) ORDER BY rank) AS r FROM h GROUP BY query_id) SELECT query_id, sha1({_redacted('r')}) AS report FROM g",
    "grounded_answers": f"""WITH {_HITS}, g AS (SELECT query_id, '{grounded.HEAD}' || chr(10) || string_agg(rank || '. ' || video_id || ' [' || a || '-' || b || 's]: ' || trim(description), chr(10) ORDER BY rank) FILTER (rank <= 3) || CASE WHEN count(*) > 3 THEN chr(10) || 'Additional grounded segments available: ' || (count(*) - 3) || '.' ELSE '' END AS answer FROM h GROUP BY query_id)
        SELECT i.query_id, sha1(coalesce(answer, '{grounded.NO_ANSWER}')) AS answer FROM (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1) i LEFT JOIN g ON g.query_id = i.query_id""",
    "sliding_events": "WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 10800000000 * 10800 - 10800, epoch_us(ts) // 10800000000 * 10800]) AS begins FROM events) SELECT begins, begins + 21600 AS ends, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL",
    "session_events": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM e)
        SELECT user_id, min(t) AS begins, max(t) + 14400000000 AS ends, count(*) AS n FROM s GROUP BY user_id, s""",
}
