"""Queries of sources, sinks and caches: tables go through files of each format and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import jobs, search
from tessera.plans.fixtures import segments, table
from tessera.plans.retrieval import BM25_SQL
from tessera.sources import files
from tessera.sources.shared import scratch

SCHEMA = "doc_id long, text string, lang string"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def jsonl_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "zst")
    files.write_zst(_docs(spark, sf_dir), path)
    return files.read_zst(spark, f"{path}/*.zst", SCHEMA).select("doc_id", F.sha1("text").alias("sha1"), "lang")


def jsonl_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "gz")
    files.write_gz(_docs(spark, sf_dir), path)
    return files.read_gz(spark, path, SCHEMA).select("doc_id", F.sha1("text").alias("sha1"), "lang")


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with different columns, written, read as text, and put one below the other."""
    path = scratch(spark, "csv")
    files.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), f"{path}/a")
    files.write_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{path}/b")
    both = files.combined({"suppliers": files.read_table(spark, f"{path}/a", ["s_suppkey", "s_name"]), "nations": files.read_table(spark, f"{path}/b", ["n_nationkey", "n_name"])})
    return both.select("artifact", "s_suppkey", "s_name", "n_nationkey", "n_name")


def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that was written and read again tells the same statistics."""
    path = scratch(spark, "index")
    search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text")).save(path)
    index = search.Index.load(spark, path)
    return index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.sha1(F.concat_ws("|", "c_name", F.lit("en"), F.lit("ru"))).alias("key"), F.col("c_custkey").alias("value"))
    return files.upserted(c.where("value % 2 = 0"), c.where("value % 3 = 0").withColumn("value", -F.col("value")), "key")


def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, ("AVI", "mp4", "txt", "mkv"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), (k % 300).cast("string")).alias("video_id"), F.concat_ws(".", k.cast("string"), ext).alias("name"))
    return files.pick_video(rows)


def stored_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and total length of the files of a table that was written, by their digests."""
    path = scratch(spark, "files")
    segments(spark, sf_dir).select("doc_id").repartition(3).write.parquet(path)
    out = files.digests(spark, f"{path}/*.parquet")
    return out.agg(F.countDistinct("sha256").alias("files"), (F.min(F.length("sha256")) == 64).alias("whole"))


def library_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with their languages, variants and status."""
    seg = segments(spark, sf_dir)
    videos = seg.groupBy("video_id").agg(F.sort_array(F.collect_set("language")).alias("languages"), F.sort_array(F.collect_set("variant")).alias("variants"), F.max(F.when(F.col("pos") == 0, F.substring("description", 1, 10))).alias("summary"))
    status = jobs.library_status(F.lit(None).cast("string"), F.col("languages"))
    return videos.select("video_id", F.concat_ws(",", "languages").alias("languages"), F.concat_ws(",", "variants").alias("variants"), status.alias("status"), F.concat_ws(",", jobs.library_tags(F.col("summary"), F.col("languages"), F.col("variants"))).alias("tags"))


QUERIES = {f.__name__: f for f in (jsonl_zst, jsonl_gz, csv_tables, saved_index, cache_upsert, video_files, stored_digests, library_catalog)}
_SAME = "SELECT doc_id, sha1(text) AS sha1, lang FROM documents"
ORACLES = {
    "jsonl_zst": _SAME,
    "jsonl_gz": _SAME,
    "csv_tables": "SELECT 'suppliers' AS artifact, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, NULL AS n_nationkey, NULL AS n_name FROM supplier UNION ALL SELECT 'nations', NULL, NULL, CAST(n_nationkey AS VARCHAR), n_name FROM nation",
    "saved_index": f"WITH {BM25_SQL} SELECT doc_id, count(*) AS terms, sum(tf) AS tokens FROM post GROUP BY doc_id",
    "cache_upsert": "WITH c AS (SELECT sha1(c_name || '|en|ru') AS key, c_custkey AS v FROM customer) SELECT key, CASE WHEN v % 3 = 0 THEN -v ELSE v END AS value FROM c WHERE v % 2 = 0 OR v % 3 = 0",
    "video_files": "WITH f AS (SELECT 'v' || (p_partkey % 300) AS video_id, p_partkey || '.' || list_extract(['AVI', 'mp4', 'txt', 'mkv'], CAST(p_partkey % 4 + 1 AS INT)) AS name, list_extract([2, 1, 9, 4], CAST(p_partkey % 4 + 1 AS INT)) AS p FROM part) SELECT video_id, name FROM f WHERE p < 9 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY p, lower(name)) = 1",
    "stored_digests": "SELECT 3 AS files, true AS whole",
    "library_catalog": "WITH g AS (SELECT source AS video_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, string_agg(DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'no_merge' END, ',' ORDER BY CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'no_merge' END) AS variants FROM documents GROUP BY 1) SELECT video_id, languages, variants, 'ready' AS status, 'summary,' || CASE WHEN languages <> 'en' THEN 'translated,' ELSE '' END || 'variants,outputs' AS tags FROM g",
}
