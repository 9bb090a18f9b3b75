"""Hybrid retrieval over a batch of queries: BM25, exact dense scores, fusion, removal of duplicates,
reranking, and search(), which puts them together. A single query is a batch of one. Ties go to the
smaller doc_id throughout."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.scalars import string_set
from tessera.functions.text import plain_terms, terms

K1, B = 1.6, 0.75
#: Bytes of query vectors that are sent to the executors at a time.
QUERY_BYTES = 16 << 20
#: A vector takes part if its squared length exceeds this.
LEAST_NORM = 1e-10


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, dl), terms(term, df, idf), lengths(doc_id, dl), stats(n, avgdl: one row)."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Postings are written in order of their terms, so that a query's terms touch few row groups."""
        tables = {n: getattr(self, n) for n in ("postings", "terms", "lengths", "stats")}
        tables["postings"] = tables["postings"].sortWithinPartitions("term")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "lengths", "stats")))


def build_index(docs: DataFrame, tokens: Column | None = None) -> Index:
    """BM25 tables of docs(doc_id, text). Frequencies are summed before they are shuffled."""
    rows = docs.select("doc_id", (terms(F.col("text")) if tokens is None else tokens).alias("t"))
    lengths = rows.select("doc_id", F.size("t").cast("long").alias("dl"))
    postings = rows.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return _index_of(postings.select("term", "doc_id", "tf", "dl"), lengths)


def _index_of(postings: DataFrame, lengths: DataFrame) -> Index:
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(postings, df.join(F.broadcast(stats)).select("term", "df", idf.alias("idf")), lengths, stats)


def stored_index(docs: DataFrame, path: str, tokens: Column | None = None) -> Index:
    """build_index(), written and read back: texts are cut into terms for the postings and the lengths only, and
    what follows from these is made of the written tables."""
    made, spark = build_index(docs, tokens), docs.sparkSession
    made.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    made.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    rest = _index_of(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths")))
    rest.terms.write.mode("overwrite").parquet(f"{path}/terms")
    rest.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return Index.load(spark, path)


def aligned(docs: DataFrame, ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents of a stored index in the order of its ids(place, doc_id), with vectors(doc_id, vector, valid):
    ids without a document vanish; if validity is told for fewer vectors than there are, all count as valid."""
    told = vectors.agg((F.count("valid") == F.count(F.lit(1))).alias("_whole"))
    rows = ids.join(docs, "doc_id").join(vectors, "doc_id", "left").join(F.broadcast(told))
    return rows.withColumn("valid", F.col("vector").isNotNull() & (~F.col("_whole") | F.coalesce("valid", F.lit(False)))).drop("_whole")


def bm25(index: Index, queries: DataFrame, k1: float = K1, b: float = B, tokens: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with queries(query_id, text). Words that
    a query repeats count each time; statistics are those of the whole index."""
    asked = queries.select("query_id", F.explode(terms(F.col("text")) if tokens is None else tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = asked.join(index.terms, "term").join(index.postings, "term").join(F.broadcast(index.stats))
    tf = F.col("tf")
    weight = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / (F.col("avgdl") + 1e-9)))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def top(scores: DataFrame, k: int, by: str = "score", partition: str = "query_id") -> DataFrame:
    """The k best of each query with their rank; Spark limits groups before and after the shuffle."""
    order = Window.partitionBy(partition).orderBy(F.desc(by), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_top(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query by sparse score among docs(doc_id): documents that share no term score 0 and
    follow, in order of doc_id. Of these, only the first k documents can be needed."""
    best = top(scores.join(docs.select("doc_id"), "doc_id", "left_semi"), k).drop("rank")
    first = docs.select("doc_id").orderBy("doc_id").limit(k)
    rest = queries.select("query_id").join(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.select("query_id", "doc_id", "score").unionByName(rest.select("query_id", "doc_id", "score")), k)


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): dot products of vectors(doc_id, vector) with each of a batch of
    queries(query_id, vector), by matrix products of Arrow batches with blocks of the queries. Vectors of
    zeros take no part. With k, each batch hands on its k best of each query only, and these are the k best
    of all, with their rank; digits rounds scores before they are ranked."""
    ids, width = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil((ids or 0) * (width or 1) * 8 / QUERY_BYTES))
    out = None
    for block in range(blocks):
        asked = queries.select("query_id", "vector")
        if blocks > 1:
            asked = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        one = _products(vectors, asked.toArrow(), queries.schema["query_id"].dataType.simpleString(), k, digits)
        out = one if out is None else out.unionByName(one)
    return out if k is None else top(out, k)


def _products(vectors: DataFrame, asked: pa.Table, kind: str, k: int | None, digits: int | None) -> DataFrame:
    spark = vectors.sparkSession
    matrix = np.array(asked.column("vector").to_pylist(), float) if asked.num_rows else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches:
            whole = batch.filter(batch.column(1).is_valid())
            if not whole.num_rows or not len(q):
                continue
            values = whole.column(1)
            if len(values.flatten()) != len(values) * q.shape[1]:
                raise ValueError("vectors and queries differ in length")
            v = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
            valid = np.flatnonzero(np.einsum("ij,ij->i", v, v) > LEAST_NORM)
            scores = q @ v[valid].T
            if digits is not None:
                scores = np.round(scores, digits)
            ids = whole.column(0).take(pa.array(valid))
            if k is None:
                at = np.tile(np.arange(len(valid)), len(q))
                of = np.repeat(np.arange(len(q)), len(valid))
            else:
                order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
                best = [order[np.argsort(-row[order], kind="stable")[:k]] for row in scores]
                at, of = np.concatenate(best), np.repeat(np.arange(len(q)), [len(x) for x in best])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), ids.take(pa.array(at)), pa.array(scores[of, at])], names=["query_id", "doc_id", "score"])

    doc = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.select("doc_id", "vector").mapInArrow(run, f"query_id {kind}, doc_id {doc}, score double")


def gathered(found: DataFrame, sparse: DataFrame | None, vectors: DataFrame | None, queries: DataFrame | None, digits: int | None = None) -> DataFrame:
    """found(query_id, doc_id) with both scores of each candidate, whichever side found it: sparse is 0 where
    no term is shared, dense is null only where a vector isn't valid. A side that is None is off."""
    pairs = found.select("query_id", "doc_id").distinct()
    if sparse is None:
        rows = pairs.withColumn("sparse", F.lit(0.0))
    else:
        rows = pairs.join(sparse.select("query_id", "doc_id", F.col("score").alias("_s")), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("_s", F.lit(0.0)).alias("sparse"))
    if vectors is None or queries is None:
        return rows.withColumn("dense", F.lit(None).cast("double"))
    v, q = F.col("_v"), F.col("_q")
    score = geometry.dot(v, q)
    both = rows.join(vectors.select("doc_id", F.col("vector").alias("_v")), "doc_id", "left").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id", "left")
    return both.select("query_id", "doc_id", "sparse", F.when(v.isNotNull() & geometry.is_valid(v), score if digits is None else F.round(score, digits)).alias("dense"))


def candidates(sparse: DataFrame, dense_top: DataFrame) -> DataFrame:
    """(query_id, doc_id): all that either side found."""
    return sparse.select("query_id", "doc_id").union(dense_top.select("query_id", "doc_id")).distinct()


def rrf(found: DataFrame, k: int = 60, w_sparse: float = 0.45, w_dense: float = 0.55) -> DataFrame:
    """Adds score: reciprocal ranks among the candidates. A missing dense score ranks last and still
    counts; a missing sparse score is 0."""
    by_dense = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("dense"), "doc_id")
    by_sparse = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("sparse", F.lit(0.0))), "doc_id")
    return found.withColumn("score", w_dense / (k + F.row_number().over(by_dense)) + w_sparse / (k + F.row_number().over(by_sparse)))


def scaled(name: str, partition: str = "query_id") -> Column:
    """Min-max over a query's candidates; 0 where the range is empty or the value is missing."""
    w = Window.partitionBy(partition)
    lo, hi = F.min(name).over(w), F.max(name).over(w)
    return F.when(F.col(name).isNull() | (hi - lo < 1e-9), 0.0).otherwise((F.col(name) - lo) / (hi - lo))


def minmax(found: DataFrame, w_sparse: float = 0.45, w_dense: float = 0.55) -> DataFrame:
    """Adds score: a weighted sum of scaled scores, over the values that are present."""
    return found.withColumn("s", scaled("sparse")).withColumn("d", scaled("dense")).withColumn("score", w_sparse * F.col("s") + w_dense * F.col("d")).drop("s", "d")


def filtered(docs: DataFrame, *, video_id: str | None = None, start: float | None = None, end: float | None = None, least: float | None = None, most: float | None = None, equal: dict[str, str] | None = None, anomaly_only: bool = False, tags: list[str] | None = None, objects: list[str] | None = None) -> DataFrame:
    """Documents that pass all filters; what is None or an empty list isn't a filter. Times must lie within
    [start, end]; tags and objects must all be present."""
    length = F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))
    tests = []
    if video_id is not None:
        tests.append(F.col("video_id") == video_id)
    tests += [F.col("start_sec") >= start] if start is not None else []
    tests += [F.col("end_sec") <= end] if end is not None else []
    tests += [length >= least] if least is not None else []
    tests += [length <= most] if most is not None else []
    for name, value in (equal or {}).items():
        if value is not None:
            tests.append(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))) == value.strip().lower())
    if anomaly_only:
        tests.append(F.coalesce(F.col("anomaly_flag"), F.lit(False)))
    for name, wanted in (("tags", tags), ("objects", objects)):
        if wanted:
            have = string_set(F.col(name))
            tests += [F.array_contains(have, x.strip().lower()) for x in wanted]
    out = docs
    for t in tests:
        out = out.where(t)
    return out


def drop_overlaps(hits: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Greedy: in order of rank, a hit of a query and video goes if it overlaps one kept before by so much.
    A query's hits in a video are few (hits are cut to a few times top_k before), so one array holds them."""
    row = F.struct("rank", "doc_id", "start_sec", "end_sec")
    groups = hits.groupBy("query_id", "video_id").agg(F.sort_array(F.collect_list(row)).alias("h"))
    kind = "array<struct<rank:int,doc_id:bigint,start_sec:double,end_sec:double>>"

    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda y: geometry.hull_iou(y["start_sec"], y["end_sec"], x["start_sec"], x["end_sec"]) >= threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    kept = groups.select("query_id", "video_id", F.explode(F.aggregate(F.col("h").cast(kind), F.array().cast(kind), step)).alias("x"))
    return kept.select("query_id", "video_id", "x.*")


def first_per_bucket(hits: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The best hit of each query, video and rounded (half to even) start and end."""
    keys = ["query_id", "video_id", F.bround(F.col("start_sec") / tolerance).alias("_b"), F.bround(F.col("end_sec") / tolerance).alias("_e")]
    order = Window.partitionBy("query_id", "video_id", "_b", "_e").orderBy("rank")
    return hits.select("*", *keys[2:]).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_b", "_e")


# What a value of a field, found among a query's terms, and the share of a list's or text's
# terms found, add to a hit's score.
VALUE_WEIGHTS = {"event_type": 0.30, "risk_level": 0.18, "people_count_bucket": 0.12, "motion_type": 0.12}
SHARE_WEIGHTS = {"description": 0.30, "tags": 0.24, "objects": 0.18}
ALERT_WEIGHT, ALERT_WORDS = 0.14, ("anomaly", "alert", "warning", "critical")
MODEL_WEIGHT = 0.35


def rerank_bonus(query: Column, description: Column, event: Column, risk: Column, people: Column, motion: Column, tags: Column, objects: Column, flag: Column) -> Column:
    """What a hit gains by its metadata; query and description are arrays of terms."""
    asked = F.array_distinct(F.filter(F.transform(query, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    values = dict(zip(VALUE_WEIGHTS, (event, risk, people, motion), strict=True))
    lists = {"description": description, "tags": string_set(tags), "objects": string_set(objects)}
    parts = [weight * F.size(F.array_intersect(asked, lists[name])) / F.size(asked) for name, weight in SHARE_WEIGHTS.items()]
    parts += [F.when(F.array_contains(asked, F.nullif(F.lower(F.trim(values[name])), F.lit(""))), weight).otherwise(0.0) for name, weight in VALUE_WEIGHTS.items()]
    parts.append(F.when(F.coalesce(flag, F.lit(False)) & F.arrays_overlap(asked, F.array(*map(F.lit, ALERT_WORDS))), ALERT_WEIGHT).otherwise(0.0))
    return F.when(F.size(asked) > 0, sum(parts[1:], parts[0])).otherwise(0.0)


def reranked(hits: DataFrame, gain: str, top_k: int, rerank_top_k: int, mode: str = "heuristic") -> DataFrame:
    """Hits in their final order (position). The first max(top_k, rerank_top_k) are ordered by combined: with
    the heuristic, score and gain; with a model, score and MODEL_WEIGHT times gain over the largest |gain| of
    these hits. The others follow as they were; score stays the fused one."""
    if mode not in ("heuristic", "model"):
        raise ValueError(f"unknown reranking {mode!r}: heuristic or model")
    query = Window.partitionBy("query_id")
    rows = hits.withColumn("_first", F.col("rank") <= max(top_k, rerank_top_k))
    gained = F.col(gain)
    if mode == "model":
        peak = F.max(F.when(F.col("_first"), F.abs(gained))).over(query)
        gained = F.when(peak > 0, MODEL_WEIGHT * gained / peak).otherwise(0.0)
    rows = rows.withColumn("combined", F.col("score") + gained)
    order = query.orderBy(F.desc("_first"), F.desc(F.when(F.col("_first"), F.col("combined"))), "rank")
    return rows.withColumn("position", F.row_number().over(order)).drop("_first")


@dataclass(frozen=True)
class Settings:
    """How search() works. A side is off if its k or its weight isn't positive; dedupe is overlap, bucket or
    None; rerank is heuristic, model or None."""

    top_k: int = 10
    k_sparse: int = 200
    k_dense: int = 200
    w_sparse: float = 0.45
    w_dense: float = 0.55
    fusion: str = "rrf"
    rrf_k: int = 60
    dedupe: str | None = "overlap"
    overlap: float = 0.7
    tolerance: float = 1.0
    rerank: str | None = "heuristic"
    rerank_top_k: int = 20
    lemma: bool = False
    digits: int | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, value, known in (("fusion", self.fusion, ("rrf", "minmax")), ("dedupe", self.dedupe, ("overlap", "bucket", None)), ("rerank", self.rerank, ("heuristic", "model", None))):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}: one of {known}")

    @property
    def sparse_on(self) -> bool:
        return self.k_sparse > 0 and self.w_sparse > 0

    @property
    def dense_on(self) -> bool:
        return self.k_dense > 0 and self.w_dense > 0

    @property
    def take(self) -> int:
        """Hits of a query before duplicates are removed."""
        return 5 * self.top_k


def fused(index: Index | None, docs: DataFrame, vectors: DataFrame | None, queries: DataFrame, how: Settings) -> DataFrame:
    """(query_id, doc_id, score, sparse_score, dense_score): the candidates among docs, fused; the two scores
    are scaled among a query's candidates. With digits, scores of a side are rounded to so many, fused ones
    to three more."""
    none = queries.select("query_id").limit(0).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    sparse = sparse_best = kept = dense_best = None
    if how.sparse_on:
        sparse = bm25(index, queries, tokens=terms(F.col("text"), lemma=how.lemma))
        sparse = sparse if how.digits is None else sparse.withColumn("score", F.round("score", how.digits))
        sparse_best = sparse_top(sparse, docs, queries, how.k_sparse)
    if how.dense_on and vectors is not None:
        kept = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
        dense_best = dense(kept, queries.where("vector is not null"), how.k_dense, how.digits)
    found = gathered(candidates(none if sparse_best is None else sparse_best, none if dense_best is None else dense_best), sparse, kept, queries if kept is not None else None, how.digits)
    scored = rrf(found, how.rrf_k, how.w_sparse, how.w_dense) if how.fusion == "rrf" else minmax(found, how.w_sparse, how.w_dense)
    scored = scored if how.digits is None else scored.withColumn("score", F.round("score", how.digits + 3))
    return scored.select("query_id", "doc_id", "score", scaled("sparse").alias("sparse_score"), scaled("dense").alias("dense_score"))


def search(index: Index | None, docs: DataFrame, vectors: DataFrame | None, queries: DataFrame, how: Settings = Settings(), reranker: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Hits of queries(query_id, text, vector) among docs(doc_id, video_id, start_sec, end_sec, description and
    metadata): filters, candidates of both sides, fusion, the first 5 top_k, removal of duplicates, reranking,
    the first top_k. Columns: query_id, position, score, sparse_score, dense_score and those of docs.

    A blank query gives the documents that pass the filters in order of doc_id, with scores 1, not reranked.
    Reranking by a model needs a reranker, a column builder over (query text, description)."""
    if how.rerank == "model" and reranker is None:
        raise ValueError("reranking by a model needs a reranker")
    kept = filtered(docs, **how.filters)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    asked, open_ = queries.where(~blank), queries.where(blank)
    hits = top(fused(index, kept, vectors, asked, how), how.take)
    first = kept.select("doc_id").orderBy("doc_id").limit(how.take)
    ones = [F.lit(1.0).alias(c) for c in ("score", "sparse_score", "dense_score")]
    listed = top(open_.select("query_id").join(F.broadcast(first)).select("query_id", "doc_id", *ones), how.take)
    hits = hits.unionByName(listed).join(kept, "doc_id")
    if how.dedupe is not None:
        left = drop_overlaps(hits, how.overlap) if how.dedupe == "overlap" else first_per_bucket(hits, how.tolerance)
        hits = hits.join(left.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    # without gaps, so that the first hits are counted as they are
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    if how.rerank is None:
        out = hits.withColumn("position", F.col("rank"))
    else:
        text = F.coalesce(F.col("_asked"), F.lit(""))
        worded = hits.join(queries.select("query_id", F.col("text").alias("_asked")), "query_id")
        if how.rerank == "model":
            gain = reranker(text, F.col("description"))
        else:
            fields = (F.col(c) for c in ("event_type", "risk_level", "people_count_bucket", "motion_type", "tags", "objects", "anomaly_flag"))
            gain = rerank_bonus(terms(text, lemma=how.lemma), plain_terms(F.col("description")), *fields)
            gain = gain if how.digits is None else F.round(gain, how.digits)
        out = reranked(worded.withColumn("_gain", F.when(F.trim(text) == "", 0.0).otherwise(gain)), "_gain", how.top_k, how.rerank_top_k, how.rerank).drop("_asked", "_gain", "combined")
    return out.where(F.col("position") <= how.top_k).drop("rank")


def search_languages(run: Callable[[str, DataFrame], DataFrame], queries: DataFrame, languages: list[str], limit: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Hits in the first language, filled up from the next ones: run(language, queries) gives hits with query_id,
    position and what tells a hit; a query that has enough hits isn't asked in a further language. keep may
    write what a language gave, so that the next one needn't search for it again."""
    place = {x: i for i, x in enumerate(languages)}
    out = None
    for language in languages:
        asked = queries if out is None else queries.join(out.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit), "query_id", "left_anti")
        hits = run(language, asked).withColumn("language", F.lit(language)).withColumn("rank", F.col("position")).drop("position")
        out = keep(merged_languages(hits if out is None else out.drop("position").unionByName(hits), place, limit))
    return out


def merged_languages(hits: DataFrame, priority: dict[str, int], limit: int) -> DataFrame:
    """Hits of several languages in order of language and rank, each segment once, at most limit (at least
    one) a query. A hit is known by (video, variant, segment), or by its times without a segment."""
    place = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])[F.col("language")]
    key = F.when(F.coalesce("segment_id", F.lit("")) != "", F.concat_ws("|", "video_id", F.coalesce("variant", F.lit("")), "segment_id")).otherwise(F.concat_ws("|", "video_id", F.coalesce("variant", F.lit("")), F.col("start_sec").cast("string"), F.col("end_sec").cast("string")))
    rows = hits.withColumn("_lang", F.coalesce(place, F.lit(len(priority)))).withColumn("_key", key)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy("_lang", "rank"))).where("_n = 1")
    order = Window.partitionBy("query_id").orderBy("_lang", "rank", "_key")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(1, limit)).drop("_lang", "_key", "_n")
