"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.functions.text import plain_terms, terms
from tessera.operators import search
from tessera.plans.fixtures import SEGMENTS_SQL, segments, table, terms_sql
from tessera.sources.shared import scratch, state_of, stored

#: Every vector whose id is divisible by this is asked.
VECTOR_STEP = 50

_stored: dict[tuple[str, str, str], str] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the documents, built and written when it is first asked for, or when the table's files change."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _stored:
        path = scratch(spark, "index")
        search.stored_index(_docs(spark, sf_dir), path)
        _stored[key] = path
    return search.Index.load(spark, _stored[key])


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_index(spark, sf_dir), _asked(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_sparse(spark, sf_dir).withColumn("score", F.round("score", 6)), 5).select("query_id", "doc_id", "rank", "score")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return index.lengths.join(F.broadcast(index.stats)).select("doc_id", "dl", "n", F.round("avgdl", 6).alias("avgdl"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("video_id"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("doc_id") % VECTOR_STEP == 0).select(F.col("doc_id").alias("query_id"), "vector")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10, 6).select("query_id", "doc_id", "rank", "score")


def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), digits=6)


def vector_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    return _vectors(spark, sf_dir).select("doc_id", geometry.is_valid(v).alias("valid"), F.round(geometry.norm(v), 6).alias("norm"), F.round(geometry.norm(geometry.unit(v)), 6).alias("unit_norm"))


def _vector_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with a stand-in for their vector (a vector is known by doc_id modulo the number of vectors)."""
    vectors = _vectors(spark, sf_dir)
    return _asked(spark, sf_dir).withColumn("v", F.col("query_id") * 7).join(vectors, F.col("v") == F.col("doc_id")).select("query_id", "text", "vector")


def _hybrid(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Candidates of passages, the k best of either side, with both scores of each."""
    vectors, asked = _vectors(spark, sf_dir), _vector_asked(spark, sf_dir)
    sparse = _sparse(spark, sf_dir).withColumn("score", F.round("score", 6))
    best = search.sparse_top(sparse, _docs(spark, sf_dir), asked, k)
    return search.gathered(search.candidates(best, search.dense(vectors, asked, k, 6)), sparse, vectors, asked, 6)


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("query_id", "doc_id", "sparse", "dense")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.rrf(_hybrid(spark, sf_dir)), 10).select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = search.minmax(_hybrid(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.top(fused, 10).select("query_id", "doc_id", "rank", "score")


def doc_filter_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = search.filtered(segments(spark, sf_dir), start=10.0, end=200.0, least=3.0, most=5.5, equal={"variant": "No_Merge ", "motion_type": "stable"}, tags=["Movement"], objects=["person"])
    return kept.select("doc_id", "video_id", "start_sec", "end_sec")


def anomaly_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(segments(spark, sf_dir), anomaly_only=True, video_id=None, tags=[]).select("doc_id", "risk_level")


def filter_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank query: what passes the filters, in order of doc_id, score 1, without overlaps, the first 10
    of each video."""
    from pyspark.sql import Window

    kept = search.filtered(segments(spark, sf_dir), equal={"people_count_bucket": "low"})
    hits = kept.withColumn("query_id", F.col("video_id")).withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("doc_id"))).where("rank <= 50")
    left = search.drop_overlaps(hits, 0.3)
    order = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("position", F.row_number().over(order)).where("position <= 10").select("video_id", "doc_id", "position", F.lit(1.0).alias("score"))


def _ranked_segments(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """The best segments of each passage, their times folded so that many overlap."""
    return search.top(_sparse(spark, sf_dir).withColumn("score", F.round("score", 6)), k).join(_folded(spark, sf_dir), "doc_id")


def nms_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.drop_overlaps(_ranked_segments(spark, sf_dir)).select("query_id", "video_id", "rank", "doc_id")


def bucket_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.first_per_bucket(_ranked_segments(spark, sf_dir)).select("query_id", "video_id", "rank", "doc_id")


def _with_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(terms(F.col("text"), lemma=True), F.array(F.lit("low"), F.lit("movement"), F.lit("person"), F.lit("warning"))).alias("q"))
    hits = _ranked_segments(spark, sf_dir, 20).join(queries, "query_id")
    bonus = search.rerank_bonus(F.col("q"), plain_terms(F.col("description")), *map(F.col, ("event_type", "risk_level", "people_count_bucket", "motion_type", "tags", "objects", "anomaly_flag")))
    return hits.withColumn("bonus", F.round(bonus, 9)).withColumn("score", F.round("score", 9))


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.reranked(_with_gains(spark, sf_dir), "bonus", 5, 10)
    return out.where("position <= 5").select("query_id", "doc_id", "position", F.round("bonus", 6).alias("bonus"), F.round("combined", 6).alias("combined"))


def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bonus as what a model tells."""
    out = search.reranked(_with_gains(spark, sf_dir), "bonus", 5, 10, "model")
    return out.where("position <= 15").select("query_id", "doc_id", "position", F.round("combined", 6).alias("combined"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose times are folded so that many overlap."""
    return segments(spark, sf_dir).withColumn("start_sec", F.pmod("doc_id", F.lit(7)) * 1.5).withColumn("end_sec", F.col("start_sec") + 2 + F.pmod("doc_id", F.lit(4))).withColumn("video_id", F.concat(F.lit("v"), F.pmod("doc_id", F.lit(5)).cast("string")))


#: Settings of search(), by name; all search the segments of one variant.
MODES = {
    "sparse": {"k_dense": 0, "dedupe": None},
    "dense": {"w_sparse": 0.0, "rerank": None},
    "minmax": {"fusion": "minmax", "dedupe": "bucket", "rerank": None},
}


def _searched(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    blank = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit(" ").alias("text"), F.lit(None).cast("array<float>").alias("vector"))
    how = search.Settings(**({"top_k": 5, "k_sparse": 20, "k_dense": 20, "rerank_top_k": 10, "digits": 6, "filters": {"equal": {"variant": "No_Merge"}}} | changes))
    return search.search(_index(spark, sf_dir), _folded(spark, sf_dir), _vectors(spark, sf_dir).select("doc_id", "vector"), _vector_asked(spark, sf_dir).unionByName(blank), how)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, both sides, fusion, removal of overlaps, reranking; a blank query among the others."""
    out = _searched(spark, sf_dir)
    return out.select("query_id", "doc_id", "position", F.round("score", 6).alias("score"), F.round("sparse_score", 6).alias("sparse_score"), F.round("dense_score", 6).alias("dense_score"), "video_id", "segment_id")


def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in each of a few modes."""
    out = None
    for name, changes in MODES.items():
        one = _searched(spark, sf_dir, **changes).select(F.lit(name).alias("mode"), "query_id", "doc_id", "position")
        out = one if out is None else out.unionByName(one)
    return out


def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages asked in German first, then in French and English, until there are four hits."""
    vectors, index = _vectors(spark, sf_dir).select("doc_id", "vector"), _index(spark, sf_dir)
    seg = _folded(spark, sf_dir).withColumn("segment_id", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(9)).cast("string")))

    def run(language: str, queries: DataFrame) -> DataFrame:
        how = search.Settings(top_k=4, k_sparse=3, w_dense=0.0, digits=6, rerank=None, dedupe=None)
        few = seg.where(F.col("language") == language).where(F.pmod("doc_id", F.lit(3)) > 0).drop("language")
        return search.search(index, few, vectors, queries, how).select("query_id", "doc_id", "position", "video_id", "variant", "segment_id", "start_sec", "end_sec")

    found = search.search_languages(run, _vector_asked(spark, sf_dir), ["de", "fr", "en"], 4, lambda df: stored(df, "hits"))
    return found.select("query_id", "doc_id", "language", "position")


def cross_language_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked_segments(spark, sf_dir, 20).withColumn("segment_id", F.when(F.pmod("doc_id", F.lit(4)) > 0, F.concat(F.lit("s"), F.pmod("doc_id", F.lit(6)).cast("string"))))
    return search.merged_languages(hits, {"en": 0, "de": 1, "fr": 2, "es": 3}, 5).select("query_id", "doc_id", "position")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_stats, bm25_lengths, dense_topk, dense_scores, vector_masks, candidate_union, rrf_fusion, minmax_fusion, doc_filter_subset, anomaly_filter, filter_only_search, nms_dedupe, bucket_dedupe, heuristic_rerank, model_rerank, hybrid_search, search_modes, language_fallback, cross_language_merge)}

BM25_SQL = f"""
tok AS (SELECT doc_id, {terms_sql("text")} AS t FROM documents),
len AS (SELECT doc_id, len(t) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY term, doc_id),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idfs AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfs, stats),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({terms_sql("text")}) AS term FROM benchmark) GROUP BY query_id, term),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * dl / (avgdl + 1e-9)))) AS score
       FROM ask JOIN idfs USING (term) JOIN post USING (term) JOIN len USING (doc_id), stats GROUP BY query_id, doc_id)"""
VECTORS_SQL = """
vec AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
DENSE_SQL = f"""{VECTORS_SQL},
dn AS (SELECT q.doc_id AS query_id, x.doc_id, list_dot_product(q.v, x.v) AS score FROM vec q, vec x WHERE q.doc_id % {VECTOR_STEP} = 0)"""
HYBRID_SQL = f"""{BM25_SQL}, {VECTORS_SQL},
hq AS (SELECT b.item_id AS query_id, q.v FROM benchmark b JOIN vec q ON q.doc_id = b.item_id * 7),
hd AS (SELECT query_id, x.doc_id, round(list_dot_product(hq.v, x.v), 6) AS score FROM hq, vec x),
hs AS (SELECT q.query_id, d.doc_id, coalesce(round(bm.score, 6), 0) AS score FROM hq q CROSS JOIN documents d LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = d.doc_id),
st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs),
dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hd),
ids AS (SELECT query_id, doc_id FROM st WHERE rank <= 20 UNION SELECT query_id, doc_id FROM dt WHERE rank <= 20),
cand AS (SELECT i.query_id, i.doc_id, coalesce(hs.score, 0) AS sparse, hd.score AS dense FROM ids i LEFT JOIN hs ON hs.query_id = i.query_id AND hs.doc_id = i.doc_id LEFT JOIN hd ON hd.query_id = i.query_id AND hd.doc_id = i.doc_id)"""
FOLDED_SQL = "(s.doc_id % 7) * 1.5::DOUBLE AS start_sec, (s.doc_id % 7) * 1.5::DOUBLE + 2 + s.doc_id % 4 AS end_sec, 'v' || (s.doc_id % 5) AS video_id"


def _ranked_sql(k: int) -> str:
    return f"""{BM25_SQL}, {SEGMENTS_SQL},
top0 AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm),
hits AS (SELECT t.query_id, t.rank, t.score, s.* REPLACE ({FOLDED_SQL})
         FROM top0 t JOIN seg s USING (doc_id) WHERE t.rank <= {k})"""


def _nms_sql(source: str, threshold: float) -> str:
    """Greedy removal as a recursion over positions within (query, video)."""
    return f"""
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY rank) AS i FROM {source}),
step AS (
    SELECT query_id, video_id, i, rank, doc_id, [{{'s': start_sec, 'e': end_sec}}] AS kept, true AS ok FROM ord WHERE i = 1
    UNION ALL
    SELECT o.query_id, o.video_id, o.i, o.rank, o.doc_id,
           CASE WHEN len(list_filter(p.kept, lambda y: greatest(0, least(y.e, o.end_sec) - greatest(y.s, o.start_sec)) / (greatest(y.e, o.end_sec) - least(y.s, o.start_sec) + 1e-9) >= {threshold})) = 0
                THEN list_append(p.kept, {{'s': o.start_sec, 'e': o.end_sec}}) ELSE p.kept END,
           len(list_filter(p.kept, lambda y: greatest(0, least(y.e, o.end_sec) - greatest(y.s, o.start_sec)) / (greatest(y.e, o.end_sec) - least(y.s, o.start_sec) + 1e-9) >= {threshold})) = 0
    FROM ord o JOIN step p ON o.query_id = p.query_id AND o.video_id = p.video_id AND o.i = p.i + 1)"""


def _gains_sql() -> str:
    lemma = "CASE WHEN suffix(x, 'ing') AND length(x) > 5 THEN x[:-4] WHEN suffix(x, 'ed') AND length(x) > 4 THEN x[:-3] WHEN suffix(x, 'es') AND length(x) > 4 THEN x[:-3] WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END"
    return f"""{_ranked_sql(20)},
        q AS (SELECT item_id AS query_id, list_distinct(list_concat(list_transform({terms_sql("text")}, lambda x: {lemma}), ['low', 'movement', 'person', 'warning'])) AS q FROM benchmark),
        b AS (SELECT h.query_id, doc_id, rank, round(score, 9) AS score, round({_BONUS_SQL}, 9) AS bonus FROM hits h JOIN q ON q.query_id = h.query_id)"""


_BONUS_SQL = """0.30::DOUBLE * len(list_intersect(q, list_distinct(list_filter(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 1)))) / len(q)
              + 0.24::DOUBLE * len(list_intersect(q, tags)) / len(q) + 0.18::DOUBLE * len(list_intersect(q, objects)) / len(q)
              + CASE WHEN list_contains(q, event_type) THEN 0.30 ELSE 0 END + CASE WHEN list_contains(q, risk_level) THEN 0.18 ELSE 0 END
              + CASE WHEN list_contains(q, people_count_bucket) THEN 0.12 ELSE 0 END + CASE WHEN list_contains(q, motion_type) THEN 0.12 ELSE 0 END
              + CASE WHEN anomaly_flag AND len(list_intersect(q, ['anomaly', 'alert', 'warning', 'critical'])) > 0 THEN 0.14 ELSE 0 END"""


def _search_sql(fusion: str = "rrf", k_sparse: int = 20, k_dense: int = 20, dedupe: str | None = "overlap", rerank: bool = True) -> str:
    """search() over folded segments of the variant no_merge, as common table expressions that end with found."""
    score = {
        "rrf": "0.55 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC NULLS LAST, doc_id)) + 0.45 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, doc_id))",
        "sparse": "0.55 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY doc_id)) + 0.45 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, doc_id))",
        "dense": "0.55 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY dense DESC NULLS LAST, doc_id))",
        "minmax": "0.45::DOUBLE * sn + 0.55::DOUBLE * dn",
    }[fusion]
    if fusion == "dense":
        score += " + 0.0 / 60"
    found = {
        "overlap": f"{_nms_sql('hits', 0.7)}, left_over AS (SELECT h.* FROM hits h JOIN step USING (query_id, doc_id) WHERE step.ok)",
        "bucket": "left_over AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, round_even(start_sec, 0), round_even(end_sec, 0) ORDER BY rank) AS n FROM hits) WHERE n = 1)",
        None: "left_over AS (SELECT * FROM hits)",
    }[dedupe]
    gain = f"CASE WHEN b.query_id < 0 OR NOT {str(rerank).upper()} THEN 0 ELSE coalesce(round({_BONUS_SQL}, 6), 0) END"
    return f"""{BM25_SQL}, {VECTORS_SQL}, {SEGMENTS_SQL},
fs AS (SELECT s.* REPLACE ({FOLDED_SQL}) FROM seg s WHERE variant = 'no_merge'),
hq AS (SELECT b.item_id AS query_id, q.v FROM benchmark b JOIN vec q ON q.doc_id = b.item_id * 7),
hs AS (SELECT q.query_id, d.doc_id, coalesce(round(bm.score, 6), 0) AS score FROM hq q CROSS JOIN fs d LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = d.doc_id),
hd AS (SELECT query_id, x.doc_id, round(list_dot_product(hq.v, x.v), 6) AS score FROM hq, vec x WHERE x.doc_id IN (SELECT doc_id FROM fs)),
st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs),
dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hd),
ids AS (SELECT query_id, doc_id FROM st WHERE rank <= {k_sparse} UNION SELECT query_id, doc_id FROM dt WHERE rank <= {k_dense}),
c0 AS (SELECT i.query_id, i.doc_id, {"hs.score" if k_sparse else "0.0::DOUBLE"} AS sparse, {"hd.score" if k_dense else "CAST(NULL AS DOUBLE)"} AS dense FROM ids i LEFT JOIN hs ON hs.query_id = i.query_id AND hs.doc_id = i.doc_id LEFT JOIN hd ON hd.query_id = i.query_id AND hd.doc_id = i.doc_id),
c1 AS (SELECT *, CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-9 THEN 0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END AS sn,
       CASE WHEN dense IS NULL OR max(dense) OVER w - min(dense) OVER w < 1e-9 THEN 0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END AS dn FROM c0 WINDOW w AS (PARTITION BY query_id)),
c2 AS (SELECT query_id, doc_id, round({score}, 9) AS score, sn AS sparse_score, dn AS dense_score FROM c1 UNION ALL SELECT -1, doc_id, 1, 1, 1 FROM fs),
h0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c2),
hits AS (SELECT h0.query_id, h0.rank, h0.score, h0.sparse_score, h0.dense_score, fs.* FROM h0 JOIN fs USING (doc_id) WHERE h0.rank <= 25),
{found},
r0 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM left_over),
rq AS (SELECT item_id AS query_id, list_distinct({terms_sql("text")}) AS q FROM benchmark),
r1 AS (SELECT b.*, {gain} AS gain FROM r0 b LEFT JOIN rq USING (query_id)),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN score + gain END DESC, rank) AS position FROM r1)"""


_MODE_SQL = {"sparse": {"fusion": "sparse", "k_dense": 0, "dedupe": None}, "dense": {"fusion": "dense", "k_sparse": 0, "rerank": False}, "minmax": {"fusion": "minmax", "dedupe": "bucket", "rerank": False}}
_MODES_SQL = " UNION ALL ".join(f"SELECT '{name}' AS mode, * FROM (WITH RECURSIVE {_search_sql(**how)} SELECT query_id, doc_id, position FROM found WHERE position <= 5)" for name, how in _MODE_SQL.items())


ORACLES = {
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 5",
    "bm25_stats": f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "bm25_lengths": f"WITH {BM25_SQL} SELECT doc_id, dl, n, round(avgdl, 6) AS avgdl FROM len, stats",
    "dense_topk": f"WITH {DENSE_SQL} SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM dn) WHERE rank <= 10",
    "dense_scores": f"WITH {DENSE_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM dn",
    "vector_masks": f"WITH {VECTORS_SQL} SELECT doc_id, list_dot_product(v, v) > 1e-10 AS valid, round(sqrt(list_dot_product(v, v)), 6) AS norm, CASE WHEN list_dot_product(v, v) > 0 THEN 1.0::DOUBLE END AS unit_norm FROM vec",
    "candidate_union": f"WITH {HYBRID_SQL} SELECT query_id, doc_id, sparse, dense FROM cand",
    "rrf_fusion": f"""WITH {HYBRID_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC NULLS LAST, doc_id) AS rd, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(sparse, 0) DESC, doc_id) AS rs FROM cand),
        f AS (SELECT query_id, doc_id, 0.55 / (60 + rd) + 0.45 / (60 + rs) AS score FROM r)
        SELECT query_id, doc_id, rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "minmax_fusion": f"""WITH {HYBRID_SQL}, r AS (SELECT *, min(sparse) OVER w AS s0, max(sparse) OVER w AS s1, min(dense) OVER w AS d0, max(dense) OVER w AS d1 FROM cand WINDOW w AS (PARTITION BY query_id)),
        f AS (SELECT query_id, doc_id, round(0.45::DOUBLE * CASE WHEN sparse IS NULL OR s1 - s0 < 1e-9 THEN 0 ELSE (sparse - s0) / (s1 - s0) END + 0.55::DOUBLE * CASE WHEN dense IS NULL OR d1 - d0 < 1e-9 THEN 0 ELSE (dense - d0) / (d1 - d0) END, 6) AS score FROM r)
        SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "doc_filter_subset": f"WITH {SEGMENTS_SQL} SELECT doc_id, video_id, start_sec, end_sec FROM seg WHERE start_sec >= 10 AND end_sec <= 200 AND end_sec - start_sec BETWEEN 3 AND 5.5 AND variant = 'no_merge' AND motion_type = 'stable' AND list_contains(tags, 'movement') AND list_contains(objects, 'person')",
    "anomaly_filter": f"WITH {SEGMENTS_SQL} SELECT doc_id, risk_level FROM seg WHERE anomaly_flag",
    "filter_only_search": f"""WITH RECURSIVE {SEGMENTS_SQL}, base AS (SELECT *, video_id AS query_id, row_number() OVER (PARTITION BY video_id ORDER BY doc_id) AS rank FROM seg WHERE people_count_bucket = 'low'),
        hits AS (SELECT * FROM base WHERE rank <= 50), {_nms_sql("hits", 0.3)}
        SELECT video_id, doc_id, position, 1.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM step WHERE ok) WHERE position <= 10""",
    "nms_dedupe": f"WITH RECURSIVE {_ranked_sql(40)}, {_nms_sql('hits', 0.7)} SELECT query_id, video_id, rank, doc_id FROM step WHERE ok",
    "bucket_dedupe": f"WITH {_ranked_sql(40)} SELECT query_id, video_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, round_even(start_sec, 0), round_even(end_sec, 0) ORDER BY rank) AS n FROM hits) WHERE n = 1",
    "heuristic_rerank": f"""WITH {_gains_sql()}, c AS (SELECT *, score + bonus AS combined FROM b),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN combined END DESC, rank) AS position FROM c)
        SELECT query_id, doc_id, position, round(bonus, 6) AS bonus, round(combined, 6) AS combined FROM p WHERE position <= 5""",
    "model_rerank": f"""WITH {_gains_sql()}, c AS (SELECT *, score + coalesce(0.35::DOUBLE * bonus / nullif(max(CASE WHEN rank <= 10 THEN abs(bonus) END) OVER (PARTITION BY query_id), 0), 0) AS combined FROM b),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, CASE WHEN rank <= 10 THEN combined END DESC, rank) AS position FROM c)
        SELECT query_id, doc_id, position, round(combined, 6) AS combined FROM p WHERE position <= 15""",
    "hybrid_search": f"""WITH RECURSIVE {_search_sql()} SELECT query_id, doc_id, position, round(score, 6) AS score, round(sparse_score, 6) AS sparse_score, round(dense_score, 6) AS dense_score, video_id, segment_id FROM found WHERE position <= 5""",
    "search_modes": _MODES_SQL,
    "language_fallback": f"""WITH {BM25_SQL}, {SEGMENTS_SQL}, fs AS (SELECT s.* REPLACE ({FOLDED_SQL}, 's' || (s.doc_id % 9) AS segment_id), CASE language WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS lp FROM seg s WHERE doc_id % 3 > 0 AND language IN ('de', 'fr', 'en')),
        hq AS (SELECT item_id AS query_id FROM benchmark JOIN embeddings ON vec_id = item_id * 7),
        sp AS (SELECT q.query_id, fs.*, coalesce(round(bm.score, 6), 0) AS score FROM hq q CROSS JOIN fs LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = fs.doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, lp ORDER BY score DESC, doc_id) AS rank FROM sp QUALIFY rank <= 3),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, variant, segment_id ORDER BY lp, rank) AS n FROM r) WHERE n = 1),
        f AS (SELECT query_id, doc_id, language, row_number() OVER (PARTITION BY query_id ORDER BY lp, rank, video_id || '|' || variant || '|' || segment_id) AS position FROM u)
        SELECT query_id, doc_id, language, position FROM f WHERE position <= 4""",
    "cross_language_merge": f"""WITH {_ranked_sql(20)},
        k AS (SELECT *, CASE language WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS lp,
              CASE WHEN doc_id % 4 > 0 THEN video_id || '|' || variant || '|s' || (doc_id % 6) ELSE video_id || '|' || variant || '|' || start_sec || '|' || end_sec END AS key FROM hits),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY lp, rank) AS n FROM k) WHERE n = 1)
        SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lp, rank, key) AS position FROM u) WHERE position <= 5""",
}
