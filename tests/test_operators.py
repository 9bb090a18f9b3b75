"""Small cases of operators that no SQL tells, plans, and reads and writes of files."""

import gzip
import json
import os

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import jobs, metrics, quality, search, timeline
from tessera.sources import files


def test_semantic_merge_keeps_running_direction(spark):
    rows = spark.createDataFrame([("v", 0.0, 1.0, 0, [1.0, 0.0]), ("v", 1.5, 2.0, 1, [0.8, 0.6]), ("v", 2.5, 3.0, 2, [0.0, 1.0]), ("v", 9.0, 10.0, 3, [0.0, 1.0]), ("w", 0.0, 1.0, 0, None), ("w", 1.0, 2.0, 1, None)], "video_id string, start_sec double, end_sec double, pos long, vector array<double>")
    got = sorted((r.video_id, r.start_sec, r.end_sec, r.members) for r in timeline.merged_by_vector(rows, 0.7, 1.0).collect())
    assert got == [("v", 0.0, 2.0, [0, 1]), ("v", 2.5, 3.0, [2]), ("v", 9.0, 10.0, [3]), ("w", 0.0, 1.0, [0]), ("w", 1.0, 2.0, [1])]


def test_semantic_merge_compares_directions(spark):
    """Lengths don't matter, zero vectors are unlike all, and what observations tell is merged too."""
    rows = spark.createDataFrame([("v", 0.0, 1.0, 0, [0.5, 0.0], "[00:01] a", False, 0.2, ["x"]), ("v", 1.0, 2.0, 1, [0.5, 0.0], "b", True, 0.1, ["y", "x"]), ("v", 2.0, 3.0, 2, [0.0, 0.0], "c", False, None, None)], "video_id string, start_sec double, end_sec double, pos long, vector array<double>, description string, anomaly_flag boolean, anomaly_confidence double, anomaly_notes array<string>")
    got = sorted(map(tuple, timeline.merged_by_vector(rows, 0.9, 1.0).collect()))
    assert got == [("v", 0.0, 2.0, "a", True, 0.2, ["x", "y"], [0, 1]), ("v", 2.0, 3.0, "c", False, 0.0, [], [2])]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 30, width=16), min_size=1, max_size=25))
def test_thinning_of_videos_is_that_of_clips(spark, times):
    rows = spark.createDataFrame([("v", float(t), i) for i, t in enumerate(sorted(times))], "video_id string, t double, id long").coalesce(1)
    whole = sorted(r.id for r in timeline.thinned_frames(rows, 0.3).collect())
    frames = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("t", "id"))).alias("f"))
    assert whole == sorted(x.id for x in frames.select(timeline.thinned(F.col("f"), 0.3).alias("f")).first().f)
    for most in (1, 3, 7):
        ids = frames.select(timeline.evenly(F.transform("f", lambda x: x["id"]), most).alias("i")).first().i
        assert sorted(r.id for r in timeline.even_frames(rows, most).collect()) == sorted(ids)


def test_clips_without_a_rate_keep_tied_frames(spark):
    frames = spark.createDataFrame([("v", t, i) for i, t in enumerate([0.0, 1.0, 1.0, 1.0, 2.0])], "video_id string, t double, id long")
    videos = spark.createDataFrame([("v", 2.0)], "video_id string, duration double")
    got = timeline.clips(frames, videos, 10.0, 10.0, 0.0, 2, 9).collect()
    assert [(r.ids, r.keyframe) for r in got] == [([0, 1, 2, 3, 4], 2)]


def test_clip_keyframes_of_tied_events(spark, sf_dir, tmp_path):
    """The query and its SQL, over events that happen twice at the same time."""
    from tessera.plans.registry import ORACLES, QUERIES
    from tests.oracle import connection, same_rows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.union(events.withColumn("event_id", F.col("event_id") + 10**6)).coalesce(1).write.parquet(str(tmp_path / "twice"))
    (part,) = (tmp_path / "twice").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    same_rows(QUERIES["clip_keyframes"](spark, str(tmp_path)), connection(tmp_path), ORACLES["clip_keyframes"])


def test_wildcards_meet_by_equal_fields(spark):
    from itertools import product

    from tessera.operators import experiments

    fields = list(product([None, " ", "v1", " v2 "], ["", "P", "q "], [None, "x", "Y"]))
    asked = [(i, *f) for i, f in enumerate(fields)]
    known = [(i, *f) for i, f in enumerate(product([None, "v1", "v2", "V1"], [None, "p", "Q"], ["X ", "y", ""]))]
    kind = "_id long, video_id string, profile string, variant string"
    queries, targets = (spark.createDataFrame(rows, kind.replace("_id", name, 1)) for rows, name in ((asked, "query_id"), (known, "target_id")))
    got = experiments.wildcard_matches(queries, targets)

    def low(x):
        return (x or "").strip().lower()

    want = [(q[0], t[0]) for q in asked for t in known if (not low(q[1]) or q[1].strip() == t[1]) and all(not low(a) or low(a) == low(b) for a, b in zip(q[2:], t[2:], strict=True))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_change_gate_warms_up(spark):
    rows = [("v", float(i), i, float(v), 50.0, 50.0) for i, v in enumerate([0] * 10 + [9, 9, 200])]
    got = timeline.change_gate(spark.createDataFrame(rows, "video_id string, t double, id long, value double, brightness double, sharpness double"), 20.0, 10.0, 10.0).orderBy("id").collect()
    assert [r.state for r in got] == ["warm_up"] * 9 + ["lazy", "kept", "lazy", "scene_cut"]
    assert got[-1].threshold == 5.0


def test_batches_close(spark):
    rows = spark.createDataFrame([("v", i, n) for i, n in enumerate([10, 9, 8, 2, 2])], "video_id string, clip int, n int")
    got = [(r.clip, r.batch) for r in timeline.packed(rows, 2, 100, 0.5).orderBy("clip").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1, width=32), min_size=1, max_size=8))
def test_scaling_keeps_bounds(spark, values):
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "query_id int, doc_id long, sparse double")
    got = [r.s for r in rows.select(search.scaled("sparse").alias("s")).collect()]
    assert min(got) == 0.0 and max(got) <= 1.0


def test_missing_dense_scores_rank_last(spark):
    found = spark.createDataFrame([(1, 1, 2.0, None), (1, 2, None, 0.5)], "query_id int, doc_id long, sparse double, dense double")
    got = {r.doc_id: r.score for r in search.rrf(found).collect()}
    assert got == pytest.approx({1: 0.55 / 62 + 0.45 / 61, 2: 0.55 / 61 + 0.45 / 62})


def test_heuristic_bonus_is_added_as_it_is(spark):
    hits = spark.createDataFrame([(1, 10, 1, 1.0, 0.0), (1, 11, 2, 0.5, 0.6), (1, 12, 3, 0.4, 9.0)], "query_id int, doc_id long, rank int, score double, gain double")
    order = [r.doc_id for r in search.reranked(hits, "gain", 1, 2).orderBy("position").collect()]
    assert order == [11, 10, 12]
    assert [r.doc_id for r in search.reranked(hits, "gain", 1, 2, "model").orderBy("position").collect()] == [10, 11, 12]
    with pytest.raises(ValueError, match="reranking"):
        search.reranked(hits, "gain", 1, 2, "other")


def test_candidates_get_both_scores(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "query_id int, doc_id long")
    sparse = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (1, 99, 7.0)], "query_id int, doc_id long, score double")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, [0.0, 3.0])], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 1.0])], "query_id int, vector array<double>")
    got = {r.doc_id: (r.sparse, r.dense) for r in search.gathered(found, sparse, vectors, queries).collect()}
    assert got == {10: (2.0, 2.0), 11: (1.0, None), 12: (0.0, 3.0)}


def test_sparse_candidates_with_score_zero(spark):
    scores = spark.createDataFrame([(1, 5, 2.0), (1, 99, 3.0)], "query_id int, doc_id long, score double")
    docs = spark.createDataFrame([(i,) for i in (3, 4, 5, 6)], "doc_id long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.sparse_top(scores, docs, queries, 3).collect()}
    assert got == {(1, 1): (5, 2.0), (1, 2): (3, 0.0), (1, 3): (4, 0.0), (2, 1): (3, 0.0), (2, 2): (4, 0.0), (2, 3): (5, 0.0)}


def test_dense_in_blocks(spark, monkeypatch):
    """Many blocks of queries and batches of vectors give what one product gives."""
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(40, 4)).round(1), rng.normal(size=(6, 4)).round(1)
    v[7] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, vector array<double>")
    monkeypatch.setattr(search, "QUERY_BYTES", 64)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in search.dense(vectors, queries, 3, 6).collect())
    want = []
    for i, row in enumerate(np.round(q @ v.T, 6)):
        best = sorted((x for x in range(40) if x != 7), key=lambda x: (-row[x], x))[:3]
        want += [(i, r + 1, x) for r, x in enumerate(best)]
    assert got == want and search.dense(vectors, queries).count() == 6 * 39


def test_search_settings(spark):
    with pytest.raises(ValueError, match="dedupe"):
        search.Settings(dedupe="none")
    with pytest.raises(ValueError, match="reranker"):
        search.search(None, spark.range(1), None, spark.range(1), search.Settings(rerank="model"))
    assert not search.Settings(k_sparse=0).sparse_on and not search.Settings(w_dense=0.0).dense_on


def test_search_by_a_model(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, "cat cat"), (3, "dog")], "doc_id long, description string").select("*", F.lit("v").alias("video_id"), F.col("doc_id").cast("double").alias("start_sec"), (F.col("doc_id") + 0.5).alias("end_sec"))
    index = search.build_index(docs.select("doc_id", F.col("description").alias("text")))
    queries = spark.createDataFrame([(1, "cat", None)], "query_id long, text string, vector array<double>")
    how = search.Settings(top_k=2, k_sparse=2, w_dense=0.0, rerank="model")
    hits = search.search(index, docs, None, queries, how, lambda q, d: F.when(d.contains("red"), 100.0).otherwise(0.0)).orderBy("position").collect()
    assert [r.doc_id for r in hits] == [1, 2] and hits[0].score < hits[1].score


def test_imports_and_packages_are_whole(spark):
    from tessera.operators import catalog, experiments

    manifest = spark.createDataFrame([("a", "/1"), ("b", "/2")], "video_id string, source_path string")
    none = spark.createDataFrame([], "video_id string")
    with pytest.raises(Exception, match="missing sources: /2"):
        catalog.importable(manifest, spark.createDataFrame([("/1",)], "path string"), none).collect()
    wanted = spark.createDataFrame([("t", "a.csv")], "label string, name string")
    for paths, wrong in ((["x/a.csv", "y/a.csv"], "ambiguous"), (["x/b.csv"], "missing or empty")):
        with pytest.raises(Exception, match=wrong):
            catalog.package_list(wanted, spark.createDataFrame([(x, 1, "h") for x in paths], "path string, length long, sha256 string")).collect()
    with pytest.raises(Exception, match="no archive metrics"):
        experiments.with_archive(manifest, manifest.limit(0), ["video_id"], ["source_path"], "source_path").collect()
    with pytest.raises(Exception, match="unknown dataset"):
        manifest.select(experiments.dataset_by_prefix(F.col("video_id"), {"x_": "x"})).collect()


def test_aligned_index(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ids = spark.createDataFrame([(0, 2), (1, 1), (2, 9)], "place int, doc_id long")
    vectors = spark.createDataFrame([(1, [1.0], True), (2, [1.0], False)], "doc_id long, vector array<double>, valid boolean")
    assert [(r.doc_id, r.valid) for r in search.aligned(docs, ids, vectors).orderBy("place").collect()] == [(2, False), (1, True)]
    short = vectors.withColumn("valid", F.when(F.col("doc_id") == 1, False))
    assert all(r.valid for r in search.aligned(docs, ids, short).collect())


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    index = search.build_index(none)
    assert search.bm25(index, spark.createDataFrame([(1, "cat")], "query_id long, text string")).count() == 0
    assert metrics.run_stats(spark.createDataFrame([], "video_id string, v double"), [], ["v"]).first().runs == 0


def test_errors_are_raised(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y")], "video_id string, dataset_id string")
    with pytest.raises(Exception, match="conflict"):
        quality.dataset_of(rows).collect()
    with pytest.raises(ValueError, match="lacks"):
        quality.manifest_errors(rows)
    with pytest.raises(Exception, match="blank"):
        metrics.ablation_means(spark.createDataFrame([(" ", 1.0)], "k string, m double"), ["k"], ["m"]).collect()
    running = spark.createDataFrame([("j", "v", "running")], "job_id string, video_id string, state string")
    with pytest.raises(Exception, match="processed"):
        jobs.without_video(running, "v").collect()


def test_queue_moves_within_bounds(spark):
    queue = spark.createDataFrame([(x, i + 1) for i, x in enumerate("abcd")], "job_id string, place int")
    for how, steps, want in (("up", 9, "cabd"), ("down", 1, "abdc"), ("bottom", 1, "abdc"), ("top", 1, "cabd")):
        got = jobs.moved(queue, "c", how, steps).orderBy("place").collect()
        assert "".join(r.job_id for r in got) == want


def test_plans(spark, sf_dir):
    from tessera.plans.registry import QUERIES

    plan = QUERIES["bm25_topk"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_segment_files(spark, tmp_path):
    folder = tmp_path / "vid1" / "outputs" / "variants" / "alt" / "segments"
    os.makedirs(folder)
    lines = ['{"segment_id": "s1", "start_sec": 1.5}', "", "[1]", '{"segment_id": "s2"}']
    with gzip.open(folder / "en.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (folder / "en.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    schema = "segment_id string, start_sec double"
    gz = files.read_gz(spark, str(folder / "*.gz"), schema)
    zst = files.read_zst(spark, str(folder / "*.zst"), schema)
    assert [r.segment_id for r in gz.orderBy("segment_id").collect()] == ["s1", "s2"]
    assert [(r.segment_id, r.start_sec, r.pos) for r in zst.orderBy("pos").collect()] == [("s1", 1.5, 0), ("s2", None, 3)]
    place = zst.select(files.source_of(F.col("path")).alias("p")).first().p
    assert (place.video_id, place.variant) == ("vid1", "alt")
    assert sorted(r.segment_id for r in files.read_gz(spark, files.segment_glob(str(tmp_path), "en", "alt").replace("{gz,zst}", "gz"), schema).collect()) == ["s1", "s2"]
    with gzip.open(folder / "de.jsonl.gz", "wt") as f:
        f.write('{"segment_id": "s3"}\n{broken')
    with pytest.raises(Exception, match="malformed"):
        files.read_gz(spark, str(folder / "de.jsonl.gz"), schema).collect()
    assert [r.segment_id for r in files.read_gz(spark, str(folder / "de.jsonl.gz"), schema, strict=False).collect()] == ["s3"]
    both = gz.select("segment_id", "path").union(zst.select("segment_id", "path"))
    assert all(r.path.endswith(".zst") for r in files.prefer_zst(both, "segment_id").collect())


def test_zst_round_trip(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit("ä"), F.col("id").cast("string")).alias("t")).repartition(3)
    assert files.write_zst(rows, f"file://{tmp_path}/out") == 3
    back = files.read_zst(spark, f"{tmp_path}/out/*.zst", "id long, t string")
    assert sorted((r.id, r.t) for r in back.collect()) == sorted((r.id, r.t) for r in rows.collect())


def test_documents_and_tables(spark, tmp_path):
    os.makedirs(tmp_path / "docs")
    (tmp_path / "docs" / "a.json").write_text(json.dumps({"x": 1}))
    (tmp_path / "docs" / "b.json").write_text("{broken")
    assert [r.x for r in files.read_documents(spark, str(tmp_path / "docs"), "x int").collect()] == [1]
    files.write_table(spark.createDataFrame([("a", 'q"u, x')], "k string, v string"), str(tmp_path / "csv"))
    assert files.read_table(spark, str(tmp_path / "csv"), ["k", "v"]).first().v == 'q"u, x'
    with pytest.raises(ValueError, match="header"):
        files.read_table(spark, str(tmp_path / "csv"), ["v", "k"])
    both = files.combined({"a": spark.range(1), "b": spark.range(1).withColumnRenamed("id", "z")})
    assert both.columns == ["id", "artifact", "z"] and both.count() == 2


def test_video_choice(spark):
    rows = spark.createDataFrame([("v", "b.AVI"), ("v", "z.mp4"), ("v", "a.mp4"), ("w", "x.txt")], "video_id string, name string")
    assert [tuple(r) for r in files.pick_video(rows).collect()] == [("v", "a.mp4")]


def test_vectors_of_members(spark):
    raw = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [0.0, 2.0])], "video_id string, pos long, vector array<double>")
    segs = spark.createDataFrame([("v", 0, [0, 1, 7])], "video_id string, seg long, members array<long>")
    assert timeline.member_vectors(segs, raw).first().vector == pytest.approx(list(np.array([1, 1]) / np.sqrt(2)))
