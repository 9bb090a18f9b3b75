"""Profiles and row builders."""

import pytest

from tessera import config, schemas
from tessera.operators import timeline


def test_profiles_extend_and_merge():
    files = {"base": {"a": {"x": 1, "y": [1]}, "b": 2}, "main": {"extends": "base", "a": {"y": [2]}}, "loop": {"extends": "loop"}}
    assert config.resolved("main", files.__getitem__, {"a": {"z": 3}}) == {"a": {"x": 1, "y": [2], "z": 3}, "b": 2}
    with pytest.raises(ValueError, match="loop > loop"):
        config.resolved("loop", files.__getitem__)
    assert config.fingerprint({"a": 1, "b": 2}) == config.fingerprint({"b": 2, "a": 1}) != config.fingerprint({"a": 2})
    assert config.positive_ks("5, 1,x,5") == [1, 5] and config.positive_ks("") == [1, 3, 5, 10]


def test_latex(spark):
    text = config.latex(spark.createDataFrame([("a_b", 0.12345), ("c", None)], "k string, v double"), "50% done")
    assert "a\\_b & 0.123" in text and "c & --" in text and "50\\% done" in text
    with pytest.raises(ValueError, match="more than"):
        config.latex(spark.range(5), "x", most=4)


def test_segments_have_their_schema(spark):
    rows = spark.createDataFrame([("v", 0.0, 2.0, 0, "[00:00] a man walks", True, 0.9, ["n"]), ("v", 2.5, 4.0, 1, "man walks a", False, 0.1, ["m"]), ("v", 9.0, 9.5, 2, "other thing", False, 0.0, [])], "video_id string, start_sec double, end_sec double, pos long, description string, anomaly_flag boolean, anomaly_confidence double, anomaly_notes array<string>")
    segs = schemas.segments(timeline.merged_by_text(rows, 0.9, 1.0), "en")
    assert [f.name for f in segs.schema] == [f.name for f in spark.createDataFrame([], schemas.SEGMENT).schema]
    got = segs.orderBy("segment_id").collect()
    assert [(r.segment_id, r.start_sec, r.end_sec, r.anomaly_flag, r.anomaly_notes, r.extra.merged_from) for r in got] == [("seg_000001", 0.0, 4.0, True, ["n", "m"], [0, 1]), ("seg_000002", 9.0, 9.5, False, [], [2])]
    assert got[0].description == "a man walks" and got[0].needs_attention
    assert [r.clip_id for r in schemas.observations(rows).orderBy("clip_id").collect()] == ["clip_000001", "clip_000002", "clip_000003"]
