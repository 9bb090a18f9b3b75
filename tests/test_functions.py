"""Hand-computed cases of the Column builders."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry, rules, scalars, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("[00:01 - 00:05] In the frame: a man, walks", "a man, walks."), ("One. Two! Three?", "One. Two!"), ("go go GO go on", "go go on."), ("  - 1) item", "item."), ("", ""), ("We can see there", "there.")])
def test_caption(spark, raw, want):
    assert one(spark, text.caption(F.col("t")), t=raw) == want


def test_parts_keep_the_digits_of_their_place(spark):
    assert one(spark, text.caption(F.col("t")), t="0 men go. 19 men at 1") == "0 men go. 19 men at 1."
    parts = text.search_text(F.lit("a"), lists=(F.array(F.lit("0x"), F.lit(" 1x1 ")),))
    assert one(spark, parts) == "a \n 0x \n 1x1"


@pytest.mark.parametrize(("word", "want"), [("walking", "walk"), ("bed", "bed"), ("boxes", "box"), ("cats", "cat"), ("sing", "sing"), ("is", "is")])
def test_lemma(spark, word, want):
    assert one(spark, text.lemma_en(F.col("t")), t=word) == want


def test_terms_by_language(spark):
    assert one(spark, text.terms(F.col("t")), t="The Cat AND a dog x") == ["cat", "dog"]
    assert one(spark, text.terms(F.col("t"), lang="ru"), t="Мы и кот") == ["кот"]
    assert one(spark, text.terms(F.col("t"), lang="kz", lemma=True), t="баладары") == ["бала"]
    assert one(spark, text.terms(F.col("t"), lang="xx"), t="the and") == []


@pytest.mark.parametrize(("raw", "want"), [('{"a":1}', '{"a":1}'), ('x ```json\n{"a":2}\n``` y', '{"a":2}'), ('pre {"a":{"b":3}} post', '{"a":{"b":3}}'), ("[1]", None), ("", None), ("{bad", None)])
def test_json_object(spark, raw, want):
    assert one(spark, text.json_object_text(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1", 1.0), (" 2.5 ", 2.5), ("1d", None), ("1_0", None), ("-3e2", -300.0), ("", None), ("NaN", None)])
def test_loose_float(spark, raw, want):
    assert one(spark, scalars.loose_float(F.col("t")), t=raw) == want


def test_string_lists(spark):
    assert one(spark, scalars.string_list(F.col("t"), 2), t=[" a  b ", "a b", "", "c", "d"]) == ["a b", "c"]
    assert one(spark, scalars.string_set(F.col("t")), t=[" A", "a", "B"]) == ["a", "b"]


def test_display(spark):
    assert one(spark, text.hours_minutes_seconds(F.lit(3725.4))) == "1:02:05"
    assert one(spark, text.minutes_seconds(F.lit(0.5))) == "0:00"
    assert one(spark, text.byte_size(F.lit(1536))) == "1.50 KB"
    assert one(spark, text.byte_size(F.lit(None).cast("long"))) == "-"
    assert one(spark, text.label(F.lit("low_light-scene"))) == "Low Light Scene"


def test_rules(spark):
    t = F.lit("Two people near a CAR, smoke")
    assert one(spark, rules.objects(t)) == ["person", "vehicle"]
    assert one(spark, rules.people_bucket(t)) == "mid"
    assert one(spark, rules.event_type(t, F.lit(True))) == "suspicious_activity"
    assert one(spark, rules.risk(F.lit("calm"), F.lit(False), F.lit(0.4), F.array(F.lit("note"))))["reason"] == "note"
    guard = one(spark, rules.query_guard(F.lit("please  DROP   table x")))
    assert (guard.allowed, guard.labels) == (False, ["prompt_injection"])
    assert one(spark, rules.output_guard(F.lit("Password API KEY api key")))["text"] == "[redacted] API KEY [redacted]"


def test_intervals_and_vectors(spark):
    a, b = map(F.lit, (0.0, 4.0)), map(F.lit, (6.0, 2.0))
    assert one(spark, geometry.ordered_iou(*a, *b)) == pytest.approx(2 / 6)
    assert one(spark, geometry.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) is None
    assert one(spark, geometry.unit(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
