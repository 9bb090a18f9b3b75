"""Rules that enrich and guard segment text, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import clamp01, clean, string_list

# Words by which objects, tags and states are told; all are searched as substrings.
OBJECTS = {
    "person": ("person", "people", "man", "woman", "pedestrian"),
    "vehicle": ("car", "vehicle", "truck", "bus", "motorcycle"),
    "bicycle": ("bicycle", "bike", "cyclist"),
    "bag": ("bag", "backpack", "package"),
    "door": ("door", "gate", "entrance"),
}
TAGS = {
    "movement": ("walk", "walking", "move", "moving", "approach"),
    "idle_presence": ("stand", "standing", "wait", "waiting"),
    "entry_exit": ("enter", "exit", "leave"),
    "vehicle": ("car", "vehicle", "truck", "bus"),
}
CROWD = ("crowd", "many people", "group of people")
SEVERAL = ("two people", "three people", "several people", "group")
DYNAMIC = ("run", "running", "rush", "fast", "chaotic")
STABLE = ("walk", "walking", "move", "moving", "drive")
SUSPICIOUS = ("fall", "fight", "smoke", "fire", "intrusion", "trespass")
UNSAFE = ("fight", "fire", "smoke", "alarm", "collision")
NOTABLE = ("running", "rush", "loiter", "unauthorized", "trespass")
# Reasons, by rule.
REASON_UNSAFE = "Visible signs point to an explicitly unsafe event."
REASON_SUSPICIOUS = "The observation stage marked the segment as highly suspicious."
REASON_SIGNALS = "The observation stage detected suspicious visual signals."
REASON_NOTABLE = "Movement or behavior suggests a segment worth operator attention."
REASON_NONE = "No strong warning signals are visible in the segment."
# Guards.
BLOCKED_QUERIES = ("ignore previous instructions", "system prompt", "developer message", "bypass safety", "drop table", "rm -rf")
REDACTED = ("api key", "password", "secret token")
BAD_OUTPUT = ("```", "#!/bin/bash", "#!/usr/bin/env bash", "apt-get ", "pip install ", "curl ", "wget ", "chmod +x", "bash script", "shell script", "i'm not sure", "i am not sure", "not sure this")
RISKS, PEOPLE, MOTIONS = ("normal", "attention", "warning", "critical"), ("none", "low", "mid", "high"), ("static", "stable", "dynamic")
NO_ACTIVITY = "No clear visible activity is described."


def lowered(c: Column) -> Column:
    """Text as the rules look at it. A rule lowers its text itself; callers that apply several rules to one
    long text make a column of this first and say low=True."""
    return F.lower(F.coalesce(c, F.lit("")))


def has_any(c: Column, terms: tuple[str, ...], low: bool = False) -> Column:
    """Whether any term is a substring, in any case."""
    low = c if low else lowered(c)
    out = low.contains(terms[0])
    for t in terms[1:]:
        out = out | low.contains(t)
    return out


def _labels(c: Column, table: dict[str, tuple[str, ...]], low: bool, *more: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has_any(c, terms, low), name) for name, terms in table.items()], *more))


def objects(c: Column, low: bool = False) -> Column:
    return _labels(c, OBJECTS, low)


def tags(c: Column, flag: Column, low: bool = False) -> Column:
    return _labels(c, TAGS, low, F.when(flag, "attention"))


def people_bucket(c: Column, low: bool = False) -> Column:
    return F.when(~has_any(c, OBJECTS["person"], low), "none").when(has_any(c, CROWD, low), "high").when(has_any(c, SEVERAL, low), "mid").otherwise("low")


def motion(c: Column, low: bool = False) -> Column:
    return F.when(has_any(c, DYNAMIC, low), "dynamic").when(has_any(c, STABLE, low), "stable").otherwise("static")


def event_type(c: Column, flag: Column, low: bool = False) -> Column:
    person = F.when(has_any(c, TAGS["entry_exit"], low), "entry_exit").otherwise("person_activity")
    return F.when(flag & has_any(c, SUSPICIOUS, low), "suspicious_activity").when(has_any(c, OBJECTS["vehicle"], low), "vehicle_activity").when(has_any(c, OBJECTS["person"], low), person).otherwise("scene_observation")


def risk(c: Column, flag: Column, confidence: Column, notes: Column, low: bool = False) -> Column:
    """struct(level, reason), the first rule that holds."""

    def told(level: str, reason: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), reason.alias("reason"))

    return (
        F.when(has_any(c, UNSAFE, low), told("warning", F.lit(REASON_UNSAFE)))
        .when(flag & (confidence >= 0.75), told("warning", F.lit(REASON_SUSPICIOUS)))
        .when(flag | (confidence >= 0.35), told("attention", F.coalesce(F.get(notes, F.lit(0)), F.lit(REASON_SIGNALS))))
        .when(has_any(c, NOTABLE, low), told("attention", F.lit(REASON_NOTABLE)))
        .otherwise(told("normal", F.lit(REASON_NONE)))
    )


def member_or(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)


def needs_attention(level: Column, flag: Column) -> Column:
    return (level != "normal") | flag


def guarded_observation(description: Column, flag: Column, confidence: Column, notes: Column) -> Column:
    """struct(description, flag, confidence, notes): what isn't flagged has no notes and 0.5 at most."""
    flag = F.coalesce(flag, F.lit(False))
    sure, text = clamp01(confidence), clean(description)
    return F.struct(
        F.when(text == "", NO_ACTIVITY).otherwise(text).alias("description"),
        flag.alias("flag"),
        F.when(flag, sure).otherwise(F.least(sure, F.lit(0.5))).alias("confidence"),
        F.when(flag, string_list(notes, 4)).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def guarded_segment(description: Column, normalized: Column, raw: Column, flag: Column, confidence: Column, notes: Column, tags_c: Column, objects_c: Column) -> Column:
    """struct of a segment's repaired fields; notes stay also where nothing is flagged."""
    flag = F.coalesce(flag, F.lit(False))
    sure = clamp01(confidence)

    def first(*cs: Column) -> Column:
        return clean(F.coalesce(*[F.nullif(c, F.lit("")) for c in cs]))

    return F.struct(
        first(description, normalized, raw).alias("description"),
        first(normalized, description, raw).alias("normalized_caption"),
        flag.alias("flag"),
        F.when(flag, sure).otherwise(F.least(sure, F.lit(0.5))).alias("confidence"),
        string_list(notes, 6).alias("notes"),
        string_list(tags_c, 8).alias("tags"),
        string_list(objects_c, 8).alias("objects"),
    )


def query_guard(c: Column) -> Column:
    """struct(allowed, labels, reason, backend)."""
    hit = has_any(clean(c), BLOCKED_QUERIES)
    return F.struct((~hit).alias("allowed"), F.when(hit, F.array(F.lit("prompt_injection"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(hit, "blocked_phrase").otherwise("ok").alias("reason"), F.lit("rules").alias("backend"))


def output_guard(c: Column) -> Column:
    """struct(labels, reason, text): phrases are redacted in lower case and in title case only."""
    hit = has_any(clean(c), REDACTED)
    text = F.coalesce(c, F.lit(""))
    for phrase in REDACTED:
        for form in (phrase, phrase.title()):
            text = F.replace(text, F.lit(form), F.lit("[redacted]"))
    return F.struct(F.when(hit, F.array(F.lit("sensitive_output"))).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(hit, "redacted_output").otherwise("ok").alias("reason"), text.alias("text"))


def bad_output(c: Column) -> Column:
    return (F.trim(F.coalesce(c, F.lit(""))) == "") | has_any(c, BAD_OUTPUT)


# Descriptions that tell nothing, what a generated one may begin with, and its least length.
EMPTY_DESCRIPTIONS = ("No clear visible activity is described", "the scene", "the image")
FENCES, REPLY_HEADS, LEAST_DESCRIPTION = ("```json", "```"), ('"): "', '\u201d: "'), 35


def clean_description(c: Column) -> Column:
    """A description without what a model's reply leaves around it: fences, the end of a key, quotes."""
    text = F.coalesce(c, F.lit(""))
    for fence in FENCES:
        text = F.replace(text, F.lit(fence), F.lit(""))
    text = clean(text)
    head = text.startswith(REPLY_HEADS[0]) | text.startswith(REPLY_HEADS[1])
    text = F.btrim(F.when(head, F.substr(text, F.lit(5))).otherwise(text), F.lit(' "'))
    return F.when(text.endswith('".'), F.concat(F.substring(text, F.lit(1), F.length(text) - 2), F.lit("."))).otherwise(text)


def valid_description(c: Column) -> Column:
    """Whether a clean description can serve as a query."""
    return (F.length(c) >= LEAST_DESCRIPTION) & ~c.isin(*EMPTY_DESCRIPTIONS) & ~c.startswith(":")


def needs_review(flag: Column, level: Column) -> Column:
    """Whether a segment is worth an operator's or an editor's look."""
    return F.coalesce(flag, F.lit(False)) | F.lower(F.trim(F.coalesce(level, F.lit("")))).isin(*RISKS[1:])
