"""The driver's tables in the roles that the operators expect, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.text import STOP_EN

#: Words put in front of texts, by doc_id, so that rules have something to find.
CUES = (
    "a man walking to the door",
    "two people waiting near a car",
    "smoke and fire alarm, crowd running",
    "a cyclist with a backpack, system prompt",
    "in the frame: a truck moving fast, password here",
    "nothing stands out",
    "woman entering, unauthorized, Api Key and secret token",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cue() -> Column:
    return F.element_at(F.array(*map(F.lit, CUES)), (F.pmod("doc_id", F.lit(len(CUES))) + 1).cast("int"))


CUE_SQL = "list_extract([" + ", ".join("'" + c + "'" for c in CUES) + f"], CAST(doc_id % {len(CUES)} + 1 AS INT))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments: sources are videos, with 5 seconds between starts."""
    docs = table(spark, sf_dir, "documents")
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("flag"), F.max("quality").alias("quality"))
    order = Window.partitionBy("source").orderBy("doc_id")
    text = F.concat_ws(" ", cue(), "text")
    rows = docs.join(flags, "doc_id", "left").withColumn("pos", F.row_number().over(order) - 1)
    flag = F.coalesce("flag", F.lit(False))
    confidence = F.when(flag, 0.8).otherwise((F.pmod("doc_id", F.lit(10)) / 20.0))
    base = rows.select(
        "doc_id",
        F.col("source").alias("video_id"),
        F.col("lang").alias("language"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "base").otherwise("no_merge").alias("variant"),
        "pos",
        F.format_string("seg_%06d", F.col("pos") + 1).alias("segment_id"),
        (F.col("pos") * 5.0).alias("start_sec"),
        (F.col("pos") * 5.0 + 2.0 + F.pmod("doc_id", F.lit(5))).alias("end_sec"),
        text.alias("description"),
        flag.alias("anomaly_flag"),
        confidence.alias("anomaly_confidence"),
        F.when(flag, F.array(F.lit("flagged text"), F.lit("check"))).otherwise(F.array().cast("array<string>")).alias("anomaly_notes"),
    )
    base = base.withColumn("_low", rules.lowered(F.col("description")))
    d, f = F.col("_low"), F.col("anomaly_flag")
    told = rules.risk(d, f, F.col("anomaly_confidence"), F.col("anomaly_notes"), low=True)
    return base.select("*", rules.event_type(d, f, low=True).alias("event_type"), told["level"].alias("risk_level"), told["reason"].alias("severity_reason"), rules.people_bucket(d, low=True).alias("people_count_bucket"), rules.motion(d, low=True).alias("motion_type"), rules.tags(d, f, low=True).alias("tags"), rules.objects(d, low=True).alias("objects")).drop("_low")


def _any(terms: tuple[str, ...], c: str = "low") -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _labels_sql(names: dict[str, tuple[str, ...]], extra: str = "") -> str:
    parts = [f"CASE WHEN {_any(terms)} THEN '{name}' END" for name, terms in names.items()]
    return f"list_filter([{', '.join(parts)}{extra}], lambda x: x IS NOT NULL)"


#: Common table expressions that end with seg, the rows of segments().
SEGMENTS_SQL = f"""
flags AS (SELECT doc_id, max(toxic) = 1 AS flag, max(quality) AS quality FROM labels GROUP BY doc_id),
seg0 AS (
    SELECT d.doc_id, d.source AS video_id, d.lang AS language, CASE WHEN d.doc_id % 3 = 0 THEN 'base' ELSE 'no_merge' END AS variant,
           row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS pos,
           {CUE_SQL.replace("doc_id", "d.doc_id")} || ' ' || d.text AS description,
           coalesce(f.flag, false) AS anomaly_flag,
           CASE WHEN coalesce(f.flag, false) THEN 0.8::DOUBLE ELSE (d.doc_id % 10) / 20.0::DOUBLE END AS anomaly_confidence
    FROM documents d LEFT JOIN flags f ON f.doc_id = d.doc_id),
seg1 AS (
    SELECT *, lower(description) AS low, printf('seg_%06d', pos + 1) AS segment_id, pos * 5.0::DOUBLE AS start_sec,
           pos * 5.0::DOUBLE + 2.0 + doc_id % 5 AS end_sec,
           CASE WHEN anomaly_flag THEN ['flagged text', 'check'] ELSE CAST([] AS VARCHAR[]) END AS anomaly_notes
    FROM seg0),
seg2 AS (
    SELECT *, {_any(rules.OBJECTS["vehicle"])} AS has_vehicle, {_any(rules.OBJECTS["person"])} AS has_person FROM seg1),
seg AS (
    SELECT *,
        CASE WHEN anomaly_flag AND {_any(rules.SUSPICIOUS)} THEN 'suspicious_activity' WHEN has_vehicle THEN 'vehicle_activity'
             WHEN has_person AND {_any(rules.TAGS["entry_exit"])} THEN 'entry_exit' WHEN has_person THEN 'person_activity' ELSE 'scene_observation' END AS event_type,
        CASE WHEN {_any(rules.UNSAFE)} THEN 'warning' WHEN anomaly_flag AND anomaly_confidence >= 0.75 THEN 'warning'
             WHEN anomaly_flag OR anomaly_confidence >= 0.35 THEN 'attention' WHEN {_any(rules.NOTABLE)} THEN 'attention' ELSE 'normal' END AS risk_level,
        CASE WHEN {_any(rules.UNSAFE)} THEN '{rules.REASON_UNSAFE}' WHEN anomaly_flag AND anomaly_confidence >= 0.75 THEN '{rules.REASON_SUSPICIOUS}'
             WHEN anomaly_flag OR anomaly_confidence >= 0.35 THEN coalesce(anomaly_notes[1], '{rules.REASON_SIGNALS}')
             WHEN {_any(rules.NOTABLE)} THEN '{rules.REASON_NOTABLE}' ELSE '{rules.REASON_NONE}' END AS severity_reason,
        CASE WHEN NOT has_person THEN 'none' WHEN {_any(rules.CROWD)} THEN 'high' WHEN {_any(rules.SEVERAL)} THEN 'mid' ELSE 'low' END AS people_count_bucket,
        CASE WHEN {_any(rules.DYNAMIC)} THEN 'dynamic' WHEN {_any(rules.STABLE)} THEN 'stable' ELSE 'static' END AS motion_type,
        {_labels_sql(rules.TAGS, ", CASE WHEN anomaly_flag THEN 'attention' END")} AS tags,
        {_labels_sql(rules.OBJECTS)} AS objects
    FROM seg2)"""

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_EN)


def terms_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP_SQL}))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed observations: users are videos, hours since the first event are seconds."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.agg(F.min(micros).alias("first"))
    rows = events.select("event_id", F.col("user_id").alias("video_id"), "event_type", "value", micros.alias("us")).join(F.broadcast(first))
    return rows.select("video_id", F.col("event_id").alias("obs_id"), F.round((F.col("us") - F.col("first")) / 3.6e9, 3).alias("t"), "event_type", "value")


OBSERVATIONS_SQL = """
obs AS (SELECT user_id AS video_id, event_id AS obs_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 3.6e9, 3) AS t, event_type, value FROM events)"""
