"""Queries of text functions, rules, guards and lenient casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules, scalars, text
from tessera.operators import translate
from tessera.plans.fixtures import CUE_SQL, SEGMENTS_SQL, cue, segments, table, terms_sql


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat_ws(" ", cue(), "text").alias("text"), "n_chars")


_TEXTS = f"t AS (SELECT doc_id, lang, source, {CUE_SQL} || ' ' || text AS text, n_chars FROM documents)"


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), F.size(text.plain_terms(F.col("text"))).alias("n_plain"))


def stopword_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def lemma_en_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(text.terms(F.col("text"), lemma=True)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def description_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the terms of each document share with those of its predecessor in the source."""
    from pyspark.sql import Window

    rows = _texts(spark, sf_dir).withColumn("a", text.description_terms(F.concat(F.lit("[00:01 - 00:05] "), F.col("text"))))
    before = F.lag("a").over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("b", before).where("b is not null").select("doc_id", F.round(text.text_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def sanitized_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("[00:10 - 00:15]  "), F.when(F.col("doc_id") % 2 == 0, F.lit("In the frame: ")).otherwise(F.lit("- ")), F.element_at(F.split("text", " "), 1), F.lit(" the The the THE "), "text")
    return _texts(spark, sf_dir).select("doc_id", text.caption(raw).alias("caption"))


def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.coalesce("props", F.lit("{}"))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Result "), props, F.lit(" done"))).otherwise(F.lit("no object [1]"))
    return table(spark, sf_dir, "events").select("event_id", text.json_object(raw).isNotNull().alias("found"), F.variant_get(text.json_object(raw), "$.k", "string").alias("k"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.substring(F.sha1(t), 1, 16).alias("fingerprint"), F.sha2(t, 256).alias("sha256"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" ."), "text", F.lit("_ "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(text.tag(raw)).alias("tag"), F.sha1(text.slug(raw)).alias("slug"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    secs = F.col("n_chars") / 2.0
    return _texts(spark, sf_dir).select(
        "doc_id",
        text.minutes_seconds(secs).alias("mmss"),
        text.hours_minutes_seconds(secs).alias("hms"),
        text.byte_size(F.col("n_chars") * 1021).alias("bytes"),
        text.first_sentence(F.col("text")).alias("headline"),
        text.clipped(F.col("text"), 60).alias("clipped"),
        text.label(F.concat(F.lit("some_"), F.lower("source"), F.lit("-value"))).alias("label"),
    )


def html_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(text.html_escaped(F.col("html"))).alias("sha1"))


_CASTS = "('1'), (' 2.5 '), ('1d'), ('1_000'), ('-3e2'), ('.5'), ('abc'), (''), (NULL), ('true'), ('Yes'), ('ON'), ('0'), ('1e')"


def loose_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM VALUES {_CASTS} AS t(raw)")
    v = scalars.loose_float(F.col("raw"))
    return rows.select("raw", v.alias("number"), scalars.loose_bool(F.col("raw")).alias("truth"), scalars.clamp01(v).alias("share"), scalars.finite_or_zero(F.col("raw")).alias("or_zero"), scalars.safe_divide(F.lit(1), v).alias("inverse"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as search documents: identifier by position, searchable text, hash of it."""
    cols = [F.col(c) for c in ("event_type", "risk_level", "people_count_bucket", "motion_type")]
    body = text.search_text(F.col("description"), *cols, lists=(F.col("tags"), F.col("objects")))
    name = F.concat_ws("/", "video_id", F.when(F.col("variant") != "base", F.col("variant")), F.format_string("seg_%04d", F.col("pos")))
    return segments(spark, sf_dir).select("doc_id", name.alias("search_id"), F.sha1(body).alias("text_sha1"))


def translation_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes between languages (kk is kz; en and kz go by way of ru) and the mock translation."""
    rows = spark.sql("SELECT s, t FROM VALUES ('en'), ('ru'), ('kk'), ('kz') AS a(s) JOIN (VALUES ('en'), ('ru'), ('kk'), ('de')) AS b(t)")
    code = {c: F.when(F.col(c) == "kk", "kz").otherwise(F.col(c)) for c in ("s", "t")}
    pair = F.concat_ws(">", code["s"], code["t"])
    route = F.when(code["s"] == code["t"], F.lit("")).when(pair.isin("en>kz", "kz>en"), F.concat_ws(">", code["s"], F.lit("ru"), code["t"])).when(pair.isin("en>ru", "ru>en", "ru>kz", "kz>ru"), pair)
    return rows.select(F.col("s").alias("source"), F.col("t").alias("target"), route.alias("route"), F.concat(F.lit("["), F.upper(code["t"]), F.lit("] hello")).alias("mock"))


def enrich_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("doc_id", "event_type", "risk_level", "severity_reason", "people_count_bucket", "motion_type", F.concat_ws(",", "tags").alias("tags"), F.concat_ws(",", "objects").alias("objects"), rules.needs_attention(F.col("risk_level"), F.col("anomaly_flag")).alias("needs_attention"))


def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    return seg.groupBy("risk_level", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("anomaly_flag").alias("flagged"))


def attention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(rules.needs_review(F.col("anomaly_flag"), F.col("risk_level"))).select("doc_id", "risk_level")


def guard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rules.query_guard(F.replace(F.initcap("text"), F.lit(" "), F.lit("  ")))
    return _texts(spark, sf_dir).select("doc_id", g["allowed"].alias("allowed"), g["reason"].alias("reason"), F.array_join(g["labels"], ",").alias("labels"))


def redact_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rules.output_guard(F.concat("text", F.lit(" API KEY, api key and Password")))
    return _texts(spark, sf_dir).select("doc_id", g["reason"].alias("reason"), F.sha1(g["text"]).alias("sha1"))


def bad_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("I'm not sure "), F.col("text"))).otherwise(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", rules.bad_output(raw).alias("bad"))


def validated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.array(F.lit(" a  b "), F.lit("a b"), F.lit(""), F.col("lang"), F.lit("c"), F.lit("d"), F.lit("e"))
    g = rules.guarded_observation(F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("text")), F.col("doc_id") % 2 == 0, F.col("doc_id") / 500.0 - 0.2, notes)
    return _texts(spark, sf_dir).select("doc_id", g["description"].alias("description"), g["flag"].alias("flag"), F.round(g["confidence"], 6).alias("confidence"), F.array_join(g["notes"], "|").alias("notes"))


def validated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    g = rules.guarded_segment(blank, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("n "), F.col("lang"))), F.lit("raw"), F.col("doc_id") % 2 == 0, F.lit(0.9), F.array("lang"), F.split("text", " "), F.array("lang", "lang"))
    level = rules.member_or(F.when(F.col("doc_id") % 2 == 0, F.lit("critical")).otherwise(F.lit("odd")), rules.RISKS, "normal")
    return _texts(spark, sf_dir).select("doc_id", g["description"].alias("description"), g["normalized_caption"].alias("caption"), g["confidence"].alias("confidence"), F.array_join(g["tags"], "|").alias("tags"), F.array_join(g["objects"], "|").alias("objects"), level.alias("level"))


def valid_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions, with what replies leave around them, cleaned; those that can serve as queries."""
    k = F.col("doc_id") % 7
    raw = F.when(k == 0, F.concat(F.lit("```json "), "text", F.lit(" ```"))).when(k == 1, F.concat(F.lit('"): "'), "text", F.lit('".'))).when(k == 2, F.concat(F.lit('\u201d: "'), "text")).when(k == 3, "the scene").when(k == 4, F.concat(F.lit(": "), "text")).when(k == 5, rules.EMPTY_DESCRIPTIONS[0]).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", rules.clean_description(raw).alias("d"))
    return rows.select("doc_id", F.sha1("d").alias("sha1"), rules.valid_description(F.col("d")).alias("valid"))


def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a translation between any two of a few languages."""
    codes = spark.sql("SELECT explode(array('en', ' RU', 'kk', 'kz', 'de')) AS code")
    pairs = codes.select(F.col("code").alias("source")).join(codes.select(F.col("code").alias("target")))
    return pairs.select("source", "target", F.concat_ws(",", translate.route(F.col("source"), F.col("target"))).alias("route"))


QUERIES = {f.__name__: f for f in (tokenize_counts, stopword_filtered_counts, lemma_en_counts, description_overlap, sanitized_captions, json_salvage, hashes, identifiers, display_formats, html_escapes, loose_casts, search_documents, translation_routes, enrich_rules, risk_levels, attention_candidates, guard_query, redact_output, bad_generations, validated_observations, validated_segments, valid_descriptions, translation_pairs)}

_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LEMMA = "CASE WHEN suffix(x, 'ing') AND length(x) > 5 THEN x[:-4] WHEN suffix(x, 'ed') AND length(x) > 4 THEN x[:-3] WHEN suffix(x, 'es') AND length(x) > 4 THEN x[:-3] WHEN suffix(x, 's') AND length(x) > 3 THEN x[:-2] ELSE x END"
_BLOCK = " OR ".join(f"contains(c, '{p}')" for p in rules.BLOCKED_QUERIES)
_RED = " OR ".join(f"contains(c, '{p}')" for p in rules.REDACTED)


def _redacted(c: str) -> str:
    for p in rules.REDACTED:
        for form in (p, p.title()):
            c = f"replace({c}, '{form}', '[redacted]')"
    return c


_WS = "' \t\n\x0b\x0c\r'"
ORACLES = {
    "tokenize_counts": "SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: length(x) > 1)) AS n_plain FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents)",
    "stopword_filtered_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms_sql('text')}) AS term FROM documents) GROUP BY term",
    "lemma_en_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest(list_transform({terms_sql('text')}, lambda x: {_LEMMA})) AS term FROM documents) GROUP BY term",
    "description_overlap": f"""WITH {_TEXTS}, a AS (SELECT doc_id, source, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: length(x) > 2)) AS a FROM t),
        b AS (SELECT *, lag(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM a)
        SELECT doc_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM b WHERE b IS NOT NULL""",
    "sanitized_captions": f"""WITH {_TEXTS}, r AS (SELECT doc_id, '[00:10 - 00:15]  ' || CASE WHEN doc_id % 2 = 0 THEN 'In the frame: ' ELSE '- ' END || string_split(text, ' ')[1] || ' the The the THE ' || text AS x FROM t),
        a AS (SELECT doc_id, {_CLEAN.format("regexp_replace(x, '^" + chr(92) + "[[0-9:" + chr(92) + "s" + chr(92) + "-]+" + chr(92) + "]" + chr(92) + "s*', '')")} AS x FROM r),
        b AS (SELECT doc_id, trim(regexp_replace(x, '^({"|".join(text.OPENERS)})\\s*[:,\\-]?\\s*', '', 'i')) AS x FROM a),
        c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '^\\s*[-*]+\\s*', ''), '^\\s*\\(?[0-9]+\\)?[.)]\\s*', '')) AS x FROM b),
        d AS (SELECT doc_id, array_to_string((list_filter(string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> ''))[:2], ' ') AS x FROM c),
        e AS (SELECT doc_id, string_split(CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?]$') THEN x || '.' ELSE x END, ' ') AS w FROM d),
        f AS (SELECT doc_id, array_to_string(list_filter(w, lambda y, i: NOT (i > 2 AND lower(w[i - 1]) = lower(y) AND lower(w[i - 2]) = lower(y))), ' ') AS x FROM e)
        SELECT doc_id, CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?]$') THEN x || '.' ELSE x END AS caption FROM f""",
    "json_salvage": "SELECT event_id, event_id % 4 < 3 AS found, CASE WHEN event_id % 4 < 3 THEN json_extract_string(coalesce(props, '{}'), '$.k') END AS k FROM events",
    "hashes": "SELECT doc_id, sha1(text) AS sha1, sha1(text)[:16] AS fingerprint, sha256(text) AS sha256 FROM documents",
    "identifiers": "SELECT doc_id, sha1(regexp_replace(regexp_replace(trim(r), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')) AS tag, sha1(regexp_replace(regexp_replace(lower(trim(r)), '[^\\p{L}\\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM (SELECT doc_id, ' .' || text || '_ ' AS r FROM documents)",
    "display_formats": f"""WITH {_TEXTS}, s AS (SELECT *, CAST(round_even(n_chars / 2.0, 0) AS BIGINT) AS s, n_chars * 1021 AS b, {_CLEAN.format("text")} AS c FROM t)
        SELECT doc_id, printf('%d:%02d', s // 60, s % 60) AS mmss, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS hms,
               CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) ELSE printf('%.2f GB', b / 1073741824.0::DOUBLE) END AS bytes,
               CASE WHEN instr(c, '. ') > 1 THEN trim(c[:instr(c, '. ') - 1], ' .') WHEN instr(c, '! ') > 1 THEN trim(c[:instr(c, '! ') - 1], ' .') WHEN instr(c, '? ') > 1 THEN trim(c[:instr(c, '? ') - 1], ' .') WHEN instr(c, ' - ') > 1 THEN trim(c[:instr(c, ' - ') - 1], ' .') ELSE trim(c[:160]) END AS headline,
               CASE WHEN length(c) <= 60 THEN c ELSE rtrim(c[:57]) || '...' END AS clipped, 'Some S' || lower(source)[2:] || ' Value' AS label FROM s""",
    "html_escapes": "SELECT page_id, sha1(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS sha1 FROM pages",
    "loose_casts": f"""WITH r AS (SELECT * FROM (VALUES {_CASTS}) t(raw)), v AS (SELECT raw, CASE WHEN regexp_matches(trim(raw), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS v FROM r)
        SELECT raw, v AS number, lower(trim(coalesce(raw, ''))) IN ('1', 'true', 'yes', 'y', 'on') AS truth, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(v, 0))) AS share, coalesce(v, 0.0::DOUBLE) AS or_zero, CASE WHEN v <> 0 THEN 1 / v END AS inverse FROM v""",
    "search_documents": f"""WITH {SEGMENTS_SQL} SELECT doc_id, video_id || CASE WHEN variant <> 'base' THEN '/' || variant ELSE '' END || '/' || printf('seg_%04d', pos) AS search_id,
        sha1(array_to_string(list_concat([trim(description), event_type, risk_level, people_count_bucket, motion_type], list_concat(tags, objects)), ' ' || chr(10) || ' ')) AS text_sha1 FROM seg""",
    "translation_routes": """WITH r AS (SELECT s, t, CASE s WHEN 'kk' THEN 'kz' ELSE s END AS a, CASE t WHEN 'kk' THEN 'kz' ELSE t END AS b FROM (VALUES ('en'), ('ru'), ('kk'), ('kz')) x(s), (VALUES ('en'), ('ru'), ('kk'), ('de')) y(t))
        SELECT s AS source, t AS target, CASE WHEN a = b THEN '' WHEN a || b IN ('enkz', 'kzen') THEN a || '>ru>' || b WHEN a || b IN ('enru', 'ruen', 'rukz', 'kzru') THEN a || '>' || b END AS route, '[' || upper(b) || '] hello' AS mock FROM r""",
    "enrich_rules": f"WITH {SEGMENTS_SQL} SELECT doc_id, event_type, risk_level, severity_reason, people_count_bucket, motion_type, coalesce(array_to_string(tags, ','), '') AS tags, coalesce(array_to_string(objects, ','), '') AS objects, risk_level <> 'normal' OR anomaly_flag AS needs_attention FROM seg",
    "risk_levels": f"WITH {SEGMENTS_SQL} SELECT risk_level, event_type, count(*) AS n, count_if(anomaly_flag) AS flagged FROM seg GROUP BY ALL",
    "attention_candidates": f"WITH {SEGMENTS_SQL} SELECT doc_id, risk_level FROM seg WHERE anomaly_flag OR risk_level IN ('attention', 'warning', 'critical')",
    "guard_query": f"WITH {_TEXTS}, c AS (SELECT doc_id, lower({_CLEAN.format('text')}) AS c FROM t), h AS (SELECT doc_id, ({_BLOCK}) AS h FROM c) SELECT doc_id, NOT h AS allowed, CASE WHEN h THEN 'blocked_phrase' ELSE 'ok' END AS reason, CASE WHEN h THEN 'prompt_injection' ELSE '' END AS labels FROM h",
    "redact_output": f"WITH {_TEXTS}, r AS (SELECT doc_id, text || ' API KEY, api key and Password' AS x FROM t), c AS (SELECT *, lower({_CLEAN.format('x')}) AS c FROM r) SELECT doc_id, CASE WHEN {_RED} THEN 'redacted_output' ELSE 'ok' END AS reason, sha1({_redacted('x')}) AS sha1 FROM c",
    "bad_generations": f"WITH {_TEXTS} SELECT doc_id, doc_id % 5 <= 1 OR (" + " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in rules.BAD_OUTPUT) + ") AS bad FROM t",
    "validated_observations": f"""WITH {_TEXTS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{rules.NO_ACTIVITY}' ELSE {_CLEAN.format("text")} END AS description, doc_id % 2 = 0 AS flag,
        round(least(greatest(0, least(1, doc_id / 500.0::DOUBLE - 0.2)), CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0.5 END), 6) AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'a b|' || lang || '|c|d' ELSE '' END AS notes FROM t""",
    "validated_segments": f"""WITH {_TEXTS}, w AS (SELECT *, {_CLEAN.format("text")} AS d, list_filter(list_transform(string_split(text, ' '), lambda x: {_CLEAN.format("x")}), lambda x: x <> '') AS l FROM t),
        u AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS f FROM w)
        SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN d WHEN doc_id % 2 = 0 THEN 'n ' || lang ELSE 'raw' END AS description, CASE WHEN doc_id % 2 = 0 THEN 'n ' || lang WHEN doc_id % 3 > 0 THEN d ELSE 'raw' END AS caption,
        CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, array_to_string(f[:8], '|') AS tags, lang AS objects, CASE WHEN doc_id % 2 = 0 THEN 'critical' ELSE 'normal' END AS level FROM u""",
    "valid_descriptions": f"""WITH r AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text || ' ' WHEN 1 THEN '"): "' || text || '".' WHEN 2 THEN '\u201d: "' || text WHEN 3 THEN 'the scene' WHEN 4 THEN ': ' || text WHEN 5 THEN '{rules.EMPTY_DESCRIPTIONS[0]}' ELSE text END AS x FROM documents),
        c AS (SELECT doc_id, {_CLEAN.format("x")} AS c FROM r), h AS (SELECT doc_id, trim(CASE WHEN starts_with(c, '"): "') OR starts_with(c, '\u201d: "') THEN c[5:] ELSE c END, ' "') AS c FROM c),
        e AS (SELECT doc_id, CASE WHEN suffix(c, '".') THEN c[:-3] || '.' ELSE c END AS c FROM h)
        SELECT doc_id, sha1(c) AS sha1, length(c) >= 35 AND c NOT IN ('{rules.EMPTY_DESCRIPTIONS[0]}', 'the scene', 'the image') AND NOT starts_with(c, ':') AS valid FROM e""",
    "translation_pairs": """WITH c AS (SELECT unnest(['en', ' RU', 'kk', 'kz', 'de']) AS code), n AS (SELECT code, CASE lower(trim(code)) WHEN 'kk' THEN 'kz' ELSE lower(trim(code)) END AS n FROM c)
        SELECT a.code AS source, b.code AS target, CASE WHEN a.n = b.n OR 'de' IN (a.n, b.n) THEN '' WHEN a.n || b.n IN ('enkz', 'kzen') THEN a.n || '>ru,ru>' || b.n ELSE a.n || '>' || b.n END AS route FROM n a, n b""",
}
