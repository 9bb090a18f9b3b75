"""Translation as data: routes, cache, selective post-editing, summaries and texts in another language. The
model is a slot: a function of a text column and a language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import needs_review

# Other names of languages, pairs with a model of their own, and the language between others.
ALIASES = {"kk": "kz"}
DIRECT = ("en>ru", "ru>en", "ru>kz", "kz>ru")
PIVOT, BY_PIVOT = "ru", ("en>kz", "kz>en")
POST_EDIT_FROM, POST_EDIT_TO = "en", ("ru", "kz")


def language(c: Column) -> Column:
    """A language's one code."""
    code = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for other, own in ALIASES.items():
        code = F.when(code == other, own).otherwise(code)
    return code


def route(source: Column, target: Column) -> Column:
    """The steps (a>b) of a translation, none between equal languages; null for a pair that no model serves."""
    a, b = language(source), language(target)
    pair = F.concat(a, F.lit(">"), b)
    way = F.array(F.concat(a, F.lit(f">{PIVOT}")), F.concat(F.lit(f"{PIVOT}>"), b))
    return F.when(a == b, F.array().cast("array<string>")).when(pair.isin(*DIRECT), F.array(pair)).when(pair.isin(*BY_PIVOT), way)


def cache_key(text: Column, source: Column, target: Column, model: str, version: str, fingerprint: str) -> Column:
    """What a translation is kept by: the text, the pair, and all that its wording depends on."""
    return F.sha1(F.concat_ws("|", F.sha1(text), language(source), language(target), F.lit(model), F.lit(version), F.lit(fingerprint)))


def through_cache(rows: DataFrame, cache: DataFrame, translate: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with translated, entries to add to the cache): texts of rows(text, key) are looked up in
    cache(key, translated) first; what isn't there is translated once for each key; a blank result passes the
    text on as it is, and isn't kept."""
    misses = rows.join(cache.select("key"), "key", "left_anti").select("key", "text").dropDuplicates(["key"])
    made = misses.select("key", F.trim(translate(F.col("text"))).alias("translated")).where("translated <> ''")
    known = cache.select("key", "translated").unionByName(made)
    out = rows.join(known, "key", "left").withColumn("translated", F.coalesce("translated", F.trim("text")))
    return out, made


def post_edited(segments: DataFrame, edits: Callable[[Column, Column], Column], most: int, source: str, target: str) -> DataFrame:
    """Translated segments (video_id, pos, text, translated, anomaly_flag, risk_level) with post_edited: of those
    worth a look, the first ``most`` of each video are edited, from English into Russian or Kazakh only. A blank
    edit changes nothing; post_edited tells where the text became another one."""
    on = source == POST_EDIT_FROM and target in POST_EDIT_TO
    chosen = needs_review(F.col("anomaly_flag"), F.col("risk_level")) & F.lit(on)
    turn = F.sum(chosen.cast("int")).over(Window.partitionBy("video_id").orderBy("pos"))
    full = (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim(F.coalesce("translated", F.lit(""))) != "")
    edit = F.nullif(F.trim(edits(F.col("text"), F.col("translated"))), F.lit(""))
    rows = segments.withColumn("_edit", F.when(chosen & full & (turn <= most), edit))
    return rows.withColumn("post_edited", F.coalesce(F.col("_edit") != F.col("translated"), F.lit(False))).withColumn("translated", F.coalesce("_edit", "translated")).drop("_edit")


def translated_summaries(summaries: DataFrame, translate: Callable[[Column], Column], target: str, edit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Summaries (video_id, language, global_summary, summary, translation_views) in another language: both texts
    are the translation of the first that isn't blank, and the view of the language is put beside the others.
    Rows without a text have no translation."""
    text = F.coalesce(F.nullif("global_summary", F.lit("")), F.nullif("summary", F.lit("")))
    rows = summaries.withColumn("_text", text).where("_text is not null").withColumn("_mt", translate(F.col("_text")))
    done = F.lit(None).cast("string") if edit is None else F.nullif(F.trim(edit(F.col("_text"), F.col("_mt"))), F.lit(""))
    rows = rows.withColumn("_done", done).withColumn("_out", F.coalesce("_done", "_mt"))
    view = F.struct(F.col("_out").alias("mt_text"), F.col("_done").isNotNull().alias("post_edited"))
    old = F.map_filter(F.coalesce("translation_views", F.create_map().cast("map<string,struct<mt_text:string,post_edited:boolean>>")), lambda k, _: k != target)
    views = F.map_concat(old, F.create_map(F.lit(target), view))
    return rows.select("video_id", F.lit(target).alias("language"), F.col("_out").alias("global_summary"), F.col("_out").alias("summary"), views.alias("translation_views"))
