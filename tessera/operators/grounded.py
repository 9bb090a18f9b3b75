"""Grounded text from hits: context blocks, reports and answers. Times are rounded half to even, as the
shortest decimal with one digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_REPORT = "No grounded evidence found for the requested scope."
NO_ANSWER = "No grounded evidence was found for this question in the retrieved search scope."
HEAD = "Grounded answer based on retrieved evidence:"


def tenth(c: Column) -> Column:
    return F.format_string("%.1f", F.bround(F.coalesce(c, F.lit(0.0)), 1))


def lines(hits: DataFrame, line: Column, most: int | None = None) -> Column:
    """The lines of a query's hits in order of rank, joined; hits are few (top_k)."""
    row = F.struct("rank", line.alias("line"))
    kept = F.when(F.col("rank") <= most, row) if most else row
    return F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["line"]))


def text_of(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def context(hits: DataFrame, most: int = 6) -> DataFrame:
    segment = F.coalesce(F.nullif(F.col("segment_id"), F.lit("")), F.lit("-"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". video="), text_of("video_id"), F.lit(" time="), tenth(F.col("start_sec")), F.lit("-"), tenth(F.col("end_sec")), F.lit(" segment="), segment, F.lit(" text="), text_of("description"))
    return hits.groupBy("query_id").agg(lines(hits, line, most).alias("context"))


def report(hits: DataFrame, video_id: str | None = None) -> DataFrame:
    fields = F.concat_ws(" | ", *[F.when(text_of(c) != "", F.concat(F.lit(f"{name}="), F.col(c))) for name, c in (("type", "event_type"), ("risk", "risk_level"), ("people", "people_count_bucket"), ("motion", "motion_type"))])
    meta = F.when(fields != "", F.concat(F.lit(" ["), fields, F.lit("]"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), text_of("video_id"), F.lit(" ["), tenth(F.col("start_sec")), F.lit("-"), tenth(F.col("end_sec")), F.lit("] "), text_of("description"), meta)
    head = f"Grounded report for {video_id}." if video_id else "Grounded report."
    return hits.groupBy("query_id").agg(F.concat(F.lit(head + "\n"), lines(hits, line)).alias("report"))


def answer(hits: DataFrame) -> DataFrame:
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce(F.nullif(text_of("video_id"), F.lit("")), F.lit("-")), F.lit(" ["), tenth(F.col("start_sec")), F.lit("-"), tenth(F.col("end_sec")), F.lit("s]: "), text_of("description"))
    more = F.count(F.lit(1)) - 3
    rest = F.when(more > 0, F.concat(F.lit("\nAdditional grounded segments available: "), more.cast("string"), F.lit("."))).otherwise("")
    return hits.groupBy("query_id").agg(F.concat(F.lit(HEAD + "\n"), lines(hits, line, 3), rest).alias("answer"))


def with_fallback(queries: DataFrame, made: DataFrame, column: str, default: str) -> DataFrame:
    """One row for each query; those without hits get the default text."""
    return queries.select("query_id").join(made, "query_id", "left").withColumn(column, F.coalesce(column, F.lit(default)))


def guarded(texts: DataFrame, column: str) -> DataFrame:
    """Texts after the output guard."""
    from tessera.functions.rules import output_guard

    return texts.withColumn(column, output_guard(F.col(column))["text"])


def chosen(model_text: Column, fallback: Column, has_context: Column) -> Column:
    """struct(text, mode): the model's text where there is context and it isn't bad, else the fallback."""
    from tessera.functions.rules import bad_output

    good = has_context & model_text.isNotNull() & ~bad_output(model_text)
    return F.struct(F.when(good, model_text).otherwise(fallback).alias("text"), F.when(good, "model").otherwise("deterministic").alias("mode"))
