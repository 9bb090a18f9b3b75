"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources in order of their names' code points, null last, weigh 5, 2, 1, 5, 2, 1, ... and share the
words of all sources. No target exceeds EPOCHS times its source; what is above is shared again by
weight among the others. The mix is a row of slots. Slot i lies at the i-th point of the
golden-ratio sequence (in 32-bit integers, so without rounding) and goes to the source whose part
of the cumulative targets holds that point. A source too small to hold a point shares one slot, dealt by
its number, with the slot's owner. A source's target, in whole words and one at least, is dealt evenly
over its slots, however many these are: the k-th slot takes the k-th of as many pieces of the source's
words, its documents in a seeded random order, end to end, up to EPOCHS times. So every source gives its
target to the word, and slots are of about equal size where a source has many of them.

Sums along a source, and ranks of slots, are cut into cells first (common.running_sum), so a source
with a third of all rows is many tasks' work. Sources are a short list next to their documents;
windows over them run in one task. Null texts and texts without words have size 0 and are never
taken. Every row is a document of its own, whatever doc_ids repeat or are null; rows of one doc_id,
source and size come in the order of their places in the files. An empty table gives no rows, and
columns besides doc_id, text and source are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROW, cells_for, located, running_sum, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Slots of the schedule at most.
SLOTS = 1 << 17
#: 2**32 divided by the golden ratio.
GOLDEN = 2654435769
CELLS = 4096
SEED = 20240301


def targets(sized: DataFrame) -> DataFrame:
    """(source, sid, source_size, target): sid numbers the sources; targets add up to all sizes."""
    every = Window.partitionBy()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", EPOCHS * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("share", share).withColumn("k", F.row_number().over(by_ratio))
    fits = ranked.withColumn("first", F.min(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("k"))).over(every))
    level = F.max(F.when(F.col("k") == F.col("first"), F.col("share"))).over(every)
    return fits.withColumn("level", level).select("source", "sid", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def slots_of(plan: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, k): the slots of each source with a target, one at least, and their ranks among the source's slots."""
    spark = plan.sparkSession
    here = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    parts = plan.where("target > 0").select("sid", (F.sum("target").over(here) / total).alias("hi"), "target", total.alias("total"))
    last = F.max("sid").over(Window.partitionBy())
    parts = parts.select("sid", (F.col("hi") - F.col("target") / F.col("total")).alias("lo"), F.when(F.col("sid") == last, 1.0).otherwise(F.col("hi")).alias("hi"))
    before = F.lag("hi", 1, 0.0).over(Window.orderBy("sid"))  # no gap between parts
    parts = parts.select("sid", before.alias("lo"), "hi")
    cells = parts.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))).alias("cell"))
    point = ((F.col("id") + 1) * GOLDEN % (1 << 32)) / float(1 << 32)
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    owned = points.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "sid")
    ranked = stored(running_sum(owned, ["sid"], ["slot"], F.col("slot") / slots, F.lit(1), cells_for(slots), "k"), "mix-owned")
    # Written, so that the few sources between two points are found without a shuffle on the source.
    held = stored(ranked.select("sid").distinct(), "mix-held")
    dealt = F.shiftright((F.col("sid") + 1) * GOLDEN % (1 << 32) * slots, 32)
    small = parts.join(held, "sid", "left_anti").select(dealt.alias("slot"), "sid", F.lit(0).cast("long").alias("k"))
    return ranked.select("slot", "sid", F.col("k").cast("long").alias("k")).unionByName(small)


def scheduled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents of a located() table (ROW, key, source, size, source_size, target, sid, start) and the
    mix (slot, sid, start, epoch, skip, words): slot takes these words of the document that starts there."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    u = F.pmod(F.xxhash64(F.lit(SEED), key, source, ROW[1]), F.lit(1 << 31)) / float(1 << 31)
    sized = stored(docs.select(*ROW, F.col(key).alias("doc_id"), F.col(source).alias("source"), words.cast("long").alias("size"), u.alias("u")), "mix-sizes")
    total, rows = sized.agg(F.sum("size"), F.count(F.lit(1))).first()
    slots = min(SLOTS, max(1, total or 0))
    plan = stored(targets(sized), "mix-targets")
    named = sized.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = stored(running_sum(named, ["sid"], ["u", "doc_id", "size", *ROW], F.col("u"), F.col("size"), cells_for(rows), "start"), "mix-placed")
    schedule = stored(slots_of(plan, slots), "mix-slots")
    # written, so that its size is known: next to documents it is short, and no source meets in one task
    goal = F.greatest(F.lit(1), F.round("target")).cast("long")
    reach = stored(schedule.groupBy("sid").agg(F.count(F.lit(1)).alias("pieces")).join(plan.select("sid", goal.alias("reach")), "sid"), "mix-reach")
    epochs = placed.where("size > 0").join(reach, "sid").select("*", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
    epochs = epochs.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start")).where("begin < reach").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("reach")))
    # piece k of a source holds its words from k * reach div pieces on
    first, last = F.expr("((begin + 1) * pieces - 1) div reach"), F.expr("(end * pieces - 1) div reach")
    cut = epochs.select("sid", "start", "epoch", "begin", "end", "pieces", "reach", F.explode(F.sequence(first, last)).alias("k"))
    low, high = F.greatest("begin", F.expr("k * reach div pieces")), F.least("end", F.expr("(k + 1) * reach div pieces"))
    pieces = cut.select("sid", "start", "epoch", "k", (low - F.col("begin")).alias("skip"), (high - low).alias("words")).where("words > 0")
    return placed, pieces.join(schedule, ["sid", "k"]).select("slot", "sid", "start", "epoch", "skip", "words")


def mixed(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    placed, mix = scheduled(located(docs))
    taken = mix.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("words").alias("taken"))
    joined = placed.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def drawn(docs: DataFrame) -> DataFrame:
    """docs as the mix draws them: a row for each time that a document is begun; what the mix doesn't
    reach is left out."""
    rows = located(docs)
    placed, mix = scheduled(rows)
    times = mix.where("skip = 0").groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.countDistinct("epoch").cast("int").alias("_tessera_times"))
    begun = placed.where("size > 0").join(times, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start"))).select(*ROW, "_tessera_times")
    again = rows.join(begun, ROW).withColumn("_tessera_turn", F.explode(F.sequence(F.lit(1), F.col("_tessera_times"))))
    return again.select(*[again[f"`{c}`"] for c in docs.columns])
