"""Text: tokens, clean-up of model output, display formats and identifiers, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import clean

WORD = r"[\p{L}\p{N}_]+"
# Stop words.
STOP_EN = tuple(
    "the a an and or is are was were to of in on for with at by from as that this it its be been being into out up down over under not no yes but so if".split()
)
STOP_RU = tuple("и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне есть они тут где мы там чтобы кто когда из от до".split())
STOP_KZ = tuple("және мен пен бен да де та те жоқ бар бір екі үш төрт бұл сол осы үшін мені сені оны онда мында сонда не қалай қайда қашан".split())
# Endings that are taken off, in this order, of words at least three letters longer.
ENDINGS_EN = ("ing", "ed", "es", "s")
ENDINGS_RU = tuple("ами ями ого ему ому ыми ими ах ях ов ев ым им ый ий ая яя ое ее".split())
ENDINGS_KZ = tuple("лары лері дары дері тары тері тың тің ның нің мен пен бен ға ге қа ке да де та те".split())
# Phrases that open a caption without telling anything.
OPENERS = ("in the frame", "in the image", "in the video", "we can see", "there is", "there are", "visible is", "shown is")


def words(c: Column) -> Column:
    """All words, Unicode letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def _cut(ending_list: tuple[str, ...]):
    def cut(x: Column) -> Column:
        out = x
        for e in reversed(ending_list):
            out = F.when(x.endswith(e) & (F.length(x) > len(e) + 2), F.substring(x, F.lit(1), F.length(x) - len(e))).otherwise(out)
        return out

    return cut


lemma_en, lemma_ru, lemma_kz = _cut(ENDINGS_EN), _cut(ENDINGS_RU), _cut(ENDINGS_KZ)


def terms(c: Column, lang: str = "en", lemma: bool = False) -> Column:
    """Lower-case words of two characters or more that aren't stop words; a language that has no list of
    its own uses the English one."""
    stop, cut = {"ru": (STOP_RU, lemma_ru), "kz": (STOP_KZ, lemma_kz)}.get(lang, (STOP_EN, lemma_en))
    kept = F.filter(words(F.lower(F.coalesce(c, F.lit("")))), lambda x: (F.length(x) > 1) & ~x.isin(*stop))
    return F.transform(kept, cut) if lemma else kept


def plain_terms(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.filter(words(F.lower(F.coalesce(c, F.lit("")))), lambda x: F.length(x) > 1)


def strip_prefix(c: Column) -> Column:
    """Without a leading [time range]."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[[0-9:\s\-]+\]\s*", "")


def description_terms(c: Column) -> Column:
    """The set that descriptions are compared by: words of three characters or more."""
    spaced = F.regexp_replace(strip_prefix(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_]+", " ")
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda x: F.length(x) > 2))


def text_overlap(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def with_end_mark(c: Column) -> Column:
    return F.when((c != "") & ~c.rlike(r"[.!?]$"), F.concat(c, F.lit("."))).otherwise(c)


def first_sentences(c: Column, most: int = 2) -> Column:
    # trim() has a second parameter: as it is, transform() would hand it an element's place as characters to trim
    parts = F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return with_end_mark(clean(F.concat_ws(" ", F.slice(parts, 1, most))))


def without_repeats(c: Column, most: int = 2) -> Column:
    """Of a word repeated in a row (in any case), the first ``most``."""
    parts = F.filter(F.split(clean(c), " "), lambda x: x != "")

    def step(acc: Column, w: Column) -> Column:
        same = F.lower(w) == acc["last"]
        run = F.when(same, acc["run"] + 1).otherwise(0)
        return F.struct(F.lower(w).alias("last"), run.alias("run"), F.when(same & (run >= most), acc["out"]).otherwise(F.concat(acc["out"], F.array(w))).alias("out"))

    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.array().cast("array<string>").alias("out"))
    return with_end_mark(F.aggregate(parts, zero, step, lambda acc: F.concat_ws(" ", acc["out"])))


def caption(c: Column) -> Column:
    """One raw caption made into one or two sentences."""
    t = clean(strip_prefix(c))
    t = F.trim(F.regexp_replace(t, "(?i)^(" + "|".join(OPENERS) + r")\s*[:,\-]?\s*", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^\s*[-*]+\s*", ""), r"^\s*\(?[0-9]+\)?[.)]\s*", ""))
    return without_repeats(first_sentences(t))


def json_object(c: Column) -> Column:
    """The first JSON object in raw model text (itself, a fenced part, or what the outermost braces
    hold), as VARIANT; null if there is none."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    fenced = F.split(F.replace(F.replace(raw, F.lit("```json"), F.lit("```")), F.lit("```JSON"), F.lit("```")), "```")
    parts = F.when(raw.contains("```"), F.filter(F.transform(fenced, lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    found = F.filter(F.concat(F.array(raw), parts, F.array(braces)), lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False)))
    return F.try_parse_json(F.get(found, F.lit(0)))


def json_object_text(c: Column) -> Column:
    return F.to_json(json_object(c))


def tag(c: Column) -> Column:
    """An identifier: runs of other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")


def slug(c: Column) -> Column:
    """Lower case; each character but letters, digits, - and _ becomes an underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")


def _whole_seconds(c: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(F.coalesce(c, F.lit(0.0))).cast("long"))


def minutes_seconds(c: Column) -> Column:
    s = _whole_seconds(c)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def hours_minutes_seconds(c: Column) -> Column:
    s = _whole_seconds(c)
    h = F.floor(s / 3600)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def byte_size(c: Column) -> Column:
    """1536 as 1.50 KB; null as -."""
    v = c.cast("double")
    out = F.format_string("%.2f TB", F.bround(v / 1024.0**4, 2))  # half to even
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(v < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(v / 1024.0**k, 2))).otherwise(out)
    return F.when(c.isNull(), "-").otherwise(F.when(v < 1024, F.concat(v.cast("long").cast("string"), F.lit(" B"))).otherwise(out))


def first_sentence(c: Column) -> Column:
    t = clean(c)
    out = F.trim(F.substring(t, 1, 160))
    for mark in (" - ", "? ", "! ", ". "):
        at = F.instr(t, mark)
        out = F.when(at > 1, F.btrim(F.substring(t, F.lit(1), at - 1), F.lit(" ."))).otherwise(out)
    return out


def clipped(c: Column, most: int = 260) -> Column:
    t = clean(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def label(c: Column) -> Column:
    """snake_case and kebab-case as words in title case."""
    parts = F.filter(F.split(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit("_")), "_"), lambda x: x != "")
    return F.initcap(F.concat_ws(" ", parts))


def html_escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def search_text(caption_c: Column, *parts: Column, lists: tuple[Column, ...] = ()) -> Column:
    """The searchable text of a segment: its parts that aren't blank, joined by ' \\n '."""
    single = [F.nullif(F.trim(c), F.lit("")) for c in (caption_c, *parts)]
    many = [F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") for c in lists]
    return F.concat_ws(" \n ", *single, *many)
