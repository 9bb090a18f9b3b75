"""Secret scans, in DataFrame operations only: fixed patterns, and Markov models of characters.

Two first-order models, one of random strings and one of ordinary identifiers, are trained from
labelled samples; what reaches the driver is a table of ratios as large as the alphabet squared. Runs
of MARKOV_LEAST or more characters of that alphabet are scored from left to right: log-likelihood
ratios are summed, and the sum begins anew where it falls below zero. The stretch with the highest sum,
of MARKOV_LEAST characters at least, is a span ``random`` if that sum exceeds BOUND and the stretch has
a digit and a letter. The ``assign``, ``access`` and ``hex`` spans of the patterns stay whatever the
models say.

Offsets count code points, ends are exclusive. Spans are summed up in chunks of CHUNK, so long lists
aren't copied for each match. Null and empty texts have no span; rows are scanned one by one, so
repeated rows have equal spans and an empty table gives no rows; spans with one start are in the order
of KINDS. Only the columns ``keep`` and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, located

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MARKOV_LEAST = 20
#: Log of the odds that an ordinary stretch must be beaten by.
BOUND = 12.0
#: Rows whose words make the sample of ordinary identifiers, words of each at most, and random strings to
#: set against them.
SAMPLE_TEXTS, SAMPLE_WORDS = 60, 5000
SAMPLE_RANDOM = 2000
#: Matches whose spans are added up in one list.
CHUNK = 256
KINDS = ("assign", "access", "hex", "random")
# Kind, pattern, group that must have so many characters.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
RUN = "[A-Za-z0-9+/_=-]{%d,}" % MARKOV_LEAST


def samples(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(value, label): digests written in several ways are 1; identifiers made of the words of a bounded
    sample of texts are 0."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    plain = F.regexp_replace(coded, "[+/=]", "")
    made = F.array(digest, coded, plain, F.upper(F.substring(plain, 1, 24)), F.substring(digest, 1, 24))
    random = spark.range(SAMPLE_RANDOM).select(F.explode(made).alias("value"), F.lit(1).alias("label"))
    rows = located(docs).select(*ROW, key, text)
    chosen = rows.select(*ROW, key).orderBy(F.xxhash64(F.lit(5), key, ROW[1]), *ROW).limit(SAMPLE_TEXTS).select(*ROW)
    words = rows.join(F.broadcast(chosen), ROW, "left_semi").select(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), 1, SAMPLE_WORDS).alias("w"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b"), i.alias("i"))))
    pairs = words.where(F.size("w") > 1).select(pair.alias("x")).select("x.*")
    n = F.col("i").cast("string")
    named = F.array(F.concat("a", F.lit("_"), "b", F.lit("_"), n), F.concat(F.initcap("a"), F.initcap("b"), n), F.concat(F.lit("/"), "a", F.lit("/"), "b", F.lit("-2024-01-"), n), F.concat("a", F.lit("-"), "b", F.lit("="), n), F.concat(F.upper("a"), F.lit("_"), F.upper("b")), F.concat("a", "b"))
    return random.union(pairs.select(F.explode(named).alias("value"), F.lit(0).alias("label")))


def fit(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair of characters, row by row of the alphabet; smoothed by one."""
    chars = F.split(F.col("value"), "")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.concat(F.element_at(F.col("chars"), i), F.element_at(F.col("chars"), i + 1))))
    counts = labelled.where(F.length("value") > 1).select("label", "value", chars.alias("chars")).select("label", pair.alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))
    seen = {(r.label, r.pair): r.n for r in counts.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
    out = []
    for a in ALPHABET:
        ends = [[seen.get((label, a + b), 0) + 1 for b in ALPHABET] for label in (0, 1)]
        out += [math.log(y / sum(ends[1])) - math.log(x / sum(ends[0])) for x, y in zip(*ends, strict=True)]
    return out


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, pattern: str, group: int, least: int, kind: str, test=None) -> Column:
    """Spans (start, kind number, end) of the matches that pass. Matches lie between the parts that
    split() leaves, so lengths add up to offsets. test tells the part of a match that passes, as
    struct(passes, from, to)."""
    parts, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.zip_with(F.slice(parts, F.lit(1), F.size(whole)), F.zip_with(whole, told, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda p, x: F.struct(F.length(p).alias("p"), F.length(x["m"]).alias("m"), x["g"].alias("g")))
    kind_no = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        if test is None:
            span = F.when(F.length(x["g"]) >= least, F.array(F.struct(start.alias("start"), kind_no.alias("kind"), end.alias("end"))))
        else:
            span = let(test(x["g"]), lambda t: F.when(t["passes"], F.array(F.struct((start + t["from"]).alias("start"), kind_no.alias("kind"), (start + t["to"]).alias("end")))))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.coalesce(span, none)).alias("out"))

    def chunks(all_rows: Column) -> Column:
        """The spans of each chunk, whose matches begin where those of the chunk before end."""
        first = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))
        begins = F.sequence(F.lit(1), F.size(all_rows), F.lit(CHUNK))
        return F.aggregate(begins, first, lambda acc, i: F.concat(acc, F.array(F.aggregate(F.slice(all_rows, i, F.lit(CHUNK)), F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out")), step))))

    return F.when(text.rlike(pattern), F.flatten(F.transform(let(rows, chunks), lambda x: x["out"]))).otherwise(none)


def is_random(ratios: Column):
    """The best stretch of a run, and whether its log-likelihood ratio exceeds BOUND."""
    alphabet = F.lit(ALPHABET)

    def test(run: Column) -> Column:
        places = F.transform(F.split(run, ""), lambda c: F.instr(alphabet, c))
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("before"), F.lit(0).alias("begin"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(0).alias("to"))

        def step(acc: Column, c: Column) -> Column:
            ratio = F.coalesce(F.get(ratios, (acc["before"] - 1) * len(ALPHABET) + c - 1), F.lit(0.0))
            total = F.when(acc["before"] > 0, acc["sum"] + ratio).otherwise(0.0)

            def onwards(s: Column) -> Column:
                begin = F.when(s < 0, acc["i"]).otherwise(acc["begin"])
                end = acc["i"] + 1
                better = (s > acc["best"]) & (end - begin >= MARKOV_LEAST)
                return F.struct(end.alias("i"), c.alias("before"), begin.alias("begin"), F.greatest(s, F.lit(0.0)).alias("sum"), F.when(better, s).otherwise(acc["best"]).alias("best"), F.when(better, begin).otherwise(acc["from"]).alias("from"), F.when(better, end).otherwise(acc["to"]).alias("to"))

            return let(total, onwards)

        def judged(acc: Column) -> Column:
            part = F.substring(run, acc["from"] + 1, acc["to"] - acc["from"])
            return F.struct(((acc["best"] > BOUND) & part.rlike("[0-9]") & part.rlike("[A-Za-z]")).alias("passes"), acc["from"].alias("from"), acc["to"].alias("to"))

        return F.aggregate(places, zero, step, judged)

    return test


def scanned(docs: DataFrame, ratios: list[float], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """docs' columns ``keep`` with base (array of spans of the patterns) and spans (all, in order)."""
    # split() of a literal is folded into one constant array
    table = F.split(F.lit(" ".join(f"{x:.6f}" for x in ratios)), " ").cast("array<double>")
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    rows = rows.select(*keep, *[found(t, pattern, group, least, kind).alias(f"_{kind}") for kind, pattern, group, least in BASE], found(t, RUN, 0, MARKOV_LEAST, "random", is_random(table)).alias("_random"))
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    return rows.select(*keep, *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS], base.alias("base"), F.array_sort(F.concat("_assign", "_access", "_hex", "_random")).alias("spans"))


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of every document's spans."""
    rows = scanned(docs, fit(samples(docs.sparkSession, docs)))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"), "n_random")
