"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a learned lexicon (words, and beginnings of words, that are far more
frequent in toxic texts than in others), how near its words stand to a second-person pronoun, and
rates of capitals, punctuation, repeated letters and obfuscated words (symbols or digits within
letters, read back as letters before they are looked up). Whole texts are read.

Bounds of the fit: at most SAMPLE labelled rows, those with the smallest hashes; of them, the lexicon
and a row of features each reach the driver. The lexicon and the trees learn from four fifths of the
sample, and the calibration from the rest. An entry is in the lexicon if the lower end of its log-odds'
interval is high enough, however rare or frequent it is.

Null and empty texts have all features 0 and are scored like others. Rows without a label are
never learned from; of several labels of one key the highest counts, and each row of a labelled key is
an example of its own. If no label is known, or only one kind, every score is 0. Repeated rows get equal
scores, an empty table gives no rows, and columns besides those named are carried along or not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.llm.common import ROW, located, short_batches, stored
from tessera.llm.langid import fold

#: Labelled rows that a model is fitted on at most.
SAMPLE = 16_000
#: An entry's log-odds are at least so high, by so many standard errors less.
LEAST_ODDS, ERRORS = 1.5, 1.5
#: Lengths of beginnings of words.
STEMS = (4, 5, 6)
#: A lexicon word is near a pronoun if so many words lie between them at most.
NEAR = 4
CACHE_WORDS = 400_000
# Second-person pronouns.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros vuestro".split())
# Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"})
EDGES = ".,;:!?\"'()[]{}<>*#&%$/\\|~_-+=`…«»“”‘’"
NAMES = ("word_density", "stem_density", "odds_density", "odds_most", "hits", "kinds", "near_share", "near_density", "second_person", "obfuscated_hits", "obfuscated", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits", "repeats", "words")


def plain(word: str) -> tuple[str, bool]:
    """A lower-case word without what surrounds it, read back from obfuscation; whether it was obfuscated."""
    core = word.strip(EDGES)
    if core.isalpha() or not core:
        return core, False
    letters = sum(map(str.isalpha, core))
    if not letters or core.isdigit():
        return core, False
    read = "".join(filter(str.isalpha, core.translate(LOOKALIKES)))
    return read, True


def entries(word: str) -> list[str]:
    """What a plain word is looked up by: itself, and its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@dataclass
class Lexicon:
    odds: dict[str, float]
    known: dict[str, tuple[float, float, bool, bool]] = field(default_factory=dict)

    def look(self, word: str) -> tuple[float, float, bool, bool]:
        """A word's log-odds as a whole and by its beginnings, whether it was obfuscated, and whether it
        is a pronoun of the second person."""
        core, hidden = plain(word)
        if not core:
            return 0.0, 0.0, False, False
        whole = self.odds.get(core, 0.0)
        stem = max((self.odds.get(e, 0.0) for e in entries(core)[1:]), default=0.0)
        return whole, stem, hidden, core in SECOND_PERSON

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(NAMES)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = text.lower().split()
        n, known, look = max(1, len(words)), self.known, self.look
        by_word = by_stem = odds = most = hidden = hidden_hits = second = hits = 0.0
        kinds = set()
        for word, count in Counter(words).items():
            told = known.get(word)
            if told is None:
                told = known[word] = look(word)
            whole, stem, is_hidden, pronoun = told
            if pronoun:
                second += count
            if is_hidden:
                hidden += count
            if whole or stem:
                best = max(whole, stem)
                hits += count
                by_word += count * (whole > 0)
                by_stem += count * (stem > 0)
                odds += count * best
                most = max(most, best)
                kinds.add(word)
                hidden_hits += count * is_hidden
        near = 0
        if kinds and second:
            you = [i for i, w in enumerate(words) if known[w][3]]
            at = np.array([i for i, w in enumerate(words) if w in kinds])
            place = np.searchsorted(you, at)
            you = np.array([-(1 << 40), *you, 1 << 40])
            near = int(np.count_nonzero(np.minimum(at - you[place], you[place + 1] - at) <= NEAR + 1))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        seen = np.bincount(raw, minlength=256)
        chars = max(1, len(text))
        capitals = int(seen[65:91].sum())
        letters = max(1, capitals + int(seen[97:123].sum()))
        marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
        repeats = int(np.count_nonzero((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]))) if len(raw) > 2 else 0
        shouted = 1.0 if capitals > 0.8 * letters else 0.0
        return [by_word / n, by_stem / n, odds / n, most, math.log1p(hits), math.log1p(len(kinds)), near / max(1.0, hits), near / n, second / n, math.log1p(hidden_hits), hidden / n, capitals / letters, shouted, int(seen[33]) / chars, int(seen[63]) / chars, marks / chars, int(seen[48:58].sum()) / chars, repeats / chars, math.log1p(len(words))]


@dataclass
class Trees:
    """Boosted trees of a fixed depth, on binned features, for the logistic loss."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(int(math.log2(leaf.size))):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 32, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    # quantiles of a rare feature are all zero: its values above get bins of their own
    edges = [np.unique(np.r_[e, np.quantile(v[v > 0], np.linspace(0, 1, 9)[:-1]) * 0.999]) if (v := x[:, k])[v > 0].size else e for k, e in enumerate(edges)]
    b, most = binned(x, edges), max(len(e) for e in edges) + 1
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    out = Trees(edges, math.log(share / (1 - share)), np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), most), np.zeros((trees, 2**depth)))
    score = np.full(len(y), out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            local = node - first
            best = np.full(width, 1e-9)
            for k in range(x.shape[1]):
                slot = local * most + b[:, k]
                g = np.bincount(slot, grad, width * most).reshape(width, most)
                h = np.bincount(slot, hess, width * most).reshape(width, most)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least / 10) | (ht - hl < least / 10)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                out.feature[t, first : first + width][better] = k
                out.cut[t, first : first + width][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), out.feature[t][node]] > out.cut[t][node])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, grad, 2**depth), np.bincount(leaf, hess, 2**depth)
        out.leaf[t] = rate * g / (h + ridge)
        score += out.leaf[t][leaf]
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function from raw scores to shares with the least squared error, by pooling adjacent
    violators: each pool's value is its mean."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, least raw score, largest raw score
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, r, r])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    knots, values = [], []
    for s, n, lo, hi in blocks:
        knots += [lo, hi] if hi > lo else [lo]
        values += [s / n] * (2 if hi > lo else 1)
    return np.array(knots), np.array(values)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(features))
        return np.interp(self.trees.raw(features), self.knots, self.values)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows; docs and labels hold only what may be learned from."""
    short_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = located(docs).select(*ROW, F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = rows.select(*ROW, "_key").join(marked, "_key").orderBy(F.xxhash64("_key", ROW[1], F.lit(11)), *ROW).limit(SAMPLE)
    chosen = chosen.select(*ROW, "y", (F.pmod(F.xxhash64("_key", F.lit(12)), F.lit(5)) == 0).alias("held"))
    sample = stored(rows.join(F.broadcast(chosen), ROW).select("text", "y", "held"), "toxicity-sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: Counter[str] = Counter()
            clean: Counter[str] = Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update({e for w in set(t.lower().split()) for e in entries(plain(w)[0]) if len(e) > 2})
            names = [*toxic, *(w for w in clean if w not in toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([clean[w] for w in names], pa.int64())], names=["entry", "toxic", "clean"])

    learned = sample.where("not held")
    sizes = {r.y: r.n for r in learned.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model(Lexicon({}), None, np.zeros(0), np.zeros(0))
    counts = learned.select("text", "y").mapInArrow(words, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0")
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    lexicon = Lexicon({r.entry: r.odds for r in counts.select("entry", odds.alias("odds"), error.alias("error")).where(F.col("odds") - ERRORS * F.col("error") >= LEAST_ODDS).select("entry", "odds").orderBy("entry").collect()})

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.odds)
        for batch in batches:
            found = [own.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "y", "held"])

    data = sample.mapInArrow(featured, "x array<double>, y int, held boolean").toArrow()
    x = np.array(data.column("x").to_pylist()).reshape(-1, len(NAMES))
    y, held = data.column("y").to_numpy().astype(float), data.column("held").to_numpy()
    order = np.lexsort((*x.T, y, held))  # rows come in any order; the fit mustn't depend on it
    x, y, held = x[order], y[order], held[order]
    trees = boost(x[~held], y[~held])
    check = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)  # a small sample's fifth may lack a kind
    return Model(lexicon, trees, *isotonic(trees.raw(x[check]), y[check]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] | list[str], text: str = "text") -> DataFrame:
    """docs' columns ``keep`` with score and predicted."""
    short_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema[c] for c in keep]).add("score", "double").add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.array([m.lexicon.features(t.as_py()) for t in texts]).reshape(-1, len(NAMES))
            score = m.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model that hasn't seen the
    held-out fifth."""
    learn = fold("doc_id", 5) != 0
    model = fit(docs.where(learn), labels.where(learn))
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
