"""Language identification by nearest centroid.

A text's vector holds TF-IDF weights of its letter n-grams (one to three letters, words padded by a
blank), hashed into ``DIMENSIONS`` columns, with logarithmic counts, and is normalised. Each
language has up to ``CENTROIDS`` centroids, found by spherical k-means over a bounded sample of its
labelled texts. A text gets the language of the centroid with the largest cosine.

It is rejected by its distance: if that cosine is below the language's bound for a text of as many
letters. Short texts are farther from all centroids, so bounds are a curve: the sample's texts are read
up to 1, 2, 4, 8, ... letters, and SLACK times the QUANTILE of the cosines at each length are the points
of the curve of a nearest language; between them it runs straight over the logarithm of the length.

Bounds of the fit: at most ``SAMPLE`` rows of a language, those with the smallest hashes, and
``SAMPLE_TOTAL`` in all; what reaches the driver is their vectors (at most DIMENSIONS numbers each) and
a table of bounds. Prediction reads whole texts in pieces of ``PIECE`` characters, so that memory
doesn't follow a text's length.

Null texts and texts without a letter get ``und`` and score 0, and are rejected. If nothing is
labelled, every text gets ``und``. Null languages are never learned. Of centroids at the same cosine
the first language by name counts. Every row is predicted by itself, so repeated rows get the same
values; an empty table gives no rows; columns besides those named are carried along or not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import ROW, located, short_batches, stored

DIMENSIONS = 1 << 14
CENTROIDS = 4
#: Rows of a language and of all languages that a model is fitted on at most.
SAMPLE, SAMPLE_TOTAL = 500, 20_000
PIECE = 1 << 20
#: The bound of rejection: this part of this quantile of the sample's cosines.
SLACK, QUANTILE = 0.5, 0.02
#: The powers of two at which the curve of bounds has points.
LENGTHS = 16
#: A cluster with a smaller share of a language's sample is dealt out to the others.
LEAST_SHARE = 0.03
SEED = 17


@functools.cache
def folded() -> np.ndarray:
    """Each code point's lower-case letter, or a blank if it isn't a letter."""
    out = np.full(sys.maxunicode + 1, 0x20, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts_of(text: str) -> tuple[np.ndarray, int]:
    """The n-gram counts of a whole text and its number of letters."""
    out, letters = np.zeros(DIMENSIONS), 0
    tail = np.array([0x20, 0x20], np.uint32)
    for begin in range(0, len(text), PIECE):
        points = folded()[np.frombuffer(text[begin : begin + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters += int(np.count_nonzero(points != 0x20))
        c = np.concatenate([tail, points, [0x20] if begin + PIECE >= len(text) else []]).astype(np.uint32)
        tail = c[-2:]
        here = c[2:] * np.uint32(0x9E3779B1)
        prev = c[1:-1] * np.uint32(0x85EBCA6B)
        word = c[2:] != 0x20
        two = here ^ (prev + np.uint32(0x165667B1))
        three = two ^ (c[:-2] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
        inner = word | (c[1:-1] != 0x20)
        for grams, used in ((here, word), (two, inner), (three, inner)):
            slot = (grams[used] * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)
            out += np.bincount(slot, minlength=DIMENSIONS)
    return out, letters


def weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMENSIONS)
    owner: np.ndarray  # of each centroid: which language
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, LENGTHS)))  # (languages, LENGTHS)

    def nearest(self, text: str | None) -> tuple[int, float, int]:
        """The nearest centroid, the cosine with it and the number of letters; -1 without any."""
        counts, letters = counts_of(text) if text else (None, 0)
        if not letters or not self.languages:
            return -1, 0.0, letters
        cosine = self.centroids @ weights(counts, self.idf)
        best = int(np.argmax(cosine))
        return best, float(min(1.0, max(0.0, cosine[best]))), letters

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        best, score, letters = self.nearest(text)
        if best < 0:
            return "und", 0.0, True
        language = self.owner[best]
        bound = np.interp(np.log2(letters), np.arange(LENGTHS), self.bounds[language])
        return self.languages[language], score, bool(score < bound)


def k_means(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine. Starts are drawn (seeded) by distance from those drawn before;
    clusters of a few outliers are dissolved, so a centroid stands for a part of the mass."""
    rng = np.random.default_rng(SEED)
    centres = [int(np.argmax(vectors @ vectors.mean(0)))]
    while len(centres) < min(k, len(vectors)):
        away = np.maximum(0.0, 1 - np.max(vectors @ vectors[centres].T, axis=1)).astype(float) ** 2
        if not away.sum():
            break
        centres.append(int(rng.choice(len(vectors), p=away / away.sum())))
    out = vectors[centres]
    for turn in range(rounds):
        own = np.argmax(vectors @ out.T, axis=1)
        sizes = np.bincount(own, minlength=len(out))
        kept = np.flatnonzero(sizes >= max(1, LEAST_SHARE * len(vectors) if turn >= rounds // 2 else 1))
        out = np.array([vectors[own == i].mean(0) for i in (kept if len(kept) else [int(np.argmax(sizes))])])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def sampled(labelled: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """(lang, text) of the rows that a model is fitted on."""
    rows = located(labelled).select(*ROW, F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    # about twice the sample of each language by its hash, so that a frequent one isn't ranked as a whole
    counts = stored(rows.groupBy(F.col("lang").alias("_l")).agg(F.count(F.lit(1)).alias("_c")), "langid-counts")
    place = F.pmod(F.xxhash64(F.col("key").cast("string"), ROW[1], F.lit(SEED)), F.lit(1 << 31))
    some = rows.select(*ROW, "lang", place.alias("_p")).join(counts, F.col("lang") == F.col("_l")).where(F.col("_p") * F.col("_c") < (2 * SAMPLE + 50) * float(1 << 31))
    order = Window.partitionBy("lang").orderBy("_p", *ROW)
    ranked = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE)
    chosen = ranked.orderBy("_n", "lang", *ROW).limit(SAMPLE_TOTAL).select(*ROW)
    return stored(rows.join(F.broadcast(chosen), ROW, "left_semi").select("lang", "text"), "langid-sample")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from a bounded sample of labelled rows."""
    short_batches(labelled.sparkSession)
    sample = sampled(labelled, text, lang, key)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, letters = counts_of(batch.column(1)[i].as_py())
                at = np.flatnonzero(counts)
                if letters:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at].astype(np.float32)], pa.list_(pa.float32()))], names=["lang", "at", "n"])

    found = sample.mapInArrow(vectors, "lang string, at array<int>, n array<float>").toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    seen = np.zeros(DIMENSIONS)
    groups: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {x: [] for x in names}
    for name, at, n in zip(found.column("lang").to_pylist(), found.column("at"), found.column("n"), strict=True):
        at = at.values.to_numpy()
        seen[at] += 1
        groups[name].append((at, n.values.to_numpy().astype(float)))
    idf = np.log((1 + found.num_rows) / (1 + seen)) + 1
    centroids, owner = [], []
    for k, name in enumerate(names):
        rows_of = np.zeros((len(groups[name]), DIMENSIONS), np.float32)
        # rows come in any order; the fit mustn't depend on it
        for i, (at, n) in enumerate(sorted(groups[name], key=lambda x: (x[0].tobytes(), x[1].tobytes()))):
            v = np.log1p(n) * idf[at]
            rows_of[i, at] = v / np.linalg.norm(v)
        own = k_means(rows_of, CENTROIDS)
        centroids.append(own)
        owner += [k] * len(own)
    model = Model(names, idf, np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32), np.array(owner, int))
    model.bounds = curves(sample, model)
    return model


def curves(sample: DataFrame, model: Model) -> np.ndarray:
    """Each language's bound at each power of two of letters; where it has no text, that of all."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                ends = np.cumsum(folded()[np.frombuffer(text[:PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)] != 0x20)
                for k in range(LENGTHS):
                    at = int(np.searchsorted(ends, 1 << k)) + 1
                    if at > len(ends):
                        break
                    best, score, _ = shared.value.nearest(text[:at])
                    out.append((int(shared.value.owner[best]), k, score))
            yield pa.RecordBatch.from_pydict({"c": pa.array([x[0] for x in out], pa.int32()), "k": pa.array([x[1] for x in out], pa.int32()), "s": pa.array([x[2] for x in out], pa.float64())})

    told = sample.mapInArrow(cosines, "c int, k int, s double")
    low = F.percentile("s", QUANTILE).alias("s")
    rows = told.groupBy("c", "k").agg(low).collect()
    every = {r.k: r.s for r in told.groupBy("k").agg(low).collect()}
    out = np.full((len(model.languages), LENGTHS), np.nan)
    for k, s in every.items():
        out[:, k] = s
    for r in rows:
        out[r.c, r.k] = r.s
    for k in range(LENGTHS):  # past the longest text, the curve runs on level
        missing = np.isnan(out[:, k])
        out[missing, k] = out[missing, k - 1] if k else 0.0
    return SLACK * out


def predict(docs: DataFrame, model: Model, keep: list[str] | tuple[str, ...], text: str = "text") -> DataFrame:
    """docs' columns ``keep`` with lang_pred, score and rejected."""
    short_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [m.predict(texts[i].as_py()) for i in range(batch.num_rows)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document, by a model that hasn't seen
    the held-out third."""
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
