"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3 code points of the lower-cased letters, other runs as
one space) are hashed into a fixed number of buckets.  Document frequencies
cover all training documents; the regression is fitted by
follow-the-regularised-leader with an elastic-net penalty (L1 and L2) on a
bounded sample of labelled documents (``SAMPLE``), and its probabilities are
calibrated by one temperature on a part of the sample kept aside.  The sample
holds every language that any training document has: even quotas, in each the
different texts of the smallest hashes, so a rare language is learnt like a
common one and copies of a text count once.  The model's size is that of the
buckets times the languages.

Defined results: null texts and texts without a letter give ``und`` with score
0; with no labelled training document every text gives ``und``; ties between
languages go to the first in order of name; repeated documents each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: log2 of the n-gram buckets.
BITS = 15
BUCKETS = 1 << BITS
#: Labelled documents for the fit at most; statistics cover all of them.
SAMPLE = 8_000
#: Step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
EPOCHS = 3
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _letters


def grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, with repeats; empty where it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    before = np.concatenate([[False], letter[:-1]])
    points = np.where(letter, points, np.uint32(32))[letter | before]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    one = points[1:-1] * np.uint32(0x9E3779B1)
    two = (points[:-1] * np.uint32(0x85EBCA77) + points[1:]) * np.uint32(0xC2B2AE3D) + np.uint32(1)
    three = ((points[:-2] * np.uint32(0x27D4EB2F) + points[1:-1]) * np.uint32(0x165667B1) + points[2:]) * np.uint32(0x9E3779B1) + np.uint32(2)
    every = np.concatenate([one, two, three])
    return ((every ^ (every >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    own = grams(text) if text else np.empty(0, np.int64)
    if not len(own):
        return own, own
    counts = np.bincount(own, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class Model:
    """Weights, document frequencies and temperature; its size depends on the buckets and languages only."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.heat = languages, idf, 1.0
        self.weights = np.zeros((BUCKETS, len(languages)), np.float32)

    def values(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.values(at, counts) @ self.weights[at]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> None:
        """Follow the regularised leader over ``rows`` (buckets, counts, class), in a fixed shuffled order."""
        kinds = len(self.languages)
        z, n = np.zeros((BUCKETS, kinds)), np.zeros((BUCKETS, kinds))
        rng = np.random.default_rng(7)

        def weights(at: np.ndarray | slice) -> np.ndarray:
            held = np.maximum(np.abs(z[at]) - L1, 0) * np.sign(z[at])
            return -held / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, counts, kind = rows[k]
                if not len(at):
                    continue
                x, w = self.values(at, counts), weights(at)
                s = x @ w * 4
                p = np.exp(s - s.max())
                p /= p.sum()
                p[kind] -= 1
                g = x[:, None] * (p * 4)
                new = n[at] + g * g
                z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
                n[at] = new
        self.weights = (weights(slice(None)) * 4).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            at, counts = counted(text)
            if not len(at) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            s = self.logits(at, counts) / self.heat
            p = np.exp(s - s.max())
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each bucket occurs, and the number of documents with a letter, over all of ``docs``."""

    @common.task("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 4096, np.int64)
        for batch in common.small_batches(batches, "text"):
            for text in batch.column(0).to_pylist():
                at, _ = counted(text)
                total[at] += 1
                total[BUCKETS] += len(at) > 0
        yield common.emit_partial(total, 4096)

    out = common.add_up(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, common.PARTIAL), "int64", BUCKETS + 4096, 4096)
    return out[:BUCKETS], int(out[BUCKETS])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs`` (``text``, ``lang``): all of them for the statistics, a sample of labelled ones for the weights."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = docs.filter("lang is not null").withColumn("h", F.expr("xxhash64(text, lang, 'sample')"))
    frequency, n = document_frequencies(docs)
    wanted = common.materialise(common.stratified(labelled, "lang", "h", sample), "sample", parts=common.files_for(sample, 32))

    @common.task("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text"):
            found = [counted(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()), pa.array([np.minimum(c, 65535).astype(np.uint16).tobytes() for _, c in found], pa.binary()), batch.column("lang")], names=["at", "counts", "lang"])

    texts = labelled.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))  # ``sample`` rows at most
    chosen = texts.select("text", "lang").mapInArrow(run, "at binary, counts binary, lang string").toArrow()
    rows = sorted(zip(*(chosen.column(c).to_pylist() for c in ("at", "counts", "lang")), strict=True))
    languages = sorted({r[2] for r in rows})
    model = Model(languages, np.log((1 + n) / (1 + frequency)) + 1)
    data = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(c, np.uint16).astype(np.int64), languages.index(lang)) for a, c, lang in rows]
    seen: dict[int, int] = {}
    nth = [seen.update({kind: seen.get(kind, -1) + 1}) or seen[kind] for *_, kind in data]
    aside = [r for r, k in zip(data, nth, strict=True) if k % 5 == 4 and len(r[0])]  # of each language every fifth, so that a rare one is learnt first
    model.fit([r for r, k in zip(data, nth, strict=True) if k % 5 != 4])
    if aside and languages:
        model.heat = common.temperature(np.array([model.logits(a, c) for a, c, _ in aside]), np.array([k for *_, k in aside]))
    return model


def annotate(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability; the other columns pass through."""
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: a fixed size
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])

    @common.task("language")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, at):
            names, scores = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, name, score])

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(common.crc_mod("doc_id", 3) != 1).select("text", "lang")


def identify(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``; learnt from the rows not held out."""
    model = train(training_rows(docs))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), (common.crc_mod("doc_id", 3) == 1).alias("held_out"))
    return annotate(rows, model).drop("text")


def drop_unidentified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows of no language, or of one less likely than ``least``; all columns stay."""
    name, score = common.P + "lang", common.P + "score"
    kept = annotate(docs, train(training_rows(docs)), name, score).filter((F.col(name) != UNKNOWN) & (F.col(score) >= least))
    return kept.drop(name, score)
