"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network in numpy.

Every token has a fixed sparse ternary index vector.  A word's vector is the sum
of the index vectors of its neighbours (two on each side) over the whole
corpus, scaled, plus its own index vector.  Words share a fixed number of hashed
buckets, so the table has one size at any input.  A document is the mean and
the deviation of its words' vectors.  The network is fitted on a bounded sample
of labelled documents (``SAMPLE``), of both labels as evenly as there are rows,
chosen by the smallest hashes of their ids; one temperature, chosen on a part
of the sample kept aside, calibrates its probabilities.

Defined results: null and empty texts pool to zeros and are scored like any
other; without labelled rows of both kinds every score is the share of label 1
(0.5 without any); labels that are null are left out; a repeated row of labels
counts once; repeated documents are scored each and one of them is learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

BUCKETS, DIM, ENTRIES, SPAN = 1 << 15, 32, 4, 2
#: Labelled documents for the fit at most.
SAMPLE = 30_000
HIDDEN, EPOCHS, RATE = 32, 25, 3e-3
#: Blocks in which partial sums travel, in values.
BLOCK = 1 << 15
#: Bucket 0 separates documents; all-capital words and numbers share one each.
GAP, CAPITALS, NUMBER, FIRST = 0, 1, 2, 8
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]")
CACHE = 200_000


class Buckets(dict):
    """Token to bucket, remembered."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > CACHE:
            for key in list(self)[CACHE // 2 :]:
                del self[key]
        if len(token) > 1 and token.isupper():
            out = CAPITALS
        elif token.isdigit():
            out = NUMBER
        else:
            out = FIRST + xxhash.xxh32_intdigest(token.lower()) % (BUCKETS - FIRST)
        self[token] = out
        return out


_buckets = common.cache("quality", Buckets())


def tokens(text: bytes) -> np.ndarray:
    found = TOKEN.findall(text)
    return np.fromiter(map(_buckets.__getitem__, found), np.int64, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    with np.errstate(over="ignore"):
        seed = common.mix64(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)).reshape(BUCKETS, ENTRIES)
    places = (seed % np.uint64(DIM)).astype(np.int64)
    signs = np.where(seed >> np.uint64(63), 1.0, -1.0)
    signs[GAP] = 0
    return places, signs


def index_table() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((BUCKETS, DIM))
    for j in range(ENTRIES):
        np.add.at(out, (np.arange(BUCKETS), places[:, j]), signs[:, j])
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors (``BUCKETS`` x ``DIM``), from the contexts of all words of all ``docs``."""

    @common.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM)
        gap = np.full(SPAN, GAP, np.int64)
        for batch in common.small_batches(batches, "text", 4_000_000):
            parts = [gap]
            for text in common.text_bytes(batch.column(0)):
                parts += [tokens(text), gap]
            ids = np.concatenate(parts)
            for offset in range(1, SPAN + 1):
                for own, other in ((ids[:-offset], ids[offset:]), (ids[offset:], ids[:-offset])):
                    for j in range(ENTRIES):
                        total += np.bincount(own * DIM + places[other, j], weights=signs[other, j], minlength=BUCKETS * DIM)
        total[:DIM] = 0
        yield common.emit_partial(total.astype(np.float32), BLOCK)

    partials = docs.select(F.col("text").cast("string")).mapInArrow(run, common.PARTIAL)
    context = common.add_up(partials, "float32", BUCKETS * DIM, BLOCK).reshape(BUCKETS, DIM)
    norm = np.sqrt((context * context).sum(axis=1, keepdims=True))
    vectors = context / np.maximum(norm, 1) + index_table() / np.sqrt(ENTRIES)
    vectors[GAP] = 0
    return vectors.astype(np.float32)


def pool(vectors: np.ndarray, squares: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Mean and deviation of the vectors of a document's words."""
    if not len(ids):
        return np.zeros(2 * DIM, np.float32)
    kinds, counts = np.unique(ids, return_counts=True) if len(ids) > 64 else (ids, np.ones(len(ids), np.int64))
    share = (counts / len(ids)).astype(np.float32)
    mean, square = share @ vectors[kinds], share @ squares[kinds]
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id`` and the pooled vector of each document, stored."""
    held = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM float32: 4 MB

    @common.task("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        squares = own * own
        for batch in common.small_batches(batches, "text"):
            out = [pool(own, squares, tokens(t)).tobytes() for t in common.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "x"])

    return common.materialise(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, x binary"), "pooled")


class Network:
    """Input scaling, a hidden layer of rectified units, one logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.heat, self.constant = 1.0, None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        aside = np.arange(len(y)) % 5 == 0
        self.params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.fit((x[~aside] - self.shift) / self.scale, y[~aside].astype(float), rng)
        logit = self.logit(x[aside])
        self.heat = common.temperature(np.stack([np.zeros(len(logit)), logit], axis=1), y[aside].astype(int))

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 256):
                own = order[at : at + 256]
                w1, b1, w2, b2 = self.params
                hidden = np.maximum(x[own] @ w1 + b1, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
                g = (p - y[own]) / len(own)
                back = np.outer(g, w2) * (hidden > 0)
                grads = [x[own].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ g + 1e-4 * w2, np.array([g.sum()])]
                step += 1
                for k, (param, grad) in enumerate(zip(self.params, grads, strict=True)):
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -50, 50)))


def train(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on the labelled rows of ``labels`` (``doc_id``, ``quality``), at most ``sample`` of them."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    own = own.withColumn("h", F.expr("xxhash64(doc_id, 'sample')"))
    wanted = common.materialise(own.join(common.stratified(own, "quality", "h", sample), ["quality", "h"], "left_semi").select("doc_id", "quality").distinct(), "sample", parts=common.files_for(sample, 32))
    rows = features.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "x", "quality").toArrow()  # ``sample`` rows
    data = sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "x", "quality")), strict=True))
    x = np.array([np.frombuffer(r[1], np.float32) for r in data]).reshape(len(data), 2 * DIM)
    return Network(x.astype(float), np.array([r[2] for r in data], int))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``; labels are learnt from the rows not held out."""
    features = pooled(docs, word_vectors(docs))
    network = docs.sparkSession.sparkContext.broadcast(train(features, labels.filter(common.crc_mod("doc_id", 3) != 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIM)
            p = network.value.score(x.astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return features.withColumn("held_out", common.crc_mod("doc_id", 3) == 1).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
