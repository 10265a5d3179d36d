"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles.

A text is its set of five-word shingles (all its words where it has fewer),
weighted by count times a damped inverse document frequency,

    w = tf * (1 + STRENGTH * ln((1 + N) / (1 + df)) / ln(1 + N)),

where df is counted over all documents in a fixed number of hashed buckets.
``SAMPLES`` consistent weighted samples per text (two texts agree on each with
the probability of their weighted Jaccard similarity) are grouped into bands.
Texts that share a band are candidates:

1. in each band bucket every text is verified against the smallest one;
2. verified links make classes; of a bucket that still holds several, the texts
   outside its largest class are dealt in blocks, and each block meets every
   block of the largest class and of the others.  First only signatures meet,
   which tell the texts that may have a partner in another class; these meet
   again with their shingles in tasks that verify pairs across classes and merge
   classes as they go, so that a task returns no more links than it has texts.

So pairs are never rows, no candidate across classes is left out, and a bucket
of many copies costs one comparison for each and one more for each text that is
none of them.  Verification is by exact weighted Jaccard similarity of the whole
texts.  A text's key is the smallest id among its rows.

Defined results: equal texts are one class; null texts and texts without words
are a class each; ties between representatives go to the smallest document id
(null last), then the first row.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.decontamination import words

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, BANDS = 64, 16
ROWS = SAMPLES // BANDS
#: Entries of the tables from which a shingle's random numbers are drawn, and buckets of document frequencies.
TABLE, DF_BITS = 4096, 18
STRENGTH = 0.25
#: Equal samples below which two signatures can't belong to similar texts: expected 51 of 64 at 0.8, five deviations less.
AGREE = 36
#: Texts of a block; two blocks meet in one task.
BLOCK = 256
#: Tasks over which the texts of a bucket are spread where they meet what is known of it.
SALT = 8
#: Keys that may be broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 2_000_000
CACHE = 200_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            for key in list(self)[CACHE // 2 :]:
                del self[key]
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = common.cache("near_dup", Hashes())


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and how often each occurs."""
    own = words(text)
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    size = min(SHINGLE, len(own))
    out = np.full(len(own) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
            out ^= out >> np.uint64(29)
    return np.unique(common.mix64(out), return_counts=True)


def weights(own: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[(own >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The damped weight of each bucket, from all documents; 2 ** DF_BITS numbers whatever the input."""
    size, block = (1 << DF_BITS) + 8192, 8192

    @common.task("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in common.small_batches(batches, "text", 2_000_000):
            for text in common.text_bytes(batch.column(0)):
                own, _ = shingles(text)
                if len(own):
                    np.add.at(total, (own >> np.uint64(64 - DF_BITS)).astype(np.int64), 1)
                    total[1 << DF_BITS] += 1
        yield common.emit_partial(total, block)

    total = common.add_up(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, common.PARTIAL), "int64", size, block)
    n = max(1, int(total[1 << DF_BITS]))
    df = np.minimum(total[: 1 << DF_BITS], n)
    return (1 + STRENGTH * np.log((1 + n) / (1 + df)) / np.log(1 + n)).astype(np.float64)


class Sampler:
    """Consistent weighted samples; the random numbers of a shingle are fixed by its hash."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20)
        self.rate = rng.gamma(2, 1, (SAMPLES, TABLE)).astype(np.float32)
        self.inverse = (1 / self.rate).astype(np.float32)
        self.cost = np.log(rng.gamma(2, 1, (SAMPLES, TABLE))).astype(np.float32)
        self.shift = rng.random((SAMPLES, TABLE)).astype(np.float32)

    def signatures(self, own: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples x texts; a text is a stretch of ``own`` from one start to the next."""
        i, j, k = ((own >> np.uint64(s) & np.uint64(TABLE - 1)).astype(np.int32) for s in (0, 12, 24))
        log = np.log(weight).astype(np.float32)
        lengths = np.diff(np.append(starts, len(own)))
        out = np.empty((SAMPLES, len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for s in range(SAMPLES):
                rate, shift = self.rate[s].take(i), self.shift[s].take(j)
                step = np.floor(log * self.inverse[s].take(i) + shift)
                a = self.cost[s].take(k) - rate * (step - shift + 1)
                least = np.minimum.reduceat(a, starts)
                at = np.flatnonzero(a == np.repeat(least, lengths))
                at = at[np.searchsorted(at, starts)]
                out[s] = common.mix64(own[at] + step[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return out


_sampler: Sampler | None = None


def sampler() -> Sampler:
    global _sampler
    if _sampler is None:
        _sampler = Sampler()
    return _sampler


def digest(text: str) -> F.Column:
    return F.unhex(F.md5(F.col(text).cast("string")))


def sketched(docs: DataFrame, idf: object) -> DataFrame:
    """Per row: id, document id, digest of the text (null without words), band keys, signature; stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), digest("text").alias("digest"))

    @common.task("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 2_000_000):
            bands: list = [None] * batch.num_rows
            signs: list = [None] * batch.num_rows
            found = [shingles(t) for t in common.text_bytes(batch.column("text"))]
            full = [n for n, (own, _) in enumerate(found) if len(own)]
            at = 0
            while at < len(full):
                group, size = [], 0
                while at < len(full) and (not group or size + len(found[full[at]][0]) <= 40_000):
                    group.append(full[at])
                    size += len(found[full[at]][0])
                    at += 1
                own = np.concatenate([found[n][0] for n in group])
                weight = weights(own, np.concatenate([found[n][1] for n in group]), idf.value)
                lengths = np.array([len(found[n][0]) for n in group])
                signature = sampler().signatures(own, weight, np.cumsum(lengths) - lengths)
                key = np.zeros((BANDS, len(group)), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        key = common.mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[r::ROWS])
                short = np.ascontiguousarray((signature >> np.uint64(32)).astype("<u4").T)
                for c, n in enumerate(group):
                    bands[n], signs[n] = key[:, c].view(np.int64), short[c].tobytes()
            digests = [k if s is not None else None for k, s in zip(batch.column("digest").to_pylist(), signs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())], names=["rid", "doc_id", "digest", "bands", "signature"])

    return common.materialise(rows.mapInArrow(run, "rid bigint, doc_id bigint, digest binary, bands array<bigint>, signature binary"), "sketches")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending hashes, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least) if least else 0.0


def whole_texts(docs: DataFrame, keys: DataFrame, label: str, parts: int) -> DataFrame:
    """(``key``, ``text``) of the distinct ``keys`` (``key``, ``digest``)."""
    wanted = common.materialise(keys, f"{label}-keys", parts=parts)
    own = docs.select(digest("text").alias("digest"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "digest").groupBy("key").agg(F.any_value("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, idf: object, threshold: float, parts: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of text keys whose texts have the similarity, stored."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "digest"), "key")
    own = common.materialise(whole_texts(docs, keys, "star", parts), "star-texts")
    left, right = own.select(F.col("key").alias("a"), F.col("text").alias("text_a")), own.select(F.col("key").alias("b"), F.col("text").alias("text_b"))

    @common.task("near_dup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, tuple] = OrderedDict()
        held = 0

        def opened(key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if key in cache:
                cache.move_to_end(key)
                return cache[key]
            h, counts = shingles((text or "").encode())
            cache[key] = out = h, weights(h, counts, idf.value)
            held += len(h)
            while held > 1_000_000 and len(cache) > 1:
                held -= len(cache.popitem(last=False)[1][0])
            return out

        for whole in batches:
            for batch in common.small_batches(iter([whole]), "text_b", 4_000_000):
                keep = [similarity(opened(a, x), opened(b, y)) >= threshold for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    links = common.materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "star-links")
    common.discard(own)
    return links


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (``band``, ``bucket``, ``key``, ``label``) of mixed buckets by the meetings they take part in.

    Within a bucket the largest class is side 0 and all others side 1, each in
    blocks; meetings are (``i``, ``j``): a block of side 1 with one of side 0
    (``j`` below zero) or with one of side 1.  Rows grow with the texts outside
    the largest class, not with the square of the bucket.
    """
    sizes = members.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("band", "bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("every"))
    many = lambda n: F.ceil(n / BLOCK).cast("int")
    own = of_bucket(members, top.select("band", "bucket", F.col("top.label").alias("most"), many(F.col("top.n")).alias("large"), many(F.col("every") - F.col("top.n")).alias("others")))
    own = own.withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("label") == F.col("most"), F.col("large")).otherwise(F.col("others"))).cast("int"))
    until = lambda n: F.sequence(F.lit(0), n - 1)
    met = F.when(F.col("label") == F.col("most"), F.transform(until(F.col("others")), lambda i: F.struct(i.alias("i"), (-1 - F.col("block")).alias("j"))))
    met = met.otherwise(F.concat(F.transform(until(F.col("large")), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j"))), F.transform(until(F.col("others")), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))))
    own = own.withColumn("side", (F.col("label") != F.col("most")).cast("int"))
    return own.select("band", "bucket", "key", "label", "side", "block", F.explode(met).alias("m")).select("band", "bucket", "m.i", "m.j", "side", "block", "key", "label")


def of_bucket(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (``band``, ``bucket``, ``key``) with what is ``known`` of their buckets; a large bucket is spread over several tasks."""
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)))
    every = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return spread.join(every, ["band", "bucket", "salt"]).drop("salt")


class Meeting:
    """The texts of one meeting: which may be similar to which, by their signatures."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("key")
        self.table = table
        self.keys = table.column("key").to_numpy()
        self.group = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        self.signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, SAMPLES)
        # texts of the same part of a meeting meet elsewhere, unless it is one block with itself
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        self.part = None if i == j else table.column("side").to_numpy() if j < 0 else table.column("block").to_numpy()
        self.band = table.column("band")[0].as_py()

    def partners(self, k: int) -> np.ndarray:
        """Texts behind ``k`` of other classes whose signatures agree enough and that share no earlier band."""
        rest = np.arange(k + 1, len(self.keys))
        rest = rest[self.group[rest] != self.group[k]]
        if self.part is not None:
            rest = rest[self.part[rest] != self.part[k]]
        if not len(rest):
            return rest
        same = self.signs[rest] == self.signs[k]
        enough = same.sum(axis=1) >= AGREE
        rest, same = rest[enough], same[enough]
        shared = same.reshape(len(rest), BANDS, ROWS).all(axis=2)
        return rest[shared.argmax(axis=1) == self.band] if len(rest) else rest


MEMBER = "band int, bucket bigint, i int, j int, side int, block int, key bigint, label bigint, signature binary"


def links_across(members: DataFrame, texts: DataFrame, docs: DataFrame, idf: object, threshold: float, parts: int) -> DataFrame:
    """Links between the classes that meet in a bucket, enough to merge them; stored.  A pair counts in the first band it shares."""

    @common.group("near_dup")
    def sift(table: pa.Table) -> pa.Table:
        met = Meeting(table)
        keep = np.zeros(len(met.keys), bool)
        for k in range(len(met.keys)):
            found = met.partners(k)
            keep[found] = True
            keep[k] |= len(found) > 0
        return met.table.filter(pa.array(keep))

    rows = dealt(members).join(texts.select("key", "signature"), "key").select(*[x.split(" ")[0] for x in MEMBER.split(", ")])
    rows = common.materialise(rows.groupBy("band", "bucket", "i", "j").applyInArrow(sift, MEMBER), "across-members")
    keys = rows.select("key").distinct().join(texts.select("key", "digest"), "key")

    @common.task("near_dup")
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", 2_000_000):
            found = [shingles(t) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())], names=["key", "h", "times"])

    opened = common.materialise(whole_texts(docs, keys, "across", parts).mapInArrow(sets, "key bigint, h binary, times binary"), "across-sets")

    @common.group("near_dup")
    def link(table: pa.Table) -> pa.Table:
        met = Meeting(table)
        group, held = met.group, {}

        def full(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in held:
                h = np.frombuffer(met.table.column("h")[k].as_py(), np.uint64)
                held[k] = h, weights(h, np.frombuffer(met.table.column("times")[k].as_py(), np.uint32).astype(np.int64), idf.value)
            return held[k]

        a, b = [], []
        for k in range(len(met.keys)):
            for m in met.partners(k).tolist():
                if group[m] != group[k] and similarity(full(k), full(m)) >= threshold:
                    a.append(met.keys[k])
                    b.append(met.keys[m])
                    group[group == group[m]] = group[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = common.materialise(rows.join(opened, "key").groupBy("band", "bucket", "i", "j").applyInArrow(link, "a bigint, b bigint"), "across-links")
    for table in (rows, opened):
        common.discard(table)
    return links


def components(links: DataFrame) -> DataFrame:
    """(``key``, ``label``) of every key in ``links`` (``a``, ``b``): the smallest key it is connected with.

    Each round takes the smallest label around and then the label of the label, so that chains halve.
    """
    parts = common.files_for(2 * links.count(), 24)
    both = common.materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges", parts=parts)
    labels = common.materialise(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("label")), "labels", parts=parts)
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        pulled = common.materialise(labels.join(near, "key").select("key", "label", F.least("label", "near").alias("new")), "labels", parts=parts)
        jumped = pulled.join(pulled.select(F.col("key").alias("new"), F.col("new").alias("above")), "new", "left")
        jumped = common.materialise(jumped.select("key", F.least("new", "above").alias("label"), (F.least("new", "above") != F.col("label")).alias("moved")), "labels", parts=parts)
        common.discard(pulled)
        common.discard(labels)
        labels = jumped.select("key", "label")
        if jumped.filter("moved").isEmpty():
            common.discard(both)
            return labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``rid``, ``doc_id``, ``class`` (key of its class, null without words); stored."""
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))  # 2 ** DF_BITS numbers
    rows = sketched(docs, idf)
    n = rows.count()
    parts, wide = common.files_for(n, 32), common.files_for(n, BANDS * 32)  # rows by text, and by text and band
    first = common.materialise(rows.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("key")), "first", parts=parts)
    texts = common.materialise(rows.join(first.select(F.col("key").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "key").drop("doc_id"), "texts", parts=wide)
    named = common.materialise(rows.select("rid", "doc_id", "digest").join(first, "digest", "left").select("rid", "doc_id", "key"), "named", parts=parts)
    common.discard(rows)
    common.discard(first)
    buckets = texts.select("key", F.posexplode("bands").alias("band", "bucket"))
    stars = buckets.groupBy("band", "bucket").agg(F.min("key").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = common.materialise(stars, "stars", parts=wide)
    pairs = of_bucket(buckets, stars).filter("key != a").select("a", F.col("key").alias("b")).distinct()
    pairs = common.materialise(pairs, "pairs", parts=wide)
    links = verified(pairs, texts, docs, idf, threshold, parts)
    labels = components(links)
    # what is left: buckets with members of several classes
    members = of_bucket(buckets, stars.select("band", "bucket")).join(labels, "key", "left").select("band", "bucket", "key", F.coalesce("label", "key").alias("label"))
    members = common.materialise(members, "members", parts=wide)
    mixed = members.groupBy("band", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band", "bucket")
    mixed = common.materialise(mixed, "mixed", parts=wide)
    if not mixed.isEmpty():
        more = links_across(of_bucket(members, mixed), texts, docs, idf, threshold, parts)
        common.discard(labels)
        labels = components(links.union(more))
    for table in (texts, stars, pairs, members, mixed):
        common.discard(table)
    idf.unpersist()
    out = common.materialise(named.join(labels, "key", "left").select("rid", "doc_id", F.coalesce("label", "key").alias("class")), "classes", parts=parts)
    for table in (named, labels):
        common.discard(table)
    return out


def firsts(rows: DataFrame) -> DataFrame:
    """Of every class its first row and its size."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    return common.materialise(rows.filter("class is not null").groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("n")), "firsts", parts=common.files_for(rows.count(), 40))


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, ``class_id`` (smallest document id of its class), ``class_size``, ``kept`` (the class's first row)."""
    rows = classes(docs, threshold)
    joined = rows.join(firsts(rows), "class", "left")
    return joined.select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("class_size"), F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class; rows without words and all columns stay."""
    own, row = common.P + "rid", common.P + "row"
    stored = common.with_row_id(docs, "copies")
    rows = classes(stored.select(F.col(own).alias("doc_id"), F.col(f"{row}.text").alias("text")), threshold)
    parts = common.files_for(rows.count(), 32)
    # the row id stands in for the document id; the first row of a class is chosen by the documents' own ids
    ids = stored.select(F.col(own).alias("own"), F.col(f"{row}.doc_id").cast("bigint").alias("doc_id"))
    both = rows.select(F.col("doc_id").alias("own"), "class").join(ids, "own").select("doc_id", F.col("own").alias("rid"), "class")
    both = common.materialise(both, "members", parts=parts)
    gone = both.join(firsts(both), "class").filter("first.rid != rid").select(F.col("rid").alias(own))
    return stored.join(common.materialise(gone, "gone", parts=parts), own, "left_anti").select(f"{row}.*")
