"""Language-model scoring with Brown class-based n-grams.

Words are counted exactly over all training texts.  Classes are seeded on the
most frequent ones, each a symbol of its own, with the others in one symbol for
each power of two of their count; exchange clustering moves symbols between
classes as long as the class bigram likelihood of the corpus grows.  Then every
word that was seen moves: passes over all training tokens count its neighbours'
classes, and it goes to the class under which the likelihood is best while the
others stay.  A pass that does not raise the likelihood is undone.  A text's
probability is the product of smoothed class transitions and word emissions; an
end token closes each text and is the context of its first word.

The corpus is cut into chunks of whole documents, stored with chunk-local word
numbers in order of a hash.  Ranges of the hash are parts: a chunk's distinct
words travel to their parts, where they are summed to corpus counts, and counts
and classes travel back, packed, in the order of the chunk's words.  No task
holds the corpus vocabulary and nothing of its size is broadcast.  What comes to
the driver are bigram matrices of symbols and classes, whose size is a constant.

Defined results: null texts are empty texts (one end token); without training
texts N and V are 0, the base score is 0 for every token and so is the model's;
repeated documents count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Words that seed the classes, powers of two for the others, classes, rounds of exchange of the seeds.
TOP, BANDS, CLASSES, ROUNDS = 800, 16, 40, 5
#: Passes in which every word may move.
PASSES = 2
UNSEEN, END = TOP + BANDS, TOP + BANDS + 1
SYMBOLS = TOP + BANDS + 2
#: Weight of the class prior in a transition, and share of the words seen once that stands for unseen words.
PRIOR, UNSEEN_SHARE = 20.0, 0.5
#: Tokens of a chunk.
CHUNK = 2_000_000
BLOCK = 16_384

#: Classes with those of unseen words and ends; figures of a word: next classes, previous classes, itself behind itself.
EVERY = CLASSES + 2
WIDTH = 2 * EVERY + 1
#: States of the class bigrams: classes, the same for words seen once, unseen, end.
STATES = 2 * CLASSES + 2
#: Ranges of word hashes, and words of chunks that meet in one part on average.
BUCKETS, PER_PART = 65_536, 500_000
#: Words whose gains are computed at once.
WORDS = 4_096

CHUNKS = "chunk bigint, docs array<bigint>, held array<boolean>, lengths binary, ids binary, n bigint, sizes binary, words array<binary>, counts binary"
CODED = "chunk bigint, sizes binary, docs array<bigint>, held array<boolean>, lengths binary, ids binary, c binary, symbols binary"
WORD_ROWS = "part int, chunk bigint, words array<binary>, counts binary"
PARTS = "part int, chunks binary, sizes binary, codes binary, c binary, n bigint, v bigint, best array<struct<c: bigint, word: binary, part: int, code: int>>"
PAIRS = "part int, chunk bigint, at binary, key binary, n binary"


def squeeze(values: np.ndarray, dtype: str = "<u4") -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    planes = values.astype(dtype).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def expand(data: bytes, dtype: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


class Numbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def words(text: bytes) -> list[bytes]:
    """White-space words of a text whose letters A-Z are lower-cased."""
    return text.lower().split()


def chunked(docs: DataFrame, held: F.Column, size: int = CHUNK) -> DataFrame:
    """Stored chunks of ``docs`` (``doc_id``, ``text``): local word numbers, distinct words and their training counts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    types = {"chunk": pa.int64(), "docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.binary(), "ids": pa.binary(), "n": pa.int64(), "sizes": pa.binary(), "words": pa.list_(pa.binary()), "counts": pa.binary()}

    @common.task("class_lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        names: list = []
        kept: list = []
        found: list[np.ndarray] = []
        numbers, n = Numbers(), 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in found], np.int64)
            own = list(numbers)
            buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 48 for w in own), np.uint16, len(own))
            order = np.argsort(buckets, kind="stable")
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            ids = place[np.concatenate(found)]
            train = ids[np.repeat(~np.array(kept, bool), lengths)]
            sizes, counts = np.bincount(buckets, minlength=BUCKETS), np.bincount(train, minlength=len(own))
            values = [chunk, names, kept, lengths.tobytes(), squeeze(ids), len(own), squeeze(sizes), [own[k] for k in order.tolist()], squeeze(counts)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types.values(), strict=True)], names=list(types))

        for batch in common.small_batches(batches, "text"):
            for doc, aside, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.text_bytes(batch.column(1)), strict=True):
                own = words(text)
                names.append(doc)
                kept.append(aside)
                found.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                n += len(own) + 1
                if n >= size:
                    yield flush()
                    chunk, names, kept, found, numbers, n = chunk + 1, [], [], [], Numbers(), 0
        if names:
            yield flush()

    return common.materialise(rows.mapInArrow(run, CHUNKS), "chunks", compression="lz4")


def part_cuts(sizes: bytes, parts: int) -> np.ndarray:
    """Where the words of each part begin among a chunk's words, and the end."""
    return np.concatenate([[0], np.cumsum(expand(sizes), dtype=np.int64)])[-(-np.arange(parts + 1) * BUCKETS // parts)]


def word_rows(chunks: DataFrame, parts: int) -> DataFrame:
    """Each chunk's words and their training counts, by part."""

    @common.task("class_lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, words, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
                cuts, counts = part_cuts(sizes.as_py(), parts), expand(counts.as_py())
                own = np.flatnonzero(np.diff(cuts))
                if not len(own):
                    continue
                offsets = pa.array(np.append(cuts[own], cuts[-1]), pa.int32())
                packed = [squeeze(counts[a:b]) for a, b in zip(cuts[own], cuts[own + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), chunk.as_py()), pa.int64()), pa.ListArray.from_arrays(offsets, words.values), pa.array(packed, pa.binary())], names=["part", "chunk", "words", "counts"])

    return chunks.select("chunk", "sizes", "words", "counts").mapInArrow(run, WORD_ROWS)


class Counts:
    """What the corpus says: the parts (a stored table of packed word counts), totals, and the words that seed the classes."""

    def __init__(self, chunks: DataFrame):
        entries, ends = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.expr("size(filter(held, x -> not x))"))).first()
        self.n_parts = min(BUCKETS, max(64, -(-entries // PER_PART)))
        self.parts = common.materialise(word_rows(chunks, self.n_parts).groupBy("part").applyInArrow(common.group("class_lm")(count_words), PARTS), "parts")
        n, v = self.parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        self.ends = ends or 0
        self.n, self.v = n + self.ends, v + (self.ends > 0)
        self.top = self.parts.select(F.explode("best").alias("x")).select("x.*").orderBy(F.desc("c"), "word").limit(TOP).collect()

    def symbol_of(self):
        """A function that gives the symbols of a part's words."""
        top: dict[int, list] = {}
        for k, r in enumerate(self.top):
            top.setdefault(r.part, []).append((r.code, k))

        def of(part: int, c: np.ndarray) -> np.ndarray:
            band = TOP + np.minimum(BANDS - 1, np.floor(np.log2(np.maximum(c, 1)))).astype(np.int64)
            symbol = np.where(c > 0, band, UNSEEN)
            for code, k in top.get(part, []):
                symbol[code] = k
            return symbol

        return of

    def seeded(self, kind: np.ndarray) -> DataFrame:
        """The parts with the class of each word before the first pass; ``kind`` has the class of each symbol."""
        of = self.symbol_of()

        @common.task("class_lm")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = [squeeze(kind[of(part, expand(c, "<u8").astype(np.int64))], "u1") for part, c in zip(batch.column("part").to_pylist(), batch.column("c").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kinds, pa.binary())], names=["part", "chunks", "sizes", "codes", "kinds"])

        return self.parts.select("part", "chunks", "sizes", "codes", "c").mapInArrow(run, "part int, chunks binary, sizes binary, codes binary, kinds binary")

    def symbols(self) -> DataFrame:
        """(``chunk``, ``part``, ``c``, ``symbols``) of every chunk's words in their order; unseen words have count 0."""
        of = self.symbol_of()

        @common.task("class_lm")
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in common.each_row(batch):
                    c, codes = expand(row["c"], "<u8").astype(np.int64), expand(row["codes"])
                    symbol = of(row["part"], c)
                    cuts = np.concatenate([[0], np.cumsum(expand(row["sizes"]), dtype=np.int64)]).tolist()
                    out = [[squeeze(c[codes[a:b]], "<u8") for a, b in zip(cuts, cuts[1:], strict=False)], [squeeze(symbol[codes[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]]
                    chunks = np.frombuffer(row["chunks"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(np.full(len(chunks), row["part"]), pa.int32()), *[pa.array(x, pa.binary()) for x in out]], names=["chunk", "part", "c", "symbols"])

        return self.parts.select("part", "chunks", "sizes", "codes", "c").mapInArrow(run, "chunk bigint, part int, c binary, symbols binary")


def count_words(table: pa.Table) -> pa.Table:
    """One part: its words' corpus counts, and which word each chunk's words are."""
    table = table.sort_by("chunk")
    words = pa.concat_arrays([x.flatten() for x in table.column("words").chunks]).dictionary_encode()
    codes, names = words.indices.to_numpy(), words.dictionary
    found = [expand(x) for x in table.column("counts").to_pylist()]
    c = np.zeros(len(names), np.int64)
    np.add.at(c, codes, np.concatenate(found).astype(np.int64))
    least = np.partition(c, len(c) - TOP)[len(c) - TOP] if len(c) > TOP else 1
    part = table.column("part")[0].as_py()
    best = sorted((-int(c[k]), names[k].as_py(), part, k) for k in np.flatnonzero(c >= max(1, least)).tolist())[:TOP]
    seeds = [{"c": -n, "word": w, "part": p, "code": k} for n, w, p, k in best]
    values = [part, table.column("chunk").to_numpy().astype(np.int64).tobytes(), squeeze(np.array([len(x) for x in found])), squeeze(codes), squeeze(c, "<u8"), int(c.sum()), int((c > 0).sum()), seeds]
    types = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.list_(pa.struct([("c", pa.int64()), ("word", pa.binary()), ("part", pa.int32()), ("code", pa.int32())]))]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "chunks", "sizes", "codes", "c", "n", "v", "best"])


def coded(chunks: DataFrame, back: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored chunks with the packed ``columns`` that come back from the parts."""
    names = [f.split()[0] for f in CODED.split(", ")]

    @common.group("class_lm")
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        for name, dtype in columns.items():
            whole = np.concatenate([np.empty(0, dtype), *[expand(x, dtype) for x in right.column(name).to_pylist()]])
            if name in left.column_names:
                left = left.drop_columns([name])
            left = left.append_column(name, pa.array([squeeze(whole, dtype)], pa.binary()))
        return left.rename_columns(["chunk" if x == "own" else x for x in left.column_names]).select(names)

    left = chunks.select(F.col("chunk").alias("own"), *[x for x in names[1:] if x in chunks.columns]).groupBy("own")
    return common.materialise(left.cogroup(back.groupBy("chunk")).applyInArrow(both, CODED), "coded", compression="lz4")


class Chunk:
    """One coded chunk, opened: words, counts and symbols or classes in text order with an end behind every document."""

    def __init__(self, row: dict, ends: int):
        self.docs, self.held = row["docs"], np.array(row["held"], bool)
        lengths = np.frombuffer(row["lengths"], np.int64)
        ids = expand(row["ids"])
        self.lengths = lengths + 1
        self.stops = np.cumsum(self.lengths)
        self.words = np.full(len(ids) + len(lengths), -1, np.int32)
        stands = np.ones(len(self.words), bool)
        stands[self.stops - 1] = False
        self.words[stands] = ids
        del ids
        self.c = self.tokens(expand(row["c"], "<u8").astype(np.int64), ends)
        self.symbols = self.tokens(expand(row["symbols"]).astype(np.int64), END)
        self.train = np.repeat(~self.held, self.lengths)

    def tokens(self, values: np.ndarray, end: int) -> np.ndarray:
        """A figure of each word, by token."""
        out = np.full(len(self.words), end, np.int64)
        stands = self.words >= 0
        if stands.any():
            out[stands] = values[self.words[stands]]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.stops - self.lengths)


def before(values: np.ndarray, end: int) -> np.ndarray:
    """The same figures of the token before."""
    return np.concatenate([[end], values[:-1]])


def states(kinds: np.ndarray, c: np.ndarray) -> np.ndarray:
    """State of each token: its class, apart for words seen once."""
    return np.where(kinds >= CLASSES, kinds + CLASSES, kinds + CLASSES * (c == 1))


def bigrams(table: DataFrame, ends: int, kind: np.ndarray | None = None) -> np.ndarray:
    """Bigrams of all training texts: of symbols, or of states where ``kind`` has the class of each symbol; a constant size."""
    size = SYMBOLS if kind is None else STATES

    @common.task("class_lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for row in common.each_row(batch):
                chunk = Chunk(row, ends)
                own = chunk.symbols if kind is None else states(kind[chunk.symbols], chunk.c)
                total += np.bincount((before(own, size - 1) * size + own)[chunk.train], minlength=len(total))
        yield common.emit_partial(total, BLOCK)

    return common.add_up(table.mapInArrow(run, common.PARTIAL), "int64", size * size, BLOCK).reshape(size, size)


def neighbours(table: DataFrame, ends: int, parts: int, kind: np.ndarray) -> DataFrame:
    """How often each class is beside each word in the training texts, by part; ``kind`` has the class of each symbol."""

    @common.task("class_lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in common.each_row(batch):
                chunk, cuts = Chunk(row, ends), part_cuts(row["sizes"], parts)
                word, own = chunk.words.astype(np.int64), kind[chunk.symbols]
                last, left = before(word, -1), before(own, EVERY - 1)
                follows, stands = chunk.train & (last >= 0), chunk.train & (word >= 0)
                keys = np.concatenate([(last * WIDTH + own)[follows], (word * WIDTH + EVERY + left)[stands], (word * WIDTH + 2 * EVERY)[stands & (word == last)]])
                keys, n = np.unique(keys, return_counts=True)
                at, key = keys // WIDTH, (keys % WIDTH).astype(np.uint8)
                bounds = np.searchsorted(at, cuts)
                found = np.flatnonzero(np.diff(bounds))
                out = []
                for p in found.tolist():
                    a, b = bounds[p], bounds[p + 1]
                    out.append((p, row["chunk"], squeeze(np.diff(at[a:b], prepend=cuts[p])), squeeze(key[a:b], "u1"), squeeze(n[a:b])))
                if out:
                    types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "chunk", "at", "key", "n"])

    return table.mapInArrow(run, PAIRS)


def best_classes(right: np.ndarray, left: np.ndarray, alone: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each word's class of the best class bigram likelihood while all others stay.

    ``right`` and ``left`` are counts of the classes behind and before each word,
    without the ``alone`` times that it stands beside itself.
    """
    classes = table.shape[0] - 2
    gain = np.zeros((len(own), classes))
    for view, more, other in ((table, right, left), (table.T, left, right)):
        w, j = np.nonzero(more)
        if not len(w):
            continue
        x, kind = more[w, j], own[w]
        a = view[:classes, j].T.copy()
        a[np.arange(len(w)), kind] -= x
        same = np.flatnonzero(j == kind)
        a[same] -= other[w[same], :classes]
        a[same, kind[same]] -= alone[w[same]]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(xlogx(a + x[:, None]) - xlogx(a), starts)
    r, b = right[:, :classes], left[:, :classes]
    w, k = np.nonzero(((r > 0) & (b > 0)) | (alone > 0)[:, None])
    x, y, s = r[w, k], b[w, k], alone[w]
    on = table[k, k] - (k == own[w]) * (x + y + s)
    gain[w, k] += xlogx(on + x + y + s) - xlogx(on + x) - xlogx(on + y) + xlogx(on)
    every = np.arange(len(own))
    for marginal, n in ((table.sum(axis=1)[:classes], right.sum(axis=1) + alone), (table.sum(axis=0)[:classes], left.sum(axis=1) + alone)):
        size, which = np.unique(n, return_inverse=True)
        gain -= (xlogx(marginal + size[:, None]) - xlogx(marginal))[which]
        gain[every, own] += xlogx(marginal[own] + n) - 2 * xlogx(marginal[own]) + xlogx(marginal[own] - n)
    best = gain.argmax(axis=1)
    return np.where(gain[every, best] > gain[every, own] + 1e-9, best, own)


def moved(parts: DataFrame, asked: DataFrame, table: np.ndarray) -> DataFrame:
    """(``chunk``, ``part``, ``symbols``): the classes of every chunk's words after a pass, each word moved while the others stay; ``parts`` has
    the classes before, and one row of each part has all the new ones (``kinds``)."""

    @common.group("class_lm")
    def move(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunks, codes, kinds = np.frombuffer(row["chunks"], np.int64), expand(row["codes"]).astype(np.int64), expand(row["kinds"], "u1").astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(expand(row["sizes"]), dtype=np.int64)])
        begin = dict(zip(chunks.tolist(), cuts.tolist(), strict=False))
        keys, ns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in right.to_pylist():
            at = np.cumsum(expand(x["at"]), dtype=np.int64) + begin[x["chunk"]]
            keys.append(codes[at] * WIDTH + expand(x["key"], "u1"))
            ns.append(expand(x["n"]).astype(np.int64))
        key, n = np.concatenate(keys), np.concatenate(ns)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        new = kinds.copy()
        for first in range(0, len(kinds), WORDS):
            own = kinds[first : first + WORDS]
            a, b = np.searchsorted(key, [first * WIDTH, (first + len(own)) * WIDTH])
            counts = np.bincount(key[a:b] - first * WIDTH, n[a:b], len(own) * WIDTH).reshape(len(own), WIDTH)
            seen = np.flatnonzero(counts.any(axis=1))
            if len(seen):
                counts, kind = counts[seen], own[seen]
                behind, ahead, alone = counts[:, :EVERY], counts[:, EVERY : 2 * EVERY], counts[:, -1]
                for side in (behind, ahead):
                    side[np.arange(len(seen)), kind] -= alone
                new[first + seen] = best_classes(behind, ahead, alone, kind, table)
        packed = [squeeze(new[codes[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"chunk": pa.array(chunks), "part": pa.array(np.full(len(chunks), row["part"]), pa.int32()), "symbols": pa.array(packed, pa.binary()), "kinds": pa.array([squeeze(new, "u1"), *[None] * (len(packed) - 1)], pa.binary())})

    left = parts.select(F.col("part").alias("own"), "part", "chunks", "sizes", "codes", "kinds").groupBy("own")
    return common.materialise(left.cogroup(asked.groupBy("part")).applyInArrow(move, "chunk bigint, part int, symbols binary, kinds binary"), "moved")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol: exchange clustering by class bigram likelihood; the end and the unseen symbol keep classes of their own."""
    n = len(pairs)
    pairs = pairs.astype(float)
    mass = pairs.sum(axis=0)
    order = [s for s in np.argsort(-mass, kind="stable").tolist() if s < n - 2 and mass[s] > 0]
    kind = np.zeros(n, np.int64)
    kind[n - 2], kind[n - 1] = classes, classes + 1
    for k, s in enumerate(order):
        kind[s] = k % classes
    every = classes + 2
    table = np.zeros((every, every))
    np.add.at(table, (kind[:, None], kind[None, :]), pairs)
    free = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for s in order:
            own = kind[s]
            right, left = np.bincount(kind, pairs[s], every), np.bincount(kind, pairs[:, s], every)
            self_count = pairs[s, s]
            right[own] -= self_count
            left[own] -= self_count
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= self_count
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            a, b = table[:classes], table[:, :classes].T
            gain = (xlogx(a + right) - xlogx(a)).sum(axis=1) + (xlogx(b + left) - xlogx(b)).sum(axis=1)
            on = table[free, free]
            gain += xlogx(on + right[:classes] + left[:classes] + self_count) - xlogx(on + right[:classes]) - xlogx(on + left[:classes]) + xlogx(on)
            gain -= xlogx(rows[:classes] + right.sum() + self_count) - xlogx(rows[:classes]) + xlogx(columns[:classes] + left.sum() + self_count) - xlogx(columns[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            kind[s] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_count
        if not moved:
            break
    return kind


#: Classes as symbols, once each word has its own; class of each state.
PLACED = np.concatenate([np.arange(EVERY), np.zeros(SYMBOLS - EVERY - 1, np.int64), [EVERY - 1]])
FOLD = np.concatenate([np.arange(CLASSES), np.arange(CLASSES), [CLASSES, CLASSES + 1]])


def folded(pairs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Class bigrams of symbol or state bigrams."""
    table = np.zeros((EVERY, EVERY))
    np.add.at(table, (kind[:, None], kind[None, :]), pairs.astype(float))
    return table


def likelihood(table: np.ndarray) -> float:
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def placed(table: DataFrame, counts: Counts, passes: int = PASSES) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The coded chunks with the words' last classes as symbols, the class of each symbol, and the state bigrams."""
    pairs = bigrams(table, counts.ends)
    kind = exchange(pairs)
    state, now, found = counts.seeded(kind), folded(pairs, kind), None
    for _ in range(passes if counts.n else 0):
        words = moved(state, neighbours(table, counts.ends, counts.n_parts, kind), now)
        new = coded(table, words, {"symbols": "<u4"})
        after = bigrams(new, counts.ends, PLACED)
        if likelihood(folded(after, FOLD)) <= likelihood(now):
            common.discard(new)
            break
        common.discard(table)
        table, kind, found, now = new, PLACED, after, folded(after, FOLD)
        state = counts.parts.select("part", "chunks", "sizes", "codes").join(words.filter("kinds is not null").select("part", "kinds"), "part")
    return table, kind, bigrams(table, counts.ends, kind) if found is None else found


class Model:
    """Log10 transitions between classes and log10 mass of each class."""

    def __init__(self, pairs: np.ndarray, kind: np.ndarray):
        self.kind = kind
        spread = pairs.astype(float)
        once, unseen = slice(CLASSES, 2 * CLASSES), 2 * CLASSES
        for view in (spread, spread.T):
            view[unseen] += UNSEEN_SHARE * view[once].sum(axis=0)
            view[once] *= 1 - UNSEEN_SHARE
        table = folded(spread, FOLD)
        mass = table.sum(axis=0)
        prior = (mass + 1) / (mass.sum() + EVERY)
        self.transitions = np.log10((table + PRIOR * prior) / (table.sum(axis=1, keepdims=True) + PRIOR))
        self.mass = np.log10(np.maximum(mass, 1))

    def scores(self, chunk: Chunk) -> np.ndarray:
        """Log10 probability of each token; an unseen word is the only one of its class."""
        kind = self.kind[chunk.symbols]
        once = (chunk.c == 1) & (kind < CLASSES)
        emission = np.log10(np.maximum(chunk.c * np.where(once, 1 - UNSEEN_SHARE, 1.0), 1e-9)) - self.mass[kind]
        return self.transitions[before(kind, EVERY - 1), kind] + np.where(chunk.c > 0, emission, 0.0)


def score(docs: DataFrame, held: F.Column | None = None, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Per document: tokens, known tokens, training tokens, the add-one unigram score and the class model's log10 probability."""
    held = common.crc_mod("doc_id", 7) == 2 if held is None else held
    chunks = chunked(docs, held, chunk)
    counts = Counts(chunks)
    table = coded(chunks, counts.symbols(), {"c": "<u8", "symbols": "<u4"})
    common.discard(chunks)
    ends, n, v = counts.ends, counts.n, counts.v
    table, kind, pairs = placed(table, counts, passes)
    model = docs.sparkSession.sparkContext.broadcast(Model(pairs, kind))  # classes squared and symbols: a constant

    @common.task("class_lm")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in common.each_row(batch):
                own = Chunk(row, ends)
                base = np.log10((own.c + 1) / (n + v + 1))
                columns = [own.docs, own.held, own.lengths, own.sums((own.c > 0).astype(np.int64)), np.full(len(own.docs), n, np.int64), own.sums(base), own.sums(model.value.scores(own)) if n else np.zeros(len(own.docs))]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return table.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
