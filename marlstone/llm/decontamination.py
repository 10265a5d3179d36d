"""Benchmark decontamination with a distributed positional inverted index.

The corpus is split into shards of whole documents.  Each shard becomes one row
of the stored index: its documents, its terms, and for every term the sorted
token positions.  A query never reads the texts again: the phrases of the
benchmark go to every shard, and in a shard the lists of a phrase's terms are
shifted by the term's offset and intersected, starting from the rarest term.
``slop=0`` gives exact phrases, ``slop>0`` proximity matches (each term within
``slop`` words of its place, all of them in one document).  A phrase is looked
up by the term that the fewest phrases have, and only where a shard has it.

The benchmark is cut into blocks of bounded size.  A few of them are broadcast at
a time; what they match is stored before the next ones go out, so neither the
driver nor a task ever holds a large benchmark.  Which terms are stored is decided
by a bitmap of fixed size that has a bit for every benchmark term: a term that no
item has is left out, and one that shares a bit with another is merely kept.

Defined results: a null text has no words; an item without words has no phrase;
an item shorter than the window is one phrase; rows with a null item id still
mark words but are not listed as items; repeated documents each get their row;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Words of a shard, a little more where a long document ends it.
SHARD_WORDS = 400_000
#: Bytes of benchmark text in one broadcast block, and blocks that are out at a time.
BLOCK_BYTES, BLOCKS = 4_000_000, 4
#: log2 of the bits of the bitmap of benchmark terms.
BITS = 24
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

INDEX_SCHEMA = "shard bigint, ids array<bigint>, lengths binary, terms array<binary>, offsets binary, positions binary"
HIT_SCHEMA = "id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
FOUND_SCHEMA = "shard bigint, found binary"
MATCH_SCHEMA = "id bigint, item_id bigint, start int, length int, exact boolean"


def words(text: bytes) -> list[bytes]:
    """Words of a text whose letters A-Z are lower-cased."""
    return WORD.findall(text.lower())


class Phrases:
    """Phrases of one block of items: a bounded, picklable query."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.window = window
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.terms = list(vocabulary)
        self.phrases = list(found)
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        uses = np.bincount(np.fromiter((t for p in self.phrases for t in set(p)), np.int64), minlength=len(self.terms))
        self.by_term: dict[int, list[int]] = {}
        for number, phrase in enumerate(self.phrases):
            self.by_term.setdefault(min(phrase, key=lambda t: (uses[t], t)), []).append(number)


def load_phrases(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """Blocks of phrases; the driver holds one block's texts at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary")).toLocalIterator():
        text = bytes(row[1] or b"")
        held.append((row[0], text))
        size += len(text)
        if size >= block_bytes:
            yield Phrases(held, window)
            held, size = [], 0
    if held:
        yield Phrases(held, window)


def term_bits(benchmark: DataFrame) -> np.ndarray:
    """The bitmap of the benchmark's terms, one byte of eight bits after the other; its size is fixed."""
    bits = np.zeros(1 << BITS, bool)
    for row in benchmark.select(F.col("text").cast("binary")).toLocalIterator():
        for w in words(bytes(row[0] or b"")):
            bits[xxhash.xxh3_64_intdigest(w) >> (64 - BITS)] = True
    return np.packbits(bits, bitorder="little")


def shard_row(shard: int, ids: list, lengths: list[int], terms: list[bytes], found: list[np.ndarray]) -> dict:
    """One index row; ``found`` has for each document the term numbers, -1 for terms left out."""
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    at = np.flatnonzero(flat >= 0).astype(np.int32)
    order = np.argsort(flat[at], kind="stable")
    counts = np.bincount(flat[at], minlength=len(terms)) if len(at) else np.zeros(len(terms), np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return {"shard": shard, "ids": ids, "lengths": np.array(lengths, np.int64).tobytes(), "terms": terms, "offsets": offsets.tobytes(), "positions": at[order].tobytes()}


class Terms(dict):
    """Words to the numbers of a shard's terms, -1 for words whose bit is not set."""

    def __init__(self, bits: bytes | None):
        super().__init__()
        self.bits, self.names = bits, []

    def __missing__(self, word: bytes) -> int:
        if self.bits is not None:
            k = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
            if not self.bits[k >> 3] >> (k & 7) & 1:
                self[word] = -1
                return -1
        out = self[word] = len(self.names)
        self.names.append(word)
        return out


def build_index(docs: DataFrame, id_column: str = "doc_id", bits: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The positional index of ``docs`` (``id_column``, ``text``), one row per shard.

    ``bits`` (of :func:`term_bits`) restricts the stored terms to those a
    benchmark can ask for; this loses no match of it.  None stores every term.
    """
    known = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits.tobytes())  # 2 ** BITS / 8 bytes
    arrow = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.binary())), ("offsets", pa.binary()), ("positions", pa.binary())])

    @common.task("decontamination")
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        terms = Terms(known.value if known else None)
        total = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([shard_row(shard, ids, lengths, terms.names, found)], schema=arrow)

        for batch in common.small_batches(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(1)), strict=True):
                own = words(text)
                ids.append(doc)
                lengths.append(len(own))
                found.append(np.fromiter(map(terms.__getitem__, own), np.int32, len(own)))
                total += len(own)
                if total >= shard_words or len(ids) >= 20_000:
                    yield flush()
                    shard, ids, lengths, found, terms, total = shard + 1, [], [], [], Terms(terms.bits), 0
        if ids:
            yield flush()

    return docs.select(F.col(id_column).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX_SCHEMA)


class Shard:
    """One index row, opened."""

    def __init__(self, row: dict):
        self.number, self.ids = row["shard"], row["ids"]
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.slots = {t: k for k, t in enumerate(row["terms"])}
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.offsets[slot] : self.offsets[slot + 1]]

    def starts(self, slots: list[int], slop: int = 0) -> np.ndarray:
        """First positions of the phrase's occurrences; every term that is found lies in the document of the rarest."""
        order = sorted(range(len(slots)), key=lambda k: self.offsets[slots[k] + 1] - self.offsets[slots[k]])
        own = self.postings(slots[order[0]]).astype(np.int64)
        here, doc = own - order[0], np.searchsorted(self.ends, own, "right")
        end = self.ends[doc]
        begin = end - self.lengths[doc]
        if not slop:
            fits = (here >= begin) & (here + len(slots) <= end)
            here, begin, end = here[fits], begin[fits], end[fits]
        for k in order[1:]:
            if not len(here):
                return here
            own = self.postings(slots[k])
            if slop:
                low, high = np.maximum(here + k - slop, begin), np.minimum(here + k + slop, end - 1)
                keep = np.searchsorted(own, high, "right") > np.searchsorted(own, low, "left")
            else:
                at = np.searchsorted(own, here + k)
                at[at == len(own)] = 0
                keep = own[at] == here + k
            here, begin, end = here[keep], begin[keep], end[keep]
        return np.unique(np.maximum(here, begin)) if slop else here

    def matches(self, query: Phrases, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(phrase number, starts) of every phrase that occurs; with ``slop`` only phrases of a whole window."""
        size = np.diff(self.offsets)
        slots = [self.slots.get(t, -1) for t in query.terms]
        live = [s >= 0 and size[s] > 0 for s in slots]
        for term, numbers in query.by_term.items():
            if not live[term]:
                continue
            for number in numbers:
                phrase = query.phrases[number]
                if (not slop or len(phrase) == query.window) and all([live[t] for t in phrase]):
                    here = self.starts([slots[t] for t in phrase], slop)
                    if len(here):
                        yield number, here


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


class Hits:
    """What the phrases of some blocks match in a shard: covered stretches, and items by document."""

    def __init__(self) -> None:
        self.spans: list[np.ndarray] = []
        self.items: dict[int, set[int]] = {}

    def add(self, shard: Shard, query: Phrases, slop: int) -> None:
        for number, here in shard.matches(query, slop):
            docs = np.searchsorted(shard.ends, here, "right")
            # what is near may run over its document's end
            self.spans.append(np.stack([here, np.minimum(here + len(query.phrases[number]), shard.ends[docs])], axis=1))
            for doc in np.unique(docs).tolist():
                self.items.setdefault(doc, set()).update(query.items[number])

    def rows(self, ids: list, lengths: np.ndarray) -> pa.RecordBatch:
        """The rows of :func:`search` of the shard's documents."""
        ends = np.cumsum(lengths)
        delta = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
        for both in self.spans:
            np.add.at(delta, both[:, 0], 1)
            np.add.at(delta, both[:, 1], -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(delta[:-1]) > 0)])
        counts, none = hit[ends] - hit[ends - lengths], digest(set())
        items = [self.items.get(k) for k in range(len(ids))]
        columns = [ids, lengths, counts, [len(x or ()) for x in items], [digest(x) if x else none for x in items], counts > 0]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def search(index: DataFrame, blocks: list, slop: int = 0) -> DataFrame:
    """Per document of ``index``: words inside occurrences of the phrases and the items concerned.

    ``blocks`` are broadcast :class:`Phrases`, a few of bounded size; a shard takes one after another.
    """

    @common.task("decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in common.each_row(batch):
                shard, hits = Shard(row), Hits()
                for block in blocks:
                    hits.add(shard, block.value, slop)
                yield hits.rows(shard.ids, shard.lengths)

    return index.mapInArrow(run, HIT_SCHEMA)


def search_in_turns(index: DataFrame, turns: Iterator[list], slop: int = 0) -> DataFrame:
    """The rows of :func:`search` for more blocks than go out at once: what each turn matches is stored, then put together by shard."""
    parts = []
    for blocks in turns:

        @common.task("decontamination")
        def run(batches: Iterator[pa.RecordBatch], blocks: list = blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in common.each_row(batch):
                    shard, hits = Shard(row), Hits()
                    for block in blocks:
                        hits.add(shard, block.value, slop)
                    if hits.spans:
                        yield pa.RecordBatch.from_arrays([pa.array([shard.number], pa.int64()), pa.array([pickle.dumps((hits.spans, hits.items))], pa.binary())], names=["shard", "found"])

        parts.append(common.materialise(index.mapInArrow(run, FOUND_SCHEMA), "found"))
        for block in blocks:
            block.unpersist()
    found = functools.reduce(DataFrame.union, parts)

    @common.group("decontamination")
    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        hits, row = Hits(), left.to_pylist()[0]
        for data in right.column("found").to_pylist():
            spans, items = pickle.loads(data)
            hits.spans += spans
            for doc, own in items.items():
                hits.items.setdefault(doc, set()).update(own)
        return pa.Table.from_batches([hits.rows(row["ids"], np.frombuffer(row["lengths"], np.int64))])

    return index.select("shard", "ids", "lengths").groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(combine, HIT_SCHEMA)


def proximity(index: DataFrame, blocks: list, slop: int) -> DataFrame:
    """Every occurrence of a whole window whose terms lie within ``slop`` words of their places: document, item, place, and whether it is exact."""

    @common.task("decontamination")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in common.each_row(batch):
                shard, out = Shard(row), []
                for block in blocks:
                    query = block.value
                    for number, here in shard.matches(query, slop):
                        phrase = query.phrases[number]
                        exact = set(shard.starts([shard.slots[query.terms[t]] for t in phrase]).tolist())
                        docs = np.searchsorted(shard.ends, here, "right")
                        for start, doc in zip(here.tolist(), docs.tolist(), strict=True):
                            out += [(shard.ids[doc], item, start - int(shard.ends[doc] - shard.lengths[doc]), len(phrase), start in exact) for item in query.items[number]]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["id", "item_id", "start", "length", "exact"])

    return index.mapInArrow(run, MATCH_SCHEMA)


def query_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Broadcast blocks, a few at a time."""
    held = []
    for query in load_phrases(benchmark, window, block_bytes):
        held.append(docs.sparkSession.sparkContext.broadcast(query))
        if len(held) == BLOCKS:
            yield held
            held = []
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", window: int = 10, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """One row per document: ``id_column`` and the counts of :func:`search`, from a stored index."""
    index = common.materialise(build_index(docs, id_column, term_bits(benchmark)), "postings")
    turns = query_blocks(docs, benchmark, window, block_bytes)
    first, second = next(turns, []), next(turns, None)
    found = search(index, first, slop) if second is None else search_in_turns(index, itertools.chain([first, second], turns), slop)
    return found.withColumnRenamed("id", id_column)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """``docs`` without the rows in which a phrase of ``benchmark`` occurs; all columns stay.

    With ``slop`` a whole window also counts where each of its words is within so many words of its place.
    """
    rows = common.with_row_id(docs, "decontaminate")
    rid = common.P + "rid"
    plain = rows.select(rid, F.col(f"{common.P}row.text").alias("text"))
    index = common.materialise(build_index(plain, rid, term_bits(benchmark)), "postings")
    hit = rows.select(rid).limit(0)
    for near in sorted({0, slop}):
        turns = query_blocks(docs, benchmark, window)
        first, second = next(turns, []), next(turns, None)
        found = search(index, first, near) if second is None else search_in_turns(index, itertools.chain([first, second], turns), near)
        hit = hit.union(found.filter("contaminated").select("id"))
    hit = common.materialise(hit.distinct(), "contaminated", parts=common.files_for(rows.count(), 8))
    common.discard(index)
    return rows.join(hit, rid, "left_anti").select(f"{common.P}row.*")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The rows of :func:`decontaminate` with ten-word windows, in DuckDB.
ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
g as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
x as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as gram from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from g))),
m as (select rid, i, n, item_id from x join g using (n, gram)),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
t as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""
