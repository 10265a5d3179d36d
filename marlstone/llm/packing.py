"""Best-fit packing of token sequences by the sum-of-squares rule.

A document becomes pieces of at most ``capacity`` tokens; only longer documents
are cut.  Full pieces are sequences of their own.  The rest is dealt into
groups that are packed side by side: each piece goes where the sum over all
residual gaps of the squared number of open sequences with that gap becomes
smallest, among the open sequences it fits in and a new one.

What stays open is packed again, as pieces of the filled lengths, level by
level.  Two sequences that are more than half full never fit together, so a
level takes the others, and of the fuller ones those with the widest gaps, as
many as could be needed; all else is set aside as it is.  From the second level
on a group joins what it leaves half empty in pairs, so each group hands on one
such sequence at most and the levels end after a few: their number grows with
the logarithm of the input and no group is larger than the first ones.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated documents are packed each; the result does not depend on the order of
the input's columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.tokens import Encoder

CAPACITY = 2048
#: Pieces packed together by one task.
GROUP = 60_000
#: Pieces above this part of the capacity go first, by length; smaller ones follow in a fixed shuffled order, which lets the rule fill the gaps evenly.
SMALL = 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, slot bigint, full boolean"
PLACES = "group bigint, number bigint, slot bigint, place bigint, length bigint, gap bigint"


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``keep_ids`` adds the ids themselves (little-endian unsigned 32-bit)."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * keep_ids
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    @common.task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, last = Encoder.of(vocabulary), np.array([end], "<u4").tobytes()
        task = TaskContext.get().partitionId() << 32
        n = 0
        for batch in common.small_batches(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), task | n, len(own) == 4 * capacity, *[own] * keep_ids))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece (in the order given), and the final gap of each sequence.

    Moving a piece of length s into a sequence with gap g changes the sum by
    2 N(g - s) - 2 N(g) + 2, closing one by 1 - 2 N(s), and a new one by
    2 N(capacity - s) + 1.  Ties go to the smallest gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    where, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        cost = 2 * (counts[: capacity + 1 - s] - counts[s:])  # by gap s .. capacity, less 2
        cost[0] -= 1  # a sequence that is closed counts no more
        fits = counts[s:capacity] > 0
        best = -1
        if fits.any():
            best = int(np.where(fits, cost[:-1], np.iinfo(np.int64).max).argmin())
        if best >= 0 and cost[best] + 2 <= 2 * counts[capacity - s] + 1:
            g = best + s
            number = stacks[g].pop()
            counts[g] -= 1
        else:
            g, number = capacity, len(gaps)
            gaps.append(capacity)
        where[k], offsets[k] = number, capacity - g
        gaps[number] = g - s
        if g > s:
            counts[g - s] += 1
            stacks[g - s].append(number)
    return where, offsets, np.array(gaps, np.int64)


def join_halves(where: np.ndarray, offsets: np.ndarray, gaps: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same packing with its sequences that are at most half full put together in pairs, until one is left."""
    filled = capacity - gaps
    half = np.flatnonzero((gaps > 0) & (2 * filled <= capacity))
    target, shift = np.arange(len(gaps)), np.zeros(len(gaps), np.int64)
    rest = sorted(half.tolist(), key=lambda k: (-int(filled[k]), k))
    own, size = None, 0
    for k in rest:  # fullest first; the open one takes what fits and makes way when it is more than half full
        if own is None or 2 * size > capacity:
            own, size = k, int(filled[k])
        else:
            target[k], shift[k] = own, size
            size += int(filled[k])
            gaps[own] = capacity - size
    return target[where], offsets + shift[where], gaps


def pack_groups(items: DataFrame, groups: int, capacity: int, level: int) -> DataFrame:
    """Pack (``slot``, ``length``) within ``groups`` groups; per item its sequence there and its place in it."""

    @common.group("packing")
    def run(table: pa.Table) -> pa.Table:
        slot, length = (table.column(c).to_numpy() for c in ("slot", "length"))
        small = length <= capacity // SMALL
        order = np.lexsort((slot, np.where(small, common.mix64(slot.astype(np.uint64)) >> np.uint64(1), np.uint64(0)), np.where(small, 0, -length), small))
        where, offsets, gaps = sum_of_squares(length[order], capacity)
        if level:
            where, offsets, gaps = join_halves(where, offsets, gaps, capacity)
        return pa.table({"group": pa.array(np.full(len(slot), table.column("group")[0].as_py(), np.int64)), "number": where, "slot": slot[order], "place": offsets, "length": length[order], "gap": gaps[where]})

    return items.select("slot", "length", F.expr(f"pmod(xxhash64(slot, {level}), {groups}L)").alias("group")).groupBy("group").applyInArrow(run, PLACES)


def next_items(left: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """What the next level packs of the open sequences (``slot``, ``gap``), and how many they are; 0 where no two fit together."""
    counts = dict(left.groupBy("gap").count().collect())  # a row for each gap: at most ``capacity``
    small = sum(n for gap, n in counts.items() if 2 * gap >= capacity)
    if not small or sum(counts.values()) < 2:
        return left, 0
    # a small one closes one of the fuller ones at most, and where one of them has room, one with a wider gap has it too
    room, least, edge = 2 * small, -(-capacity // 2), None
    for gap in sorted((g for g in counts if 2 * g < capacity), reverse=True):
        if counts[gap] > room:
            edge = gap
            break
        room, least = room - counts[gap], gap
    chosen = F.col("gap") >= least
    if edge is not None:
        chosen = chosen | ((F.col("gap") == edge) & (F.expr(f"pmod(xxhash64(slot, 'share'), {counts[edge]}L)") < room))
    return left.filter(chosen), 3 * small - (room if edge is None else 0)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a stored table of :func:`cut`) with ``sequence_id`` and ``offset``."""
    rest = pieces.filter("not full").select("slot", "length")
    groups, level, tables = max(1, -(-rest.count() // group)), 0, []
    while True:
        places = common.materialise(pack_groups(rest, groups, capacity, level), f"packing{level}")
        # a sequence's own id, as an item of the next level; the groups halve at least, so there are far fewer than 127 levels
        name = F.lit(level).cast("bigint") * F.lit(1 << 56) + F.col("group") * F.lit(1 << 26) + F.col("number")
        places = places.withColumn("sequence", name)
        tables.append(places)
        if groups == 1:
            break
        left = places.filter("gap > 0").groupBy("sequence").agg(F.sum("length").alias("length"), F.max("gap").alias("gap")).withColumnRenamed("sequence", "slot")
        rest, n = next_items(left, capacity)
        if not n:
            break
        groups = min(-(-groups // 2), -(-n // group))
        level += 1
    # resolve an item's sequence upwards through the levels
    found = tables[-1].select("slot", F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))
    for places in reversed(tables[:-1]):
        up = found.select(F.col("slot").alias("sequence"), F.col("sequence_id").alias("above"), F.col("offset").alias("shift"))
        found = places.join(up, "sequence", "left").select("slot", F.coalesce("above", "sequence").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))
    whole = pieces.filter("full").withColumns({"sequence_id": -F.col("slot") - 1, "offset": F.lit(0).cast("bigint")})
    return pieces.filter("not full").join(found, "slot").unionByName(whole).drop("slot", "full")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """One row per piece: document, piece, start, length, checksum, sequence and place in it."""
    return pack(common.materialise(cut(docs, vocabulary, capacity, end, keep_ids), "pieces"), capacity, group)
