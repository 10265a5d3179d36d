"""Token-id output as directly addressable codes.

An id is split into chunks of fixed widths, lowest first.  Level 0 holds the
first chunk of every id, level 1 the second chunk of those ids that need one,
and so on; a bitmap beside each level says which ids continue, and a rank
directory (set bits before each block of 512) turns a position of one level
into a position of the next in constant time.  Any id is read with one look at
each level, without decoding a block.

A segment is the file image of consecutive whole documents in ascending order
of document id (null ids first; equal ids by text); segments are rows of a
Parquet table without compression, so that any store Spark reads can hold
them.  A shard is what one task wrote; segments know their place in it, and the
totals of the shards (one number per task) give global positions.

Defined results: a null or empty text is the end id alone; repeated documents
are written each; an empty table gives an empty output.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common
from marlstone.llm.tokens import Encoder

MAGIC = b"MDAC1\0\0\0"
#: Bits of the chunks: the last level takes what is left of 32 bits.
WIDTHS = (8, 8, 16)
#: Ids per block of the rank directory.
BLOCK = 512
#: Ids after which a segment ends with its document.
SEGMENT = 1_000_000
#: Bytes of text a writing task gets on average, at most.
PART_BYTES = 64_000_000

SEGMENTS = "shard int, seq int, shard_start bigint, n_ids bigint, first_doc bigint, last_doc bigint, image binary"


def dtype(width: int) -> str:
    return "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def encode_image(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray) -> bytes:
    """The image of a segment: header, document directory, then the levels."""
    known = np.array([d is not None for d in docs], np.uint8)
    parts = [MAGIC, struct.pack("<qq", len(ids), len(docs)), known.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), lengths.astype("<i8").tobytes()]
    rest = ids.astype(np.uint32)
    for level, width in enumerate(WIDTHS):
        last = level == len(WIDTHS) - 1
        parts += [struct.pack("<q", len(rest)), (rest & np.uint32((1 << width) - 1)).astype(dtype(width)).tobytes()]
        if last:
            break
        rest = rest >> np.uint32(width)
        more = rest > 0
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.empty(0, np.int64)
        parts += [np.packbits(more, bitorder="little").tobytes(), np.concatenate([[0], np.cumsum(blocks)])[:-1].astype("<u4").tobytes()]
        rest = rest[more]
    return b"".join(parts)


class Image:
    """A segment image, opened without decoding it."""

    def __init__(self, image: bytes):
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = len(MAGIC)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        self.n, n_docs = (int(x) for x in take("<i8", 2))
        known = take("u1", n_docs)
        self.docs = [int(d) if k else None for d, k in zip(take("<i8", n_docs), known, strict=True)]
        self.lengths = take("<i8", n_docs)
        self.levels = []
        for level, width in enumerate(WIDTHS):
            n = int(take("<i8", 1)[0])
            values = take(dtype(width), n)
            last = level == len(WIDTHS) - 1
            self.levels.append((values, None if last else take("u1", -(-n // 8)), None if last else take("<u4", -(-n // BLOCK))))

    def __getitem__(self, k: int) -> int:
        """The id at position ``k``: one look at each level it reaches."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        value, shift = 0, 0
        for (values, bits, ranks), width in zip(self.levels, WIDTHS, strict=True):
            value |= int(values[k]) << shift
            shift += width
            if bits is None or not bits[k >> 3] >> (k & 7) & 1:
                return value
            block = k // BLOCK
            before = np.unpackbits(bits[block * BLOCK // 8 : (k >> 3) + 1], bitorder="little")[: k - block * BLOCK]
            k = int(ranks[block]) + int(before.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n, "<u4")
        at, shift = None, 0
        for (values, bits, _), width in zip(self.levels, WIDTHS, strict=True):
            part = values.astype("<u4") << np.uint32(shift)
            out[slice(None) if at is None else at] |= part
            shift += width
            if bits is not None:
                more = np.flatnonzero(np.unpackbits(bits, count=len(values), bitorder="little"))
                at = more if at is None else at[more]
        return out


def write_segments(docs: DataFrame, vocabulary: str, end: int, segment: int = SEGMENT, partitions: int | None = None) -> DataFrame:
    """The stored segments of ``docs`` (``doc_id``, ``text``) in ascending order of document id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    tie = F.xxhash64("text")  # ranges can end within equal ids
    ordered = rows.withColumn("tie", tie).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    arrow = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("image", pa.binary())])

    @common.task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, last, shard = Encoder.of(vocabulary), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        held: list[bytes] = []
        names: list = []
        size, start, seq = 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            image = encode_image(ids, names, np.array([len(x) // 4 for x in held], np.int64))
            return pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "shard_start": start, "n_ids": size, "first_doc": names[0], "last_doc": names[-1], "image": image}], schema=arrow)

        for batch in common.small_batches(batches, "text"):
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                held.append(ids + last)
                names.append(doc)
                size += len(held[-1]) // 4
                if size >= segment:
                    yield flush()
                    start, seq, size, held, names = start + size, seq + 1, 0, [], []
        if held:
            yield flush()

    return common.materialise(ordered.mapInArrow(run, SEGMENTS), "segments", compression="none")


def shard_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each shard; one number per writing task comes to the driver."""
    totals = sorted(segments.groupBy("shard").agg(F.sum("n_ids")).collect())
    return dict(zip([k for k, _ in totals], accumulate([0, *(n for _, n in totals)]), strict=False))


def read_documents(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the images: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``."""
    starts = segments.sparkSession.sparkContext.broadcast(shard_starts(segments))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    @common.task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in common.each_row(batch):
                image = Image(row["image"])
                raw = image.ids().tobytes()
                ends = np.cumsum(image.lengths)
                begins = ends - image.lengths
                own = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(image.docs, pa.int64()), pa.array(begins + starts.value[row["shard"]] + row["shard_start"], pa.int64()), pa.array(image.lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return segments.mapInArrow(run, schema)


def read_token(segments: DataFrame, position: int) -> int:
    """The id at a global position: the segment is found by its metadata, the id by direct access."""
    starts = shard_starts(segments)
    shard = max((k for k, s in starts.items() if s <= position), default=None, key=lambda k: starts[k])
    if shard is None:
        raise IndexError(position)
    local = position - starts[shard]
    row = segments.filter((F.col("shard") == shard) & (F.col("shard_start") <= local) & (F.col("shard_start") + F.col("n_ids") > local)).first()
    if row is None:
        raise IndexError(position)
    return Image(bytes(row["image"]))[local - row["shard_start"]]
