"""Helpers shared by the training-data operators.

Intermediate results are cut with :func:`marlstone.store.materialise`.
"""

from __future__ import annotations

import ctypes
import functools
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import ship
from marlstone.store import clear, discard, files_for, materialise, own_dir, shared_dir

#: Prefix of every internal column; user columns never start with it.
P = "__m_"


#: What the modules keep from task to task in a Python worker, and the module whose tasks ran last.
_caches: dict[str, list[dict]] = {}
_last = {"owner": "", "trimmed": 0.0}


def cache(owner: str, held: dict) -> dict:
    """Register ``held`` as a cache of the module ``owner``."""
    _caches.setdefault(owner, []).append(held)
    return held


def begin(owner: str) -> None:
    """A task of ``owner`` begins: the caches of other modules are emptied, as Spark uses its Python workers again."""
    if _last["owner"] != owner:
        for name, held in _caches.items():
            if name != owner:
                for x in held:
                    x.clear()
        _last["owner"] = owner
        release()


def release() -> None:
    """Give freed memory back to the system, every second at most."""
    if time.monotonic() - _last["trimmed"] > 1:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        _last["trimmed"] = time.monotonic()


def task(owner: str) -> Callable[[Callable], Callable]:
    """Marks a function over the batches of a partition as a task of ``owner``."""

    def mark(run: Callable) -> Callable:
        @functools.wraps(run)
        def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(owner)
            for batch in run(batches):
                yield batch
                del batch
                release()
            release()

        return wrapped

    return mark


def group(owner: str) -> Callable[[Callable], Callable]:
    """Marks a function of one group, or two co-groups, as a task of ``owner``."""

    def mark(run: Callable) -> Callable:
        if run.__code__.co_argcount == 2:

            def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
                begin(owner)
                out = run(left, right)
                release()
                return out

        else:

            def wrapped(table: pa.Table) -> pa.Table:
                begin(owner)
                out = run(table)
                release()
                return out

        return wrapped

    return mark


def with_row_id(df: DataFrame, label: str) -> DataFrame:
    """``df`` as (``__m_rid``, ``__m_row``), stored: the id of a row stays the same however often it is read.

    The original row travels as one struct, so extra columns with any name survive.
    """
    return materialise(df.select(F.monotonically_increasing_id().alias(P + "rid"), F.struct("*").alias(P + "row")), label)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slice batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = byte_lengths(batch.column(column))
        part = (np.cumsum(sizes) // limit).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one after the other, for rows that are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc32_text(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


#: Schema of partial vectors: which task, which block, the values.
PARTIAL = "part int, block int, data binary"


def emit_partial(values: np.ndarray, block: int) -> pa.RecordBatch:
    """A task's sums as rows of blocks; blocks of zeros are left out."""
    from pyspark import TaskContext

    part, flat = TaskContext.get().partitionId(), values.reshape(-1)
    rows = [(part, k // block, flat[k : k + block].tobytes()) for k in range(0, len(flat), block) if flat[k : k + block].any()]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["part", "block", "data"])


def add_up(partials: DataFrame, dtype: str, size: int, block: int) -> np.ndarray:
    """The sum of all partial vectors of ``size`` values, on the driver: ``size`` is a constant of the caller, whatever the input.

    Two rounds, so that no task gets the blocks of more than a 256th of all tasks at once.
    """

    def fold(table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("data").to_pylist():
            own = np.frombuffer(data, dtype)
            total = own.copy() if total is None else total + own
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    once = partials.withColumn("part", F.expr("cast(part % 256 as int)")).groupBy("part", "block").applyInArrow(fold, PARTIAL)
    twice = once.groupBy("block").applyInArrow(fold, PARTIAL)
    out = np.zeros(size, dtype)
    for row in twice.select("block", "data").toLocalIterator():
        own = np.frombuffer(row[1], dtype)
        out[row[0] * block : row[0] * block + len(own)] = own
    return out


def quotas(counts: dict, bound: int) -> dict:
    """How many rows of each stratum a sample of at most ``bound`` takes: even shares, and what small strata leave goes to the others."""
    out, left = {}, bound
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        out[name] = min(n, left // (len(counts) - k))
        left -= out[name]
    return out


def stratified(rows: DataFrame, stratum: str, hashed: str, bound: int) -> DataFrame:
    """Distinct (``stratum``, ``hashed``) of ``rows``, at most ``bound``: of every stratum those with the smallest hashes.

    ``hashed`` is a 64-bit hash, so what is taken depends on the rows alone, not
    on their order or on how often each occurs.  A share that is likely twice
    the quota is taken before the exact cut, so no task sorts a whole stratum.
    """
    found = rows.groupBy(stratum).agg(F.approx_count_distinct(hashed).alias("n")).collect()  # a row for each stratum
    taken = quotas({r[0]: r[1] + 1 + r[1] // 4 for r in found}, bound)  # the estimate may be a few hundredths low
    if not taken:
        return rows.select(stratum, hashed).limit(0)
    limits = [(name, taken[name], int(min(1.0, 2.0 * taken[name] / max(1, n) + 1e-6) * (1 << 20)) if n > 4096 else 1 << 20) for name, n in found]
    dim = F.broadcast(rows.sparkSession.createDataFrame(limits, f"{stratum} {rows.schema[stratum].dataType.simpleString()}, quota bigint, share bigint"))
    own = rows.select(stratum, hashed).join(dim, stratum).filter(F.pmod(F.col(hashed), F.lit(1 << 20)) < F.col("share")).groupBy(stratum, hashed).agg(F.max("quota").alias("quota"))
    order = Window.partitionBy(stratum).orderBy(hashed)
    return own.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= bound).filter(F.col("turn") <= F.col("quota")).select(stratum, hashed)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which the softmax of ``logits`` gives ``labels`` the least log loss."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    return float(min(grid, key=loss))


__all__ = ["clear", "discard", "files_for", "materialise", "own_dir", "shared_dir"]
