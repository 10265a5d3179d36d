"""Intermediate tables in the folder that driver and executors share.

Results that several steps read, and cuts in an iteration, are written as Parquet
to the folder named in ``spark.checkpoint.dir``, so that a lost executor never
forces a whole lineage to be computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """Where this application's intermediate results are."""
    return f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate results of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, compression: str = "zstd", parts: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``parts`` puts its partitions together to so many files at most."""
    spark = ship(df.sparkSession)
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_for(rows: int, width: int, size: int = 8_000_000, least: int = 8) -> int:
    """Files of about ``size`` bytes for ``rows`` rows of ``width`` bytes at most, so that narrow tables don't become a file per shuffle partition."""
    return max(least, -(-rows * width // size))


def discard(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path(folder).getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path(folder), True)
