"""Jobs over landed files: index builds with upsert, workspaces, JSON artifacts, checks of downloads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import scope
from marlstone.operators.facts import keep_last
from marlstone.sources import readers

SCOPE = ("ticker", "fiscal_year")
#: Stands for a null in the folders of the index.
NO_SCOPE = "__none__"
# The smallest document that counts as a filing, and phrases of pages that were refused.
LEAST_BYTES, LEAST_PAGES, LEAST_TEXT = 100_000, 20, 300
REFUSED = ("loading inline docs", "inline viewer", "undeclared automated tool", "please declare your traffic")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit(NO_SCOPE)) for c in SCOPE})


def upsert_index(rows: DataFrame, path: str) -> None:
    """Insert or replace ``rows`` (``chunk_id``, ``load_seq``, scope, ...) in the index under ``path``.

    The last row of each id stays, and a replaced row is newer than all others.
    Only the filings that ``rows`` holds are read and written again, as folders
    of the partitioned table; an id names its filing, so no row is in two.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        old = read_index(spark, path)
        touched = rows.select(*SCOPE).distinct()
        same = [old[c].eqNullSafe(touched[c]) for c in SCOPE]
        last = old.agg(F.coalesce(F.max("load_seq"), F.lit(-1)).alias("last"))  # one row
        new = rows.crossJoin(F.broadcast(last)).withColumn("load_seq", F.col("load_seq") + F.col("last") + 1).drop("last")
        rows = old.join(touched, same[0] & same[1], "left_semi").unionByName(new, allowMissingColumns=True)
    kept = keep_last(rows, ["chunk_id"], "load_seq").withColumns({c: F.coalesce(c, F.lit(NO_SCOPE)) for c in SCOPE})
    kept.repartition(*SCOPE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(path)


def embedded(rows: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the vectors of their ``content``; a text without one is an error, raised where the row is written."""
    vector = embed(F.col("content"))
    return rows.withColumn("embedding", F.when(vector.isNull(), F.raise_error(F.concat(F.lit("no embedding for "), "chunk_id"))).otherwise(vector))


def build_index(rows: DataFrame, path: str, embed: Callable[[Column], Column], rebuild: bool = True) -> int:
    """Embed index rows (of :func:`readers.index_rows` or :func:`readers.summary_rows`) and store them; the number of rows of the index.

    ``rebuild`` writes a new index beside the old one and then takes its place;
    else rows are inserted or replaced.
    """
    spark = rows.sparkSession
    numbered = rows if "load_seq" in rows.columns else rows.withColumn("load_seq", F.monotonically_increasing_id())
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}" if rebuild else path
    upsert_index(embedded(numbered, embed), target)
    if rebuild:
        new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (target, path))
        store = old.getFileSystem(spark._jsc.hadoopConfiguration())
        store.delete(old, True)
        store.rename(new, old)
    return spark.read.parquet(path).count()


def build_table_index(assets: DataFrame, path: str, embed: Callable[[Column], Column], rebuild: bool = True) -> int:
    """The index of table captions; an error where no table has a successful summary."""
    rows = readers.summary_rows(assets)
    if rows.isEmpty():
        raise ValueError("no table has a successful summary")
    return build_index(rows, path, embed, rebuild)


def write_json(rows: DataFrame, path: str) -> None:
    """An artifact as JSON lines; the commit makes it visible as a whole, in place of the one before."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines that can be read, and the text of those that can't."""
    parsed = F.from_json("value", f"{schema}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    return rows.filter("broken is null").drop("broken"), rows.filter("broken is not null").select("broken")


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """(``workspace``, ``ready``): folders under ``root`` with a file ``metadata.json``; ready are those that have ``chunks.json`` too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{metadata,chunks}.json").load(root)
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("workspace"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    found = named.groupBy("workspace").agg(F.collect_set("name").alias("names"))
    return found.filter(F.array_contains("names", "metadata.json")).select("workspace", F.array_contains("names", "chunks.json").alias("ready"))


def rebuild_indexes(spark: SparkSession, root: str, path: str, schema: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Rebuild the index of all ready workspaces under ``root``; per workspace its rows and what the audit says (``ready`` or ``failed``)."""
    chunks = spark.read.schema(schema).json(f"{root}/*/chunks.json", multiLine=True).withColumn("workspace", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    known = workspaces(spark, root).filter("ready").select("workspace")
    rows = readers.index_rows(chunks.join(known, "workspace", "left_semi"), "workspace")
    build_index(rows, path, embed)
    audit = readers.health(read_index(spark, path), ["workspace"])
    status = F.when(F.coalesce("valid", F.lit(False)), "ready").otherwise("failed")
    return workspaces(spark, root).join(audit, "workspace", "left").select("workspace", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), F.when(F.col("n").isNull(), "no chunks").otherwise(F.col("reason")).alias("reason"))


def valid_filing(length: Column, pages: Column, first_text: Column) -> Column:
    """Whether a landed document is a filing: large enough, of enough pages, with text on the first that is no refusal."""
    low = F.lower(F.coalesce(first_text, F.lit("")))
    refused = F.exists(F.array(*map(F.lit, REFUSED)), lambda x: F.contains(low, x))
    return F.coalesce((length >= LEAST_BYTES) & (pages >= LEAST_PAGES) & (F.length(F.trim(low)) >= LEAST_TEXT) & ~refused, F.lit(False))


def pending(spark: SparkSession, stages: dict[str, str], force: bool = False) -> list[str]:
    """Stages whose output path doesn't exist yet, in order; all of them with ``force``."""
    return [name for name, path in stages.items() if force or not exists(spark, path)]


def merged_assets(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets of all workspaces (``source_file``, ``tables``, ``images``) in one table, and the counts of what was merged.

    Empty payloads are left out; every asset carries its filing's identity.
    """
    full = assets.filter((F.size(F.coalesce("tables", F.array())) > 0) | (F.size(F.coalesce("images", F.array())) > 0))
    who = scope.source_identity(F.col("source_file"))
    tagged = full.select("source_file", who["ticker"].alias("ticker"), who["fiscal_year"].alias("fiscal_year"), "tables", "images")
    kinds = [tagged.select("source_file", "ticker", "fiscal_year", F.lit(kind).alias("kind"), F.explode(column).alias("asset_id")) for kind, column in (("table", "tables"), ("image", "images"))]
    rows = kinds[0].unionByName(kinds[1])
    counts = rows.agg(F.count_distinct("source_file").alias("sources"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "image").alias("images"))
    return rows, counts
