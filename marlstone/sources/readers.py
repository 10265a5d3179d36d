"""Sources: nested facts, chunk and asset documents, audit logs; each gives the flat table its operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import scope
from marlstone.functions import text as T


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Nested company documents (``ticker`` from the file name, ``facts``)."""
    rows = spark.read.schema(schemas.COMPANY_FACTS).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    return rows.select(F.upper(F.regexp_extract("file", r"^([A-Za-z]+)_", 1)).alias("ticker"), "facts")


def index_rows(chunks: DataFrame, *more: str) -> DataFrame:
    """Text chunks as index rows: id and neighbours qualified by their source, scope from its name, text as it is embedded; ``more`` columns stay."""
    own = chunks.filter((F.col("chunk_type") == "text") & (T.clean_text(F.col("text")) != ""))
    who = scope.source_identity(F.col("source_file"))
    qualified = lambda c: scope.qualified_id(F.col("source_file"), F.col(c)).alias(c)
    return own.select(qualified("chunk_id"), T.embedding_text(F.col("text")).alias("content"), who["ticker"].alias("ticker"), who["fiscal_year"].alias("fiscal_year"), "source_file", "section_ref_id", "header_path", qualified("prev_id"), qualified("next_id"), *more)


def summary_rows(assets: DataFrame) -> DataFrame:
    """Tables with a successful summary as index rows (``table_id``, ``status``, ``summary``, ``source_file``)."""
    who = scope.source_identity(F.col("source_file"))
    own = assets.filter((F.col("status") == "success") & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    return own.select(F.concat_ws("::", "source_file", F.lit("table"), "table_id").alias("chunk_id"), T.caption_text(F.col("summary")).alias("content"), "table_id", who["ticker"].alias("ticker"), who["fiscal_year"].alias("fiscal_year"), "source_file")


def scoped(rows: DataFrame, tickers: list[str] | None = None, years: list[str] | None = None) -> DataFrame:
    """Rows of the wanted filings; values are canonical, so the predicate prunes partitions."""
    out = rows
    if tickers:
        out = out.filter(F.col("ticker").isin(*[t.strip().upper() for t in tickers]))
    if years:
        out = out.filter(F.col("fiscal_year").isin(*[y if (y := v.strip().upper()).startswith("FY") else f"FY{y}" for v in years]))
    return out


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def inlined(html: str, sources: dict[str, str]):
    """Image sources replaced by data URIs; those that have one or are unknown stay (a Column of ``html``)."""
    out = F.col(html)
    for src, data in sources.items():
        out = F.replace(out, F.lit(f'src="{src}"'), F.lit(f'src="{data}"'))
    return out


def with_css(html, css: str):
    """A style element before the first end of the head, else in front."""
    style = F.lit(f"<style>{css}</style>")
    return F.when(F.contains(F.lower(html), F.lit("</head>")), F.regexp_replace(html, r"(?i)(?s)^(.*?)(</head>)", f"$1<style>{css}</style>$2")).otherwise(F.concat(style, html))


def health(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Index size, rows without a ticker, rows of a generic source, validity and the first reason against it: one row, or one per ``keys``."""
    stats = rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("ticker", F.lit(""))) == "").alias("missing_ticker"), F.count_if(F.col("source_file") == "source.pdf").alias("stale"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("stale") > 0, "stale_source").when(F.col("missing_ticker") > 0, "missing_ticker")
    return stats.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
