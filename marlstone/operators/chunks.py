"""Text chunks: units in, linked chunks out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import chunker
from marlstone.functions import text as T

CHUNK_ID = "text_%05d"


def marker(table_id: Column) -> Column:
    return F.concat(F.lit("[[TABLE:"), table_id, F.lit("]]"))


def units(sections: DataFrame) -> DataFrame:
    """Text units of sections (``file``, ``section_id``, ``seq``, ``header``, ``preamble``, ``subs``): the preamble opens the first subsection, or is a unit itself."""
    rows = sections.select("file", "section_id", "seq", "header", "preamble", F.posexplode_outer("subs").alias("sub_pos", "sub"))
    lead = F.when(F.col("sub_pos").isNull() | (F.col("sub_pos") == 0), F.coalesce("preamble", F.lit(""))).otherwise("")
    body = F.concat_ws(" ", F.nullif(lead, F.lit("")), F.col("sub.text"))
    header = F.concat_ws(" > ", "header", F.col("sub.title"))
    unit = F.concat_ws("::", "section_id", F.coalesce(F.format_string("sub_%03d", F.col("sub_pos") + 1), F.lit("preamble")))
    return rows.select("file", "section_id", unit.alias("unit_id"), (F.col("seq") * 10_000 + F.coalesce("sub_pos", F.lit(0))).alias("unit_seq"), header.alias("header"), body.alias("body")).filter(T.clean_text(F.col("body")) != "")


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of units (``file``, ``section_id``, ``unit_id``, ``unit_seq``, ``header``, ``body``) with dense ids per file."""
    pieces = rows.select("file", "section_id", "unit_id", "unit_seq", "header", F.posexplode(chunker.chunk_udf("body", "header")).alias("split_index", "text"))
    order = Window.partitionBy("file").orderBy("unit_seq", "split_index")
    numbered = pieces.withColumn("seq", F.row_number().over(order))
    count = F.count("*").over(Window.partitionBy("file", "unit_id"))
    return numbered.select("file", F.format_string(CHUNK_ID, "seq").alias("chunk_id"), "seq", "section_id", "unit_id", "header", "text", T.token_count(F.col("text")).alias("token_count"), "split_index", count.alias("split_count"))


def linked(chunks: DataFrame) -> DataFrame:
    """Neighbours in the same unit and in the same section."""
    unit, section = (Window.partitionBy("file", k).orderBy("seq") for k in ("unit_id", "section_id"))
    return chunks.withColumns(
        {
            "unit_prev": F.lag("chunk_id").over(unit),
            "unit_next": F.lead("chunk_id").over(unit),
            "section_prev": F.lag("chunk_id").over(section),
            "section_next": F.lead("chunk_id").over(section),
            "is_continuation": F.row_number().over(unit) > 1,
        }
    )


def counters(chunks: DataFrame) -> DataFrame:
    """One row: chunks, long and short ones, those that continue a unit."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") > 500).alias("long"), F.count_if(F.col("token_count") < 100).alias("short"), F.count_if(F.col("split_index") > 0).alias("continued"))


def table_residue(c: Column) -> Column:
    """Whether a text reads like the rest of a flattened table: many numbers, few sentences."""
    words = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    ratio = F.size(F.filter(words, lambda x: x.rlike("[0-9]"))) / F.greatest(F.size(words), F.lit(1))
    ends = F.regexp_count(c, F.lit(r"[.!?](\s|$)"))
    return (F.size(words) >= 5) & (((ratio > 0.30) & (ends == 0)) | ((ratio > 0.22) & (ends < 3)))


def without_rows(body: Column, rows: Column) -> Column:
    """A body without the flattened rows of a table: cells in order, separated by white space."""
    def pattern(row: Column) -> Column:
        cells = F.filter(F.transform(row, lambda c: T.clean_text(c)), lambda c: c != "")
        return F.when(F.size(cells) >= 3, F.array_join(F.transform(cells, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), r"\s+"))

    return F.aggregate(F.filter(F.transform(rows, pattern), lambda p: p.isNotNull()), body, lambda acc, p: F.call_function("regexp_replace", acc, p, F.lit(" ")), lambda acc: T.clean_text(acc))


def anchored(chunks: DataFrame) -> DataFrame:
    """Tables marked in each chunk: ``table_anchors`` (id and place in the text), ids in order."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[TABLE:([^\]]+)\]\]"), F.lit(1)))
    return chunks.withColumn("table_anchors", F.transform(ids, lambda t: F.struct(t.alias("table_id"), F.locate(F.lit("[[TABLE:"), F.col("text")).alias("first"), F.call_function("position", marker(t), F.col("text")).alias("at"))))


def with_full_headers(chunks: DataFrame) -> DataFrame:
    """Chunks whose header path has no empty parts."""
    return chunks.withColumn("header_path", F.filter(F.coalesce("header_path", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Tables (``source_file``, ``table_id``, ``header_path``, ``raw_rows``, pages, ``bbox``) as chunks of their own, numbered in order."""
    body = F.array_join(F.transform("raw_rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("page_start", F.col("bbox")[1], "table_id"))
    return with_full_headers(tables.select("source_file", F.format_string("table_%05d", number).alias("chunk_id"), F.lit("table").alias("chunk_type"), "table_id", "header_path", body.alias("text"), T.token_count(body).alias("token_count"), "page_start", "page_end", "bbox"))


def image_chunks(images: DataFrame) -> DataFrame:
    """Images (``source_file``, ``image_id``, ``header_path``, ``page``, ``bbox``) as chunks: their header, page and place."""
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("page", "image_id"))
    place = F.concat(F.lit("Image/figure on page "), F.col("page").cast("string"), F.lit(" with bbox ["), F.array_join(F.transform("bbox", lambda x: x.cast("string")), ", "), F.lit("]."))
    own = with_full_headers(images).withColumn("text", T.clean_text(F.concat_ws("\n\n", F.array_join("header_path", " > "), place)))
    return own.select("source_file", F.format_string("image_%05d", number).alias("chunk_id"), F.lit("image").alias("chunk_type"), "image_id", "header_path", "text", T.token_count(F.col("text")).alias("token_count"), "page", "bbox")
