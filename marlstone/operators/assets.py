"""Assets of filings: images, rescanned rows, header bands, refs, status of parses, counts and API rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import layout as L
from marlstone.operators import tables as TB


def images(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Image blocks of 80 by 60 points or more inside a section, with dense ids per file in page order."""
    own = blocks.withColumns({"width": F.col("bbox")[2] - F.col("bbox")[0], "height": F.col("bbox")[3] - F.col("bbox")[1]}).filter("width >= 80 and height >= 60")
    placed = own.withColumn("asset_id", F.concat_ws("/", "file", "page", "block_no"))
    found = L.section_of(placed.select("asset_id", "file", "page", F.lit(None).cast("double").alias("y0")), refs)
    w = Window.partitionBy("file").orderBy("page", "block_no")
    rows = placed.join(found, "asset_id")
    return rows.select("file", F.format_string("image_%03d", F.row_number().over(w)).alias("image_id"), "page", "bbox", F.round("width", 2).alias("width"), F.round("height", 2).alias("height"), "section_ref_id")


def payload(regions: DataFrame, lines: DataFrame, blocks: DataFrame, refs: DataFrame, heads: DataFrame) -> dict[str, DataFrame]:
    """The assets of documents: ``tables`` with dense ids in page order, ``images``, ``refs`` (table ids by section and subsection) and the ``counts`` of the table steps."""
    found, counts = TB.run_tables(regions, lines, refs, heads)
    placed = TB.relinked(found, refs, heads)
    return {"tables": placed, "images": images(blocks, refs), "refs": TB.unit_refs(placed), "counts": counts}


def rescanned(regions: DataFrame, lines: DataFrame, below: float = 36.0) -> DataFrame:
    """Regions whose rows on the word layer are more than the detector's: the first unbroken run of line items under their top.

    ``lines``: (``file``, ``page``, ``top``, ``cells``).  Only the rows change; regions the words don't improve stay.
    """
    near = regions.join(lines, (F.col("source_file") == F.col("file")) & (F.col("page_start") == F.col("page")) & F.col("top").between(F.col("bbox")[1] - 2, F.col("bbox")[3] + below))
    w = Window.partitionBy("source_file", "table_id").orderBy("top")
    item = TB.line_item_row(F.col("cells"))
    runs = near.withColumn("item", item).withColumn("run", F.sum(F.when(item & ~F.coalesce(F.lag("item").over(w), F.lit(False)), 1).otherwise(0)).over(w)).filter("item and run = 1")
    rows = runs.groupBy("source_file", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "cells"))), lambda x: x["cells"]).alias("new_rows"), F.max("top").alias("low"))
    joined = regions.join(rows, ["source_file", "table_id"], "left")
    better = F.coalesce(F.size("new_rows") > F.size("raw_rows"), F.lit(False)) & ~F.coalesce("header_only", F.lit(False))
    box = F.array(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[2], F.greatest(F.col("bbox")[3], F.round(F.col("low") + 12, 2)))
    return joined.withColumns({"bbox": F.when(better, box).otherwise(F.col("bbox")), "raw_rows": F.when(better, F.col("new_rows")).otherwise(F.col("raw_rows")), "rescanned": better}).drop("new_rows", "low")


def header_bands(lines: DataFrame, regions: DataFrame, page_height: float = 792.0, margin: float = 130.0) -> DataFrame:
    """Header rows at the bottom of a page that no region holds (they open a table on the next page).

    ``lines``: (``file``, ``page``, ``top``, ``cells``).
    """
    low = lines.filter((F.col("top") >= page_height - margin) & TB.header_row(F.col("cells")))
    box = regions.select(F.col("source_file").alias("f"), F.col("page_start").alias("p"), F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"))
    free = low.join(box, (F.col("file") == F.col("f")) & (F.col("page") == F.col("p")) & F.col("top").between(F.col("y0") - 2, F.col("y1") + 2), "left_anti")
    g = free.groupBy("file", "page").agg(F.array_sort(F.collect_list(F.struct("top", "cells"))).alias("x"))
    return g.select(F.col("file").alias("source_file"), "page", F.transform("x", lambda r: r["cells"]).alias("raw_rows"), F.element_at("x", 1)["top"].alias("top"), F.lit("table_header_band").alias("asset_type"))


def continuations(bands: DataFrame, lines: DataFrame, regions: DataFrame, reach: float = 160.0) -> DataFrame:
    """First data row at the top of the page after a header band, where no table starts above it."""
    top = lines.filter((F.col("top") <= reach) & TB.data_row(F.col("cells"))).groupBy("file", "page").agg(F.min_by("cells", "top").alias("cells"), F.min("top").alias("top"))
    starts = regions.filter(F.col("bbox")[1] < 150).select(F.col("source_file").alias("f"), F.col("page_start").alias("p"))
    rows = bands.select("source_file", (F.col("page") + 1).alias("next")).join(top, (F.col("source_file") == F.col("file")) & (F.col("next") == F.col("page")))
    return rows.join(starts, (F.col("source_file") == F.col("f")) & (F.col("next") == F.col("p")), "left_anti").select("source_file", F.col("next").alias("page"), F.array("cells").alias("raw_rows"), "top", F.lit("table_continuation").alias("asset_type"))


def to_parse(tables: DataFrame, ids: list[str] | None = None, min_page: int | None = None, without_items: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Tables to parse, in page order, the first ``n`` where a limit is asked for."""
    rows = tables
    if ids:
        rows = rows.filter(F.col("table_id").isin(*ids))
    if min_page is not None:
        rows = rows.filter(F.col("page_start") >= min_page)
    if without_items:
        rows = rows.filter(~F.coalesce("item", F.lit("")).isin(*without_items))
    rows = rows.orderBy("page_start", "table_id")
    return rows if n is None else rows.limit(n)


def carried_over(tables: DataFrame, earlier: DataFrame) -> DataFrame:
    """Tables with an earlier successful parse where they have none."""
    old = earlier.filter("status = 'success'").select("table_id", F.col("status").alias("old_status"), F.col("summary").alias("old_summary"))
    return tables.join(old, "table_id", "left").withColumns({"status": F.coalesce("status", "old_status"), "summary": F.coalesce("summary", "old_summary")}).drop("old_status", "old_summary")


def parse_status(tables: DataFrame) -> DataFrame:
    """Per source: tables, parsed, missing and failed ones."""
    total, done, none = F.count("*"), F.count_if(F.col("status") == "success"), F.count_if(F.col("status").isNull())
    return tables.groupBy("source_file").agg(total.alias("tables"), F.coalesce(done, F.lit(0)).alias("parsed"), F.coalesce(none, F.lit(0)).alias("missing"), (total - done - none).alias("failed"))


def parts(sections: DataFrame) -> DataFrame:
    """Sections under their parts, I to IV in order and then the unknown ones."""
    order = F.array_position(F.array(*map(F.lit, ["Part I", "Part II", "Part III", "Part IV"])), F.coalesce("part", F.lit("Unknown")))
    rows = sections.withColumn("place", F.when(order > 0, order).otherwise(99))
    return rows.groupBy("file", "place").agg(F.first(F.when(F.col("place") < 99, F.col("part")).otherwise("Unknown")).alias("part"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]).alias("items"))


def chunk_rows(chunks: DataFrame, n: int = 260) -> DataFrame:
    """Rows for display: a preview and the header path as one text."""
    return chunks.select("chunk_id", F.array_join("header_path", " > ").alias("header"), F.substring(T.clean_text(F.col("text")), 1, n).alias("preview"), F.coalesce("token_count", T.token_count(F.col("text"))).alias("token_count"))


def trace_rows(steps: DataFrame) -> DataFrame:
    """Steps of an agent (``run_id``, ``step``, ``tool``, ``input``, ``output``) as rows and as messages: the question, then call and observation of each step."""
    call = F.struct(F.lit("assistant").alias("role"), F.lit("tool_call").alias("kind"), "tool", F.col("input").alias("content"))
    seen = F.struct(F.lit("tool").alias("role"), F.lit("observation").alias("kind"), "tool", F.col("output").alias("content"))
    rows = steps.filter("tool <> 'final_answer'")
    return rows.select("run_id", "step", F.posexplode(F.array(call, seen)).alias("half", "m")).select("run_id", (F.col("step") * 2 + F.col("half") - 1).alias("pos"), "step", "m.role", "m.kind", "m.tool", "m.content")


def last_events(events: DataFrame, n: int = 80) -> DataFrame:
    """The last ``n`` events of each job, and its progress: thirds for finished steps, eight for a running one, at most 95 before the end."""
    w = Window.partitionBy("job_id").orderBy(F.desc("seq"))
    return events.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def progress(steps: DataFrame) -> DataFrame:
    done, running = F.count_if(F.col("state") == "done"), F.count_if(F.col("state") == "running")
    share = F.floor(100 * done / 3) + F.when(running > 0, 8).otherwise(0)
    return steps.groupBy("job_id").agg(F.when(done >= 3, 100).otherwise(F.least(share, F.lit(95))).cast("int").alias("percent"))


def enriched(files: DataFrame, audit: DataFrame, payloads: DataFrame) -> DataFrame:
    """Files (``file_id``, ``chunks``, ``tables``) with the state of their index and, where a count is missing, the one of their payload."""
    state = audit.select("file_id", F.col("valid").alias("index_ready"), F.col("reason").alias("index_reason"))
    other = payloads.select("file_id", F.col("chunks").alias("other_chunks"), F.col("tables").alias("other_tables"))
    joined = files.join(state, "file_id", "left").join(other, "file_id", "left")
    return joined.select("file_id", F.coalesce("chunks", "other_chunks", F.lit(0)).alias("chunks"), F.coalesce("tables", "other_tables", F.lit(0)).alias("tables"), F.coalesce("index_ready", F.lit(False)).alias("index_ready"), "index_reason")


def event_lines(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs as lines of events (``run_id``, ``pos``, ``line``): started, a start and an end for each step, done or error.

    ``steps``: ``run_id``, ``step``, ``tool``, ``size``; ``runs``: ``run_id``, ``error`` (null where the run ended well).
    """
    numbered = steps.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("step")))
    line = lambda *c: F.to_json(F.struct(*c))
    kind = lambda x: F.lit(x).alias("type")
    begun = numbered.select("run_id", (2 * F.col("n") - 1).alias("pos"), line(kind("step_start"), F.col("n").alias("step"), "tool").alias("line"))
    ended = numbered.select("run_id", (2 * F.col("n")).alias("pos"), line(kind("step"), F.col("n").alias("step"), "tool", "size").alias("line"))
    last = runs.join(numbered.groupBy("run_id").agg(F.max("n").alias("n")), "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = runs.select("run_id", F.lit(0).alias("pos"), line(kind("started")).alias("line"))
    done = F.when(F.col("error").isNull(), line(kind("done"), F.col("n").alias("steps"))).otherwise(line(kind("error"), "error"))
    return first.union(begun).union(ended).union(last.select("run_id", (2 * F.col("n") + 1).alias("pos"), done.alias("line")))
