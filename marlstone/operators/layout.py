"""Page layout to sections and subsections: line records in, flat tables out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

TITLE_SIMILAR = 0.45
LINE_ORDER = ("page", "line_no")


def offsets(lines: DataFrame) -> DataFrame:
    """Character offset of each line in the full text, where every page opens with a marker line."""
    page_mark = F.length(F.concat(F.lit("\n\n[[PAGE "), F.col("page").cast("string"), F.lit("]]\n")))
    first = F.row_number().over(Window.partitionBy("file", "page").orderBy("line_no")) == 1
    rows = lines.withColumn("mark", F.when(first, page_mark).otherwise(0))
    before = F.sum(F.length("line") + 1 + F.col("mark")).over(Window.partitionBy("file").orderBy(*LINE_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", (F.coalesce(before, F.lit(0)) + F.col("mark")).cast("bigint")).drop("mark")


def gaps(lines: DataFrame) -> DataFrame:
    """Vertical distance to the line before and behind on the page."""
    w = Window.partitionBy("file", "page").orderBy(F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)))
    return lines.withColumns({"gap_before": F.col("y0") - F.lag("y1").over(w), "gap_after": F.lead("y0").over(w) - F.col("y1")})


def heading_score(height: Column) -> Column:
    """Points for what makes a line look like a heading: centred, in capitals, set apart."""
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) <= F.greatest(F.lit(48.0), 0.09 * F.col("page_width"))
    letters = F.length(F.regexp_replace("line", "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace("line", "[^A-Z]", "")) / F.greatest(letters, F.lit(1))
    apart = lambda c, k: F.when(F.col(c) > k * height, 1).otherwise(0)
    return F.when(centred, 2).otherwise(0) + F.when((letters > 0) & (capitals >= 0.85), 2).otherwise(0) + F.when((letters > 0) & (capitals >= 0.85), apart("gap_before", 1.25)).otherwise(apart("gap_before", 1.5)) + F.when((letters > 0) & (capitals >= 0.85), apart("gap_after", 1.25)).otherwise(apart("gap_after", 1.5))


def heading_noise(line: Column) -> Column:
    """Lines that never head a subsection: page numbers, table words, long lines, running text."""
    words = F.size(F.split(F.trim(line), r"\s+"))
    return F.trim(line).rlike(r"^[\d\s.,$%()|-]*$") | (words > 18) | (F.length(line) > 160) | F.lower(F.trim(line)).rlike(r"^(table of contents|form 10-[kq]|\(?in (millions|thousands|billions).*)$")


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Lines that can head a subsection, with score and level: 1 notes, 2 centred or bold, 3 italic, 4 other."""
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    scored = gaps(lines).withColumn("score", heading_score(height))
    short = F.size(F.split(F.trim("line"), r"\s+")) <= 12
    flag = (F.col("score") >= 4) | ((F.col("x0") <= 120) & (F.col("is_bold") | (F.col("is_italic") & short)))
    level = F.when(F.col("line").rlike(r"(?i)^note\s+\d+"), 1).when(F.col("is_bold") | (F.col("score") >= 4), 2).when(F.col("is_italic"), 3).otherwise(4)
    return scored.filter(flag & ~heading_noise(F.col("line")) & ~F.coalesce("is_toc", F.lit(False)) & ~(F.col("line").endswith(".") & ~F.col("is_bold"))).withColumn("level", level)


def toc_pages(lines: DataFrame) -> DataFrame:
    """Pages that hold a table of contents: many items beside many bare page numbers; lines without text don't count."""
    shown = lines.withColumn("line", T.clean_text(F.col("line"))).filter("line <> ''")
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("file", "page").orderBy("line_no")))
    item = F.lower("line").rlike(r"^item\s+\d+[a-z]?\b")
    stats = shown.groupBy("file", "page").agg(
        F.max((F.lower("line") == "table of contents") & (F.col("place") <= 8)).alias("titled"),
        F.count_if(item).alias("items"),
        F.count_if(item & (F.length("line") < 30)).alias("short_items"),
        F.count_if(F.col("line").rlike(r"^\d+$")).alias("numbers"),
    )
    enough = (F.col("titled") & (F.col("items") >= 4)) | ((F.col("items") >= 6) & (F.col("short_items") >= 4))
    return stats.filter(enough & (F.col("numbers") >= 4)).select("file", "page")


def toc_entries(lines: DataFrame) -> DataFrame:
    """(``file``, ``entry``, ``item``, ``toc_title``, ``toc_page``) from the lines of the contents pages, in order; a title may go on over any number of lines."""
    w = Window.partitionBy("file").orderBy(*LINE_ORDER)
    starts = F.lower("line").rlike(r"^item\s+\d+[a-z]?\b").cast("int")
    rows = lines.withColumn("entry", F.sum(starts).over(w)).filter("entry > 0")
    bare = F.trim("line").rlike(r"^\d+$")
    ordered = lambda c: F.array_sort(F.collect_list(c))
    got = rows.groupBy("file", "entry").agg(ordered(F.struct("page", "line_no", "line", bare.alias("bare"))).alias("x"))
    item = F.regexp_extract(F.element_at("x", 1)["line"], r"(?i)^(item\s+\d+[a-z]?)", 1)
    rest = F.regexp_replace(F.element_at("x", 1)["line"], r"(?i)^item\s+\d+[a-z]?[.:]?\s*", "")
    tail = F.transform(F.filter(F.slice("x", F.lit(2), F.size("x")), lambda r: ~r["bare"]), lambda r: r["line"])
    page = F.element_at(F.transform(F.filter("x", lambda r: r["bare"]), lambda r: F.trim(r["line"])), 1)
    return got.select("file", "entry", F.initcap(item).alias("item"), T.clean_text(F.concat_ws(" ", rest, F.array_join(tail, " "))).alias("toc_title"), page.cast("int").alias("toc_page"))


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of two titles in lower-case letters and digits; 1 where one holds the other."""
    x, y = (" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()) for t in (a, b))
    if not x or not y:
        return 0.0
    return 1.0 if x in y or y in x else SequenceMatcher(None, x, y).ratio()


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: str, b: str) -> Column:
    return F.pandas_udf(_similarities, "double")(a, b)


def matched_headings(entries: DataFrame, heads: DataFrame) -> DataFrame:
    """Contents entries matched to body headings, in order: of a later heading of the same item the most similar title, ties to the first.

    Each match limits the next, so a file (some twenty entries) is one fold.
    ``entries``: file, entry, item, toc_title; ``heads``: file, offset, page, item, title.
    """
    schema = "file string, entry bigint, item string, toc_title string, matched_title string, title_similarity double, match_status string, offset bigint, page int"

    def match(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at, out = -1, []
        right = right.sort_values("offset", kind="stable")
        for e in left.sort_values("entry").itertuples():
            own = [(similarity(e.toc_title, h.title), -h.offset, h) for h in right.itertuples() if h.offset > at and (h.item or "").lower() == (e.item or "").lower()]
            if not own:
                out.append((e.file, e.entry, e.item, e.toc_title, None, 0.0, "missing", None, None))
                continue
            score, _, best = max(own, key=lambda x: x[:2])
            at = best.offset
            out.append((e.file, e.entry, e.item, e.toc_title, best.title, score, "matched" if score >= TITLE_SIMILAR else "weak", best.offset, best.page))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        return frame.astype({"offset": "Int64", "page": "Int32"})

    return entries.groupBy("file").cogroup(heads.groupBy("file")).applyInPandas(match, schema)


def sections(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Sections (``file``, ``seq``, ``item``, ``title``, ``page``, ``start``, ``end``, ``text``): each ends where the next starts."""
    own = heads.filter("offset is not null").join(texts, "file")
    w = Window.partitionBy("file").orderBy("offset")
    end = F.coalesce(F.lead("offset").over(w), F.length("full_text").cast("bigint"))
    rows = own.withColumns({"end": end, "seq": F.row_number().over(w)})
    return rows.select("file", "seq", "item", F.col("toc_title").alias("title"), "page", F.col("offset").alias("start"), "end", T.clean_text(F.substring(F.col("full_text"), F.col("offset").cast("int") + 1, (F.col("end") - F.col("offset")).cast("int"))).alias("text"))


def subsections(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates inside a section with the end of their text and the path of the headings above them."""
    inside = own.select("file", F.col("seq").alias("section_seq"), "start", "end").join(candidates, "file").filter((F.col("offset") > F.col("start")) & (F.col("offset") < F.col("end")))
    w = Window.partitionBy("file", "section_seq").orderBy("offset")
    rows = inside.withColumn("sub_end", F.coalesce(F.lead("offset").over(w), F.col("end")))
    # for each level the last heading of it, dropped where a shallower one came later
    last = {k: F.last(F.when(F.col("level") == k, F.struct("offset", "line")), ignorenulls=True).over(w) for k in range(1, 5)}
    at = {k: F.coalesce(last[k]["offset"], F.lit(-1)) for k in last}
    above = {k: F.greatest(F.lit(-1), F.lit(-1), *[at[j] for j in range(1, k)]) for k in last}
    path = F.array_compact(F.array(*[F.when((F.col("level") >= k) & (at[k] > above[k]), last[k]["line"]) for k in last]))
    return rows.withColumn("path", path).select("file", "section_seq", F.row_number().over(w).alias("sub_seq"), F.col("line").alias("title"), "level", "page", "offset", "sub_end", "path")


def section_of(assets: DataFrame, refs: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Every asset (``asset_id``, ``file``, ``page``, ``y0``) with its section; null only where no section begins on its page or before.

    ``refs``: ``file``, ``section_ref_id``, ``start_offset``, ``start_page`` and
    perhaps ``end_page``; a section ends a page before the next one starts, on
    its own page at the earliest.  In this order:

    1. near the top of a page (``y0`` below 150), the last section that comes from the page before and goes on, else the last that ended there;
    2. where several sections start on the page, the first of them, and the last for a footer;
    3. the last section whose pages hold the asset, else the last that started before.

    A file has some twenty sections, so assets meet all of them and one
    aggregate per asset chooses.  Several rows of an asset count as one, whose
    ``y0`` is the first there is by ``pos``, or the least where assets have no
    ``pos``: the order in which rows arrive decides nothing.
    """
    if "pos" in assets.columns:
        rows = Window.partitionBy("asset_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        assets = assets.withColumn("y0", F.first("y0", ignorenulls=True).over(rows))
    w = Window.partitionBy("file").orderBy("start_offset", "section_ref_id")
    end = F.greatest(F.coalesce(F.lead("start_page").over(w) - 1, F.lit(1 << 30)), F.col("start_page"))
    spans = refs.select("file", "section_ref_id", "start_page", (F.coalesce("end_page", end) if "end_page" in refs.columns else end).alias("end_page"), F.row_number().over(w).alias("pos"))
    both = assets.select("asset_id", "file", "page", "y0").join(spans, "file", "left")
    page, first, last = F.col("page"), F.col("start_page"), F.col("end_page")
    latest = lambda test: F.max(F.when(test, F.struct("pos", "section_ref_id")))["section_ref_id"]
    earliest = lambda test: F.min(F.when(test, F.struct("pos", "section_ref_id")))["section_ref_id"]
    holds, here = (first <= page) & (page <= last), first == page
    found = both.groupBy("asset_id").agg(
        F.min("y0").alias("y0"),
        latest((first < page) & (last >= page)).alias("goes_on"),
        latest(last == page - 1).alias("ended"),
        F.count_if(here).alias("starts"),
        earliest(here & holds).alias("first_here"),
        latest(here & holds).alias("last_here"),
        latest(holds).alias("holds"),
        latest(first <= page).alias("before"),
    )
    top = F.when(F.col("y0") < 150, F.coalesce("goes_on", "ended"))
    several = F.when((F.col("starts") >= 2) & F.col("y0").isNotNull(), F.when(F.col("y0") >= 0.91 * page_height, F.col("last_here")).otherwise(F.col("first_here")))
    return found.select("asset_id", F.coalesce(top, several, "holds", "before").alias("section_ref_id"))


def heading_before(assets: DataFrame, heads: DataFrame) -> DataFrame:
    """As-of join: for each asset (``asset_id``, ``section_ref_id``, ``page``, ``y0``) the last heading (``sub_id``) at or before it, two points of slack.

    Both sides are one ordered stream; the last heading seen is carried along,
    so the cost is one sort however many headings a section has.
    """
    a = assets.select("section_ref_id", "page", (F.col("y0") + 2).alias("y"), F.lit(1).alias("side"), "asset_id", F.lit(None).cast("string").alias("sub_id"))
    h = heads.select("section_ref_id", "page", F.col("y0").alias("y"), F.lit(0).alias("side"), F.lit(None).cast(assets.schema["asset_id"].dataType).alias("asset_id"), F.col("sub_id").cast("string").alias("sub_id"))
    w = Window.partitionBy("section_ref_id").orderBy("page", "y", "side")
    return a.unionByName(h).withColumn("sub_id", F.last("sub_id", ignorenulls=True).over(w)).filter("side = 1").select("asset_id", "sub_id")


def record_of(headings: DataFrame, records: DataFrame) -> DataFrame:
    """Headings (``file``, ``offset``, ``page``, ``title``) with the place of their line record (``y0``, ``x0``): by offset and page, else by page and text; of several the first."""
    own = records.select("file", "page", "offset", "line", F.struct("line_no", "x0", "y0").alias("r"))
    by_offset = own.groupBy("file", "page", "offset").agg(F.min("r").alias("exact"))
    by_text = own.groupBy("file", "page", F.col("line").alias("title")).agg(F.min("r").alias("same"))
    found = headings.join(by_offset, ["file", "page", "offset"], "left").join(by_text, ["file", "page", "title"], "left")
    at = F.coalesce("exact", "same")
    return found.withColumns({"x0": at["x0"], "y0": at["y0"]}).drop("exact", "same")


def subsection_counts(own: DataFrame, subs: DataFrame, every: bool = False) -> DataFrame:
    """(``file``, ``item``, ``n``): subsections of each item; items without one only where ``every`` is asked for."""
    n = subs.groupBy("file", F.col("section_seq").alias("seq")).agg(F.count("*").alias("n"))
    rows = own.select("file", "seq", "item").join(n, ["file", "seq"], "left" if every else "inner")
    return rows.groupBy("file", "item").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def section_payload(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and subsections of documents given as line records (``schemas.LINE``).

    Contents pages are found and read, their entries matched to headings in the
    body, the text between them cut out, and what looks like a heading inside a
    section becomes a subsection with its path.
    """
    contents = toc_pages(lines)
    entries = toc_entries(lines.join(contents, ["file", "page"], "left_semi"))
    placed = offsets(lines).join(contents.withColumn("is_contents", F.lit(True)), ["file", "page"], "left")
    item = F.regexp_extract("line", r"(?i)^(item\s+\d+[a-z]?)\b", 1)
    body = placed.filter("is_contents is null")
    heads = body.filter(item != "").select("file", "offset", "page", F.initcap(item).alias("item"), F.col("line").alias("title"))
    # the text as the offsets count it: every page opens with a marker line
    opened = placed.withColumn("mark", F.when(F.row_number().over(Window.partitionBy("file", "page").orderBy("line_no")) == 1, F.concat(F.lit("\n\n[[PAGE "), F.col("page").cast("string"), F.lit("]]\n"))).otherwise(""))
    texts = opened.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, F.concat("mark", "line").alias("s")))), lambda x: x["s"]), "\n").alias("full_text"))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  (both sides come from the same lines)
    own = sections(matched_headings(fresh(entries), fresh(heads)), texts)
    candidates = heading_candidates(body).select("file", "line", "level", "page", "offset")
    return own, subsections(own, candidates)
