"""Filing scope: tickers, fiscal years, items and where a question should be answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticker(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def fiscal_year(c: Column) -> Column:
    """``2025`` and ``fy2025`` to ``FY2025``; empty to null."""
    own = F.upper(F.trim(c))
    return F.when(own.rlike("^[0-9]{4}$"), F.concat(F.lit("FY"), own)).otherwise(F.nullif(own, F.lit("")))


def scope_list(c: Column, one) -> Column:
    """A comma-separated list, each part normalised by ``one``; null where nothing is left."""
    parts = F.filter(F.transform(F.split(c, ","), one), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, parts)


def one_scope(tickers: Column, years: Column) -> tuple[Column, Column]:
    """Status of a scope, and the year that is kept: several tickers have to be asked apart, several years drop the filter."""
    status = F.when(F.size(tickers) > 1, "needs_decomposition").otherwise("ok")
    return status, F.when(F.size(years) == 1, F.element_at(years, 1))


def source_identity(c: Column) -> Column:
    """Ticker and fiscal year in a source file name such as ``ABC_FY2025_10-K.pdf``."""
    found = r"(?i)^([A-Za-z]+)_FY([0-9]{4})_"
    name = F.nullif(F.upper(F.regexp_extract(c, found, 1)), F.lit(""))
    year = F.nullif(F.regexp_extract(c, found, 2), F.lit(""))
    return F.struct(name.alias("ticker"), F.when(year.isNotNull(), F.concat(F.lit("FY"), year)).alias("fiscal_year"))


def resolved_source(name: Column, original: Column, meta: Column) -> Column:
    """A generic ``source.pdf`` gives way to the original name, then to the one in the metadata."""
    generic = F.lower(name) == "source.pdf"
    return F.when(generic, F.coalesce(F.nullif(original, F.lit("")), F.nullif(meta, F.lit("")), name)).otherwise(name)


def qualified_id(source: Column, own: Column) -> Column:
    return F.when(own.isNull() | F.contains(own, F.lit("::")), own).otherwise(F.concat_ws("::", source, own))


def renamed(c: Column, old: str, new: str) -> Column:
    """A source name, or an id qualified by it, moved to a new name."""
    return F.when(c == old, F.lit(new)).when(c.startswith(f"{old}::"), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c)


def metric_years(question: Column) -> Column:
    """Distinct years 20xx in a question, ascending."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def year_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, "([0-9]{4})", 1), F.lit("")).cast("int")


def newest(available: Column) -> Column:
    """The filing label with the largest year."""
    ranked = F.array_sort(F.transform(F.filter(available, lambda x: x.rlike("[0-9]{4}")), lambda x: F.struct(year_number(x).alias("year"), x.alias("label"))))
    return F.when(F.size(ranked) > 0, F.element_at(ranked, -1)["label"])


def filing_year(question: Column, requested: Column, available: Column) -> Column:
    """(``resolved``, ``reason``): which indexed filing answers a question.

    A filing reports earlier years too.  The newest one is taken where the
    requested filing is not indexed, where the earliest year asked for has no
    filing of its own, and where that year lies before the requested filing.
    """
    wanted, top, years = fiscal_year(requested), newest(available), metric_years(question)
    target = F.array_min(years)
    numbers = F.transform(available, year_number)
    older = wanted.isNull() | (wanted != top)
    reason = (
        F.when(top.isNull(), F.lit(None).cast("string"))
        .when(wanted.isNotNull() & ~F.array_contains(available, wanted), "requested_filing_not_indexed")
        .when(target.isNull(), F.lit(None).cast("string"))
        .when(~F.array_contains(numbers, target) & older, "metric_year_not_indexed_as_filing")
        .when((target < year_number(wanted)) & older, "metric_year_older_than_filing_scope")
    )
    return F.struct(F.when(reason.isNotNull(), top).otherwise(wanted).alias("resolved"), reason.alias("reason"))


def item_parts(item: Column) -> Column:
    """Number and letter of an item: ``Item 1A`` to (1, A)."""
    return F.struct(F.nullif(F.regexp_extract(F.trim(item), r"(?i)^item\s+(\d+)([A-Z]?)$", 1), F.lit("")).alias("number"), F.nullif(F.upper(F.regexp_extract(F.trim(item), r"(?i)^item\s+(\d+)([A-Z]?)$", 2)), F.lit("")).alias("letter"))


def part_of_item(item: Column) -> Column:
    n = item_parts(item)["number"].cast("int")
    return F.when(n <= 4, "Part I").when(n <= 9, "Part II").when(n <= 14, "Part III").when(n <= 16, "Part IV")


def header_path(part: Column, item: Column, title: Column) -> Column:
    """Part, item family, lettered item under its family, title; what is missing is left out."""
    own = item_parts(item)
    family = F.when(own["number"].isNotNull(), F.concat(F.lit("Item "), own["number"])).otherwise(item)
    lettered = F.when(own["letter"].isNotNull(), F.concat(F.lit("Item "), own["number"], own["letter"]))
    name = F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit(""))
    tail = F.when(own["letter"].isNull() & own["number"].isNotNull(), F.coalesce(name, item)).otherwise(name)
    return F.filter(F.array(part, family, lettered, tail), lambda x: x.isNotNull() & (x != ""))


def header_text(path: Column) -> Column:
    return F.array_join(F.array_distinct(path), " > ")
