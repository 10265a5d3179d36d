"""Captions of tables: masking of numbers, topic wording, the section path in front."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as T

# How amounts and numbers are written, and openings that say nothing.
AMOUNT = r"(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand|m|b))?"
NUMBER = r"\(?[\d,]+(?:\.\d+)?\)?%?"
PERCENT = r"\(?[\d,]+(?:\.\d+)?\)?%"
BOILERPLATE = [
    r"^(?:the\s+)?table\s+(?:presents|shows|displays|contains|summarizes|lists)\b",
    r"^key financial performance metrics\b",
    r"^financial performance metrics\b",
]
HEADINGS = r"(?i)\b(SUMMARY RESULTS OF OPERATIONS|RESULTS OF OPERATIONS|OPERATING EXPENSES|REPORTABLE SEGMENTS)\b"
GROWTH = r"(?i)(?:growth across each of our segments|summary results of operations)"
UNIT = r"(?i)^\(?In (?:millions|thousands)"
COMPARES = r"(?i)\b(?:vs\.?|compared|change|comparison|expenses|operations|revenue|income)\b"


def masked_context(c: Column) -> Column:
    """A sentence without its figures: amounts and numbers by placeholders (a year is a number, and so is a bare comma)."""
    return T.clean_text(F.regexp_replace(F.regexp_replace(T.clean_text(c), AMOUNT, "[amount]"), NUMBER, "[num]"))


def plain_topic(c: Column) -> Column:
    """A topic without amounts and percentages; fiscal years stay."""
    bare = F.regexp_replace(F.regexp_replace(T.clean_text(c), AMOUNT, " "), PERCENT, " ")
    return F.regexp_replace(T.clean_text(bare), r"^[ ,;:.]+|[ ,;:.]+$", "")


def summary(path: Column, topic: Column) -> Column:
    """Section path, a middle dot, topic; one of them where the other is empty."""
    return F.concat_ws(" · ", F.nullif(T.clean_text(path), F.lit("")), F.nullif(plain_topic(topic), F.lit("")))


def year_pair(c: Column) -> Column:
    """(``newer``, ``older``): the years of a comparison phrase, else the two latest years between 2010 and 2035."""
    phrase = r"(?i)Fiscal Year (\d{4}) Compared with Fiscal Year (\d{4})"
    years = F.sort_array(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda x: x.cast("int")), lambda y: y.between(2010, 2035))), asc=False)
    said = F.struct(F.regexp_extract(c, phrase, 1).alias("newer"), F.regexp_extract(c, phrase, 2).alias("older"))
    found = F.struct(F.get(years, F.lit(0)).cast("string").alias("newer"), F.get(years, F.lit(1)).cast("string").alias("older"))
    return F.when(c.rlike(phrase), said).when(F.size(years) >= 2, found)


def with_years(topic: Column, corpus: Column) -> Column:
    """A topic that compares, with its years; one that names a year stays."""
    text, pair = T.clean_text(topic), year_pair(F.coalesce(corpus, F.lit("")))
    tail = F.concat(F.lit("FY"), pair["newer"], F.lit(" vs FY"), pair["older"])
    filled = F.call_function("regexp_replace", text, F.lit(r"(?i)\bFY\s*vs\.?\s*FY\b"), tail)
    return F.when(text.rlike(r"\b20\d{2}\b") | pair.isNull(), text).when(filled.rlike(r"\bFY20\d{2}\b"), filled).when(text.rlike(COMPARES), F.concat_ws(" ", text, tail)).otherwise(text)


def row_labels(rows: Column, n: int = 5) -> Column:
    """First cells that name a row: no amounts, bare numbers or units."""
    first = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: T.clean_text(r[0]))
    return F.slice(F.filter(first, lambda c: (c != "") & ~c.startswith("$") & ~c.rlike(r"^[\d(,]+$") & ~c.rlike(UNIT)), 1, n)


def weak_topic(c: Column) -> Column:
    """Topics too general to find a table by."""
    text = F.coalesce(c, F.lit(""))
    short = (F.size(F.split(F.trim(text), r"\s+")) <= 4) & text.rlike(r"(?i)fy20\d{2}")
    return (text == "") | text.rlike(r"(?i)\bfinancial table\b$") | short


def boilerplate(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return functools.reduce(Column.__or__, [text.rlike(f"(?i){p}") for p in BOILERPLATE])


def markdown_labels(markdown: Column, n: int = 10) -> Column:
    """The first cells of a markdown table's rows, figures masked, each once."""
    rows = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), F.trim), lambda x: F.startswith(x, F.lit("|")) & ~F.contains(x, F.lit("---")))
    cells = F.transform(rows, lambda x: F.get(F.filter(F.transform(F.split(x, r"\|"), F.trim), lambda c: c != ""), F.lit(0)))
    labels = F.transform(F.filter(cells, lambda c: c.isNotNull()), masked_context)
    return F.slice(F.array_distinct(F.filter(labels, lambda c: (c != "") & ~F.startswith(c, F.lit("(")))), 1, n)


def inferred_topic(rows: Column, corpus: Column) -> Column:
    """A topic from a table's row labels, the heading near it and the years around it; empty where no row has a label.

    Tables of results are named as such, with what they are about; tables of
    expenses by their first label; all others by their first label alone.
    """
    labels, near = row_labels(rows), F.coalesce(corpus, F.lit(""))
    low = F.transform(labels, F.lower)
    has = lambda word: F.exists(low, lambda x: F.contains(x, F.lit(word)))
    years = year_pair(near)
    tail = F.when(years.isNotNull(), F.concat(F.lit(" FY"), years["newer"], F.lit(" vs FY"), years["older"])).otherwise("")
    heading = F.upper(F.regexp_extract(near, HEADINGS, 1))
    theme = F.when(has("revenue") & has("margin"), "revenue, margins, and earnings").when(has("expense"), F.array_join(F.slice(low, 1, 2), " and ")).when(F.size(low) >= 2, F.array_join(F.slice(low, 1, 3), ", ")).when(F.size(low) == 1, F.get(low, F.lit(0))).otherwise("key metrics")
    results = F.concat(F.lit("consolidated summary results of operations with "), theme, tail)
    behind = F.exists(F.slice(low, F.lit(2), F.greatest(F.size(low), F.lit(1))), lambda x: F.contains(x, F.lit("percent")) | F.contains(x, F.lit("revenue")))
    expenses = F.concat(F.get(low, F.lit(0)), F.when(behind, " operating expenses and percent of revenue").otherwise(" operating expenses"), tail)
    money = has("revenue") & (near.rlike(GROWTH) | ((F.size(low) >= 3) & has("gross margin")) | has("operating income") | has("net income") | has("diluted earnings"))
    named = F.concat(F.get(labels, F.lit(0)), tail)
    return T.clean_text(F.when(heading == "SUMMARY RESULTS OF OPERATIONS", results).when((heading == "OPERATING EXPENSES") & (F.size(low) > 0), expenses).when(money, results).otherwise(F.coalesce(named, F.lit(""))))
