"""Bodies of text chunks: flattened tables out, markers in; and the text around markers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = re.compile(r"\[\[TABLE:([^\]]+)\]\]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CLEANED = "struct<body: string, anchors: array<struct<table_id: string, char_offset: int, marker: string>>, table_refs: array<string>>"


def flat(text: str | None) -> str:
    return " ".join((text or "").replace(" ", " ").split())


def sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE.split(text.strip()) if s.strip()]


def closed(prefix: str) -> str:
    """The narrative before a table, ended with a full stop."""
    prefix = re.sub(r"\(\s*$", "", prefix.rstrip(" ,;:-")).rstrip(" ,;:-")
    return prefix if not prefix or prefix.endswith(".") else prefix + "."


def numeric_rows(table: list) -> list[list[str]]:
    """Rows that can be recognised in running text: three cells at least, two of them with digits."""
    rows = [[flat(c) for c in row if flat(c)] for row in table or []]
    return [r for r in rows if len(r) >= 3 and sum(bool(re.search(r"\d", c)) for c in r) >= 2]


def table_start(body: str, table: list) -> int | None:
    """Where the first recognisable row, or the row of headers before it, begins in the text."""
    low = body.lower()
    for row in [[flat(c) for c in r if flat(c)] for r in table or []]:
        if len(row) >= 2:
            for width in sorted({min(5, len(row)), 3, 2} - {0}, reverse=True):
                at = low.find(" ".join(row[:width]).lower()) if len(row) >= width else -1
                if at >= 0:
                    return at
    return None


def residue(text: str) -> bool:
    """What is left of a flattened table: many numbers, few sentences."""
    words = text.split()
    ratio = sum(bool(re.search(r"\d", w)) for w in words) / max(len(words), 1)
    ends = len(re.findall(r"[.!?](?:\s|$)", text))
    return len(words) >= 5 and ((ratio > 0.30 and ends == 0) or (ratio > 0.22 and ends < 3))


def cleaned(body: str | None, heading: str | None, tables: list[tuple[str, list]]) -> tuple[str, list[tuple[str, int, str]], list[str]]:
    """A body without its tables: text, anchors (id, offset of the marker in the text, marker), ids.

    One table ends the text where it starts; with several, the narrative between
    them stays and each is replaced by its marker.  Offsets are those of the
    returned text.
    """
    text, head = flat(re.sub(r"\[\[PAGE\s+\d+\]\]", " ", body or "")), flat(heading)
    if head and text.lower().startswith(head.lower()):
        text = flat(text[len(head) :])
    starts = sorted((at, key, rows) for key, rows in tables if (at := table_start(text, rows)) is not None)
    if not starts:
        return ("", [], []) if residue(text) else (text, [], [])
    parts, cursor = [], 0
    for n, (at, key, rows) in enumerate(starts):
        before = closed(text[cursor:at]) if at > cursor else ""
        if before and not residue(before):
            parts.append(before)
        parts.append(f"[[TABLE:{key}]]")
        cursor = at
        if len(starts) > 1:
            stop = starts[n + 1][0] if n + 1 < len(starts) else len(text)
            for row in numeric_rows(rows):
                hit = re.compile(r"\s+".join(map(re.escape, row))).search(text, cursor, stop)
                cursor = max(cursor, hit.end()) if hit else cursor
    if len(starts) > 1 and (tail := flat(text[cursor:])) and not residue(tail):
        parts.append(tail)
    out = flat(" ".join(parts))
    anchors = [(key, out.find(f"[[TABLE:{key}]]"), f"[[TABLE:{key}]]") for _, key, _ in starts]
    return out, anchors, [key for _, key, _ in starts]


def around_markers(content: str | None, wanted: list[str] | None = None, n: int = 2) -> str:
    """The sentences next to the wanted markers; the whole text where it has none of them."""
    text, parts, cursor = content or "", [], 0
    for m in MARK.finditer(text):
        if wanted is not None and len(wanted) and m[1] not in wanted:
            continue
        parts.append(" ".join([*sentences(text[cursor : m.start()])[-n:], m[0], *sentences(text[m.end() :])[:n]]))
        cursor = m.end()
    return " ".join(parts) if parts else text


def _clean(body: pd.Series, heading: pd.Series, tables: pd.Series) -> pd.DataFrame:
    rows = [cleaned(b, h, [(x["table_id"], [list(r) for r in x["raw_rows"]]) for x in (t if t is not None else [])]) for b, h, t in zip(body, heading, tables, strict=True)]
    return pd.DataFrame({"body": [r[0] for r in rows], "anchors": [[{"table_id": k, "char_offset": at, "marker": m} for k, at, m in r[1]] for r in rows], "table_refs": [r[2] for r in rows]})


def clean_udf(body: str, heading: str, tables: str) -> Column:
    """``tables``: array<struct<table_id, raw_rows>> of the unit."""
    return F.pandas_udf(_clean, CLEANED)(body, heading, tables)


def _around(content: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([around_markers(c, None if w is None else list(w)) for c, w in zip(content, wanted, strict=True)])


def around_udf(content: str, wanted: str) -> Column:
    return F.pandas_udf(_around, "string")(content, wanted)
