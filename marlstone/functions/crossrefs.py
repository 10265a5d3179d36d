"""Cross-references in filing text: a cue phrase and its target.

The target is the first kind of target, in the order of the table below, that a
cue allows and that stands in the ``WINDOW`` characters behind it (an article or
"our" at its start doesn't count).  What is "incorporated by reference" mostly
stands before its cue: there the last match counts, of four kinds of target, and
what is behind is looked at only if there is none.  Behind "refer to", a target
that a word of ``ELSEWHERE`` precedes is passed over.  A quoted heading is kept
for five cues; for others it ends the search without a reference.

Offsets are those of the target in the text; titles and headings take straight
and curly quotes; "table" is a word of its own.

Spark's expressions give no match offsets, so a text goes through one Arrow UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 220
SCHEMA = "array<struct<cue_type: string, target_type: string, target_label: string, raw_span: string, char_start: int, char_end: int, part: string, item: string, title: string>>"

# Cue phrases by name.
CUES = {
    "refer_to": r"refer(?:s|red|ring)?\s+to",
    "see": r"see(?:\s+also)?",
    "discussed_in": r"(?:as\s+)?discussed\s+in",
    "described_in": r"(?:as\s+)?described\s+in",
    "noted_in": r"(?:as\s+)?noted\s+in",
    "detailed_in": r"(?:as\s+)?detailed\s+in",
    "outlined_in": r"(?:as\s+)?outlined\s+in",
    "explained_in": r"(?:as\s+)?explained\s+in",
    "presented_in": r"presented\s+in",
    "set_forth_in": r"set\s+forth\s+in",
    "included_in": r"included\s+in",
    "found_in": r"found\s+in",
    "contained_in": r"contained\s+in",
    "read_in_conjunction_with": r"read\s+in\s+conjunction\s+with",
    "incorporated_by_reference": r"incorporated\s+(?:herein\s+)?by\s+reference",
    "pursuant_to": r"pursuant\s+to",
    "under_the_heading": r"under\s+the\s+heading",
    "in_accordance_with": r"in\s+accordance\s+with",
    "for_more_information": r"for\s+more\s+information\s+(?:on|about|regarding)",
    "described_under": r"(?:as\s+)?described\s+under",
    "discussed_under": r"(?:as\s+)?discussed\s+under",
}
_CUE = re.compile("|".join(rf"(?P<{name}>\b{pattern}\b)" for name, pattern in CUES.items()), re.I)

# Target patterns, the more specific first.
_PART, _ITEM, _NOTE = r"Part\s+(?:[IVXLC]+|\d+)", r"Item\s+\d+[A-Z]?", r"Note\s+\d+\s*(?:[–—:-]\s*[^.;,(]+)?"
_NOTES = r"(?:the\s+)?Notes?\s+to\s+(?:the\s+)?(?:Consolidated\s+)?Financial\s+Statements?"
_QUOTES = '"“”'
_TARGETS = {
    "note_with_location": rf"(?P<label>{_NOTE})\s+of\s+(?:the\s+)?{_NOTES}(?:\s*\(\s*(?P<part>{_PART})\s*,\s*(?P<item>{_ITEM})[^)]*\))?",
    "note_simple": rf"(?P<label>{_NOTE})(?:\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements)?",
    "notes_block": rf"(?P<label>{_NOTES})",
    "proxy_statement": r"(?P<label>(?:the\s+)?(?:\d{4}\s+)?(?:Definitive\s+)?Proxy\s+Statement)",
    "part_item_with_title": rf"(?P<part>{_PART})\s*,\s*(?P<item>{_ITEM})(?:\s*,\s*[{_QUOTES}](?P<title>[^{_QUOTES}]+)[{_QUOTES}])?",
    "item_with_form": rf"(?P<item>{_ITEM})\s+of\s+(?:this\s+)?(?:Form\s+10-[KQ]|Annual\s+Report)",
    "part_item": rf"(?P<part>{_PART})\s*,\s*(?P<item>{_ITEM})",
    "prior_report": rf"(?P<label>[^{_QUOTES}]{{10,160}}?(?:Annual\s+Report\s+on\s+Form\s+10-K|Form\s+10-K)[^{_QUOTES}]{{0,80}})",
    "item_only": rf"(?P<item>{_ITEM})",
    "part_only": rf"(?P<part>{_PART})",
    "exhibit": r"(?P<label>Exhibit\s+\d+(?:\.\d+)?)",
    "schedule": r"(?P<label>Schedule\s+(?:[IVXLC]+|\d+))",
    "appendix": r"(?P<label>Appendix\s+[A-Z0-9]+)",
    "section": r"(?P<label>Section\s+\d+(?:\([a-z]\))?)",
    "table": r"(?P<label>(?:the\s+)?(?:following\s+)?\btable\b(?:\s+\d+)?)",
    "form": r"(?P<label>(?:this\s+)?(?:Form\s+10-[KQ]|Annual\s+Report\s+on\s+Form\s+10-K))",
    "heading": rf"(?:under\s+the\s+heading\s+)?(?P<label>[{_QUOTES}][^{_QUOTES}]{{3,120}}[{_QUOTES}])",
}
_COMPILED = {name: re.compile(pattern, re.I) for name, pattern in _TARGETS.items()}

_ITEMS = {"part_item_with_title", "part_item", "item_only"}
_NOTES_TARGETS = {"note_with_location", "note_simple", "notes_block"}
_LOCATIONS = _NOTES_TARGETS | _ITEMS | {"item_with_form", "part_only", "form", "proxy_statement", "prior_report", "heading"}
# Targets a cue can have; other cues have any.
ALLOWED = {
    "refer_to": _NOTES_TARGETS | _ITEMS | {"item_with_form", "exhibit", "schedule", "section", "table", "proxy_statement", "form", "prior_report"},
    "see": _NOTES_TARGETS | _ITEMS | {"item_with_form", "exhibit", "section", "table", "heading"},
    "under_the_heading": {"heading"},
    "pursuant_to": _ITEMS | {"section"},
    "in_accordance_with": _ITEMS | {"section"},
    "incorporated_by_reference": {"proxy_statement", "form", "exhibit", "prior_report", "part_item_with_title"},
} | {cue: _LOCATIONS for cue in ("included_in", "found_in", "contained_in", "presented_in", "set_forth_in", "read_in_conjunction_with")}


# Targets that may stand before their cue, cues that keep a heading, words that lead out of the filing, and how a window can open.
BEFORE = {"proxy_statement", "form", "exhibit", "prior_report"}
KEEP_HEADING = {"under_the_heading", "see", "discussed_in", "described_in", "noted_in"}
ELSEWHERE = ("website", "our ", "each ", "those ")
_OPENING = re.compile(r"\s*(?:the|our|Company(?:'s)?|Registrant(?:'s)?)\s+", re.I)


def _squeezed(text: str | None) -> str | None:
    return None if text is None else " ".join(text.strip(" ,;.").split())


def _behind(text: str, cue: re.Match[str]) -> tuple[str, re.Match[str]] | None:
    end = min(len(text), cue.end() + WINDOW)
    opening = _OPENING.match(text, cue.end(), end)
    begin = opening.end() if opening else cue.end()
    allowed = ALLOWED.get(cue.lastgroup, _COMPILED.keys())
    for name in (n for n in _COMPILED if n in allowed):
        found = _COMPILED[name].search(text, begin, end)
        if found and not (cue.lastgroup == "refer_to" and any(w in text[begin : found.start()].lower() for w in ELSEWHERE)):
            return name, found
    return None


def _ahead(text: str, cue: re.Match[str]) -> tuple[str, re.Match[str]] | None:
    begin = max(0, cue.start() - WINDOW)
    last = {name: [*pattern.finditer(text, begin, cue.start())][-1:] for name, pattern in _COMPILED.items() if name in BEFORE}
    return next(((name, found[0]) for name, found in last.items() if found), None)


def extract(text: str | None) -> list[dict]:
    """References of a text in order of their cues, each target once."""
    out: dict[tuple, dict] = {}
    for cue in _CUE.finditer(text or ""):
        kind = cue.lastgroup
        ahead = _ahead(text, cue) if kind == "incorporated_by_reference" else None
        found = ahead or _behind(text, cue)
        if found is None or (found[0] == "heading" and kind not in KEEP_HEADING):
            continue
        name, m = found
        groups = m.groupdict()
        label = _squeezed(next((groups[g] for g in ("label", "item", "part") if groups.get(g)), m.group()))
        span = text[max(0, m.start() - 20) : cue.start() + 40] if ahead else text[max(0, m.start() - 40) : m.end() + 40]
        record = {"cue_type": kind, "target_type": name, "target_label": label, "raw_span": _squeezed(span), "char_start": m.start(), "char_end": m.end()}
        out.setdefault((m.start(), m.end(), label.lower()), record | {g: _squeezed(groups.get(g)) for g in ("part", "item", "title")})
    return list(out.values())


def _references(text: pd.Series) -> pd.Series:
    return pd.Series([extract(t) for t in text])


def extract_udf(text: str) -> Column:
    return F.pandas_udf(_references, SCHEMA)(text)


def summary(refs: DataFrame, column: str = "cross_refs") -> DataFrame:
    """(``kind``, ``name``, ``n``): references by cue and by target, most frequent first."""
    each = refs.select(F.explode(column).alias("r"))
    both = each.select(F.lit("cue").alias("kind"), F.col("r.cue_type").alias("name")).union(each.select(F.lit("target").alias("kind"), F.col("r.target_type").alias("name")))
    return both.groupBy("kind", "name").agg(F.count("*").alias("n")).orderBy("kind", F.desc("n"), "name")
