"""The retrieval pipeline: one attempt, confidence, a rewritten attempt, context, and the fallback ladder around it.

Models (embedding, scoring, rewriting, answering) are injected callables;
:mod:`marlstone.plans.models` has deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import retrieval as R
from marlstone.store import materialise


@dataclass(frozen=True)
class Settings:
    vector_k: int = 10
    bm25_k: int = 10
    rerank_n: int = 3
    contexts: int = 10
    table_k: int = 8
    table_threshold: float = 0.60
    tables: int = 3
    rerank_threshold: float = 0.60


@dataclass
class Index:
    """Chunks (``doc_id``, ``content``, ``embedding``) and tables (``table_key``, ``caption``, ``embedding``)."""

    chunks: DataFrame
    tables: DataFrame | None = None


def attempt(index: Index, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame], s: Settings = Settings()) -> dict[str, DataFrame]:
    """Hits of a batch of queries (``query_id``, ``query``, ``query_vector``): merged, reranked, tables above the threshold."""
    vector = R.vector_topk(index.chunks, queries, s.vector_k, "doc_id")
    bm25 = R.bm25_topk(index.chunks, queries, F.col("content"), s.bm25_k)
    merged = materialise(R.hybrid_merge(vector, bm25), "hits")  # some hits per query, read by several steps
    pairs = merged.join(index.chunks.select("doc_id", "content"), "doc_id").join(R.small(queries.select("query_id", "query")), "query_id")
    anchors = materialise(R.reranked(merged, scorer(pairs), s.rerank_n), "anchors")
    tables = index.tables
    hits = None if tables is None else materialise(R.above_threshold(R.vector_topk(tables, queries, s.table_k, "table_key"), s.table_threshold), "table-hits")
    return {"merged": merged, "anchors": anchors} | ({} if hits is None else {"tables": hits})


def retrieve(index: Index, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame] | None = None, s: Settings = Settings()) -> dict[str, DataFrame]:
    """First attempt; queries with weak text and weak tables are rewritten and asked again, the better attempt counts."""
    first = attempt(index, queries, scorer, s)
    empty = first["anchors"].limit(0)
    sure = R.confidence(first["anchors"], first.get("tables", empty), queries, s.rerank_threshold, s.table_threshold)
    if rewrite is None:
        return first | {"confidence": sure}
    again = queries.join(sure.filter("should_retry").select("query_id"), "query_id", "left_semi")
    second = attempt(index, rewrite(again), scorer, s)
    pick = R.better_attempt(first["merged"], second["merged"])
    chosen = lambda name: first[name].join(pick.filter("attempt = 'first'").select("query_id"), "query_id", "left_semi").unionByName(second[name].join(pick.filter("attempt = 'retry'").select("query_id"), "query_id", "left_semi"))
    return {name: chosen(name) for name in first} | {"confidence": sure, "attempts": pick}


INSUFFICIENT = ("insufficient", "not found in the", "no relevant", "does not contain", "do not contain", "cannot determine")


def insufficient(text: str) -> bool:
    """Whether an answer says that its context doesn't hold it."""
    low = (text or "").lower()
    return not low.strip() or any(m in low for m in INSUFFICIENT)


@dataclass
class Outcome:
    status: str
    answer: str = ""
    trace: list[dict[str, Any]] = field(default_factory=list)


def ask(question: str, tickers: list[str], year: str | None, available: list[str], run: Callable[[str, list[str], str | None], str], rewrite: Callable[[str], str] | None = None) -> Outcome:
    """The fallback ladder: several tickers are asked apart; an insufficient answer is tried once rewritten, then in the newest filing."""
    if len(tickers) > 1:
        return Outcome("needs_decomposition", trace=[{"reason": "several tickers"}])
    trace: list[dict[str, Any]] = []
    newest = max(available, key=lambda y: int("".join(filter(str.isdigit, y)) or 0), default=None)
    steps: list[tuple[str, str, str | None]] = [("first", question, year)]
    if rewrite is not None:
        steps.append(("rewritten", rewrite(question), year))
    if newest and newest != year:
        steps.append(("newest_filing", question, newest))
    for k, (name, text, scope) in enumerate(steps):
        try:
            said = run(text, tickers, scope)
        except Exception as error:  # a failed tool is an outcome, not a crash
            return Outcome("error", str(error), trace)
        trace.append({"step": name, "fiscal_year": scope, "insufficient": insufficient(said)})
        if not insufficient(said):
            return Outcome("fallback_success" if k else "success", said, trace)
    return Outcome("insufficient_context", said, trace)
