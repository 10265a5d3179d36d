"""Guarded SQL: one read-only SELECT over allowed tables, checked on the parsed plan.

The check walks the plan that Spark's parser makes, so comma joins and
subqueries are seen, and ``EXTRACT(YEAR FROM d)`` or a literal with ``from`` in
it is not taken for a table.  Only relational steps on a list are allowed: a
common table expression anywhere, a table function, an inline table or a
statement is none of them.  Functions are allowed by list, so no statement can
call Java, read a file or see the session's settings.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import SparkSession

CANNOT = "CANNOT_ANSWER"
MAX_ROWS, ATTEMPTS = 1000, 3
TABLES = ("companies", "income_statements", "balance_sheets", "segment_revenue", "geographic_revenue")
# Statements that are never allowed.
FORBIDDEN = "ALTER ANALYZE ATTACH BEGIN COMMIT CREATE DELETE DETACH DROP INSERT PRAGMA REINDEX REPLACE ROLLBACK SAVEPOINT TRUNCATE UPDATE VACUUM".split()

# Steps of a parsed plan, and functions, that a statement may have.
STEPS = "Aggregate Deduplicate Distinct Except Filter GlobalLimit Intersect Join LocalLimit Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedRelation UnresolvedSubqueryColumnAliases WithWindowDefinition".split()
FUNCTIONS = set(
    "abs any_value avg bigint bround cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist date date_add date_diff date_format date_part date_sub "
    "date_trunc datediff day dayofmonth decimal dense_rank div double endswith every exp extract first first_value float floor format_number format_string greatest if iff ifnull initcap instr int isnotnull isnull lag last last_value "
    "lead least left length listagg ln locate log log10 lower lpad ltrim make_date max max_by mean median min min_by mod month nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_cont percentile_disc pmod position "
    "pow power printf quarter rank regexp_like regexp_replace replace reverse right round row_number rpad rtrim sign signum some split_part sqrt startswith std stddev stddev_pop stddev_samp string string_agg substr substring "
    "sum to_date trim trunc try_add try_cast try_divide try_multiply try_subtract upper var_pop var_samp variance year".split()
)


def bare(sql: str) -> str:
    """SQL out of a model's answer: without code fences, label and last semicolon."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", sql or "").strip()
    return text.rstrip(";").strip()


def without_literals(sql: str) -> str:
    return re.sub(r"'(?:[^']|'')*'", "''", sql)


def _each(values: Any) -> list[Any]:
    """The members of a Scala sequence."""
    return [values.apply(k) for k in range(values.size())]


def contents(spark: SparkSession, sql: str) -> tuple[list[str], list[str], list[str]]:
    """Names of the tables a parsed statement reads, of its steps and of its functions."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    tables: list[str] = []
    steps: list[str] = []
    functions: list[str] = []

    def look(expression: Any) -> None:
        name = expression.getClass().getSimpleName()
        if name == "UnresolvedFunction":
            functions.append(".".join(map(str, _each(expression.nameParts()))).lower())
        elif name == "UnresolvedGenerator":
            functions.append(str(expression.name()).lower())
        for child in _each(expression.children()):
            look(child)

    def walk(node: Any) -> None:
        name = node.getClass().getSimpleName()
        steps.append(name)
        if name == "UnresolvedRelation":
            tables.append(str(node.tableName()).lower())
        for expression in _each(node.expressions()):
            look(expression)
        for child in [*_each(node.children()), *_each(node.subqueries())]:
            walk(child)

    walk(plan)
    return tables, steps, functions


def problem(spark: SparkSession, sql: str, tables: tuple[str, ...] = TABLES) -> str | None:
    """What is wrong with a statement; None where it may run (or says it can't answer)."""
    text = bare(sql)
    if not text:
        return "empty statement"
    if text.upper() == CANNOT:
        return None
    plain = without_literals(text)
    word = next((w for w in FORBIDDEN if re.search(rf"\b{w}\b(?!\s*\()", plain, re.I)), None)
    if word:
        return f"forbidden keyword {word}"
    if "--" in plain or "/*" in plain:
        return "comments are not allowed"
    if not re.match(r"(?i)select\b", plain):
        return "only SELECT statements are allowed"
    if ";" in plain:
        return "one statement only"
    try:
        used, steps, functions = contents(spark, text)
    except Exception as error:  # the parser's message is the answer
        return f"can't be parsed: {str(error).splitlines()[0]}"
    for what, names, allowed in (("unknown table", used, tables), ("not allowed:", steps, STEPS), ("function not allowed:", functions, FUNCTIONS)):
        wrong = sorted(set(names) - set(allowed))
        if wrong:
            return f"{what} {wrong[0]}"
    return None if used else "no table"


@dataclass
class Answer:
    status: str
    question: str
    sql: str = ""
    rows: list[dict] = field(default_factory=list)
    error: str | None = None
    corrected: bool = False
    latency_ms: int = 0


def answer(spark: SparkSession, question: str, generate: Callable[[str], str], correct: Callable[[str, str, str], str] | None = None, tables: tuple[str, ...] = TABLES, attempts: int = ATTEMPTS, log: Callable[[dict], None] | None = None) -> Answer:
    """Question to rows: generate, check, run; errors and empty results go back to the generator, up to ``attempts`` times."""
    began, out = time.time(), Answer("error", question)
    try:
        sql = bare(generate(question))
        for k in range(attempts):
            out.sql, out.corrected = sql, k > 0
            if sql.upper() == CANNOT:
                out.status, out.error = "cannot_answer", None
                break
            out.error = problem(spark, sql, tables)
            if out.error is None:
                try:
                    rows = [r.asDict() for r in spark.sql(sql).limit(MAX_ROWS + 1).collect()]
                    if len(rows) > MAX_ROWS:
                        out.status, out.error = "error", f"more than {MAX_ROWS} rows"
                        break
                    out.status, out.rows = ("success" if rows else "empty_result"), rows
                    if rows:
                        break
                    out.error = "no rows"
                except Exception as error:  # what the engine says goes back to the generator
                    out.status, out.error = "error", str(error).splitlines()[0]
            if correct is None or k == attempts - 1:
                break
            sql = bare(correct(question, sql, out.error or ""))
        if out.status == "empty_result":
            out.error = None
    finally:
        out.latency_ms = int(1000 * (time.time() - began))
        if log is not None:
            log({"question": question, "sql": out.sql, "status": out.status, "rows": len(out.rows), "corrected": out.corrected, "latency_ms": out.latency_ms})
    return out


def as_json(result: Answer) -> str:
    return json.dumps(asdict(result), default=str)


def payload(result: Answer, rows: int = 50) -> dict[str, Any]:
    """What a tool call shows of an answer: ok where the question was dealt with, the first ``rows`` rows."""
    return {"tool": "sql", "ok": result.status in ("success", "empty_result", "cannot_answer"), "question": result.question, "status": result.status, "sql": result.sql, "row_count": len(result.rows), "rows": result.rows[:rows], "correction_used": result.corrected, "error_message": result.error, "latency_ms": result.latency_ms}
