"""Session memory as views over an append-only table of turns (``session_id``, ``turn``, ``role``, ``text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

KEEP, FOLD_CHARS, SUMMARY_CHARS = 4, 400, 6000
NOTES, ARTIFACTS = 50, 24
MIN_SCORE, MAX_ITEMS = 0.06, 8
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def recency(turns: DataFrame) -> DataFrame:
    """``back``: 1 for a session's last message."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn"))))


def recent(turns: DataFrame, keep: int = KEEP) -> DataFrame:
    return recency(turns).filter(F.col("back") <= keep).drop("back")


def summaries(turns: DataFrame, keep: int = KEEP) -> DataFrame:
    """Older messages as lines; the summary's last characters stay.

    Only messages that can reach them are gathered, so a row holds some six
    thousand characters and one message more, however long a session is.
    """
    line = F.concat(F.lit("- "), F.col("role"), F.lit(": "), F.substring(F.translate(F.coalesce("text", F.lit("")), "\n", " "), 1, FOLD_CHARS))
    old = recency(turns).filter(F.col("back") > keep).select("session_id", "turn", line.alias("line"))
    behind = F.sum(F.length("line") + 1).over(Window.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1))
    near = old.withColumn("behind", F.coalesce(behind, F.lit(0))).filter(F.col("behind") <= SUMMARY_CHARS)
    folded = near.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    whole = F.trim(F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return folded.select("session_id", F.when(F.length(whole) > SUMMARY_CHARS, F.expr(f"right(array_join(transform(x, y -> y.line), '\\n'), {SUMMARY_CHARS})")).otherwise(whole).alias("summary"))


def notes(turns: DataFrame, cap: int = NOTES) -> DataFrame:
    """Question and answer notes: each user message with the assistant's next one, the newest ``cap`` of a session."""
    w = Window.partitionBy("session_id").orderBy("turn")
    pairs = turns.withColumns({"answer": F.lead("text").over(w), "answers": F.lead("role").over(w)}).filter("role = 'user' and answers = 'assistant' and trim(coalesce(answer, '')) <> ''")
    note = F.concat(F.lit("Q: "), F.substring(T.clean_text(F.col("text")), 1, 220), F.lit(" / A: "), F.substring(T.clean_text(F.col("answer")), 1, 480))
    return recency(pairs.select("session_id", "turn", note.alias("note"))).filter(F.col("back") <= cap).drop("back")


def facts(turns: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(``session_id``, ``key``, ``value``): addresses and preferences of user messages, the last write wins.

    ``rules`` (``key``, ``value``, ``trigger``, ``pos``) is a small dimension of trigger words.
    """
    said = turns.filter("role = 'user'").select("session_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    mails = said.select("session_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("pos", "value")).withColumn("key", F.lit("user_email"))
    prefers = F.lower("text").rlike("i prefer|always use|from now on|remember that i")
    pref = said.filter(prefers).select("session_id", "turn", F.lit(0).alias("pos"), F.substring(F.trim("text"), 1, 320).alias("value"), F.lit("user_preference").alias("key"))
    every = mails.unionByName(pref)
    if rules is not None:
        hit = said.join(F.broadcast(rules), F.contains(F.lower(said["text"]), rules["trigger"]))  # rules: a constant list
        every = every.unionByName(hit.select("session_id", "turn", "pos", "value", "key"))
    own = every.filter(F.trim("value") != "")
    return own.groupBy("session_id", "key").agg(F.max_by("value", F.struct("turn", "pos")).alias("value"))


def retrieved(items: DataFrame, queries: DataFrame, minimum: float = MIN_SCORE, cap: int = MAX_ITEMS) -> DataFrame:
    """Memory lines (``session_id``, ``kind``, ``pos``, ``line``) that answer a session's query, best first, capped."""
    scored = items.join(queries, "session_id").withColumn("score", T.memory_score(F.col("query"), F.col("line"))).filter(F.col("score") >= minimum)
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "kind", "pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def newest_capped(rows: DataFrame, cap: int, key: str = "session_id", order: str = "turn") -> DataFrame:
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("back") <= cap).drop("back")


def snapshot(turns: DataFrame) -> DataFrame:
    """Per session: messages, notes, whether a summary exists."""
    n = turns.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    m = notes(turns).groupBy("session_id").agg(F.count("*").alias("notes"))
    s = summaries(turns).select("session_id", F.length("summary").alias("summary_chars"))
    return n.join(m, "session_id", "left").join(s, "session_id", "left").select("session_id", "messages", "last_turn", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("summary_chars", F.lit(0)).cast("bigint").alias("summary_chars"))


def context(turns: DataFrame, queries: DataFrame) -> DataFrame:
    """(``session_id``, ``context``): facts, then retrieved lines, then the recent messages."""
    known = facts(turns).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "key", "value"))), "\n").alias("known"))
    lines = summaries(turns).select("session_id", F.lit("summary").alias("kind"), F.posexplode(F.split("summary", "\n")).alias("pos", "line"))
    lines = lines.unionByName(notes(turns).select("session_id", F.lit("note").alias("kind"), F.col("turn").cast("int").alias("pos"), F.col("note").alias("line")))
    found = retrieved(lines, queries).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("found"))
    last = recent(turns).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said")))).alias("last"))
    out = queries.select("session_id").join(known, "session_id", "left").join(found, "session_id", "left").join(last, "session_id", "left")
    return out.select("session_id", F.concat_ws("\n\n", "known", F.array_join(F.transform("found", lambda x: x["line"]), "\n"), F.array_join(F.transform("last", lambda x: x["said"]), "\n")).alias("context"))


def store(turns: DataFrame, artifacts: DataFrame | None = None, semantic: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five tables of session memory, as views of the turns and of two event logs.

    ``artifacts`` (``session_id``, ``seq``, ``tool``, ``input``, ``output``) keeps the newest ``ARTIFACTS`` of a session with
    previews of 400 characters; ``semantic`` (``session_id``, ``content``, ``importance``, ``seq``) has a row per access: the
    last importance of a content counts, and how often it came up again.
    """
    spark = turns.sparkSession
    artifacts = spark.createDataFrame([], "session_id bigint, seq bigint, tool string, input string, output string") if artifacts is None else artifacts
    semantic = spark.createDataFrame([], "session_id bigint, content string, importance double, seq bigint") if semantic is None else semantic
    seen = turns.groupBy("session_id").agg(F.min("turn").alias("created"), F.max("turn").alias("updated"))
    sessions = seen.join(summaries(turns), "session_id", "left").select("session_id", F.coalesce("summary", F.lit("")).alias("summary"), "created", "updated")
    preview = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 400).alias(f"{c}_preview")
    known = semantic.filter(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy("session_id", "content")
    return {
        "sessions": sessions,
        "messages": turns.select("session_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content")),
        "memory_facts": facts(turns),
        "tool_artifacts": newest_capped(artifacts, ARTIFACTS, order="seq").select("session_id", "seq", "tool", preview("input"), preview("output")),
        "memory_semantic": known.agg(F.max_by("importance", "seq").alias("importance"), (F.count("*") - 1).alias("access_count"), F.max("seq").alias("last_accessed")),
    }
