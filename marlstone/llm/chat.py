r"""Chat formatting of reply trees.

Messages point at the message they answer.  Root-to-leaf paths are enumerated
by iterative self-joins that double the distance looked at (a depth of n takes
log2 n joins): every message learns its depth and the score of the path above
it.  Branches are ranked by mean score (deeper first on ties, then the smaller
leaf), the best ones of each tree are walked back by the same steps, and each
chosen path is formatted as one conversation.

The template opens with ``<s>``; a user turn is ``[INST] text [/INST]``, an
assistant turn `` text </s>``, a system turn ``[SYS] text [/SYS]``, any other
role ``[ROLE:name] text [/ROLE]``.  Control strings inside a text get a
backslash behind their first character and backslashes are doubled, which
:func:`unescape` takes back; so no text can open or close a turn.

Defined results: null texts are empty; a message whose parent is missing is a
root; messages in a ring of replies have no path from a root and are left out;
equal messages are numbered each; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\]|/?SYS\]|ROLE:|/ROLE\])")
ESCAPED = re.compile(r"\\(\\?)")
#: Stands for a null tree id while trees are joined.
NO_TREE = -(1 << 63)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[int]]:
    """The conversation and the loss mask: begin and end of each assistant text in code points."""
    parts, mask, at = ["<s>"], [], 3
    for role, text in turns:
        own = escape(text or "")
        if role == "user":
            opened, closed = "[INST] ", " [/INST]"
        elif role == "assistant":
            opened, closed = " ", " </s>"
        elif role == "system":
            opened, closed = "[SYS] ", " [/SYS]"
        else:
            opened, closed = f"[ROLE:{quote(role or '', safe='')}] ", " [/ROLE]"
        if role == "assistant":
            mask += [at + len(opened), at + len(opened) + len(own)]
        parts += [opened, own, closed]
        at += len(opened) + len(own) + len(closed)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at, out = 3, []
    while at < len(formatted):
        for role, opened, closed in (("user", "[INST] ", " [/INST]"), ("system", "[SYS] ", " [/SYS]"), ("assistant", " ", " </s>"), ("", "[ROLE:", " [/ROLE]")):
            if formatted.startswith(opened, at):
                begin = at + len(opened)
                if not role:
                    name_end = formatted.index("] ", begin)
                    role, begin = unquote(formatted[begin:name_end]), name_end + 2
                end = formatted.index(closed, begin)
                out.append((role, unescape(formatted[begin:end])))
                at = end + len(closed)
                break
        else:
            raise ValueError("not a formatted conversation")
    return out


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(``tree``, ``path``, ``id``, ``depth``): the messages of the best ``branches`` root-to-leaf paths of every tree.

    ``messages`` has ``tree``, ``id`` (unique in its tree), ``parent`` and ``score``.
    """
    base = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("id").alias("up"))
    parents = base.filter("parent is not null").select("tree", "id", F.col("parent").alias("up")).join(known, ["tree", "up"])
    step = base.join(parents, ["tree", "id"], "left").select("tree", "id", "up", F.lit(1).alias("depth"), F.col("score").alias("total"))
    parts = common.files_for(messages.count(), 48)
    step = common.materialise(step, "replies", parts=parts)
    done, active, steps = step.filter("up is null"), step.filter("up is not null"), []
    reach, count = 1, None
    while not active.isEmpty():
        count = step.count() if count is None else count
        if reach > 2 * count:  # what still points upwards is a ring
            break
        steps.append(active.select("tree", "id", "up"))
        # only messages that still point upwards move on; they look up what the message they point at knows
        above = done.unionByName(active).select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("gain"))
        moved = active.join(above, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("gain")).alias("total"))
        moved = common.materialise(moved, "replies", parts=parts)
        done, active = done.unionByName(moved.filter("up is null")), moved.filter("up is not null")
        reach *= 2
    whole = done
    leaves = whole.join(parents.select("tree", F.col("up").alias("id")).distinct(), ["tree", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "id"))
    marked = leaves.withColumn("path", rank).filter(F.col("path") <= branches).select("tree", "path", "id")
    marked = common.materialise(marked, "marked", parts=parts)
    for step in reversed(steps):
        above = marked.join(step, ["tree", "id"]).select("tree", "path", F.col("up").alias("id"))
        marked = common.materialise(marked.union(above).distinct(), "marked", parts=parts)
    return marked.join(whole.select("tree", "id", "depth"), ["tree", "id"]).select("tree", "path", "id", "depth")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Stored conversations: ``tree``, ``path``, ``formatted`` and ``mask`` (begin, end, begin, end, ... in code points).

    ``messages`` has ``tree``, ``id``, ``parent``, ``score``, ``role`` and ``text``.
    """
    turns = chosen_paths(messages, branches).join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    whole = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render([(x["role"], x["text"]) for x in own]) for own in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("path"), pa.array([x for x, _ in out], pa.string()), pa.array([m for _, m in out], pa.list_(pa.int64()))], names=["tree", "path", "formatted", "mask"])

    return common.materialise(whole.mapInArrow(run, "tree bigint, path int, formatted string, mask array<bigint>"), "conversations")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: turns, their hash, the text under the loss mask, lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, path, text, mask in zip(*(batch.column(c).to_pylist() for c in ("tree", "path", "formatted", "mask")), strict=True):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
                rows.append((tree, path, len(turns), whole, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], names=["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "tree bigint, path int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches: each row answers the one before (ties by role and text)."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_TREE)).alias("tree"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = common.materialise(rows.withColumn("id", F.row_number().over(order)), "messages")
    return rows.select("tree", F.col("id").cast("bigint").alias("id"), F.when(F.col("id") > 1, F.col("id").cast("bigint") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    out = digests(format_trees(linear_messages(conversations)))
    return out.select(F.when(F.col("tree") != NO_TREE, F.col("tree")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The rows of the registered query in DuckDB: digests of the texts themselves, lengths under the template.
ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<#\1', 'g'), '\[(/?INST\]|/?SYS\]|ROLE:|/ROLE\])', '[#\1', 'g'))
  + case role when 'user' then 15 when 'assistant' then 6 when 'system' then 13 else 15 + length(url_encode(role)) end as n from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, (3 + sum(n))::bigint as formatted_chars
from e group by conv_id
"""
