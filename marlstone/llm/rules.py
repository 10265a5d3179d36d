"""Quality rules by cross-document line frequency, in DataFrame operations only.

Base figures of a text: words, their characters, symbols, repeated lines, words
inside repeated three-word windows.  On top of them, lines (lower-cased, single
spaces) are hashed and the distinct documents of each line are counted per
host; a line in more than ``MIN_DOCS`` of them is removed, and on a small host
one in more than ``SHARE`` of its documents and more than ``FEW`` of them.  The
bar does not rise with the host.  A document that keeps less than ``KEEP`` of
its words is rejected, as is one that fails the base rules.

The text is read once; figures and line hashes are stored, so the counting
joins move hashes and never texts.  Rows are first made distinct by host, line
and document, which spreads a hot line over all tasks, and the counts per (host,
line) are combined before the shuffle, so a line of a third of all documents
reaches its counting task once per task before.

Defined results: null and empty texts have no words and fail; a null host is
the host without a name; rows of one document id count as one document, and so
do all rows without an id; lines without a word never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

MIN_WORDS, REPEATED_PERCENT = 50, 50
MIN_DOCS, FEW, SHARE, KEEP = 20, 4, 0.10, 0.5
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"


def normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"[{SPACE}]+", " ")))


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures and line hashes of every row, stored; the row id is made once, when they are."""
    t = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    t = t.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    t = t.withColumn("n_words", F.size("words").cast("bigint"))
    hashes = F.when(F.col("n_words") >= 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"))
    t = t.withColumn("h", hashes)
    # only a text with an equal pair of windows is sorted
    t = t.withColumn("s", F.expr("case when size(array_distinct(h)) < size(h) then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end"))
    t = t.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h or get(s, i + 1).h <=> x.h), x -> x.i))"))
    t = t.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1), x + 3) - x)), 0L, (a, x) -> a + x), 0L)"))
    t = t.withColumn("keys", F.transform("lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("k"), F.size(F.regexp_extract_all(x, F.lit(f"[^{SPACE}]+"), F.lit(0))).alias("w"))))
    t = t.select(
        "rid",
        "doc_id",
        "host",
        "n_words",
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        "keys",
    )
    return common.materialise(t, "figures")


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, few: int = FEW) -> DataFrame:
    """(``host``, ``k``) of the lines above the limits."""
    each = rows.select("host", "doc_id", F.explode(F.array_distinct(F.transform("keys", lambda x: x["k"]))).alias("k")).distinct()
    counts = each.groupBy("host", "k").agg(F.count("*").alias("n")).filter(F.col("n") > min(few, min_docs))
    hosts = rows.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    return counts.join(hosts, "host").filter((F.col("n") > min_docs) | (F.col("n") > share * F.col("docs"))).select("host", "k")


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """Per document: the base figures, ``base_failed``, ``kept``, and the words in removed lines (``n_line_words_removed``)."""
    rows = figures(docs, host)
    often = common.materialise(frequent_lines(rows, min_docs, share), "frequent", parts=common.files_for(rows.count(), 16))
    gone = rows.select("rid", "host", F.explode("keys").alias("x")).select("rid", "host", F.col("x.k").alias("k"), F.col("x.w").alias("w")).join(often, ["host", "k"]).groupBy("rid").agg(F.sum("w").alias("gone"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    out = rows.drop("keys", "host").join(gone, "rid", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ((F.col("n_words") - F.col("gone")) >= keep * F.col("n_words"))).alias("kept"), F.col("gone").cast("bigint").alias("n_line_words_removed"))


def without_frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``docs`` with the lines above the limits cut out of their texts; all rows and columns stay."""
    rid, row = common.P + "rid", common.P + "row"
    stored = common.with_row_id(docs, "rules")
    plain = stored.select(F.col(rid).alias("doc_id"), F.col(f"{row}.{host}").alias("source"), F.col(f"{row}.text").alias("text"))
    rows = figures(plain)
    often = common.materialise(frequent_lines(rows, min_docs, share), "frequent", parts=common.files_for(rows.count(), 16))
    gone = rows.select("doc_id", "host", F.explode(F.array_distinct(F.transform("keys", lambda x: x["k"]))).alias("k")).join(often, ["host", "k"]).groupBy(F.col("doc_id").alias(rid)).agg(F.collect_set("k").alias("gone"))
    joined = stored.join(gone, rid, "left")
    kept = F.array_join(F.filter(F.split(F.col(f"{row}.text"), "\n", -1), lambda x: ~(x.rlike(f"[^{SPACE}]") & F.array_contains("gone", F.xxhash64(normal(x))))), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"{row}.text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(row)[c].alias(c) for c in docs.columns])


#: The same rows in DuckDB; limits as above.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
tri as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
dup as (select rid, i from tri where (rid, g) in (select (rid, g) from tri group by rid, g having count(*) > 1)),
rep as (select rid, count(distinct i + o) as n from dup, (values (0), (1), (2)) as x(o) group by rid),
ln as (select rid, doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as k,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as c
        from (select rid, doc_id, host, unnest(lines) as x from w)),
often as (select host, k from (select host, k, count(*) as n from (select distinct host, k, doc_id from ln) group by host, k)
        join (select host, count(*) as docs from (select distinct host, doc_id from w) group by host) using (host) where n > 4 and (n > 20 or n > 0.1 * docs)),
gone as (select rid, sum(c) as n from ln semi join often using (host, k) group by rid),
b as (select doc_id, len(ws)::bigint as n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words,
        (len(ws) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(ws)) as base_failed,
        coalesce(gone.n, 0)::bigint as n_line_words_removed
      from w left join rep using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and n_words - n_line_words_removed >= 0.5 * n_words) as kept, n_line_words_removed from b
"""
