import os

import pytest
from pyspark.sql import functions as F

from marlstone import fixtures, queries
from marlstone.operators import chunks as C
from marlstone.operators import facts as FA
from marlstone.operators import layout as L
from marlstone.operators import memory as M
from marlstone.operators import retrieval as R
from marlstone.operators import tables as TB
from marlstone.plans import guard, models, pipeline
from marlstone.sources import jobs, readers


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, ["Plant", "North"], "Solar output rose in the north plant. Solar demand was flat."), (2, ["Plant", "South"], "The south plant closed two lines."), (3, ["Plant", "North"], "Wind output fell."), (4, ["Notes"], "Nothing to report.")]
    return spark.createDataFrame(rows, "doc_id int, header_path array<string>, content string")


def test_bm25_golden_values(spark, golden):
    from marlstone.functions.text import searchable_text

    q = spark.createDataFrame([(1, "solar output solar"), (2, "  ")], "query_id int, query string")
    text = searchable_text(F.col("header_path"), F.col("content"), F.lit(""))
    got = R.bm25_topk(golden, q, text, 4).orderBy("query_id", "rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 3.304915), (3, 0.815467), (2, 0.0), (4, 0.0)]


def test_hybrid_merge_and_rerank(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id string, rank int, score double")
    merged = R.hybrid_merge(hits([(1, "a", 1, 0.9), (1, "b", 2, 0.8)]), hits([(1, "b", 1, 7.0), (1, "c", 2, 3.0)]))
    assert [(r.doc_id, r.rank, r.score, r.retrieval_sources) for r in merged.orderBy("rank").collect()] == [("a", 1, 0.9, ["vector"]), ("b", 2, 0.8, ["vector", "bm25"]), ("c", 3, 3.0, ["bm25"])]
    scored = spark.createDataFrame([(1, "c", 0, 0.7), (1, "c", 1, 0.1)], "query_id int, doc_id string, position int, rerank_score double")
    assert [(r.doc_id, r.rerank_score) for r in R.reranked(merged, scored, 2).orderBy("rank").collect()] == [("c", 0.7), ("a", None)]
    assert [(r.doc_id, r.rerank_score) for r in R.reranked(merged, scored, 3).orderBy("rank").collect()] == [("a", None), ("b", None), ("c", None)]


def test_table_lookup_first_wins(spark):
    rows = spark.createDataFrame([("f", "g1", ["t1", "t2"], 0), ("f", "t1", None, 1)], "source_file string, table_id string, source_table_ids array<string>, load_pos int")
    assert {(r.table_key, r.table_id) for r in R.table_lookup(rows).collect()} == {("f::g1", "g1"), ("f::t1", "g1"), ("f::t2", "g1"), ("f::t1_merged", "g1"), ("f::t2_merged", "g1")}


def test_facts(spark, tmp_path):
    rows = {(r.company_ticker, r.fiscal_year): r for r in FA.income_statements(fixtures.documents(spark)).collect()}
    assert rows["ABC", 2024].revenue == 101 and rows["ABC", 2024].eps_basic == 1.25 and rows["XYZ", 2025].net_income == -20
    tables = fixtures.star(spark)
    counts = {r.table: r.rows for r in FA.write_star(str(tmp_path), tables).collect()}
    assert counts == {"companies": 2, "income_statements": 2, "balance_sheets": 2, "segment_revenue": 3, "geographic_revenue": 2}
    assert {r.name for r in tables["companies"].collect()} == {"A", "X"}  # the first of equal keys, by place in the source
    gaps = {r.company_ticker: r.gap for r in FA.revenue_gaps(spark.read.parquet(f"{tmp_path}/income_statements"), spark.read.parquet(f"{tmp_path}/geographic_revenue")).collect()}
    assert gaps == {"ABC": -41}


def test_facts_from_json(spark, tmp_path):
    import json

    body = {"cik": 1, "entityName": "A", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-09-28", "val": 5, "fp": "FY", "form": "10-K", "filed": "2024-11-01"}]}}}}}
    (tmp_path / "ABC_companyfacts.json").write_text(json.dumps(body))
    got = FA.balance_sheets(readers.company_facts(spark, str(tmp_path))).first()
    assert (got.company_ticker, got.total_assets, got.total_debt) == ("ABC", 5, None)


def test_layout(spark):
    lines = spark.createDataFrame([("f", 1, 0, "MARKET RISK", False, 250.0, 362.0, 100.0, 112.0, 612.0, 12.0, False, False, ["A"]), ("f", 1, 1, "We hold notes that pay interest at fixed rates.", False, 72.0, 540.0, 140.0, 152.0, 612.0, 10.0, False, False, ["A"]), ("f", 2, 0, "next page", False, 72.0, 200.0, 100.0, 112.0, 612.0, 10.0, False, True, ["A"])], "file string, page int, line_no int, line string, is_toc boolean, x0 double, x1 double, y0 double, y1 double, page_width double, max_size double, is_bold boolean, is_italic boolean, font_names array<string>")
    assert [r.offset for r in L.offsets(lines).orderBy("page", "line_no").collect()] == [13, 25, 86]
    assert [(r.line, r.level) for r in L.heading_candidates(lines).orderBy("page").collect()] == [("MARKET RISK", 2), ("next page", 3)]
    assert L.similarity("Risk Factors", "Item 1A. Risk Factors") == 1.0 and L.similarity("Properties", "Legal") < 0.45 and L.similarity("", "x") == 0.0


def test_toc_headings_and_sections(spark):
    e = spark.createDataFrame([("f", 1, "Item 1", "Business", 3), ("f", 2, "Item 1A", "Risk Factors", 9)], "file string, entry bigint, item string, toc_title string, toc_page int")
    h = spark.createDataFrame([("f", 5, 1, "Item 1", "Item 1"), ("f", 40, 3, "Item 1", "Item 1. Business"), ("f", 90, 9, "Item 1A", "Item 1A. Risk Factors"), ("f", 20, 1, "Item 1A", "Item 1A")], "file string, offset bigint, page int, item string, title string")
    got = L.matched_headings(e, h)
    assert [(r.offset, r.match_status) for r in got.orderBy("entry").collect()] == [(40, "matched"), (90, "matched")]
    text = spark.createDataFrame([("f", "x" * 40 + "Item 1. Business  is good." + "y" * 24 + "Item 1A. Risk")], "file string, full_text string")
    assert [(r.start, r.end) for r in L.sections(got, text).orderBy("seq").collect()] == [(40, 90), (90, 103)]


def test_section_and_heading_lookup(spark):
    refs = spark.createDataFrame([("f", "s1", 1, 0), ("f", "s2", 3, 50), ("f", "s3", 3, 80)], "file string, section_ref_id string, start_page int, start_offset int")
    assets = spark.createDataFrame([(1, "f", 2, 300.0), (2, "f", 3, 300.0), (3, "f", 3, 760.0), (4, "f", 3, 90.0)], "asset_id int, file string, page int, y0 double")
    got = {r.asset_id: r.section_ref_id for r in L.section_of(assets, refs).collect()}
    assert got == {1: "s1", 2: "s2", 3: "s3", 4: "s1"}
    odd = spark.createDataFrame([(1, "f", 1, None), (2, "f", 9, 300.0), (3, "g", 1, 300.0), (4, "h", 1, 300.0), (5, "h", 3, 100.0)], "asset_id int, file string, page int, y0 double")
    more = refs.unionByName(spark.createDataFrame([("h", "t1", 2, 0), ("h", "t2", 3, 9)], refs.schema))
    # the last section goes on to the end; no section of the file, none that begins before; the top of a page belongs to what ended before it
    assert {r.asset_id: r.section_ref_id for r in L.section_of(odd, more).collect()} == {1: "s1", 2: "s3", 3: None, 4: None, 5: "t1"}
    ended = spark.createDataFrame([("f", "a", 0, 1, 2), ("f", "b", 9, 5, 6)], "file string, section_ref_id string, start_offset int, start_page int, end_page int")
    assert L.section_of(spark.createDataFrame([(1, "f", 4, 300.0)], odd.schema), ended).first().section_ref_id == "a"  # outside every span: the last that started before


def test_contents_pages(spark):
    def page(n, lines):
        return [("f", n, k, x) for k, x in enumerate(lines)]

    items = [f"Item {k}. Some title of it" for k in range(1, 7)]
    numbers = ["1", "22", "333", "4444"]
    rows = page(1, ["Table of Contents", *items[:4], *numbers]) + page(2, ["Index", *items[:4], *numbers]) + page(3, [*items, *numbers]) + page(4, [x + " and much more of the title" for x in items] + numbers) + page(5, ["Table of Contents", *items[:4], *numbers[:3]])
    lines = spark.createDataFrame(rows, "file string, page int, line_no int, line string")
    assert {r.page for r in L.toc_pages(lines).collect()} == {1, 3}
    long_ = spark.createDataFrame(page(1, ["Item 1.", *[f"word{k}" for k in range(150)], "7"]), "file string, page int, line_no int, line string")
    entry = L.toc_entries(long_).first()
    assert entry.toc_title.split() == [f"word{k}" for k in range(150)] and entry.toc_page == 7
    heads = spark.createDataFrame([("s1", 1, 10.0, "h1"), ("s1", 2, 200.0, "h2")], "section_ref_id string, page int, y0 double, sub_id string")
    a = spark.createDataFrame([(1, "s1", 1, 5.0), (2, "s1", 1, 9.0), (3, "s1", 2, 500.0)], "asset_id int, section_ref_id string, page int, y0 double")
    assert {r.asset_id: r.sub_id for r in L.heading_before(a, heads).collect()} == {1: None, 2: "h1", 3: "h2"}


def test_tables(spark):
    islands = TB.same_page_islands(fixtures.regions(spark))
    assert [r.island for r in islands.filter("table_id <> 'table_005'").orderBy("table_id").collect()] == [1, 1, 2, 3]
    from marlstone.schemas import TABLE

    box = lambda x0, y0, x1, rows, k: ("f", f"t{k}", "table", 1, 1, [x0, y0, x1, y0 + 10], rows, [], "s", "u", False, k)
    prose, four, dates = [["words only", "more"]], [["a", "b", "c", "d"]], [["January 5, 2024", "x"]]
    cases = [box(40.0, 100.0, 560.0, prose, 1), box(40.0, 150.0, 560.0, prose, 2), box(40.0, 300.0, 300.0, prose, 3), box(40.0, 320.0, 300.0, four, 4), box(40.0, 400.0, 300.0, dates, 5), box(40.0, 420.0, 300.0, dates, 6), box(40.0, 500.0, 300.0, prose, 7), box(40.0, 520.0, 300.0, prose, 8)]
    got = {r.table_id: r.island for r in TB.same_page_islands(spark.createDataFrame(cases, TABLE)).collect()}
    # wide ones join whatever they hold; others where one has four columns or both are schedules
    assert got["t1"] == got["t2"] and got["t3"] == got["t4"] and got["t5"] == got["t6"] and got["t7"] != got["t8"] and len(set(got.values())) == 5
    groups = {r.table_id: r for r in TB.grouped(TB.same_page_islands(TB.contained(fixtures.regions(spark)))).collect()}
    assert groups["table_group_001"].source_table_ids == ["table_001", "table_002"] and len(groups["table_group_001"].raw_rows) == 3
    assert groups["table_group_001"].bbox == [40.0, 100.0, 560.0, 150.0] and groups["table_003"].asset_type == "table"
    flags = {r.grid_id: (r.prose, r.header_only) for r in queries.prose_grid_flags(spark, "").collect()}
    assert flags == {g: (p, h) for g, p, h in fixtures.GRID_FLAGS}


def test_cross_page_link_passes_the_section_on(spark):
    from marlstone.schemas import TABLE

    rows = [("f", "table_001", "table", 1, 1, [40.0, 700.0, 560.0, 740.0], [["Year", "Amount"]], [], "s1", "u1", True, 0), ("f", "table_002", "table", 2, 2, [40.0, 80.0, 560.0, 200.0], [["a", "1", "2"]], [], "s2", "u2", False, 1), ("f", "table_003", "table", 4, 4, [40.0, 80.0, 560.0, 200.0], [["a", "1", "2"]], [], "s3", "u3", False, 2)]
    got = {r.table_id: (r.island, r.section_ref_id) for r in TB.cross_page_islands(spark.createDataFrame(rows, TABLE)).collect()}
    assert got == {"table_001": (1, "s1"), "table_002": (1, "s1"), "table_003": (2, "s3")}


def test_words_lines_anchors(spark):
    words = spark.createDataFrame([("f", 1, 50.0, 100.2, "income"), ("f", 1, 10.0, 100.0, "Net"), ("f", 1, 10.0, 120.0, "Total")], "file string, page int, x0 double, top double, text string")
    assert [r.text for r in TB.word_rows(words).orderBy("top").collect()] == ["Net income", "Total"]
    lines = spark.createDataFrame([("f.pdf", 1, 90.0, "(in millions)"), ("f.pdf", 1, 80.0, "The following table shows"), ("f.pdf", 1, 20.0, "Farther away it said this")], "file string, page int, y1 double, line string")
    got = {r.table_id: r.text_anchor for r in TB.text_anchors(fixtures.regions(spark), lines).collect()}
    assert got["table_001"] == "The following table shows" and got["table_004"] is None
    heads = spark.createDataFrame([("f.pdf", 1, 50.0, 200.0, 104.0, 114.0), ("f.pdf", 1, 50.0, 200.0, 60.0, 70.0)], "file string, page int, x0 double, x1 double, y0 double, y1 double")
    assert [r.y0 for r in TB.outside_tables(heads, fixtures.regions(spark)).collect()] == [60.0]


def test_chunks(spark):
    body = " ".join(f"Sentence {k} has some words in it." for k in range(300))
    sections = spark.createDataFrame([("f", "s1", 1, "Head", "Before.", [("One", body), ("Two", "Short.")]), ("f", "s2", 2, "Other", "Alone.", None)], "file string, section_id string, seq int, header string, preamble string, subs array<struct<title: string, text: string>>")
    got = C.linked(C.chunked(C.units(sections))).orderBy("seq").collect()
    assert [r.chunk_id for r in got] == [f"text_{k:05d}" for k in range(1, len(got) + 1)]
    assert got[0].text.startswith("Head > One\n\nBefore. Sentence 0") and got[-1].text == "Other\n\nAlone."
    by_id = {r.chunk_id: r for r in got}
    assert all(by_id[r.unit_next].unit_prev == r.chunk_id for r in got if r.unit_next)
    cleaned = spark.createDataFrame([("We sold Total 10 9 more.", [["Total", "10", "9"], ["x", None, None]])], "body string, rows array<array<string>>").select(C.without_rows(F.col("body"), F.col("rows")).alias("v")).first().v
    assert cleaned == "We sold more."


def test_memory(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"message {k}") for k in range(9)]
    turns[0] = (1, 0, "user", "my email is a@b.co and i prefer tables")
    turns[2] = (1, 2, "user", "send to c@d.org")
    rows = spark.createDataFrame(turns, "session_id bigint, turn bigint, role string, text string")
    assert sorted(r.turn for r in M.recent(rows).collect()) == [5, 6, 7, 8]
    assert M.summaries(rows).first().summary.split("\n")[1] == "- assistant: message 1"
    assert {r.key: r.value for r in M.facts(rows).collect()} == {"user_email": "c@d.org", "user_preference": turns[0][3]}
    assert M.notes(rows).count() == 4
    asked = spark.createDataFrame([(1, "message 3")], "session_id bigint, query string")
    assert "c@d.org" in M.context(rows, asked).first().context


def test_guard(spark):
    problems = {r.statement: r.problem for r in queries.sql_guard(spark, "").collect()}
    ok = {s for s, p in problems.items() if p is None}
    assert ok == {s for s, p in fixtures.STATEMENTS if p is None} and problems == dict(fixtures.STATEMENTS)


def test_guarded_answers(spark):
    spark.createDataFrame([("ABC", 5), ("XYZ", 7)], "ticker string, n int").createOrReplaceTempView("companies")
    logged = []
    out = guard.answer(spark, "q", lambda q: "```sql\nSELECT nope FROM companies;\n```", lambda q, s, e: "SELECT ticker FROM companies WHERE n > 6", log=logged.append)
    assert (out.status, out.rows, out.corrected) == ("success", [{"ticker": "XYZ"}], True) and logged[0]["status"] == "success"
    assert guard.answer(spark, "q", lambda q: "CANNOT_ANSWER").status == "cannot_answer"
    assert guard.answer(spark, "q", lambda q: "SELECT * FROM companies WHERE n > 100").status == "empty_result"
    assert guard.answer(spark, "q", lambda q: "DELETE FROM companies").status == "error"
    spark.range(1500).createOrReplaceTempView("companies")
    assert "more than" in guard.answer(spark, "q", lambda q: "SELECT id FROM companies").error


def test_fallback_ladder():
    said = iter(["does not contain the figure", "insufficient evidence", "It was 5."])
    out = pipeline.ask("q", ["ABC"], "FY2024", ["FY2024", "FY2025"], lambda *a: next(said), lambda q: q + "?")
    assert (out.status, out.answer, len(out.trace)) == ("fallback_success", "It was 5.", 3)
    assert pipeline.ask("q", ["A", "B"], None, [], lambda *a: "").status == "needs_decomposition"
    assert pipeline.ask("q", ["A"], "FY2025", ["FY2025"], lambda *a: "").status == "insufficient_context"
    assert pipeline.ask("q", ["A"], None, [], lambda *a: 1 / 0).status == "error"


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("ABC_FY2025_10-K.pdf", "text_1", "text", "s", ["a"], "Body [[TABLE:t1]] text", None, "text_2"), ("ABC_FY2025_10-K.pdf", "t", "table", "s", ["a"], "x", None, None), ("source.pdf", "text_3", "text", "s", [], "y", None, None)], "source_file string, chunk_id string, chunk_type string, section_ref_id string, header_path array<string>, text string, prev_id string, next_id string")
    index = readers.index_rows(rows)
    got = index.orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.ticker, r.next_id) for r in got] == [("ABC_FY2025_10-K.pdf::text_1", "Body text", "ABC", "ABC_FY2025_10-K.pdf::text_2"), ("source.pdf::text_3", "y", None, None)]
    health = readers.health(index).first()
    assert (health.n, health.missing_ticker, health.stale, health.reason, health.valid) == (2, 1, 1, "stale_source", False)
    path = str(tmp_path / "index")
    twice = index.withColumn("load_seq", F.lit(1)).union(index.withColumns({"load_seq": F.lit(2), "content": F.lit("new")}))
    assert jobs.build_index(twice, path, models.embedding) == 2
    before = {f for f in os.listdir(f"{path}/ticker=__none__/fiscal_year=__none__") if f.startswith("part")}
    assert jobs.build_index(index.filter("ticker is not null").withColumns({"load_seq": F.lit(0), "content": F.lit("newer")}), path, models.embedding, rebuild=False) == 2
    assert before == {f for f in os.listdir(f"{path}/ticker=__none__/fiscal_year=__none__") if f.startswith("part")}  # other filings are not written again
    back = jobs.read_index(spark, path)
    assert [r.content for r in readers.scoped(back, ["abc"], ["2025"]).collect()] == ["newer"] and readers.scoped(back, ["zzz"]).count() == 0
    assert {r.ticker for r in back.collect()} == {"ABC", None}
    with pytest.raises(Exception, match="no embedding for"):
        jobs.build_index(index.withColumn("load_seq", F.lit(0)), path, lambda c: F.lit(None).cast("array<float>"))
    with pytest.raises(ValueError, match="no table"):
        jobs.build_table_index(spark.createDataFrame([("f", "t", "error", "x")], "source_file string, table_id string, status string, summary string"), path, models.embedding)
    assert jobs.pending(spark, {"a": path, "b": f"{path}-none"}) == ["b"] and jobs.pending(spark, {"a": path}, True) == ["a"]


def test_settings_and_stages():
    from marlstone.plans.timing import Stages
    from marlstone.session import settings

    lines = ["# comment", "export A='1'", "B = two words ", "no sign", "C="]
    assert settings(lines, {"A": "0"}) == {"A": "0", "B": "two words", "C": ""} and settings(lines, {"A": "0"}, True)["A"] == "1"
    took = Stages()
    for _ in range(2):
        with took.stage("search"):
            pass
    assert set(took.seconds()) == {"search", "total"} and took.seconds()["total"] >= took.seconds()["search"] >= 0


def test_texts_of_tables_and_answers(spark):
    from marlstone.functions import text as T

    row = spark.createDataFrame([(" ", [["a", None], ["b", "c"]], "raw", "Thought: x\nIt rose.\n Action: y", "x" * 7000)], "parsed string, rows array<array<string>>, raw string, answer string, long string")
    got = row.select(T.markdown(F.col("parsed"), F.col("rows"), F.col("raw")).alias("a"), T.markdown(F.col("long"), F.col("rows"), F.col("raw")).alias("b"), T.markdown(F.col("parsed"), F.array().cast("array<array<string>>"), F.col("raw")).alias("c"), T.without_meta_lines(F.col("answer")).alias("d")).first()
    assert (got.a, len(got.b), got.c, got.d) == ("a | \nb | c", 6000, "raw", "It rose.")


def test_chunks_against_a_plain_fold():
    """Sentence-packed chunks keep all words in order, respect the size and could not take one sentence more."""
    import random

    from marlstone.functions import chunker

    rng = random.Random(3)
    for _ in range(300):
        size, overlap = rng.choice([(30, 2), (60, 1), (100, 0)])
        sentences = [[f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 4, 9, 20, 45, 130]) - 1)] + ["end."] for _ in range(rng.randrange(1, 14))]
        spans = chunker.spans([len(s) for s in sentences], size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(sentences)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert c == max(a, b - overlap) and d > b
            assert sum(map(len, sentences[a : b + 1])) > size  # one sentence more would be too many
        for k, (a, b) in enumerate(spans):
            new = b - (spans[k - 1][1] if k else 0)
            assert sum(map(len, sentences[a:b])) <= size or new == 1
        text = " ".join(" ".join(s) for s in sentences)
        pieces = [p.split() for p in chunker.packed(text, size, 0)]
        assert [w for p in pieces for w in p] == text.split() and all(len(p) <= max(size, chunker.HARD) for p in pieces)
        for p in chunker.with_header(text * 9, "A > B"):
            assert p.startswith("A > B\n\n") and len(p.split()) <= chunker.MAX_WORDS


def test_streaming_memory(spark, tmp_path):
    from marlstone.streaming import sessions

    rows = [(1, k, "user", f"m{k}") for k in range(7)]
    schema = "session_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = sessions.session_memory(sessions.ndjson_events(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("memo").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("memo").first()
    assert got.recent == 4 and got.summary == "- user: m0\n- user: m1\n- user: m2"


def test_neighbour_sentences_keep_their_ends(spark):
    """Sentence 1 of 0, 1, 2 ends with the digit 1, sentence 2 begins with 2: neither is trimmed by its place."""
    rows = [(1, None, 2, "s", "\u3000No. Part 16.195.23.11. 22 of 2"), (2, 1, 3, "s", "own"), (3, 2, None, "s", "0 cents. key=d1\n")]
    chunks = spark.createDataFrame(rows, "chunk_id int, prev_id int, next_id int, section_id string, content string")
    got = {r.chunk_id: r.expanded for r in R.neighbour_expansion(chunks.select("chunk_id"), chunks).collect()}
    assert got[2] == "Part 16.195.23.11. 22 of 2\n\nown\n\n0 cents. key=d1\n"
    assert got[3].split("\n\n")[0] == "own" and got[1] == rows[0][4] + "\n\nown"
