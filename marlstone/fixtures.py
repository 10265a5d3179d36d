"""Small literal inputs for operators whose data the tables don't hold; the same rows as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ticker, concept, unit, start, end, val, form, fp, filed
FACTS = [
    ("ABC", "Revenues", "USD", "2023-10-01", "2024-09-28", 90.0, "10-K", "FY", "2025-11-01"),
    ("ABC", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2023-10-01", "2024-09-28", 100.0, "10-K", "FY", "2024-11-01"),
    ("ABC", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2023-10-01", "2024-09-28", 101.0, "10-K", "FY", "2025-11-01"),
    ("ABC", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2024-06-30", "2024-09-28", 25.0, "10-K", "FY", "2025-11-01"),
    ("ABC", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "2023-10-01", "2024-09-28", 102.0, "10-Q", "Q4", "2026-01-01"),
    ("ABC", "NetIncomeLoss", "USD", "2023-10-01", "2024-09-28", 30.0, "10-K", "FY", "2024-11-01"),
    ("ABC", "EarningsPerShareBasic", "USD/shares", "2023-10-01", "2024-09-28", 1.25, "10-K", "FY", "2024-11-01"),
    ("XYZ", "Revenues", "USD", "2024-07-01", "2025-06-30", 500.0, "10-K", "FY", "2025-07-30"),
    ("XYZ", "NetIncomeLoss", "USD", "2024-07-01", "2025-06-30", -20.0, "10-K", "FY", "2025-07-30"),
]


def documents(spark: SparkSession, rows: list[tuple] = FACTS) -> DataFrame:
    """The facts as nested company documents."""
    facts: dict = {}
    for ticker, concept, unit, *values in rows:
        row = dict(zip(("start", "end", "val", "form", "fp", "filed"), values, strict=True)) | {"fy": None}
        facts.setdefault(ticker, {}).setdefault(concept, {"units": {}})["units"].setdefault(unit, []).append(row)
    from marlstone.schemas import FACT

    schema = f"ticker string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<{FACT}>>>>>"
    return spark.createDataFrame([(t, {"us-gaap": f}) for t, f in facts.items()], schema)


def facts(spark: SparkSession) -> DataFrame:
    from marlstone.operators.facts import flat_facts

    return flat_facts(documents(spark))


def facts_sql(facts_: list[tuple], fields: dict[str, list[str]]) -> str:
    """Facts as a named SQL table ``f``, with field and priority of each concept."""
    place = {c: (f, k, p) for k, (f, names) in enumerate(fields.items()) for p, c in enumerate(names)}
    seen: dict = {}
    rows = []
    for ticker, concept, _, start, end, val, form, fp, filed in facts_:
        pos = seen[ticker, concept] = seen.get((ticker, concept), -1) + 1
        field, field_pos, priority = place[concept]
        rows.append(f"('{ticker}', '{field}', {field_pos}, {priority}, {pos}, {_literal(start)}, '{end}', {val}::double, '{form}', '{fp}', '{filed}')")
    return 'with f(ticker, field, field_pos, priority, pos, "start", "end", val, form, fp, filed) as (values ' + ", ".join(rows) + ") "


def _literal(x: object) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::double" if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"


def _income_sql() -> str:
    from marlstone.operators.facts import INCOME

    return facts_sql(FACTS, INCOME)


FACTS_SQL = _income_sql()

GRID_HEAD = ["(in millions)", "2025", "2024"]
# id, page, x0, y0, x1, y1, subsection, rows
REGIONS = [
    ("table_001", 1, 40.0, 100.0, 560.0, 120.0, "s1", [GRID_HEAD, ["Total revenue", "10", "9"]]),
    ("table_002", 1, 40.0, 130.0, 560.0, 150.0, "s1", [GRID_HEAD, ["Net income", "5", "4"]]),
    ("table_003", 1, 40.0, 260.0, 560.0, 280.0, "s1", [["Total assets", "7", "6"]]),
    ("table_004", 2, 40.0, 100.0, 560.0, 120.0, "s1", [["Total debt", "2", "1"]]),
    ("table_005", 2, 60.0, 104.0, 200.0, 118.0, "s1", [["Basic", "2", "1"]]),
]


def regions(spark: SparkSession) -> DataFrame:
    rows = [("f.pdf", i, "table", p, p, [x0, y0, x1, y1], g, [], "sec1", s, False, k) for k, (i, p, x0, y0, x1, y1, s, g) in enumerate(REGIONS)]
    from marlstone.schemas import TABLE

    return spark.createDataFrame(rows, TABLE)


REGIONS_SQL = "with g(table_id, page, y0, y1, sub) as (values " + ", ".join(f"('{i}', {p}, {y0}::double, {y1}::double, '{s}')" for i, p, _, y0, _, y1, s, _ in REGIONS) + ") "

GRIDS = [
    (1, [["The company designs and sells a range of", "products in many countries and also offers"], ["services to customers which are", None]], [40.0, 100.0, 560.0, 160.0]),
    (2, [["(in millions)", "2025", "2024"], ["Revenue", "$ 100", "90"], ["Cost of revenue", "40", "35"]], [40.0, 100.0, 300.0, 160.0]),
    (3, [["Year", "Amount per share"]], [40.0, 100.0, 560.0, 120.0]),
    (4, [[str(k) for k in range(10)] for _ in range(17)], [40.0, 100.0, 300.0, 700.0]),
    (5, [["a", None, None, "—"], [None, "b", None, "1,000"]], [40.0, 100.0, 200.0, 130.0]),
    (6, [["•", "We may not be able to keep our suppliers"]], [40.0, 100.0, 560.0, 120.0]),
    (7, [["$", "a long and winding label of a row"], ["$", "another long and winding label"]], [40.0, 100.0, 560.0, 120.0]),
    (8, [["This is one sentence over a whole row", None, None], ["and here it goes on with more", None, "and some words to end it"]], [40.0, 100.0, 560.0, 120.0]),
    (9, [["January 5, 2024", "Declared"], ["April 4, 2024", "Declared"]], [40.0, 100.0, 560.0, 120.0]),
    (10, [["A cell whose text is longer than forty-five characters of prose", "Another cell whose text is longer than forty-five characters"], ["Yet a cell whose text is longer than forty-five characters too", "And one more cell of more than fifty characters in its text"]], [40.0, 100.0, 560.0, 120.0]),
    (11, [["Legal matters and proceedings", None, None, "of the company as described", None, "below here"], [None, "some words of it", None, None, "and more words of it", None]], [40.0, 100.0, 560.0, 120.0]),
    (12, [], [40.0, 100.0, 560.0, 120.0]),
]
# grid, prose, header rows only
GRID_FLAGS = [(1, True, False), (2, False, False), (3, True, True), (4, False, False), (5, False, False), (6, True, False), (7, False, False), (8, True, False), (9, False, False), (10, True, False), (11, True, False), (12, False, False)]
GROUPS = [("table_group_001", "table_group", 1, "table_001,table_002", 3), ("table_003", "table", 1, "", 1), ("table_004", "table", 2, "", 1), ("table_005", "table", 2, "", 1)]


def grids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRIDS, "grid_id int, raw_rows array<array<string>>, bbox array<double>")


GRIDS_SQL = "with g(grid_id, raw_rows, bbox) as (values " + ", ".join(f"({i}, {_literal(g)}::varchar[][], {_literal(b)})" for i, g, b in GRIDS) + ") "

TITLES = [("Risk Factors", "ITEM 1A. RISK FACTORS"), ("Properties", "Legal Proceedings"), ("Market Risk Disclosures", "Disclosures about market risk"), ("", "Business")]
# twice the matched characters over all characters, or 1 where one holds the other
SIMILARITIES = [("Risk Factors", "ITEM 1A. RISK FACTORS", 1.0), ("Properties", "Legal Proceedings", 0.444444), ("Market Risk Disclosures", "Disclosures about market risk", 0.423077), ("", "Business", 0.0)]


def titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TITLES, "a string, b string")


SENTENCES = [
    (1, "Refer to Note 4 – Leases of the Notes to Consolidated Financial Statements (Part II, Item 8) for details."),
    (2, 'See the section under the heading "Liquidity and Capital Resources" for details.'),
    (3, "As described in Note 12, the plan was amended; see also Item 7A."),
    (4, "The information is set forth in our 2025 Proxy Statement, which is incorporated herein by reference."),
    (5, "The weather was fine and nobody looked at the river."),
    (6, "Please refer to our website for a copy of Item 7."),
    (7, "The 2024 Proxy Statement and Exhibit 3.1 are incorporated by reference into Part III, Item 10."),
    (8, 'It is included in "Some Heading" below.'),
    (9, 'See Part II, Item 8, "Financial Statements" and Part I, Item 1.'),
    (10, "Transactions pursuant to Section 12(b) and in accordance with Part I, Item 2 of it."),
]
# sentence, cue, target, label, part, item, title, begin, end
REFERENCES = [
    (1, "refer_to", "note_with_location", "Note 4 – Leases", "Part II", "Item 8", None, 9, 92),
    (2, "see", "heading", '"Liquidity and Capital Resources"', None, None, None, 16, 67),
    (2, "under_the_heading", "heading", '"Liquidity and Capital Resources"', None, None, None, 34, 67),
    (3, "described_in", "note_simple", "Note 12", None, None, None, 16, 23),
    (3, "see", "item_only", "Item 7A", None, "Item 7A", None, 56, 63),
    (4, "set_forth_in", "proxy_statement", "2025 Proxy Statement", None, None, None, 36, 56),
    (7, "incorporated_by_reference", "proxy_statement", "The 2024 Proxy Statement", None, None, None, 0, 24),
    (9, "see", "part_item_with_title", "Item 8", "Part II", "Item 8", "Financial Statements", 4, 43),
    (10, "pursuant_to", "part_item_with_title", "Item 2", "Part I", "Item 2", None, 62, 76),
]


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "sentence_id int, sentence string")


SCOPES = [
    (1, "How did revenue change in 2023?", "FY2024", ["FY2024", "FY2025"]),
    (2, "What was net income in 2024?", "2024", ["FY2024", "FY2025"]),
    (3, "What were the risks?", "FY2022", ["FY2024", "FY2025"]),
    (4, "What were the risks?", "FY2024", ["FY2024", "FY2025"]),
    (5, "Compare 2024 with 2025", "FY2025", ["FY2024", "FY2025"]),
    (6, "Capital spending in 2021", None, ["FY2024", "FY2025"]),
    (7, "Sales in 2024", None, ["FY2024", "FY2025"]),
]


def scopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCOPES, "id int, question string, requested string, available array<string>")


SCOPES_SQL = "with s(id, question, requested, available) as (values " + ", ".join(f"({i}, {_literal(q)}, {_literal(r)}, {_literal(a)})" for i, q, r, a in SCOPES) + ") "

# statement, what is wrong with it
STATEMENTS = [
    ("", "empty statement"),
    ("CANNOT_ANSWER", None),
    ("DROP TABLE companies", "forbidden keyword DROP"),
    ("SELECT 1 FROM companies -- all", "comments are not allowed"),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "only SELECT statements are allowed"),
    ("SELECT 1 FROM companies; SELECT 2 FROM companies", "one statement only"),
    ("SELECT * FROM accounts", "unknown table accounts"),
    ("SELECT 1", "no table"),
    ("SELECT i.fiscal_year, b.total_assets FROM income_statements i JOIN balance_sheets b ON i.company_ticker = b.company_ticker", None),
    ("SELECT * FROM companies, accounts", "unknown table accounts"),
    ("SELECT EXTRACT(YEAR FROM DATE '2025-01-01') AS y FROM companies WHERE name = 'from x'", None),
    ("SELECT name FROM companies WHERE ticker IN (SELECT ticker FROM accounts)", "unknown table accounts"),
    ("SELECT s.* FROM (WITH hidden AS (SELECT 1 AS x) SELECT x FROM hidden) t, hidden s, companies c", "unknown table hidden"),
    ("SELECT t.x FROM (WITH companies AS (SELECT 1 AS x) SELECT x FROM companies) t, companies c", "not allowed: UnresolvedWith"),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM companies", "function not allowed: reflect"),
    ("SELECT name FROM companies WHERE ticker IN (SELECT java_method('a', 'b') FROM companies)", "function not allowed: java_method"),
    ("SELECT * FROM range(5), companies", "not allowed: UnresolvedTableValuedFunction"),
    ("SELECT * FROM parquet.`/tmp/x`", "unknown table parquet.`/tmp/x`"),
    ("SELECT input_file_name() FROM companies", "function not allowed: input_file_name"),
    ("SELECT t.x FROM companies LATERAL VIEW explode(array(1)) t AS x", "not allowed: Generate"),
    ("SELECT sum(revenue) OVER (PARTITION BY company_ticker ORDER BY fiscal_year) AS running FROM income_statements", None),
    ("SELECT company_ticker, avg(revenue) AS r FROM income_statements GROUP BY 1 HAVING avg(revenue) > 3 ORDER BY r DESC LIMIT 5", None),
    ("SELECT CASE WHEN revenue > 1 THEN 'x' ELSE 'y' END AS k FROM income_statements UNION SELECT name FROM companies", None),
]


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """Rows as a query of their own."""
    return "select * from (values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, bool)) else _literal(x) for x in row) + ")" for row in rows) + f") as t({', '.join(f'"{c.strip()}"' for c in columns.split(','))})"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """Rows as a named SQL table: ``name(columns) as (values ...)``."""
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, bool)) and x is not None else _literal(x) for x in row) + ")" for row in rows) + ")"


ITEMS = [(1, "Part I", "Item 1", "Business"), (2, "Part I", "Item 1A", "Risk Factors"), (3, "Part II", "Item 7A", None), (4, None, "Signatures", "End"), (5, "Part I", "Item 2", "")]
SOURCES = [(1, "ABC_FY2025_10-K.pdf"), (2, "source.pdf"), (3, "xyz_fy2024_report.pdf")]
LOOKUP = [("f", "g1", ["t1", "t2"], 0), ("f", "t1", None, 1), ("h", "t1", [], 2)]
WORDS = [("f", 1, 50.0, 100.2, "income"), ("f", 1, 10.0, 100.0, "Net"), ("f", 1, 10.0, 120.0, "Total"), ("f", 2, 10.0, 30.0, "Cash")]
JOBS = [(1, 1, "done"), (1, 2, "running"), (2, 1, "done"), (2, 2, "done"), (2, 3, "done"), (3, 1, "queued")]
PARSES = [("f", "t1", 3, "success"), ("f", "t2", 1, None), ("f", "t3", 2, "error"), ("g", "t1", 1, "success")]
SECTIONS = [("f", "Part II", 3, "Item 7"), ("f", "Part I", 1, "Item 1"), ("f", None, 4, "Other"), ("f", "Part I", 2, "Item 2")]
CAPTIONS = [(1, "Sales rose $1,200.5 million or 12% in 2024"), (2, "Revenue FY2025"), (3, "The table shows revenue"), (4, "financial table"), (5, "revenue by region and product line")]

# --- landed files, a whole document, stores ------------------------------------

BALANCES = [
    ("ABC", "Assets", "USD", None, "2024-09-28", 500.0, "10-K", "FY", "2024-11-01"),
    ("ABC", "Assets", "USD", None, "2024-09-28", 510.0, "10-K", "FY", "2025-11-01"),
    ("ABC", "Assets", "USD", None, "2024-09-28", 520.0, "10-K", "Q4", "2026-11-01"),
    ("ABC", "CashCashEquivalentsAndShortTermInvestments", "USD", None, "2024-09-28", 60.0, "10-K", "FY", "2024-11-01"),
    ("ABC", "CashAndCashEquivalentsAtCarryingValue", "USD", None, "2024-09-28", 50.0, "10-K", "FY", "2024-11-01"),
    ("ABC", "LongTermDebtNoncurrent", "USD", None, "2024-09-28", 70.0, "10-K", "FY", "2024-11-01"),
    ("XYZ", "Assets", "USD", None, "2025-06-30", 900.0, "10-K", "FY", "2025-07-30"),
    ("XYZ", "Liabilities", "USD", None, "2025-06-30", 300.0, "10-Q", "FY", "2025-07-30"),
    ("XYZ", "StockholdersEquity", "USD", None, "2022-06-30", 100.0, "10-K", "FY", "2022-07-30"),
]


def nested(rows: list[tuple]) -> dict[str, dict]:
    """Facts as the nested documents in which they are published, by ticker."""
    out: dict = {}
    for ticker, concept, unit, *values_ in rows:
        row = {k: v for k, v in zip(("start", "end", "val", "form", "fp", "filed"), values_, strict=True) if v is not None}
        out.setdefault(ticker, {}).setdefault(concept, {"units": {}})["units"].setdefault(unit, []).append(row)
    return {t: {"cik": k, "entityName": t, "facts": {"us-gaap": f}} for k, (t, f) in enumerate(out.items())}


def landed(spark: SparkSession, name: str, files: dict[str, str]) -> str:
    """Write small files into a new folder of the shared one, as another program would; the folder's path."""
    import uuid

    from marlstone.store import own_dir

    root = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for file, text in files.items():
        out = store.create(path(f"{root}/{file}"))
        out.write(bytearray(text.encode()))
        out.close()
    return root


# source_file, chunk, type, section, header, text, previous, next
def _chunk(file: str, k: int, text: str, kind: str = "text") -> dict:
    return {"source_file": file, "chunk_id": f"text_{k}", "chunk_type": kind, "section_ref_id": "s", "header_path": ["Part I", "Item 1"], "text": text, "prev_id": f"text_{k - 1}" if k > 1 else None, "next_id": None}


CHUNK_ROW = "source_file string, chunk_id string, chunk_type string, section_ref_id string, header_path array<string>, text string, prev_id string, next_id string"
WORKSPACES = {
    "w1": [_chunk("ABC_FY2025_10-K.pdf", 1, "Sales [[TABLE:t1]] rose."), _chunk("ABC_FY2025_10-K.pdf", 2, "Costs fell."), _chunk("ABC_FY2025_10-K.pdf", 3, "x", "table")],
    "w2": [_chunk("source.pdf", 1, "Nobody named this file.")],
    "w4": [_chunk("XYZ_FY2024_10-K.pdf", 1, "Cash grew.")],
}
# workspace, rows, status, reason
AUDITS = [("w1", 2, "ready", None), ("w2", 1, "failed", "stale_source"), ("w3", 0, "failed", "no chunks"), ("w4", 1, "ready", None)]

# name, bytes, pages, text of the first page, valid
FILINGS = [
    ("good", 200_000, 80, "annual report " * 40, True),
    ("small", 99_999, 80, "annual report " * 40, False),
    ("short", 200_000, 19, "annual report " * 40, False),
    ("bare", 200_000, 80, "annual report", False),
    ("refused", 200_000, 80, "Your request came from an Undeclared Automated Tool. " * 10, False),
    ("viewer", 200_000, 80, "Inline Viewer " * 40, False),
    ("none", 200_000, None, None, False),
]
# address, subject, body, ok, reason
MAILS = [("a.b@c.org", "Results", "They rose.", True, None), ("a b@c.org", "x", "y", False, "invalid address"), ("a@c", "x", "y", False, "invalid address"), ("a@c.de", "x", "  ", False, "empty body"), (None, "x", "y", False, "invalid address")]

# a document of four pages: contents, then two items with subsections
PAGES = [
    (1, ["Table of Contents", "Item 1.", "Business", "3", "Item 1A.", "Risk", "Factors", "4", "Item 2.", "Properties", "5", "Item 3.", "Legal Proceedings", "5"]),
    (2, ["Item 1. Business", "OVERVIEW", "We make things.", "Products", "We sell them."]),
    (3, ["Item 1A. Risk Factors", "MARKET RISK", "Prices may fall."]),
    (4, ["Item 2. Properties", "We own a plant."]),
]
BOLD = {"Products"}


def layout_lines(spark: SparkSession) -> DataFrame:
    """The document as line records: capitals are centred and set apart, some lines are bold."""
    from marlstone.schemas import LINE

    rows = []
    for page, lines in PAGES:
        for k, line in enumerate(lines):
            big = line.isupper()
            rows.append(("d.pdf", page, k, line, False, 250.0 if big else 72.0, 362.0 if big else 300.0, 100.0 + 40 * k, 110.0 + 40 * k, 612.0, 10.0, line in BOLD, False, ["A"]))
    return spark.createDataFrame(rows, LINE)


# seq, item, title, page, similarity is 1, text
SECTION_ROWS = [(1, "Item 1", "Business", 2, "Item 1. Business OVERVIEW We make things. Products We sell them. [[PAGE 3]]"), (2, "Item 1a", "Risk Factors", 3, "Item 1A. Risk Factors MARKET RISK Prices may fall. [[PAGE 4]]"), (3, "Item 2", "Properties", 4, "Item 2. Properties We own a plant.")]
# section, subsection, title, level, page, path
SUBSECTION_ROWS = [(1, 1, "OVERVIEW", 2, 2, "OVERVIEW"), (1, 2, "Products", 2, 2, "Products"), (2, 1, "MARKET RISK", 2, 3, "MARKET RISK")]

# table regions, word lines and headings of a document of three pages
TABLE_REGIONS = [
    ("table_001", 1, 40.0, 100.0, 560.0, 120.0, [["(in millions)", "2025", "2024"], ["Total revenue", "10", "9"]]),
    ("table_002", 1, 40.0, 130.0, 560.0, 150.0, [["(in millions)", "2025", "2024"], ["Net income", "5", "4"]]),
    ("table_003", 1, 40.0, 300.0, 560.0, 400.0, [["The company designs and sells a range of", "products in many countries and also offers"], ["services to customers which are", None]]),
    ("table_004", 2, 40.0, 400.0, 300.0, 480.0, [["Assets", "1"], ["Debt", "2"]]),
    ("table_005", 2, 50.0, 410.0, 200.0, 430.0, [["Debt", "2"]]),
    ("table_006", 2, 40.0, 720.0, 560.0, 760.0, [["Year", "Amount", "Fair value"], ["2025", "7", "8"]]),
    ("table_007", 3, 40.0, 60.0, 560.0, 120.0, [["Year", "Amount", "Fair value"], ["2024", "5", "6"]]),
]
WORD_LINES = [(2, 402.0, ["Assets", "1", "4"]), (2, 425.0, ["Debt", "2", "5"]), (2, 450.0, ["Total", "3", "9"]), (2, 470.0, ["Net income", "4", "8"]), (2, 500.0, ["We sell many things"])]
# section, first page, offset, and headings: section, id, page, y
TABLE_SECTIONS = [("I1", 1, 0), ("I2", 2, 500)]
TABLE_HEADS = [("I1", "I1::sub_001", 1, 50.0), ("I1", "I1::sub_002", 1, 250.0), ("I2", "I2::sub_001", 2, 300.0), ("I2", "I2::sub_002", 2, 415.0)]
# table, type, page, end, section, heading, rows, sources
TABLES = [
    ("table_004", "table", 2, 2, "I2", "I2::sub_001", 4, ""),
    ("table_group_001", "table_group", 1, 1, "I1", "I1::sub_001", 3, "table_001,table_002"),
    ("table_group_002", "table_group", 2, 3, "I2", "I2::sub_001", 3, "table_006,table_007"),
]
TABLE_STEPS = [("raw_regions", 6), ("after_same_page_link", 5), ("after_dedupe", 4), ("after_relink_same_page", 4), ("final_tables", 3), ("table_groups", 2)]


def table_document(spark: SparkSession) -> dict[str, DataFrame]:
    from marlstone.schemas import TABLE

    rows = [("t.pdf", i, "table", p, p, [x0, y0, x1, y1], g, [], None, None, False, k) for k, (i, p, x0, y0, x1, y1, g) in enumerate(TABLE_REGIONS)]
    return {
        "regions": spark.createDataFrame(rows, TABLE),
        "lines": spark.createDataFrame([("t.pdf", *x) for x in WORD_LINES], "file string, page int, top double, cells array<string>"),
        "refs": spark.createDataFrame([("t.pdf", *x) for x in TABLE_SECTIONS], "file string, section_ref_id string, start_page int, start_offset int"),
        "heads": spark.createDataFrame([("t.pdf", *x) for x in TABLE_HEADS], "file string, section_ref_id string, sub_id string, page int, y0 double"),
    }


# block, page, box, and the images kept: page, section
BLOCKS = [(1, 1, [100.0, 500.0, 300.0, 600.0]), (2, 1, [100.0, 500.0, 150.0, 600.0]), (3, 3, [100.0, 200.0, 180.0, 260.0])]
IMAGES = [("image_001", 1, "I1"), ("image_002", 3, "I2")]

COMPANY_ROWS = [("ABC", "A", "1", "2", "tech", "0928", 0), ("XYZ", "X", "2", "3", "food", "0630", 1), ("ABC", "A again", "9", "9", "tech", "0928", 2)]
PART_ROWS = [("ABC", "2024-09-28", "FY", "North", 60, 0), ("ABC", "2024-09-28", "FY", "North", 99, 1), ("ABC", "2024-09-28", "FY", "South", 41, 2), ("ABC", "2024-09-28", "FY", "East", None, 3), ("XYZ", "2025-06-30", "FY", "All", 500, 4)]


def star(spark: SparkSession) -> dict[str, DataFrame]:
    """The five tables of the fixtures."""
    from marlstone import schemas
    from marlstone.operators import facts as FA

    companies = spark.createDataFrame(COMPANY_ROWS, schemas.COMPANIES + ", pos int")
    parts = spark.createDataFrame(PART_ROWS, schemas.BREAKDOWN + ", pos int")
    docs = documents(spark, [*FACTS, *BALANCES])
    return FA.star(docs, companies, parts, parts.filter("name <> 'South'"))

# id, rows, text around, markdown, topic, labels of the markdown
TOPICS = [
    (1, [["Revenue", "10"], ["Gross margin", "5"], ["Operating income", "3"]], "SUMMARY RESULTS OF OPERATIONS Fiscal Year 2025 Compared with Fiscal Year 2024", None, "consolidated summary results of operations with revenue, margins, and earnings FY2025 vs FY2024", ""),
    (2, [["Research and development", "5"], ["As a percent of revenue", "2%"]], "OPERATING EXPENSES in 2025 and 2024", "| Label | 2025 |\n|---|---|\n| Sales | 5 |\n| Sales | 6 |\n| (x) | 1 |\n| Up $5 | 2 |", "research and development operating expenses and percent of revenue FY2025 vs FY2024", "Label,Sales,Up [amount]"),
    (3, [["Marketing", "5"]], "Operating expenses rose", None, "marketing operating expenses", ""),
    (4, [["Total revenue", "5"], ["Net income", "2"]], "", None, "consolidated summary results of operations with total revenue, net income", ""),
    (5, [["Inventories", "5"], ["Receivables", "2"]], "2025 2024", None, "Inventories FY2025 vs FY2024", ""),
    (6, [["$ 5", "1"], ["(In millions)", ""]], None, "no table", "", ""),
]
