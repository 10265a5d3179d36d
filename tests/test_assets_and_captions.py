import pytest
from pyspark.sql import functions as F

from marlstone import fixtures
from marlstone.functions import bodies, captions
from marlstone.operators import assets


def v(spark, column, **values):
    kinds = {k: "array<array<string>>" if isinstance(x, list) else "string" for k, x in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("Sales rose $1,200.5 million in 2024", "Sales rose [amount] in [num]"), ("up 12%", "up [num]"), (None, "")])
def test_masked_context(spark, text, want):
    assert v(spark, captions.masked_context(F.col("c")), c=text) == want


def test_topics(spark):
    assert v(spark, captions.plain_topic(F.col("c")), c="Revenue of $5 million, up 10%, FY2025.") == "Revenue of , up , FY2025"
    assert v(spark, captions.summary(F.col("p"), F.col("t")), p="Part II > Item 8", t="cash flows") == "Part II > Item 8 · cash flows"
    assert v(spark, captions.summary(F.col("p"), F.col("t")), p="", t="cash flows") == "cash flows"
    assert tuple(v(spark, captions.year_pair(F.col("c")), c="Fiscal Year 2024 Compared with Fiscal Year 2023; 2025")) == ("2024", "2023")
    assert tuple(v(spark, captions.year_pair(F.col("c")), c="2023, 2025 and 2024 and 2099")) == ("2025", "2024")
    assert v(spark, captions.year_pair(F.col("c")), c="only 2024") is None
    assert v(spark, captions.with_years(F.col("t"), F.col("c")), t="operating expenses", c="2025 2024") == "operating expenses FY2025 vs FY2024"
    assert v(spark, captions.with_years(F.col("t"), F.col("c")), t="margins FY vs FY", c="2025 2024") == "margins FY2025 vs FY2024"
    assert v(spark, captions.with_years(F.col("t"), F.col("c")), t="board of directors", c="2025 2024") == "board of directors"
    assert v(spark, captions.row_labels(F.col("r")), r=[["(In millions)"], ["Revenue", "1"], ["$ 5"], ["", "x"], ["Cost", "2"]]) == ["Revenue", "Cost"]
    assert v(spark, captions.weak_topic(F.col("c")), c="Revenue FY2025") and not v(spark, captions.weak_topic(F.col("c")), c="revenue by region and product line")
    assert v(spark, captions.boilerplate(F.col("c")), c="The table shows revenue")


TABLE = [["", "2025", "2024"], ["Revenue", "100", "90"], ["Costs", "40", "35"]]


def test_bodies_end_where_their_table_starts():
    body, anchors, refs = bodies.cleaned("Heading Sales were strong this year in all regions, as follows: Revenue 100 90 Costs 40 35", "Heading", [("t1", TABLE[1:])])
    assert body == "Sales were strong this year in all regions, as follows. [[TABLE:t1]]" and refs == ["t1"]
    assert body[anchors[0][1] :] == anchors[0][2] == "[[TABLE:t1]]"


def test_bodies_keep_the_text_between_tables():
    other = [["Assets", "7", "6"]]
    body, anchors, refs = bodies.cleaned("First comes revenue. Revenue 100 90 Costs 40 35 Then we turn to assets. Assets 7 6 That is all.", "", [("t2", other), ("t1", TABLE[1:])])
    assert refs == ["t1", "t2"] and body == "First comes revenue. [[TABLE:t1]] Then we turn to assets. [[TABLE:t2]] That is all."
    assert all(body[at : at + len(m)] == m for _, at, m in anchors)
    assert bodies.cleaned("1 2 3 4 5 6", "", []) == ("", [], []) and bodies.cleaned(None, None, []) == ("", [], [])
    assert bodies.cleaned("Revenue 100 90", "", [("t1", TABLE[1:])])[0] == "[[TABLE:t1]]"


def test_text_around_markers(spark):
    text = "One. Two. Three. [[TABLE:a]] Four. Five. Six. [[TABLE:b]] Seven."
    assert bodies.around_markers(text, ["a"]) == "Two. Three. [[TABLE:a]] Four. Five."
    assert bodies.around_markers("no marker", None) == "no marker" and bodies.around_markers(text, ["z"]) == text
    rows = spark.createDataFrame([(text, ["b"])], "content string, wanted array<string>")
    assert rows.select(bodies.around_udf("content", "wanted").alias("v")).first().v == "Five. Six. [[TABLE:b]] Seven."
    units = spark.createDataFrame([("Revenue 100 90", "", [("t1", [["Revenue", "100", "90"]])])], "body string, heading string, tables array<struct<table_id: string, raw_rows: array<array<string>>>>")
    assert units.select(bodies.clean_udf("body", "heading", "tables").alias("v")).first().v.table_refs == ["t1"]


def test_images(spark):
    blocks = spark.createDataFrame([("f", 1, 0, [0.0, 0.0, 100.0, 80.0]), ("f", 1, 1, [0.0, 0.0, 50.0, 80.0]), ("f", 3, 0, [0.0, 0.0, 90.0, 60.0])], "file string, page int, block_no int, bbox array<double>")
    refs = spark.createDataFrame([("f", "s1", 1, 0), ("f", "s2", 3, 50)], "file string, section_ref_id string, start_page int, start_offset int")
    assert [(r.image_id, r.page, r.section_ref_id) for r in assets.images(blocks, refs).orderBy("image_id").collect()] == [("image_001", 1, "s1"), ("image_002", 3, "s2")]


def test_rescan_bands_and_continuations(spark):
    lines = spark.createDataFrame([("f.pdf", 1, 102.0, ["Total revenue", "10", "9"]), ("f.pdf", 1, 114.0, ["Cost of revenue", "4", "3"]), ("f.pdf", 1, 126.0, ["Net income", "5", "4"]), ("f.pdf", 1, 140.0, ["We sell things"]), ("f.pdf", 1, 150.0, ["Total debt", "1", "2"]), ("f.pdf", 1, 760.0, ["Year", "Amount"]), ("f.pdf", 3, 100.0, ["Cash", "5", "4"])], "file string, page int, top double, cells array<string>")
    got = {r.table_id: r for r in assets.rescanned(fixtures.regions(spark), lines).collect()}
    assert got["table_001"].rescanned and [r[0] for r in got["table_001"].raw_rows] == ["Total revenue", "Cost of revenue", "Net income"] and got["table_001"].bbox[3] == 138.0
    assert not got["table_004"].rescanned
    bands = assets.header_bands(lines, fixtures.regions(spark))
    assert [(r.page, r.raw_rows) for r in bands.collect()] == [(1, [["Year", "Amount"]])]
    later = bands.withColumn("page", F.lit(2))
    assert [(r.page, r.raw_rows) for r in assets.continuations(later, lines, fixtures.regions(spark)).collect()] == [(3, [["Cash", "5", "4"]])]
    assert assets.continuations(bands, lines.withColumn("page", F.lit(2)), fixtures.regions(spark)).count() == 0


def test_parse_states(spark):
    t = spark.createDataFrame([("f", "t1", 3, "Item 8", "success", "s"), ("f", "t2", 1, "Item 1", None, None), ("f", "t3", 2, None, "error", None)], "source_file string, table_id string, page_start int, item string, status string, summary string")
    assert [r.table_id for r in assets.to_parse(t, min_page=2, without_items=["Item 8"]).collect()] == ["t3"] and [r.table_id for r in assets.to_parse(t, n=2).collect()] == ["t2", "t3"]
    s = assets.parse_status(t).first()
    assert (s.tables, s.parsed, s.missing, s.failed) == (3, 1, 1, 1)
    old = spark.createDataFrame([("t2", "success", "kept")], "table_id string, status string, summary string")
    assert {r.table_id: r.summary for r in assets.carried_over(t, old).collect()} == {"t1": "s", "t2": "kept", "t3": None}


def test_views(spark):
    s = spark.createDataFrame([("f", "Part II", 2, "Item 7"), ("f", "Part I", 1, "Item 1"), ("f", None, 3, "X"), ("f", "Part I", 0, "Item 0")], "file string, part string, seq int, item string")
    assert [(r.part, r.items) for r in assets.parts(s).orderBy("place").collect()] == [("Part I", ["Item 0", "Item 1"]), ("Part II", ["Item 7"]), ("Unknown", ["X"])]
    steps = spark.createDataFrame([(1, 1, "sql", "q", "o"), (1, 2, "final_answer", "", "")], "run_id int, step int, tool string, input string, output string")
    assert [(r.pos, r.kind, r.content) for r in assets.trace_rows(steps).orderBy("pos").collect()] == [(1, "tool_call", "q"), (2, "observation", "o")]
    jobs = spark.createDataFrame([(1, "done"), (1, "running"), (2, "done"), (2, "done"), (2, "done")], "job_id int, state string")
    assert {r.job_id: r.percent for r in assets.progress(jobs).collect()} == {1: 41, 2: 100}
    assert assets.last_events(spark.range(100).selectExpr("1 as job_id", "id as seq")).count() == 80
    c = spark.createDataFrame([("c1", ["a", "b"], " x  y ", None)], "chunk_id string, header_path array<string>, text string, token_count bigint")
    assert tuple(assets.chunk_rows(c).first()) == ("c1", "a > b", "x y", 2)
