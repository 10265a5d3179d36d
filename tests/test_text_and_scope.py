import pytest
from pyspark.sql import functions as F

from marlstone.functions import chunker, crossrefs, scope, vectors
from marlstone.functions import text as T


def one(spark, expr, **values):
    values = values or {"x": "1"}
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return rows.select(expr.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [("  a  b \n", "a b"), (None, ""), ("", "")])
def test_clean_text(spark, text, want):
    assert one(spark, T.clean_text(F.col("c")), c=text) == want


def test_tokens_and_sentences(spark):
    assert one(spark, T.bm25_tokens(F.col("c")), c="Net-Income rose 12.5% IN 2025") == ["net", "income", "rose", "12", "5", "in", "2025"]
    assert one(spark, T.sentences(F.col("c")), c="One. Two?  Three! four") == ["One.", "Two?", "Three!", "four"]
    assert one(spark, T.last_sentences(F.col("c"), 2), c="One. Two. Three.") == "Two. Three."
    assert one(spark, T.trimmed_sentences(F.col("c")), c="A. B. C. D. E.") == "A. B. ... D. E."
    assert one(spark, T.token_count(F.col("c")), c=None) == 0


def test_texts_for_models(spark):
    assert one(spark, T.rerank_text(F.col("p"), F.col("c")), p=["a", "b"], c="body") == "Section: a > b\nbody"
    assert one(spark, T.searchable_text(F.col("p"), F.col("c"), F.lit("id")), p=[], c="") == "id"
    assert one(spark, T.embedding_text(F.col("c")), c="x [[TABLE:t1]]  y") == "x y"
    assert one(spark, T.bare_json(F.col("c")), c='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.bare_json(F.col("c")), c='so: {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'


def test_memory_and_overlap_scores(spark):
    assert one(spark, T.memory_score(F.col("q"), F.col("c")), q="net income 2025", c="income of 2025") == pytest.approx(2 / 3)
    assert one(spark, T.lexical_overlap(F.col("q"), F.col("c")), q="the net margins of", c="Net margin and networks") == 1
    assert one(spark, T.money(F.lit(1.5e9))) == "$1.50B" and one(spark, T.money(F.lit(2.25e6))) in ("$2.3M", "$2.2M") and one(spark, T.money(F.lit(1234.0))) == "$1,234"


def test_cosine(spark):
    v = lambda a, b: spark.sql(f"select array({a}) a, array({b}) b").select(vectors.cosine(F.col("a"), F.col("b")).alias("v")).first().v
    assert round(v("1f, 2f", "3f, 4f"), 6) == 0.98387 and round(v("1f, 2f", "1f, 2f"), 6) == 1.0 and v("0f, 0f", "1f, 2f") == 0.0


def test_scope(spark):
    assert one(spark, scope.scope_list(F.col("c"), scope.ticker), c=" abc, ,xyz") == ["ABC", "XYZ"]
    assert one(spark, scope.scope_list(F.col("c"), scope.fiscal_year), c="2025,fy2024") == ["FY2025", "FY2024"]
    assert one(spark, scope.scope_list(F.col("c"), scope.ticker), c=" , ") is None
    assert tuple(one(spark, scope.source_identity(F.col("c")), c="abc_FY2025_10-K.pdf")) == ("ABC", "FY2025")
    assert tuple(one(spark, scope.source_identity(F.col("c")), c="source.pdf")) == (None, None)
    assert one(spark, scope.renamed(F.col("c"), "old.pdf", "new.pdf"), c="old.pdf::text_1") == "new.pdf::text_1"
    assert one(spark, scope.metric_years(F.col("c")), c="2025 against 2023, 2025 and 1999") == [2023, 2025]
    assert one(spark, scope.header_path(F.col("p"), F.col("i"), F.col("t")), p="Part I", i="Item 1A", t="Risk Factors") == ["Part I", "Item 1", "Item 1A", "Risk Factors"]
    assert one(spark, scope.header_path(F.col("p"), F.col("i"), F.col("t")), p="Part I", i="Item 2", t="Properties") == ["Part I", "Item 2", "Properties"]
    assert one(spark, scope.part_of_item(F.col("i")), i="Item 7A") == "Part II"


def test_chunks_cover_all_words():
    body = " ".join(f"Sentence {k} has some words in it." for k in range(400))
    pieces = chunker.packed(body, 100, 0)
    assert " ".join(pieces).split() == body.split() and all(len(p.split()) <= 100 for p in pieces)
    overlapped = chunker.packed(body, 100)
    assert overlapped[1].split()[:14] == overlapped[0].split()[-14:]
    assert chunker.with_header("short body", "Part > Item") == ["Part > Item\n\nshort body"] and chunker.with_header("  ", "x") == []
    assert all(len(p.split()) <= 500 for p in chunker.with_header(body * 3, "Head"))
    assert chunker.packed("w " * 1000, 430) == [" ".join(["w"] * n) for n in (430, 430, 140)]


def test_cross_references():
    found = crossrefs.extract("Refer to Note 4 – Leases of the Notes to Consolidated Financial Statements (Part II, Item 8).")
    assert found[0]["target_type"] == "note_with_location" and found[0]["item"] == "Item 8"
    assert crossrefs.extract('See under the heading "Liquidity"')[0]["target_label"] == '"Liquidity"'
    back = crossrefs.extract("Our 2025 Proxy Statement is incorporated herein by reference.")
    assert [r["target_type"] for r in back] == ["proxy_statement"]
    assert crossrefs.extract("See the equitable remedies.") == [] and crossrefs.extract(None) == []
