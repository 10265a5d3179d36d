"""Every registered query runs on the smallest tables; where it has SQL, DuckDB gives the same rows."""

import pytest

from marlstone import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    import os

    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    if name not in queries.ORACLE_SQL:
        assert got.count() >= 1
        return
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = [[r[c] for c in sorted(got.columns)] for r in got.collect()]
    order = [want.columns.index(c) for c in sorted(want.columns)]
    theirs = [[r[k] for k in order] for r in want.fetchall()]

    def plain(v):
        return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)

    assert sorted(repr(list(map(plain, r))) for r in mine) == sorted(repr(list(map(plain, r))) for r in theirs)


#: Sentences that begin or end with their place, white space of all kinds, texts without a sentence, the edge of a cut.
ODD = [
    None, "", " \t\n", "0", "0. 1. 2", "0a0. 1b1. 2c2", "Ezboes. 16.195.23.11", "One. Two. 22.33.22", *[". ".join(["x"] * k + [f"{k}y{k}"]) for k in range(9, 13)],
    " lead. tail. ", "\tlead.\n\ttail.\n", "\u00a0a. b\u00a0", "a.\u3000 b.\u2003\u3000 c\u3000", "a.\u00a0b. c\u00a0d", "a.\x0bb. \x0bc", "a.\x01b!\x01\x01c", "a.\x85b. c\u2028", "?! ... a?  b!!\r\n c", "...", ". . .",
    *["w" * 200 + ". " + "v" * k + "." for k in (216, 217, 218, 219)], "w" * 418 + " v" + "u" * 9, "w" * 418 + "\u3000v" + "u" * 9, "\U0001f600" * 421, "e\u0301" * 211,
]


@pytest.mark.parametrize("name", ["sentence_window_first_last", "excerpt"])
def test_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_interval_section_takes_the_first_row_of_a_line(spark, tmp_path):
    """Lines whose rows lie in several files at different heights: the first in the table has the height."""
    day = "timestamp '2000-01-01' + make_interval(0, 0, 0, cast(200 * {} as int))"
    spark.range(40).selectExpr("id as o_orderkey", "cast(0 as bigint) as o_custkey", day.format("id % 8") + " as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(0, 4000, 1, 8).selectExpr("(id * 7) % 40 as l_orderkey", "cast(id % 3 as int) as l_linenumber", day.format("(id % 8)") + " as l_shipdate", "cast((id * id) % 50 + if(id % 11 = 0, null, 0) as double) as l_quantity")
    lines.write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect(config={"threads": 1})
    for name in ("orders", "lineitem"):
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(c.sql(queries.ORACLE_SQL["interval_section"]).fetchall())
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = queries.QUERIES["interval_section"](spark, str(tmp_path)).select("asset_id", "section_ref_id")
            assert sorted(map(tuple, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
