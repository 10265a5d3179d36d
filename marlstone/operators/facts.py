"""Financial facts: nested company documents to a wide star schema."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Public taxonomy tags per field, in order of priority.
INCOME = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "cost_of_revenue": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization"],
    "gross_profit": ["GrossProfit"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "eps_basic": ["EarningsPerShareBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "research_and_development": ["ResearchAndDevelopmentExpense"],
    "total_operating_expenses": ["OperatingExpenses", "CostsAndExpenses"],
}
BALANCE = {
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "stockholders_equity": ["StockholdersEquity"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"],
    "total_debt": ["LongTermDebt", "LongTermDebtNoncurrent"],
    "short_term_debt": ["ShortTermBorrowings", "CommercialPaper"],
    "accounts_receivable": ["AccountsReceivableNetCurrent"],
    "total_current_assets": ["AssetsCurrent"],
    "total_current_liabilities": ["LiabilitiesCurrent"],
}
YEARS = (2023, 2024, 2025)


def concepts(spark: SparkSession, fields: dict[str, list[str]]) -> DataFrame:
    """(``field``, ``field_pos``, ``concept``, ``priority``): a dimension of a few rows."""
    rows = [(f, k, c, p) for k, (f, names) in enumerate(fields.items()) for p, c in enumerate(names)]
    return spark.createDataFrame(rows, "field string, field_pos int, concept string, priority int")


def flat_facts(documents: DataFrame) -> DataFrame:
    """Nested documents (``ticker``, ``facts``) to fact rows: the dollar unit, else dollars per share."""
    concept = documents.select("ticker", F.explode(F.col("facts.us-gaap")).alias("concept", "body"))
    unit = F.coalesce(F.col("body.units")["USD"], F.col("body.units")["USD/shares"])
    return concept.select("ticker", "concept", F.posexplode(unit).alias("pos", "f")).select("ticker", "concept", "pos", "f.start", "f.end", "f.val", "f.fp", "f.form", "f.filed")


def annual(start, end):
    """350 to 380 days; dates that can't be read are not annual."""
    days = F.date_diff(F.try_to_date(end, "yyyy-MM-dd"), F.try_to_date(start, "yyyy-MM-dd"))
    return F.coalesce(days.between(350, 380), F.lit(False))


def filtered(facts: DataFrame, fields: dict[str, list[str]], form: str = "10-K") -> DataFrame:
    """Facts of the wanted concepts and form, with field and priority."""
    dim = concepts(facts.sparkSession, fields)
    return facts.join(F.broadcast(dim), "concept").filter(F.col("form") == form)  # a row per concept


def one_per_field(facts: DataFrame, income: bool, years: tuple[int, ...] = YEARS) -> DataFrame:
    """One fact per ticker, field and period end: lowest priority, latest filing, first arrival."""
    own = facts.filter(F.col("val").isNotNull() & F.substring("end", 1, 4).cast("int").isin(*years))
    own = own.filter(annual(F.col("start"), F.col("end"))) if income else own.filter(F.col("fp") == "FY")
    order = Window.partitionBy("ticker", "field", "end").orderBy("priority", F.desc("filed"), "pos")
    return own.withColumn("turn", F.row_number().over(order)).filter("turn = 1").drop("turn")


def wide(facts: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """A row per ticker and period end, a column per field; the period starts where the first field's does."""
    rows = facts.groupBy("ticker", "end").pivot("field", list(fields)).agg(F.first("val"))
    start = facts.groupBy("ticker", "end").agg(F.min_by("start", "field_pos").alias("period_start"))
    out = rows.join(start, ["ticker", "end"])
    real = {"eps_basic", "eps_diluted"}
    values = [F.col(f) if f in real else F.col(f).cast("bigint").alias(f) for f in fields]
    return out.select(F.col("ticker").alias("company_ticker"), F.year(F.to_date("end")).alias("fiscal_year"), "period_start", F.col("end").alias("period_end"), F.lit("FY").alias("period_type"), *values)


def income_statements(documents: DataFrame, years: tuple[int, ...] = YEARS) -> DataFrame:
    return wide(one_per_field(filtered(flat_facts(documents), INCOME), True, years), INCOME)


def balance_sheets(documents: DataFrame, years: tuple[int, ...] = YEARS) -> DataFrame:
    return wide(one_per_field(filtered(flat_facts(documents), BALANCE), False, years), BALANCE).drop("period_start")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key; rows with a null key stay."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def last_values(facts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write of a non-blank value per key."""
    own = facts.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return own.groupBy(*key).agg(F.max_by("value", F.struct(*order)).alias("value"))


def breakdown(rows: DataFrame, name: str) -> DataFrame:
    """Revenue by segment or region: rows without a revenue are left out, of equal keys the first by ``pos`` stays."""
    own = keep_first(rows.filter("revenue is not null"), ["company_ticker", "period_end", "period_type", "name"], "pos")
    return own.select("company_ticker", F.year(F.to_date("period_end")).alias("fiscal_year"), "period_end", "period_type", F.col("name").alias(name), "revenue")


def star(documents: DataFrame, companies: DataFrame, segments: DataFrame, regions: DataFrame, years: tuple[int, ...] = YEARS) -> dict[str, DataFrame]:
    """The five tables.  ``companies``, ``segments`` and ``regions`` have ``pos``, their place in the source, which decides between equal keys."""
    return {
        "companies": keep_first(companies, ["ticker"], "pos").drop("pos"),
        "income_statements": income_statements(documents, years),
        "balance_sheets": balance_sheets(documents, years),
        "segment_revenue": breakdown(segments, "segment_name"),
        "geographic_revenue": breakdown(regions, "region"),
    }


def write_star(out: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Build the tables anew under ``out``; (``table``, ``rows``) as read back."""
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        counts.append(df.sparkSession.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    return functools.reduce(DataFrame.union, counts)


def enum_catalog(tables: dict[str, DataFrame], key: str = "company_ticker") -> DataFrame:
    """(``field``, ``key``, ``names``): the distinct values of one column per company, in order; ``tables`` has the table of each column."""
    rows = [df.select(F.lit(field).alias("field"), F.col(key).alias("key"), F.col(field).alias("name")) for field, df in tables.items()]
    return functools.reduce(DataFrame.union, rows).groupBy("field", "key").agg(F.array_sort(F.collect_set("name")).alias("names"))


def revenue_gaps(income: DataFrame, parts: DataFrame) -> DataFrame:
    """Where the parts of a breakdown don't add up to the revenue: (``company_ticker``, ``fiscal_year``, ``gap``)."""
    total = parts.groupBy("company_ticker", "fiscal_year").agg(F.sum("revenue").alias("parts"))
    return income.join(total, ["company_ticker", "fiscal_year"]).select("company_ticker", "fiscal_year", (F.col("parts") - F.col("revenue")).alias("gap")).filter("gap <> 0")
