"""Filings and the index of their chunks: what is new, what is missing, what statement a column is of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import TAGS

#: Columns of the three statements.
INCOME = "total_revenue cost_of_revenue gross_profit research_and_development sales_and_marketing sales_general_and_admin general_and_administrative total_operating_expenses operating_income ebitda interest_income interest_expense other_income income_before_taxes income_tax_expense net_income earnings_per_share_basic earnings_per_share_diluted weighted_average_shares_basic weighted_average_shares_diluted".split()
BALANCE = "cash_and_cash_equivalents short_term_investments cash_and_short_term_investments accounts_receivable inventory prepaid_expenses total_current_assets total_non_current_assets property_plant_equipment goodwill intangible_assets long_term_investments other_assets total_assets accounts_payable accrued_liabilities commercial_paper other_short_term_borrowings current_portion_long_term_debt finance_lease_liability_current operating_lease_liability_current total_current_liabilities long_term_debt non_current_long_term_debt finance_lease_liability_noncurrent operating_lease_liability_noncurrent other_long_term_liabilities total_non_current_liabilities total_liabilities common_stock retained_earnings accumulated_oci total_stockholders_equity total_liabilities_and_equity".split()
CASH_FLOW = "net_cash_from_operating_activities depreciation_and_amortization depreciation amortization stock_based_compensation changes_in_accounts_receivable changes_in_other_receivable changes_in_inventory changes_in_accounts_payable changes_in_other_operating_assets changes_in_other_operating_liabilities net_cash_from_investing_activities capital_expenditures purchases_of_intangible_assets purchases_of_investments sales_of_investments acquisitions divestitures net_cash_from_financing_activities proceeds_from_debt repayment_of_long_term_debt repayment_of_short_term_debt net_repayment_of_commercial_paper dividends_paid share_repurchases proceeds_from_stock_issuance net_change_in_cash".split()
#: Words in a tag that tell its statement, where no column does; the first list with a match decides.
TAG_WORDS = {
    "balance_sheet": "assets liabilities equity stockholders cash receivable inventory payable debt goodwill intangible property plant equipment investment retained earnings".split(),
    "income_statement": "revenue income expense cost profit loss operating tax interest sales marketing research development administrative".split(),
    "cash_flow": "financing investing activities depreciation amortization capital expenditure dividend repurchase acquisition".split(),
}
QUARTERS = ["1", "2", "3"]


def statement_of(column: Column) -> Column:
    """income_statement, balance_sheet, cash_flow or unknown, of a column."""
    return F.when(column.isin(INCOME), "income_statement").when(column.isin(BALANCE), "balance_sheet").when(column.isin(CASH_FLOW), "cash_flow").otherwise("unknown")


def statement_of_tag(tag: Column) -> Column:
    """The same of a tag: by the column that it is filed for, else by its words."""
    low = F.lower(tag)
    column = F.element_at(F.create_map(*(F.lit(x) for t, c in TAGS.items() for x in (t.lower(), c))), low)
    by_word = F.lit("unknown")
    for name, words in reversed(TAG_WORDS.items()):
        by_word = F.when(low.rlike("|".join(words)), name).otherwise(by_word)
    return F.when(column.isNotNull(), statement_of(column)).otherwise(by_word)


def storage(filings: DataFrame, kind: str, size: str, date: str) -> DataFrame:
    """By kind: number, bytes, first and last date."""
    return filings.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min(date).alias("first"), F.max(date).alias("last"))


def older(filings: DataFrame, years: int, as_of: str, date: str) -> DataFrame:
    """What a clean-up would delete: filings of known date that are older than so many years."""
    return filings.filter(F.col(date) < F.add_months(F.to_date(F.lit(as_of)), -12 * years))


FILING = ["ticker", "form_type", "fiscal_year", "fiscal_quarter"]


def new_chunks(chunks: DataFrame, indexed: DataFrame, key: list[str] = FILING) -> DataFrame:
    """Chunks of filings of which the index has none: a filing is its company, form, year and quarter, a missing quarter being one of its own. What moves of the index is a row a filing."""
    marks = [F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(f"_{k}") for k in key]
    known = indexed.select(*marks).distinct()
    out = chunks.select("*", *marks).join(known, [f"_{k}" for k in key], "left_anti")
    return out.drop(*(f"_{k}" for k in key))


def missing_reports(index: DataFrame, first: int, last: int, key: str = "ticker") -> DataFrame:
    """form_type, fiscal_year and fiscal_quarter of the yearly and quarterly reports that each key lacks: years first to last, quarters 1 to 3 of each."""
    report = lambda form, y, q: F.struct(F.lit(form).alias("form_type"), y.alias("fiscal_year"), F.lit(q).alias("fiscal_quarter"))
    wanted = F.flatten(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda y: F.array(report("10-K", y, "FY"), *(report("10-Q", y, q) for q in QUARTERS))))
    expected = index.select(key).distinct().select(key, F.inline(wanted))
    held = index.select(key, "form_type", F.col("fiscal_year").cast("int").alias("fiscal_year"), F.when(F.col("form_type") == "10-K", "FY").otherwise(F.regexp_replace("fiscal_quarter", "(?i)^q", "")).alias("fiscal_quarter")).distinct()
    return expected.join(held, expected.columns, "left_anti")


def ticker_of(path: Column, text: Column) -> Column:
    """The ticker of a filing: the beginning of its file's name (abc-...), else the last folder of 2 to 5 letters, else what the text gives as its trading symbol; in capitals."""
    name = F.lower(F.substring_index(path, "/", -1))
    folders = F.filter(F.split(path, "/"), lambda p: p.rlike("^[A-Za-z]{2,5}$"))
    said = F.regexp_extract(text, r"(?i)(?:trading symbol|ticker symbol|nasdaq|nyse)(?:\(s\))?\s*:?\s*([A-Z]{1,5})\b", 1)
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(name, "^([a-z]{2,5})-", 1), F.lit("")), F.try_element_at(folders, F.lit(-1)), F.nullif(said, F.lit(""))))
