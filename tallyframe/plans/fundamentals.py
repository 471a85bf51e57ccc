"""Queries over statements, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import RATIOS, VIRTUAL
from ..functions.formula import with_virtual_fields
from ..operators import facts, fundamentals as fu
from ..sources.scratch import written
from .views import based, oracle, shared, view

INCOME = "total_revenue cost_of_revenue gross_profit sales_general_and_admin sales_and_marketing general_and_administrative research_and_development total_operating_expenses operating_income interest_income interest_expense other_income income_before_taxes income_tax_expense net_income".split()
CASH = "net_cash_from_operating_activities depreciation_and_amortization depreciation amortization capital_expenditures net_cash_from_investing_activities net_cash_from_financing_activities net_change_in_cash cash_beginning_of_period cash_end_of_period".split()
KEY = "cik, ticker, period_end_date, fiscal_year, period_type, period_length_months"


def _t(name: str) -> str:
    return f"({name} IS NOT NULL AND {name} <> 0)"


def _chain(source: str, steps: list[tuple[str, str, str]], name: str) -> str:
    """CTEs that fill one column after the other."""
    out, at = [], source
    for k, (column, when, value) in enumerate(steps):
        out.append(f"{name}{k} AS (SELECT * REPLACE (CASE WHEN {column} IS NULL AND {when} THEN {value} ELSE {column} END AS {column}) FROM {at})")
        at = f"{name}{k}"
    return ", ".join(out)


# income -------------------------------------------------------------------------------------------------------------
def impute_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.impute_income(view(spark, sf_dir, "income"))
    return out.select(*fu.HEAD, *INCOME, fu.rounded(F.col("earnings_per_share_basic")).alias("earnings_per_share_basic"), "weighted_average_shares_basic")


_INCOME_STEPS = [
    ("cost_of_revenue", f"{_t('total_revenue')} AND {_t('gross_profit')}", "total_revenue - gross_profit"),
    ("gross_profit", f"{_t('total_revenue')} AND {_t('cost_of_revenue')}", "total_revenue - cost_of_revenue"),
    ("sales_general_and_admin", "sales_and_marketing IS NOT NULL AND general_and_administrative IS NOT NULL", "sales_and_marketing + general_and_administrative"),
    ("operating_income", f"{_t('gross_profit')} AND {_t('opex0')}", "gross_profit - opex0"),
    ("total_operating_expenses", f"{_t('gross_profit')} AND {_t('income0')}", "gross_profit - income0"),
    ("income_before_taxes", "net_income IS NOT NULL AND income_tax_expense IS NOT NULL", "net_income + income_tax_expense"),
    ("net_income", f"{_t('income_before_taxes')} AND income_tax_expense IS NOT NULL", "income_before_taxes - income_tax_expense"),
    ("income_tax_expense", f"{_t('income_before_taxes')} AND {_t('net0')}", "income_before_taxes - net0"),
]
IMPUTE_INCOME = oracle(f"""
WITH s AS (SELECT *, total_operating_expenses AS opex0, operating_income AS income0, net_income AS net0 FROM income), {_chain("s", _INCOME_STEPS, "i")}
SELECT {KEY}, {", ".join(INCOME)}, CASE WHEN {_t("net_income")} AND {_t("weighted_average_shares_basic")} THEN floor(CAST(net_income AS DOUBLE) / weighted_average_shares_basic * 1e6 + 0.5) / 1e6 END AS earnings_per_share_basic, weighted_average_shares_basic FROM i{len(_INCOME_STEPS) - 1}""")


# balance ------------------------------------------------------------------------------------------------------------
TOTALS = "total_current_assets total_non_current_assets total_assets total_current_liabilities total_non_current_liabilities total_liabilities total_stockholders_equity total_liabilities_and_equity long_term_debt non_current_long_term_debt".split()


def impute_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.impute_balance(view(spark, sf_dir, "balance").withColumn("total_non_current_liabilities", F.lit(None).cast("bigint"))).select("cik", "period_end_date", *TOTALS)


def _known(names: list[str]) -> tuple[str, str]:
    return " + ".join(f"(CASE WHEN {n} IS NULL THEN 0 ELSE 1 END)" for n in names), " + ".join(f"coalesce({n}, 0)" for n in names)


def _balance_steps() -> list[tuple[str, str, str]]:
    steps = []
    for whole, now, later in (("total_assets", "total_current_assets", "total_non_current_assets"), ("total_liabilities", "total_current_liabilities", "total_non_current_liabilities")):
        steps += [(now, f"{_t(whole + '0')} AND {_t(later + '0')}", f"{whole}0 - {later}0"), (later, f"{_t(whole + '0')} AND {_t(now + '0')}", f"{whole}0 - {now}0"), (whole, f"{_t(now + '0')} AND {_t(later + '0')}", f"{now}0 + {later}0")]
        for part in (now, later):
            n, total = _known([x for x in fu.PARTS[part] if x not in ("prepaid_expenses", "other_assets", "other_long_term_liabilities")])
            steps.append((part, f"coalesce({whole}, 0) = 0 AND ({n}) >= 2", total))
    return [*steps,
        ("total_stockholders_equity", f"{_t('total_assets')} AND {_t('total_liabilities')}", "total_assets - total_liabilities"),
        ("total_liabilities_and_equity", f"{_t('total_liabilities')} AND {_t('total_stockholders_equity')}", "total_liabilities + total_stockholders_equity"),
        ("total_liabilities_and_equity", _t("total_assets"), "total_assets"),
        ("long_term_debt", "(coalesce(non_current_long_term_debt, 0) <> 0 OR coalesce(current_portion_long_term_debt, 0) <> 0)", "coalesce(non_current_long_term_debt, 0) + coalesce(current_portion_long_term_debt, 0)"),
        ("non_current_long_term_debt", _t("debt0"), "debt0"),
    ]


IMPUTE_BALANCE = oracle(f"""
WITH s AS (SELECT *, CAST(NULL AS BIGINT) AS total_non_current_liabilities, CAST(NULL AS BIGINT) AS total_liabilities_and_equity, long_term_debt AS debt0, total_assets AS total_assets0, total_current_assets AS total_current_assets0, total_non_current_assets AS total_non_current_assets0,
  total_liabilities AS total_liabilities0, total_current_liabilities AS total_current_liabilities0, CAST(NULL AS BIGINT) AS total_non_current_liabilities0 FROM balance), {_chain("s", _balance_steps(), "b")}
SELECT cik, period_end_date, {", ".join(TOTALS)} FROM b{len(_balance_steps()) - 1}""")


# cash flow ----------------------------------------------------------------------------------------------------------
def impute_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.impute_cash_flow(view(spark, sf_dir, "cash_flow")).select(*fu.HEAD, *CASH)


_CASH_STEPS = [
    ("depreciation_and_amortization", "d0 IS NOT NULL AND a0 IS NOT NULL", "d0 + a0"),
    ("depreciation", f"{_t('all0')} AND a0 IS NOT NULL", "all0 - a0"),
    ("amortization", f"{_t('all0')} AND d0 IS NOT NULL", "all0 - d0"),
    ("net_change_in_cash", "net_cash_from_operating_activities + net_cash_from_investing_activities + net_cash_from_financing_activities IS NOT NULL", "net_cash_from_operating_activities + net_cash_from_investing_activities + net_cash_from_financing_activities"),
    ("cash_end_of_period", f"{_t('cash_beginning_of_period')} AND net_change_in_cash IS NOT NULL", "cash_beginning_of_period + net_change_in_cash"),
]
IMPUTE_CASH = oracle(f"WITH s AS (SELECT *, depreciation_and_amortization AS all0, depreciation AS d0, amortization AS a0 FROM cash_flow), {_chain('s', _CASH_STEPS, 'c')} SELECT {KEY}, {', '.join(CASH)} FROM c{len(_CASH_STEPS) - 1}")


def ebitda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.with_ebitda(view(spark, sf_dir, "income"), view(spark, sf_dir, "cash_flow")).select(*fu.HEAD, "operating_income", "ebitda")


EBITDA = oracle(f"""
SELECT {KEY}, operating_income, operating_income + coalesce(depreciation_and_amortization, CASE WHEN depreciation IS NOT NULL OR amortization IS NOT NULL THEN coalesce(depreciation, 0) + coalesce(amortization, 0) END) AS ebitda
FROM income LEFT JOIN (SELECT cik, period_end_date, period_type, period_length_months, depreciation_and_amortization, depreciation, amortization FROM cash_flow) USING (cik, period_end_date, period_type, period_length_months)""")


# trailing twelve months ---------------------------------------------------------------------------------------------
SHARES = "weighted_average_shares_basic"


def _ltm_sql(source: str, fields: list[str], need: list[str], shares: str) -> str:
    pct = lambda p: "(" + " + ".join(f"(CASE WHEN {p}{n} IS NOT NULL AND {p}{n} <> 0 THEN 1 ELSE 0 END)" for n in need) + ") * 100.0 / 5.0"
    values = ", ".join(f"CASE WHEN p.cik IS NOT NULL THEN y.{f} + n.{f} - p.{f} ELSE y.{f} + n.{f} END AS {f}" for f in fields)
    sums = ", ".join(f"sum(CASE WHEN q.fiscal_year = t.fiscal_year THEN q.{f} END) AS c_{f}, count(CASE WHEN q.fiscal_year = t.fiscal_year THEN q.{f} END) AS cn_{f}, sum(CASE WHEN q.fiscal_year < t.fiscal_year THEN q.{f} END) AS l_{f}, count(CASE WHEN q.fiscal_year < t.fiscal_year THEN q.{f} END) AS ln_{f}" for f in fields)
    quarter = ", ".join(f"CASE WHEN cn_{f} >= greatest(1, n // 2) THEN CAST(y.{f} + c_{f} - CASE WHEN ln_{f} >= greatest(1, n // 2) THEN l_{f} ELSE 0 END AS BIGINT) END AS {f}" for f in fields)
    keep, from_n, from_s = (f", {shares}", f", n.{shares}", f", s.{shares}") if shares else ("", "", "")
    head = "n.cik, n.ticker, n.period_end_date, n.fiscal_year, n.period_type, n.period_length_months"
    return f"""
full_year AS (SELECT * FROM {source} WHERE period_type = 'FY'),
now_ AS (SELECT * FROM {source} s WHERE period_type <> 'FY' AND NOT EXISTS (SELECT 1 FROM full_year f WHERE f.cik = s.cik AND f.period_end_date = s.period_end_date)),
same_ AS (SELECT * FROM (SELECT p.*, n.period_end_date AS at, row_number() OVER (PARTITION BY n.cik, n.period_end_date, n.period_length_months ORDER BY p.period_end_date DESC) AS rn FROM now_ n JOIN now_ p ON n.cik = p.cik AND n.period_length_months = p.period_length_months AND year(p.period_end_date) = year(n.period_end_date) - 1 AND abs(month(p.period_end_date) - month(n.period_end_date)) <= 2) WHERE rn = 1),
standard_ AS (SELECT {head}, CASE WHEN p.cik IS NOT NULL THEN 'standard' ELSE 'standard_fy_only' END AS calculation_method, {values}{from_n}
  FROM now_ n JOIN full_year y ON n.cik = y.cik AND y.fiscal_year = n.fiscal_year - 1 LEFT JOIN same_ p ON p.cik = n.cik AND p.at = n.period_end_date AND p.period_length_months = n.period_length_months
  WHERE n.period_length_months = CASE n.period_type WHEN 'Q1' THEN 3 WHEN 'Q2' THEN 6 WHEN 'Q3' THEN 9 END
    AND (n.period_type = 'Q1' OR CASE WHEN p.cik IS NOT NULL THEN ({pct("n.")} + {pct("y.")} + {pct("p.")}) / 3 > 50 ELSE ({pct("n.")} + {pct("y.")}) / 2 > 40 END)),
single_ AS (SELECT * FROM now_ WHERE period_length_months = 3),
sums_ AS (SELECT t.cik, t.ticker, t.period_end_date, t.fiscal_year, t.period_type, t.period_length_months{f", t.{shares}" if shares else ""}, CAST(substr(t.period_type, 2, 1) AS INT) AS n, count(CASE WHEN q.fiscal_year = t.fiscal_year THEN 1 END) AS n_now,
  coalesce(sum(CASE WHEN q.fiscal_year = t.fiscal_year THEN {pct("q.")} END), 0) AS c_score, coalesce(sum(CASE WHEN q.fiscal_year < t.fiscal_year THEN {pct("q.")} END), 0) AS l_score, {sums}
  FROM single_ t JOIN single_ q ON t.cik = q.cik AND q.period_type <= t.period_type AND q.fiscal_year BETWEEN t.fiscal_year - 1 AND t.fiscal_year WHERE t.period_type IN ('Q2', 'Q3') GROUP BY ALL),
quarterly_ AS (SELECT s.cik, s.ticker, s.period_end_date, s.fiscal_year, s.period_type, s.period_length_months, 'quarterly_sum' AS calculation_method, {quarter}{from_s}
  FROM sums_ s JOIN full_year y ON s.cik = y.cik AND y.fiscal_year = s.fiscal_year - 1
  WHERE {pct("y.")} > 20 AND n_now >= n * 0.5 AND ({pct("y.")} + c_score / n + l_score / n) / 3 > 30 AND NOT EXISTS (SELECT 1 FROM standard_ x WHERE x.cik = s.cik AND x.period_end_date = s.period_end_date)),
ltm_ AS (SELECT {KEY}, calculation_method, {", ".join(fields)}{keep} FROM standard_ UNION ALL SELECT {KEY}, calculation_method, {", ".join(fields)}{keep} FROM quarterly_)"""


def ltm_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.ltm(shared(spark, sf_dir, "income")).select(*fu.HEAD, "calculation_method", *INCOME, SHARES)


def ltm_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.ltm(shared(spark, sf_dir, "cash_flow"), "cash_flow").select(*fu.HEAD, "calculation_method", *CASH)


_LTM_INCOME = _ltm_sql("income", INCOME, fu.REQUIRED["income"], SHARES)
LTM_INCOME = oracle(f"WITH {_LTM_INCOME} SELECT * FROM ltm_")
LTM_CASH = oracle(f"WITH {_ltm_sql('cash_flow', CASH, fu.REQUIRED['cash_flow'], '')} SELECT * FROM ltm_")


def ltm_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.repaired(fu.ltm(shared(spark, sf_dir, "income")))
    return out.select("cik", "period_end_date", "gross_profit", "operating_income", "income_before_taxes", "net_income", fu.rounded(F.col("earnings_per_share_basic")).alias("eps"))


def _repair(name: str, value: str, when: str) -> str:
    return f"CASE WHEN {when} AND ({name} IS NULL OR abs({value} - {name}) > abs({value}) * 0.1) THEN {value} ELSE {name} END AS {name}"


LTM_DERIVED = oracle(f"""
WITH {_LTM_INCOME},
r0 AS (SELECT * REPLACE ({_repair("gross_profit", "(total_revenue - cost_of_revenue)", "total_revenue IS NOT NULL AND cost_of_revenue IS NOT NULL")}) FROM ltm_),
r1 AS (SELECT * REPLACE ({_repair("operating_income", "(gross_profit - total_operating_expenses)", "gross_profit IS NOT NULL AND total_operating_expenses IS NOT NULL")}) FROM r0),
r2 AS (SELECT * REPLACE ({_repair("income_before_taxes", "(operating_income + coalesce(other_income, 0) + coalesce(interest_income, 0) - coalesce(interest_expense, 0))", "operating_income IS NOT NULL")}) FROM r1),
r3 AS (SELECT * REPLACE ({_repair("net_income", "(income_before_taxes - coalesce(income_tax_expense, 0))", "income_before_taxes IS NOT NULL")}) FROM r2)
SELECT cik, period_end_date, gross_profit, operating_income, income_before_taxes, net_income, CASE WHEN {SHARES} > 0 THEN floor(CAST(net_income AS DOUBLE) / {SHARES} * 1e6 + 0.5) / 1e6 END AS eps FROM r3""")


def ltm_method_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = shared(spark, sf_dir, "income")
    return fu.best_method(fu.ltm(income).unionByName(fu.year_rows(income))).select("cik", "period_end_date", "period_type", "calculation_method", "total_revenue")


LTM_PRIORITY = oracle(f"""
WITH {_LTM_INCOME}, every AS (SELECT cik, period_end_date, period_type, calculation_method, total_revenue FROM ltm_ UNION ALL SELECT cik, period_end_date, period_type, 'fy_direct', total_revenue FROM income WHERE period_type = 'FY')
SELECT cik, period_end_date, period_type, calculation_method, total_revenue FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end_date ORDER BY list_position(['fy_direct', 'standard', 'quarterly_sum', 'standard_fy_only'], calculation_method), period_type) AS rn FROM every) WHERE rn = 1""")


# ratios -------------------------------------------------------------------------------------------------------------
def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = based(spark, sf_dir)
    income, cash, balance = (view(spark, sf_dir, n, base) for n in ("income", "cash_flow", "balance"))
    return fu.combined(income.filter("period_type = 'FY'"), cash.filter("period_type = 'FY'"), balance)


_SHEET = "cash_and_cash_equivalents short_term_investments cash_and_short_term_investments accounts_receivable inventory total_current_assets property_plant_equipment goodwill intangible_assets long_term_investments total_non_current_assets total_assets commercial_paper other_short_term_borrowings current_portion_long_term_debt finance_lease_liability_current operating_lease_liability_current total_current_liabilities long_term_debt non_current_long_term_debt finance_lease_liability_noncurrent operating_lease_liability_noncurrent total_stockholders_equity".split()
_PERIODS = f"""
sheet AS (SELECT y.cik AS sheet_cik, y.period_end_date AS at, b.period_end_date AS balance_date, {", ".join("b." + n for n in _SHEET)}, row_number() OVER (PARTITION BY y.cik, y.period_end_date ORDER BY abs(date_diff('day', b.period_end_date, y.period_end_date)), b.period_end_date DESC) AS rn
  FROM income y JOIN balance b ON y.cik = b.cik AND abs(date_diff('day', b.period_end_date, y.period_end_date)) <= 90 WHERE y.period_type = 'FY'),
periods AS (SELECT y.*, {", ".join("c." + n for n in CASH)}, s.balance_date, {", ".join("s." + n for n in _SHEET)} FROM (SELECT * FROM income WHERE period_type = 'FY') y
  LEFT JOIN (SELECT * FROM cash_flow WHERE period_type = 'FY') c ON y.cik = c.cik AND y.period_end_date = c.period_end_date LEFT JOIN (SELECT * FROM sheet WHERE rn = 1) s ON s.sheet_cik = y.cik AND s.at = y.period_end_date)"""


def _virtual_sql() -> str:
    """CTEs of the virtual fields in the order of the catalog, one after the other; NULL makes a term void, COALESCE takes 0 for null."""
    import re

    out, at = [], "periods"
    absent = {"acquisitions", "divestitures", "share_repurchases", "proceeds_from_stock_issuance"}
    for k, (name, ways) in enumerate(VIRTUAL.items()):
        terms = []
        for text in ways:
            text = text.replace("d&a", "d_and_a")
            text = re.sub(r"COALESCE\((\w+), 0\)", lambda m: "0" if m[1] in absent else f"coalesce({m[1]}, 0)", text)
            terms.append(f"CAST({text} AS DOUBLE)")
        out.append(f"v{k} AS (SELECT *, coalesce({', '.join(terms)}) AS {name.replace('d&a', 'd_and_a')} FROM {at})")
        at = f"v{k}"
    return ", ".join(out) + f", virtual_ AS (SELECT * FROM {at})"


FIELDS = [n.replace("d&a", "d_and_a") for n in VIRTUAL]


def virtual_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_virtual_fields(_periods(spark, sf_dir), VIRTUAL).select("cik", "period_end_date", "balance_date", *(fu.rounded(F.col(n), 2).alias(n) for n in FIELDS))


VIRTUAL_FIELDS = oracle(f"WITH {_PERIODS}, {_virtual_sql()} SELECT cik, period_end_date, balance_date, {', '.join(f'floor({n} * 100.0 + 0.5) / 100.0 AS {n}' for n in FIELDS)} FROM virtual_")


def ratios_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.ratios(_periods(spark, sf_dir), RATIOS, VIRTUAL, False).select("cik", "period_end_date", "ratio_name", "category", "ratio_value")


def _ratio_sql() -> str:
    import re

    rows = []
    for name, category, text in RATIOS:
        if "YOY_GROWTH" in text:
            continue
        top, bottom = text.rsplit(" / ", 1)
        plain = lambda t: re.sub(r"[a-z_]{2,}", lambda m: m[0] if m[0] in FIELDS else f"coalesce({m[0]}, 0)", t)
        rows.append(f"SELECT cik, period_end_date, '{name}' AS ratio_name, '{category}' AS category, CAST({plain(top)} AS DOUBLE) / nullif(CAST({plain(bottom)} AS DOUBLE), 0) AS v FROM virtual_")
    return " UNION ALL ".join(rows)


RATIOS_LONG = oracle(f"WITH {_PERIODS}, {_virtual_sql()}, long_ AS ({_ratio_sql()}) SELECT cik, period_end_date, ratio_name, category, floor(v * 1e6 + 0.5) / 1e6 AS ratio_value FROM long_ WHERE v IS NOT NULL")


def ratio_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of one ratio, read back from their JSON."""
    out = fu.ratios(_periods(spark, sf_dir), [r for r in RATIOS if r[0] == "ROE"], VIRTUAL)
    given = F.from_json("calculation_inputs", "map<string, double>")
    return out.select("cik", "period_end_date", given["net_income"].alias("net_income"), given["total_stockholders_equity"].alias("equity"))


RATIO_INPUTS = oracle(f"WITH {_PERIODS} SELECT cik, period_end_date, CAST(net_income AS DOUBLE) AS net_income, CAST(total_stockholders_equity AS DOUBLE) AS equity FROM periods WHERE total_stockholders_equity <> 0")


def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.growth(fu.best_method(fu.ltm(shared(spark, sf_dir, "income"))).select("cik", "ticker", "period_end_date", "total_revenue", "operating_income"), ["total_revenue", "operating_income"])


GROWTH_YOY = oracle(f"""
WITH {_LTM_INCOME}, flat AS (SELECT cik, ticker, period_end_date, 'total_revenue' AS field, CAST(total_revenue AS DOUBLE) AS value FROM ltm_ UNION ALL SELECT cik, ticker, period_end_date, 'operating_income', CAST(operating_income AS DOUBLE) FROM ltm_),
near AS (SELECT n.*, p.period_end_date AS prior_date, p.value AS prior, row_number() OVER (PARTITION BY n.cik, n.field, n.period_end_date ORDER BY abs(date_diff('day', p.period_end_date, n.period_end_date) - 365), p.period_end_date DESC) AS rn
  FROM flat n JOIN flat p ON n.cik = p.cik AND n.field = p.field AND date_diff('day', p.period_end_date, n.period_end_date) BETWEEN 330 AND 450)
SELECT cik, ticker, field, period_end_date, prior_date, floor((value - prior) / nullif(prior, 0) * 1e6 + 0.5) / 1e6 AS growth FROM near WHERE rn = 1 AND value IS NOT NULL AND prior <> 0""")


def _all_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LTM, and fiscal years where there is none, each with its cash flow and nearest balance sheet."""
    base = based(spark, sf_dir)
    income, cash, balance = (shared(spark, sf_dir, n, given=base) for n in ("income", "cash_flow", "balance"))
    of_income, of_cash = written(fu.best_method(fu.ltm(income))), fu.best_method(fu.ltm(cash, "cash_flow"))
    years = fu.trailing_and_years(of_income, income.filter("period_type = 'FY'"))
    flows = of_cash.withColumn("data_source", F.lit("LTM")).unionByName(cash.filter("period_type = 'FY'").withColumn("data_source", F.lit("FY")), allowMissingColumns=True)
    return written(fu.combined(years, flows, balance))


_BEST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end_date ORDER BY list_position(['fy_direct', 'standard', 'quarterly_sum', 'standard_fy_only'], calculation_method), period_type) AS rn FROM ltm_) WHERE rn = 1"
_HEAD = "cik, ticker, period_end_date, fiscal_year"
_ALL_PERIODS = f"""
trailing_income AS (WITH {_LTM_INCOME} {_BEST}), trailing_cash AS (WITH {_ltm_sql("cash_flow", CASH, fu.REQUIRED["cash_flow"], "")} {_BEST}),
flows AS (SELECT i.cik, i.ticker, i.period_end_date, i.fiscal_year, 'LTM' AS data_source, {", ".join("i." + n for n in INCOME)}, {", ".join("c." + n for n in CASH)} FROM trailing_income i LEFT JOIN trailing_cash c ON i.cik = c.cik AND i.period_end_date = c.period_end_date
  UNION ALL SELECT i.cik, i.ticker, i.period_end_date, i.fiscal_year, 'FY', {", ".join("i." + n for n in INCOME)}, {", ".join("c." + n for n in CASH)} FROM income i LEFT JOIN (SELECT * FROM cash_flow WHERE period_type = 'FY') c ON i.cik = c.cik AND i.period_end_date = c.period_end_date
  WHERE i.period_type = 'FY' AND NOT EXISTS (SELECT 1 FROM trailing_income t WHERE t.cik = i.cik AND t.period_end_date = i.period_end_date)),
sheet AS (SELECT y.cik AS sheet_cik, y.period_end_date AS at, b.period_end_date AS balance_date, {", ".join("b." + n for n in _SHEET)}, row_number() OVER (PARTITION BY y.cik, y.period_end_date ORDER BY abs(date_diff('day', b.period_end_date, y.period_end_date)), b.period_end_date DESC) AS rn
  FROM (SELECT DISTINCT cik, period_end_date FROM flows) y JOIN balance b ON y.cik = b.cik AND abs(date_diff('day', b.period_end_date, y.period_end_date)) <= 90),
periods AS (SELECT f.*, s.balance_date, {", ".join("s." + n for n in _SHEET)} FROM flows f LEFT JOIN (SELECT * FROM sheet WHERE rn = 1) s ON s.sheet_cik = f.cik AND s.at = f.period_end_date)"""


def ratios_ltm_fy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ratios of the catalog, growth too, over LTM and the fiscal years that LTM lacks."""
    periods = _all_periods(spark, sf_dir)
    plain = fu.ratios(periods, RATIOS, VIRTUAL, False).select("cik", "period_end_date", "data_source", "ratio_name", "category", "ratio_value")
    grown = with_virtual_fields(periods, VIRTUAL).select("cik", "ticker", "period_end_date", "data_source", "total_revenue", "ebitda")
    return plain.unionByName(fu.growth_ratios(written(grown), RATIOS, {}).select(*plain.columns))


def company_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of every company: LTM and fiscal years with figures of all three statements and their ratios."""
    periods = _all_periods(spark, sf_dir)
    long = fu.ratios(periods, [r for r in RATIOS if r[0] in FRAME], VIRTUAL, False)
    return fu.with_ratios(periods.select("cik", "period_end_date", "data_source", "total_revenue", "net_cash_from_operating_activities", "inventory"), long, FRAME)


FRAME = ["ROE", "Net_Margin", "Current_Ratio", "Debt_to_Equity", "Asset_Turnover"]


def growth_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of revenue, EBIT and EBITDA over LTM and fiscal years."""
    periods = with_virtual_fields(_all_periods(spark, sf_dir), VIRTUAL).select("cik", "ticker", "period_end_date", "data_source", "total_revenue", "ebit", "ebitda")
    return fu.growth(written(periods), ["total_revenue", "ebit", "ebitda"]).select("cik", "field", "period_end_date", "data_source", "prior_date", "growth")


_GROWN = """
flat AS (SELECT cik, period_end_date, data_source, field, value FROM (SELECT cik, period_end_date, data_source, CAST(total_revenue AS DOUBLE) AS total_revenue, ebit, ebitda FROM virtual_) UNPIVOT INCLUDE NULLS (value FOR field IN (total_revenue, ebit, ebitda))),
grown AS (SELECT n.*, p.period_end_date AS prior_date, p.value AS prior, row_number() OVER (PARTITION BY n.cik, n.field, n.period_end_date, n.data_source ORDER BY abs(date_diff('day', p.period_end_date, n.period_end_date) - 365), p.period_end_date DESC, p.data_source = 'FY') AS rn
  FROM flat n JOIN flat p ON n.cik = p.cik AND n.field = p.field AND date_diff('day', p.period_end_date, n.period_end_date) BETWEEN 330 AND 450),
growth_ AS (SELECT cik, field, period_end_date, data_source, prior_date, floor((value - prior) / nullif(prior, 0) * 1e6 + 0.5) / 1e6 AS growth FROM grown WHERE rn = 1 AND value IS NOT NULL AND prior <> 0)"""
_WITH_SOURCE = _ratio_sql().replace("SELECT cik, period_end_date,", "SELECT cik, period_end_date, data_source,")
COMPANY_FRAME = oracle(f"""WITH {_ALL_PERIODS}, {_virtual_sql()}, long_ AS ({_WITH_SOURCE}), w AS (SELECT cik, period_end_date, data_source, {", ".join(f'max(CASE WHEN ratio_name = {chr(39)}{n}{chr(39)} THEN floor(v * 1e6 + 0.5) / 1e6 END) AS {chr(34)}{n}{chr(34)}' for n in FRAME)} FROM long_ GROUP BY ALL)
SELECT p.cik, p.period_end_date, p.data_source, p.total_revenue, p.net_cash_from_operating_activities, p.inventory, {", ".join(f'"{n}"' for n in FRAME)} FROM periods p LEFT JOIN w ON p.cik = w.cik AND p.period_end_date = w.period_end_date AND p.data_source = w.data_source""")
GROWTH_ALL = oracle(f"WITH {_ALL_PERIODS}, {_virtual_sql()}, {_GROWN} SELECT * FROM growth_")
RATIOS_LTM_FY = oracle(f"""WITH {_ALL_PERIODS}, {_virtual_sql()}, {_GROWN}, long_ AS ({_WITH_SOURCE})
SELECT cik, period_end_date, data_source, ratio_name, category, floor(v * 1e6 + 0.5) / 1e6 AS ratio_value FROM long_ WHERE v IS NOT NULL
UNION ALL SELECT cik, period_end_date, data_source, CASE field WHEN 'total_revenue' THEN 'Revenue_Growth_YoY' ELSE 'EBITDA_Growth_YoY' END, 'growth', growth FROM growth_ WHERE field <> 'ebit'""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten companies whose trailing revenue has grown most, at their latest quarter."""
    income = shared(spark, sf_dir, "income").select(*fu.HEAD, "total_revenue", *[n for n in fu.REQUIRED["income"] if n != "total_revenue"])
    rows = fu.growth(fu.best_method(fu.ltm(income)).select("cik", "ticker", "period_end_date", "total_revenue"), ["total_revenue"])
    last = rows.groupBy("cik", "ticker").agg(F.max("period_end_date").alias("period_end_date"), F.max_by("growth", "period_end_date").alias("growth"))
    return last.orderBy(F.desc("growth"), "cik").limit(10)


FLAGSHIP = GROWTH_YOY.rsplit("SELECT cik, ticker, field", 1)[0] + """
SELECT cik, ticker, max(period_end_date) AS period_end_date, max_by(floor((value - prior) / prior * 1e6 + 0.5) / 1e6, period_end_date) AS growth FROM near WHERE rn = 1 AND field = 'total_revenue' AND value IS NOT NULL AND prior <> 0 GROUP BY cik, ticker ORDER BY growth DESC, cik LIMIT 10"""


# facts --------------------------------------------------------------------------------------------------------------
_FACT = """
SELECT cik, CASE k WHEN 0 THEN 'Revenues' WHEN 1 THEN 'salesRevenueNet' WHEN 2 THEN 'CostOfRevenue' WHEN 3 THEN 'NetIncomeLoss' ELSE 'UnknownTag' END AS tag, CASE WHEN k = 3 AND cik % 10 = 3 THEN 'EUR' ELSE 'USD' END AS unit,
  CASE WHEN (cik + k) % 9 = 0 THEN NULL ELSE make_date(fiscal_year, 1, 1) END AS start, last_day(make_date(fiscal_year, quarter * 3, 1)) AS "end", CASE WHEN (cik + k) % 17 = 0 THEN NULL ELSE last_day(make_date(fiscal_year, quarter * 3, 1)) + CAST(30 + k AS INT) END AS filed,
  CASE WHEN quarter = 4 THEN 'FY' ELSE concat('Q', CAST(quarter AS VARCHAR(9))) END AS fp, CAST(fiscal_year + CASE WHEN k = 2 THEN 1 ELSE 0 END AS INT) AS fy, CAST(CASE k WHEN 0 THEN rev WHEN 1 THEN rev + tax ELSE cost END AS DOUBLE) AS val
FROM sums CROSS JOIN (SELECT CAST(k AS INT) AS k FROM (VALUES (0), (1), (2), (3), (4)) x(k)) ks"""
_USABLE = """
usable AS (SELECT *, CASE WHEN months = 12 THEN 'FY' WHEN fp = 'FY' THEN 'Q4' ELSE fp END AS period_type FROM (SELECT *, CASE WHEN start IS NULL THEN CASE WHEN fp = 'FY' THEN 12 ELSE 3 END WHEN date_diff('day', start, "end") > 330 THEN 12 WHEN date_diff('day', start, "end") > 240 THEN 9 WHEN date_diff('day', start, "end") > 150 THEN 6 ELSE 3 END AS months
  FROM fact WHERE unit IN ('USD', 'shares', 'pure', 'USD/shares') AND "end" IS NOT NULL AND filed IS NOT NULL)),
mapped AS (SELECT *, CASE lower(tag) WHEN 'revenues' THEN 'total_revenue' WHEN 'salesrevenuenet' THEN 'total_revenue' WHEN 'costofrevenue' THEN 'cost_of_revenue' WHEN 'netincomeloss' THEN 'net_income' END AS "column" FROM usable WHERE lower(tag) IN ('revenues', 'salesrevenuenet', 'costofrevenue', 'netincomeloss'))"""


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import views

    views.VIEWS.setdefault("fact", _FACT.replace('"', "`"))
    return view(spark, sf_dir, "fact")


def _fact_oracle(sql: str) -> str:
    return oracle(f"WITH fact AS ({_FACT}), {_USABLE}, {sql}") if sql.startswith("x ") else oracle(f"WITH fact AS ({_FACT}), {_USABLE} {sql}")


def fact_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.mapped(facts.usable(_fact(spark, sf_dir)))
    return facts.pivoted(rows, ["total_revenue", "cost_of_revenue", "net_income"], ["cik", "end", "period_type", "period_length_months"])


FACT_PIVOT = _fact_oracle("""SELECT cik, "end", period_type, months AS period_length_months, max(CASE WHEN "column" = 'total_revenue' THEN val END) AS total_revenue, max(CASE WHEN "column" = 'cost_of_revenue' THEN val END) AS cost_of_revenue, max(CASE WHEN "column" = 'net_income' THEN val END) AS net_income FROM mapped GROUP BY cik, "end", period_type, months""")


def fact_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.one_year(facts.usable(_fact(spark, sf_dir))).select("cik", "tag", "end", "filed", "period_length_months", "fiscal_year", "start")


FACT_YEAR = _fact_oracle("""SELECT cik, tag, "end", filed, months AS period_length_months, first(fy ORDER BY filed, fy) OVER (PARTITION BY cik, "end", months) AS fiscal_year, coalesce(start, CAST("end" - to_months(months) AS DATE)) AS start FROM usable""").replace("first(fy ORDER BY filed, fy) OVER (PARTITION BY cik, \"end\", months)", "first_value(fy) OVER (PARTITION BY cik, \"end\", months ORDER BY filed, fy)")


def fact_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.mapped(facts.usable(_fact(spark, sf_dir))).withColumn("computed", F.lower("tag") == "revenues")
    return facts.preferred(rows, ["cik", "end", "period_length_months"])


FACT_PREFERRED = _fact_oracle("""SELECT cik, "end", period_length_months, "column", val, computed FROM (SELECT cik, "end", months AS period_length_months, "column", val, lower(tag) = 'revenues' AS computed, row_number() OVER (PARTITION BY cik, "end", months, "column" ORDER BY lower(tag) = 'revenues', filed, val) AS rn FROM mapped) WHERE rn = 1""")

QUERIES = {
    "flagship_ltm_growth": (flagship, FLAGSHIP),
    "impute_income": (impute_income, IMPUTE_INCOME),
    "impute_balance": (impute_balance, IMPUTE_BALANCE),
    "impute_cash_flow": (impute_cash_flow, IMPUTE_CASH),
    "ebitda": (ebitda, EBITDA),
    "ltm_income": (ltm_income, LTM_INCOME),
    "ltm_cash_flow": (ltm_cash_flow, LTM_CASH),
    "ltm_derived": (ltm_derived, LTM_DERIVED),
    "ltm_method_priority": (ltm_method_priority, LTM_PRIORITY),
    "virtual_fields": (virtual_fields, VIRTUAL_FIELDS),
    "ratios_long": (ratios_long, RATIOS_LONG),
    "ratio_inputs_json": (ratio_inputs, RATIO_INPUTS),
    "growth_yoy": (growth_yoy, GROWTH_YOY),
    "ratios_ltm_fy": (ratios_ltm_fy, RATIOS_LTM_FY),
    "company_frame": (company_frame, COMPANY_FRAME),
    "growth_all": (growth_all, GROWTH_ALL),
    "fact_pivot_max": (fact_pivot, FACT_PIVOT),
    "fact_fiscal_year_unify": (fact_year, FACT_YEAR),
    "preferred_value": (fact_preferred, FACT_PREFERRED),
}
